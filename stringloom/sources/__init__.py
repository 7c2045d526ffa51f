"""Where inputs come from: files, tables with text or bytes, models, containers."""
