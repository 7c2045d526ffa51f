"""Extractors by name: functions from one input's bytes to rows, each an SQL table function and a table of `extract`."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from stringloom.operators import code, entries, language, runs
from stringloom.schema import Options
from stringloom.sources.containers import architectures


@dataclass(frozen=True)
class Extractor:
    """`rows(parsed, content, options)` gives the rows, of type `returns` (name:type, comma-joined), of one architecture of an
    input, `parsed` being a row of PARSED as a dict. It runs in tasks, so it must be a function that executors can import, or a
    closure; it must not change what it is given."""

    name: str
    returns: str
    rows: Callable[[dict, bytes, Options], Iterable[tuple]]


REGISTRY: dict[str, Extractor] = {}


def add(extractor: Extractor) -> Extractor:
    """Register an extractor; its name must be new."""
    if not extractor.name.isidentifier() or extractor.name in REGISTRY:
        raise ValueError(f"no new name: {extractor.name}")
    REGISTRY[extractor.name] = extractor
    return extractor


def chosen(which: Iterable[str | Extractor]) -> list[Extractor]:
    """Extractors by their names, or as they are; an unknown name is an error when the plan is made."""
    out = [x if isinstance(x, Extractor) else REGISTRY.get(x) or _unknown(x) for x in which]
    if len({x.name for x in out}) < len(out):
        raise ValueError("an extractor is named twice")
    return out


def _unknown(name: str):
    raise ValueError(f"no extractor {name!r}; there are {sorted(REGISTRY)}")


def _strings(parsed: dict, data: bytes, options: Options):
    sections, out = parsed["sections"], runs.Strings()
    runs.scanned(out, data, parsed["scan_start"], parsed["scan_end"], sections, options, targets=code.references(parsed["arch"], sections, data))
    language.scanned(out, data, sections, language.toolchain_of(sections, data), options)
    runs.decoded_into(out, data, parsed["arch_idx"], sections, options)
    names = ("kind", "encoding", "value", "offset", "address", "section", "xrefs")
    return zip(*(out.columns[n] for n in names))


STRINGS = add(Extractor("strings", "kind:string,encoding:string,value:string,offset:bigint,address:bigint,section:string,xrefs:int", _strings))
FUNCTION_STARTS = add(Extractor("function_starts", entries.START, lambda x, data, _: entries.starts_of(x["arch"], x["sections"], data)))
IMPORT_CALLS = add(Extractor("import_calls", entries.CALL, lambda x, data, _: entries.import_calls_of(x["arch"], x["sections"], x["imports"], data)))
DIRECT_CALLS = add(Extractor("direct_calls", "place:bigint,target:bigint", lambda x, data, _: entries.direct_calls_of(x["arch"], x["sections"], x["symbols"], x["entry"], data)))
REFERENCES = add(Extractor("references", "place:bigint,target:bigint", lambda x, data, _: code.taken_addresses(x["arch"], x["sections"], data)))


def register(spark: SparkSession, *which: str | Extractor, prefix: str = "extract_") -> None:
    """Each extractor, all of the registry by default, as an SQL table function: `SELECT * FROM inputs, LATERAL
    extract_function_starts(content)`. Further arguments: kinds of strings, comma-joined (null for all), the least length of
    strings, and the format. Inputs that cannot be read and null contents have no rows."""
    for x in chosen(which or REGISTRY):
        spark.udtf.register(prefix + x.name, udtf(_table_function(x), returnType=x.returns.replace(":", " ")))


def _table_function(extractor: Extractor) -> type:
    class Rows:
        def eval(self, content: bytes, kinds: str | None = None, least: int = 4, form: str = "auto"):
            options = Options(min_length=least, enabled=tuple(kinds.split(",")) if kinds else None, format=form, decode_base64=bool(kinds) and "base64" in kinds.split(","))
            data = bytes(content or b"")
            for x in architectures("", data, form):
                if not x["error"]:
                    yield from extractor.rows(x, data, options)

    return Rows
