"""Tags and scores of a string, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the tags.
URL = r"^(?i)(https?|ftp)://"
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"
EMAIL = r"^[^@]+@[^@.](?:[^@]*[^@.])?$"
PATH = r"^(?:/|\\\\|[A-Za-z]:[/\\])"
REGISTRY = r"^(?i)(HKEY_|HK(?:LM|CU|CR|U)\\)"
#: Trigrams of characters that a model can count.
TRIGRAMS = 130**3
BEGIN, END = "\u0080", "\u0081"


def is_email(v: Column) -> Column:
    return v.rlike(EMAIL) & ~v.rlike(r"(?U)\s") & F.contains(F.substring_index(v, "@", -1), F.lit("."))


def is_ipv6(v: Column) -> Column:
    """Up to eight groups of hexadecimal digits, one run of zero groups as `::`, the last two groups as an IPv4 address."""
    plain = F.regexp_replace(v, r"(?<=:)(?:\d{1,3}\.){3}\d{1,3}$", "0:0")
    tail = F.regexp_extract(v, r"(?<=:)((?:\d{1,3}\.){3}\d{1,3})$", 1)
    colons = F.length(plain) - F.length(F.replace(plain, F.lit(":"), F.lit("")))
    shaped = plain.rlike(r"^(?:[0-9A-Fa-f]{1,4}|:(?=:)|(?<=:):|(?<=[0-9A-Fa-f]):(?=[0-9A-Fa-f:]))+$")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    doubles = F.size(F.split(plain, "::", -1)) - 1
    whole = (doubles == 0) & (colons == 7) & (groups == 8)
    short = (doubles == 1) & (groups <= 7) & ~plain.rlike("^:[^:]|[^:]:$|:::")
    return shaped & (whole | short) & ((tail == "") | tail.rlike(IPV4))


def tags(v: Column, kind: Column | None = None, in_library: Column | None = None, code: Column | None = None) -> Column:
    """array<string> of tags in their order: code, url, ip_address, email, path, registry, library, base64."""
    no = F.lit(False)
    rules = [("code", code if code is not None else no), ("url", v.rlike(URL)), ("ip_address", v.rlike(IPV4) | (F.contains(v, F.lit(":")) & is_ipv6(v))), ("email", is_email(v)), ("path", v.rlike(PATH)), ("registry", v.rlike(REGISTRY))]
    rules += [("library", in_library if in_library is not None else no), ("base64", kind == "base64" if kind is not None else no)]
    return F.filter(F.array(*(F.when(F.coalesce(hit, no), F.lit(name)) for name, hit in rules)), lambda x: x.isNotNull())


def quality(v: Column) -> Column:
    """0 to 1: much of letters and digits, many different bytes, no long run of one byte; a little more for short strings.
    Other than ASCII counts by its UTF-8 bytes."""
    b = F.when(F.octet_length(v) == F.char_length(v), v).otherwise(F.decode(F.encode(v, "UTF-8"), "ISO-8859-1"))
    n = F.length(b).cast("double")
    kinds = F.size(F.array_distinct(F.split(b, ""))).cast("double")
    good = F.length(F.regexp_replace(b, "[^A-Za-z0-9]", "")).cast("double")
    longest = F.aggregate(F.regexp_extract_all(b, F.lit(r"(?s)((.)\2++)"), F.lit(1)), F.lit(1), lambda m, x: F.greatest(m, F.length(x)))
    score = F.lit(0.6) * ((good / n) * (kinds / n)) + F.lit(0.4) * (F.lit(1.0) - (longest - 1) / n) + F.when(n <= 6, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def trigrams(v: Column, lowercase: bool | Column) -> Column:
    """The trigrams of an ASCII string of three characters or more, from its first two after the beginning to its end."""
    text = F.when(lowercase, F.lower(v)).otherwise(v) if isinstance(lowercase, Column) else F.lower(v) if lowercase else v
    marked = F.concat(F.lit(BEGIN * 2), text, F.lit(END))
    return F.when(v.rlike(r"^\p{ASCII}{3,}$"), F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.substring(marked, i + 1, F.lit(3))))


def trigram_scores(strings: DataFrame, model: DataFrame, lowercase: bool | None = None) -> DataFrame:
    """(value, trigram_score) of each distinct `value`: the mean log10 probability of its trigrams, each count with one added;
    null for a string that the model does not apply to. Trigrams are counted before they meet the model, so a frequent one
    is a row for each task. Whether strings are lower-cased is what the model says, in its column `lowercase`, if
    nothing else is asked for. No job runs while the plan is built: the model's total is a scalar subquery."""
    own = lowercase if lowercase is not None else model.agg(F.coalesce(F.max("lowercase"), F.lit(False))).scalar() if "lowercase" in model.columns else False
    total = (F.coalesce(model.agg(F.sum("n")).scalar(), F.lit(0)) + TRIGRAMS).cast("double")
    values = strings.select("value").distinct().withColumn("lower", F.lit(own) if isinstance(own, bool) else own)
    grams = values.select("value", F.explode(trigrams(F.col("value"), F.col("lower"))).alias("gram"))
    known = grams.groupBy("value", "gram").agg(F.count("*").alias("times")).join(model.select("gram", "n"), "gram", "left").withColumn("total", total)
    score = F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.col("total"))) / F.sum("times")
    return values.select("value").join(known.groupBy("value").agg(score.alias("trigram_score")), "value", "left")


def once(c: Column) -> Column:
    """A row generator that gives `c` for each row, so that a filter on it is not pushed below it and computed again."""
    return F.explode(F.array(c))
