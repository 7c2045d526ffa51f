"""Personal data: patterns, and terms that give a protected value away because they co-occur with it in the corpus.

DataFrame functions only. Patterns are written so that Java's matcher neither backtracks far nor recurses; each gives the
leftmost non-overlapping matches of the plain pattern beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import settled, stash, texts

#: Kinds in their order, with the plain pattern and the one that is run. A match of a run-on pattern can only begin where a
#: run of its first class begins, or right after the match before.
PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9]([\x20-]?[0-9])+", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Share of the information in a protected value that a term may disclose: terms beyond the first are generalised, beyond
#: the second removed; and the number of different texts with a value that must hold the term.
GENERALISE, REMOVE, SUPPORT = 0.5, 0.8, 2
#: Terms: runs of letters, marks and digits, lower-cased, of at least this many characters.
TERM, SHORTEST = r"[\p{L}\p{M}\p{N}]+", 3
#: Tasks that copies of one text are spread over.
SALTS = 16
#: Matches of a text that are placed together.
GROUP = 256

KINDS = (*PATTERNS, "generalise", "remove")


def running(pieces: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<`kind`> of the pieces, struct<gap, value>, in order: step(where the value begins in code points, its piece), null
    for none. Pieces are added up in groups of GROUP and the groups after that, so the cost does not grow with the square."""
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))
    none = F.array().cast(f"array<{kind}>")

    def group(part: Column, begin: Column) -> Column:
        def add(acc, x):
            own = step(acc["at"] + F.length(x["gap"]), x)
            return F.struct((acc["at"] + size(x)).alias("at"), F.when(own.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(own))).alias("out"))

        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def placed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + size(x)))
        begins = F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), group))

    # An array of one element is a name for a value that is used several times and computed once.
    split = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / GROUP).cast("int")), lambda k: F.slice(own, k * GROUP + 1, F.lit(GROUP)))
    return F.transform(F.transform(F.array(pieces), split), placed)[0]


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<gap, value>>: what lies before each match, and the match; the last gap has none after it."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points."""
    span = lambda start, x: F.when(x["value"].isNotNull(), F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")))
    return running(pieces(text, pattern), span, "struct<start:int,end:int,value:string>")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its digits added; the sum of all is a multiple of ten."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is one: parts of an address up to 255, 13 to 19 digits that pass Luhn, 9 to 15 digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike(r"^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), passes_luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the base kinds, in the order of KINDS, then start."""
    out, none = [], F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    for kind, (_, pattern) in PATTERNS.items():
        needs = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        out.append(F.when(needs, _of_kind(kind, matches(text, pattern))).otherwise(none))
    return F.concat(*out)


def _of_kind(kind: str, found: Column) -> Column:
    place = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(F.filter(found, lambda m: holds(kind, m["value"])), lambda m: F.struct(place, m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind)))


def written(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms(text: Column, base: Column) -> Column:
    """The different terms of a text outside its base spans, lower-cased."""
    outside = F.when(F.size(base) == 0, text).otherwise(cleaned(text, base, " "))
    words = F.filter(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)), lambda x: F.length(x) >= SHORTEST)
    return F.array_distinct(F.transform(words, F.lower))


def places(text: Column, kinds: Column) -> Column:
    """array<struct<kind, start, end>> of all words whose lower-cased form is in `kinds`, a map from terms."""

    def step(start, x):
        kind = F.element_at(kinds, F.lower(x["value"]))
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end")))

    return running(pieces(text, TERM), step, "struct<kind:int,start:int,end:int>")


def disclosures(held: DataFrame, document_terms: DataFrame, documents: int) -> DataFrame:
    """(text_id, kinds): for each text with protected values the terms that disclose too much of one, as a map to their kind.

    Of a value with probability p(v) a term discloses log p(v|t) / p(v) of -log p(v) bits, both from the corpus: documents
    with both, against all that hold the term. SUPPORT different texts must have both; values in fewer are left out first.
    `held` is (text_id, n, values, terms) for each text, a written table, n documents having the text; `document_terms` (term,
    documents).

    A value that very many texts hold is no large group: its texts are counted by task first, only (text, value) travels to the
    count, and values with their terms are aggregated by both, by task first, before anything is joined by value. What is then
    joined by value is written and joined on by another key next, so Spark can split a value with very many terms."""
    each = held.select("text_id", "n", F.explode("values").alias("value"))
    own = each.groupBy("value").agg(F.sum("n").alias("contexts"), F.count("*").alias("different")).where(F.col("different") >= SUPPORT)
    own = stash(own.drop("different"), "values").hint("shuffle_merge")
    supported = each.select("text_id", "value").join(own.select("value"), "value", "left_semi").groupBy("text_id").agg(F.collect_list("value").alias("supported"))
    kept = stash(held.select("text_id", "n", "terms").join(supported.hint("shuffle_merge"), "text_id"), "supported")
    pairs = kept.select("text_id", "n", "terms", F.explode("supported").alias("value")).select("text_id", "n", "value", F.explode("terms").alias("term"))
    joint = stash(pairs.groupBy("value", "term").agg(F.sum("n").alias("both"), F.count("*").alias("different")).where(F.col("different") >= SUPPORT), "joint")
    total = F.lit(float(max(2, documents)))
    information = F.log2(total / F.col("contexts"))
    share = F.when(information > 0, 1 + F.log2(F.least(F.lit(1.0), F.col("both") / F.col("documents"))) / information)
    met = joint.join(own, "value").join(document_terms.hint("shuffle_merge"), "term")
    risky = stash(met.select("value", "term", share.alias("share")).where(F.col("share") > GENERALISE), "risky")
    kind = F.when(F.col("share") > REMOVE, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    hits = pairs.join(risky.hint("shuffle_merge"), ["value", "term"]).groupBy("text_id", "term").agg(F.max(kind).alias("kind"))
    return hits.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans, both array<struct<kind, start, end, value>> by kind (a place in
    KINDS), then start. `spans` also has all places of the terms that disclose too much of a protected value of the text.

    Null and empty texts have no spans. Repeated rows and ids give a row each; a null id stays null; an empty table gives no
    rows; texts of any length are searched whole; other columns are not carried.

    `df` is evaluated once for the spans, which are written with a number for each row and with the text where there are some,
    and once for the words of all documents, which need no number. Only documents with protected values are shuffled; words
    are counted by task first, and so are values with their terms. A text that very many documents share is spread over
    SALTS tasks when its spans come back to them. All tables that grow with the documents are joined by a shuffle."""
    return _found(df, id_col, text_col).select("row", "doc_id", "base", "spans")


def _found(df: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """(row, doc_id, text, base, spans). The text is null where there are no spans, unless it is asked for as a `whole`."""
    spans = texts(df, id_col, text_col).withColumn("base", base_spans(F.col("text")))
    rows = stash(spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.lit(whole) | (F.size("base") > 0), F.col("text")).alias("text"), "base"), "spans")
    words = spans.select(F.explode(terms(F.col("text"), F.col("base"))).alias("term"))
    added = settled(lambda: _added(rows, words, rows.count()), "added")
    overlaps = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.array_sort(F.filter(F.coalesce("more", F.array().cast(added.schema["more"].dataType)), lambda x: ~overlaps(x)))
    return rows.join(added.hint("shuffle_merge"), "row", "left").select("row", "doc_id", "text", "base", F.concat("base", more).alias("spans"))


def _added(rows: DataFrame, words: DataFrame, documents: int) -> DataFrame:
    """(row, more): the disclosing terms of the rows that have some."""
    found = rows.where(F.size("base") > 0).select("row", "text", F.sha2("text", 256).alias("text_id"), "base")
    once = found.groupBy("text_id", "text", "base").agg(F.count("*").alias("n"))
    values = F.array_distinct(F.transform("base", lambda b: b["value"]))
    once = stash(once.select("text_id", "text", "n", values.alias("values"), terms(F.col("text"), F.col("base")).alias("terms")), "texts")
    counted = words.groupBy("term").agg(F.count("*").alias("documents"))
    kinds = disclosures(once.select("text_id", "n", "values", "terms"), counted, documents)
    span = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(None).cast("string").alias("value"))
    more = stash(once.join(kinds.hint("shuffle_merge"), "text_id").select("text_id", F.transform(places(F.col("text"), F.col("kinds")), span).alias("more")), "disclosed")
    spread = more.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = found.select("row", "text_id", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")).join(spread.hint("shuffle_merge"), ["text_id", "salt"])
    return placed.select("row", "more")


def cleaned(text: Column, spans: Column, mask: str | None = None) -> Column:
    """The text with its spans replaced: by `mask` if there is one, else base kinds by their name, generalised terms by a
    class, removed ones by nothing. Where spans overlap, what they cover together goes."""
    token = lambda s: F.lit(mask) if mask is not None else F.when(s["kind"] == KINDS.index("remove"), "").when(s["kind"] == KINDS.index("generalise"), "[TERM]").otherwise(F.concat(F.lit("["), F.upper(F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"])), F.lit("]")))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), token(s))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text without personal data and without what gives it away. Base kinds become their
    name in brackets, generalised terms `[TERM]`, removed ones nothing.

    Null and empty texts give an empty text; repeated rows and ids give a row each; a null id stays null; an empty table
    gives no rows; texts are taken whole; other columns are not carried."""
    found = _found(df, id_col, text_col, whole=True)
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(cleaned(F.col("text"), F.col("spans"))).alias("text"))
