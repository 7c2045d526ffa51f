"""The registered queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.functions import capabilities
from stringloom.functions import text as T
from stringloom.operators import code, runs, strings
from stringloom.plans.extract import examined, extract
from stringloom.schema import Options
from stringloom.sources import inputs
from stringloom.tables import stash

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CAPABILITIES_SQL = "capabilities(place, name, tag) AS (VALUES " + ", ".join(f"({i}, '{name}', '{tag}')" for i, (name, tag) in enumerate(capabilities.rows())) + ")"

ASCII = Options(enabled=("static_ascii",))


def text_inputs(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    return inputs.table(read(spark, sf_dir, name), id_col, "text")


def found(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id", options: Options = ASCII) -> DataFrame:
    return strings.located(examined(text_inputs(spark, sf_dir, name, id_col), options))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of all turns of conversations."""
    return read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")


# ASCII runs of a table's texts: segments of other bytes and a run; a run begins where its segment ends, less its length.
def ascii_sql(table: str = "documents", key: str = "doc_id") -> str:
    return rf"""
        segments AS (SELECT {key} AS id, unnest(regexp_extract_all(text, '[^\t\x20-\x7E]*[\t\x20-\x7E]+')) AS seg,
                            generate_subscripts(regexp_extract_all(text, '[^\t\x20-\x7E]*[\t\x20-\x7E]+'), 1) AS i FROM {table}),
        pieces AS (SELECT id, i, regexp_extract(seg, '[\t\x20-\x7E]+$') AS value, sum(strlen(seg)) OVER (PARTITION BY id ORDER BY i) AS ends FROM segments),
        runs AS (SELECT CAST(id AS VARCHAR) AS input_id, value, CAST(ends - strlen(value) AS BIGINT) AS "offset" FROM pieces WHERE strlen(value) >= 4)"""


@query(f"WITH {ascii_sql()} SELECT * FROM runs")
def ascii_runs(spark, sf_dir):
    return found(spark, sf_dir).select("input_id", "value", "offset")


@query(f"WITH {ascii_sql()} SELECT * FROM runs")
def ascii_runs_native(spark, sf_dir):
    return runs.ascii_runs_native(text_inputs(spark, sf_dir), 4)


@query(rf"""
    WITH {ascii_sql()},
    split AS (SELECT value, string_split(value, '') AS c FROM (SELECT DISTINCT value FROM runs)),
    marked AS (SELECT value, c, array_to_string(list_transform(list_zip(c, list_slice(c, 2, len(c))), lambda p: CASE WHEN p[1] = p[2] THEN '1' ELSE '0' END), '') AS same FROM split),
    sized AS (SELECT value, CAST(strlen(value) AS DOUBLE) AS n, CAST(len(list_distinct(c)) AS DOUBLE) AS dc, CAST(strlen(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) AS DOUBLE) AS al,
                     coalesce(list_max(list_transform(regexp_extract_all(same, '1+'), lambda x: strlen(x))), 0) + 1 AS mr FROM marked),
    scored AS (SELECT value, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * ((al / n) * (dc / n)) + 0.4::DOUBLE * (1.0::DOUBLE - (mr - 1) / n)
        + CASE WHEN n <= 6 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)), 9) AS quality FROM sized)
    SELECT input_id, value, "offset", quality FROM runs JOIN scored USING (value) WHERE quality >= 0.4""")
def ascii_quality(spark, sf_dir):
    scored = found(spark, sf_dir, options=Options(enabled=("static_ascii",), min_quality=0.4 - 1e-9)).select("input_id", "value", "offset", "quality")
    return scored.withColumn("quality", F.round("quality", 9)).where("quality >= 0.4")


UNICODE = r"\x00-\x08\x0a-\x1f\x7f-\x9f\x{FFFD}-\x{FFFF}\x{FEFF}\x{FDD0}-\x{FDEF}"


@query(rf"""
    WITH segments AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[{UNICODE}]*[^{UNICODE}]+')) AS seg, generate_subscripts(regexp_extract_all(text, '[{UNICODE}]*[^{UNICODE}]+'), 1) AS i FROM conversations),
    pieces AS (SELECT conv_id, turn, regexp_extract(seg, '[^{UNICODE}]+$') AS value, sum(strlen(seg)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS ends FROM segments)
    SELECT conv_id || '/' || turn AS input_id, value, CAST(ends - strlen(value) AS BIGINT) AS "offset", CAST(strlen(value) AS BIGINT) AS length FROM pieces WHERE length(value) >= 4""")
def utf8_runs(spark, sf_dir):
    wanted = Options(enabled=("static_utf8",))
    return strings.located(examined(inputs.table(turns(spark, sf_dir), "id", "text"), wanted)).select("input_id", "value", "offset", "length")


def utf16_sql(texts: str, both: bool) -> str:
    """Runs of the texts (id, text) as UTF-16LE, in all alignments and, if `both`, in the other byte order too: the units of each
    reading as a text of its own. Surrogates and NUL, which separate, become U+0001; only the first reading can hold more."""
    reading = lambda kind, align, v: f"""SELECT id, '{kind}' AS kind, {align} AS align, array_to_string(list_transform({v}, lambda x: CASE WHEN x = 0 OR x BETWEEN 55296 AND 57343 THEN chr(1) ELSE chr(x) END), '') AS s FROM pairs"""
    others = [reading("static_utf16_le", 1, "list_transform(p, lambda q: ((q[2] & 255) << 8) | (q[1] >> 8))")]
    if both:
        others += [reading("static_utf16_be", 0, "list_transform(u, lambda x: ((x & 255) << 8) | (x >> 8))"), reading("static_utf16_be", 1, "list_transform(p, lambda q: ((q[1] >> 8) << 8) | (q[2] & 255))")]
    units = lambda x: f"length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    return rf"""
        units AS (SELECT id, text, flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END)) AS u FROM ({texts})),
        pairs AS (SELECT id, text, u, list_slice(list_zip(u, list_slice(u, 2, len(u))), 1, len(u) - 1) AS p FROM units),
        readings AS (SELECT id, 'static_utf16_le' AS kind, 0 AS align, text AS s FROM pairs UNION ALL {" UNION ALL ".join(others)}),
        segments AS (SELECT id, kind, align, unnest(regexp_extract_all(s, '[{UNICODE}]*[^{UNICODE}]+')) AS seg, generate_subscripts(regexp_extract_all(s, '[{UNICODE}]*[^{UNICODE}]+'), 1) AS i FROM readings),
        pieces AS (SELECT id, kind, align, regexp_extract(seg, '[^{UNICODE}]+$') AS value, sum({units("seg")}) OVER (PARTITION BY id, kind, align ORDER BY i) AS ends FROM segments),
        wide AS (SELECT CAST(id AS VARCHAR) AS input_id, value, kind, CAST(align + 2 * (ends - ({units("value")})) AS BIGINT) AS "offset", CAST(2 * ({units("value")}) AS BIGINT) AS length FROM pieces WHERE length(value) >= 4)"""


@query(f'WITH {utf16_sql("SELECT doc_id AS id, text FROM documents", False)} SELECT input_id, value, "offset", length FROM wide')
def utf16_runs(spark, sf_dir):
    """All texts as UTF-16LE, read at even and odd offsets."""
    wide = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-16LE").alias("text"))
    return strings.located(examined(inputs.table(wide, "doc_id", "text"), Options(enabled=("static_utf16_le",)))).select("input_id", "value", "offset", "length")


@query(rf"""
    WITH {utf16_sql("SELECT conv_id || '/' || turn AS id, text FROM conversations", True)},
    plain AS (SELECT * FROM wide WHERE regexp_full_match(value, '[\x00-\x7F]*'))
    SELECT w.input_id, w.value, w.kind, w."offset" FROM wide w LEFT JOIN plain o
        ON w.input_id = o.input_id AND w.kind <> o.kind AND o."offset" = w."offset" - 1 AND o.length = w.length + 2 AND regexp_full_match(w.value, '[\x00-\x7F]*')
    WHERE o.input_id IS NULL""")
def endian_suppression(spark, sf_dir):
    """All turns as UTF-16LE, read in both byte orders and alignments, without rows that only the wrong order sees. After a line
    break the wrong order sees as much as the true one, and both stay."""
    wide = turns(spark, sf_dir).select("id", F.encode("text", "UTF-16LE").alias("text"))
    located = stash(strings.located(examined(inputs.table(wide, "id", "text"), Options(enabled=("static_utf16_le", "static_utf16_be")), mirrored=True)))
    return runs.without_mirrored(located).select("input_id", "value", "kind", "offset")


@query(f"""
    WITH {ascii_sql("conversations", "(conv_id * 1000 + turn)")}, sizes AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS input_id, text FROM conversations)
    SELECT input_id, value, CAST(0 AS BIGINT) AS "offset", "offset" AS decoded_offset, CAST(4 * ((strlen(text) + 2) // 3) AS BIGINT) AS source_length FROM runs JOIN sizes USING (input_id)
    WHERE 4 * ((strlen(text) + 2) // 3) BETWEEN 8 AND 1048576""")
def base64_recover(spark, sf_dir):
    coded = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("text"))
    options = Options(enabled=("static_ascii", "base64"), decode_base64=True)
    located = strings.located(examined(inputs.table(coded, "id", "text"), options))
    return located.where("kind = 'base64'").select("input_id", "value", "offset", "decoded_offset", "source_length")


TOKENS_SQL = r"""tokens AS (SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(html, '[\s"''<>()\[\]{}=,;]+')) AS token FROM pages UNION ALL SELECT url FROM pages) WHERE token <> '')"""
TAGS_SQL = r"""tagged AS (SELECT token, concat_ws(' ',
        CASE WHEN regexp_matches(token, '^(?i)(https?|ftp)://') THEN 'url' END,
        CASE WHEN regexp_matches(token, '^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$') THEN 'ip_address' END,
        CASE WHEN regexp_matches(token, '^[^@]+@[^@.](?:[^@]*[^@.])?$') AND contains(split_part(token, '@', 2), '.') THEN 'email' END,
        CASE WHEN regexp_matches(token, '^(?:/|\\\\|[A-Za-z]:[/\\])') THEN 'path' END,
        CASE WHEN regexp_matches(token, '^(?i)(HKEY_|HK(?:LM|CU|CR|U)\\)') THEN 'registry' END) AS tags FROM tokens)"""


def tokens(spark, sf_dir) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    split = pages.select(F.explode(F.split("html", r"[\s\x22\x27<>()\[\]{}=,;]+")).alias("token"))
    return split.unionAll(pages.select(F.col("url").alias("token"))).where("token <> ''").distinct()


@query(f"WITH {TOKENS_SQL}, {TAGS_SQL} SELECT * FROM tagged WHERE tags <> ''")
def tags_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("token", F.array_join(T.tags(F.col("token")), " ").alias("tags")).where("tags <> ''")


@query(f"WITH {TOKENS_SQL}, {TAGS_SQL} SELECT token FROM tagged WHERE list_has_any(string_split(tags, ' '), ['email', 'ip_address'])")
def tag_any_filter(spark, sf_dir):
    tagged = tokens(spark, sf_dir).select("token", F.col("token").alias("value"), T.tags(F.col("token")).alias("tags"))
    return strings.late_filters(tagged, Options(required_tags=("email", "ip_address"))).select("token")


@query(f"""
    WITH {ascii_sql()}, library AS (SELECT value FROM runs GROUP BY value HAVING count(DISTINCT input_id) >= 5)
    SELECT * FROM runs WHERE value NOT IN (SELECT value FROM library)""")
def library_filter(spark, sf_dir):
    """Strings of five inputs or more are taken as the library."""
    own = stash(found(spark, sf_dir))
    library = own.select("value", "input_id").distinct().groupBy("value").count().where("count >= 5")
    kept = strings.early_filters(strings.in_library(own, library), Options(skip_library_strings=True))
    return kept.select("input_id", "value", "offset")


@query(f"""
    WITH {ascii_sql()} SELECT input_id, value, "offset", row_number() OVER (PARTITION BY input_id, value ORDER BY "offset") > 1 AS is_duplicate FROM runs""")
def duplicate_flag(spark, sf_dir):
    return strings.with_duplicates(stash(found(spark, sf_dir))).select("input_id", "value", "offset", "is_duplicate")


@query(f'WITH {ascii_sql()} SELECT input_id, value, min("offset") AS "offset" FROM runs GROUP BY ALL')
def dedupe_first(spark, sf_dir):
    return strings.first_of_each(stash(found(spark, sf_dir))).select("input_id", "value", "offset")


@query(f"""WITH {ascii_sql()} SELECT d.source, 'static_ascii' AS kind, count(*) AS strings FROM runs JOIN documents d ON CAST(d.doc_id AS VARCHAR) = runs.input_id GROUP BY ALL""")
def kind_histogram(spark, sf_dir):
    sources = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("input_id"), "source")
    counted = found(spark, sf_dir).groupBy("input_id", "kind").count().join(sources, "input_id")
    return counted.groupBy("source", "kind").agg(F.sum("count").alias("strings"))


@query(f"""WITH {ascii_sql()} SELECT input_id, "offset" // 1000 * 1000 AS function_va, count(*) AS strings FROM runs GROUP BY ALL""")
def by_function(spark, sf_dir):
    """Strings by the thousand bytes that they begin in, as if each were a function."""
    return strings.by_function(found(spark, sf_dir).withColumn("function_va", F.expr("offset div 1000 * 1000")))


GRAMS = r"""
    words AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY w),
    grams AS (SELECT substr('^^' || w || '$', i + 1, 3) AS gram, sum(n) AS n FROM (SELECT w, n, unnest(range(1, strlen(w) + 1)) AS i FROM words) GROUP BY 1),
    total AS (SELECT sum(n) + 130 * 130 * 130 AS total FROM grams)"""


@query(f"""
    WITH {GRAMS}, names AS (SELECT DISTINCT w AS value FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark)),
    parts AS (SELECT value, substr('^^' || value || '$', i + 1, 3) AS gram FROM (SELECT value, unnest(range(1, strlen(value) + 1)) AS i FROM names))
    SELECT value, round(avg(log10((coalesce(n, 0) + 1)::DOUBLE / total::DOUBLE)), 7) AS trigram_score FROM parts LEFT JOIN grams USING (gram), total GROUP BY value""")
def trigram_score(spark, sf_dir):
    words = lambda name: read(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("value"))
    counts = words("documents").groupBy("value").count()
    model = counts.select("count", F.explode(T.trigrams(F.col("value"), True)).alias("gram")).groupBy("gram").agg(F.sum("count").alias("n"))
    scored = T.trigram_scores(words("benchmark"), stash(model), lowercase=True)
    return scored.select("value", F.round("trigram_score", 7).alias("trigram_score"))


@query(f"""
    WITH {ascii_sql()}, sizes AS (SELECT CAST(doc_id AS VARCHAR) AS input_id, strlen(text) AS size FROM documents),
    sections AS (SELECT input_id, 0 AS idx, 0 AS file_offset, size AS file_size FROM sizes UNION ALL
                 SELECT input_id, i + 1, i * 1000, CASE WHEN i % 2 = 0 THEN 1200 ELSE 700 END FROM (SELECT input_id, unnest(range(0, size // 1000 + 1)) AS i FROM sizes)),
    hits AS (SELECT r.input_id, r."offset", arg_min(struct_pack(idx := s.idx, file_offset := s.file_offset), struct_pack(a := s.file_size, b := s.idx)) AS s
             FROM runs r JOIN sections s ON r.input_id = s.input_id AND r."offset" >= s.file_offset AND r."offset" < s.file_offset + s.file_size GROUP BY ALL)
    SELECT input_id, "offset", 's' || s.idx AS section, 4096 * s.idx + "offset" - s.file_offset AS address FROM hits""")
def section_lookup(spark, sf_dir):
    """Each text cut into overlapping sections: the smallest one that holds a string gives its address."""
    whole = text_inputs(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long"))
    parsed = whole.select("*", F.lit(0).alias("arch_idx"), F.lit(0).cast("long").alias("scan_start"), F.col("size").alias("scan_end"))
    section = lambda idx, at, size: F.struct(idx.alias("idx"), F.concat(F.lit("s"), idx).alias("name"), at.cast("long").alias("file_offset"), size.cast("long").alias("file_size"), (idx * 4096).cast("long").alias("virtual_address"), F.lit(False).alias("executable"), F.lit(False).alias("writable"))
    cut = F.transform(F.sequence(F.lit(0), F.expr("cast(size div 1000 as int)")), lambda i: section(i + 1, i * 1000, F.when(i % 2 == 0, 1200).otherwise(700)))
    own = parsed.withColumn("sections", F.concat(F.array(section(F.lit(0), F.lit(0), F.col("size"))), cut))
    return strings.located(runs.scan(own, ASCII)).select("input_id", "offset", "section", "address")


@query("SELECT CAST(l_suppkey % 10 AS VARCHAR) AS input_id, l_partkey AS target, CAST(count(*) AS INTEGER) AS xrefs FROM lineitem GROUP BY ALL")
def xref_count(spark, sf_dir):
    """Lines as references of a supplier group to parts."""
    refs = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("input_id"), F.col("l_partkey").alias("target"))
    return code.reference_counts(refs)


def calls(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"))


@query("SELECT l_partkey AS callee, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY ALL")
def caller_count(spark, sf_dir):
    return code.caller_counts(calls(spark, sf_dir))


@query("SELECT caller, callee FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS n FROM (SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee FROM lineitem)) WHERE n <= 3")
def first_callers(spark, sf_dir):
    return code.first_callers(calls(spark, sf_dir))


# An order's lines as blocks of a function, 10 apart and 12 long; each line leads to another.
GRAPH = """
    blocks AS (SELECT DISTINCT l_orderkey AS function, CAST(l_linenumber * 10 AS BIGINT) AS start, CAST(l_linenumber * 10 + 12 AS BIGINT) AS "end" FROM lineitem),
    edges AS (SELECT l_orderkey AS function, CAST(l_linenumber * 10 AS BIGINT) AS src, CAST((l_partkey % 7 + 1) * 10 AS BIGINT) AS dst FROM lineitem)"""


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines, start = read(spark, sf_dir, "lineitem"), (F.col("l_linenumber") * 10).cast("long")
    blocks = lines.select(F.col("l_orderkey").alias("function"), start.alias("start"), (start + 12).alias("end")).distinct()
    return blocks, lines.select(F.col("l_orderkey").alias("function"), start.alias("src"), ((F.col("l_partkey") % 7 + 1) * 10).alias("dst"))


@query(f"""WITH {GRAPH} SELECT e.function, count(*) AS loops FROM edges e JOIN blocks s ON e.function = s.function AND e.src = s.start
    JOIN blocks d ON e.function = d.function AND e.dst = d.start WHERE e.dst < s."end" GROUP BY ALL""")
def back_edges(spark, sf_dir):
    return code.back_edges(*graph(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT DISTINCT b.function, b.start FROM blocks b JOIN edges e ON b.function = e.function AND e.dst <= e.src AND b.start BETWEEN e.dst AND e.src")
def loop_bodies(spark, sf_dir):
    return code.loop_blocks(*graph(spark, sf_dir))


@query(f'WITH {GRAPH} SELECT function, CAST(sum("end" - start) AS BIGINT) AS byte_size FROM blocks GROUP BY function')
def byte_size(spark, sf_dir):
    return code.byte_sizes(graph(spark, sf_dir)[0])


@query(f"WITH {GRAPH} SELECT DISTINCT e.function, e.dst AS start, e.src AS predecessor FROM edges e JOIN blocks b ON e.function = b.function AND e.dst = b.start")
def predecessors(spark, sf_dir):
    return code.predecessors(*graph(spark, sf_dir))


@query("""SELECT l_orderkey AS function, count(*) AS instructions, count(*) FILTER (WHERE l_suppkey % 3 = 0) / count(*)::DOUBLE AS bitwise_density FROM lineitem GROUP BY ALL""")
def bitwise_density(spark, sf_dir):
    """An order's lines as instructions; those of every third supplier work on bits."""
    mnemonic = F.when(F.col("l_suppkey") % 3 == 0, "XOR").otherwise("mov")
    return code.densities(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("function"), mnemonic.alias("mnemonic")))


@query("""
    WITH """ + CAPABILITIES_SQL + """, blocks AS (SELECT DISTINCT l_orderkey AS function, l_linenumber * 10 AS start FROM lineitem), sizes AS (SELECT function, count(*) * 12 AS byte_size FROM blocks GROUP BY 1),
    density AS (SELECT l_orderkey AS function, count(*) FILTER (WHERE l_suppkey % 3 = 0) / count(*)::DOUBLE AS d FROM lineitem GROUP BY 1),
    edges AS (SELECT l_orderkey AS function, l_linenumber * 10 AS src, (l_partkey % 7 + 1) * 10 AS dst FROM lineitem),
    loops AS (SELECT e.function, count(*) AS n FROM edges e JOIN blocks s ON e.function = s.function AND e.src = s.start JOIN blocks t ON e.function = t.function AND e.dst = t.start WHERE e.dst < e.src + 12 GROUP BY 1),
    calls AS (SELECT DISTINCT o_orderkey AS caller, o_custkey AS callee, o_orderstatus = 'F' AS imported FROM orders),
    out AS (SELECT caller AS function, count(*) FILTER (WHERE imported) AS imports, count(*) FILTER (WHERE NOT imported) AS callees FROM calls GROUP BY 1),
    callers AS (SELECT callee AS function, count(DISTINCT caller) AS n FROM calls GROUP BY 1), made AS (SELECT l_partkey AS function, count(*) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT sizes.function AS va, byte_size, coalesce(d, 0) AS d, coalesce(loops.n, 0) AS loops, coalesce(callers.n, 0) AS callers, coalesce(imports, 0) AS imports, coalesce(callees, 0) AS callees, coalesce(made.n, 0) AS recovered_strings
          FROM sizes LEFT JOIN density USING (function) LEFT JOIN loops USING (function) LEFT JOIN callers USING (function) LEFT JOIN out USING (function) LEFT JOIN made USING (function)),
    s AS (SELECT *, (1.5::DOUBLE * d + 1.2::DOUBLE * (CASE WHEN loops <= 0 THEN 0.0 WHEN loops <= 1 THEN 0.75 WHEN loops <= 2 THEN 0.9 ELSE 1.0 END)
        + 0.3::DOUBLE * (CASE WHEN byte_size < 8 THEN 0.0 WHEN byte_size < 16 THEN 0.4 + 0.2 * ((byte_size - 8) / 8.0) WHEN byte_size < 256 THEN 0.6 + 0.4 * ((byte_size - 16) / 240.0) ELSE 1.0 END)::DOUBLE
        + 0.3::DOUBLE * (CASE WHEN callers <= 0 THEN 0.0 WHEN callers <= 1 THEN 0.4 WHEN callers <= 2 THEN 0.7 ELSE 1.0 END)
        + 0.4::DOUBLE * (CASE imports WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.15 ELSE 0.0 END)
        + 0.3::DOUBLE * (CASE callees + imports WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.2 ELSE 0.0 END)) / 4.0::DOUBLE AS score FROM f),
    known AS (SELECT caller AS va, list_aggregate(list_sort(list(DISTINCT tag)), 'string_agg', ' ') AS tags FROM calls JOIN capabilities ON callee = place WHERE imported GROUP BY 1)
    SELECT va, c_name AS name, loops, callers, recovered_strings, coalesce(tags, '') AS tags, round(score, 12) AS score FROM s LEFT JOIN customer ON va = c_custkey LEFT JOIN known USING (va) WHERE score >= 0.3""")
def candidate_rows(spark, sf_dir):
    """Orders as functions: their lines are blocks and instructions, they call their customers, who give them names; some of
    these are imports, whose numbers say what they can do."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    made = orders.select(F.col("o_orderkey").alias("caller"), F.col("o_custkey").alias("callee"), (F.col("o_orderstatus") == "F").alias("imported"))
    instructions = lines.select(F.col("l_orderkey").alias("function"), F.when(F.col("l_suppkey") % 3 == 0, "xor").otherwise("mov").alias("mnemonic"))
    symbols = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("va"), F.col("c_name").alias("name"))
    imports = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(capabilities.rows())], "iat_va long, name string")
    found = code.candidates(*graph(spark, sf_dir), made, instructions, symbols, lines.select(F.col("l_partkey").alias("address")), imports, capabilities.table(spark))
    return found.select("va", "name", "loops", "callers", "recovered_strings", F.array_join("tags", " ").alias("tags"), F.round("score", 12).alias("score"))


FEATURES = """features AS (SELECT p_partkey AS va, p_brand AS input_id, (p_partkey % 11) / 10.0::DOUBLE AS bitwise_density, p_partkey % 5 AS loops, CAST(floor(p_retailprice * 2) AS BIGINT) AS byte_size,
        p_partkey % 4 AS callers, p_partkey % 6 AS imports, p_size % 3 AS callees FROM part)"""
SCORES = """scored AS (SELECT *, (1.5::DOUBLE * greatest(0.0, least(1.0, bitwise_density)) + 1.2::DOUBLE * (CASE WHEN loops <= 0 THEN 0.0 WHEN loops <= 1 THEN 0.75 WHEN loops <= 2 THEN 0.9 ELSE 1.0 END)
        + 0.3::DOUBLE * (CASE WHEN byte_size < 8 THEN 0.0 WHEN byte_size < 16 THEN 0.4 + 0.2 * ((byte_size - 8) / 8.0) WHEN byte_size < 256 THEN 0.6 + 0.4 * ((byte_size - 16) / 240.0)
                              WHEN byte_size < 2048 THEN 1.0 - 0.5 * ((byte_size - 256) / 1792.0) WHEN byte_size < 8192 THEN 0.5 - 0.5 * ((byte_size - 2048) / 6144.0) ELSE 0.0 END)::DOUBLE
        + 0.3::DOUBLE * (CASE WHEN callers <= 0 THEN 0.0 WHEN callers <= 1 THEN 0.4 WHEN callers <= 2 THEN 0.7 ELSE 1.0 END)
        + 0.4::DOUBLE * (CASE imports WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.15 ELSE 0.0 END)
        + 0.3::DOUBLE * (CASE callees + imports WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.2 ELSE 0.0 END)) / 4.0::DOUBLE AS score FROM features)"""


def features(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    own = read(spark, sf_dir, "part").select(p.alias("va"), F.col("p_brand").alias("input_id"), ((p % 11) / 10.0).alias("bitwise_density"), (p % 5).alias("loops"), (F.col("p_retailprice") * 2).cast("long").alias("byte_size"), (p % 4).alias("callers"), (p % 6).alias("imports"), (F.col("p_size") % 3).alias("callees"))
    return code.decoder_scores(own)


@query(f"WITH {FEATURES}, {SCORES} SELECT va, round(score, 12) AS score FROM scored")
def decoder_score(spark, sf_dir):
    return features(spark, sf_dir).select("va", F.round("score", 12).alias("score"))


@query(f"""WITH {FEATURES}, {SCORES} SELECT input_id, va, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY round(score, 12) DESC, va) AS n FROM scored WHERE score >= 0.3) WHERE n <= 200""")
def rank_candidates(spark, sf_dir):
    rounded = features(spark, sf_dir).withColumn("score", F.round("score", 12))
    return code.ranked(rounded, ["input_id"]).select("input_id", "va", "rank")


@query("""
    WITH w AS (SELECT l_orderkey AS input_id, l_linenumber AS target, l_partkey * 100 + l_suppkey % 100 AS place, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) + 64 END AS byte FROM lineitem),
    l AS (SELECT input_id, target, byte FROM (SELECT *, row_number() OVER (PARTITION BY input_id, target ORDER BY place DESC, byte DESC) AS n FROM w) WHERE n = 1 AND (byte BETWEEN 32 AND 126 OR byte = 9)),
    i AS (SELECT *, target - row_number() OVER (PARTITION BY input_id ORDER BY target) AS island FROM l)
    SELECT input_id, CAST(min(target) AS INTEGER) AS target, string_agg(chr(byte), '' ORDER BY target) AS value FROM i GROUP BY input_id, island HAVING count(*) >= 3""")
def stack_runs(spark, sf_dir):
    """An order's lines as writes to the stack."""
    byte = F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("int") + 64)
    place = (F.col("l_partkey") * 100 + F.col("l_suppkey") % 100) * 1000 + byte
    writes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("input_id"), F.col("l_linenumber").alias("target"), place.alias("place"), byte.alias("byte"))
    return code.stack_strings(writes, ["input_id"], 3)


@query("""
    WITH RECURSIVE n AS (SELECT max(p_partkey) + 1 AS n FROM part), calls AS (SELECT p_partkey AS caller, (p_partkey * 3 + 1) % n.n AS callee FROM part, n WHERE p_size > 10),
    r(function) AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' UNION SELECT callee FROM r JOIN calls ON r.function = calls.caller)
    SELECT function FROM r""")
def call_closure(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    n = part.agg(F.max("p_partkey") + 1).first()[0]
    made = part.where("p_size > 10").select(F.col("p_partkey").alias("caller"), ((F.col("p_partkey") * 3 + 1) % n).alias("callee"))
    return code.reachable(made, part.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("function")), stash)


def imported(spark, events: DataFrame) -> DataFrame:
    """(iat_va, name): imports by the number of the event, those of the table and some that are not in it, in capitals."""
    known = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(capabilities.rows())], "place long, name string")
    return events.select((F.col("event_id") % 300).alias("iat_va")).distinct().join(known, F.col("iat_va") == F.col("place"), "left").select("iat_va", F.upper(F.coalesce("name", F.lit("other"))).alias("name"))


@query(f"""
    WITH {CAPABILITIES_SQL}
    SELECT user_id AS function, list_aggregate(list_sort(list(DISTINCT tag)), 'string_agg', ' ') AS tags FROM events JOIN capabilities ON event_id % 300 = place GROUP BY user_id""")
def capability_tags(spark, sf_dir):
    """Users as functions; their events call imports."""
    events = read(spark, sf_dir, "events")
    made = events.select(F.col("user_id").alias("function"), (F.col("event_id") % 300).alias("iat_va"))
    return code.import_tags(made, imported(spark, events), capabilities.table(spark)).select("function", F.array_join("tags", " ").alias("tags"))


@query("""
    SELECT target, caller, block, ip FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY caller, block, ip) AS n
        FROM (SELECT l_partkey AS target, l_suppkey AS caller, l_orderkey AS block, CAST(l_linenumber AS BIGINT) AS ip FROM lineitem WHERE l_partkey <> l_suppkey)) WHERE n <= 6""")
def call_sites(spark, sf_dir):
    """Lines as calls of a part by a supplier, orders as blocks."""
    lines = read(spark, sf_dir, "lineitem")
    sites = lines.select(F.col("l_suppkey").alias("caller"), F.col("l_orderkey").alias("block"), F.col("l_linenumber").cast("long").alias("ip"), F.col("l_partkey").alias("target"))
    return code.call_sites(calls(spark, sf_dir), sites)


@query(f"""
    WITH texts AS (SELECT page_id, html AS text FROM pages), {ascii_sql("texts", "page_id")}
    SELECT input_id, value, min("offset") AS "offset", regexp_matches(value, '^(?i)(https?|ftp)://') AS is_url FROM runs GROUP BY ALL""")
def extract_pages(spark, sf_dir):
    """The whole plan over pages: scanned, located, annotated and without duplicates."""
    pages = inputs.table(read(spark, sf_dir, "pages"), "page_id", "html")
    result = extract(pages, Options(enabled=("static_ascii",), annotate=True, dedupe=True)).strings
    return result.select("input_id", "value", F.col("location.offset").alias("offset"), F.array_contains("analysis.tags", "url").alias("is_url"))
