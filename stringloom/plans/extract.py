"""The whole extraction: one pass over the inputs, and relational work on what it found."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stringloom.functions.extractors import Extractor, chosen
from stringloom.functions.text import trigram_scores
from stringloom.operators import code, flow, language, runs
from stringloom.operators import strings as rows
from stringloom.schema import PARSED, STATIC, WRITES, Options
from stringloom.sources.containers import architectures
from stringloom.tables import stash


@dataclass
class Result:
    """Tables by input_id. `candidates` are functions that look like decoders, (input_id, va, name, score, recovered_strings,
    tags), where the caller has the call graph for `code.candidates`; reports and documents then show them. `more` has the rows of
    each further extractor by its name, with input_id and arch_idx; `parsed` is PARSED of all architectures, `facts` all that the pass found."""

    strings: DataFrame
    inputs: DataFrame
    warnings: DataFrame
    candidates: DataFrame | None = None
    facts: DataFrame | None = None
    parsed: DataFrame | None = None
    more: dict[str, DataFrame] = field(default_factory=dict)

    def only_candidates(self) -> Result:
        """Without strings of code whose function is no candidate."""
        return self if self.candidates is None else replace(self, strings=rows.only_candidates_of(self.strings, self.candidates))


def examined(inputs: DataFrame, options: Options, mirrored: bool = False, extractors: Iterable[str | Extractor] = (), missing: Iterable[str] | None = None) -> DataFrame:
    """One row per input and architecture: PARSED, `language`, `runs` of all kinds that are wanted, `alone` (no other row has strings of
    the input, nor does its code), `writes`, and the rows of each of
    `extractors` in a column with its name after `more_`; one that fails on an input gives a warning of it. Kinds that are `missing` give a warning of each input. Contents go to Python once and do not come back; nothing is shuffled."""
    extra = chosen(extractors)
    schema = T._parse_datatype_string(f"{PARSED}, language string, alone boolean, runs array<{runs.RUN}>, writes {WRITES}" + "".join(f", more_{x.name} array<struct<{x.returns}>>" for x in extra))
    fields = {x.name: [f.split(":")[0].strip() for f in x.returns.split(",")] for x in extra}
    head = T.StructType([f for f in schema if f.name not in ("runs", "writes")])
    arrow, at = to_arrow_schema(head), schema.names.index("runs")
    static = any(options.wants(k) for k in STATIC) or (options.decode_base64 and options.wants("base64"))
    by_language, stack = options.wants("go") or options.wants("rust"), options.wants("stack") or options.wants("tight")
    beyond = [f"nothing here finds strings of kind {k}" for k in (options.unsupported if missing is None else missing)]

    def one(input_id: str, data: bytes, out: runs.Strings, written: list):
        found = architectures(input_id, data, options.format)
        for x in found:
            own = x | {"language": None, "warnings": [*x["warnings"], *(beyond if x["arch_idx"] == 0 else [])]}
            written.append(code.NO_WRITES)
            if not x["error"]:
                own["language"] = language.toolchain_of(x["sections"], data)
                if static:
                    targets = code.references(x["arch"], x["sections"], data)
                    runs.scanned(out, data, x["scan_start"], x["scan_end"], x["sections"], options, mirrored, targets)
                if by_language:
                    language.scanned(out, data, x["sections"], own["language"], options, own["warnings"])
                runs.decoded_into(out, data, x["arch_idx"], x["sections"], options, own["warnings"])
                if stack:
                    written[-1] = code.writes_found(x["arch"], x["sections"], [va for va, _ in x["symbols"]], data)
                for e in extra:
                    try:
                        own["more_" + e.name] = [dict(zip(fields[e.name], row)) for row in e.rows(x, data, options)]
                    except (ValueError, LookupError, ArithmeticError, TypeError, struct.error) as error:
                        own["warnings"].append(f"extractor {e.name}: {error}")
            own["alone"] = len(found) == 1 and not written[-1][-1] and own["language"] != "rust"
            out.close()
            yield own

    def run(batches):
        for batch in runs.sliced(batches):
            out, written = runs.Strings(), []
            rows = [x for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in one(i, data or b"", out, written)]
            columns = pa.RecordBatch.from_pylist(rows, schema=arrow).columns
            columns[at:at] = [out.arrow(options), code.writes_arrow(written)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return inputs.select("input_id", "content").mapInArrow(run, schema)


def stack_rows(facts: DataFrame, least: int, graph: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(input_id, arch_idx, va, block, target, value, tight): strings that code writes to the stack byte by byte or word by word. With
    the blocks and edges of the code, each block's writes make strings of their own, which are tight if the block is in a loop;
    else, and for writes in no block, what lies between the starts of functions counts together."""
    by = ["input_id", "arch_idx"]
    none = F.lit(None).cast("long").alias("block")
    if graph is None:
        return code.written_strings(facts, by, least).select(*by, F.col("region").alias("va"), none, "target", "value", F.lit(False).alias("tight"))
    found = flow.strings_of_blocks(facts, *graph, by, least)
    return found.select(*by, F.coalesce("function", "region").alias("va"), "block", "target", "value", "tight")


def _code_rows(found: DataFrame, kind: str, stage: int, section: str | None, align: str) -> DataFrame:
    """(input_id, arch_idx, value, va) of a kind that belongs to a function, not to a place in the file."""
    none = lambda t: F.lit(None).cast(t)
    seq = F.struct(F.lit(0).alias("stage"), "arch_idx", F.lit(stage).alias("pass"), F.col(align).cast("long").alias("align"), F.col("va").alias("pos"))
    encoding = "ascii" if kind in ("stack", "tight") else "utf8"
    return found.select(
        "input_id", "arch_idx", "value", F.lit(kind).alias("kind"), F.lit(encoding).alias("encoding"), F.lit(0).cast("long").alias("offset"),
        F.octet_length("value").cast("long").alias("length"), F.col("va").alias("address"), F.lit(section).cast("string").alias("section"), F.lit(False).alias("in_code"),
        none("long").alias("decoded_offset"), none("long").alias("source_length"), F.lit(0).alias("xrefs"), none("double").alias("quality"), none("boolean").alias("again"), none("int").alias("nth"), F.lit(False).alias("alone"), seq.alias("seq"), F.col("va").alias("function_va"),
    )


def extract(
    inputs: DataFrame, options: Options = Options(), library: DataFrame | None = None, model: DataFrame | None = None, lowercase: bool | None = None,
    graph: tuple[DataFrame, DataFrame] | None = None, extractors: Iterable[str | Extractor] = (),
) -> Result:
    """Strings of all `inputs` (input_id, content). `library` (value) are known strings, `model` (gram, n, lowercase) scores
    trigrams. `graph` has the blocks (input_id, arch_idx, function, start, end) and edges (input_id, arch_idx, function, src, dst) of
    the inputs' code, which tell tight strings from other strings of the stack. `extractors`, of the registry by name or others,
    find more in the same pass. What one pass over the inputs finds is written to the shared folder; all else reads that. Branches for kinds
    that are not wanted are not built. The rows are in no order; `strings.order_columns` gives it."""
    if options.min_trigram_score is not None and model is None:
        raise ValueError("min_trigram_score needs a model")
    missing = options.unsupported + tuple(k for k in ("tight",) if graph is None and k in (options.enabled or ()))
    if options.enabled is not None and not set(options.enabled) - set(missing):
        raise ValueError(f"nothing here finds strings of these kinds, as no code is run, and no tight ones without a graph: {sorted(options.enabled)}")
    extra = chosen(extractors)
    facts = stash(examined(inputs, options, extractors=extra, missing=missing), "facts")
    branches = [rows.located(facts).withColumn("function_va", F.lit(None).cast("long"))]
    if options.wants("rust"):
        symbols = language.rust_symbols(facts.where("language = 'rust'"), options.min_length).withColumnRenamed("address", "va")
        branches.append(_code_rows(symbols.withColumn("one", F.lit(1)), "rust", 4, None, "one"))
    if options.wants("stack") or (options.wants("tight") and graph is not None):
        made = stash(stack_rows(facts, options.min_length, graph))  # each reader of the strings would make them again
        if options.wants("stack"):
            branches.append(_code_rows(made.where("not tight"), "stack", 6, "stack", "target"))
        if options.wants("tight") and graph is not None:
            branches.append(_code_rows(made.where("tight"), "tight", 7, "stack-tight", "target"))
    found = reduce(DataFrame.unionByName, branches)
    if options.skip_library_strings or options.annotated:
        found = rows.in_library(found, library)
    found = rows.early_filters(found, options)
    if options.skip_code_sections or options.skip_library_strings:
        found = found.withColumn("alone", F.lit(False))  # what came before may have gone
    if not options.annotated:
        found = found.withColumn("tags", F.lit(None).cast("array<string>"))
    elif options.dedupe and "duplicate" not in options.required_tags:
        found = rows.annotated_firsts(found)
    else:
        found = rows.annotated(found)
    if model is not None:
        found = found.join(trigram_scores(found, model, lowercase), "value", "left")
    else:
        found = found.withColumn("trigram_score", F.lit(None).cast("double"))
    found = rows.late_filters(found, options)
    if options.dedupe:
        if options.required_tags:
            found = found.withColumn("alone", F.lit(False))  # tags go by places, too
        found = rows.first_of_each(found)
    location = F.struct("offset", "address", "section", "function_va", F.lit(None).cast("long").alias("source_va"), "xrefs")
    analysis = F.struct("tags", "trigram_score", "decoded_offset", "source_length")
    strings = found.select("input_id", "value", "kind", "encoding", location.alias("location"), analysis.alias("analysis"), "seq")
    first = facts.groupBy("input_id").agg(F.min_by(F.struct("format", "arch", "bits", "size", "error"), "arch_idx").alias("x"), F.min_by("language", F.when(F.col("language").isNotNull(), F.col("arch_idx"))).alias("language"))
    warnings = facts.select("input_id", F.explode(F.concat("warnings", F.filter(F.array("error"), lambda x: x.isNotNull()))).alias("warning"))
    more = {x.name: facts.select("input_id", "arch_idx", F.explode("more_" + x.name).alias("r")).select("input_id", "arch_idx", "r.*") for x in extra}
    return Result(strings, first.select("input_id", "x.*", "language"), warnings, facts=facts, parsed=facts.select(*T._parse_datatype_string(PARSED).names), more=more)
