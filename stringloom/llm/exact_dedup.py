"""Exact duplicates by deterministic block naming: equal blocks get equal integer names, then equal pairs of names do."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stringloom.llm.common import WHITE_SPACE, settled, stash, texts

#: UTF-8 bytes of a block of normalised text.
BLOCK = 4096
#: Bytes of distinct normalised text, and rows, that a task holds before it starts a new chunk.
CHUNK_BYTES, CHUNK_ROWS = 48 << 20, 200_000


def _chunks(batches, block: int, chunk_bytes: int, chunk_rows: int):
    """Per chunk of a task's rows: {normalised text: (its number, names of its blocks, its rows)} and {block: its name}.

    Blocks of distinct texts are numbered through within the task; with the task's number above, no two places of the
    table share a number. In its chunk a block has the number of its first place as its name."""
    task = TaskContext.get().partitionId() << 40
    groups, names, size, rows, place = {}, {}, 0, 0, 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            normal = text.encode().translate(None, WHITE_SPACE)
            own = groups.get(normal)
            if own is None:
                first, refs = task + place, []
                for at in range(0, max(len(normal), 1), block):
                    refs.append(names.setdefault(normal[at : at + block], task + place))
                    place += 1
                groups[normal] = own = (first, refs, [])
                size += len(normal)
            own[2].append((doc_id, len(text)))
        rows += batch.num_rows
        if size > chunk_bytes or rows > chunk_rows:
            yield groups, names
            groups, names, size, rows = {}, {}, 0, 0
    if groups:
        yield groups, names


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space (space, U+0009 to U+000D); null counts as empty. Of equal
    texts the one with the most code points, then the smallest doc_id, is kept; of repeated rows with that id, one.
    Null ids come after all others. Nothing depends on a hash: names are given by comparing blocks.

    Each task first brings its equal texts together, so a large group of copies is one row per chunk afterwards, and
    gives its distinct blocks local names. The blocks are shuffled once, sorted, and every run of equal blocks takes its
    smallest local name. Documents are then sequences of names; each round sorts the pairs of adjacent names and renames
    them, which halves the sequences. (number of bytes, last name) is the identity of a text.

    `df` is evaluated once: texts and blocks are written by one pass, and all that follows reads what it wrote, so nothing
    depends on how the input is split or ordered. An empty table gives no rows; a text may be of any length; other columns
    are not carried."""
    # The blocks and their names, as large as the texts, go as soon as each text has its identity.
    whole = settled(lambda: _identities(df, id_col, text_col, block, chunk_bytes, chunk_rows), "identities")
    own = F.struct((-F.col("m.points")).alias("a"), F.col("m.doc_id").isNull().alias("b"), F.col("m.doc_id").alias("doc_id"), F.col("rep"), F.col("at"))
    best = whole.select("n_bytes", "name", "rep", F.posexplode("members").alias("at", "m"))
    first = best.groupBy("n_bytes", "name").agg(F.min(own).alias("best"), F.count("*").alias("group_size"))
    first = stash(first.select("n_bytes", "name", F.col("best.doc_id").alias("keep_id"), F.col("best.rep").alias("keep_rep"), F.col("best.at").alias("keep_at"), "group_size"), "kept")
    return (
        whole.join(first, ["n_bytes", "name"])
        .select("*", F.posexplode("members").alias("at", "m"))
        .select(F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size", ((F.col("rep") == F.col("keep_rep")) & (F.col("at") == F.col("keep_at"))).alias("kept"), "text_sha256")
    )


def _identities(df: DataFrame, id_col: str, text_col: str, block: int, chunk_bytes: int, chunk_rows: int) -> DataFrame:
    """(rep, n_bytes, text_sha256, members, name): the different texts of each chunk with their rows and their last name."""
    id_type = df.schema[id_col].dataType
    rows = texts(df, id_col, text_col)
    members = T.ArrayType(T.StructType([T.StructField("doc_id", id_type), T.StructField("points", T.LongType())]))
    reps_type = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("refs", T.ArrayType(T.LongType())), T.StructField("members", members)])
    arrow_members = to_arrow_type(members)

    pass_type = T.StructType([*(T.StructField(f.name, f.dataType) for f in reps_type), T.StructField("block", T.BinaryType()), T.StructField("ref", T.LongType())])

    def local_names(batches):
        """Rows of two sorts: texts with their rows, and blocks with their local names."""
        for groups, names in _chunks(batches, block, chunk_bytes, chunk_rows):
            for some in _slices(list(groups.items()), 2000):
                own = [
                    pa.array([x[1][0] for x in some], pa.int64()),
                    pa.array([len(x[0]) for x in some], pa.int64()),
                    pa.array([hashlib.sha256(x[0]).hexdigest() for x in some]),
                    pa.array([x[1][1] for x in some], pa.list_(pa.int64())),
                    pa.array([[{"doc_id": d, "points": n} for d, n in x[1][2]] for x in some], arrow_members),
                ]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64())], pass_type.names)
            for some in _slices(list(names.items()), 2000):
                none = [pa.nulls(len(some), to_arrow_type(f.dataType)) for f in reps_type]
                yield pa.RecordBatch.from_arrays([*none, pa.array([x[0] for x in some], pa.binary()), pa.array([x[1] for x in some], pa.int64())], pass_type.names)

    def name_runs(batches):
        """Sorted (block, ref) to (ref, name): the name of a block is the first ref of its run."""
        last, name = None, None
        for batch in batches:
            out = []
            for part, ref in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != last:
                    last, name = part, ref
                out.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64())], ["ref", "name"])

    once = stash(rows.mapInArrow(local_names, pass_type), "pass")
    reps = once.where("rep is not null").select(*reps_type.names)
    blocks = once.where("ref is not null").select("block", "ref").repartition("block").sortWithinPartitions("block", "ref")
    names = stash(blocks.mapInArrow(name_runs, "ref long, name long"), "blocks")
    parts = reps.select("rep", F.posexplode("refs").alias("i", "ref")).join(names, "ref").select("rep", "i", "name")
    most = reps.agg(F.max(F.size("refs"))).first()[0] or 1
    # A document's names are few and go with the document through all rounds; only pairs are named anew in each.
    named = parts.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("names"))
    while most > 1:
        named = _halve(named)
        most = (most + 1) // 2
    named = named.select("rep", F.col("names")[0].alias("name"))
    return reps.drop("refs").join(named, "rep")


def _halve(named: DataFrame) -> DataFrame:
    """Rename adjacent pairs: (rep, names) to (rep, half as many names). A last name without a partner pairs with -1."""
    pair = lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b"))
    named = stash(named, "names")
    long = named.where(F.size("names") > 1)
    pairs = long.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.size("names") + 1) / 2).cast("int") - 1), pair)).alias("i", "p")).select("rep", "i", "p.a", "p.b")
    # The places of a document's blocks are its own numbers, so the smallest place of a pair is a name of no other pair.
    names = stash(pairs.groupBy("a", "b").agg(F.min(F.col("rep") + F.col("i")).alias("name")), "pairs")
    halved = pairs.join(names, ["a", "b"]).groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("names"))
    return named.where(F.size("names") <= 1).unionByName(halved)


def _slices(items: list, n: int):
    for at in range(0, len(items), n):
        yield items[at : at + n]
