"""Product codes of vectors: codebooks of their parts by Lloyd's rounds over trees of both, in whole numbers."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import bound_rows, stash

#: Whole numbers for 1.0; components are floored to them.
SCALE = 4096
#: Components from here on are not coded: the sums of their squares would not fit into a long.
BEYOND = 2.0**15
#: Parts of a vector, entries of a codebook, rounds.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors whose parts are in one tree, and parts in a leaf.
BLOCK, LEAF = 512, 16


@dataclass
class Codebooks:
    """`values[part, entry, position]`, whole numbers."""

    values: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for, in the vectors' own scale."""
        entries = [int(code[2 * i : 2 * i + 2], 16) for i in range(len(self.values))]
        return (np.concatenate([self.values[p, e] for p, e in enumerate(entries)]) / SCALE).tolist()


@dataclass
class Tree:
    """Nodes over boxes, root after root, in levels: a node of level L has its children at 2i and 2i + 1 of the next one."""

    order: np.ndarray  # row and part of each point, in the order of the leaves
    ends: list[np.ndarray]  # of each level: where its nodes end in that order
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def grow(points: np.ndarray, roots: int, leaf: int) -> Tree:
    """A tree for each of `roots` equal runs of `points`: nodes are halved at the median of the dimension in which they are widest
    until they have at most `leaf` points. All nodes of a level are halved at once."""
    each = len(points) // roots
    order, ends = np.arange(len(points)), each * np.arange(1, roots + 1)
    tree = Tree(order, [], [], [], [])
    while True:
        begins = np.concatenate(([0], ends[:-1]))
        own = points[order]
        low, high = np.minimum.reduceat(own, begins), np.maximum.reduceat(own, begins)
        for kept, new in ((tree.ends, ends), (tree.low, low), (tree.high, high), (tree.sums, np.add.reduceat(own, begins))):
            kept.append(new)
        sizes = ends - begins
        if sizes.max() <= leaf or sizes.min() < 2:
            tree.order = order
            return tree
        node = np.repeat(np.arange(len(ends)), sizes)
        widest = np.argmax(high - low, axis=1)
        order = order[np.lexsort((own[np.arange(len(own)), widest[node]], node))]
        ends = np.stack((begins + sizes // 2, ends), axis=1).ravel()


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least squared distance between points of two boxes."""
    d = np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0)
    return (d * d).sum(axis=1)


def _reach(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The greatest."""
    d = np.maximum(high_b - low_a, high_a - low_b)
    return (d * d).sum(axis=1)


def _least(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, groups, values)
    return out


class Dual:
    """Assigns all parts of a block to the nearest entries, of equally near ones the first, by going down a tree over the parts and
    one over the entries at once."""

    def __init__(self, values: np.ndarray):
        self.parts, self.real, self.width = values.shape
        # As many as a power of two: copies of the last one, which it comes before at every distance.
        self.each = 1 << (self.real - 1).bit_length()
        self.entries = np.pad(values, ((0, 0), (0, self.each - self.real), (0, 0)), mode="edge").reshape(-1, self.width)
        self.tree = grow(self.entries, self.parts, 1)
        self.norms = (self.entries * self.entries).sum(axis=1)

    def __call__(self, tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point within its part, count of each entry, sum of each entry); `points` as they were given to `grow`. Whole
        nodes that have one entry left bring their cached sums; points of leaves that have several are compared one by one."""
        labels = np.zeros(len(points), np.int64)
        counts, sums = np.zeros(len(self.entries), np.int64), np.zeros_like(self.entries)
        mine = self.tree
        node = other = np.arange(self.parts)  # pairs of nodes, one of each tree
        level = at = 0
        while len(node):
            low, high = tree.low[level], tree.high[level]
            bottom = at == len(mine.ends) - 1
            box = low[node], high[node], mine.low[at][other], mine.high[at][other]
            near = _gap(*box) <= _least(_reach(*box), node, len(low))[node]
            node, other = node[near], other[near]
            if bottom:
                node, other = self._undominated(low, high, node, other)
                alone = np.bincount(node, minlength=len(low))[node] == 1
                self._assign(tree, level, node[alone], mine.order[other[alone]], labels, counts, sums)
                node, other = node[~alone], other[~alone]
            if level == len(tree.ends) - 1 and bottom:
                self._compare(tree, points, node, mine.order[other], labels, counts, sums)
                break
            if level < len(tree.ends) - 1:
                level, node, other = level + 1, (2 * node[:, None] + [0, 1]).ravel(), np.repeat(other, 2)
            if not bottom:
                at, node, other = at + 1, np.repeat(node, 2), (2 * other[:, None] + [0, 1]).ravel()
        shape = (self.parts, self.each)
        return labels % self.each, counts.reshape(shape)[:, : self.real], sums.reshape(*shape, self.width)[:, : self.real]

    def _undominated(self, low, high, node, other):
        """Without entries that no point of the node's box has nearer than another one: the greatest difference of the two distances
        over the box is known exactly, as it is linear in the point."""
        mine = self.tree.order[other]
        own = self.entries[mine]
        away = low[node] + high[node] - 2 * own
        ranked = np.lexsort((mine, (away * away).sum(axis=1), node))
        best = np.empty(len(low), np.int64)
        best[node[ranked[::-1]]] = mine[ranked[::-1]]  # the nearest to the middle of each box
        d = own - self.entries[best[node]]
        most = self.norms[best[node]] - self.norms[mine] + 2 * np.where(d > 0, high[node] * d, low[node] * d).sum(axis=1)
        kept = (most > 0) | (most == 0) & (best[node] >= mine)
        return node[kept], other[kept]

    def _assign(self, tree, level, node, entry, labels, counts, sums):
        ends = tree.ends[level]
        begins = np.concatenate(([0], ends[:-1]))
        sizes = (ends - begins)[node]
        np.add.at(counts, entry, sizes)
        np.add.at(sums, entry, tree.sums[level][node])
        labels[tree.order[_ranges(begins[node], sizes)]] = np.repeat(entry, sizes)

    def _compare(self, tree, points, node, entry, labels, counts, sums):
        if not len(node):
            return
        ends = tree.ends[-1]
        begins = np.concatenate(([0], ends[:-1]))
        sizes = (ends - begins)[node]
        which = tree.order[_ranges(begins[node], sizes)]
        against = np.repeat(entry, sizes)
        d = points[which] - self.entries[against]
        first = np.lexsort((against, (d * d).sum(axis=1), which))
        first = first[np.concatenate(([True], which[first][1:] != which[first][:-1]))]
        which, found = which[first], against[first]
        labels[which] = found
        np.add.at(counts, found, 1)
        np.add.at(sums, found, points[which])


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of [begin, begin + size), run after run."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(begins - starts, sizes)


def _good(vector: str):
    """A vector without null or non-finite components."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def first_entries(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES) -> tuple[Codebooks, int] | None:
    """Codebooks of the parts of the vectors with the smallest ids, and the vectors' length, which is that of the first of them; None
    if there is no vector. Of equal ids the smaller vector comes first; null ids come last."""
    kept = df.where(_good(vector_col) & F.forall(vector_col, lambda x: F.abs(x) < BEYOND)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    found = kept.orderBy(*order).limit(entries).collect()
    if not found:
        return None
    length = len(found[0].v)
    if any(len(r.v) != length for r in found):
        found = kept.where(F.size("v") == length).orderBy(*order).limit(entries).collect()
    whole = _whole(np.array([r.v for r in found]).reshape(len(found), length), parts)
    return Codebooks(np.ascontiguousarray(whole.reshape(len(found), parts, -1).transpose(1, 0, 2))), length


def _whole(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Whole numbers; zeros fill up the last part."""
    out = np.floor(vectors * SCALE).astype(np.int64)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % parts or parts * (out.shape[1] == 0))))


def blocks(df: DataFrame, length: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(ids, labels, points, tree): vectors of `length` in blocks of at most BLOCK, with the trees over their parts. Every task
    makes blocks of its own rows; nothing is shuffled."""
    bound_rows(df.sparkSession)
    kept = df.where(_good(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("labels", T.ArrayType(df.schema[label_col].dataType)), T.StructField("points", T.BinaryType()), T.StructField("tree", T.BinaryType())])

    def run(batches):
        for rows in _gathered(batches, BLOCK):
            vectors = rows.column(2).combine_chunks()
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) if length else np.zeros((len(vectors), 0))
            whole = _whole(values, parts)
            points = by_part(whole, parts)
            yield pa.RecordBatch.from_arrays([_as_list(rows.column(0)), _as_list(rows.column(1)), pa.array([whole.astype("<i4").tobytes()]), pa.array([packed(grow(points, parts, LEAF))])], schema.names)

    fits = (F.size("v") == length) & F.forall("v", lambda x: F.abs(x) < BEYOND)
    return kept.where(fits).mapInArrow(run, schema)


def _gathered(batches, most: int):
    """Tables of up to `most` rows each."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _as_list(column: pa.ChunkedArray) -> pa.ListArray:
    own = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)


def by_part(whole: np.ndarray, parts: int) -> np.ndarray:
    """All first parts, then all second ones, and so on."""
    return np.ascontiguousarray(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2)).reshape(len(whole) * parts, -1)


def packed(tree: Tree) -> bytes:
    """A tree as bytes: levels, order, then of each level the ends, boxes and sums."""
    head = [np.array([len(tree.ends), len(tree.order), tree.low[0].shape[1]], "<i8"), tree.order.astype("<i4")]
    for level in range(len(tree.ends)):
        head += [tree.ends[level].astype("<i4"), tree.low[level].astype("<i4"), tree.high[level].astype("<i4"), tree.sums[level].astype("<i8")]
    return b"".join(x.tobytes() for x in head)


def unpacked(raw: bytes, parts: int) -> Tree:
    levels, n, width = np.frombuffer(raw, "<i8", 3).tolist()
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at).astype(np.int64)
        at += out.size * np.dtype(kind).itemsize
        return out

    tree = Tree(take("<i4", n), [], [], [], [])
    for level in range(levels):
        nodes = parts << level
        tree.ends.append(take("<i4", nodes))
        for kept, kind in ((tree.low, "<i4"), (tree.high, "<i4"), (tree.sums, "<i8")):
            kept.append(take(kind, nodes * width).reshape(nodes, width))
    return tree


def _read(raw_points: bytes, raw_tree: bytes, parts: int, width: int) -> tuple[Tree, np.ndarray]:
    whole = np.frombuffer(raw_points, "<i4").astype(np.int64).reshape(-1, parts * width)
    return unpacked(raw_tree, parts), by_part(whole, parts)


def lloyd(trees: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """`rounds` rounds: each part to the nearest entry, each entry to the floor of its parts' mean; entries that nothing is near to
    stay. Tasks add up their own blocks, so a round brings sums of as many rows as there are components of entries to each
    task and to the driver, whatever the input."""
    parts, entries, width = books.values.shape
    for _ in range(rounds):
        values = books.values

        def run(batches):
            dual = Dual(values)  # noqa: B023
            both = np.zeros((parts * entries, 1 + width), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    _, counts, sums = dual(*_read(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), parts, width))
                    both += np.concatenate((counts[..., None], sums), axis=2).reshape(both.shape)
            slot = np.flatnonzero(both[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(slot, width + 1)), pa.array(np.tile(np.arange(width + 1), len(slot))), pa.array(both[slot].ravel())], ["slot", "place", "n"])

        found = trees.select("points", "tree").mapInArrow(run, "slot long, place long, n long").groupBy("slot", "place").agg(F.sum("n").alias("n")).collect()
        total = np.zeros((parts * entries, width + 1), np.int64)
        for r in found:
            total[r.slot, r.place] = r.n
        used = total[:, 0] > 0
        flat = values.reshape(-1, width).copy()
        flat[used] = np.floor_divide(total[used, 1:], total[used, :1])
        books = Codebooks(flat.reshape(values.shape))
    return books


def encode(trees: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): the nearest entry of each part, in two hexadecimal digits, and the squared distances together."""
    parts, entries, width = books.values.shape
    values = books.values
    id_type, label_type = trees.schema["ids"].dataType.elementType, trees.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{i:02x}" for i in range(entries)])

    def run(batches):
        dual = Dual(values)
        for batch in batches:
            for i in range(batch.num_rows):
                tree, points = _read(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), parts, width)
                labels, _, _ = dual(tree, points)
                d = points - values[np.repeat(np.arange(parts), len(points) // parts), labels]
                error = (d * d).sum(axis=1).reshape(parts, -1).sum(axis=0)
                codes = digits[labels.reshape(parts, -1).T]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(["".join(c) for c in codes]), pa.array(error)], schema.names)

    return trees.select("ids", "labels", "points", "tree").mapInArrow(run, schema)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of `df` with a vector of finite numbers; others go.

    Blocks of vectors with the trees over their parts are written once and read in every round. What a label's rows lose
    together is summed by tasks before it is shuffled, written, and joined: Spark broadcasts those sums if their measured
    size allows, and else splits a label that very many rows have, as both sides are plain tables.

    The vectors have the length of the one with the smallest id; rows with another one or with components of 2^15 or more
    have no code and no error. Lengths that `parts` does not divide are filled up with zeros, as are empty vectors.
    Repeated rows and ids are rows of their own; null ids and labels stay null, and null labels sum up together; fewer
    rows than `entries` make as many entries. An empty table gives no rows; other columns are not carried."""
    begun = first_entries(df, id_col, vector_col, parts, entries)
    digest = F.lit(None).cast("string")
    if begun is None:
        coded = df.where(_good(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        books, length = begun
        trees = stash(blocks(df, length, id_col, vector_col, label_col, parts), "trees")
        books = lloyd(trees, books, rounds)
        digest = F.lit(books.sha256)
        odd = df.where(_good(vector_col) & ((F.size(vector_col) != length) | F.exists(vector_col, lambda x: F.abs(x) >= BEYOND)))
        coded = encode(trees, books).unionByName(odd.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = stash(coded, "codes")
    sums = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"), "label-errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("own")), "left")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))
