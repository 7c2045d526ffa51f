"""SimHash near-duplicates: a fingerprint for each text, links between fingerprints that differ in few bits, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import rows_per_batch, settled, stash, texts
from stringloom.schema import signed

#: Words of a shingle, seed of its hash, and differing bits of a link.
WORDS, SEED, BITS = 4, 42, 4
#: Up to this many fingerprints under one key are compared pair by pair; in larger groups hubs stand for the others.
SMALL = 32
#: Larger groups are dealt out anew by a second key, and groups under two or more keys that are larger than the second number, by
#: a further one. A task holds no larger group.
LARGE, LARGER = 2048, 1 << 16
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included; 0 for a text without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        counts += np.unpackbits(hashes[at : at + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, bits (the fingerprint as a signed 64-bit integer). Null text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("bits", T.LongType())])

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(x, words, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], schema.names)

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def segments(bits: int = BITS, width: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of `width` bits: so many that of `bits` differing bits at most one falls into some
    segment, which is one more than half of them."""
    n = bits // 2 + 1
    edges = [round(width * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(value: Column, own: list[tuple[int, int]]) -> list[Column]:
    """A key for each bit of the segments: the segment with that bit deleted, and which bit it is."""
    out = []
    for first, width in own:
        for i in range(width):
            mask = ((1 << width) - 1) ^ (1 << i)
            out.append(F.shiftleft(F.shiftrightunsigned(value, first).bitwiseAND(F.lit(mask)), 6) + F.lit(first + i))
    return out


def second_keys(bits: int = BITS) -> Column:
    """For (key, bits) of a group that is too large: array<struct<key, free>>, the key again with each variant of the bits outside its
    segment, and the bits that neither fixes. Two fingerprints that link still share one, since of the bits outside no more
    than `bits` differ."""
    out = F.lit(None).cast("array<struct<key:bigint,free:bigint>>")
    for first, width in segments(bits):
        after = first + width
        rest = F.col("bits").bitwiseAND(F.lit((1 << first) - 1))
        if after < 64:
            rest = rest + F.shiftleft(F.shiftrightunsigned("bits", after), first)
        own = segments(bits, 64 - width)
        room = 6 + max(w for _, w in own)
        places = [i for i in range(64) if not first <= i < after]
        free = [signed(sum(1 << i for i in places) ^ sum(1 << i for i in places[a : a + w])) for a, w in own for _ in range(w)]
        here = F.array(*(F.struct((F.shiftleft("key", room) + x).alias("key"), F.lit(f).cast("long").alias("free")) for x, f in zip(variants(rest, own), free)))
        out = F.when((F.col("key").bitwiseAND(F.lit(63)) >= first) & (F.col("key").bitwiseAND(F.lit(63)) < after), here).otherwise(out)
    return out


def further_keys(prints: np.ndarray, keys: np.ndarray, free: int, bits: int):
    """For fingerprints of runs that are too large, of which the bits `free` are not fixed yet: (keys, fingerprints, free bits) for
    each segment of those bits. The key goes on with the segment and one bit of it deleted, hashed; two fingerprints that
    link still share one, since of the free bits no more than `bits` differ. Equal hashes of others cost comparisons only."""
    places = [i for i in range(64) if free >> i & 1]
    for first, width in segments(bits, len(places)):
        own = places[first : first + width]
        mask = sum(1 << i for i in own)
        for i in own:
            kept = prints & np.uint64(mask ^ 1 << i)
            mixed = (kept ^ kept >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((i + 1) * 0x94D049BB133111EB & (1 << 64) - 1)
            mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            yield (mixed ^ mixed >> np.uint64(32)).view(np.int64), free ^ mask


def links(distinct: DataFrame, bits: int = BITS, large: int = LARGE, larger: int = LARGER) -> DataFrame:
    """(a, b): pairs of fingerprints of column `bits` that differ in at most `bits` bits (2 to 8), enough to connect all that
    are linked, directly or through others.

    The fingerprint is cut into segments of which one differs by at most one bit. Each segment is indexed once for each
    of its bits with that bit deleted, so two fingerprints that link share one of these variants: 64 rows for each
    distinct fingerprint, sorted by variant. Runs of equal variants are then verified bit by bit.

    A run of more than `large` fingerprints is not held by its task. It is handed on row by row and dealt out over many tasks
    by variants of the bits that its key does not fix, under which the same holds for any two that link. A run of more than
    `larger` under these is dealt out again, and so on, with fewer free bits each time: a run has no more fingerprints than its
    free bits have values."""
    if not 2 <= bits <= 8:
        raise ValueError("bits must be within 2 and 8")
    spark = distinct.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(tasks, "bits").select(F.explode(F.array(*variants(F.col("bits"), segments(bits)))).alias("key"), "bits")
    keyed = keyed.select("key", "bits", F.lit(None).cast("long").alias("free"))
    found = []
    with rows_per_batch(spark, 10_000):
        while True:
            met = stash(_met(keyed, bits, large), "met")
            found.append(met.where("key is null").select("a", "b"))
            crowded = met.where("key is not null").select("key", F.col("a").alias("bits"), F.col("b").alias("free"))
            if crowded.isEmpty():
                return reduce(DataFrame.unionByName, found).distinct()
            crowded = crowded.repartition(tasks, "bits")
            keyed = crowded.select(F.explode(second_keys(bits)).alias("x"), "bits").select("x.key", "bits", "x.free") if len(found) == 1 else _dealt(crowded, bits)
            large = larger


def _dealt(crowded: DataFrame, bits: int) -> DataFrame:
    """(key, bits, free) of the members of crowded runs under two or more keys, under their further keys."""

    def run(batches):
        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            free = batch.column(2).to_numpy().view(np.uint64)
            for each in np.unique(free):
                here = free == each
                for further, rest in further_keys(prints[here], keys[here], int(each), bits):
                    left = np.full(len(further), rest, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(further), pa.array(prints[here].view(np.int64)), pa.array(left)], ["key", "bits", "free"])

    return crowded.mapInArrow(run, "key long, bits long, free long")


def _met(keyed: DataFrame, bits: int, large: int | None) -> DataFrame:
    """(a, b, key): links of (key, bits, free), with a null key, and the members `a` of runs beyond `large`, with their key and, as `b`,
    their free bits. Runs without enough free bits to be cut again are held, as they can have few members."""

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for keys, prints, crowded, free in _runs(batches, large, bits):
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array([free] * len(keys), pa.int64()), pa.array(keys)], ["a", "b", "key"])
            else:
                for pairs in _edges(keys, prints, bits, sent):
                    yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(pairs.num_rows, pa.int64())], ["a", "b", "key"])

    return keyed.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(run, "a long, b long, key long")


def _runs(batches, large: int | None, bits: int = BITS):
    """(keys, fingerprints, crowded, free bits) of whole runs of equal keys, many at a time. A run beyond `large` is crowded and comes
    alone, in parts, so no more than `large` and a batch are held."""
    key, held, crowded, free = None, [], False, None  # the run that can go on in the next batch

    def parts():
        if sum(len(k) for k, _ in held):
            yield np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held]), crowded, free

    for batch in batches:
        keys, prints, rest = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
        if not len(keys):
            continue
        n = int(np.searchsorted(keys, key, "right")) if key is not None else 0
        held.append((keys[:n], prints[:n]))
        if n < len(keys):
            yield from parts()
            keys, prints, rest, crowded = keys[n:], prints[n:], rest.slice(n), False
            last = int(np.searchsorted(keys, keys[-1]))
            yield from _apart(keys[:last], prints[:last], rest, large, bits)
            key, held, free = keys[-1], [(keys[last:], prints[last:])], rest[last].as_py()
        if large and _cut_again(free, bits) and (crowded or sum(len(k) for k, _ in held) > large):
            crowded = True
            yield from parts()
            held = []
    yield from parts()


def _cut_again(free: int | None, bits: int) -> bool:
    """Whether so many bits are free that segments of them tell fingerprints apart."""
    return free is None or (free & (1 << 64) - 1).bit_count() > 4 * (bits // 2 + 1)


def _apart(keys: np.ndarray, prints: np.ndarray, free, large: int | None, bits: int):
    """Each run beyond `large` alone, and all others together."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    long = sizes > large if large else np.zeros(len(sizes), bool)
    for i in np.flatnonzero(long).tolist():
        at, n, own = int(starts[i]), int(sizes[i]), free[int(starts[i])].as_py()
        long[i] = _cut_again(own, bits)
        if long[i]:
            yield keys[at : at + n], prints[at : at + n], True, own
    rest = ~np.repeat(long, sizes)
    if rest.any():
        yield keys[rest], prints[rest], False, None


def _edges(keys: np.ndarray, prints: np.ndarray, bits: int, sent: set):
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    large = sizes > SMALL
    small = np.repeat(~large, sizes)
    for shift in range(1, int(sizes[~large].max(initial=1))):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:])
        near = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= bits]
        found.append((prints[near], prints[near + shift]))
    for start, size in zip(starts[large].tolist(), sizes[large].tolist()):
        found.append(forest(prints[start : start + size], bits))
    pairs = set()
    for a, b in found:
        pairs.update(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))
    pairs -= sent
    if len(sent) < 200_000:  # only spares repeats; distinct() follows
        sent |= pairs
    if pairs:
        a, b = zip(*pairs)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within `prints`: fewer than there are fingerprints. The one nearest to the
    majority of bits is a hub; each one that does not link to it is compared with all."""
    spread = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    middle = np.packbits(spread.mean(axis=0) > 0.5).view(">u8")[0].astype(np.uint64)
    hub = int(np.argmin(np.bitwise_count(prints ^ middle)))
    near = np.bitwise_count(prints ^ prints[hub]) <= bits
    parent = np.arange(len(prints))
    parent[near] = hub
    near[hub] = False
    a, b = [np.full(int(near.sum()), hub)], [np.flatnonzero(near)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    rest = np.flatnonzero(parent != hub)
    for i in rest.tolist():
        hits = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= bits)
        for j in hits[np.unique(parent[hits], return_index=True)[1]].tolist():
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                a.append(np.array([i]))
                b.append(np.array([j]))
    return prints[np.concatenate(a)], prints[np.concatenate(b)]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of the links (a, b), with the same root if they are connected. Each round every node takes
    the place of the neighbour that comes first in an order that is random anew, so a fixed share of the nodes of any
    graph, chains included, goes with each round. Links and names are written between the rounds."""
    edges = stash(edges, "links")
    roots, salt = None, 0
    while not edges.isEmpty():
        salt += 1
        rank = lambda x: F.xxhash64(F.col(x), F.lit(salt))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        moved = stash(first.select(F.col("a").alias("node"), F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "moves")
        at = lambda end: moved.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: B023, E731
        ends = edges.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to")
        edges = stash(ends.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        if roots is None:
            roots = moved.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(moved.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = stash(roots, "roots")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id, the smallest doc_id that can be
    reached over links of at most `bits` differing bits, its own included.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows and ids give a row each; a null
    id stays null and is never the smallest, unless its component has no other. An empty table gives no rows; texts are
    taken whole; other columns are not carried."""
    prints = stash(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = stash(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct")
    roots = settled(lambda: components(links(distinct.select("bits"), bits)), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = stash(named.select("bits", "root").join(stash(smallest, "smallest"), "root").select("bits", "component_id"), "placed")
    # Many copies can share a fingerprint; both sides are plain tables here, so Spark can split such a key over tasks.
    return prints.join(placed, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
