"""Benchmark decontamination: item-sized windows are found by SimHash and verified by weighted shingles."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stringloom.llm.common import bound_rows, stash, texts

#: Words of a shingle and the similarity from which a passage counts as the item.
WORDS, SIMILAR = 5, 0.8
#: Differing bits of the 64-bit fingerprints up to which windows are found, and the blocks of the index.
RADIUS, BLOCKS = 11, 4
#: Words of benchmark items that one pass over the documents searches, with an index of about 70 MB in each Python worker; a
#: larger benchmark takes more passes.
PASS_WORDS = 100_000
#: Words that are worked on at once; a part goes on into the next by a window, so that none is lost at the border.
PART_WORDS = 1 << 14

#: Letters A-Z to lower case, ASCII punctuation to space; all other bytes stay.
PLAIN = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else 32 if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def window_size(n: int) -> int:
    """Words of the windows by which an item of n words is found: the largest power of two within three quarters of it.
    A passage can then miss words at its ends, or one within, and still hold whole windows of the item."""
    return 1 << max(0, (3 * n // 4)).bit_length() - 1 if n > 1 else 1


def step(size: int) -> int:
    """Words from one window of a document to the next; an item is indexed at every place, so none falls between."""
    return max(1, size // 4)


class Hashes(dict):
    """64-bit hashes of words, at most 2**16 of them at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def grams(words: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word, a hash for each pair of adjacent words); the last word is no pair and stands alone."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return h, _mixed(h, np.append(h[1:], np.uint64(0)))


def _mixed(h: np.ndarray, after: np.ndarray) -> np.ndarray:
    mixed = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (after + (after << np.uint64(31)))
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9) ^ (mixed >> np.uint64(32))


def window_prints(hashed: tuple[np.ndarray, np.ndarray], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """{size: SimHash of each window of so many words, `sizes[size]` words apart}: the majority of the bits of its word
    pairs, or the hash of its only word. Sizes are powers of two; set bits are added up over 1, 2, 4 ... pairs, and a
    window has one of each of these."""
    words, pairs = hashed
    longest = max(sizes)
    bits = np.unpackbits(pairs.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    levels = [bits if longest < 256 else bits.astype(np.uint16 if longest < 65536 else np.uint32)]
    while 1 << len(levels) < longest:
        last, n = levels[-1], 1 << len(levels) - 1
        levels.append(last[: max(0, len(last) - n)] + last[n:])
    out = {}
    for size, every in sizes.items():
        if size == 1:
            out[size] = _mixed(words, np.zeros_like(words))[::every]
            continue
        number, at = max(0, (len(pairs) - size) // every + 1), 0
        ones = np.zeros((number, 64), levels[0].dtype)
        for k in range(size.bit_length() - 2, -1, -1):
            ones += levels[k][at::every][:number]
            at += 1 << k
        out[size] = np.packbits(ones > (size - 1) // 2, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def balls(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with at most `radius` bits set."""
    out = [np.zeros(1, np.int64)]
    for _ in range(radius):
        out.append(np.unique((out[-1][:, None] ^ (1 << np.arange(width))[None, :]).ravel()))
    return np.unique(np.concatenate(out))


class Index:
    """Fingerprints of item windows, by blocks. Two fingerprints within the radius differ in some block by at most
    radius // blocks bits; each block's table has every fingerprint under all such values, so none is missed."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        self.tables = []
        for low, high in zip(edges, edges[1:]):
            width = high - low
            value = ((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            keys = (value.astype(np.int32)[:, None] ^ balls(width, radius // blocks).astype(np.int32)[None, :]).ravel()
            first = np.zeros((1 << width) + 1, np.int32)
            first[1:] = np.bincount(keys, minlength=1 << width)
            np.cumsum(first, out=first)
            # Sorted in place as one number each: the key, then the fingerprint's place.
            both = keys.astype(np.int64) << 32
            del keys
            both |= np.repeat(np.arange(len(prints)), len(both) // max(1, len(prints)))
            both.sort()
            both &= (1 << 32) - 1
            self.tables.append((low, np.uint64((1 << width) - 1), first, both.astype(np.uint16 if len(prints) < 1 << 16 else np.int32)))

    def search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in wanted, place in prints) of all pairs within the radius."""
        found = set()
        for low, mask, first, owner in self.tables:
            value = ((wanted >> np.uint64(low)) & mask).astype(np.int64)
            begin = first[value]
            sizes = first[value + 1] - begin
            at = np.repeat(np.arange(len(wanted)), sizes)
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
            own = owner[place]
            near = np.bitwise_count(wanted[at] ^ self.prints[own]) <= self.radius
            found.update(zip(at[near].tolist(), own[near].tolist()))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def shingles(words: list[bytes], n: int = WORDS) -> Counter:
    """Shingles with their counts; fewer words give one shingle of all of them."""
    return Counter(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def hull(words: list[bytes], low: int, high: int, bag: Counter, n: int) -> tuple[int, int]:
    """The part of words[low:high] from the first to the last shingle of the item; all of it if it has none."""
    hits = [i for i in range(low, high - n + 1) if b" ".join(words[i : i + n]) in bag]
    return (hits[0], hits[-1] + n) if hits else (low, high)


def similarity(a: Counter, b: Counter, weight: dict) -> float:
    """Weighted Jaccard of two bags of shingles: the sum of the smaller weighted counts over that of the larger ones."""
    both = sum(min(n, b[s]) * weight.get(s, 1.0) for s, n in a.items() if s in b)
    total = sum(n * weight.get(s, 1.0) for s, n in a.items()) + sum(n * weight.get(s, 1.0) for s, n in b.items())
    return both / (total - both) if total else 0.0


class Benchmark:
    """Items with the index of their windows, by window size. A shingle's weight is 1 over the number of different items of
    the whole benchmark with it, so what items have in common counts little; each item brings its numbers beyond 1."""

    def __init__(self, items: list[tuple[object, str, list]], words: int = WORDS):
        self.items = [(i, w) for i, t, _ in items if (w := words_of(t or ""))]
        self.bags = [shingles(w, words) for _, w in self.items]
        self.weight = {bytes(s): 1.0 / n for _, _, common in items for s, n in common}
        places, hashes = defaultdict(list), Hashes()
        for k, (_, w) in enumerate(self.items):
            size = window_size(len(w))
            prints = window_prints(grams(w, hashes), {size: 1})[size]
            places[size] += [(p, k, at) for at, p in enumerate(prints.tolist())]
        self.sizes = {size: (Index(np.array([p for p, _, _ in x], np.uint64)), [(k, at) for _, k, at in x]) for size, x in sorted(places.items())}


_built: dict[str, Benchmark] = {}


def built(name: str, items: list) -> Benchmark:
    """The index of a block, made once in each Python worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(items)
    return _built[name]


def passages(docs: list[list[bytes]], bench: Benchmark, hashes: Hashes, n: int = WORDS, similar: float = SIMILAR) -> list[dict]:
    """For each document {item: (similarity, first word, end)} of the best passage of each item that it holds: around a
    window, what lies between the first and the last shingle of the item. Documents are worked on together, one after the
    other; windows over their borders are left out."""
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in docs]
    flat, sizes = [w for x in docs for w in x], np.array([len(x) for x in docs], np.int64)
    if not flat or not bench.sizes:
        return best
    ends = np.cumsum(sizes)
    every = {size: step(size) for size in bench.sizes}
    tried = set()
    for begin in range(0, len(flat), PART_WORDS):
        part = flat[begin : begin + PART_WORDS + max(bench.sizes)]
        for size, prints in window_prints(grams(part, hashes), every).items():
            index, places = bench.sizes[size]
            for at, own in zip(*index.search(prints)):
                k, offset = places[own]
                window = begin + int(at) * every[size]
                d = int(np.searchsorted(ends, window, "right"))
                low, high = int(ends[d] - sizes[d]), int(ends[d])
                start = window - offset
                if window + size > high or (k, start, d) in tried:
                    continue
                tried.add((k, start, d))
                length = len(bench.items[k][1])
                a, b = hull(flat, max(low, start - n), min(high, start + length + n), bench.bags[k], min(n, length))
                score = similarity(bench.bags[k], shingles(flat[a:b], n), bench.weight)
                a, b = a - low, b - low
                if score >= similar and (k not in best[d] or (-score, a) < (-best[d][k][0], best[d][k][1])):
                    best[d][k] = (score, a, b)
    return best


def with_common(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id, text, common): with each item those of its shingles that other items have too, and how many have them.
    Items with the same words are one item here, so a repeated item weighs as if it stood once."""
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    bound_rows(items.sparkSession)

    def key(batches):
        for batch in batches:
            own = pa.array([b" ".join(words_of(x or "")) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], ["item_id", "text", "key"])

    def split(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = list(shingles(k.split()))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.binary()), pa.array(own, pa.binary())], ["key", "shingle"])

    keyed = stash(rows.mapInArrow(key, T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])), "items")
    held = stash(keyed.select("key").distinct().mapInArrow(split, "key binary, shingle binary"), "shingles")
    counts = held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = held.join(counts, "shingle").groupBy("key").agg(F.collect_list(F.struct("shingle", "n")).alias("common"))
    return stash(keyed.join(common, "key", "left").select("item_id", "text", F.coalesce("common", F.array().cast(common.schema["common"].dataType)).alias("common")), "weighed")


def blocks(items: DataFrame, item_col: str, item_text: str, pass_words: int):
    """Lists of (item, text, common) of at least `pass_words` words, but for the last; one list is on the driver at a time."""
    block, size = [], 0
    for item in with_common(items, item_col, item_text).toLocalIterator():
        block.append((item.item_id, item.text, [(bytes(x.shingle), x.n) for x in item.common]))
        size += len((item.text or "").split())
        if size >= pass_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similar: float = SIMILAR, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per document row and item that it holds a passage of: doc_id, item_id, similarity, first_word and end_word
    (of the best passage, the first of equals; words are counted without ASCII punctuation).

    Every document is searched whole. The items are the stated query set: they are read in blocks of `pass_words` words,
    and each block, which is all that a task holds, is searched in a pass of its own. Null and empty texts, and items
    without words, match nothing; repeated items and rows give a row each; an empty table gives no rows; clean documents
    have no row; a document of any length is searched in parts that overlap by a window; other columns are not carried."""
    id_type, item_type = df.schema[id_col].dataType, items.schema[item_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    arrow, rows, spark = to_arrow_schema(schema), texts(df, id_col, text_col), df.sparkSession

    def one_pass(block: list) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches):
            bench, hashes = built(name, shared.value), Hashes()
            for batch in batches:
                out = []
                found = passages([words_of(x) for x in batch.column(1).to_pylist()], bench, hashes, similar=similar)
                for doc_id, own in zip(batch.column(0).to_pylist(), found):
                    for k, (score, a, b) in own.items():
                        out.append((doc_id, bench.items[k][0], score, a, b))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=arrow)

        return rows.mapInArrow(run, schema)

    passes = [one_pass(block) for block in blocks(items, item_col, item_text, pass_words)]
    return reduce(DataFrame.unionByName, passes) if passes else one_pass([])


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similar: float = SIMILAR, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of `df`, with all their columns, that hold no passage of any item; null and empty texts hold none. No row is
    shuffled; repeated rows and ids each stay or go; an empty table gives no rows."""
    schema, place, spark = df.schema, df.columns.index(text_col), df.sparkSession

    def one_pass(rows: DataFrame, block: list) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches):
            bench, hashes = built(name, shared.value), Hashes()
            for batch in batches:
                clean = [not x for x in passages([words_of(x or "") for x in batch.column(place).to_pylist()], bench, hashes, similar=similar)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rows.mapInArrow(run, schema)

    bound_rows(spark)
    for block in blocks(items, item_col, item_text, pass_words):
        df = one_pass(df, block)
    return df
