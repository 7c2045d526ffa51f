"""Best-fit packing of token sequences with bounds that certify how many are needed."""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import stash, texts
from stringloom.llm.token_count import load

#: Tokens of a sequence.
SIZE = 2048
#: Pieces that one task packs together, on average.
GROUP = 4096
#: The most times that sequences with gaps are exchanged.
ROUNDS = 12
#: Divisions of the functions that round: of lengths as they are, and of those over thresholds.
STEPS = (range(1, 17), range(1, 5))


#: Characters of Latin scripts have had their class since long ago; others are looked up.
BEYOND = re.compile("[^\x00-\u017f]")


@cache
def reclassed(c: str) -> bool:
    """Whether a character's class (letter, number, space, other) is not the same in Unicode 3.2 and today. Libraries with
    different Unicode versions agree on all others."""
    old, new = (db.category(c)[0] for db in (unicodedata.ucd_3_2_0, unicodedata))
    return old != new and bool({old, new} & {"L", "N", "Z"})


#: White space beyond which a text goes to the tokenizers library: the other one keeps its places on the stack.
LONG_SPACE = re.compile(r"\s{4096}")


class Ids:
    """The ids that the tokenizers library gives for a whole text, special strings within it being one id each. The ranks of the
    same vocabulary give them several times faster; texts with characters that the two can class otherwise go to the
    library itself."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken

        self.library = load(vocabulary)
        added = self.library.get_added_tokens_decoder()
        if self.library.normalizer is not None or any(x.single_word or x.lstrip or x.rstrip for x in added.values()):
            raise ValueError("only tokenizers without a normalizer and with plain special strings are known here")
        self.special = {x.content: i for i, x in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=lambda x: -len(x))) + ")") if self.special else None
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not text.isascii() and any(map(reclassed, set(BEYOND.findall(text)))) or LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if self.cut is None or not any(x in text for x in self.special):
            return self.plain.encode_ordinary(text)
        return [i for part in self.cut.split(text) for i in ([self.special[part]] if part in self.special else self.plain.encode_ordinary(part))]


def pieces(df: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and `end`, in pieces of `size` of which only the first can
    be shorter. `encoder()` makes the function from text to ids, once in each task."""
    fields = "piece int, start long, length long, ids_crc32 long"
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *T._parse_datatype_string(fields)])

    def run(batches):
        ids_of = encoder()
        for batch in batches:
            which, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = np.array([*ids_of(text), end], "<u4").tobytes()
                n = len(raw) // 4
                begin, stop = 0, n % size or size
                for k in range(-(-n // size)):
                    which.append(i)
                    out.append((k, begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop])))
                    begin, stop = stop, stop + size
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *columns], schema.names)

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, size: int, enough: int | None = None) -> int:
    """The fewest sequences of `size` that pieces can need, where `counts[x]` pieces have length x: the largest sum over dual-feasible
    functions, which give to lengths that fit into one sequence together no more than 1 together. All in whole numbers.
    It ends as soon as `enough` is reached.

    Families: lengths as they are, those below a threshold being nothing and those that leave less than it being 1; rounding
    to multiples of 1/k, alone and on top of thresholds; and numbers of pieces of at least some length."""
    x = np.arange(size + 1)
    most = -(-int(counts @ x) // size)
    if enough is not None and most >= enough:
        return most
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return most
    n = counts[lengths].astype(np.int64)
    # Only thresholds at lengths that occur, or just beyond what fits beside one, change a function.
    edges = np.unique(np.concatenate((lengths, size - lengths, lengths + 1, size - lengths + 1)))
    edges = edges[(edges >= 1) & (edges <= size // 2)][:, None]
    cut = np.where(lengths > size - edges, size, np.where(lengths < edges, 0, lengths))

    def totals():
        yield cut @ n, size
        if len(edges):
            fit = size // edges[:, 0]
            yield np.where(2 * lengths > size, fit[:, None] - (size - lengths) // edges, lengths >= edges) @ n, fit
        for form, steps in zip((lengths[None], cut), STEPS):
            for k in steps:
                scaled = (k + 1) * form
                yield np.where(scaled % size == 0, k * form, size * (scaled // size)) @ n, k * size

    for total, one in totals():
        most = max(most, int((-(-total // one)).max(initial=0)))
        if enough is not None and most >= enough:
            break
    return most


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """The sequence and the place in it of each piece: the longest first, each where the least room stays. Lengths are at most
    `size`. One number's bits say which gaps there are, so the tightest gap is found at once."""
    which, place = [0] * len(lengths), [0] * len(lengths)
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gaps, opened = 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            own = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, own, opened = size, opened, opened + 1
        which[i], place[i] = own, size - gap
        if gap > n:
            by_gap[gap - n].append(own)
            gaps |= 1 << gap - n
    return which, place


def _packed(pool: DataFrame, deal: str, groups: int, first: int, size: int) -> DataFrame:
    """`pool` in groups by a hash of the column `deal`, each packed anew if that needs fewer sequences than before. With `whole`:
    whether the sequence has no gap; and `certified`: whether a bound says that the group cannot do with fewer."""
    schema = T.StructType([*pool.schema.fields, T.StructField("whole", T.BooleanType()), T.StructField("certified", T.BooleanType())])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        lengths, before = rows["length"].to_pylist(), rows["sequence_id"].combine_chunks()
        which, place = best_fit(lengths, size)
        needed, old = max(which) + 1, len(before.unique())
        if before.null_count or needed < old:
            sequence, offset = ((first + key[0].as_py()) << 24) + np.array(which, np.int64), np.array(place, np.int64)
        else:
            sequence, offset, needed = before.to_numpy(), rows["offset"].combine_chunks().to_numpy(), old
        _, own = np.unique(sequence, return_inverse=True)
        whole = np.bincount(own, weights=lengths)[own] == size
        certified = lower_bound(np.bincount(lengths, minlength=size + 1), size, needed) == needed
        new = {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "whole": pa.array(whole), "certified": pa.array([certified] * len(lengths))}
        return pa.table({name: new[name] if name in new else rows[name] for name in schema.names})

    dealt = F.pmod(F.xxhash64(deal), F.lit(groups)).alias("dealt")
    return pool.select("*", dealt).groupBy("dealt").applyInArrow(pack, schema)


def pack(items: DataFrame, size: int = SIZE, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """`items` (length from 1 to `size`, and other columns) with `sequence_id` and `offset`: the pieces of a sequence lie beside each
    other from 0 on and are together no longer than `size`; and with `certified`: whether a bound says that the pieces it was
    packed with cannot do with fewer sequences.

    Pieces of full length are sequences of their own. The others are dealt out by a hash into groups of about `group`, each
    packed by best fit decreasing, and dual-feasible functions tell for each group how few sequences it can need at least.
    Sequences without a gap are settled. As long as there are more than the bound over all pieces certifies, sequences with
    gaps are exchanged: dealt out anew, whole, in as few groups as their number allows, and packed again; a group
    keeps what it had unless it gets on with fewer. It ends when the bound is met, or when all that is left is in one group,
    or, with several groups left, when two exchanges in a row have saved nothing, and after `rounds` in any case. No group
    grows with the input; the driver sees the histogram of lengths (`size` rows) and sums.

    An empty table gives no rows. Repeated rows are pieces like others. Rows must not change between readings, so `items` is
    written first; it must not have columns named key, sequence_id, offset, whole, certified or dealt."""
    rows = stash(items.select(F.monotonically_increasing_id().alias("key"), "*"), "pieces")
    none = F.lit(None).cast("long")
    full = rows.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("key")).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    counts = np.zeros(size + 1, np.int64)
    for r in rows.where(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    parts, pool, left, bound = [full], rows.where(F.col("length") < size).withColumn("sequence_id", none).withColumn("offset", none), int(counts.sum()), lower_bound(counts, size)
    first, used, last, idle, deal = 0, 0, None, 0, "key"
    while left:
        groups = -(-left // group)
        packed = stash(_packed(pool, deal, groups, first, size), "packed")
        first += groups
        begins = F.col("offset") == 0
        told = packed.agg(F.count(F.when(begins, 1)).alias("n"), F.count(F.when(begins & F.col("whole"), 1)).alias("whole"), F.count(F.when(~F.col("whole"), 1)).alias("left")).first()
        total = used + told.n
        idle = idle + 1 if last is not None and total >= last else 0
        rounds, last, left = rounds - 1, total, told.left
        if total <= bound or groups == 1 or rounds <= 0 or idle >= 2:
            return _whole([*parts, packed])
        parts.append(packed.where("whole"))
        used += told.whole
        pool, deal = packed.where(~F.col("whole")).drop("whole", "certified"), "sequence_id"
    return _whole(parts)


def _whole(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.drop("key", "whole") for x in parts))


def pack_documents(df: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified) for each piece of each text of `df`, packed into sequences of
    `size` tokens. `vocabulary` (.json) and `ranks` (.tiktoken) are the same tokenizer, `pattern` is how it splits text.

    Null and empty texts are one token, the end. Repeated rows and ids are documents of their own; a null id stays null;
    other columns are not carried; a text of any length is encoded whole and then cut."""
    return pack(pieces(df, lambda: Ids(vocabulary, ranks, pattern), id_col, text_col, size), size, group)
