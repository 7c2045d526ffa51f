"""Language-model scoring: a gated recurrent network with a class-factored softmax, trained in numpy by Spark tasks."""

from __future__ import annotations

import ctypes
import heapq
import zlib
from dataclasses import dataclass
from functools import cache
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import frequent, rows_per_batch, stash, texts

#: The end of a text as a key among words: no word holds a space.
END = " "
#: Added to every count, that of an unseen word included.
SMOOTH = 0.1
#: Words that are units of the network themselves, and hash buckets for all the others, which are units too.
HEAD, BUCKETS = 1023, 64
#: Units of a class of the output; there are about as many classes.
MEMBERS = 32
#: Size of the state, steps of a truncated window, streams side by side, documents that are dealt to them together.
HIDDEN, WINDOW, STREAMS, SORTED = 16, 16, 256, 4096
#: The training documents are gone through once, in so many rounds; after each the shards' networks are averaged. The step
#: size, and the windows over which it rises to that in each round.
ROUNDS, RATE, RISE = 3, 0.3, 20
#: A window's gradient is divided by the tokens of a full one, so windows with few streams left move the weights little.
FULL = np.float32(1 / (WINDOW * STREAMS))
#: Where few streams are left, a window has up to so many times the steps.
LONGER = 8
#: Training documents of more tokens than this go to shards of their own, so that streams side by side are about as long; and
#: the tokens of a shard of short and of long ones. How many shards there are depends on the corpus alone, not on the
#: cluster, and so do the weights.
LONG, SHARD = 1024, (1 << 20, 1 << 22)
#: Sum of squared gradients that every weight starts with: early steps follow the gradient, not its sign.
START = 1e-6
#: The outputs before the softmax stay within these, so that their exponentials are finite.
LOGIT = np.float32(60)
#: Words whose counts every task holds; the other words meet their counts by a join.
HELD = 1 << 18
#: Parts in which the shards' networks are added up.
PARTS = 32
#: How units, and numbers of words, are written.
UNIT, WORD = np.dtype("<u2"), np.dtype("<u4")
#: Bytes of text that are numbered together, beside the bound by SORTED.
PART_BYTES = 8 << 20


def words_of(text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has: lower-cased A-Z, split at space and U+0009 to
    U+000D. Arrow splits off an empty word where white space begins or ends a text; these go."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words, there = split.flatten(), np.concatenate(([0], np.cumsum(pc.binary_length(split.flatten()).to_numpy() > 0)))
    borders = split.offsets.to_numpy() - split.offsets[0].as_py()
    return words if there[-1] == len(words) else words.filter(pc.not_equal(words, "")), np.diff(there[borders])


@cache
def keep_memory() -> None:
    """Arrays of a window are made anew for each one; the C library hands such memory back to the system and gets it again page by
    page. Here it keeps up to 64 MB for the next window. Once in each Python worker; without glibc, nothing happens."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    for option in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        mallopt(option, 64 << 20)


class Places(dict):
    """The places of held words, which come in the order of their places."""


@dataclass
class Vocabulary:
    """Counts of the training tokens: in all, distinct, of the held words, and of each bucket. Units: 0 is the end, then
    the words of the head by frequency, then the buckets."""

    total: int
    distinct: int
    held: Places  # word to its place in the lists below
    unit: np.ndarray
    log_count: np.ndarray  # log10(count + SMOOTH)
    rest: np.ndarray  # log10 of what a bucket's words share
    units: int
    start: np.ndarray  # counts of the units

    @property
    def base(self) -> float:
        return log10(self.total + SMOOTH * (self.distinct + 1))


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def vocabulary(counts: DataFrame, held: int = HELD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary from (key, n), and the counts that it does not hold."""
    place = (F.crc32(F.col("key").cast("binary")) % BUCKETS).cast("int").alias("bucket")
    sums = np.zeros((2, BUCKETS), np.int64)
    ends = 0
    for row in counts.groupBy(place, (F.col("key") == END).alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        if row.end:
            ends = row.n
        else:
            sums[:, row.bucket] += (row.n, row.v)
    total, distinct = int(sums[0].sum()) + ends, int(sums[1].sum()) + (ends > 0)
    top = frequent(counts.where(F.col("key") != END), held)
    known = sorted(((r.n, r.key.encode()) for r in top.toLocalIterator()), key=lambda x: (-x[0], x[1]))
    head = known[:HEAD]
    for n, word in head:
        sums[:, bucket(word)] -= (n, 1)
    first = 1 + len(head)
    unit = np.array([1 + i if i < len(head) else first + bucket(w) for i, (_, w) in enumerate(known)] + [0], np.int32)
    log_count = np.log10(np.array([n for n, _ in known] + [ends]) + SMOOTH)
    place_of = Places({w: i for i, (_, w) in enumerate(known)})
    start = np.concatenate(([ends], [n for n, _ in head], sums[0])).astype(np.float64) + 1.0
    rest = np.log10(sums[0] + SMOOTH * (sums[1] + 1))
    rare = counts.where(F.col("key") != END).join(top.select("key"), "key", "left_anti")
    return Vocabulary(total, distinct, place_of, unit, log_count, rest, first + BUCKETS, start), rare


class Network:
    """Embeddings are kept multiplied with the input weights: a row of three gates' inputs for each unit. The biases of the output are the
    last rows of its weights, which a one behind every state meets."""

    SHAPES = ("embed", "bias", "gates", "candidate", "classes", "members")

    def __init__(self, vocab: Vocabulary, values: np.ndarray | None = None):
        h, classes = HIDDEN, -(-vocab.units // MEMBERS)
        shapes = [(vocab.units, 3 * h), (3 * h,), (h, 2 * h), (h, h), (h + 1, classes), (classes, h + 1, MEMBERS)]
        sizes = [int(np.prod(s)) for s in shapes]
        if values is None:
            rng = np.random.default_rng(11)
            values = rng.normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.values = np.array(values, np.float32)
        at = 0
        for name, shape, size in zip(self.SHAPES, shapes, sizes):
            setattr(self, name, self.values[at : at + size].reshape(shape))
            at += size
        self.to_class, self.class_bias = self.classes[:h], self.classes[h]
        self.to_member, self.member_bias = self.members[:, :h], self.members[:, h]

    @classmethod
    def untrained(cls, vocab: Vocabulary) -> Network:
        """Random weights; the output's biases are the frequencies of the units."""
        net = cls(vocab)
        counts = np.zeros(net.member_bias.size)
        counts[: vocab.units] = vocab.start
        counts = counts.reshape(net.member_bias.shape)
        net.bias[:] = 0
        net.class_bias[:] = np.log(counts.sum(axis=1) / counts.sum())
        net.member_bias[:] = np.log(np.maximum(counts, 1e-9) / counts.sum(axis=1, keepdims=True))
        return net

    def states(self, units: np.ndarray, begins: np.ndarray, state: np.ndarray):
        """States before and after each step of a window: `units` (steps, streams) go in, from `state`; where a document
        begins, the state before it is zero. All that comes back is (steps, features, streams): a step's features lie beside
        each other, and so do the streams of a feature, over which every pass goes."""
        h, (steps, streams) = HIDDEN, units.shape
        resets, went = begins.any(axis=1).tolist(), (~begins).astype(np.float32)
        rows = self.embed + self.bias
        rows *= np.repeat(np.array([-1, 2], np.float32), (2 * h, h))
        inputs = np.ascontiguousarray(rows.take(units, axis=0).transpose(0, 2, 1))
        minus, twice = -self.gates.T, 2 * self.candidate.T
        gates = np.empty((steps, 2 * h, streams), np.float32)
        prior, out, cand, reset = np.empty((4, steps, h, streams), np.float32)
        state = state.T
        with np.errstate(over="ignore"):  # 1 / (1 + inf), a gate that is shut
            for t in range(steps):
                before, g, c = prior[t], gates[t], cand[t]
                if resets[t]:
                    np.multiply(state, went[t], out=before)
                else:
                    before[:] = state
                np.matmul(minus, before, out=g)
                g += inputs[t, : 2 * h]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                np.multiply(g[h:], before, out=reset[t])
                np.matmul(twice, reset[t], out=c)
                c += inputs[t, 2 * h :]
                np.exp(c, out=c)  # tanh(x) = 1 - 2 / (1 + e^2x), in less time than np.tanh
                c += 1
                np.divide(-2, c, out=c)
                c += 1
                state = np.subtract(before, c, out=out[t])
                state *= g[:h]
                state += c
        return prior, out, gates, cand, reset

    def output(self, out: np.ndarray, unit: np.ndarray, valid: np.ndarray, learn: bool = False):
        """Natural log-probability of each valid unit after its state: that of its class times that of the unit in the class.
        With `learn`, instead the gradient of the loss for the states, in their shape, and those for `classes` and `members`."""
        h, (steps, _, streams) = HIDDEN, out.shape
        there = None if valid.all() else np.flatnonzero(valid)
        unit = unit.ravel() if there is None else unit.ravel()[there]
        cls = (unit // MEMBERS).astype(np.int16)  # small integers are sorted in linear time
        order = np.argsort(cls, kind="stable")
        at = order if there is None else there[order]
        cls, member, every = cls.take(order), (unit % MEMBERS).take(order), np.arange(len(unit))
        rows = np.empty((steps, streams, h + 1), np.float32)
        rows[:, :, :h], rows[:, :, h] = out.transpose(0, 2, 1), 1
        state = rows.reshape(-1, h + 1).take(at, axis=0)
        # Sums over a row as a product with ones: faster over short rows.
        logits = state @ self.classes
        # A product for each class that occurs; all else goes over all units at once.
        cut = np.searchsorted(cls, np.arange(len(self.members) + 1)).tolist()
        used = [(k, slice(cut[k], cut[k + 1])) for k in range(len(self.members)) if cut[k] < cut[k + 1]]
        inner = np.empty((len(unit), MEMBERS), np.float32)
        for k, own in used:
            np.matmul(state[own], self.members[k], out=inner[own])
        # No feature of a state is beyond one, so the weights tell whether an output can be.
        for found, weights in ((logits, self.classes), (inner, self.members)):
            if not np.abs(weights).sum(axis=-2).max() < LOGIT:
                np.clip(found, -LOGIT, LOGIT, out=found)
        if not learn:
            logs = logits[every, cls] + inner[every, member]
            for found in (logits, inner):
                np.exp(found, out=found)
                logs -= np.log(found @ np.ones(found.shape[1], np.float32))
            result = np.empty_like(logs)
            result[order] = logs
            return result
        for found, place in ((logits, cls), (inner, member)):
            np.exp(found, out=found)
            found *= (FULL / (found @ np.ones(found.shape[1], np.float32)))[:, None]
            found.ravel()[every * found.shape[1] + place] -= FULL
        # The last row is that of units that are not there.
        back, members = np.zeros((len(unit) + 1, h), np.float32), np.zeros_like(self.members)
        for k, own in used:
            np.matmul(state[own].T, inner[own], out=members[k])
            np.matmul(inner[own], self.to_member[k].T, out=back[own])
        back[:-1] += logits @ self.to_class.T
        row = np.full(steps * streams, len(unit))
        row[at] = every
        return np.ascontiguousarray(back.take(row, axis=0).reshape(steps, streams, h).transpose(0, 2, 1)), state.T @ logits, members

    def learn(self, before: np.ndarray, unit: np.ndarray, begins: np.ndarray, valid: np.ndarray, state: np.ndarray, squares: Network, rate: float) -> np.ndarray:
        """A step of gradient descent on one window, with back-propagation to its start; the state after it."""
        h = HIDDEN
        prior, out, gates, cand, reset = self.states(before, begins, state)
        slope: dict[str, np.ndarray] = {}
        flow, slope["classes"], slope["members"] = self.output(out, unit, valid, learn=True)
        d_in = np.empty((len(before), 3 * h, before.shape[1]), np.float32)
        z, r = gates[:, :h], gates[:, h:]
        shut = 1 - z
        to_update = prior - cand
        to_update *= z
        to_update *= shut
        to_cand = np.multiply(cand, cand, out=cand)
        np.subtract(1, to_cand, out=to_cand)
        to_cand *= shut
        to_reset = np.subtract(1, r, out=shut)
        to_reset *= reset
        stays, resets = (~begins).astype(np.float32), begins.any(axis=1).tolist()
        ahead = np.zeros((h, before.shape[1]), np.float32)
        for t in range(len(before) - 1, -1, -1):
            d, into = flow[t], d_in[t]
            d += ahead
            dc = np.multiply(d, to_cand[t], out=into[2 * h :])
            d_reset = self.candidate @ dc
            np.multiply(d, to_update[t], out=into[:h])
            np.multiply(d_reset, to_reset[t], out=into[h : 2 * h])
            np.matmul(self.gates, into[: 2 * h], out=ahead)
            d_reset *= r[t]
            ahead += d_reset
            d *= z[t]
            ahead += d
            if resets[t]:
                ahead *= stays[t]
        slope["gates"] = np.matmul(prior, d_in[:, : 2 * h].transpose(0, 2, 1)).sum(axis=0)
        slope["candidate"] = np.matmul(reset, d_in[:, 2 * h :].transpose(0, 2, 1)).sum(axis=0)
        flat = before.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat.take(order)
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        # Sums of two columns at a time, as parts of a complex number, take half as many steps.
        used, rows = flat[first], d_in.transpose(0, 2, 1).reshape(-1, 3 * h).take(order, axis=0)
        g = np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)
        slope["bias"] = g.sum(axis=0)
        for name, own_g in slope.items():
            own, sq = getattr(self, name), getattr(squares, name)
            sq += own_g * own_g
            own -= rate * own_g / np.sqrt(sq)
        sums = squares.embed.take(used, axis=0)
        sums += g * g
        squares.embed[used] = sums
        g *= np.float32(rate)
        g /= np.sqrt(sums, out=sums)
        self.embed[used] -= g
        return out[-1].T


def windows(found: list[np.ndarray]):
    """Documents, given by their units, in up to STREAMS streams of about the same length, each of which takes one
    document after the other. A window is (units before, units, number of the document, which units begin one, which are
    there), each by step and stream; streams that have ended are left out."""
    sizes = np.array([len(x) for x in found])
    lanes: list[list[int]] = [[] for _ in range(min(STREAMS, len(found)))]
    loads = [(0, k) for k in range(len(lanes))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heapq.heappop(loads)
        lanes[k].append(i)
        heapq.heappush(loads, (load + int(sizes[i]), k))
    lanes.sort(key=lambda x: -int(sizes[x].sum()))
    order = [i for lane in lanes for i in lane]
    flat, doc = np.concatenate([found[i] for i in order]), np.repeat(order, sizes[order])
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum(sizes[order]) - sizes[order]] = True
    length = np.array([sizes[x].sum() for x in lanes])
    starts = np.cumsum(length) - length
    before = np.where(begins, 0, np.roll(flat, 1))
    begin = 0
    while begin < length[0]:
        active = int((length > begin).sum())
        # As streams end, windows grow longer, so that a few long documents take no more steps than many short ones.
        at = begin + np.arange(min(WINDOW * min(LONGER, max(1, STREAMS // active)), int(length[0]) - begin))[:, None]
        begin += len(at)
        valid = at < length[None, :active]
        place = np.where(valid, starts[:active] + at, 0)
        yield before[place], flat[place], doc[place], begins[place], valid


def dealt(coded: DataFrame) -> tuple[DataFrame, int]:
    """The texts that train, with their `shard` by length and by a hash of what they are, and the number of shards."""
    taught, is_long = coded.where(~F.col("held_out")), F.col("n_tokens") > LONG
    sums = {r.long: r.n for r in taught.groupBy(is_long.alias("long")).agg(F.sum("n_tokens").alias("n")).collect()}  # two rows
    short, long = (-(-sums.get(kind, 0) // size) for kind, size in zip((False, True), SHARD))
    own = lambda n: F.pmod(F.xxhash64("doc_id", "units"), F.lit(max(1, n)))
    return taught.withColumn("shard", F.when(is_long, own(long) + short).otherwise(own(short)).cast("int")), max(1, short + long)


def train(coded: DataFrame, vocab, start: np.ndarray, rate: float, shards: int) -> np.ndarray:
    """Each shard of (doc_id, units, shard) trains the network on its documents; the mean of their networks, by tokens. `start` and the
    result are the weights and the sums of their squared gradients. They are cut into PARTS that are added up apart, so
    that only one network reaches the driver."""
    shared = coded.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        keep_memory()
        net, squares = (Network(vocab.value, x) for x in shared.value)
        tokens = steps = 0
        for some in _tables(batches):
            found = [np.frombuffer(x, UNIT).astype(np.int32) for x in some.column(0).to_pylist()]
            tokens += sum(map(len, found))
            state = np.zeros((STREAMS, HIDDEN), np.float32)
            for before, unit, _, begins, valid in windows(found):
                steps += 1
                state = net.learn(before, unit, begins, valid, state[: before.shape[1]], squares, rate * min(1.0, steps / RISE))
        if tokens:
            parts = np.array_split(np.concatenate((net.values, squares.values)), PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([float(tokens)] * PARTS), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "tokens", "network"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for part, n, raw in zip(*(x.to_pylist() for x in batch.columns)):
                own = sums.setdefault(part, [0.0, 0.0])
                own[0] += n
                own[1] = own[1] + n * np.frombuffer(raw, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x[0] for x in sums.values()]), pa.array([(x[1] / x[0]).astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["part", "tokens", "network"])

    kind = "part int, tokens double, network binary"
    placed = coded.select("units", "shard", F.xxhash64("doc_id", "units").alias("place")).repartitionById(shards, F.col("shard")).sortWithinPartitions("place")
    found = sorted(placed.select("units").mapInArrow(run, kind).repartition("part").mapInArrow(add, kind).collect(), key=lambda r: r.part)
    return np.concatenate([np.frombuffer(r.network, np.float32) for r in found]).reshape(2, -1) if found else start


def log_likelihoods(net: Network, found: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's units; the state goes on from window to window."""
    out, state = np.zeros(len(found)), np.zeros((STREAMS, HIDDEN), np.float32)
    for before, unit, doc, begins, valid in windows(found):
        _, states, *_ = net.states(before, begins, state[: before.shape[1]])
        state = states[-1].T
        logs = net.output(states, unit, valid)
        out += np.bincount(doc[valid], weights=logs, minlength=len(found))
    return out / np.log(10)


def score(df: DataFrame, held_out: Column, round_of: Column, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows for which `held_out` is not true: first the counts of all their words, then the
    network, in `rounds` rounds, over every window of every document, those whose `round_of` is r in round r. A text's
    score is the log10 probability of its words and its end: of the unit by the network, and of a word that shares a
    bucket by its count within the bucket, where unseen words together have the share of one.

    The texts are read once: parts of them are written as numbers of words with the words beside them. The counts, then the
    units of each text and what its held words add up to come from that, and training and scoring read the units. Null and empty texts are one end. Repeated rows and ids give a row each; a null id stays
    null; an empty table gives no rows; texts are taken whole, their state being carried from window to window in
    training and in scoring; other columns are not carried."""
    spark = df.sparkSession
    rows = texts(df, id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(round_of, F.lit(0)).alias("round"))

    parts = stash(numbered(rows), "parts")
    pairs = counted(parts)
    ends = parts.agg(F.lit(END).alias("key"), F.sum("ends").alias("n")).where("n > 0")
    with rows_per_batch(spark, 1):  # a part is many texts
        counts = stash(pairs.groupBy("key").agg(F.sum("n").alias("n")).unionByName(ends), "words")
    vocab, rare = vocabulary(counts, held)
    shared = spark.sparkContext.broadcast(vocab)
    with rows_per_batch(spark, 1):
        coded = stash(encoded(parts, shared), "units")
    first = Network.untrained(vocab).values
    values = np.stack((first, np.full_like(first, START)))
    taught, shards = dealt(coded)
    for r in range(rounds):
        values = train(taught.where(F.col("round") == r), shared, values, RATE, shards)
    network = spark.sparkContext.broadcast(values[0])
    out = T.StructType([f for f in coded.schema if f.name not in ("units", "round")] + [T.StructField("logs", T.DoubleType())])

    def run(batches):
        keep_memory()
        net = Network(shared.value, network.value)
        for some in _tables(batches):
            logs = log_likelihoods(net, [np.frombuffer(x, UNIT).astype(np.int32) for x in some.column(0).to_pylist()])
            columns = [some.column(i).combine_chunks() for i in range(1, some.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logs + some.column("tail").to_numpy(), pa.float64())], out.names)

    docs = coded.select("units", *out.names[:-1]).mapInArrow(run, out)
    # A row for each word that is not held; the first of a document also brings what the task has summed. A document
    # without such words has one row, under a key with a space, which no word has.
    first = F.coalesce("i", F.lit(0)) == 0
    pairs = docs.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "logs", "times", F.posexplode_outer("keys").alias("i", "key")).select(
        "row", "doc_id", "held_out", *(F.when(first, F.col(x)).alias(x) for x in ("n_tokens", "n_known", "base", "logs")),
        F.coalesce("key", F.concat(F.lit(" "), (F.col("row") % 100_003).cast("string"))).alias("key"), F.when(F.col("key").isNotNull(), F.get("times", F.col("i"))).alias("times"),
    )
    n = F.coalesce("n", F.lit(0))
    met = pairs.join(rare, "key", "left").groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when(n > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.sum("base").alias("base"),
        F.sum("logs").alias("logs"),
        F.coalesce(F.sum(F.col("times") * F.log10(n + F.lit(SMOOTH))), F.lit(0.0)).alias("cold"),
    )
    return met.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("cold") - F.col("n_tokens") * F.lit(vocab.base)).alias("base_score"), (F.col("logs") + F.col("cold")).alias("score"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, text, held_out, round) in parts of up to SORTED rows. A row of the result is a part: its different `words` with a
    space between them, how often each stands in training texts (`times`, in one), how many of these there are (`ends`), and of each text its id, whether it
    is held out, its round, the number of its words and, all in one, the numbers of its words."""
    listed = [T.StructField(f"{f.name}s", T.ArrayType(f.dataType)) for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField("words", T.StringType()), T.StructField("times", T.BinaryType()), T.StructField("ends", T.LongType()), *listed, T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("numbers", T.BinaryType())])

    def run(batches):
        for some in _tables(batches):
            words, sizes = words_of(some.column("text").combine_chunks())
            coded = words.dictionary_encode()
            places, numbers = coded.dictionary, coded.indices.to_numpy().astype(WORD)
            trains = ~some.column("held_out").to_numpy()
            times = np.bincount(numbers[np.repeat(trains, sizes)], minlength=len(places))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            kept = [one(some.column(f.name.removesuffix("s")).combine_chunks()) for f in listed]
            columns = [pc.binary_join(one(places), " "), pa.array([times.astype(np.int64).tobytes()], pa.binary()), pa.array([int(trains.sum())], pa.int64()), *kept]
            yield pa.RecordBatch.from_arrays([*columns, one(pa.array(sizes, pa.int64())), pa.array([numbers.tobytes()], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def listed_words(part: pa.StringScalar) -> pa.StringArray:
    """The words of a part, which has a space between them."""
    return pc.split_pattern(pa.array([part]), " ").values if len(part.as_buffer()) else pa.array([], pa.string())


def counted(parts: DataFrame) -> DataFrame:
    """(key, n): for each part, its words that stand in training texts and how often."""

    def run(batches):
        for batch in batches:
            for words, times in zip(*(batch.column(x) for x in ("words", "times"))):
                found = pa.RecordBatch.from_arrays([listed_words(words), pa.array(np.frombuffer(times.as_buffer(), np.int64))], ["key", "n"])
                yield found.filter(pc.greater(found.column("n"), 0))

    return parts.select("words", "times").mapInArrow(run, "key string, n long")


def encoded(parts: DataFrame, vocab) -> DataFrame:
    """A row for each text of the parts: its number, the units of its tokens, how many tokens it has and how many of them are
    held, the sums of their log-counts (`base`) and of what its held words have of their buckets (`tail`), and the words
    that are not held with their numbers."""
    listed = ("doc_ids", "held_outs", "rounds")
    schema = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(x.removesuffix("s"), parts.schema[x].dataType.elementType) for x in listed)])
    kinds = {"units": T.BinaryType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "base": T.DoubleType(), "tail": T.DoubleType(), "keys": T.ArrayType(T.StringType()), "times": T.ArrayType(T.LongType())}
    for name, kind in kinds.items():
        schema.add(name, kind)

    def one(own: Vocabulary, held: pa.StringArray, words: pa.StringArray, sizes: np.ndarray, numbers: np.ndarray) -> list[pa.Array]:
        """The columns from `units` on, for all texts of a part at once."""
        place = pc.fill_null(pc.index_in(words, value_set=held.cast(words.type)), -1).to_numpy()
        first, missing = own.units - BUCKETS, np.flatnonzero(place < 0)
        unit = own.unit[place]
        unit[missing] = first + np.fromiter(map(bucket, words.take(pa.array(missing)).cast(pa.binary()).to_pylist()), np.int64, len(missing))
        log_count, rest = np.where(place < 0, 0.0, own.log_count[place]), np.where(unit >= first, own.rest[np.maximum(unit - first, 0)], 0.0)
        tail = np.where(unit >= first, log_count, 0.0) - rest
        n, text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        units, ends = np.zeros(len(numbers) + n, UNIT), np.cumsum(sizes + 1)
        units[np.arange(len(numbers)) + text] = unit[numbers]  # each text before this one has its end, a zero
        borders = np.concatenate(([0], ends * UNIT.itemsize)).astype(np.int32)
        base, tail = (np.bincount(text, weights=x[numbers], minlength=n) for x in (log_count, tail))
        away = np.flatnonzero((place < 0)[numbers])
        cold, times = np.unique(text[away] * len(words) + numbers[away], return_counts=True)
        known = sizes - np.bincount(text[away], minlength=n) + (own.total > 0)
        of = pa.array(np.searchsorted(cold, np.arange(n + 1) * len(words)), pa.int32())
        return [
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(borders), pa.py_buffer(units)]),
            pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base + own.log_count[-1], pa.float64()), pa.array(tail, pa.float64()),
            pa.ListArray.from_arrays(of, words.take(pa.array(cold % max(1, len(words))))), pa.ListArray.from_arrays(of, pa.array(times, pa.int64())),
        ]

    def run(batches):
        own = vocab.value
        held = pa.array(list(own.held), pa.binary()).cast(pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                part = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes, numbers = part["sizes"].values.to_numpy(), np.frombuffer(part["numbers"].as_buffer(), WORD).astype(np.int64)
                columns = [pa.array(np.zeros(len(sizes), np.int64)), *(part[x].values for x in listed), *one(own, held, listed_words(part["words"]), sizes, numbers)]
                found = pa.RecordBatch.from_arrays(columns, schema.names)
                for at in range(0, len(sizes), 256):
                    yield found.slice(at, 256)

    found = parts.select("words", *listed, "sizes", "numbers").mapInArrow(run, schema)
    return found.withColumn("row", F.monotonically_increasing_id())


def _tables(batches):
    """Batches of up to SORTED rows or PART_BYTES: more documents side by side."""
    held, size, n_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        n_bytes += batch.nbytes
        if size >= SORTED or n_bytes >= PART_BYTES:
            yield pa.Table.from_batches(held)
            held, size, n_bytes = [], 0, 0
    if size:
        yield pa.Table.from_batches(held)
