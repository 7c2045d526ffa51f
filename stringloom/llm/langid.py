"""Language ID by mixture inference: each document is a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import stash, texts

#: Slots that byte trigrams are hashed to; a language's model is that many log-likelihoods.
SLOTS = 1 << 17
#: Added to the count of each slot.
SMOOTH = 0.5
#: Trigrams of a segment; a segment is taken to be in one language.
SEGMENT = 48
#: What a further language must add to the log-likelihood, per unit of 0.5 * log(segments); and rounds of EM.
PENALTY, ROUNDS = 8.0, 30

#: Languages of one part of the model, which takes 0.5 MB for each. A column with more of them has more parts, one after the other.
#: Tasks hold the counts of HELD languages at a time.
LANGS, HELD = 256, 64
#: Characters of the texts that are worked on together.
PART = 1 << 18

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes of ASCII that are no letters become spaces; letters are lower-cased before.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each byte trigram of the texts, one after the other; number of trigrams of each text). Trigrams around a
    space are left out."""
    parts = [b" " + x.lower().encode("utf-8", "replace").translate(LETTERS) + b" " for x in found]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    sizes = np.array([len(x) for x in parts], np.int64)
    if len(raw) < 3:
        return np.empty(0, np.int64), np.zeros(len(found), np.int64)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    keep = raw[1:-1] != 32
    # The middle of a trigram is never the space at a text's border, so no trigram belongs to two texts.
    owner = np.repeat(np.arange(len(found)), sizes)[1:-1]
    return (mixed[keep] >> np.uint32(32 - 17)).astype(np.int64), np.bincount(owner[keep], minlength=len(found))


def _some(found: list[str]):
    """The texts in parts of about PART characters; a longer one is a part of its own, whole."""
    part, size = [], 0
    for text in found:
        if part and size + len(text) > PART:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def counted_languages(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, slot, n), written: how often each trigram slot occurs in each language, from all rows of `df` with a language and a text.
    Tasks add up their counts; a language whose texts have no trigram is none."""
    rows = texts(df, lang_col, text_col).where("doc_id is not null")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                for some in _some(own):
                    counts = np.bincount(trigrams(some)[0], minlength=SLOTS)
                    found[lang] = found[lang] + counts if lang in found else counts
                if len(found) > HELD:
                    yield from counted(found)
                    found = {}
        yield from counted(found)

    def counted(found):
        for lang, counts in found.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int64()), pa.array(counts[slots], pa.int64())], ["lang", "slot", "n"])

    return stash(rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigrams")


def parts_of(sums: DataFrame, most: int = LANGS) -> list[list[str]]:
    """The languages in parts of at most `most`, those with the most trigrams first. Only names come to the driver."""
    ranked = [r.lang for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").select("lang").toLocalIterator()]
    return [sorted(ranked[i : i + most]) for i in range(0, len(ranked), most)]


def model_of(sums: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-likelihoods by slot and language; at most SLOTS rows for each of the languages of a part reach the driver."""
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.full((SLOTS, len(langs)), SMOOTH)
    if langs:
        known = sums.sparkSession.createDataFrame([(x,) for x in langs], "lang string")
        totals = sums.join(F.broadcast(known), "lang").toArrow()
        at = np.array([place[x] for x in totals.column("lang").to_pylist()], np.int64)
        counts[totals.column("slot").to_numpy(), at] += totals.column("n").to_numpy()
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = LANGS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods by slot and language) of the first part of the model."""
    sums = counted_languages(df, lang_col, text_col)
    langs = (parts_of(sums, most) or [[]])[0]
    return langs, model_of(sums, langs)


def fit(segments: np.ndarray, sizes: np.ndarray, chosen: list[int], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Expectation-maximisation: (log-likelihood, share of trigrams) of the languages `chosen`, from the log-likelihood of
    each segment in each language."""
    own = segments[:, chosen]
    top = own.max(axis=1, keepdims=True)
    like = np.exp(own - top)
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(rounds):
        joint = like * share
        resp = joint / joint.sum(axis=1, keepdims=True)
        new = (resp * sizes[:, None]).sum(axis=0) / sizes.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return float((top[:, 0] + np.log((like * share).sum(axis=1))).sum()), share


def mixture(segments: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """(languages, their shares): languages are added one by one while the penalised likelihood rises."""
    totals = segments.sum(axis=0)
    chosen, share = [int(np.argmax(totals))], np.ones(1)
    likelihood, cost = float(totals[chosen[0]]), penalty * 0.5 * np.log(max(2, len(segments)))
    # No mixture of any languages can exceed the best language of every segment.
    while len(chosen) < segments.shape[1] and float(segments.max(axis=1).sum()) - likelihood > cost:
        tries = [(*fit(segments, sizes, [*chosen, x]), x) for x in range(segments.shape[1]) if x not in chosen]
        better, new, lang = max(tries, key=lambda t: (t[0], -t[2]))
        if better - likelihood <= cost:
            break
        chosen, share, likelihood = [*chosen, lang], new, better
    return chosen, share


def likelihoods(found: list[str], table: np.ndarray):
    """For each text (log-likelihood of each of its segments in each language, trigrams of each segment); nothing for a text without
    a letter, or if nothing was learned."""
    slots, counts = trigrams(found)
    ends = np.cumsum(counts)
    # Segments of all these texts: a text's trigrams are cut evenly, so that none is tiny.
    pieces = np.maximum(1, counts // SEGMENT) * (counts > 0)
    borders = np.concatenate([e - n + np.arange(p, dtype=np.int64) * n // max(1, p) for e, n, p in zip(ends.tolist(), counts.tolist(), pieces.tolist())] or [np.empty(0, np.int64)])
    sizes = np.diff(np.append(borders, len(slots)))
    likes = np.add.reduceat(table[slots], borders, axis=0, dtype=np.float64) if len(borders) and table.shape[1] else np.zeros((0, table.shape[1]))
    at = 0
    for text, p in zip(found, pieces.tolist()):
        yield (likes[at : at + p], sizes[at : at + p]) if p and table.shape[1] and LETTER.search(text) else None
        at += p


def decided(langs: list[str], segments: np.ndarray, sizes: np.ndarray) -> tuple[str, float, list[tuple[str, float]]]:
    """(language with the largest share, score, mixture) of one text."""
    chosen, share = mixture(segments, sizes)
    best = max(range(len(chosen)), key=lambda i: (share[i], -chosen[i]))
    totals, n = segments.sum(axis=0), int(sizes.sum())
    if len(chosen) > 1:  # on the segments that it explains best
        totals = segments[segments[:, chosen].argmax(axis=1) == best].sum(axis=0)
    odds = (totals - totals[chosen[best]]) * min(1.0, 64 / max(1, n))
    sure = 1 / float(np.exp(np.minimum(odds, 0)).sum())
    return langs[chosen[best]], float(min(1.0, share[best] * sure)), [(langs[c], float(s)) for c, s in zip(chosen, share)]


NOTHING = (UNKNOWN, 0.0, [])
FOUND = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]


def _found(out: list[tuple]) -> list[pa.Array]:
    return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.map_(pa.string(), pa.float64()))]


def identify(df: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per input row: doc_id, `more`, lang_pred (the language with the largest share; the first by name of equals),
    score and mixture (language to share).

    A text that is null or has no letter is `und`, with score 0; so is every text if nothing was learned. The score is
    the share times the probability of the language against the others on at most 64 trigrams, so short or mixed texts
    score lower. Repeated rows and ids give a row each; an empty table gives no rows; texts are taken whole; only
    the text is looked at."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = texts(df, id_col, text_col, *more)
    schema = T.StructType([rows.schema.fields[0], *rows.schema.fields[2:], *FOUND])

    def run(batches):
        for batch in batches:
            out = [decided(langs, *x) if x else NOTHING for found in _some(batch.column(1).to_pylist()) for x in likelihoods(found, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), *_found(out)], schema.names)

    return rows.mapInArrow(run, schema)


def learn_and_identify(known: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column, lang_col: str = "lang", most: int = LANGS) -> DataFrame:
    """`identify` with all languages of `known`, however many there are. Up to `most` are one model. More are gone through in parts: each
    part finds its own mixture of each text, and the final mixture is chosen among the languages of all of these, of which
    one is the best single language; the score is against these. The rows are numbered and written then, and a part's pass
    writes, for each text, the likelihoods of its segments in the languages it found."""
    sums = counted_languages(known, lang_col, text_col)
    parts = parts_of(sums, most)
    if len(parts) < 2:
        langs = parts[0] if parts else []
        return identify(df, langs, model_of(sums, langs), id_col, text_col, *more)
    numbered = stash(texts(df, id_col, text_col, *more).select(F.monotonically_increasing_id().alias("row"), "*"), "numbered")
    tried = reduce(DataFrame.unionByName, [stash(_candidates(numbered, langs, model_of(sums, langs)), "candidates") for langs in parts])
    met = tried.groupBy("row").agg(F.collect_list(F.struct("langs", "likes", "sizes")).alias("tried"))
    kept = [f for f in numbered.schema.fields if f.name not in ("row", "text")]
    schema = T.StructType([*kept, *FOUND])

    def best(own) -> tuple:
        if not own:
            return NOTHING
        sizes = np.frombuffer(own[0]["sizes"], np.int64)
        names = [x for part in own for x in part["langs"]]
        columns = np.concatenate([np.frombuffer(part["likes"]).reshape(len(sizes), -1) for part in own], axis=1)
        order = sorted(range(len(names)), key=names.__getitem__)
        return decided([names[i] for i in order], columns[:, order], sizes)

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *_found([best(own) for own in batch.column(len(kept)).to_pylist()])], schema.names)

    whole = numbered.drop("text").join(met.hint("shuffle_merge"), "row", "left")
    return whole.select(*(f.name for f in kept), "tried").mapInArrow(run, schema)


def _candidates(numbered: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(row, langs, likes, sizes): the mixture of each text in one part of the languages, with the log-likelihoods of its segments; no
    row for a text without a letter."""
    shared = numbered.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows, out = iter(batch.column(0).to_pylist()), []
            for found in _some(batch.column(1).to_pylist()):
                for x in likelihoods(found, shared.value):
                    row = next(rows)
                    if x:
                        chosen = mixture(*x)[0]
                        out.append((row, [langs[c] for c in chosen], x[0][:, chosen].tobytes(), x[1].astype(np.int64).tobytes()))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "langs", "likes", "sizes"])

    return numbered.select("row", "text").mapInArrow(run, "row long, langs array<string>, likes binary, sizes binary")
