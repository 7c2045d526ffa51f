"""Vector codes, packing and the filter audit against plain loops, on odd rows too."""

import math
import random
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stringloom.llm import filter_audit, packing, vector_codes
from stringloom.llm.token_count import load

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in kept:
                own.setdefault(near(v, p), []).append(cut(v, p))
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    return sorted(("".join(f"{near(v, p):02x}" for p in range(parts)), sum(far(cut(v, p), books[p][near(v, p)]) for p in range(parts))) for _, v in kept)


@pytest.mark.parametrize("n, spread", [(700, 1.0), (5, 1.0), (300, 0.002), (1, 0.5)])
def test_vector_codes_equal_plain_rounds(spark, n, spread):
    """Many rows, fewer than entries, many ties, one row."""
    rng = random.Random(n)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * spread for _ in range(16)], i % 3 or None) for i in range(n)]
    found = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()
    floats = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v, _ in rows]
    assert sorted((r.code, r.error) for r in found) == plain_codes(floats)
    by_label = {}
    for r in found:
        by_label[r.vec_id % 3] = by_label.get(r.vec_id % 3, 0) + r.error
    assert all(r.label_error == by_label[r.vec_id % 3] for r in found)


def test_vector_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i), -1.0, 0.5, 0.25] * 4, 1, "x") for i in range(40)]
    odd = [(100, None, 1, "x"), (101, [1.0, None] * 8, 1, "x"), (102, [inf] * 16, 1, "x"), (103, [nan] * 16, 1, "x"), (None, good[3][1], None, "x"), (7, good[7][1], 1, "x"), (104, [1.0], 1, "x"), (105, [1e30] * 16, None, "x")]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, label int, id string")
    rows = vector_codes.compress(df).collect()
    found = {(r.vec_id, r.code is None) for r in rows}
    assert len(rows) == 44 and {i for i, none in found if none} == {104, 105}
    assert len({r.codebooks_sha256 for r in rows}) == 1
    assert sum(r.vec_id == 7 for r in rows) == 2
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.where("vec_id = 100")).collect() == []


def test_trees_assign_as_brute_force():
    """Whatever the number of entries, their order and ties, all points get the first of the nearest entries."""
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (200, 3), (513, 16), (64, 7)):
        points, values = rng.integers(-6, 6, (n * 4, 3)), rng.integers(-6, 6, (4, k, 3))
        tree = vector_codes.unpacked(vector_codes.packed(vector_codes.grow(points, 4, 16)), 4)
        labels, counts, sums = vector_codes.Dual(values)(tree, points)
        part = np.repeat(np.arange(4), n)
        expected = ((points[:, None] - values[part]) ** 2).sum(axis=2).argmin(axis=1)
        assert (labels == expected).all()
        for p in range(4):
            for e in range(k):
                own = points[(part == p) & (expected == e)]
                assert counts[p, e] == len(own) and (sums[p, e] == own.sum(axis=0)).all()


def test_ids_are_those_of_the_tokenizers_library():
    ids, library = packing.Ids(VOCABULARY, RANKS, public_tokenizers.PATTERN), load(VOCABULARY)
    for text in ("", "a<|endoftext|>b <|endoftext|>", "Größe 12 ½  x", "ꙁԧ neu", "😀 中文 текст ก", " " * 9000 + "y", "x" * 20000, "it's\t\n\n  we'll"):
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_bounds_hold_and_best_fit_fits():
    rng = random.Random(3)
    for size in (10, 17, 30):
        for _ in range(60):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
            which, place = packing.best_fit(lengths, size)
            for b in set(which):
                own = sorted((place[i], lengths[i]) for i in range(len(lengths)) if which[i] == b)
                assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= size
            fewest = fewest_bins(lengths, size)
            bound = packing.lower_bound(np.bincount(lengths, minlength=size + 1), size)
            assert bound <= fewest <= max(which) + 1


def fewest_bins(lengths, size):
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in set(gaps):
            if g >= lengths[i]:
                rest = list(gaps)
                rest.remove(g)
                place(i + 1, [*rest, g - lengths[i]])
        place(i + 1, [*gaps, size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def check_packed(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= size
    return len(by_sequence)


def test_packing_meets_its_bound_by_exchange(spark):
    """Small groups leave gaps that only an exchange closes."""
    rng = random.Random(9)
    lengths = [min(100, int(rng.expovariate(1 / 25)) + 1) for _ in range(3000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(5)
    rows = packing.pack(items, size=100, group=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    needed = check_packed(rows, 100)
    alone = check_packed(packing.pack(items, size=100, group=100, rounds=1).collect(), 100)
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= needed <= bound + 2 < alone


def test_packing_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, None, 5), (1, None, 5), ((1 << 62) + 1, "c", 0), (2, "", 0), (None, "a b", 1), (3, long, 2), (4, "x" * 70000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    found = packing.pack_documents(df, VOCABULARY, RANKS, public_tokenizers.PATTERN).collect()
    assert check_packed(found, 2048) == -(-sum(r.length for r in found) // 2048)
    ids = load(VOCABULARY)
    for doc_id, text in ((3, long), (4, "x" * 70000), (2, ""), (None, "a b")):
        whole = [*ids.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(whole)
        assert all(r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    assert sum(r.doc_id == 1 for r in found) == 2 and sum(r.doc_id == (1 << 62) + 1 for r in found) == 1
    assert packing.pack_documents(df.limit(0), VOCABULARY, RANKS, public_tokenizers.PATTERN).collect() == []


def plain_audit(docs, labels):
    import re

    facts = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        first = min((i for i, x, _ in docs if (x or "") == t and i is not None), default=None)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and first < doc_id,
        }
        facts.append((lang or "", {f for f in fails if fails[f]}, any(i == doc_id and q == 1 for i, q, _ in labels), any(i == doc_id and x == 1 for i, _, x in labels)))
    out = {}
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in facts if f[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                every = [x for x in facts if x[0] == part and f in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(every) - len(gone), sum(len(x[1]) == 1 for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    for (part, order, k), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[k - 1]))
    return out


def test_audit_equals_plain_counts(spark):
    """Copies in several parts and under repeated and missing ids, all filters, nulls, repeated labels."""
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Wort", "UND", "a%b", "c|d", *map(str, range(90))]) for _ in range(rng.choice([0, 5, 99, 100, 160]))) for _ in range(25)]
    base += ["", "\x0b\x0c\t ", "É" * 9 + "A", " ".join(f"w{i}" for i in range(120)), None]
    docs = [(rng.choice([None, *range(40)]), rng.choice(base), rng.choice(["en", "", None, "fr"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(50)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, part string").repartition(3)
    said = spark.createDataFrame([(*x, "x") for x in labels if x[0] is not None], "doc_id long, quality int, toxic int, mask string")
    found = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(df, said).collect()}
    assert found == plain_audit(docs, [x for x in labels if x[0] is not None])
    assert filter_audit.audit(df.limit(0), said).collect() == []
    only = filter_audit.audit(df.where(F.col("lang") == "fr"), said.limit(0)).collect()
    assert len(only) == 600 and {r.good_lost for r in only} == {0}
