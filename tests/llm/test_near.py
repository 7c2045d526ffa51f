"""op7, op9: against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stringloom.llm import decontam, simhash

WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bits": F.lit(1), "key": F.lit("x"), "item_id": F.lit(0)})


def slow_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    own = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in own]
    if len(hashes) > 10_000:
        bits = sum(np.array([[h >> k & 1 for k in range(64)] for h in hashes[i : i + 10_000]]).sum(axis=0) for i in range(0, len(hashes), 10_000))
        return sum(1 << k for k in range(64) if int(bits[k]) * 2 > len(hashes))
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def components(prints, bits=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO")]
    for i in range(30):
        base = [rng.choice(WORDS) for _ in range(150)]
        for j in range(3):
            own = list(base)
            for _ in range(j):
                own[rng.randrange(150)] = "changed"
            rows.append((10 * i + j + 10, " ".join(own)))
    rows += [(900, " ".join(rng.choice(WORDS) for _ in range(simhash.COUNT_ROWS + 5000))), (901, "x" * 300_000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = [slow_print(t or "") for _, t in rows]
    expected = {rows[i][0]: (f"{prints[i]:016x}", rows[r][0]) for i, r in enumerate(components(prints))}
    assert got == expected
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")])).where("component_id = 7").count() == 3


@pytest.mark.parametrize(("large", "larger"), [(simhash.LARGE, simhash.LARGER), (12, 1000), (50, 40)])
def test_links_of_dense_groups(spark, large, larger):
    """Many fingerprints around one, a chain, and random ones: the components are those of all pairs, also where groups are
    dealt out by second and further keys."""
    rng = random.Random(6)
    center, prints = rng.getrandbits(64), set()
    for _ in range(150):
        p = center
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    p = rng.getrandbits(64)
    for _ in range(40):
        for _ in range(4):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    roots = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "bits long"), large=large, larger=larger)).collect()
    where = {r.node: r.root for r in roots}
    groups: dict = {}
    for x, r in zip(signed, components(prints)):
        groups.setdefault(r, set()).add(where.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_runs_over_batches(rows):
    """Runs are whole however the rows are cut into batches; those beyond `large` come alone and lose no row."""
    keys = np.repeat(np.arange(9), [1, 5, 2, 30, 1, 6, 17, 3, 12]).astype(np.int64)
    prints = np.arange(len(keys), dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows]), pa.array(prints[i : i + rows]), pa.array([7 if k == 6 else -1 for k in keys[i : i + rows]], pa.int64())], ["key", "bits", "free"]) for i in range(0, len(keys), rows)]
    seen, crowded = [], set()
    for k, p, own, free in simhash._runs([batches[0].slice(0, 0), *batches], 10):
        assert free == -1 or not own
        seen += p.tolist()
        crowded |= set(k.tolist()) if own else set()
        assert own or all((keys == x).sum() == (k == x).sum() and (x == 6 or (k == x).sum() <= 10) for x in set(k.tolist()))
    # Run 6 has too few free bits to be dealt out again.
    assert sorted(seen) == prints.tolist() and crowded == {3, 8}


def test_further_keys_part_no_link():
    """Two fingerprints that differ in few of the free bits share a further key, whatever is free; what is left free shrinks."""
    rng = random.Random(2)
    for _ in range(300):
        free = rng.getrandbits(64) | rng.getrandbits(64)
        places = [i for i in range(64) if free >> i & 1]
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(places, rng.randint(0, 4)):
            b ^= 1 << i
        pair, key = np.array([a, b], np.uint64), np.array([5, 5])
        met = [rest for keys, rest in simhash.further_keys(pair, key, free, 4) if keys[0] == keys[1]]
        assert met and all(x & free == x and x != free for x in met)


@pytest.mark.parametrize("size", [5, 40, 400])
def test_forest(size):
    rng = np.random.default_rng(size)
    center = rng.integers(0, 1 << 62, dtype=np.uint64)
    prints = np.unique(center ^ (np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)))
    a, b = simhash.forest(prints, 2)
    assert len(a) < len(prints) and all(np.bitwise_count(a ^ b) <= 2)
    assert len(set(components([int(x) for x in prints], 2))) == len(prints) - len(a)


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    wanted = prints[rng.integers(0, 50, 300)]
    for _ in range(12):
        wanted ^= np.where(rng.random(300) < 0.8, np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64), np.uint64(0))
    got = set(zip(*(x.tolist() for x in decontam.Index(prints).search(wanted))))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(wanted[:, None] ^ prints[None, :]) <= decontam.RADIUS))))


def test_window_prints():
    """Windows of 4, 8 and 1 words against bits that are counted one by one."""
    words = [b"w%d" % (i * i % 17) for i in range(40)]
    pairs = decontam.grams(words, decontam.Hashes())
    assert decontam.window_prints(pairs, {1: 1})[1].tolist() == [decontam.window_prints(decontam.grams([w], decontam.Hashes()), {1: 1})[1][0] for w in words]
    for size, every in ((8, 2), (4, 1), (2, 1), (32, 8)):
        got = decontam.window_prints(pairs, {size: every, 2: 1})[size].tolist()
        for k, p in enumerate(got):
            own = [int(x) for x in pairs[1][k * every : k * every + size - 1]]
            assert p == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in own) * 2 > len(own))
        assert len(got) == (40 - size) // every + 1


def test_contamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(15, 60)))) for i in range(30)] + [(90, "short item"), (91, None), (92, "...")]
    filler = lambda n: [f"f{rng.randrange(300)}" for _ in range(n)]
    rows, expected = [(1, None), (2, ""), (3, " ".join(filler(3000)))], set()
    for i, text in items[:30]:
        own = text.split()
        rows.append((100 + i, " ".join([*filler(rng.randint(0, 90)), text.upper().replace(" ", ", "), *filler(rng.randint(0, 90))])))
        expected.add((100 + i, i))
        if len(own) >= 55:  # one word within changed: similar still
            changed = [*own[: len(own) // 2], "other", *own[len(own) // 2 + 1 :]]
            rows.append((200 + i, " ".join([*filler(40), *changed, *filler(40)])))
            expected.add((200 + i, i))
        rows.append((400 + i, " ".join([*filler(30), *own[: -(len(own) // 10)], *filler(30)])))  # most of it is
        expected.add((400 + i, i))
        rows.append((300 + i, " ".join([*filler(40), *own[: len(own) // 2], *filler(40)])))  # half of it is no copy
    rows += [(600, "a Short, item!"), (100, next(t for d, t in rows if d == 100)), (601, " ".join([*filler(50), "Supercalifragilistic!", *filler(50)]))]
    items.append((93, "supercalifragilistic"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontam.PASS_WORDS, 300):
        found = decontam.contaminated(frame(spark, rows), bench, pass_words=words).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected | {(600, 90), (601, 93)}
        assert all(r.similarity >= 0.8 for r in found) and len(found) == len(expected) + 3
    clean = decontam.decontaminate(frame(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in expected} - {600, 601}
    assert clean.columns == frame(spark, rows).columns
    assert decontam.contaminated(frame(spark, []), bench).count() == 0 and decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_near_copies_of_repeated_items(spark):
    """The similarity is the same whether items that share shingles fall into one pass or into several, and whether an item
    stands in the benchmark once or twice."""
    own = [f"q{i}" for i in range(60)]
    other = [*own[:20], *[f"r{i}" for i in range(40)]]
    copy = " ".join([*own[:30], "changed", *own[31:]])
    found = []
    for items, words in (((own, own, other), 10_000), ((own, own, other), 1), ((own, other), 10_000)):
        bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
        got = decontam.contaminated(frame(spark, [(1, copy)]), bench, pass_words=words).collect()
        assert {r.item_id for r in got} == set(range(len(items) - 1))
        assert decontam.decontaminate(frame(spark, [(1, copy)]), bench, pass_words=words).count() == 0
        found.append({round(r.similarity, 9) for r in got})
    assert found[0] == found[1] == found[2] == {round((16 / 2 + 35) / (16 / 2 + 35 + 10), 9)}


def test_passages_against_all_windows():
    """All windows of an item's size in all documents are compared by shingles: at least nine of ten items that some window
    resembles are found, in texts longer than a part too, and nothing else is."""
    rng = random.Random(12)
    items = [[rng.choice(WORDS) for _ in range(rng.randint(12, 60))] for _ in range(60)]
    docs = []
    for i, own in enumerate(items):
        for edits in (0, 1, 2):
            copy = list(own)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            copy = copy[rng.randint(0, 2) :]
            docs.append([rng.choice(WORDS) for _ in range(rng.randint(0, 60))] + copy + [rng.choice(WORDS) for _ in range(rng.randint(0, 60))])
    docs.append([rng.choice(WORDS) for _ in range(decontam.PART_WORDS - 10)] + items[0] + items[1] + [rng.choice(WORDS) for _ in range(100)])
    docs.append(items[2] + ["between"] * 3 + items[2])  # a tie: the first counts
    bench = decontam.Benchmark([(i, " ".join(w), []) for i, w in enumerate(items)])
    bytes_of = [[w.encode() for w in x] for x in docs]
    found = decontam.passages(bytes_of, bench, decontam.Hashes())
    wanted = set()
    for d, words in enumerate(bytes_of):
        for k, (_, own) in enumerate(bench.items):
            bag, n = bench.bags[k], len(own)
            starts = {p + q for p in range(len(words) - 4) if b" ".join(words[p : p + 5]) in bag for q in range(-n, 1)}
            if any(decontam.similarity(bag, decontam.shingles(words[a : a + n]), {}) >= 0.8 for a in starts if 0 <= a <= len(words) - n):
                wanted.add((d, k))
    got = {(d, k) for d, x in enumerate(found) for k in x}
    assert len(got & wanted) >= 0.9 * len(wanted) and len(wanted) > 60
    assert all(decontam.similarity(bench.bags[k], decontam.shingles(bytes_of[d][a:b]), {}) == s >= 0.8 for d, x in enumerate(found) for k, (s, a, b) in x.items())
    assert {(len(docs) - 2, 0), (len(docs) - 2, 1)} <= got and found[-1][2][1] == 0
