"""op2: base kinds against the plain patterns, disclosure on a small corpus."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from stringloom.llm import pii


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text: str) -> list[tuple]:
    out = []
    for k, (kind, (pattern, _)) in enumerate(pii.PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, m.start(), m.end(), m[0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "row": F.lit("x"), "spans": F.lit(0)})


def test_base_spans(spark):
    rng = random.Random(4)
    parts = ["a@b.cd", "x_y%@e.f-g.h", "@", ".", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (386) 555-3733", "+12", " ", "é😀", "\n", "5", "12", "word", "_", "-", "+"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 50_000), (1003, "a@" + "b." * 20_000 + "c"), (1004, "1" * 30_000), (1005, "+" + "1 " * 20_000), (1006, "a@b.cd_x@e.fg 1.2.3.4.5.6.7.8"), (1006, "a@b.cd_x@e.fg 1.2.3.4.5.6.7.8"), (None, "a@b.cd")]
    got = pii.find(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), [tuple(x) for x in r.base]) for r in got) == sorted((str(i), plain(t or "")) for i, t in rows)
    assert all([tuple(x) for x in r.base] == [tuple(x) for x in r.spans if x.kind < 4] for r in got)
    assert pii.find(frame(spark, [])).count() == 0


def test_written(spark):
    (r,) = frame(spark, [(1, "1.2.3.4 a@b.cd")]).select(pii.written(pii.base_spans(F.col("text"))).alias("w")).collect()
    assert r.w == "email:8:14,ip:0:7" and len(hashlib.sha256(r.w.encode()).hexdigest()) == 64


def test_disclosure(spark):
    """A term that stands only by one address, in different contexts, gives it away; frequent words do not, and copies of
    one context are one."""
    rows = [(i, f"common text number {i} common") for i in range(200)]
    rows += [(300 + i, f"common {w} zanzibar contact me@here.org common") for i, w in enumerate(("alpha", "beta", "gamma"))]
    rows += [(400 + i, "common quixotic you@there.org common") for i in range(20)]
    got = {r.doc_id: [(pii.KINDS[x.kind], x.start, x.end) for x in r.spans if x.kind > 3] for r in pii.find(frame(spark, rows)).collect()}
    text = rows[200][1]
    at = text.index("zanzibar")
    assert ("remove", at, at + 8) in got[300] and all(text[a:b] != "common" for _, a, b in got[300])
    assert got[400] == [] and got[0] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "zanzibar" not in clean[300] and "[EMAIL]" in clean[300] and clean[0] == rows[0][1] and clean[400] == "common quixotic [EMAIL] common"


def test_disclosure_in_the_whole_text(spark):
    """A term far from the value goes wherever it stands; a word that a window would cut is no term of its own."""
    far = "common words " * 30
    rows = [(i, f"common words number {i}") for i in range(200)]
    rows += [(300 + i, f"Zanzibar {w} {far} me@here.org {far} zanzibar. common zanzibars") for i, w in enumerate(("alpha", "beta"))]
    rows += [(400, f"unprecedented {'x ' * 25}you@there.org"), (401, f"unprecedented {'x ' * 24}y you@there.org")] + [(500 + i, f"unprecedented number {i}") for i in range(100)]
    text = dict(rows)
    got = {r.doc_id: [(pii.KINDS[x.kind], text[r.doc_id][x.start : x.end]) for x in r.spans if x.kind > 3] for r in pii.find(frame(spark, rows)).collect()}
    assert got[300].count(("remove", "Zanzibar")) == got[300].count(("remove", "zanzibar")) == 1 and "common" not in {x for _, x in got[300]}
    assert got[400] == got[401] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "zanzibar." not in clean[301].lower() and not clean[301].startswith("Zanzibar") and "alpha" in clean[300]


def test_hot_value_and_a_page_of_addresses(spark, monkeypatch):
    """One address in thousands of texts, and a page with thousands of addresses: values are counted with their terms, by task
    first, before anything is partitioned by value."""
    plans, real = {}, pii.stash
    monkeypatch.setattr(pii, "stash", lambda df, name="table": (plans.setdefault(name, df._jdf.queryExecution().toString()), real(df, name))[1])
    rows = [(i, f"help {'zanzibar' if i % 3 == 0 else 'other'} number {i} mail support@big.org common") for i in range(4000)]
    rows += [(10_000, " ".join(f"n{i}@page.org term{i}" for i in range(3000)) + " rare")]
    rows += [(20_000 + i, f"common text {i}") for i in range(60_000)]
    got = {r.doc_id: [(pii.KINDS[x.kind], x.start, x.end) for x in r.spans if x.kind > 3] for r in pii.find(frame(spark, rows)).collect()}
    at = rows[0][1].index("zanzibar")
    assert ("remove", at, at + 8) in got[0] and got[10_000] == [] and got[20_000] == []
    joint = plans["joint"].split("== Physical Plan ==")[1]
    assert joint.index("Exchange hashpartitioning(value") < joint.index("partial_sum") and "Join" not in joint


def test_recall_of_planted_terms(spark):
    """Terms that stand only by one address are found, those that stand everywhere are not."""
    rng = random.Random(3)
    common = [f"word{i}" for i in range(300)]
    words = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows, planted, n = [], [], 0
    for k in range(60):
        for _ in range(rng.randint(2, 6)):
            rows.append((n, f"{words(40)} planted{chr(97 + k % 26)}{chr(97 + k // 26)} {words(20)} user{k}@mail{k}.org {words(30)}"))
            planted.append(n)
            n += 1
    rows += [(n + i, words(60)) for i in range(3000)]
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][x.start : x.end] for x in r.spans if x.kind > 3] for r in pii.find(frame(spark, rows)).collect()}
    found = sum(any(x.startswith("planted") for x in got[i]) for i in planted)
    assert found >= 0.9 * len(planted)
    assert sum(x.startswith("word") for xs in got.values() for x in xs) == 0
