"""op1, op3, op4: against the libraries and brute force."""

import base64
import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stringloom.llm import bpe_codec, exact_dedup, token_count

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts() -> list[tuple]:
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "héllo wörld 😀😀 naïve <|endoftext|>x<|endoftext|>"), (4, "a　b ꟎ ᠎  "), (4, "x" * 5000 + " don't'll 12345  \n\n x"), (None, "\0 12"), (7, "日本語 text ẞ՘"), (7, "日本語 text ẞ՘")]
    return rows + [(100 + i, "".join(rng.choice(["a", "b", " ", "\n", "é", "😀", "ab", "1", "'s", "<|endoftext|>"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]


def frame(spark, rows=None):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "ids": F.lit("x"), "row": F.lit(2)})


def test_vocabularies_are_one():
    """The ids of the .json file, through the byte table, are the ranks of the .tiktoken file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tokenizer = bpe_codec.load(JSON)
    special = {x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()}
    assert {t: i for i, t in enumerate(bpe_codec.token_bytes(tokenizer)) if t not in special} == ranks


@pytest.mark.parametrize("pattern", [None, public_tokenizers.PATTERN])
def test_codec(spark, pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe_codec.encode(frame(spark), JSON, pattern=pattern)
    whole = bpe_codec.decode(found.withColumn("packed", F.col("ids")), JSON, "packed").collect()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in whole), key=str)
    expected = []
    for i, t in texts():
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), (t or "").encode()))
    assert got == sorted(expected, key=str)
    once = bpe_codec.encode(frame(spark), JSON, decoded=True, pattern=pattern).collect()
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in once), key=str) == sorted(expected, key=str)


def test_offsets(spark):
    (r,) = bpe_codec.encode(frame(spark, [(1, "é😀a")]), JSON, offsets=True).collect()
    assert list(zip(r.starts, r.ends))[0] == (0, 1) and list(zip(r.starts, r.ends))[-1] == (2, 3) and r.n_split >= 2
    pieces = ["é".encode()[:1], "é".encode()[1:], b"a", b"\xff"]
    assert bpe_codec.decode_text(pieces) == ["", "é", "a", "�"]


@pytest.mark.parametrize("held", [token_count.HELD, 3])
def test_counts(spark, held):
    library = token_count.load(JSON)
    got = sorted(map(tuple, token_count.count_tokens(frame(spark), JSON, public_tokenizers.PATTERN, held=held).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()], key=str)


def test_duplicates(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 9, 9, 30, 70])))) for i in range(120)]
    rows = [(rng.randint(0, 150), t) for _, t in rows + rows[:60]] + [(None, "ab"), (5, None)]
    normal = lambda t: (t or "").encode().translate(None, b" \t\n\r\x0b\x0c")
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0, i))
    expected = []
    for k, own in groups.items():
        own.sort(key=lambda x: x[:3])
        expected += [(x[3], own[0][3], len(own), n == 0, hashlib.sha256(k).hexdigest()) for n, x in enumerate(own)]
    for block, chunk in ((4, 50), (exact_dedup.BLOCK, exact_dedup.CHUNK_BYTES)):
        assert sorted(map(tuple, exact_dedup.duplicates(frame(spark, rows), block=block, chunk_bytes=chunk).collect()), key=str) == sorted(expected, key=str)


def test_long_and_many_texts(spark):
    """Texts of many blocks that differ in one place, with the production block; more equal rows than a chunk holds."""
    long = "".join(chr(97 + i * i % 26) for i in range(30_000))
    rows = [(1, long), (2, long[:20_000] + "!" + long[20_001:]), (3, long[:15_000] + " \n" + long[15_000:]), (4, long[:4096])] + [(10 + i, "copy") for i in range(400)] + [(None, None)] * 300
    got = exact_dedup.duplicates(frame(spark, rows).repartition(3), chunk_rows=100).collect()
    assert len(got) == len(rows) and sorted(r.doc_id for r in got if r.kept and r.doc_id) == [2, 3, 4, 10] and sum(r.kept for r in got) == 5
    assert {r.group_size for r in got if r.doc_id is None} == {300} and {(r.keep_id, r.group_size) for r in got if (r.doc_id or 0) >= 10} == {(10, 400)}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe_codec.encode(none, JSON).count() == 0 and bpe_codec.decode(bpe_codec.encode(none, JSON), JSON).count() == 0 and exact_dedup.duplicates(none).count() == 0
    assert token_count.count_tokens(none, JSON, public_tokenizers.PATTERN).count() == 0
