"""Byte-level BPE: text to ids and back, over Arrow batches."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import texts

#: Characters that one call of the tokenizer gets; what it returns takes many times their memory.
CALL_BYTES = 1 << 17

#: Pre-tokens whose ids a task holds at once.
HELD = 1 << 17

#: Characters from U+0250 on: those below have had their class since long ago.
BEYOND = regex.compile("[^\\x00-\u024f]")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(vocabulary: str):
    """The tokenizer of a .json file; special strings inside texts are ordinary text. One thread: Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, through the reversed byte table."""
    back, vocabulary = byte_characters(), tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


class Encoder:
    """Encodes texts with the tokenizer of a .json file. If the pattern by which it splits text is given, each distinct
    pre-token goes to the library once and its ids are held, up to HELD of them; the result is the same. Texts with
    characters that another Unicode version can class otherwise always go to the library whole."""

    def __init__(self, vocabulary: str, pattern: str | None = None):
        self.tokenizer = load(vocabulary)
        self.pattern = regex.compile(pattern) if pattern else None
        self.held: dict[str, bytes] = {}

    def library(self, found: list[str]) -> list[bytes]:
        """Ids of each text, in calls of about CALL_BYTES; a longer text goes alone and whole."""
        out, part, size = [], [], 0
        for text in [*found, None]:
            if part and (text is None or size + len(text) > CALL_BYTES):
                out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return out

    def __call__(self, found: list[str]) -> list[bytes]:
        split = [i for i, x in enumerate(found) if self.pattern and (x.isascii() or not BEYOND.search(x))]
        out: list[bytes] = [b""] * len(found)
        rest = sorted(set(range(len(found))) - set(split))
        for i, ids in zip(rest, self.library([found[i] for i in rest])):
            out[i] = ids
        held = self.held
        for i in split:
            pieces = self.pattern.findall(found[i])
            new = list(set(pieces).difference(held))
            if new:
                held.update(zip(new, self.library(new)))
            out[i] = b"".join(map(held.__getitem__, pieces))
            if len(held) > HELD:
                held.clear()
        return out


def spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets [start, end) of tokens of these byte lengths. A token that begins or ends inside a character
    covers that whole character, so the tokens of a split character overlap on it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    character = np.concatenate((np.cumsum((raw & 0xC0) != 0x80) - 1, [-1]))
    return character[starts], character[np.maximum(ends - 1, 0)] + (lengths > 0)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False, pattern: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers in one binary value), n_split
    (tokens that hold only a part of some character) and, if asked for, the character offsets `starts` and `ends`, and
    `decoded`, the bytes that the ids decode to, by the same Python worker.
    `pattern`, if given, must be the one by which the tokenizer splits text; see Encoder.

    Null or empty text gives no tokens. Repeated rows and ids give a row each; a null id stays null; other columns are
    not carried. A text of any length is encoded whole."""
    schema = "doc_id long, n_tokens long, ids binary, n_split long" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded
    id_type = df.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), *T._parse_datatype_string(schema).fields[1:]]

    def run(batches):
        encoder = Encoder(vocabulary, pattern)
        table = token_bytes(encoder.tokenizer)
        lengths = np.array([len(x) for x in table], np.int64)
        for batch in batches:
            ids, found, counts, split, first, last = batch.column(0), batch.column(1).to_pylist(), [], [], [], []
            packed = encoder(found)
            for text, raw in zip(found, packed):
                own = np.frombuffer(raw, "<u4")
                counts.append(len(own))
                partly = np.zeros(len(own), bool)
                if offsets or not text.isascii():
                    a, b = spans(text, lengths[own])
                    if len(own):
                        shared = a[1:] < b[:-1]
                        partly[1:] |= shared
                        partly[:-1] |= shared
                    if offsets:
                        first.append(a.astype(np.int32))
                        last.append(b.astype(np.int32))
                split.append(int(partly.sum()))
            columns = [ids, pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(split, pa.int64())]
            if offsets:
                columns += [pa.array(x, pa.list_(pa.int32())) for x in (first, last)]
            if decoded:
                columns.append(pa.array([joined(raw, table) for raw in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return texts(df, id_col, text_col).mapInArrow(run, T.StructType(fields))


def joined(raw: bytes | None, table: list[bytes]) -> bytes:
    """The bytes of packed ids; those of a character that is split over tokens come together again."""
    return b"".join(map(table.__getitem__, np.frombuffer(raw or b"", "<u4").tolist()))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns of `df` but `ids_col`, then `decoded`, the bytes of the tokens in order. A character that is split over
    tokens is whole again as its bytes are joined. Null ids decode to no bytes; an id outside the vocabulary is an error."""
    kept = [f for f in df.schema.fields if f.name not in (ids_col, "decoded")]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = token_bytes(load(vocabulary))
        for batch in batches:
            out = [joined(raw, table) for raw in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.binary())], schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(ids_col)).mapInArrow(run, schema)


def decode_text(pieces: list[bytes]) -> list[str]:
    """The text that each token adds; the parts of a split character are held back until it is complete, and bytes that
    are no UTF-8 become U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(x) for x in pieces]
    if rest := decoder.decode(b"", True):
        out.append(rest)
    return out
