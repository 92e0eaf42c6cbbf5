"""Encoding of whole texts with a public byte-level BPE vocabulary.

The vocabulary (a file of base64 tokens with ranks) is turned, without any training, into a sentencepiece BPE model: each
token's bytes are written as one character per byte, its score is its negative rank, normalisation is the identity. Text
is cut into pre-tokens by the vocabulary's published pattern, the distinct new pre-tokens of an Arrow batch go through
the model at once, and a bounded memo in each Python worker keeps their ids as packed integers, so that a document's ids
are one join of byte strings. Decoding maps ids back to bytes.

Only the serialised model (about 1 MB) is broadcast. Every document is encoded where it is read: no shuffle.

Defined results: a null and an empty text both give an empty list; the string of a special token is ordinary text; white
space is kept as it is; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are; a parameter of every function that reads them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern published with the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for the standard library's faster engine; it differs only on the characters of `_SPECIAL`.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Pre-tokens that one Python worker remembers.
MEMO = 200_000
_FIRST = 0x100  # the character that stands for byte 0


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The tokens' bytes, in the order of their ids."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ids have gaps")
    return [t for _, t in ranked]


def _as_characters(data: bytes) -> str:
    return "".join(chr(_FIRST + b) for b in data)


def _varint(value: int) -> bytes:
    out, value = b"", value & (1 << 64) - 1
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialised_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece model file (protocol buffer) whose ids are the vocabulary's; the id after the last is unknown."""
    n = len(vocabulary)
    pieces = [(_as_characters(t), -float(rank), 1) for rank, t in enumerate(vocabulary)] + [("<unk>", 0.0, 2)]
    body = b"".join(_block(1, _block(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)) for p, score, kind in pieces)
    trainer = _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _block(2, trainer) + _block(3, normalizer)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Finds the characters on which the engines differ; and the pattern for texts that have one."""
    import regex

    # Characters beyond 16 bits are all taken as special: a set without them is tested in constant time.
    special = [chr(c) for c in range(0x1C, 0x20)] + [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No")]
    return re.compile("[" + "".join(map(re.escape, special)) + "]|[\U00010000-\U0010ffff]"), regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    """The text cut by the pattern; joined they give the text again."""
    special, slow = _patterns()
    return slow.findall(text) if special.search(text) else _FAST.findall(text)


class Encoder:
    """One worker's encoder: the model and a memo of pre-token -> packed ids."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.memo: dict[str, bytes] = {}

    def packed(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        cut = [pre_tokens(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [t for t in set().union(*cut) if t not in self.memo]
        encoded = self.model.encode([_as_characters(t.encode()) for t in new], out_type=int, num_threads=1)
        self.memo.update((t, np.array(ids, "<i4").tobytes()) for t, ids in zip(new, encoded, strict=True))
        at = self.memo.__getitem__
        return [b"".join(map(at, tokens)) for tokens in cut]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """This process's encoder for a model; it lives as long as the Python worker."""
    key = blake2b(model, digest_size=16).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _chunks(column: pa.Array, characters: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts): runs of rows of bounded total length, a longer text by itself."""
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        if held and size + len(text or "") > characters:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    model = documents.sparkSession.sparkContext.broadcast(serialised_model(read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                packed = enc.packed(texts)
                offsets = np.zeros(len(packed) + 1, "<i4")
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(packed)), ids], names=[doc_id, "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens bigint) for every row, without building the ids."""
    model = documents.sparkSession.sparkContext.broadcast(serialised_model(read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                sizes = pa.array([len(p) // 4 for p in enc.packed(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sizes)), sizes], names=[doc_id, "n_tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from ids; bytes that are no UTF-8 become the replacement character. A null list gives null."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        for batch in batches:
            texts = [None if v is None else b"".join([known[i] for i in v]).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(doc_id, F.col(ids)).mapInArrow(run, f"`{doc_id}` {kind}, text string")


def round_trip(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens int, same): whether a text's ids decode to it again, in one pass without a shuffle. A null text counts as empty."""
    tokens = read_vocabulary(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast((serialised_model(tokens), tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        enc = encoder(model)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                packed = enc.packed(texts)
                same = [b"".join([known[i] for i in memoryview(p).cast("i")]) == (t or "").encode() for p, t in zip(packed, texts, strict=True)]
                columns = [batch.column(0).slice(start, len(packed)), pa.array([len(p) // 4 for p in packed], pa.int32()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_tokens", "same"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens int, same boolean")
