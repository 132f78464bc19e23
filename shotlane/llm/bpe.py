"""Byte-level BPE encoding and decoding through a sentencepiece model written straight from a rank file.

Each byte is mapped to one printable character, each token of the vocabulary to a
piece of such characters, scored by its negative rank; normalisation is the
identity.  The merge order of that model is the order of the ranks, so encoding a
pre-token gives the ids of the rank file (ids are ranks).  Decoding maps ids back to bytes.

Nothing is trained: the model is a serialisation of the vocabulary file, whose path is a parameter.
Its bytes (about a megabyte, fixed by the vocabulary) go to the tasks; each task loads it once.

Defined cases: null and empty texts have no tokens; a pre-token of any length is
encoded whole; equal rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from shotlane.llm.common import map_text, set_aside, without

#: Pre-tokens kept ready per task, by number and by length: a cache that is emptied when full; results don't depend on it.
CACHE, CACHE_LENGTH = 400_000, 48


def byte_characters() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; the ranks must be 0, 1, 2 ... without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is token i, score -i; one unknown piece at the end."""
    chars = byte_characters()
    pieces = [_message(1, _message(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -float(i))) for i, t in enumerate(tokens)]
    unknown = _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _message(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43)))
    normaliser = _message(3, _message(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5)))
    return b"".join(pieces) + unknown + trainer + normaliser


class Codec:
    """Encodes and decodes whole texts; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.ready: dict[str, bytes] = {}  # ids as 32-bit numbers

    def _encode_new(self, parts: list[str]) -> dict[str, bytes]:
        mapped = [p.encode().decode("latin-1").translate(self.map) for p in parts]
        return {p: array("i", ids).tobytes() for p, ids in zip(parts, self.pieces.encode(mapped, out_type=int, num_threads=1))}

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ids(self, text: str) -> np.ndarray:
        parts = self.find(text)
        ready = self.ready
        missing = [p for p in dict.fromkeys(parts) if p not in ready]
        if missing:
            new = self._encode_new(missing)
            if len(ready) + len(new) > CACHE:
                ready = self.ready = {p: ready[p] for p in set(parts) if p in ready}
            long = {p: ids for p, ids in new.items() if len(p) > CACHE_LENGTH}
            ready.update(new)
            out = b"".join(map(ready.__getitem__, parts))
            for p in long:
                del ready[p]
        else:
            out = b"".join(map(ready.__getitem__, parts))
        return np.frombuffer(out, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(spark, path: str, pattern: str):
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((tokens, sentencepiece_model(tokens), pattern))  # size fixed by the vocabulary file


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all) plus ``ids``, ``n_tokens`` and ``intact`` (the ids were decoded and give the text again)."""
    held = _codec(docs.sparkSession, path, pattern)

    def start():
        codec = Codec(*held.value)

        def step(texts: pa.Array) -> list:
            held = [t or "" for t in texts.to_pylist()]
            ids = [codec.ids(t) for t in held]
            intact = [codec.decode(x.tolist()) == t.encode() for x, t in zip(ids, held)]
            counts = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))
            return [lists, pa.array(counts), pa.array(intact, pa.bool_())]

        return step

    names = without(docs, ["ids", "n_tokens", "intact"])
    fields = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("intact", BooleanType())]
    return map_text(docs, [c for c in keep or names if c in names], fields, start)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256 (of the decimal ids, joined by blanks), decoded (the text from the ids) and decoded_sha256."""
    held = _codec(docs.sparkSession, path, pattern)

    def start():
        codec = Codec(*held.value)
        digits = [str(i) for i in range(len(codec.tokens) + 1)]
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def step(texts: pa.Array) -> list:
            n, of_ids, of_text = [], [], []
            for t in texts.to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(digits.__getitem__, ids)).encode()))
                of_text.append(sha(codec.decode(ids)))
            return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

        return step

    return map_text(docs, keep, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())], start)


def decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``text``, the characters of ``ids``; null ids give an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    held = encoded.select(*[c for c in keep if c.lower() != "text"], F.coalesce("ids", F.array().cast("array<int>")).alias("__ids"))
    fields = [f for f in held.schema if f.name != "__ids"]

    def run(batches):
        table = tokens.value
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(fields))], pa.array(texts, pa.string())], names=[*[f.name for f in fields], "text"])

    return held.mapInArrow(run, StructType([*fields, StructField("text", StringType())]))


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` but those named ids, n_tokens and intact, plus these three."""
    held, back = set_aside(docs)
    names = {"ids", "n_tokens", "intact"}
    kept = [c for c, name in zip(back, docs.columns) if name.lower() not in names]
    from pyspark.sql import functions as F

    return encode(held, path, pattern, [*held.columns]).select(*kept, F.col("ids"), F.col("n_tokens"), F.col("intact"))
