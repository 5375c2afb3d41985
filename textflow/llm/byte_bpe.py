"""Byte-level BPE through a sentencepiece model built from a vocabulary of ranks.

The vocabulary file (``base64-token rank`` lines) becomes a sentencepiece BPE
model without any training: each token's bytes are mapped one to one onto
characters, its score is its negative rank, and normalisation is the
identity. A merge with the highest score is then the merge with the lowest
rank. Texts are split by a pattern into pre-tokens, each encoded by itself; ids
are decoded by the inverse of the byte mapping.

Defined cases: a null text counts as empty and has no ids; ids outside the
vocabulary and null ids within an array raise an error in ``decode``; special tokens are ordinary text;
repeated rows are encoded one by one, a pre-token that repeats only once while a task remembers it.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A vocabulary is shipped to every task, so its file may hold no more than this.
MAX_VOCABULARY_BYTES = 32 << 20
#: Byte b is written as this code point plus b: no white space, no mark of sentencepiece's own.
FIRST_CHARACTER = 0x100
#: Entries of a task's memory of encoded pre-tokens, and the longest pre-token it holds.
MEMORY_ENTRIES, MEMORY_LENGTH = 1 << 18, 64
#: Texts are split and learned together up to this many characters; a text beyond it is split piece after piece.
LONG_TEXT = 1 << 20

_TO_CHARACTERS = {b: chr(FIRST_CHARACTER + b) for b in range(256)}


def _mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHARACTERS)


def _unmapped(piece: str) -> bytes:
    return bytes(ord(c) - FIRST_CHARACTER for c in piece)


def read_vocabulary(spark: SparkSession, path: str) -> list[bytes]:
    """Tokens by rank. Ranks must run from 0 without a gap and hold all 256
    single bytes."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {MAX_VOCABULARY_BYTES} bytes")
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path}: ranks must be 0, 1, 2, ... and cover every single byte")
    return tokens


# --- the model file: protocol buffer fields written directly ---


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; the id of a piece is its rank, and
    the unknown piece that the format asks for takes the next free id."""
    normal, unknown, bpe = 1, 2, 2  # fixed values of the model format
    pieces = [_piece(_mapped(t), -float(rank), normal) for rank, t in enumerate(tokens)]
    pieces.append(_piece("<unk>", 0.0, unknown))
    trainer = (_number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
               + _number(41, -1) + _number(42, -1) + _number(43, -1))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


# --- tasks ---


class _Encoder:
    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {t: array("i", [i]).tobytes() for i, t in enumerate(tokens)}  # a pre-token that is a token needs no merges
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        found, rest, ends, raws = {}, [], [0], bytearray()
        for w in words:
            raw = w.encode()
            ids = self.whole.get(raw)
            if ids is None:
                rest.append(w)
                raws += raw
                ends.append(len(raws))
            else:
                found[w] = ids
        mapped = (np.frombuffer(raws, np.uint8).astype("<u2") + FIRST_CHARACTER).tobytes().decode("utf-16-le")  # all at once
        encoded = self.model.encode([mapped[i:j] for i, j in pairwise(ends)], num_threads=1)
        for w, ids in zip(rest, encoded, strict=True):
            found[w] = array("i", ids).tobytes()
        return found

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens, as the bytes of int32. What is new in any of them is encoded at once."""
        if len(self.known) > MEMORY_ENTRIES:
            self.known = {}
        known = self.known
        fresh = self._learn(set(chain.from_iterable(texts)).difference(known))
        known |= fresh
        ids = [b"".join(map(known.__getitem__, words)) for words in texts]
        for w in fresh:
            if len(w) > MEMORY_LENGTH:
                del known[w]
        return ids

    def _long(self, text: str) -> bytes:
        parts, words, held = [], [], 0
        for m in self.pattern.finditer(text):
            words.append(m.group())
            held += len(words[-1])
            if held > LONG_TEXT:
                parts += self._ids([words])
                words, held = [], 0
        return b"".join([*parts, *self._ids([words])])

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as the bytes of int32; texts of ``LONG_TEXT`` characters together are held at most."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > LONG_TEXT:
                yield from self._ids(held)
                held, size = [], 0
            if len(text) > LONG_TEXT:
                yield self._long(text)
            else:
                held.append(self.pattern.findall(text))
                size += len(text)
        yield from self._ids(held)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(next(self.each([text])), np.int32)


def encode(text: Column, tokens: list[bytes], pattern: str) -> Column:
    """``array<int>``: the ids of a text column. ``tokens`` from
    ``read_vocabulary``."""
    model = model_bytes(tokens)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(model, tokens, pattern)
        for batch in batches:
            flat, ends = bytearray(), [0]
            for found in encoder.each(text.as_py() for text in batch):
                flat += found
                ends.append(len(flat) // 4)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))

    return ids.asNondeterministic()(text)  # so that no rule copies the call


def decode(ids: Column, tokens: list[bytes]) -> Column:
    """``binary``: the bytes that ids stand for; null ids give null. An array
    with a null item or an id that stands for no token is an error."""
    written = [_mapped(t) for t in tokens]

    @F.arrow_udf("binary")
    def content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(map(_unmapped, written), pa.binary())
        for batch in batches:
            flat = batch.flatten()
            if flat.null_count or (len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(table))):
                raise ValueError("a null, a negative id or one beyond the vocabulary stands for no token")
            # tokens taken one after the other are the bytes; a row ends where its last token does
            taken = table.take(flat)
            if isinstance(taken, pa.ChunkedArray):
                raise ValueError("a batch beyond 2 GB of bytes; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            _, ends, held = taken.buffers()
            ends = np.frombuffer(ends, np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
            of_rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy())])
            valid = pc.is_valid(batch).cast(pa.uint8()).to_numpy()
            yield pa.Array.from_buffers(pa.binary(), len(batch), [
                pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(ends[of_rows].tobytes()),
                held if held is not None else pa.py_buffer(b"")])

    return content.asNondeterministic()(ids)
