"""Byte-level BPE by a sentencepiece model that is serialised straight from the vocabulary.

Each token's bytes become printable characters, one for one; a piece's score is its negative rank, so that the merges
run in the order of the ranks; normalisation is the identity.  Pre-tokens are encoded one by one and decoded by the
inverse of the byte map.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import documents, free_name, text_of
from .rolling import chunks

#: Chunks that a task remembers, and as many that begin a text; the memory is emptied when full and at the task's end.
CACHE = 500_000
# Python's white space holds all that the pattern's does, so that a chunk never ends inside a run of it.
ODD_SPACE = re.compile(r"\s\s|^\s|\s\Z").search
CHUNK_END = re.compile(r"(?<=\S) (?=\S)").split


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1 where printable, else the next free code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces 1 (piece 1, score 2, type 3), trainer 2 (model type 3 = BPE), normaliser 3."""
    chars = byte_characters()
    parts = []
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        parts.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    parts.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    parts.append(_field(2, _field(3, 2) + _field(40, len(tokens))))
    parts.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(parts)


class Codec:
    """Encodes and decodes as a rank file's tokenizer does, special tokens aside."""

    def __init__(self, vocabulary: str, pattern: str):
        self.tokens = read_ranks(vocabulary)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.to_chars = {b: c for b, c in enumerate(byte_characters())}
        self.split = regex.compile(pattern).findall
        #: ids in decimal by chunk, with the space before it or (first in its text) without
        self.spaced: dict[str, str] = {}
        self.bare: dict[str, str] = {}

    def pieces(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; a pre-token that is a token itself is that token, whatever its merges."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        ids = self.model.encode([r.decode("latin-1").translate(self.to_chars) for r in raw], num_threads=1)
        return [[self.rank[r]] if r in self.rank else i for r, i in zip(raw, ids, strict=True)]

    def learn(self, known: dict[str, str], chunks: list[str], before: str) -> None:
        """Split new chunks by the pattern, encode their distinct pre-tokens in one call and remember the result."""
        found = [self.split(before + x) for x in chunks]
        distinct = list({p for f in found for p in f})
        ids = dict(zip(distinct, self.pieces(distinct), strict=True))
        for x, f in zip(chunks, found, strict=True):
            known[x] = " ".join([str(i) for p in f for i in ids[p]])

    def decimals(self, texts: list[str]) -> list[str]:
        """Ids of each text in decimal, joined by spaces.

        No pre-token reaches over a space that stands between two other characters, so that such a space begins a chunk
        whose pre-tokens depend on nothing else; most chunks have been met before.
        """
        split = [(CHUNK_END(t) if ODD_SPACE(t) else t.split(" ")) if t else [] for t in texts]
        for known, before, parts in ((self.bare, "", [c[:1] for c in split]), (self.spaced, " ", [c[1:] for c in split])):
            distinct = set().union(*parts)
            new = [x for x in distinct if x not in known]
            if new and len(known) + len(new) > CACHE:
                known.clear()
                new = list(distinct)
            if new:
                self.learn(known, new, before)
        bare, spaced = self.bare, self.spaced
        return [" ".join(filter(None, [*[bare[x] for x in c[:1]], *[spaced[x] for x in c[1:]]])) for c in split]

    def forget(self) -> None:
        """Give back the memory of the chunks met so far."""
        self.spaced, self.bare = {}, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [list(map(int, d.split())) for d in self.decimals(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec a Python worker."""
    key = (vocabulary, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = True, carry: bool = False) -> DataFrame:
    """Token ids of every whole text and their digests, then the digest of the bytes that the ids decode to.

    The vocabulary file is read by its path on each worker (it comes with an installed package).  Row-local: no
    shuffle, and about a megabyte of texts (one text at least) at a time in memory.

    Cases: a null text counts as empty (no ids); repeated rows and null ids are encoded each on its own; an empty table
    gives an empty result.  With ``carry`` all columns of ``docs`` stay, and the new ones give way by underscores.

    Returns the id (or all columns), ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``with_ids``, ``ids``.
    """
    if vocabulary is None or pattern is None:
        own = default_vocabulary()
        vocabulary, pattern = vocabulary or own[0], pattern or own[1]
    kept = docs if carry else docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("text" if id_col != "text" else "text_"))
    source = text_col if carry else kept.columns[1]
    names = [free_name(kept, x) for x in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")][: 4 if with_ids else 3]
    shown = [c for c in kept.columns if carry or c != source]
    types = dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "ids"), ("bigint", "string", "string", "array<int>"), strict=True))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in shown] + [f"`{n}` {t}" for n, t in zip(names, types.values(), strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        try:
            for batch in batches:
                for lo, hi, _, _ in chunks(batch, source):
                    part = batch.slice(lo, hi - lo)
                    rows: tuple[list, list, list, list] = ([], [], [], [])
                    for decimal in c.decimals([t or "" for t in part.column(source).to_pylist()]):
                        ids = list(map(int, decimal.split()))
                        rows[0].append(len(ids))
                        rows[1].append(hashlib.sha256(decimal.encode()).hexdigest())
                        rows[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
                        rows[3].append(ids if with_ids else None)
                    cols = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                    cols += [pa.array(rows[3], pa.list_(pa.int32()))] * with_ids
                    yield pa.RecordBatch.from_arrays([part.column(x) for x in shown] + cols, names=[*shown, *names])
        finally:  # the worker lives on, beside other steps
            c.forget()

    return kept.mapInArrow(run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir), with_ids=False)
