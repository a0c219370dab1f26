"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, one each, so that an Aho-Corasick
automaton over strings holds the byte vocabulary. For each split-off piece of
text it lists all vocabulary matches in one pass; the encoder walks from the
longest match at each place and backs up to the next shorter one whenever two
neighbours are not compatible, that is, when merging their joined bytes would
not give back just these two. A sequence whose neighbours are all compatible is
the one that the merges give, and it is unique. Compatibility of a token pair is
found once and remembered, and a place that failed is never tried again, so the
work is linear in the length of the piece.

Defined results
* null or empty texts: no ids, the digests of the empty byte string;
* null ids are carried through; repeated rows give repeated rows;
* very long pieces without a split are encoded whole, in linear time;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cropframe.llm.common import held

MEMO_PIECES = 400_000
MEMO_PAIRS = 1_000_000
MEMO_LENGTH = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank (its id), from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by plain merging, lowest rank first: for short pieces and as the reference in tests."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token, i in ranks.items():
            # a token that merging never makes can only stand as a whole piece
            if len(token) == 1 or merge(token, ranks) == [i]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        made = {t for t in self.automaton.keys()}
        for word in made:
            n = len(word) - 1
            while n and word[:n] not in made:
                n -= 1
            self.shorter[ranks[word.encode("latin-1")]] = ranks[word[:n].encode("latin-1")] if n else -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves just the two."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = merge(self.tokens[a] + self.tokens[b], self.ranks) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, exactly as its merges give them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (n, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = i  # ends come in order: the last is the longest
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            n = len(self.tokens[token])
            if not dead[at + n] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at += n
                if at == len(piece):
                    return out
                token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:  # no token leads on from here: give up this place and the step that led to it
                dead[at] = 1
                last = out.pop()
                at -= len(self.tokens[last])
                token = self.shorter[last]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        found = self.pattern.findall(text)
        memo = self.pieces
        if len(memo) > MEMO_PIECES:
            memo.clear()
        extra: dict[str, bytes] = {}
        for p in set(found).difference(memo):
            ids = np.array(self.encode_piece(p.encode()), dtype="<u4").tobytes()
            (memo if len(p) <= MEMO_LENGTH and len(memo) <= 2 * MEMO_PIECES else extra)[p] = ids
        if extra:
            return b"".join(memo[p] if p in memo else extra[p] for p in found)
        return b"".join(map(memo.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    return held(("bpe", path, pattern), lambda: Codec(load_ranks(path), pattern))


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def _encode(path: str, pattern: str, with_ids: bool):
    names = [c.split()[0] for c in ENCODED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = c.encode(text) if text else b""
                    out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                hashlib.sha256(c.decode(ids)).hexdigest(), ids if with_ids else None))
                columns = zip(zip(*out, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names)
    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: token count, digests of the ids and of the decoded bytes, and the ids themselves."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(ranks_path, pattern, with_ids), ENCODED)


def decode_ids(ids: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns plus ``decoded`` (binary): the bytes of an id column as ``encode_documents`` writes it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            out = [None if x is None else c.decode(x) for x in b[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return ids.mapInArrow(run, StructType([*ids.schema.fields, StructField("decoded", BinaryType())]))
