"""Sequence packing as vector bin packing with the dot-product heuristic.

An example takes part of three budgets of a sequence at once: tokens, segments
and loss-bearing tokens. A sequence is filled by taking, again and again, the
example that fits and whose demand vector (as shares of the budgets) has the
largest dot product with what the sequence has left, so an example goes where
the scarce budget still has room.

Examples may be cut. Whole sequences are cut off long ones first; when nothing
fits a hole any more, the next example is cut to fill it. A sequence that ends
short of the token budget is closed as sequences of powers of two, which need
no padding.

Each task packs its own rows in blocks of bounded tokens, so packing moves no
data and its memory does not depend on the input. Sequence ids are unique over
all tasks.

Defined results
* null or empty texts: the end token alone;
* examples without tokens: no piece (documents always have the end token);
* ties: the earlier row; repeated rows are packed like any others;
* null ids are carried through; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import held

BLOCK_TOKENS = 1 << 20
BLOCK_ROWS = 4096
MEMO_WORDS = 250_000
MEMO_PIECES = 400_000
MEMO_LENGTH = 48


@dataclass(frozen=True)
class Limits:
    """Budgets of one sequence."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Sequence:
    """Pieces of one sequence: (example, start, length)."""

    pieces: list[tuple[int, int, int]] = field(default_factory=list)

    def total(self) -> int:
        return sum(p[2] for p in self.pieces)


class Examples:
    """Unpacked rests of a block's examples. ``loss`` marks the loss-bearing tokens of each, None for all."""

    def __init__(self, lengths: list[int], loss: list[np.ndarray | None]):
        self.loss_sums = [None if x is None else np.concatenate([[0], np.cumsum(x)]) for x in loss]
        self.ends = lengths
        self.start = np.zeros(len(lengths), dtype=np.int64)
        self.tokens = np.array(lengths, dtype=np.int64)
        self.loss = np.array([self.loss_of(i, 0, n) for i, n in enumerate(lengths)], dtype=np.int64)

    def loss_of(self, i: int, start: int, length: int) -> int:
        sums = self.loss_sums[i]
        return length if sums is None else int(sums[start + length] - sums[start])

    def fitting(self, i: int, tokens: int, loss: int) -> int:
        """The longest next piece of example i within both rooms."""
        n = int(min(tokens, self.tokens[i]))
        sums = self.loss_sums[i]
        if sums is None:
            return min(n, loss)
        s = int(self.start[i])
        return int(np.searchsorted(sums[s:s + n + 1], sums[s] + loss, "right")) - 1

    def take(self, i: int, length: int) -> tuple[int, int, int]:
        piece = (i, int(self.start[i]), length)
        self.start[i] += length
        self.tokens[i] -= length
        self.loss[i] = self.loss_of(i, int(self.start[i]), int(self.tokens[i]))
        return piece


def closed(seq: Sequence, tokens: int) -> Iterator[Sequence]:
    """The sequence itself if full, else sequences of powers of two with the same pieces in order."""
    left = seq.total()
    if left == tokens:
        yield seq
        return
    queue = list(seq.pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        part, room = Sequence(), size
        while room:
            i, start, n = queue.pop(0)
            part.pieces.append((i, start, min(n, room)))
            if n > room:
                queue.insert(0, (i, start + room, n - room))
            room -= min(n, room)
        yield part
        left -= size


def pack(lengths: list[int], loss: list[np.ndarray | None] | None = None,
         limits: Limits = Limits()) -> Iterator[Sequence]:
    """Sequences over the examples of one block; every token lies in exactly one piece."""
    ex = Examples(lengths, loss or [None] * len(lengths))
    for i in np.flatnonzero(ex.tokens >= limits.tokens):
        while ex.tokens[i] >= limits.tokens and ex.fitting(i, limits.tokens, limits.loss) == limits.tokens:
            yield Sequence([ex.take(i, limits.tokens)])
    share = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss])
    left = np.flatnonzero(ex.tokens > 0)
    while len(left):
        seq, room = Sequence(), np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
        while room[0] and room[1] and len(left):
            tokens, bearing = ex.tokens[left], ex.loss[left]
            weight = room * share
            score = tokens * (share[0] * weight[0]) + share[1] * weight[1] + bearing * (share[2] * weight[2])
            score[(tokens > room[0]) | (bearing > room[2])] = -1.0
            best = int(np.argmax(score))
            if score[best] < 0:  # nothing fits whole: cut the first that gives anything
                best, n = next(((k, n) for k in range(len(left))
                                if (n := ex.fitting(left[k], int(room[0]), int(room[2])))), (0, 0))
                if not n:
                    break
            else:
                n = int(tokens[best])
            i = int(left[best])
            piece = ex.take(i, n)
            seq.pieces.append(piece)
            room -= np.array([n, 1, ex.loss_of(i, piece[1], n)])
            if ex.tokens[i] == 0:
                left = np.delete(left, best)
        if not seq.pieces:  # a loss budget of nothing: place the token alone rather than lose it
            seq.pieces.append(ex.take(int(left[0]), 1))
            left = left[ex.tokens[left] > 0]
        yield from closed(seq, limits.tokens)


#: Characters that no normal form changes, that lower-case alike everywhere and whose class is settled: visible
#: ASCII and the precomposed Latin letters up to U+017F, without the two whose small form has two characters.
_VISIBLE = "\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
_SETTLED = re.compile(f"[\t-\r {_VISIBLE}]*")
#: The small letters and the digits among them, in place of the classes of a pattern.
_SMALL, _DIGITS = "a-z\u00df-\u00f6\u00f8-\u017f", "0-9"


def _byte_letters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself if visible, else the next from U+0100."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in seen)}


class Pieces(dict):
    """Ids of each piece of text that the merges have seen, in two generations of bounded size."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters, self.older = model, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        known = self.older.get(piece)
        if known is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(spelled)]
            known = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = known
        return known


class WordTokenizer:
    """Ids of whole texts: the tokenizer never joins anything across white space.

    A text of settled characters is lower-cased and split where the tokenizer's
    own pre-tokenizer splits it, and only pieces not seen before go through the
    tokenizer's merges; the rest of its work is dictionary look-ups. Any other
    text goes word by word: words between ASCII white space are encoded once,
    by the whole tokenizer where they are not settled, and remembered, in two
    generations of bounded size, so that words in use outlive the others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.split = self._splitter(made)
        self.pieces = Pieces(self.tokenizer.model)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _splitter(made: dict):
        """The pre-tokenizer's pattern, if the file lower-cases, splits by it and merges bytes; else None."""
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if (steps != ["NFC", "Replace", "Lowercase"] or first.get("type") != "Split" or not first.get("invert")
                or first.get("behavior") != "Removed" or [r["type"] for r in rest] != ["ByteLevel"]
                or rest[0]["add_prefix_space"] or rest[0]["use_regex"] or made["model"]["type"] != "BPE"):
            return None
        pattern = first["pattern"]["Regex"]
        if set(re.findall(r"\\p\{\w+\}", pattern)) - {r"\p{L}", r"\p{N}"}:
            return None
        return re.compile(pattern.replace(r"\p{L}", _SMALL).replace(r"\p{N}", _DIGITS)).findall

    def _settled(self, text: str) -> bytes | None:
        """Ids of a text by its pieces, or None if it needs the whole tokenizer."""
        if self.split is None or not _SETTLED.fullmatch(text) or any(s in text for s in self.special):
            return None
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        out = [self._settled(t) for t in texts]
        whole = [i for i, x in enumerate(out) if x is None]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        for i, e in zip(whole, found, strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        out = [self._settled(t.decode("utf-8", "replace")) for t in texts]
        other = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(other, self._by_words([texts[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]  # bytes split at ASCII white space only
        recent, older = self.recent, self.older
        if len(recent) > MEMO_WORDS:
            recent, older = self.recent, self.older = {}, recent
        new = set().union(*split).difference(recent)
        extra: dict[bytes, bytes] = {}
        missing = []
        for w in new:
            ids = older.get(w)
            if ids is None:
                missing.append(w)
            else:
                recent[w] = ids
        for lo in range(0, len(missing), 4096):
            part = missing[lo:lo + 4096]
            for w, ids in zip(part, self._encode(part), strict=True):
                (recent if len(w) <= MEMO_LENGTH and len(recent) <= 2 * MEMO_WORDS else extra)[w] = ids
        if extra:
            return [b"".join([recent[w] if w in recent else extra[w] for w in words]) for words in split]
        return [b"".join(map(recent.__getitem__, words)) for words in split]


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return held(("words", path), lambda: WordTokenizer(path))


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long, ids binary")


def _pack_texts(path: str, end_id: int, limits: Limits, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.binary() if c.endswith("binary") else pa.int64() for c in PIECES.split(", ")]

    def block(ids: list, tokens: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(t) // 4 for t in tokens]
        out, number = [], first
        for seq in pack(lengths, None, limits):
            at = 0
            for i, start, n in seq.pieces:
                part = tokens[i][4 * start:4 * (start + n)]
                out.append((ids[i], start, n, zlib.crc32(part), lengths[i], number, at, n,
                            part if with_ids else None))
                at += n
            number += 1
        columns = zip(zip(*out, strict=True), types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names), number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(path)
        number = TaskContext.get().partitionId() << 40
        ids, tokens, size = [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
                for doc, t in zip(part["doc_id"].to_pylist(), coder.ids(texts), strict=True):
                    ids.append(doc)
                    tokens.append(t + end)
                    size += len(tokens[-1]) // 4
                if size >= BLOCK_TOKENS or len(ids) >= BLOCK_ROWS:
                    out, number = block(ids, tokens, number)
                    yield out
                    ids, tokens, size = [], [], 0
        if ids:
            yield block(ids, tokens, number)[0]
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 1, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: every token of plain text bears loss."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack_texts(tokenizer_path, end_id, limits, with_ids), PIECES)


PLACED = "example_id string, start long, length long, sequence_id long, offset long, loss_tokens long"


def _pack_examples(limits: Limits):
    names = [c.split()[0] for c in PLACED.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                lengths = [n or 0 for n in part["tokens"].to_pylist()]
                marks = [None if m is None else np.array(m, dtype=np.int64) for m in part["loss_mask"].to_pylist()]
                ids, out = part["example_id"].to_pylist(), []
                for seq in pack(lengths, marks, limits):
                    at = 0
                    for i, start, n in seq.pieces:
                        bearing = n if marks[i] is None else int(marks[i][start:start + n].sum())
                        out.append((ids[i], start, n, number, at, bearing))
                        at += n
                    number += 1
                columns = zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names)
    return run


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_mask_col: str,
                  limits: Limits = Limits()) -> DataFrame:
    """Pieces of instruction examples: token counts and a 0/1 mask per token (null: all bear loss)."""
    rows = examples.select(F.col(id_col).cast("string").alias("example_id"), F.col(tokens_col).alias("tokens"),
                           F.col(loss_mask_col).alias("loss_mask"))
    return rows.mapInArrow(_pack_examples(limits), PLACED)
