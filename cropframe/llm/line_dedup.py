"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words (runs of letters, digits and
underscores, where every character beyond ASCII counts as a letter). A line with
any word goes if it repeats an earlier line exactly (in the order of document
id, then place). A line of at least ``min_words`` words, repeated ones counted
as often as they stand and characters of scripts without spaces counted like
words, goes as well if an earlier such line has a Jaccard similarity of
``threshold`` or more. The join is exact:

* words are ordered by rarity over all lines (a bounded table of hashed counts
  gives the order; any fixed order keeps the join exact, rarity makes it cheap);
* prefix filter: two such lines share a word among the first
  |x| - ceil(threshold * |x|) + 1 of that order;
* length and positional filters bound the overlap that a shared word allows;
  the bits in which two 128-bit parity signatures differ bound it again;
* candidates are verified on their full word sets.

Each line needs one earlier match only, so a dense group does not list all its
pairs: per shared word, a line first tries its nearest few candidates; the
lines that found no match among these try the rest of the words where candidates
are left in a second round, over the postings that the first kept of these words. A word that is still common among prefixes is replaced
by pairs of words (two such lines share at least two words in a prefix one
longer), so posting lists stay short. Postings travel as packed arrays, one
row per task batch and group of words.

Three passes read the texts: counts and line keys; postings; the word sets of
candidate lines, found through a bloom filter of fixed size. Texts are never
shuffled.

Defined results
* null or empty texts: unchanged, null stays null; lines without words stay;
* words are compared by 64-bit hashes;
* null ids: their documents stay as they are, and take no part;
* rows that repeat an id are one document: what goes from one goes from all
  whose line at that place is the same;
* a document whose lines all go keeps its row with an empty text;
* empty table: empty result; extra columns are kept by ``remove_lines``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import fresh, held, staged

THRESHOLD = 0.8
MIN_WORDS = 5
#: Hashed word counts, 4 bytes each; 2^24 of them suit corpora of some 100 GB and more.
COUNTERS = 1 << 18
COUNT_BLOCK = 1 << 14
#: Words of a larger count are common: their postings go by pairs of words.
HOT = 4_096
TRIES = 64
#: Candidates whose signatures hardly differ are nearly always matches: so many of them are enough to try.
STRONG = 2
#: Earlier lines of a word that are looked at one by one before the search turns to lines of fitting size.
NEAREST = 32
GROUP_POSTINGS = 100_000
CHUNK_BYTES = 1 << 20
MEMO = 200_000
BLOOM_BITS = 1 << 25

#: Words of more bytes are hashed one by one, shorter ones eight bytes of all words at a time.
LONG_WORD = 32
_IN_WORD = bytes(chr(b).isalnum() or b == 95 if b < 128 else True for b in range(256))
_LEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first byte, 64-bit hash) of every word of a lower-cased UTF-8 text, in whole-array steps."""
    padded = b"\n" + text + b"\n" * 8
    inside = np.frombuffer(padded.translate(_IN_WORD), dtype=np.bool_)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    size = end - start
    # the eight bytes from every place of the text on; no word holds a zero byte
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, offset=1, strides=(1,))
    h = _mixed(eight[start] & _LEAD[np.minimum(size, 8)])
    for k in range(8, LONG_WORD, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        piece = eight[start[more] + k] & _LEAD[np.minimum(size[more] - k, 8)]
        h[more] = _mixed(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ piece)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i]:end[i]])
    return start, h


#: Characters of scripts that write no spaces: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                       "\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _counter(h: np.ndarray, counters: int) -> np.ndarray:
    """The counter of every word."""
    if counters & (counters - 1):
        return (h % np.uint64(counters)).astype(np.int64)
    return (h & np.uint64(counters - 1)).astype(np.int64)


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.strip().encode("utf-8", "surrogatepass"))


def _split_lines(ids: list[int], texts: list[str | None]) -> tuple[list[str], list[int], list[int]]:
    """Every line of the texts, its document and its place there."""
    lines, docs, places = [], [], []
    for doc, text in zip(ids, texts, strict=True):
        if text:
            own = text.split("\n")
            lines += own
            docs += [doc] * len(own)
            places += range(len(own))
    return lines, docs, places


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash) of every word of the lines, joined and lower-cased, and the places where lines end."""
    low = "\n".join(lines).lower().encode("utf-8", "surrogatepass")
    start, h = word_hashes(low)
    return start, h, np.flatnonzero(np.frombuffer(low, dtype=np.uint8) == 10)


def _new_lines(lines: list[str], docs: list[int], places: list[int], posted: dict[bytes, tuple[int, int]]) -> list[int]:
    """Which lines ``posted`` does not know at their place or a smaller one; it knows them from now on."""
    new = []
    for i, here in enumerate(zip(docs, places, strict=True)):
        k = line_key(lines[i])
        if k not in posted or here < posted[k]:
            posted[k] = here
            new.append(i)
    return new


class Lines:
    """The lines of ``min_words`` words or more of some documents, and their words: each once a line, sorted by line."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int, rarity: np.ndarray,
                 magnitude: np.ndarray, posted: dict[bytes, tuple[int, int]]):
        lines, docs, places = _split_lines(ids, texts)
        new = _new_lines(lines, docs, places, posted)
        lines, docs, places = [lines[i] for i in new], [docs[i] for i in new], [places[i] for i in new]
        start, h, ends = _hashed(lines)
        owner = np.searchsorted(ends, start)
        length = np.bincount(owner, minlength=len(lines))
        for i in np.flatnonzero((length > 0) & (length < min_words)).tolist():
            if not lines[i].isascii():
                length[i] = max(length[i], len(_UNSPACED.findall(lines[i])))
        rank = magnitude[_counter(h, len(rarity))]
        # one sort key: line, magnitude of the count, leading bits of the hash
        key = owner.astype(np.uint64) << np.uint64(44) | rank << np.uint64(38) | h >> np.uint64(26)
        order = np.argsort(key)
        key, sorted_h = key[order], h[order]
        if (len(lines) >> 20) or ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            order = np.lexsort((h, rank, owner))
            sorted_h = h[order]
        owner = owner[order]
        one = np.ones(len(order), dtype=bool)
        one[1:] = (owner[1:] != owner[:-1]) | (sorted_h[1:] != sorted_h[:-1])
        owner, words = owner[one], sorted_h[one]
        used = np.flatnonzero(length >= min_words)
        local = np.full(len(lines), -1)
        local[used] = np.arange(len(used))
        pick = local[owner] >= 0
        self.owner, self.words = local[owner[pick]], words[pick]
        self.count = rarity[_counter(self.words, len(rarity))].astype(np.int64)
        self.lines = [lines[i] for i in used]
        self.doc = np.array(docs, dtype=np.int64)[used] if docs else np.zeros(0, dtype=np.int64)
        self.place = np.array(places, dtype=np.int32)[used] if docs else np.zeros(0, dtype=np.int32)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[str | None]]]:
    """Ids and texts of a batch in chunks of bounded text (a single text may be longer)."""
    ids, texts, size = [], [], 0
    for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
        ids.append(doc)
        texts.append(text)
        size += len(text or "")
        if size >= CHUNK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


SURVEY = "block int, counts binary, line binary, doc_id long, place int"


def _survey(counters: int):
    """First pass: a row per line with any word, and the task's hashed word counts in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lines", dict)     # lets go of what an earlier operator kept
        names = [c.split()[0] for c in SURVEY.split(", ")]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
        total = np.zeros(counters, dtype=np.uint32)
        for b in batches:
            for ids, texts in _texts(b):
                lines, doc, place = _split_lines(ids, texts)
                start, h, ends = _hashed(lines)
                total += np.bincount(_counter(h, counters), minlength=counters).astype(np.uint32)
                used = np.unique(np.searchsorted(ends, start)).tolist()     # the lines with any word
                n = len(used)
                cols = [[None] * n, [None] * n, [line_key(lines[i]) for i in used], [doc[i] for i in used],
                        [place[i] for i in used]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        blocks = total.reshape(-1, min(COUNT_BLOCK, counters))
        used = [i for i in range(len(blocks)) if blocks[i].any()]
        n = len(used)
        cols = [used, [blocks[i].tobytes() for i in used], [None] * n, [None] * n, [None] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
    return run


def _sum_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, block = None, None
    for f in frames:
        for b, raw in zip(f["block"], f["counts"], strict=True):
            part = np.frombuffer(raw, dtype=np.uint32).astype(np.uint64)
            total, block = (part if total is None else total + part), b
    if total is not None:
        capped = np.minimum(total, np.uint64((1 << 32) - 1)).astype(np.uint32)
        yield pd.DataFrame({"block": [block], "counts": [capped.tobytes()]})


def word_counts(survey: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Hashed word counts over all lines: ``counters`` numbers at any input size."""
    got = survey.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(
        _sum_block, "block int, counts binary").collect()
    out = np.zeros(counters, dtype=np.uint32)
    size = min(COUNT_BLOCK, counters)
    for r in got:
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out


def needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """ceil(threshold * size), safe against rounding."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - needed(size, threshold) + 1


def overlap_needed(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two words, whatever their order."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    x = (lo ^ (hi * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def bloom_place(doc, place, bits: int):
    """The filter's bit of a line; the same arithmetic stands in ``bloom_filter``."""
    return (doc % (1 << 31) * 2654435761 + place * 40503) % bits


def _bits_set(rows: DataFrame, at: Column, bits: int) -> np.ndarray:
    """Bytes of a table of ``bits`` bits in which those that ``at`` names are set, at any input size."""
    words = rows.select(at.cast("long").alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set"))
    out = np.zeros(bits // 32, dtype="<u4")
    table = words.toArrow()      # at most a row for every 32 bits
    out[table["word"].to_numpy()] = table["set"].to_numpy().astype("<u4")
    return out.view(np.uint8)


def bloom_filter(lines: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit table with the bit of every (doc_id, place) set."""
    at = F.pmod(F.pmod(F.col("doc_id"), F.lit(1 << 31)) * F.lit(2654435761) + F.col("place") * F.lit(40503), F.lit(bits))
    return _bits_set(lines, at, bits)


def token_filter(tokens: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit table with the bit of every ``token`` set."""
    return _bits_set(tokens, F.pmod("token", F.lit(bits)), bits)


def has_token(table: np.ndarray, token: np.ndarray) -> np.ndarray:
    at = np.ascontiguousarray(token).view(np.int64) % (len(table) * 8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def with_documents(lines: DataFrame) -> DataFrame:
    """The lines, and each document as the place -1."""
    return lines.select("doc_id", F.explode(F.array("place", F.lit(-1))).alias("place"))


def in_bloom(table: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = bloom_place(doc, place, len(table) * 8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: One posting: a word (or pair) of a line's prefix, the line, its size, the word's place in it, its signature.
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("size", "<i4"), ("pos", "<i4"),
                    ("asks", "<i4"), ("sig0", "<u8"), ("sig1", "<u8")])


def postings(x: Lines, threshold: float, hot: int) -> np.ndarray:
    """Prefix postings of all lines of ``x``."""
    own, w, count = x.owner, x.words, x.count
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[start, len(own)])
    pos = np.arange(len(own)) - np.repeat(start, size)
    limit = np.repeat(prefix_length(size, threshold), size)
    bit = np.uint64(1) << (w & np.uint64(63))
    high = (w & np.uint64(64)) != 0
    sig0 = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), start)
    sig1 = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), start)
    common = (count > hot) & np.repeat(needed(size, threshold) >= 2, size)
    plain = np.flatnonzero((pos < limit) & ~common)
    at, token, place = [plain], [w[plain]], [pos[plain]]
    for i in np.flatnonzero((pos < limit) & common):
        lo = i - pos[i]
        other = np.arange(lo, lo + min(limit[i] + 1, size[own[i]]))
        other = other[other != i]
        at.append(np.full(len(other), i))
        token.append(pair_key(w[i], w[other]))
        place.append(np.minimum(pos[i], pos[other]))
    at = np.concatenate(at)
    line = own[at]
    out = np.zeros(len(at), dtype=POSTING)
    out["token"], out["pos"] = np.concatenate(token), np.concatenate(place)
    out["doc"], out["place"] = x.doc[line], x.place[line]
    out["size"], out["sig0"], out["sig1"] = size[line], sig0[line], sig1[line]
    return out


def _post(counts, threshold: float, min_words: int, hot: int, groups: int):
    """Second pass: postings of each batch, dealt to groups of words as packed arrays.

    A line text that the task has posted is posted again only for a smaller
    (document, place), so the first occurrence of every text is posted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = counts.value
        magnitude = np.frexp(rarity.astype(np.float64))[1].astype(np.uint64)
        posted: dict[bytes, tuple[int, int]] = held("lines", dict)
        posted.clear()
        for b in batches:
            parts = []
            for ids, texts in _texts(b):
                if len(posted) > MEMO:
                    posted.clear()
                x = Lines(ids, texts, min_words, rarity, magnitude, posted)
                if len(x.words):
                    parts.append(postings(x, threshold, hot))
            if not parts:
                continue
            p = np.concatenate(parts)
            p["asks"] = 1
            g = ((p["token"] >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            p, g = p[order], g[order]
            cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            ends = np.r_[cut[1:], len(g)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[cut], pa.int64()),
                 pa.array([_columns(p[a:z]) for a, z in zip(cut, ends, strict=True)], pa.binary())], ["g", "packed"])
    return run


def _columns(p: np.ndarray) -> bytes:
    """Postings field by field, which compresses better than row by row."""
    return len(p).to_bytes(8, "little") + b"".join(np.ascontiguousarray(p[n]).tobytes() for n in POSTING.names)


def _unpacked(raw: bytes | pa.Buffer) -> np.ndarray:
    n, at = int(np.frombuffer(raw, dtype="<u8", count=1)[0]), 8
    out = np.zeros(n, dtype=POSTING)
    for name in POSTING.names:
        kind = POSTING[name]
        out[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += n * kind.itemsize
    return out


class Columns:
    """Fields of postings that the filters read, side by side."""

    def __init__(self, p: np.ndarray, threshold: float):
        self.size = p["size"].astype(np.int64)
        self.left = self.size - p["pos"]
        self.sig0, self.sig1 = np.ascontiguousarray(p["sig0"]), np.ascontiguousarray(p["sig1"])
        sizes = np.arange(2 * int(self.size.max(initial=0)) + 1)
        self.least, self.overlap = needed(sizes, threshold), overlap_needed(sizes, 0, threshold)

    def may_match(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings a and b of one word that pass length, positional and signature filters; which do with ease.

        A pair is looked for at its first shared word, so nothing before it counts.
        """
        sa, sb = self.size[a], self.size[b]
        both = sa + sb
        need = self.overlap[both]
        ok = np.minimum(self.left[a], self.left[b]) >= need
        ok &= np.minimum(sa, sb) >= self.least[np.maximum(sa, sb)]
        at = np.flatnonzero(ok)
        a, b = a[at], b[at]
        differ = np.bitwise_count(self.sig0[a] ^ self.sig0[b])
        differ += np.bitwise_count(self.sig1[a] ^ self.sig1[b])
        most = both[at] - 2 * need[at]
        at = np.flatnonzero(differ <= most)
        differ, most = differ[at].astype(np.int64), most[at]
        # signatures of far lines fill up near 64
        return a[at], b[at], (differ <= 32) & (3 * differ <= 2 * most)


def _by_word(p: np.ndarray) -> np.ndarray:
    """Postings sorted by word, document and place, each line once a word."""
    words, word = np.unique(p["token"], return_inverse=True)
    docs, doc = np.unique(p["doc"], return_inverse=True)
    bits = int(p["place"].max(initial=0)).bit_length()
    if (len(words) * len(docs)).bit_length() + bits < 63:
        key = (word * len(docs) + doc) << bits | p["place"]
        order = np.argsort(key)
        key = key[order]
        return p[order[np.r_[True, key[1:] != key[:-1]]]]
    p = p[np.lexsort((p["place"], p["doc"], p["token"]))]
    same = (p["token"][1:] == p["token"][:-1]) & (p["doc"][1:] == p["doc"][:-1]) & (p["place"][1:] == p["place"][:-1])
    return p[np.r_[True, ~same]]


#: A pair of lines, or (with ``token``) a line and a word under which it has more candidates than it tried.
PAIRS = "xdoc long, xplace int, ydoc long, yplace int, token long"


def candidates(p: np.ndarray, threshold: float, last: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each asking posting, up to ``last`` candidates among the earlier lines of its word (None: all).

    First the nearest earlier lines in turn, where copies and near copies find
    a match at once; then, for lines still short of candidates, the rest of the
    earlier lines, as far as their size fits. Returns the postings of both sides
    of the pairs (a pair may come under several words), and those that have more.
    """
    p = _by_word(p)
    cols = Columns(p, threshold)
    token = np.ascontiguousarray(p["token"])
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    run = np.diff(np.r_[begin, len(p)])
    group = np.repeat(np.arange(len(begin)), run)
    earlier = np.arange(len(p)) - np.repeat(begin, run)
    found, sure = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def put(x: np.ndarray, y: np.ndarray) -> None:
        x, y, strong = cols.may_match(x, y)
        found[x] += 1
        sure[x[strong]] += 1
        left.append(x)
        right.append(y)

    def open_(x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), dtype=bool) if last is None else (found[x] < last) & (sure[x] < STRONG)

    live = np.flatnonzero((p["asks"] > 0) & (earlier > 0))
    for step in range(1, NEAREST + 1):
        put(live, live - step)
        live = live[(earlier[live] > step) & open_(live)]
        if not len(live):
            break
    # the rest by size: a posting's place leaves room for lines up to a size only
    key = group << 32 | cols.size
    by_size = np.argsort(key, kind="stable")
    key = key[by_size]
    low = cols.least[cols.size[live]]
    most = np.floor(cols.left[live] * (1 + threshold) / threshold + 1e-9).astype(np.int64) - cols.size[live]
    at = np.searchsorted(key, group[live] << 32 | low, "left")
    end = np.searchsorted(key, group[live] << 32 | np.maximum(most, 0), "right")
    go = at < end
    live, at, end = live[go], at[go], end[go]
    while len(live):
        y = by_size[at]
        ok = y < live - NEAREST
        put(live[ok], y[ok])
        at += 1
        go = open_(live) & (at < end)
        live, at, end = live[go], at[go], end[go]
    x, y = np.concatenate(left), np.concatenate(right)
    return p[x], p[y], p[np.unique(x[~open_(x)])]


def _found(x: np.ndarray, y: np.ndarray | None = None, token: np.ndarray | None = None,
           kept: bytes | None = None) -> pa.RecordBatch:
    """Rows of ``FOUND``; what is not given is null."""
    def column(values: np.ndarray | None, name: str, kind: pa.DataType) -> pa.Array:
        return pa.nulls(len(x), kind) if values is None else pa.array(np.ascontiguousarray(values[name]), kind)

    open_ = pa.nulls(len(x), pa.binary()) if kept is None else pa.array([kept], pa.binary())
    token = pa.nulls(len(x), pa.int64()) if token is None else pa.array(np.ascontiguousarray(token["token"]).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [column(x, "doc", pa.int64()), column(x, "place", pa.int32()), column(y, "doc", pa.int64()),
         column(y, "place", pa.int32()), token, open_], [c.split()[0] for c in FOUND.split(", ")])


#: Pairs and open words, and once a group the packed postings of all its open words.
FOUND = f"{PAIRS}, open binary"


def _join(threshold: float, last: int):
    """First round: up to ``last`` candidates of a line under a word, and the postings of words with more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(raw.as_buffer()) for b in batches for raw in b["packed"]]
        if not parts:
            return
        p = np.concatenate(parts)
        x, y, more = candidates(p, threshold, last)
        yield _found(x, y)
        if len(more):
            yield _found(more, token=more)
            words = np.unique(more["token"])
            at = np.minimum(np.searchsorted(words, p["token"]), len(words) - 1)
            yield _found(more[:1], kept=_columns(p[words[at] == p["token"]]))
    return run


def _join_open(asking, threshold: float):
    """Second round: all candidates of the asking lines, from the postings that the first round kept.

    ``asking`` holds filters of the asking lines and of the words under which
    they ask. All postings of a word are in one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, tokens = asking.value
        for b in batches:
            for raw in b["open"]:
                p = _unpacked(raw.as_buffer())
                p = p[has_token(tokens, p["token"])]
                p["asks"] = in_bloom(lines, p["doc"], p["place"].astype(np.int64))
                if p["asks"].any():
                    x, y, _ = candidates(p, threshold, None)
                    yield _found(x, y)
    return run


def _word_sets(lines: list[str]) -> list[bytes]:
    """The sorted distinct word hashes of every line."""
    start, h, ends = _hashed(lines)
    owner = np.searchsorted(ends, start)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    one = np.ones(len(h), dtype=bool)
    one[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    raw, cut = h[one].tobytes(), (8 * np.searchsorted(owner[one], np.arange(len(lines) + 1))).tolist()
    return [raw[a:z] for a, z in zip(cut, cut[1:], strict=False)]


def _sets(asked):
    """Third pass: word sets of the lines that the filter lets through."""
    def out(doc: list[int], place: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()),
                                           pa.array(_word_sets(lines), pa.binary())], ["doc_id", "place", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = asked.value
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(in_bloom(table, ids, np.full(len(ids), -1))))
            doc, place, found, size = [], [], [], 0
            for ids, texts in _texts(b):
                lines, docs, places = _split_lines(ids, texts)
                if not lines:
                    continue
                for at in np.flatnonzero(in_bloom(table, np.array(docs, dtype=np.int64), np.array(places))).tolist():
                    doc.append(docs[at])
                    place.append(places[at])
                    found.append(lines[at])
                    size += len(lines[at])
                if size >= CHUNK_BYTES:
                    yield out(doc, place, found)
                    doc, place, found, size = [], [], [], 0
            if doc:
                yield out(doc, place, found)
    return run


def common_words(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many words each set of ``x`` shares with the set of ``y`` at its place."""
    size = [np.array([len(raw) >> 3 for raw in side], dtype=np.int64) for side in (x, y)]
    pair = np.concatenate([np.repeat(np.arange(len(n), dtype=np.uint64), n) for n in size])
    w = np.frombuffer(b"".join(x + y), dtype=np.uint64)
    bits = max(1, len(x).bit_length())
    key = pair << np.uint64(64 - bits) | w >> np.uint64(bits)     # one sort key: pair, leading bits of the word
    order = np.argsort(key)
    key, words = key[order], w[order]
    same = words[1:] == words[:-1]
    if ((key[1:] == key[:-1]) & ~same).any():
        order = np.lexsort((w, pair))
        words = w[order]
        same = words[1:] == words[:-1]
    pair = pair[order]
    same &= pair[1:] == pair[:-1]
    return np.bincount(pair[1:][same].astype(np.int64), minlength=len(x))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b["wx"].to_pylist(), b["wy"].to_pylist()
            both = np.array([len(i) + len(j) >> 3 for i, j in zip(x, y, strict=True)], dtype=np.int64)
            part = np.cumsum(both) * 8 // CHUNK_BYTES       # pairs of bounded words (a single one may be longer)
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(x)]
            common = np.concatenate([common_words(x[i:j], y[i:j]) for i, j in zip(cut, cut[1:], strict=False)])
            mask = pa.array(common >= threshold * (both - common) - 1e-9, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["xdoc"].filter(mask), b["xplace"].filter(mask)], ["doc_id", "place"])
    return run


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, place of the later lines of the pairs whose full word sets reach the threshold."""
    spark = docs.sparkSession
    ends = F.array(F.struct(F.col("xdoc").alias("doc_id"), F.col("xplace").alias("place")),
                   F.struct(F.col("ydoc").alias("doc_id"), F.col("yplace").alias("place")))
    wanted = staged(pairs.select(F.explode(ends).alias("e")).select("e.doc_id", "e.place").distinct(), "lines-wanted")
    asked = spark.sparkContext.broadcast(bloom_filter(with_documents(wanted)))
    sets = docs.mapInArrow(_sets(asked), "doc_id long, place int, words binary")
    sets = staged(sets.join(wanted, ["doc_id", "place"], "left_semi").dropDuplicates(["doc_id", "place"]), "line-words")
    x = sets.select(F.col("doc_id").alias("xdoc"), F.col("place").alias("xplace"), F.col("words").alias("wx"))
    y = sets.select(F.col("doc_id").alias("ydoc"), F.col("place").alias("yplace"), F.col("words").alias("wy"))
    both = pairs.join(x, ["xdoc", "xplace"]).join(y, ["ydoc", "yplace"]).select("xdoc", "xplace", "wx", "wy")
    return both.mapInArrow(_verify(threshold), "doc_id long, place int").distinct()


def similar_lines(docs: DataFrame, survey: DataFrame, threshold: float, min_words: int, hot: int = HOT,
                  tries: int = TRIES, counters: int = COUNTERS) -> DataFrame:
    """doc_id, place of posted lines that some earlier line matches."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(word_counts(survey, counters))
    # some nine words of a line are posted
    groups = max(1, -(-9 * survey.where("line is not null").count() // GROUP_POSTINGS))

    packed = docs.mapInArrow(_post(counts, threshold, min_words, hot, groups), "g long, packed binary")
    found = staged(packed.groupBy("g").applyInArrow(_join(threshold, tries), FOUND), "line-candidates")
    keys = ["xdoc", "xplace", "ydoc", "yplace"]

    def matches(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.select(*keys).distinct(), "line-pairs")
        return staged(verified(docs, pairs, threshold), "line-matches")

    good = matches(found.where("ydoc is not null"))
    lines = found.where("token is not null").select(F.col("xdoc").alias("doc_id"), F.col("xplace").alias("place"), "token")
    unsettled = staged(lines.join(good, ["doc_id", "place"], "left_anti"), "lines-open")
    if unsettled.isEmpty():
        return good
    asking = spark.sparkContext.broadcast((bloom_filter(unsettled), token_filter(unsettled)))
    rest = found.where("open is not null").select("open").mapInArrow(_join_open(asking, threshold), FOUND)
    return good.union(matches(rest)).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, min_words: int = MIN_WORDS, counters: int = COUNTERS) -> DataFrame:
    """doc_id, place, line (16-byte key), how of every line that goes: a copy of an earlier line, or similar to one."""
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = staged(rows.mapInArrow(_survey(counters), SURVEY), "line-survey")
    lines = survey.where("line is not null").select("line", "doc_id", "place")
    similar = similar_lines(rows, survey, threshold, min_words, counters=counters)
    firsts = lines.groupBy("line").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts.where("n > 1").select("line", "first"), "line-firsts")
    copies = lines.join(firsts, "line").where(F.struct("doc_id", "place") != F.col("first")).select(
        "doc_id", "place", "line", F.lit(False).alias("near"))
    near = lines.join(similar, ["doc_id", "place"]).select("doc_id", "place", "line", F.lit(True).alias("near"))
    # a posted copy can be similar too, and counts as a copy
    gone = copies.union(near).groupBy("doc_id", "place", "line").agg(F.min("near").alias("near"))
    return gone.select("doc_id", "place", "line", F.when(F.col("near"), "similar").otherwise("copy").alias("how"))


def document_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, copies, similar (lines that go, by how) and places (of these lines, in order)."""
    gone = repeated_lines(docs, id_col, text_col, threshold, min_words).groupBy("doc_id").agg(
        F.count_if(F.col("how") == "copy").alias("copies"), F.count_if(F.col("how") == "similar").alias("similar"),
        F.array_sort(F.collect_set("place")).alias("places"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(gone, "doc_id", "left").select(
        "doc_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("similar", F.lit(0)).alias("similar"),
        F.coalesce("places", F.array().cast("array<int>")).alias("places"))


def _without(text_col: str, chars_col: str | None, names: list[str], lines: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars = [], []
            old = b[chars_col].to_pylist() if chars_col else [None] * b.num_rows
            for text, gone, n in zip(b[text_col].to_pylist(), b[lines].to_pylist(), old, strict=True):
                if text is not None and gone:
                    drop = {(g["place"], g["line"]) for g in gone}
                    places = {p for p, _ in drop}
                    text = "\n".join(x for i, x in enumerate(text.split("\n"))
                                     if i not in places or (i, line_key(x)) not in drop)
                    n = len(text)
                texts.append(text)
                chars.append(n)
            out = {n: b[n] for n in names} | {text_col: pa.array(texts, b[text_col].type)}
            if chars_col:
                out[chars_col] = pa.array(chars, b[chars_col].type)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names)
    return run


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None,
                 threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents and columns, the texts without repeated lines; ``chars_col`` follows the text's length."""
    gone = repeated_lines(docs, id_col, text_col, threshold, min_words).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("place", "line")).alias("_gone"))
    key, lines = fresh(docs, "gone_id", "gone_lines")
    both = docs.join(gone.toDF(key, lines), F.col(id_col) == F.col(key), "left").drop(key)
    return both.mapInArrow(_without(text_col, chars_col, docs.columns, lines), docs.schema)
