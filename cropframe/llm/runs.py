"""Periodic runs of words: stretches that repeat one group of words over and over.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least max(6, 4 q) words, which no neighbouring word
extends. Every word of a run stands in it at least four times (six times where
q = 1), so a word that occurs fewer than four times in a segment can't lie in a
run there: such words split the segment, the counts are taken anew inside every
part, and so on until no part loses a word. What survives is scanned lag by
lag. Splitting never cuts a run, so a run found in a segment is maximal in the
whole text.

The lag scan compares a surviving segment with itself, shifted by q: at every
place for short lags, else at every q-th place only: a run covers two or more
such places. What is compared there is not the single word but the window of
2^k <= q words that starts there (windows are numbered once for each k), so that
a place which matches is hardly ever a coincidence; around matching places the
words are compared one by one. That takes n/q steps for lag q, n log n for all, and
gives exactly the runs of the full comparison.

Defined results
* Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte. A null, empty or
  blank text has no words, no runs and an empty collapsed text.
* Every row is judged by itself: repeated rows, repeated and null ids return
  one result each, and an empty table an empty result.
* Only the id and the text are read, so further columns may have any name.
* Whole texts are read, whatever their length; a task splits a batch of texts
  together, some million words at a time, and a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least words of a run, least periods of a run.
LEAST, TIMES = 6, 4

#: Lags up to this are scanned word by word.
SHORT = 16

#: Words that a task splits together.
GROUP = 1_000_000

Run = tuple[int, int, int]  # start, length, period


def surviving(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words left by recursive frequency splitting, and the segment of each.

    ``segment`` numbers the texts that ``words`` are joined from; it rises.
    """
    at = np.arange(len(words))
    while len(at):
        # a segment ends where the text ends or a word between was taken out
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(segment[at]) > 0)
        part = np.cumsum(new) - 1
        size = np.bincount(part)
        key = part * np.int64(words.max() + 1) + words[at]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = (count[back] >= TIMES) & (size[part] >= LEAST)
        if stays.all():
            return at, part
        at = at[stays]
    return at, at


def _near(words: np.ndarray, q: int) -> list[Run]:
    """Qualifying runs of a short lag by comparing all words; those with a shorter lag are left out."""
    same = np.flatnonzero(np.diff(np.r_[0, (words[:-q] == words[q:]).astype(np.int8), 0]))
    out = []
    for start, end in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
        length = end - start + q
        if length >= max(LEAST, TIMES * q):
            # over four periods, a shorter lag would have to divide this one
            part = words[start:start + length]
            if not any(q % d == 0 and (part[d:] == part[:-d]).all() for d in range(1, q)):
                out.append((start, length, q))
    return out


def _stretch(words: np.ndarray, q: int, h: int) -> tuple[int, int]:
    """First and last + 1 place of the stretch of words equal to those q later that holds place h."""
    n, lo, hi, step = len(words), h, h, q
    while lo and words[lo - 1] == words[lo - 1 + q]:
        back = max(0, lo - step)
        differ = np.flatnonzero(words[back:lo] != words[back + q:lo + q])
        lo, step = (back + int(differ[-1]) + 1, step) if len(differ) else (back, 2 * step)
    step = q
    while hi + q < n and words[hi] == words[hi + q]:
        on = min(n - q, hi + step)
        differ = np.flatnonzero(words[hi:on] != words[hi + q:on + q])
        hi, step = (hi + int(differ[0]), step) if len(differ) else (on, 2 * step)
    return lo, hi


def lag_scan(words: np.ndarray) -> list[Run]:
    """All runs of one segment, by start, then period."""
    n, found, window, numbered = len(words), [], 1, words
    for q in range(1, min(SHORT, n // TIMES) + 1):
        found += _near(words, q)
    known = np.array(found, dtype=np.int64).reshape(-1, 3)
    for q in range(SHORT + 1, n // TIMES + 1):
        while 2 * window <= q:  # number the windows of twice the length
            pair = numbered[:-window].astype(np.int64) * (int(numbered.max()) + 1) + numbered[window:]
            numbered = np.unique(pair, return_inverse=True)[1]
            window *= 2
        probe = numbered[::q]
        hit = probe[1:] == probe[:-1]  # the window at i * q equals the one q words on
        if not hit.any():
            continue
        # a known run whose period divides q holds all that its own places could show at lag q
        known = known[known[:, 1] > q]
        own = known[q % known[:, 2] == 0]
        if len(own):
            cover = np.zeros(len(hit) + 2, dtype=np.int64)
            np.add.at(cover, np.minimum(-(-own[:, 0] // q), len(hit)), 1)
            np.add.at(cover, np.minimum((own[:, 0] + own[:, 1] - q) // q + 1, len(hit)), -1)
            hit &= np.cumsum(cover)[:len(hit)] <= 0
        done, fresh = 0, []
        for h in (np.flatnonzero(hit) * q).tolist():
            if h >= done:
                lo, hi = _stretch(words, q, h)
                done = hi
                if hi - lo + q >= max(LEAST, TIMES * q):
                    fresh.append((lo, hi - lo + q, q))
        if fresh:
            found += fresh
            known = np.concatenate([known, np.array(fresh, dtype=np.int64)])
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as its words."""
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t], dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    out: list[list[Run]] = [[] for _ in texts]
    at, part = surviving(flat, np.repeat(np.arange(len(texts)), sizes))
    if len(at):
        cut = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            first = int(at[lo])
            text = int(np.searchsorted(start, first, side="right")) - 1  # of equal starts the last has words
            out[text] += [(first - int(start[text]) + s, n, q) for s, n, q in lag_scan(flat[at[lo:hi]])]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def result(ids: list[int], texts: list[list[bytes]], batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = text_runs(texts)
        named = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        text = pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())),
                                           pa.array([len(t) for t in texts], pa.int64()), pa.array(named, kind), text],
                                          ["id", "n_words", "runs", "collapsed"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or b"").split()  # bytes split at 20 and 09 to 0D alone
            if ids and size + len(words) > GROUP:
                yield result(ids, texts, batch)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(words)
            size += len(words)
        if ids:
            yield result(ids, texts, batch)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """id, n_words, runs (by start, then period) and the collapsed text of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"))
    rows = rows.mapInArrow(_find, f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return rows.select(F.col("id").alias(id_col), "n_words", "runs",
                       F.col("collapsed").cast("string").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, exact; ties: smallest start, then period. Null without runs."""
    def better(best: Column, run: Column) -> Column:
        left, right = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (left > right), run).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
