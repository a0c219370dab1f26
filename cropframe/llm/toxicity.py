"""Toxicity from a learned lexicon, matched by Levenshtein automata, read in context.

Lexicon. From a bounded sample of labelled training rows, words and word stems
(prefixes) are counted by the toxic and clean documents that hold them. Those
whose log-odds are high even at the lower end of their confidence interval
become entries of a trie, with that lower end as weight.

Matching. The Levenshtein automaton of every entry runs over the trie at once:
a state is the set of (trie node, errors so far), built only when a text leads
to it and then remembered, so a word costs one look-up a letter. Entries of
five letters or more bear one error, of nine or more two; stems one from seven.
A misspelling counts less than the term. Words that are near an entry but are
seen in clean training documents are no misspellings.

Context. Around each match a window of words is scored: quotation marks and
words of reporting speak for a quotation, direct address for abuse. The masses
of both kinds are separate inputs of a logistic regression, which gives the
score. Labels, language, source and id are never inputs.

Defined results
* null or empty texts, texts without words: the score of a text without matches;
* null ids: scored, not held out; repeated rows give repeated rows;
* very long texts: all words are read;
* no labels, or labels of one class: the smoothed share of that class for all;
* empty table: empty result; extra columns are ignored (or kept, by ``keep_clean``).
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import held, staged
from cropframe.llm.sampling import Logistic, held_out, labelled_sample, sigmoid

MAX_TRAIN = 10_000
MAX_CANDIDATES = 4_000
MAX_EXCEPTIONS = 50_000
PREFIXES = range(4, 9)
MIN_DOCS = 4
MIN_WEIGHT = 1.5
WINDOW = 8
DISCOUNT = 0.6
MEMO = 200_000

WORD = re.compile(r"[^\W_](?:[\w@$!*'’]*\w)?")
# Words of reporting and of direct address, by language.
REPORTING = frozenset("""said says say wrote writes called calls quote quoted quotes word term phrase reported
sagte sagt schrieb nannte nennt zitat zitiert wort begriff
dit disait écrit appelé appelle citation mot terme
dijo dice escribió llamó llama cita palabra término""".split())
ADDRESS = frozenset("""you your you're youre u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous
votre tú ti tus usted ustedes vosotros""".split())
OPENING, CLOSING, PLAIN = "“«„‹", "”»‟›", '"'


def errors_allowed(term: str, stem: bool) -> int:
    if stem:
        return int(len(term) >= 7)
    return int(len(term) >= 5) + int(len(term) >= 9)


class LexiconAutomaton:
    """The entries' Levenshtein automata over their common trie, made deterministic as texts need it."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.entries = entries
        self.child: list[dict[str, int]] = [{}]
        self.word_end: dict[int, int] = {}
        self.stem_end: dict[int, int] = {}
        self.reach = [0]  # the most errors that any entry below a node bears
        for k, (term, stem, _) in enumerate(entries):
            bears, node = errors_allowed(term, stem), 0
            self.reach[0] = max(self.reach[0], bears)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.reach.append(0)
                node = self.child[node][c]
                self.reach[node] = max(self.reach[node], bears)
            (self.stem_end if stem else self.word_end)[node] = k
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}, None)

    def _better(self, a: tuple[int, int] | None, b: tuple[int, int] | None):
        """Of two (errors, entry): fewer errors, then more weight, then the earlier entry."""
        if a is None or b is None:
            return a or b
        rank = lambda h: (h[0], -self.entries[h[1]][2], h[1])
        return min(a, b, key=rank)

    def _state(self, live: dict[int, int], stem: tuple[int, int] | None) -> int:
        """Number of the state: live nodes closed under skipped letters, and the best stem passed."""
        todo = list(live.items())
        while todo:
            node, e = todo.pop()
            if live.get(node) != e:
                continue
            if node in self.stem_end:
                k = self.stem_end[node]
                if e <= errors_allowed(*self.entries[k][:2]):
                    stem = self._better(stem, (e, k))
            for kid in self.child[node].values():
                if e + 1 <= self.reach[kid] and live.get(kid, 99) > e + 1:
                    live[kid] = e + 1
                    todo.append((kid, e + 1))
        key = (frozenset(live.items()), stem)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        live, stem = self.states[state]
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and out.get(node, 99) > e:
                out[node] = e

        for node, e in live:
            put(node, e + 1)  # a letter too many
            for letter, kid in self.child[node].items():
                put(kid, e + (letter != c))
        to = self.moves[state, c] = self._state(out, stem)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, entry) of the best entry for a whole word, or None."""
        if len(self.moves) > MEMO:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            to = moves.get((state, c))
            state = self._move(state, c) if to is None else to
            if not self.states[state][0]:
                return self.states[state][1]
        live, best = self.states[state]
        for node, e in live:
            k = self.word_end.get(node)
            if k is not None and e <= errors_allowed(*self.entries[k][:2]):
                best = self._better(best, (e, k))
        return best


class Matcher:
    """Scores matches of whole texts; one per Python worker and model."""

    def __init__(self, entries: list[tuple[str, bool, float]], exceptions: frozenset[str] = frozenset()):
        self.automaton = LexiconAutomaton(entries)
        self.entries, self.exceptions = entries, exceptions
        self.memo: dict[str, tuple[int, int] | None] = {}

    def hits(self, text: str) -> tuple[list[str], dict[str, tuple[int, int]]]:
        """Words of the text, and (errors, entry) of those that match."""
        words = WORD.findall(text.lower())
        found, memo = {}, self.memo
        for w in set(words):
            if w in memo:
                h = memo[w]
            else:
                if len(memo) > MEMO:
                    memo.clear()
                h = self.automaton.match(w) if self.entries else None
                if h and h[0] and w in self.exceptions:
                    h = None
                memo[w] = h
            if h:
                found[w] = h
        return words, found

    def features(self, text: str | None) -> list[float]:
        """Masses of abuse and of quotation, the strongest match, and lengths."""
        words, found = self.hits(text or "")
        abuse = quoted = top = 0.0
        if found:
            low = text.lower()
            spans = [(m.start(), m.group()) for m in WORD.finditer(low)]
            inside = quoted_spans(low)
            for i, (at, w) in enumerate(spans):
                h = found.get(w)
                if h is None:
                    continue
                value = self.entries[h[1]][2] * DISCOUNT ** h[0]
                near = {x for _, x in spans[max(0, i - WINDOW):i] + spans[i + 1:i + 1 + WINDOW]}
                # above 0 the window speaks for a quotation
                score = 2 * within(inside, at) + bool(near & REPORTING) - bool(near & ADDRESS)
                if score > 0:
                    quoted += value
                else:
                    abuse += value
                    top = max(top, value)
        n = len(words)
        return [np.log1p(abuse), top, np.log1p(100 * abuse / (n + 20)), np.log1p(quoted), np.log1p(n)]


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks, a line at most."""
    out, base = [], 0
    for line in text.split("\n"):
        opened = None
        for m in re.finditer("[“«„‹”»‟›\"]", line):
            c = m.group()
            if opened is None and (c in OPENING or c in PLAIN):
                opened = m.start()
            elif opened is not None and (c in CLOSING or c in PLAIN or c in OPENING):
                out.append((base + opened, base + m.start()))
                opened = None
        base += len(line) + 1
    return out


def within(spans: list[tuple[int, int]], at: int) -> bool:
    from bisect import bisect_right

    k = bisect_right(spans, (at, 1 << 62)) - 1
    return k >= 0 and spans[k][0] < at < spans[k][1]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem) with the toxic and clean documents that hold it, summed per batch."""
    for b in batches:
        counts = (Counter(), Counter())
        for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            terms = {(w, False) for w in words if 3 <= len(w) <= 40}
            terms |= {(w[:n], True) for n in PREFIXES for w in words if len(w) >= n}
            counts[int(label)].update(terms)
        keys = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            ["term", "stem", "toxic", "clean"])


def mine_lexicon(train: DataFrame) -> list[tuple[str, bool, float]]:
    """Entries (term, is stem, weight) from labelled documents."""
    n = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic_docs, clean_docs = n.get(1, 0), n.get(0, 0)
    if not toxic_docs or not clean_docs:
        return []
    counts = train.select("text", "label").mapInArrow(
        _count_terms, "term string, stem boolean, toxic long, clean long")
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic_docs + 1.0)) - F.log(b / (clean_docs + 1.0)) - 2 * F.sqrt(1 / a + 1 / b)
    found = (counts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where(F.col("toxic") >= MIN_DOCS).withColumn("weight", odds).where(F.col("weight") > MIN_WEIGHT)
             .orderBy((F.col("toxic") * F.col("weight")).desc(), "term", "stem").limit(MAX_CANDIDATES).collect())
    return select_entries([(r["term"], r["stem"], r["toxic"], r["weight"]) for r in found])


def select_entries(found: list[tuple[str, bool, int, float]]) -> list[tuple[str, bool, float]]:
    """Without stems that a longer entry says as well, and without entries that a kept stem says as well."""
    by_stem: dict[str, int] = {}
    for term, stem, toxic, _ in found:
        for n in PREFIXES:
            if len(term) > n or (len(term) == n and not stem):
                by_stem[term[:n]] = max(by_stem.get(term[:n], 0), toxic)
    kept: dict[tuple[str, bool], float] = {}
    order = sorted((f for f in found if not (f[1] and by_stem.get(f[0], 0) >= 0.9 * f[2])),
                   key=lambda f: (len(f[0]), not f[1], f[0]))
    for term, stem, _, weight in order:
        above = [kept.get((term[:n], True)) for n in range(1, len(term) + (not stem))]
        if all(w is None or w < weight - 0.25 for w in above):
            kept[term, stem] = weight
    return [(t, s, w) for (t, s), w in kept.items()]


def _matcher(model: bytes) -> Matcher:
    """One matcher for all tasks of a Python worker."""
    return held(("toxicity", model), lambda: Matcher(*pickle.loads(model)))


def _near_words(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(model)
        for b in batches:
            seen = Counter()
            for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                seen.update((w, int(label)) for w, h in m.hits(text or "")[1].items() if h[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in seen], pa.string()),
                 pa.array([n * k[1] for k, n in seen.items()], pa.int64()),
                 pa.array([n * (1 - k[1]) for k, n in seen.items()], pa.int64())], ["word", "toxic", "clean"])
    return run


def _features(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(model)
        for b in batches:
            x = [m.features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b["label"]], ["x", "label"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[bytes, Logistic]:
    """Lexicon with its exceptions, and the regression, from at most ``max_train`` labelled rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    train = staged(labelled_sample(rows, lab, "toxic", max_train).select("text", "label"), "toxic-train")
    entries = mine_lexicon(train)
    bare = pickle.dumps((entries, frozenset()))
    near = (train.mapInArrow(_near_words(bare), "word string, toxic long, clean long").groupBy("word")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where("clean > 0 and clean * 2 >= toxic").orderBy(F.desc("clean"), "word").limit(MAX_EXCEPTIONS))
    model = pickle.dumps((entries, frozenset(r["word"] for r in near.collect())))
    got = train.mapInArrow(_features(model), "x array<double>, label int").collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), 5)
    return model, Logistic(x, np.array([r["label"] for r in got], dtype=np.float64), l2=1.0)


def _scored(batches, model: bytes, fitted: Logistic, text_col: str):
    m = _matcher(model)
    for b in batches:
        x = np.array([m.features(t) for t in b[text_col].to_pylist()], dtype=np.float64).reshape(b.num_rows, 5)
        yield b, sigmoid(fitted.logit(x))


def _score(model: bytes, fitted: Logistic):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in _scored(batches, model, fitted, "text"):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], ["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model, fitted = fit(docs, labels, id_col, text_col, label_col, max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model, fitted), "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(model: bytes, fitted: Logistic, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in _scored(batches, model, fitted, text_col):
            yield b.filter(pa.array(s < threshold))
    return run


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept, in one pass without a shuffle."""
    model, fitted = fit(docs, labels, id_col, text_col, label_col, max_train)
    return docs.mapInArrow(_keep(model, fitted, text_col, threshold), docs.schema)
