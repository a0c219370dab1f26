"""Quality classifier by co-training of two views.

View one reads the text: symbol, digit and capital shares, repetition, variety,
word lengths. View two reads the page: language, source, length, and the layout
of lines. Each view has its own classifier, trained on a bounded labelled
sample. In each round each view labels the rows of a bounded unlabelled pool
that it is most sure of, and the other view trains on them too, at less weight.
Then each view is calibrated on labelled rows that trained neither, and the
calibrated logits are combined, also there. All documents are scored in one
pass over the data.

Defined results
* null or empty texts: features of the empty text;
* null language, source or length: a value of their own (length: the text's own);
* no labels, or labels of one class: the smoothed share of that class for all;
* null ids: scored, never train; repeated rows give repeated rows;
* empty table: empty result; extra columns are ignored (or kept, by ``keep_good``).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import held, staged
from cropframe.llm.sampling import Logistic, held_out, labelled_sample, sample_ids, sigmoid

MAX_TRAIN = 8_000
MAX_POOL = 8_000
ROUNDS = 4
SHARE = 0.05
SURE = 0.95
PSEUDO_WEIGHT = 0.3
HASHED = 16

LETTERS = re.compile(r"[^\W\d_]+")


def text_features(text: str) -> list[float]:
    """View one: what the text is made of."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 12
    size = len(text)
    counts = Counter(words)
    letters = sum(map(len, LETTERS.findall(text)))
    digits = sum(text.count(c) for c in "0123456789")
    spaces = size - sum(map(len, words))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(1 for w in counts if w[-1] in "!#$%&*@^~|") / len(counts)
    repeated = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [1 - (letters + spaces + digits) / size, digits / size, upper / n, marked, repeated / n,
            counts.most_common(1)[0][1] / n, len(counts) / n, np.log1p(len(counts) / np.sqrt(n)),
            (size - spaces) / n, sum(1 for w in words if len(w) == 1) / n,
            sum(1 for w in words if w[-1] in ".,;:?") / n, np.log1p(n)]


def page_features(text: str, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """View two: what is known about the page, and how its lines are laid out."""
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.array([len(x) for x in lines] or [0], dtype=np.float64)
    n = len(lines) or 1
    ends = sum(1 for x in lines if x.rstrip()[-1] in ".?!:\"”»") / n
    bars = sum(text.count(c) for c in "|\t;{}<>=") / (len(text) + 1)
    starts = sum(1 for x in lines if not x.lstrip()[0].isalnum()) / n
    hashed = np.zeros(2 * HASHED)
    hashed[zlib.crc32((lang or "").encode()) % HASHED] = 1
    hashed[HASHED + zlib.crc32((source or "").encode()) % HASHED] = 1
    chars = len(text) if n_chars is None else n_chars
    doubled = 1 - len(set(lines)) / n
    packed = len(zlib.compress(text.encode(), 1)) / (len(text) + 20)
    return [np.log1p(max(chars, 0)), np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.max()),
            (sizes < 40).mean(), sizes.std() / (sizes.mean() + 1), ends, 10 * bars, starts, doubled, packed,
            *hashed]


N_TEXT, N_PAGE = 12, 11 + 2 * HASHED


def curved(x: np.ndarray, plain: int) -> np.ndarray:
    """The first ``plain`` features with their squares and square roots, so that limits on both sides can be learned."""
    a = x[:, :plain]
    return np.hstack([x, a ** 2, np.sqrt(np.abs(a))])


@dataclass
class CoTrained:
    """Two calibrated views and their combination."""

    text: Logistic
    page: Logistic
    text_scale: Logistic
    page_scale: Logistic
    both: Logistic

    def probability(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        a = self.text_scale.logit(self.text.logit(curved(text, N_TEXT))[:, None])
        b = self.page_scale.logit(self.page.logit(curved(page, 11))[:, None])
        return sigmoid(self.both.logit(np.stack([a, b], axis=1)))


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, calibrate: np.ndarray,
             pool_text: np.ndarray, pool_page: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Train both views on the rows not in ``calibrate``, exchanging sure pseudo-labels from the pool."""
    views = [(curved(text, N_TEXT), curved(pool_text, N_TEXT)), (curved(page, 11), curved(pool_page, 11))]
    train = ~calibrate
    given: list[dict[int, int]] = [{}, {}]  # pool row -> pseudo-label that a view got from the other

    def fit(v: int) -> Logistic:
        x, pool = views[v]
        rows = sorted(given[v])
        both = np.vstack([x[train], pool[rows]])
        labels = np.concatenate([y[train], [given[v][r] for r in rows]])
        weight = np.concatenate([np.ones(train.sum()), np.full(len(rows), PSEUDO_WEIGHT)])
        return Logistic(both, labels, weight, l2=2.0)

    models = [fit(0), fit(1)]
    good = (y[train].sum() + 1) / (train.sum() + 2)
    for _ in range(rounds if len(pool_text) else 0):
        for v in (0, 1):
            p = sigmoid(models[v].logit(views[v][1]))
            fresh = np.array([r not in given[1 - v] for r in range(len(p))])
            for label, sure, share in ((1, p, good), (0, 1 - p, 1 - good)):
                take = np.argsort(-np.where(fresh, sure, -1), kind="stable")
                take = take[:max(1, int(SHARE * share * len(p)))]
                given[1 - v].update({int(r): label for r in take if fresh[r] and sure[r] >= SURE})
        models = [fit(0), fit(1)]
    held = calibrate if len(np.unique(y[calibrate])) == 2 else train
    scales = [Logistic(m.logit(x[held])[:, None], y[held]) for m, (x, _) in zip(models, views, strict=True)]
    z = np.stack([s.logit(m.logit(x[held])[:, None])
                  for s, m, (x, _) in zip(scales, models, views, strict=True)], axis=1)
    return CoTrained(models[0], models[1], scales[0], scales[1], Logistic(z, y[held]))


def _let_go() -> None:
    """Makes room for this operator's tasks in workers that served another one."""
    held("quality", dict)


def _vectors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    _let_go()
    texts = [t or "" for t in b["text"].to_pylist()]
    page = [page_features(t, a, s, n) for t, a, s, n in zip(
        texts, b["lang"].to_pylist(), b["source"].to_pylist(), b["n_chars"].to_pylist(), strict=True)]
    return (np.array([text_features(t) for t in texts], dtype=np.float64).reshape(-1, N_TEXT),
            np.array(page, dtype=np.float64).reshape(-1, N_PAGE))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, p = _vectors(b)
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["label"], pa.array(t.tolist(), pa.list_(pa.float64())),
             pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "t", "p"])


def _columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       F.col(chars_col).cast("long").alias("n_chars"))


NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", names: tuple[str, ...] = NAMES,
        max_train: int = MAX_TRAIN, max_pool: int = MAX_POOL, rounds: int = ROUNDS) -> CoTrained:
    """Fit on at most ``max_train`` labelled rows and ``max_pool`` others (features only reach the driver)."""
    rows = _columns(docs, *names)
    lab = labels.select(F.col("doc_id"), F.col(label_col).alias("quality"))
    train = labelled_sample(rows, lab, "quality", max_train, salt=3)
    # the pool: rows without a label, by the smallest hashes of all ids
    known = lab.select(F.col("doc_id").alias("_id")).distinct()
    free = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    picked = sample_ids(free.join(known, "_id", "left_anti"), "_id", max_pool, 9)
    pool = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")
    cols = ["doc_id", "text", "lang", "source", "n_chars", "label"]
    both = train.select(*cols).union(pool.withColumn("label", F.lit(None).cast("int")).select(*cols))
    got = staged(both.mapInArrow(_features, "doc_id long, label int, t array<double>, p array<double>"),
                 "quality-features").orderBy("doc_id").collect()
    t = np.array([r["t"] for r in got], dtype=np.float64).reshape(len(got), N_TEXT)
    p = np.array([r["p"] for r in got], dtype=np.float64).reshape(len(got), N_PAGE)
    has = np.array([r["label"] is not None for r in got], dtype=bool)
    y = np.array([r["label"] for r in got if r["label"] is not None], dtype=np.float64)
    calibrate = np.array([zlib.crc32(f"c{r['doc_id']}".encode()) % 4 == 0 for r in got], dtype=bool)[has]
    return co_train(t[has], p[has], y, calibrate, t[~has], p[~has], rounds)


def _score(model: CoTrained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.probability(*_vectors(b))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], ["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "quality",
          names: tuple[str, ...] = NAMES, **bounds: int) -> DataFrame:
    """doc_id, held_out, score (1: good), kept for every document."""
    model = fit(docs, labels, label_col, names, **bounds)
    found = _columns(docs, *names).mapInArrow(_score(model), "doc_id long, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= threshold).alias("kept"))


def _keep(model: CoTrained, names: tuple[str, ...], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view = pa.RecordBatch.from_arrays([b[n] for n in names], list(NAMES))
            yield b.filter(pa.array(model.probability(*_vectors(view)) >= threshold))
    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "quality",
              names: tuple[str, ...] = NAMES, **bounds: int) -> DataFrame:
    """The documents that reach the threshold, all columns kept, in one pass without a shuffle."""
    model = fit(docs, labels, label_col, names, **bounds)
    return docs.mapInArrow(_keep(model, names, threshold), docs.schema)
