"""Line dedup, toxicity and quality."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropframe.llm import line_dedup, quality, toxicity
from cropframe.llm.sampling import Logistic, sigmoid


def brute_lines(rows, threshold=0.8, min_words=5):
    """Places that go, per document: compared with every earlier line."""
    seen, out = [], {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: (r[0], r[1] or "")):
        for place, line in enumerate((text or "").split("\n")):
            words = frozenset(re.findall("[0-9a-z_\u0080-\U0010ffff]+", line.lower()))
            if len(words) < min_words:
                continue
            if any(len(words & s) >= threshold * len(words | s) - 1e-9 for s in seen):
                out.setdefault(doc, set()).add(place)
            seen.append(words)
    return {d: sorted(p) for d, p in out.items()}


@pytest.fixture(scope="module")
def near_lines(words):
    """Families of lines with edits, common words, hot copies."""
    rng = random.Random(9)
    common = words[:12]
    families = [rng.sample(words, rng.randint(5, 60)) for _ in range(12)]
    rows = []
    for doc in range(150):
        lines = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                f = list(rng.choice(families))
                for _ in range(rng.randint(0, 3)):
                    f[rng.randrange(len(f))] = rng.choice(words)
                lines.append(" ".join(f))
            elif kind < 0.6:
                lines.append(" ".join(rng.sample(common, rng.randint(4, 9))))
            elif kind < 0.7:
                lines.append("A common line, that stands in very many documents.")
            else:
                lines.append(" ".join(rng.choices(words, k=rng.randint(1, 30))))
        rows.append((doc * 7 % 150, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("hot, tries", [(4096, 4), (3, 1), (0, 2)])
def test_lines_match_brute_force(spark, near_lines, hot, tries, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEAREST", tries)
    df = spark.createDataFrame(near_lines, "doc_id long, text string").repartition(5)
    real = line_dedup.similar_lines
    monkeypatch.setattr(line_dedup, "similar_lines",
                        lambda *a, **k: real(*a, **(k | {"hot": hot, "tries": tries})))
    got = {r["doc_id"]: r["places"] for r in line_dedup.document_digest(df).collect() if r["places"]}
    assert got == brute_lines(near_lines)


def test_second_round_reads_the_first_ones_postings(spark, near_lines, monkeypatch):
    """Texts are split once for postings, whatever is left open; every word of a text has a hash of its own."""
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    df = spark.createDataFrame(near_lines, "doc_id long, text string").repartition(5)
    passes, real, post = [], line_dedup.similar_lines, line_dedup._post
    monkeypatch.setattr(line_dedup, "_post", lambda *a: passes.append(a) or post(*a))
    monkeypatch.setattr(line_dedup, "similar_lines", lambda *a, **k: real(*a, **(k | {"hot": 3, "tries": 1})))
    assert line_dedup.repeated_lines(df).where("how = 'similar'").count() > 0
    assert len(passes) == 1
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij", k=n)) for n in [*range(1, 70), 5_000] for _ in range(9)]
    texts += [t + "\u00e9" for t in texts]
    start, h = line_dedup.word_hashes("  ".join(texts).encode())
    raw = "  ".join(texts).encode()
    assert len(set(h.tolist())) == len(set(texts)) and all(raw[a - 1:a] in (b"", b" ") for a in start.tolist())
    one = {t: int(line_dedup.word_hashes(b"-" + t.encode() + b".")[1][0]) for t in texts}
    assert [one[t] for t in texts] == h.tolist()
    assert all(len(x) == 0 for t in (b"", b"\n", b"-- .") for x in line_dedup.word_hashes(t))


def test_odd_documents(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = brute_lines([tuple(r) for r in rows])
    got = {r["doc_id"]: r["places"] for r in line_dedup.document_digest(odd_docs).collect() if r["places"]}
    assert got == want
    kept = line_dedup.remove_lines(odd_docs, chars_col="n_chars")
    assert kept.columns == odd_docs.columns and kept.count() == len(rows)
    for r in kept.collect():
        olds = [x["text"] for x in rows if x["doc_id"] == r["doc_id"]]
        gone = set(want.get(r["doc_id"], ()))
        cut = [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) for t in olds]
        assert r["text"] in cut
        if gone:
            assert r["n_chars"] == len(r["text"])


def test_short_copies_go(spark):
    """Exact copies of lines under five words go; a floor of words counts repeats and unspaced characters."""
    rows = [(1, "Read more\n---\n\nok"), (2, "Read more\nread more\n---\n\nok"), (3, "ha " * 200),
            (4, "Ha " * 300), (5, "\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed"),
            (6, "\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed."), (7, "Read more"), (8, "ha"), (9, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["copies"], r["similar"], r["places"]) for r in line_dedup.document_digest(df).collect()
           if r["places"]}
    assert got == {2: (2, 0, [0, 4]), 4: (0, 1, [0]), 6: (0, 1, [0]), 7: (1, 0, [0])}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df).collect()}
    assert texts[2] == "read more\n---\n" and texts[7] == "" and texts[8] == "ha"


def test_automaton_matches_edit_distance():
    terms = [("idiot", False, 2.0), ("worthless", False, 3.0), ("lowei", True, 2.0), ("pathetisch", True, 1.5),
             ("bad", False, 1.0)]
    a = toxicity.LexiconAutomaton(terms)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    rng = random.Random(1)
    probes = [t for t, _, _ in terms]
    for t, _, _ in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "i", t[0]])
            probes.append("".join(w) + rng.choice(["", "", "schaft", "s"]))
    for w in probes:
        best = None
        for k, (t, stem, weight) in enumerate(terms):
            d = min(distance(w[:n], t) for n in range(len(w) + 1)) if stem else distance(w, t)
            if d <= toxicity.errors_allowed(t, stem):
                best = min(best or (99,), (d, -weight, k))
        assert a.match(w) == (None if best is None else (best[0], best[2])), w


def test_context_tells_quotation_from_abuse():
    m = toxicity.Matcher([("idiot", False, 2.0)])
    abuse = m.features("you are an idiot, go away")
    quoted = m.features('the report said that he wrote "idiot" on the wall')
    assert abuse[0] > 0 and abuse[3] == 0
    assert quoted[0] == 0 and quoted[3] > 0
    assert m.features("an 1diot here")[0] > 0 and m.features(None) == m.features("") and m.features("idea")[0] == 0


def labelled(spark, words, n=900):
    rng = random.Random(11)
    bad = ["zurkel", "frabnot", "quimble"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(20, 80)))
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                term = rng.choice(bad) if i % 12 else rng.choice(["zurkels", "frabmot", "quimbie"])
                text += f" you {term} " + rng.choice(words)
        good = int(i % 5 != 1)
        if not good:
            text = " ".join(w + "!!" for w in text.upper().split()) if i % 2 else text.replace(" ", "$$$ ")
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 10 != 9:
            labels.append((i, good, toxic))
    labels += [(None, 1, 1), (5000, 1, 0), (3, None, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows(spark, words, odd_docs):
    docs, labels = labelled(spark, words)
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = toxicity.score(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(r["score"] is not None for r in odd)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - toxic


def test_toxicity_scores_ignore_labels_of_held_out_rows(spark, words):
    docs, labels = labelled(spark, words, 300)
    from cropframe.llm.sampling import held_out
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda d: sorted((r["doc_id"], r["score"]) for r in d.collect())
    assert key(toxicity.score(docs, labels)) == key(toxicity.score(docs, turned))


def test_quality_on_held_out_rows(spark, words, odd_docs):
    docs, labels = labelled(spark, words)
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in got]) > 0.97
    assert quality.score(odd_docs, labels).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns


def test_co_training_passes_labels_between_views():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1200).astype(float)
    text = rng.normal(0, 1, (1200, quality.N_TEXT))
    page = rng.normal(0, 1, (1200, quality.N_PAGE))
    text[:, 0] += 3 * y
    page[:, 0] += 3 * y
    few = np.arange(60) % 4 == 0
    model = quality.co_train(text[:60], page[:60], y[:60], few, text[60:700], page[60:700])
    alone = quality.co_train(text[:60], page[:60], y[:60], few, text[:0], page[:0])
    score = lambda m: np.mean((m.probability(text[700:], page[700:]) > 0.5) == (y[700:] > 0.5))
    assert score(model) >= score(alone) - 0.01 and score(model) > 0.85


def test_empty_tables_and_missing_labels(spark, no_docs, odd_docs, words):
    docs, labels = labelled(spark, words, 60)
    assert toxicity.score(no_docs, labels).count() == 0
    assert quality.score(no_docs, labels).count() == 0
    assert line_dedup.document_digest(no_docs).count() == 0
    assert line_dedup.remove_lines(no_docs).count() == 0
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert quality.score(docs, none).count() == 60


def test_logistic_is_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < sigmoid(x @ [1.0, -2.0, 0.0] + 0.5)).astype(float)
    m = Logistic(x, y, l2=1e-6)
    p = sigmoid(m.logit(x))
    assert np.abs(x.T @ (p - y)).max() < 1e-2 and abs((p - y).sum()) < 1e-2
