"""Runs of words against the definition, tried at every place and period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from cropframe.llm import queries, runs


def brute(words):
    """Every stretch with smallest period q and max(6, 4q) words or more that no neighbour extends."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            if length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(rng):
    """Texts of few words, with repeated parts of all periods planted in them."""
    letters = [b"w%d" % i for i in range(rng.choice([1, 2, 3, 8, 60]))]
    words = rng.choices(letters, k=rng.randint(0, 60))
    for _ in range(rng.randint(0, 4)):
        period = rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 17, 23, 40]))
        words += (period * 7)[:rng.randint(1, 6 * len(period))] + rng.choices(letters, k=rng.randint(0, 30))
    return words


@pytest.mark.parametrize("seed", range(40))
def test_against_the_definition(seed):
    rng = random.Random(seed)
    texts = [sample(rng) for _ in range(12)]
    for text, got in zip(texts, runs.text_runs(texts), strict=True):
        assert got == brute(text)


def test_long_segments_and_nested_periods():
    unit = [b"a"] * 7 + [b"b"]
    big = (unit * 6 + [b"c"] * 3) * 5
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 700:
        fib = fib[1], fib[1] + fib[0]
    texts = [big, [], fib[1] * 5, [b"x"] * 900, (big + [b"d"]) * 4 + [b"x"] * 5, [b"q"] * 5, [b"q"] * 6]
    for text, got in zip(texts, runs.text_runs(texts), strict=True):
        assert got == brute(text)


def test_a_million_equal_words_take_no_square_of_their_number():
    assert runs.text_runs([[b"x"] * 1_000_000]) == [[(0, 1_000_000, 1)]]
    tail = [b"%d" % (i % 50_021) for i in range(400_000)]
    assert runs.text_runs([tail]) == [[(0, 400_000, 50_021)]]


def digest(doc_id, text):
    """The query's row by the definition."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def rows(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def saved(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_on_odd_rows(spark, odd_docs, tmp):
    rng = random.Random(9)
    more = [(i, " \x0b\t ".join(w.decode() for w in sample(rng)), "en", "s", 1) for i in range(500, 640)]
    more += [(700 + i, "  a\x1cb\x85 " * 9, "en", "s", 1) for i in range(12)]
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id <> 7")
    docs = odd_docs.unionByName(spark.createDataFrame(more, plain.schema), allowMissingColumns=True)
    docs = docs.where("doc_id is null or doc_id <> 7")  # 40,000 words are too long for the definition
    got = rows(queries.op13_runs(spark, saved(docs, tmp)))
    assert got == sorted((digest(r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_operator_returns_runs_and_texts(spark, odd_docs):
    got = runs.find_runs(odd_docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == odd_docs.count()
    one = spark.createDataFrame([(1, "x a b a b a b a b y")], "doc_id long, text string")
    r = runs.find_runs(one).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 8, 2)] and r["collapsed"] == "x a b y" and r["n_words"] == 10


def test_empty_table(spark, no_docs, tmp):
    assert queries.op13_runs(spark, saved(no_docs, tmp)).count() == 0


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r["text"] or "").split()) < 1500]
    got = {r[0]: r for r in rows(queries.op13_runs(spark, sf))}
    for r in docs:
        assert got[r["doc_id"]] == digest(r["doc_id"], r["text"])
