"""Small tables for the training-data operators, with every kind of odd row."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi", "du", "pe"]
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices(words, k=n))
    line = say(60)
    texts = [None, "", "   \n\n", "one", "two words", say(30) + "\n" + line, say(5) + "\n" + line, say(40000),
             "x" * 30000, "é́ ſ İ 'S don't\x1c\x85  <|endoftext|> \U0001f600" + say(3)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(20 + i, say(rng.randint(1, 200)), None if i % 7 == 0 else "de", None, None) for i in range(40)]
    rows += [(70 + i, line, "fr", "hot", len(line)) for i in range(30)]
    rows += [rows[5], rows[5], (None, line, "en", "s", 3), (None, None, None, None, None), ((1 << 60) + 1, say(9), "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    return df.withColumns({"id": F.lit("x"), "rep": F.lit(1), "fp": F.lit(2), "kind": F.lit("k"), "label": F.lit(9),
                           "place": F.lit("p"), "line": F.lit(0.5), "_id": F.lit(3), "vec": F.lit("v")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
