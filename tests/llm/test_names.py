"""Extra columns whose names clash with an operator's own change no result."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, licenses, quality, toxicity

ROWS = [
    (1, "Released under the MIT License. " + "the of and to plain words " * 20, "en"),
    (2, licenses.TEMPLATES["MIT-grant"], "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "you are a loser and scum " * 3, "xx"),
    (5, "you are a loser and scum " * 3, "xx"),
]
#: Names of results, of steps on the way, and ones that need quoting.
CLASHES = ["kept", "n_words", "score", "predicted", "passages", "license", "feature", "toxic", "n", "key", "_key", "words", "doc_id_", "a.b", "a b", "`q`"]


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    wide = docs.select(F.lit("x").alias(CLASHES[0]), "*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES[1:])])
    return docs, wide


def rows(df, but=()):
    return sorted(repr(sorted((k, v) for k, v in r.asDict(recursive=True).items() if k not in but)) for r in df.collect())


def test_license_scans(both):
    docs, wide = both
    found = rows(licenses.scan(docs))
    assert found and rows(licenses.scan(wide)) == found


def test_quality_verdicts(both):
    docs, wide = both
    assert len(rows(quality.judge(docs))) == len(ROWS) and rows(quality.judge(wide)) == rows(quality.judge(docs))


def test_quality_keeps_the_columns_of_its_input(both):
    docs, wide = both
    kept = quality.keep(wide)
    assert kept.columns == wide.columns
    assert rows(kept, CLASHES) == rows(quality.keep(docs))
    assert all(r["kept"] == "x" and r["n_words"] == 0 for r in kept.collect())


def test_decontamination_keeps_the_columns_of_its_input(spark, both):
    docs, wide = both
    item = "you are a loser and scum you are a loser and scum"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontam.clean(wide, benchmark)
    assert clean.columns == wide.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 3, 4}
    assert rows(clean, CLASHES) == rows(decontam.clean(docs, benchmark))


def test_toxicity(spark, both):
    r = random.Random(2)
    plain = [" ".join(r.choice("some words of a calm and plain text here now".split()) for _ in range(30)) for _ in range(60)]
    texts = [(k, t + (" you loser scum you loser" if k % 3 == 0 else "")) for k, t in enumerate(plain)]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    clashing = train.select("*", F.lit(1).alias("toxic"), F.lit(2).alias("feature"), F.lit(3).alias("a.b"))
    again = toxicity.fit(clashing, labels.select("*", F.lit("t").alias("text"), F.lit(0).alias("n")))
    docs, wide = both
    assert len(rows(toxicity.score(docs, model))) == len(ROWS)
    assert rows(toxicity.score(wide, model)) == rows(toxicity.score(docs, model)) == rows(toxicity.score(docs, again))
