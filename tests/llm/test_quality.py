"""Word divergence of short texts and of languages with few words."""

import random

import pytest

from tessella.llm import quality

COMMON = "the of and to in a is that for it as was with on by".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(COMMON) if r.random() < 0.5 else f"word{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('abcdefgh')}" for _ in range(n))


def junk(r: random.Random, n: int) -> str:
    return " ".join(f"item{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('abcdefgh')}" for _ in range(n))


@pytest.fixture(scope="module")
def kept(spark):
    r = random.Random(5)
    rows = [(k, prose(r, 200), "en") for k in range(60)]
    rows += [(100 + n, junk(r, n), "en") for n in range(50, 100, 7)] + [(200 + n, prose(r, n), "en") for n in range(50, 100, 7)]
    rows += [(300, junk(r, 70), "xx"), (301, junk(r, 300), "xx"), (302, prose(r, 70), "xx"), (303, prose(r, 300), None)]
    return {d["doc_id"]: d["kept"] for d in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}


def test_lists_of_50_to_99_words_go_and_prose_stays(kept):
    assert not any(kept[100 + n] for n in range(50, 100, 7))
    assert all(kept[200 + n] for n in range(50, 100, 7)) and all(kept[k] for k in range(60))


def test_a_thin_language_is_held_against_the_pool(kept):
    assert (kept[300], kept[301], kept[302], kept[303]) == (False, False, True, True)


def test_a_small_corpus_is_judged_too(spark):
    r = random.Random(6)
    rows = [(k, prose(r, 150), "en") for k in range(20)] + [(99, junk(r, 150), "en")]
    kept = {d["doc_id"]: d["kept"] for d in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [k for k, v in kept.items() if not v] == [99]
