"""The segment scan takes every occurrence of a word."""

import pytest

from tessella.llm.toxicity import NEAR, Scorer, segments

ODDS = {"wloser": 3.0, "wscum": 2.0}


def found(text: str) -> list:
    n, marked = Scorer(ODDS, 0.3).scan(text.encode())
    return segments(marked, 0.3)


def test_a_second_passage_in_the_same_words_scores_alike():
    got = found("you loser scum " + "plain words here " * 30 + "you loser scum")
    assert [(a, z) for a, z, _ in got] == [(1, 2), (94, 95)] and got[0][2] == pytest.approx(got[1][2])


def test_scattered_mentions_do_not_use_up_a_dense_passage():
    filler = "plain " * (NEAR + 1)
    got = found(f"loser {filler} scum {filler} loser scum")
    assert max(s for *_, s in got) == pytest.approx(3.0 + 2.0 - 2 * 0.3)


def test_repeats_in_a_row_count_but_less_each_time():
    one, four = (max(s for *_, s in found(" ".join(["loser"] * k))) for k in (1, 4))
    assert one < four < 4 * one
