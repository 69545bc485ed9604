"""Short benchmark items are searched too."""

import random
import re

import pytest

from tessella.llm import decontam

ITEMS = [(1, "2+2=?"), (2, "why?"), (3, "who was she"), (4, "What is the sum of it?"), (5, "Name the largest planet of all"), (6, "  "), (7, None), (8, "Oslo"), (9, "what is the capital of Norway?")]
TEXTS = ["So 2+2=? is asked", "12+2=?", "But WHY? and why?", "ask who was she then", "who was shed", "well, what is the sum of it? ok", "what is the sun of it?", "name the largesst planet of all", "oslo", "Oslos", None, "", "nothing here", "Oslo Oslo", "What\nis the capital of norway? It is Oslo."]
WANT = {(0, 1), (2, 2), (3, 3), (5, 4), (6, 4), (7, 5), (8, 8), (13, 8), (14, 8), (14, 9)}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_short_items_are_reported(tables):
    got = decontam.leaks(*tables).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == WANT
    assert [(r["start"], r["end"]) for r in got if r["doc_id"] == 13] == [(0, 4), (5, 9)]
    assert {r["edits"] for r in got if r["doc_id"] in (6, 7)} == {1}


def test_their_documents_go(tables):
    assert {r["doc_id"] for r in decontam.clean(*tables).collect()} == set(range(len(TEXTS))) - {i for i, _ in WANT}


def test_exact_items_against_brute_force():
    r = random.Random(4)
    text = "".join(r.choice("ab ab.") for _ in range(6000))
    items = sorted({"".join(r.choice("ab ") for _ in range(r.randint(1, 15))).strip() for _ in range(400)} - {""})
    items += sorted({text[k : k + r.randint(8, 15)].strip() for k in r.sample(range(5900), 200)} - set(items))
    items = [t for t in items if t and t[0] != "." and t[-1] != "."]
    got = {m[:3] for m in decontam.matches(text.encode(), decontam.Patterns([(i, t.encode()) for i, t in enumerate(items)], 0.1, 400, 40))}
    want = {(i, m.start(), m.start() + len(t)) for i, t in enumerate(items) for m in re.finditer(f"(?=(?<![a-z]){re.escape(t)}(?![a-z]))", text)}
    assert {g for g in got if len(items[g[0]]) < decontam.Q} == {w for w in want if len(items[w[0]]) < decontam.Q}
    covered = lambda found: {(i, k) for i, a, z in found if len(items[i]) >= decontam.Q for k in range(a, z)}
    assert covered(got) == covered(want) and covered(got)  # places that overlap are reported as one
