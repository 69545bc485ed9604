"""Toxicity: maximum-scoring segment search.

Fit. Log-odds of words and of their 4- and 5-letter beginnings come from
labelled rows only, under a Dirichlet prior of `prior` pseudo-counts that is
spread over the classes by their sizes, so an unseen feature has odds 1.
Counts are of texts that hold a feature. Features in under `least` texts or
under `z` standard errors (there are millions of features to be wrong about) are
dropped. A
word's score is its strongest feature, every other word costs `drift`. Every
occurrence scores. In a run of one word, whose occurrences stand at most `NEAR`
words apart, the first k together count log2(1 + k) times, as they are not k
independent pieces of evidence; a word that comes back later speaks in full.

Scan. A linear pass over the words (Ruzzo and Tompa's stack of partial sums)
finds all maximal segments, each a passage whose score cannot be raised by
making it longer or shorter.

Calibration. For random text the best segment of n words follows an
extreme-value law: P(S > s) = 1 - exp(-K n exp(-lambda s)). lambda solves
E[exp(lambda score)] = 1 over the words of the non-toxic labelled rows, K comes
from the mean of their best segments. Every segment with lambda s > ln(K n) is
significant; the document's statistic is the sum of those excesses, and a
one-feature logistic curve over it, fitted on binned counts of the labelled
rows, gives the probability.

The fit takes at most `sample` labelled rows, the first by a hash of the id.
That bound makes the table of ids safe to broadcast, so no text is shuffled;
the model holds at most `features` features. Every document is scored where it
lies.

Defined results: a null or empty text scores as a text without segments; a
null doc_id is scored, never learnt; conflicting labels of one id count as
toxic if any does; null labels are left out; repeated rows are scored each;
without labelled rows of both classes every score is 0.5; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_table, rows_of, texts

PUNCTUATION = b".,;:!?#$%&*|\"()'<>-"
BINS = 400
NEAR = 20


def words_of(text: bytes) -> list[str]:
    return text.translate(None, PUNCTUATION).decode("utf-8", "replace").lower().split()


def features_of(word: str) -> list[str]:
    out = ["w" + word]
    if len(word) > 5:
        out.append("5" + word[:5])
    if len(word) > 4:
        out.append("4" + word[:4])
    return out


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text
    whose words cost `drift` each but for those in scores (place, score)."""
    out: list[list] = []  # [sum before, sum after, first, last]
    total, last = 0.0, -1
    for at, score in scores:
        total -= drift * (at - last - 1)
        last = at
        if score <= 0:
            total += score
            continue
        new = [total, total + score, at, at]
        total += score
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][0] >= new[0]:
                k -= 1
            if k < 0 or out[k][1] >= new[1]:
                out.append(new)
                break
            new = [out[k][0], new[1], out[k][2], new[3]]
            del out[k:]
    return [(a, b, hi - lo) for lo, hi, a, b in out]


class Scorer:
    """The log-odds of words, kept for words seen before."""

    def __init__(self, odds: dict[str, float], drift: float):
        self.odds, self.drift, self.known = odds, drift, {}

    def of(self, word: str) -> float | None:
        found = [x for x in map(self.odds.get, features_of(word)) if x is not None]
        return max(found, key=abs) if found else None

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, float]]]:
        words, known = words_of(text), self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.of(w)
        marked, runs = [], {}
        for i, s in enumerate(map(known.__getitem__, words)):
            if s is not None:
                last, k = runs.get(words[i], (-NEAR - 1, 0))
                k = k + 1 if i - last <= NEAR else 1
                runs[words[i]] = i, k
                marked.append((i, s * (math.log2(1 + 1 / k) if k > 1 else 1.0) - self.drift))
        return len(words), marked


def excess(found: list[tuple[int, int, float]], n: int, model: dict) -> float:
    least = max(0.0, math.log(max(model["k"] * n, 1e-9)))
    return sum(max(0.0, model["lambda"] * s - least) for _, _, s in found)


def _lambda(score: np.ndarray, share: np.ndarray) -> float:
    lo, hi = 1e-6, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * score, 600))).sum()) - 1
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope."""
    a, b = math.log((n1.sum() + 1) / (n0.sum() + 1)), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        n, g = n1 + n0, n1 - (n1 + n0) * p
        w = n * p * (1 - p) + 1e-9
        grad, hess = np.array([g.sum(), (g * x).sum() - 0.01 * b]), np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = 200_000, features: int = 200_000, prior: float = 1.0, least: int = 8, z: float = 4.5, drift: float = 0.3) -> dict:
    """labels: doc_id, toxic (0 or 1), the rows that may be learnt from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = cut_table(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"))  # at most `sample` ids

    def count(batches):
        seen = {0: Counter(), 1: Counter()}

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            out = rows_of({"feature": keys, "y1": [seen[1][k] for k in keys], "y0": [seen[0][k] for k in keys]}, pa.schema([("feature", pa.string()), ("y1", pa.int64()), ("y0", pa.int64())]))
            seen[0].clear()
            seen[1].clear()
            return out

        for b in batches:
            for text, toxic in zip(texts(b.column(0)), b.column(1).to_pylist()):
                found = set(words_of(text or b""))  # texts that hold it, not times said
                seen[int(toxic == 1)].update({f for w in found for f in features_of(w)})
                seen[int(toxic == 1)]["n"] += len(found)
                if len(seen[0]) + len(seen[1]) > 600_000:
                    yield flush()
        yield flush()

    table = train.mapInArrow(count, "feature string, y1 long, y0 long").groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).filter(F.col("y1") + F.col("y0") >= least)
    if not (n := table.filter("feature = 'n'").first()) or not n.y1 or not n.y0:
        return {}
    ratio, n1, n0 = n.y0 / n.y1, n.y1, n.y0
    y1, y0 = F.col("y1") + prior, F.col("y0") + prior * ratio
    odds = F.log(y1 / (n1 + prior)) - F.log(y0 / (n0 + prior * ratio))
    kept = table.filter("feature <> 'n'").select("feature", odds.alias("odds"), (F.abs(odds) / F.sqrt(1 / y1 + 1 / y0)).alias("z")).filter(F.col("z") >= z).orderBy(F.desc("z"), "feature").limit(features)
    model = {"odds": {f: s for f, s in kept.select("feature", "odds").toLocalIterator()}, "drift": drift}

    def background(batches):
        scorer, seen, best = Scorer(model["odds"], drift), Counter(), []
        for b in batches:
            for text, toxic in zip(texts(b.column(0)), b.column(1).to_pylist()):
                if toxic != 1:
                    length, marked = scorer.scan(text or b"")
                    if length:
                        seen[-drift] += length - len(marked)
                        seen.update(round(s, 1) for _, s in marked)
                        best.append((max((s for _, _, s in segments(marked, drift)), default=0.0), math.log(length)))
        yield rows_of({"score": list(seen) + [None], "n": list(seen.values()) + [len(best)], "best": [0.0] * len(seen) + [sum(x for x, _ in best)], "logs": [0.0] * len(seen) + [sum(x for _, x in best)]}, pa.schema([("score", pa.float64()), ("n", pa.int64()), ("best", pa.float64()), ("logs", pa.float64())]))

    rows = train.mapInArrow(background, "score double, n long, best double, logs double").groupBy("score").agg(F.sum("n"), F.sum("best"), F.sum("logs")).collect()
    scores = np.array([(r[0], r[1]) for r in rows if r[0] is not None], float).reshape(-1, 2)
    documents, best, logs = next((r[1], r[2], r[3]) for r in rows if r[0] is None)
    model["lambda"] = _lambda(scores[:, 0], scores[:, 1] / scores[:, 1].sum())
    # mean of the law: (ln(K n) + Euler's constant) / lambda
    model["k"] = math.exp(min(20.0, max(-20.0, (model["lambda"] * best - logs) / documents - 0.5772156649)))

    def statistic(batches):
        scorer, seen = Scorer(model["odds"], drift), Counter()
        for b in batches:
            for text, toxic in zip(texts(b.column(0)), b.column(1).to_pylist()):
                length, marked = scorer.scan(text or b"")
                seen[min(BINS - 1, int(40 * math.log1p(excess(segments(marked, drift), length, model)))), int(toxic == 1)] += 1
        yield rows_of({"bin": [k[0] for k in seen], "toxic": [k[1] for k in seen], "n": list(seen.values())}, pa.schema([("bin", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]))

    n = np.zeros((2, BINS))
    for at, toxic, k in train.mapInArrow(statistic, "bin int, toxic int, n long").groupBy("bin", "toxic").agg(F.sum("n")).collect():
        n[toxic, at] = k
    model["a"], model["b"] = _logistic((np.arange(BINS) + 0.5) / 40, n[1], n[0])
    return model


def score(docs: DataFrame, model: dict, least: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and the significant passages of every text, as
    first word, last word (from 0) and excess over the extreme-value level."""

    def run(batches):
        scorer = Scorer(model["odds"], model["drift"]) if model else None
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                if scorer is None:
                    out.append((i, 0.5, int(0.5 >= least), []))
                    continue
                n, marked = scorer.scan(text or b"")
                found = segments(marked, model["drift"])
                x = (int(40 * math.log1p(excess(found, n, model))) + 0.5) / 40
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model["a"] + model["b"] * x))))
                level = max(0.0, math.log(max(model["k"] * n, 1e-9)))
                out.append((i, p, int(p >= least), [{"first": a, "last": z, "excess": model["lambda"] * s - level} for a, z, s in found if model["lambda"] * s > level]))
            columns = list(zip(*out)) or [()] * len(SCORED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORED)], schema=SCORED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<first:int,last:int,excess:double>>")


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("excess", pa.float64())])))])


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
