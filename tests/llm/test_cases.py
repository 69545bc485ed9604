"""Odd rows, odd tables and hot groups, and brute-force versions of what SQL
cannot say."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import chat, decontam, licenses, packing, quality, repeats, setjoin, sharding, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def prose(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join(r.choice(("the", "of", "and", "to", "in")) if r.random() < 0.4 else f"w{r.randrange(words)}" for _ in range(n))


# --- the join ---------------------------------------------------------------


def family(r: random.Random, n: int, size: int, edits: int) -> list[str]:
    base = [f"f{r.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(size)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def components_by_all_pairs(texts: dict, words: int, t: tuple[int, int]) -> dict:
    sets = {}
    for i, text in texts.items():
        w = (text or "").lower().split()
        sets[i] = ({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)}) if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and t[1] * len(sets[a] & sets[b]) >= t[0] * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_join_of_families_long_texts_and_shared_passages(spark):
    r = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = family(r, 40, 150, 2) + family(r, 30, 80, 3) + family(r, 3, 5000, 40)
    texts += [" ".join([prose(r, 80, 10**6), passage, prose(r, 80, 10**6)]) for _ in range(30)]
    texts += [texts[0]] * 5 + [None, "", " \n", "one", "One"]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS).repartition(5)
    want = components_by_all_pairs(dict(enumerate(texts)), 4, (85, 100))
    for cell in (4096, 7):
        assert {x["doc_id"]: x["component_id"] for x in setjoin.join_components(docs, cell=cell).collect()} == want


def test_large_token_groups_are_streamed():
    import numpy as np
    import pyarrow as pa

    token, n, key = np.repeat([1, 2, 3], [5, 500, 4]), np.tile([10], 509), np.arange(509)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 40]) for c in (token, n, key)], names=["token", "n", "key"]) for k in range(0, 509, 40)]
    got = pa.Table.from_batches(list(setjoin.shared_tokens(iter(batches), (85, 100), most=64)))
    assert sorted(got["key"].to_pylist()) == list(range(509))
    assert Counter(got["df"].to_pylist()) == {5: 5, 64: 500, 4: 4}


def test_one_of_each_keeps_one_row_of_a_group(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "c"), (None, text, "d"), (3, None, "x"), (3, None, "x"), (4, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `some.lang` string").repartition(3)
    kept = [tuple(x) for x in setjoin.one_of_each(docs).collect()]
    assert len([k for k in kept if k[1]]) == 1 and kept.count((3, None, "x")) == 2 and (4, "", "y") in kept and len(kept) == 4


# --- chat -------------------------------------------------------------------


def test_trees_with_branches_cycles_ties_and_repeats(spark):
    rows = [
        ("a", 0, None, "u", "hi", 1.0), ("a", 1, 0, "a", "x", 2.0), ("a", 2, 0, "a", "y", 5.0), ("a", 3, 2, "u", "z", 0.0), ("a", 3, 2, "u", "zz", 9.0),
        ("a", 7, 8, "c", "on a cycle", 1.0), ("a", 8, 7, "c", "on a cycle", 1.0), ("b", 5, 99, "u", "its parent is absent", None), (None, 1, None, "u", "no tree", 1.0), ("c", None, None, "u", "no node", 1.0),
    ]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(x["tree"], x["leaf"]): (x["rank"], x["score"], x["formatted"].count("<turn>")) for x in chat.format_trees(nodes).collect()}
    assert got == {("a", 3): (1, 2.0, 3), ("a", 1): (2, 1.5, 2), ("b", 5): (1, 0.0, 1), (None, 1): (1, 1.0, 1)}
    assert {(x["tree"], x["leaf"]) for x in chat.format_trees(nodes, top=1).collect()} == {("a", 3), ("b", 5), (None, 1)}
    assert chat.format_trees(nodes.limit(0)).collect() == []


def test_a_long_chain_is_one_conversation(spark):
    nodes = spark.range(300).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"), F.col("id").cast("double").alias("score"))
    (path,) = chat.format_trees(nodes).withColumn("turns", chat.read_turns("formatted")).collect()
    assert [t["text"] for t in path["turns"]] == [str(k) for k in range(300)] and path["score"] == pytest.approx(149.5)


# --- quality ----------------------------------------------------------------


def test_verdicts_do_not_depend_on_partitions(spark):
    r = random.Random(5)
    rows = [(k, prose(r, r.randint(0, 200)), r.choice(["en", "de", None]), "web", 0) for k in range(200)] + [(500, None, "en", "web", 0), (501, "", None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    assert rows_of(quality.judge(docs.coalesce(1))) == rows_of(quality.judge(docs.repartition(37)))


def test_symbols_lines_and_distances_against_plain_code(spark):
    r = random.Random(6)
    texts = [prose(r, 120).replace(" w1", "\nthe # w1").replace(" of", "\nsame line\n") for _ in range(12)]
    docs = spark.createDataFrame([(k, t, "en", "w", 0) for k, t in enumerate(texts)], DOCS)
    words = Counter(w for t in texts for w in t.lower().translate({ord(c): None for c in ".,;:!?"}).split())
    usual = sorted(words, key=lambda w: (-words[w], w.encode()))[:64]
    total = sum(words.values())
    q = [words[w] / total for w in usual] + [1 - sum(words[w] for w in usual) / total]
    import math

    for row in quality.judge(docs).collect():
        t = texts[row["doc_id"]]
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        lines = [x for x in t.split("\n") if x.strip()]
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        mine = Counter(t.split())
        n = sum(mine.values())
        p = [mine[w] / n for w in usual] + [1 - sum(mine[w] for w in usual) / n]
        half = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in a if x > 0)
        assert row["word_distance"] == pytest.approx(math.sqrt((half(zip(p, q)) + half(zip(q, p))) / 2), abs=1e-6)


# --- toxicity ---------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.select("doc_id", "toxic").filter(~out))
    done = toxicity.score(docs, model).join(labels, "doc_id").filter(out).groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in done}
    assert n[1, 1] >= 0.7 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


def test_segments_against_all_stretches():
    r = random.Random(2)
    for _ in range(200):
        scores = [r.choice([-1.0, -0.5, 0.7, 1.0, 2.0]) for _ in range(r.randint(1, 25))]
        best = max(sum(scores[a:z]) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1))
        found = toxicity.segments([(k, s) for k, s in enumerate(scores)], 0.0)
        assert max((s for *_, s in found), default=0.0) == pytest.approx(max(best, 0.0))
        for a, z, s in found:
            assert s == pytest.approx(sum(scores[a : z + 1])) and s > 0


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    done = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(done) == 4 and all(0 <= x["score"] <= 1 for x in done)


# --- licenses ---------------------------------------------------------------


def test_scan_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (4, "License MIT the under Released. Released under the MIT License.")], "doc_id long, text string")
    got = licenses.scan(docs).filter("license = 'MIT-notice'").groupBy("doc_id").count().collect()
    assert {x["doc_id"]: x["count"] for x in got} == {1: 2, 4: 1}
    assert licenses.scan(docs.limit(0)).collect() == []


def test_places_against_longest_common_subsequences():
    r = random.Random(1)
    known = licenses.Templates({"t": "a b c d e f g h"}, 0.75)
    for _ in range(300):
        words = [r.choice("abcdefghxyz") for _ in range(r.randint(0, 25))]
        found = known.scan(" ".join(words).encode())
        reach = lambda part: len(licenses.longest(part, list("abcdefgh"))) >= 6
        assert bool(found) == reach(words)
        for _, start, end, matched, _ in found:
            assert matched >= 6 and reach(" ".join(words)[start:end].split())


# --- shards, repeats, packing, tokens ---------------------------------------


def test_shards_of_repeated_rows_and_odd_names(spark):
    docs = spark.createDataFrame([(1, "a", 1)] * 40 + [(None, None, None)] * 3, "doc_id long, text string, `a.b` int").repartition(4)
    got = sharding.shard(docs, [1.0] * 5).collect()
    for s in {x["shard"] for x in got}:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    assert len({x["shard"] for x in got if x["doc_id"] == 1}) == 1 and {x["size"] for x in got} == {9, 8}


def removed(texts: list[bytes], length: int) -> list[bytes]:
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("memory", [64 << 20, 2000])
def test_repeats_that_spill_periodic_texts_and_odd_columns(spark, memory):
    r = random.Random(4)
    part = "".join(r.choices("abcdef ", k=500))
    texts = ["ab" * 300, "x" * 199, "x" * 200, part, part[:300] + "".join(r.choices("ghij ", k=300)) + part[100:], "".join(r.choices("ab", k=3000)), part[:199]]
    rows = [(k, t, "key", 1, None) for k, t in enumerate(texts)] + [(None, None, "key", 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, `a.b` int, kept int").repartition(3)
    got = {x["doc_id"]: x for x in repeats.remove_repeats(docs, memory=memory).collect()}
    want = removed([t.encode() for t in texts], 200)
    assert [bytes(got[k]["kept"]) for k in range(len(texts))] == want
    assert bytes(got[None]["kept"]) == b"" and got[0]["_key"] == "key" and got[0]["a.b"] == 1
    assert repeats.without_repeats(docs).columns == docs.columns


def test_packing_of_cut_documents_comes_near_the_bound(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(k, prose(r, r.choice([3, 50, 400, 900, 3000]))) for k in range(250)] + [(900, None)] * 3, "doc_id long, text string").repartition(3)
    placed = packing.pack(docs).collect()
    by: dict = {}
    for p in placed:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert p["length"] <= 2048 and (p["piece"] == 0 or p["length"] == 2048)
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    gaps: list[int] = []  # plain best fit, longest first
    for s in sorted((p["length"] for p in placed), reverse=True):
        best = min((g for g in gaps if g >= s), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((2048 if best is None else best) - s)
    assert max(p["piece"] for p in placed) > 1 and len(by) <= len(gaps)
    assert sum(p["doc_id"] == 900 for p in placed) == 3


def test_length_table_against_plain_counts(spark):
    r = random.Random(9)
    texts = [prose(r, r.randint(0, 3000)) for _ in range(60)] + [None, "", ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    encode = tokens.encoder(tokens.default_vocabulary())
    sizes = [len(encode(t)) if t else 0 for t in texts]
    table = tokens.context_table(tokens.length_histogram(docs))
    rows = {x["n_tokens"]: x for x in table.collect()}
    assert set(rows) == set(sizes)
    for limit, x in rows.items():
        inside = [s for s in sizes if s <= limit]
        assert (x["n_docs"], x["docs_over"], x["docs_within"], x["tokens_within"]) == (sizes.count(limit), len(sizes) - len(inside), len(inside), sum(inside))
        assert (x["tokens_total"], x["tokens_truncated"]) == (sum(sizes), sum(min(s, limit) for s in sizes)) and x["share_within"] == pytest.approx(len(inside) / len(sizes))
    for x in tokens.at_limits(table, [0, 17, 10**6]).collect():
        assert (x["docs_within"], x["tokens_truncated"]) == (sum(s <= x["context"] for s in sizes), sum(min(s, x["context"]) for s in sizes))
    assert {x["share"]: x["n_tokens"] for x in tokens.quantiles(table, [0.5, 1.0]).collect()} == {0.5: sorted(sizes)[(len(sizes) - 1) // 2], 1.0: max(sizes)}
    assert tokens.context_table(tokens.length_histogram(docs.limit(0))).collect() == []


# --- decontamination --------------------------------------------------------


def best_edits(item: str, text: str) -> int:
    """The fewest edits that turn the item into some stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != c), last[j] + 1, row[-1] + 1))
    return min(row)


def test_leaks_against_alignment_of_everything(spark):
    r = random.Random(12)
    items = [" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(12)) for _ in range(8)]
    texts = []
    for k in range(40):
        around = lambda: " ".join("".join(r.choices("klmnopqrst", k=5)) for _ in range(20))
        inside = list(items[k % 8])
        for _ in range(r.choice([0, 2, 5, 7, 9, 14])):
            inside[r.randrange(len(inside))] = r.choice("xyz")
        texts.append(f"{around()} {''.join(inside)} {around()}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)) * 2, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(docs, bench).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if best_edits(item, t) <= len(item) // 10}
    assert got == want and want


def test_two_places_close_together_are_both_reported(spark):
    item = " ".join(f"word{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{item}. {item}")], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((x["start"], x["end"]) for x in got) == [(0, len(item)), (len(item) + 2, 2 * len(item) + 2)]


# --- the pipeline -----------------------------------------------------------


def test_pipeline_against_plain_code(spark, tmp_path):
    r = random.Random(20)
    passage, item = prose(r, 90, 10**6), " ".join(f"q{k}" for k in range(30))
    texts = [prose(r, 150, 10**5) for _ in range(40)]
    texts += [f"{prose(r, 100, 10**5)} {passage} {prose(r, 100, 10**5)}" for _ in range(4)]
    texts += family(r, 4, 200, 2)[:0] + [" ".join([texts[0], "more"]), texts[1], f"{prose(r, 90, 10**5)} {item} {prose(r, 60, 10**5)}", "too short", None, ""]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {x["doc_id"]: texts[x["doc_id"]] for x in quality.judge(docs).filter("kept").collect()}
    groups = components_by_all_pairs(kept, 5, (80, 100))
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    ids = sorted(kept)
    kept = dict(zip(ids, (t.decode("utf-8", "ignore") for t in removed([kept[i].encode() for i in ids], 200))))
    kept = {i: t for i, t in kept.items() if item not in t}
    encode = tokens.encoder(tokens.default_vocabulary())
    assert {i: len(encode(t)) + 1 for i, t in kept.items()} == {i: sum(p["length"] for p in placed if p["doc_id"] == i) for i in {p["doc_id"] for p in placed}}
    assert len(kept) < len(texts) - 4 and 0 in kept and 40 in kept and len(kept[40]) < len(texts[40])
