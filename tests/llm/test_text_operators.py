"""The text operators on small fixtures, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tessella.llm import catalog, chat, decontam, packing, quality, repeats, setjoin, sharding, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_texts(seed: int, n: int = 40) -> list:
    r = random.Random(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"word{k}" for k in range(300)]
    passage = " ".join(r.choices(words, k=70))
    out = [None, "", "   \n", "one", "a b c", "A b C"]
    while len(out) < n:
        text = " ".join(r.choices(words, k=r.randint(1, 250)))
        if r.random() < 0.3:
            at = r.randint(0, len(text))
            text = text[:at] + passage + text[at:]
        out.append(text)
        if r.random() < 0.4:
            near = text.split(" ")
            near[r.randrange(len(near))] = "other"
            out += [" ".join(near), text]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(some_texts(1))]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, words):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return set()
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)}


def test_join_against_all_pairs(docs):
    sets = {r["doc_id"]: shingles(r["text"], 4) for r in docs.collect()}
    up = {k: k for k in sets}

    def root(k):
        return k if up[k] == k else root(up[k])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.join_components(docs).collect()}
    assert got == {k: (len(s), root(k)) for k, s in sets.items()}


def test_small_cells_lose_no_link(docs):
    whole = {r["doc_id"]: r["component_id"] for r in setjoin.join_components(docs).collect()}
    assert whole == {r["doc_id"]: r["component_id"] for r in setjoin.join_components(docs, cell=2).collect()}


def test_repeats_against_all_windows(docs):
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    seen = Counter(t[k : k + 200] for t in data.values() for k in range(len(t) - 199))
    want = {}
    for i, t in data.items():
        gone = [False] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        want[i] = bytes(c for c, g in zip(t, gone) if not g)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs.select("doc_id", "text")).collect()}
    assert got == want and any(len(want[i]) < len(data[i]) for i in data)


def test_packing_places_every_token_once(docs):
    placed = packing.pack(docs).collect()
    encode = tokens.encoder(tokens.default_vocabulary())
    for i, text in ((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = [*encode(text or ""), 0]
        mine = sorted((p for p in placed if p["doc_id"] == i), key=lambda p: p["piece"])
        assert [p["start"] for p in mine] == [sum(q["length"] for q in mine[:k]) for k in range(len(mine))]
        assert sum(p["length"] for p in mine) == len(ids)
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[p["start"] : p["start"] + p["length"]]))
    by: dict = {}
    for p in placed:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_shards_are_gapless_and_grow_into_the_new_one(docs):
    got = sharding.shard(docs, [1.0] * 24).collect()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)


def test_base_counts(docs):
    import re

    texts = {d["doc_id"]: d["text"] or "" for d in docs.collect()}
    for r in quality.judge(docs).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(inside))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_empty_tables(none, spark):
    bench = spark.createDataFrame([(1, "some words " * 20)], "item_id long, text string")
    for made in (setjoin.join_components(none), repeats.remove_repeats(none.select("doc_id", "text")), packing.pack(none), sharding.shard(none, [1.0] * 3), quality.judge(none), decontam.leaks(none, bench)):
        assert made.collect() == []


def test_benchmark_copies_are_found(spark):
    words = random.Random(3).choices([f"term{k}" for k in range(500)], k=60)
    item, near = " ".join(words), " ".join(w if k != 30 else "changed" for k, w in enumerate(words))
    rows = [(1, "before " * 30 + item + " after" * 30, "en", "w", 0), (2, near, "en", "w", 0), (3, " ".join(random.Random(9).choices([f"x{k}" for k in range(500)], k=200)), "en", "w", 0), (4, None, "en", "w", 0)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(spark.createDataFrame(rows, DOCS), bench).collect()} == {1, 2}


def test_chat_reads_back_what_it_wrote(spark):
    odd = "<turn> \\n </turn> \\### \n Assistant:"
    turns = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    done = chat.format_trees(chat.turns_to_nodes(turns)).withColumn("turns", chat.read_turns("formatted"))
    got = {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in done.collect()}
    assert got == {1: [("user", odd), ("assistant", odd)], 2: [("user", "")]}


def test_sql_twin_of_chat(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    made = catalog.op1_chat_formatting(spark, sf)
    columns = sorted(made.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.OP1_SQL})").fetchall()
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(want)
    assert hashlib.sha256(b"").hexdigest() not in {r["turns_sha256"] for r in made.collect()}
