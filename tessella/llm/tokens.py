"""Tokenizing with public vocabularies, and token counts.

Ids are those of the `tokenizers` library for a byte-level BPE file. Texts
made only of characters on which the two libraries' patterns agree (see
PLAIN) go through `tiktoken` with the same vocabulary as ranks, which gives the
same ids three times faster; all others, and texts that hold a special token's
string, go through `tokenizers` itself. A test compares both on every
character of PLAIN.

Token counts: an exact length histogram. Documents are counted by encoded
length; suffix sums over lengths then answer, for every context limit, how
many documents are longer, the total, the total after truncation, and
quantiles. Lengths are counted in the scan, so the shuffle holds one row for
each length and task. Suffix sums run in blocks of lengths, then over block
totals.

Defined results: a null or empty text has length 0; repeated rows count each;
an empty table gives an empty histogram; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cached, cut, rows_of

#: Characters on which the two pattern engines classify letters, digits and
#: white space alike.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(vocabulary: tuple[str, str]):
    """A function from a text to its ids as an unsigned 32-bit array."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(vocabulary[0])
        special = re.compile("|".join(re.escape(t.content) for t in exact.get_added_tokens_decoder().values()) or r"(?!)")
        with open(vocabulary[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if PLAIN.fullmatch(text) and not special.search(text):
                return np.array(fast.encode_ordinary(text), "<u4")
            return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")

        return encode

    return cached(("encoder", vocabulary), make)


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        encode, seen = encoder(vocabulary), Counter()
        for b in batches:
            seen.update(len(encode(t)) if t else 0 for t in b.column(0).to_pylist())
        yield rows_of({"n_tokens": list(seen), "n_docs": list(seen.values())}, pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    return docs.select(text).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_table(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For every length that occurs, taken as a context limit: n_docs of that
    length, docs_over (longer), docs_within, tokens_within (of documents that
    fit), tokens_total (of all), tokens_truncated (of all, cut at the limit)
    and share_within (the quantile that the length is)."""
    histogram = cut(histogram)  # read more than once below, and made by tokenizing every text
    rows = histogram.withColumn("_block", F.floor(F.col("n_tokens") / block)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each 1024 lengths
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("_block", F.coalesce(F.sum("_bd").over(later), F.lit(0)).alias("_ld"), F.coalesce(F.sum("_bt").over(later), F.lit(0)).alias("_lt"), F.sum("_bd").over(every).alias("_ad"), F.sum("_bt").over(every).alias("_at"))
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_od", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("_ot", F.coalesce(F.sum("_t").over(inside), F.lit(0))).join(sums, "_block")
    over, over_tokens = F.col("_od") + F.col("_ld"), F.col("_ot") + F.col("_lt")
    return rows.select(
        "n_tokens", "n_docs", over.alias("docs_over"), (F.col("_ad") - over).alias("docs_within"), (F.col("_at") - over_tokens).alias("tokens_within"), F.col("_at").alias("tokens_total"),
        (F.col("_at") - over_tokens + over * F.col("n_tokens")).alias("tokens_truncated"), ((F.col("_ad") - over) / F.col("_ad")).alias("share_within"),
    )


def at_limits(contexts: DataFrame, limits: list[int]) -> DataFrame:
    """docs_within, tokens_total and tokens_truncated at any context limits."""
    some = F.array(*(F.lit(int(x)).cast("long") for x in limits))
    held = contexts.select(F.explode(F.filter(some, lambda x: x >= F.col("n_tokens"))).alias("context"), F.struct("n_tokens", "docs_within", "docs_over", "tokens_within").alias("x"))
    none = F.lit(None).cast(held.schema["x"].dataType)
    wanted = contexts.sparkSession.createDataFrame([(int(x),) for x in limits], "context long").select("context", none.alias("x"))
    below = held.unionByName(wanted).groupBy("context").agg(F.max("x").alias("x"))
    total, docs = contexts.agg(F.max("tokens_total"), F.max("docs_within")).first()  # two numbers
    over = F.coalesce(F.col("x.docs_over"), F.lit(docs))
    return below.select("context", F.coalesce("x.docs_within", F.lit(0)).alias("docs_within"), F.lit(total).cast("long").alias("tokens_total"), (F.coalesce("x.tokens_within", F.lit(0)) + over * F.col("context")).alias("tokens_truncated"))


def quantiles(contexts: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that holds each share of the documents."""
    some = F.array(*(F.lit(float(x)) for x in shares))
    return contexts.select("n_tokens", F.explode(F.filter(some, lambda x: x <= F.col("share_within"))).alias("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
