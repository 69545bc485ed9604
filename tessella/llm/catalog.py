"""The queries of the text operators and, where SQL can say it, their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, packing, quality, repeats, setjoin, sharding, tokens, toxicity
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    done = chat.format_trees(chat.turns_to_nodes(turns)).withColumn("turns", chat.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substr("formatted", s["start"], s["length"]))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(F.encode(learnt, "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, role r0, text x0, coalesce(role, '') r, coalesce(text, '') x FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok', CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) s(n)),
e AS (SELECT *, length(replace(replace(replace(x, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn')) lx,
  length(replace(replace(replace(replace(r, '\', '\b'), chr(10), '\n'), '<turn', '\lturn'), '</turn', '\l/turn')) lr FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, x0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, x0 NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(lx + lr + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 24).withColumn("law", F.lit("key"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), (n - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_table(tokens.length_histogram(table(spark, sf_dir, "documents")))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_license_scans, op3_quality_rules, op4_toxicity, op5_sharding, op6_suffix_array_dedup, op7_best_fit_packing, op8_benchmark_decontamination, op9_token_counts, op10_ngram_jaccard_join)
}
ORACLES = {"op1_chat_formatting": OP1_SQL}
