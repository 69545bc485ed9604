"""Rasters derived from the benchmark tables, as pixel relations, with the
DuckDB text (samples: image_id, width, height, y, x, c, v) of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the images that one task makes pixels of.
IMAGES_OF_A_TASK = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows by image_id, so many of them to a task that its pixels (800 of an
    image at most) stay few: a small file of sizes or vectors is a single split
    but makes rows by the hundred. What groups or orders by image needs no
    shuffle of pixels after this."""
    rows = df.count()  # of a file: from its footer
    return df.repartition(max(1, min(rows, df.sparkSession.sparkContext.defaultParallelism), -(-rows // IMAGES_OF_A_TASK)), "image_id")


def _byte(e):
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 255 + 128))).cast("int")


def emb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 8x8 gray8."""
    df = _dealt(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")).select("image_id", F.posexplode("embedding").alias("p", "e"))
    return df.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.array(_byte(F.col("e"))).alias("px"))


def emb4(spark: SparkSession, sf_dir: str, floats: bool = False) -> DataFrame:
    """Each vector as 4x4 rgba8 (or rgbaf32)."""
    df = _dealt(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")).select("image_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    four = [F.col("embedding")[F.col("p") * 4 + k] for k in range(4)]
    px = F.array(*(four if floats else map(_byte, four)))
    return df.select("image_id", F.lit(4).alias("width"), F.lit(4).alias("height"), F.floor(F.col("p") / 4).cast("int").alias("y"), (F.col("p") % 4).cast("int").alias("x"), px.alias("px"))


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width and height of part_rgb."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").alias("width"), (1 + F.col("p_partkey") % 16).cast("int").alias("height"))


def part_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as p_size x (1 + p_partkey % 16) rgb8: many shapes."""
    df = _dealt(part_sizes(spark, sf_dir))
    df = df.withColumn("y", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))
    df = df.selectExpr("*", "case when (x div 8 + y div 8) % 2 = 0 then 60 else 0 end as ck")
    # samples as columns first: what reads px more than once then reads columns, not their terms again
    df = df.selectExpr("*", "cast((x * 255 div width + ck) % 256 as int) as r", "cast((y * 255 div height + ck) % 256 as int) as g", "cast((x ^ y) % 256 as int) as b")
    return df.selectExpr("image_id", "width", "height", "y", "x", "array(r, g, b) as px")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one-pixel frames on an 8x8 canvas."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image_id"), F.row_number().over(order).alias("frame_no"), (F.col("event_id") % 8).cast("int").alias("x"), F.expr("cast(event_id div 8 % 8 as int)").alias("y"),
        (F.col("event_id") % 4).cast("int").alias("disposal"), F.expr("cast(floor(value) % 256 as int)").alias("idx"),
    )


_EMB = "(SELECT vec_id, UNNEST(embedding) e, CAST(GENERATE_SUBSCRIPTS(embedding, 1) - 1 AS INT) p FROM embeddings)"
_QUANT = "CAST(LEAST(255, GREATEST(0, FLOOR(CAST(e AS DOUBLE) * 255 + 128))) AS INT)"
SQL = {
    "emb8": f"SELECT vec_id image_id, 8 width, 8 height, p // 8 y, p % 8 x, 0 c, {_QUANT} v FROM {_EMB}",
    "emb4": f"SELECT vec_id image_id, 4 width, 4 height, p // 16 y, (p // 4) % 4 x, p % 4 c, {_QUANT} v FROM {_EMB}",
    "emb4f": f"SELECT vec_id image_id, 4 width, 4 height, p // 16 y, (p // 4) % 4 x, p % 4 c, e v FROM {_EMB}",
    "part_rgb": """SELECT image_id, width, height, y, x, c, CAST(CASE c WHEN 0 THEN ((x * 255) // width + ck) % 256 WHEN 1 THEN ((y * 255) // height + ck) % 256 ELSE XOR(x, y) % 256 END AS INT) v
  FROM (SELECT *, UNNEST([0, 1, 2])::INT c FROM (SELECT *, CASE WHEN ((x // 8) + (y // 8)) % 2 = 0 THEN 60 ELSE 0 END ck
  FROM (SELECT image_id, width, height, y, UNNEST(RANGE(0, width))::INT x FROM (SELECT image_id, width, height, UNNEST(RANGE(0, height))::INT y
  FROM (SELECT p_partkey image_id, p_size width, CAST(1 + p_partkey % 16 AS INT) height FROM part)))))""",
    "event_frames": """SELECT user_id image_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) frame_no, CAST(event_id % 8 AS INT) x, CAST((event_id // 8) % 8 AS INT) y,
  CAST(event_id % 4 AS INT) disposal, CAST(CAST(FLOOR(value) AS INT) % 256 AS INT) idx FROM events""",
}
