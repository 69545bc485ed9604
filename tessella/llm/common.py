"""Helpers that the text operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Make sure checkpoints have a place: the cluster's own setting wins; a
    temporary folder is used only by a local session that names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessella-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so a
    lost executor costs a read, not the work so far."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cached(key, make):
    """A value that a Python worker keeps between tasks; of each kind (the first
    part of the key) only the last two used."""
    kept = sys.__dict__.setdefault("_tessella_kept", {})
    kept[key] = kept.pop(key) if key in kept else make()
    for old in [k for k in kept if k[0] == key[0]][:-2]:
        del kept[old]
    return kept[key]


def texts(column) -> list:
    """An Arrow string column as UTF-8 bytes objects, None for null."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def quoted(name: str) -> F.Column:
    """A column by its name as it stands, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def utf8(column: str | F.Column) -> F.Column:
    """A text column as bytes, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")


def rows_of(table_or_dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of plain Python lists."""
    return pa.RecordBatch.from_arrays([pa.array(table_or_dict[f.name], f.type) for f in schema], schema=schema)


#: What the calls of settled() that are under way have cut.
_under_way: list[list] = []


def settled(make) -> DataFrame:
    """The frame that make() returns, cut; tables cut on the way to it go."""
    mine: list = []
    _under_way.append(mine)
    try:
        out = make()
    finally:
        _under_way.pop()
    out = cut_table(out)
    for remove in mine:
        remove()
    return out


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), but as compressed Parquet in the same shared folder: for
    frames whose rows would make a large checkpoint. Removed at exit, or before
    by settled()."""
    import uuid

    spark = df.sparkSession
    shared_dir(spark)
    jvm, context = spark._jvm, spark.sparkContext
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm.System.gc()  # the plan just written is garbage; once it is collected, Spark drops its shuffle files

    def remove():
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has gone; its folder goes with it
            pass

    atexit.register(remove)
    if _under_way:
        _under_way[-1].append(remove)
    return spark.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs that judge keeps: judge() makes, in each task, a
    function from a record batch with `text` (and `lang`) to a list of booleans.
    All columns stay; the others travel by number, as Arrow stages take no name
    with a dot or a quote."""

    def run(batches):
        keep = judge()
        for b in batches:
            yield b.filter(pa.array(keep(b), pa.bool_()))

    plain = docs.toDF(*(c if c in ("text", "lang") else f"column{k}" for k, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
