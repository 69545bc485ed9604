"""What kind of image a file is, by its first bytes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signatures, in the order of the tests.
SIGNATURES = (
    ("png", 0, ("89504e470d0a1a0a",)), ("gif", 0, ("474946383761", "474946383961")), ("jpeg", 0, ("ffd8ff",)), ("tiff", 0, ("49492a00", "4d4d002a")),
)
BRANDS = ("avif", "mif1", "miaf", "MA1A", "MA1B", "avis")


def sniff(content: Column) -> Column:
    """The format's name, or null. File names play no part."""
    head = F.lower(F.hex(F.substring(content, 1, 64)))
    at = lambda first, n: F.substring(head, 2 * first + 1, 2 * n)
    found = F.lit(None).cast("string")
    ftyp = F.lit("66747970")
    brands = [F.lit(b.encode().hex()) for b in BRANDS]
    size = F.least(F.lit(64), F.conv(at(0, 4), 16, 10).cast("int"))
    listed = F.exists(F.sequence(F.lit(16), F.greatest(F.lit(16), size - 4), F.lit(4)), lambda k: (k + 4 <= size) & F.substring(head, 2 * k + 1, F.lit(8)).isin(*brands))
    tests = [("avif", (at(4, 4) == ftyp) & (at(8, 4).isin(*brands) | listed)), ("webp", (at(0, 4) == "52494646") & (at(8, 4) == "57454250"))]
    tests += [(name, F.greatest(*(at(k, len(m) // 2) == m for m in marks), F.lit(False))) for name, k, marks in reversed(SIGNATURES)]
    for name, test in tests:
        found = F.when(test, name).otherwise(found)
    return found


def format_of(data: bytes) -> str | None:
    """As sniff(), of bytes at hand."""
    for name, at, marks in SIGNATURES:
        if any(data[at:].startswith(bytes.fromhex(m)) for m in marks):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:8] == b"ftyp":
        size = min(64, int.from_bytes(data[:4], "big"), len(data))
        names = [data[8:12], *(data[k : k + 4] for k in range(16, size - 3, 4))]
        return "avif" if any(n.decode("latin1") in BRANDS for n in names) else None
    return None


def scan(spark: SparkSession, path: str) -> DataFrame:
    """image files below a path: path, length, format, content; bytes of files are
    read only if format or content is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", sniff(F.col("content")).alias("format"), "content")
