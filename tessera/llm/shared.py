"""Helpers that the training-data operators have in common."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one where a session on one machine has
    none. On a cluster there is no folder to guess, so its lack is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends in files that outlive any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1, of a binary column; 20 hexadecimal digits make 16 characters."""
    digits = F.sha1(data)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(8):
        five = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(alphabet), (F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, max_bytes: int = 1 << 21):
    """(first row, bytes, offsets) of runs of whole rows, each of about max_bytes or of one longer row."""
    buf, off = as_bytes(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1)
        yield row, buf[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def spread_join(rows: DataFrame, side: DataFrame, on: str, by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """rows joined with a side that has one row for each key at most; the rows of one key are spread over salts tasks by
    the column by, and the side is sent to each of them."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(repeated, [on, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, group: str, order: str, value: str, out: str, ties: tuple[str, ...] = (), part_rows: int = 1 << 12) -> DataFrame:
    """df with out: the sum of value over the rows of the same group that come before, by the unsigned order of the
    64-bit hash in column order and then of ties.

    A group may be any share of the rows: its hash range is cut into parts whose number follows the number of rows
    (two windows: one over the parts' sums, one inside each part), so no task holds a whole group.
    """
    from pyspark.sql import Window as W

    rows = df.count()
    bits = max(4, min(40, int(np.ceil(np.log2(max(1, rows) / part_rows + 1))) + 4))
    part = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(2**63))), 64 - bits)
    cut = df.withColumn("_part", part)
    sums = cut.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    joined = cut.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    inside = W.partitionBy(group, "_part").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_g", "_p", "_base")
