"""What the operators share: scratch tables, column names that cannot clash, numbering of sorted rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SAMPLE_SEED = 3
#: Texts are handed to Python in batches of so many bytes (or one text).
BATCH_BYTES = 4 << 20
#: What tables_written() gives, the innermost last.
_collecting: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only where Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fieldsong-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def text_batches() -> SparkSession:
    """The active session, set to hand texts to Python in batches of BATCH_BYTES: rows alone would not bound a batch."""
    spark = SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, whole after the loss of an executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fieldsong/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    for tables in _collecting:
        tables.append(table)
    return table


@contextmanager
def tables_written() -> Iterator[list[DataFrame]]:
    """The tables that written() makes inside, to discard() them when nothing reads them any more."""
    _collecting.append([])
    try:
        yield _collecting[-1]
    finally:
        _collecting.pop()


def discard(*tables: DataFrame) -> None:
    """Delete written() tables that nothing reads any more, and have Spark's cleaner drop the shuffles of jobs that are over."""
    SparkSession.active()._jvm.System.gc()
    for df in tables:
        if path := getattr(df, "_scratch", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, whichever df has not (columns are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def share_of_each(by: Column, totals: dict, n: int, *key: Column) -> Column:
    """Whether a row is in a sample, drawn by a hash of its key, that holds n rows and more of each value of `by`.

    totals: how many rows each value has, for a bounded number of values. About 2 n + 200 rows of a value are in the
    sample however many it has, so that a hot value brings no more to one task than any other. Other values have no rows.
    """
    if not totals:
        return F.lit(False)
    scale = 1 << 31
    cuts = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, min(scale, (2 * n + 200) * scale // max(1, v)))])
    return F.coalesce(F.pmod(F.xxhash64(F.lit(SAMPLE_SEED), *key), F.lit(scale)) < F.element_at(cuts, by), F.lit(False))


def first_of_each(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of df of each value of `by`, in order."""
    nth = fresh(df, "first_nth")
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(nth) <= n).drop(nth)


def numbered(df: DataFrame, order: list[Column], parts: int, number: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """Number df's rows from 0 in a global sort order, and sum columns up to and with each row.

    Rows are dealt by range once and written; only one row a partition is summed up for the offsets.
    carry: name of a running total to the column that is summed.
    """
    carry = carry or {}
    part, row = fresh(df, "part_no"), fresh(df, "part_row")
    dealt = written(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(row))
    )
    sums = {name: F.sum(col) for name, col in carry.items()}
    of_part = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), *[s.alias(f"sum_{k}") for k, s in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select(
        F.col(part),
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("off_rows"),
        *[F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"off_{k}") for k in carry],
    )
    within = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.select("*", (F.row_number().over(Window.partitionBy(part).orderBy(row)) - 1).alias(f"in_{number}"), *[F.sum(col).over(within).alias(f"in_{k}") for k, col in carry.items()])
        .join(F.broadcast(offsets), part)  # one row a partition
        .select(*df.columns, (F.col("off_rows") + F.col(f"in_{number}")).cast("long").alias(number), *[(F.col(f"off_{k}") + F.col(f"in_{k}")).alias(k) for k in carry])
    )
