"""What the corpus operators share: the word pattern, shared-folder tables and checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shared import shared_folder, ship_package  # noqa: F401

#: A word: code points other than the six ASCII white-space characters (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


#: Spark removes the shuffle files of a query that has ended, as nothing reads them again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: cuts the lineage, survives lost
    executors, and gives the optimizer a measured size."""
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Empty tables that `stored` wrote and that nothing will read again."""
    for df in tables:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df._quillon_path)


#: Bytes that a broadcast may have, by the sizes of its columns' types (16 bytes for text).
BROADCAST_BYTES = 8_000_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether counting shows that the rows of `df` take at most BROADCAST_BYTES."""
    width = sum(16 if f.dataType.typeName() in ("string", "struct") else 8 for f in df.schema.fields) + 16
    most = BROADCAST_BYTES // width
    return df.limit(most + 1).count() <= most


def checked_broadcast(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it fits, otherwise `df` as it is (the join then shuffles, and adaptive execution splits skewed
    partitions)."""
    return F.broadcast(df) if fits_broadcast(df) else df


def unused(df: DataFrame, name: str) -> str:
    """A column name made of `name` that `df` hasn't got, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")

