"""The session store as a sink: events, messages and artifacts, numbered within their session, each batch written exactly once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a message that a session shows as its summary (fixed value).
SUMMARY = 120
_LEDGER = "stream string, batch long, rows long"


def safe_path(path: Column) -> Column:
    """A relative path with `.`, `..` and repeated slashes walked and backslashes as slashes; null if it leads outside, or nowhere."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda p: ~p.isin("", "."))
    # A step outside stays as a mark that no later step can take back.
    none = F.array().cast("array<string>")
    out = F.lit("..")
    step = lambda a, p: F.when(F.get(a, F.lit(0)) == out, a).when(p != out, F.array_append(a, p)).when(F.size(a) == 0, F.array(out)).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
    walked = F.aggregate(parts, none, step)
    return F.when((F.size(walked) > 0) & (F.get(walked, F.lit(0)) != out), F.array_join(walked, "/"))


class Store:
    """A table of rows by session under a folder that all machines share.

    A batch is written to a folder named after its stream and number, then entered in the ledger; only entered batches are read. A batch that comes
    again after a crash is written over, with the same numbers, if it hadn't been entered, and left alone if it had: a replay changes no row. Next to
    the rows of a batch stand its heads, one row for each session it touched: last number, rows so far, last time, summary. Numbering reads heads,
    not rows; `compacted` folds the heads of many batches into one.
    """

    def __init__(self, spark: SparkSession, at: str, session: str = "session_id", order: Sequence[str] = ("created_at", "id"), text: str = "content", time: str = "created_at") -> None:
        self.spark, self.at, self.session, self.order, self.text, self.time = spark, at.rstrip("/"), session, list(order), text, time

    def _folder(self, what: str, stream: str, batch: int) -> str:
        return f"{self.at}/{what}/stream={stream}/batch={batch}"

    def _there(self, what: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{what}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ledger(self) -> DataFrame:
        """(stream, batch, rows) of the batches that count: a row a batch."""
        return self.spark.read.schema(_LEDGER).json(f"{self.at}/ledger") if self._there("ledger") else self.spark.createDataFrame([], _LEDGER)

    def _entered(self, what: str) -> DataFrame | None:
        """The rows of a kind that belong to batches in the ledger, with their stream and batch."""
        if not self._there("ledger") or not self._there(what):
            return None
        rows = self.spark.read.option("basePath", f"{self.at}/{what}").parquet(f"{self.at}/{what}/stream=*")
        keys = self.ledger().select(F.col("stream").alias("_s"), F.col("batch").alias("_b")).distinct()
        return rows.join(F.broadcast(keys) if keys.count() < 100_000 else keys, (rows["stream"].cast("string") == keys["_s"]) & (rows["batch"] == keys["_b"]), "left_semi")

    def heads(self) -> DataFrame | None:
        """(session, last_seq, n, last_at, summary): the latest of each session, K02's view. None while nothing is stored."""
        found = self._entered("heads")
        if found is None:
            return None
        rest = ("last_seq", "n", "last_at", "summary")
        return found.groupBy(self.session).agg(F.max_by(F.struct(*rest), "last_seq").alias("x")).select(self.session, "x.*")

    def rows(self) -> DataFrame | None:
        """All rows that count, with seq_no."""
        found = self._entered("rows")
        return None if found is None else found.drop("stream", "batch")

    def append(self, batch: DataFrame, number: int, stream: str = "main", jsonl: bool = False) -> bool:
        """Write a batch once: True if it was written now, False if it had been. seq_no goes on from each session's last, in the given order; the
        place in the batch breaks ties. Rows without a session are left out; an empty batch is entered, so that it isn't tried again."""
        if self.ledger().where((F.col("stream") == stream) & (F.col("batch") == number)).limit(1).count():
            return False
        known = self.heads()
        key = self.session
        given = batch.where(F.col(key).isNotNull())
        place = F.row_number().over(W.partitionBy(key).orderBy(*[F.asc_nulls_last(c) for c in self.order]))
        numbered = given.withColumn("seq_no", place.cast("long"))
        if known is not None:
            last = known.select(key, F.col("last_seq").alias("_last"))
            numbered = numbered.join(last, key, "left").withColumn("seq_no", F.col("seq_no") + F.coalesce("_last", F.lit(0))).drop("_last")
        rows_at = self._folder("rows", stream, number)
        numbered.select(*batch.columns, "seq_no").write.mode("overwrite").parquet(rows_at)
        written = self.spark.read.schema(numbered.select(*batch.columns, "seq_no").schema).parquet(rows_at)
        newest = F.max_by(F.struct(F.col(self.time).alias("last_at"), F.substring(F.coalesce(self.text, F.lit("")), 1, SUMMARY).alias("summary")), "seq_no")
        heads = written.groupBy(key).agg(F.max("seq_no").alias("last_seq"), newest.alias("x")).select(key, "last_seq", F.col("last_seq").alias("n"), "x.*")
        heads.write.mode("overwrite").parquet(self._folder("heads", stream, number))
        if jsonl:
            written.write.mode("overwrite").partitionBy(key).json(self._folder("jsonl", stream, number))
        self.spark.createDataFrame([(stream, number, written.count())], _LEDGER).coalesce(1).write.mode("append").json(f"{self.at}/ledger")
        return True

    def writer(self, stream: str = "main", jsonl: bool = False) -> Callable[[DataFrame, int], None]:
        """For `writeStream.foreachBatch`."""
        return lambda batch, number: self.append(batch, number, stream, jsonl) and None

    def compacted(self) -> None:
        """Fold the heads of all batches into one batch of the stream `heads`; readers see the same latest rows before and after."""
        known = self.heads()
        if known is None:
            return
        number = self.ledger().where("stream = 'heads'").count()
        at = self._folder("heads", "heads", number)
        known.write.mode("overwrite").parquet(at)
        self.spark.createDataFrame([("heads", number, 0)], _LEDGER).coalesce(1).write.mode("append").json(f"{self.at}/ledger")


def artifacts(rows: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(artifacts with a safe path and their size in bytes, rows refused because their path leads outside the session). Null content has
    size 0; a null path is refused."""
    walked = rows.withColumns({"_safe": safe_path(F.col(path)), "size": F.coalesce(F.octet_length(F.col(content)), F.lit(0)).cast("long")})
    good = walked.where("_safe IS NOT NULL").withColumn(path, F.col("_safe")).drop("_safe")
    return good, rows.where(safe_path(F.col(path)).isNull())
