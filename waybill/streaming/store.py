"""Tables of a stream as Parquet folders that are written once and read when complete.

Every write makes a new version: a folder of its own, partitioned by a hash of the vehicle (``bucket``)
and, for logs, by ``event_date``.  Spark's committer marks a folder that is whole; a reader takes no
other, so a write that stops anywhere, in its commit as well, leaves the table as it was.

- A state table's bucket is what its newest complete version says; a version holds the buckets that its
  batch touched.  Versions that newer ones replace are dropped when the next batch starts.
- A log is its newest compacted version and all later ones, one a batch.

A batch reads versions before its own, so running it again reads the same and writes the same.
Version numbers are batch << 20 plus a count of what else was written after that batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1 << 20
PARTS = "version bigint, bucket int"
DATED = "version bigint, event_date date, bucket int"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("vehicle_id"), F.lit(buckets)).cast("int")


class KeyedStore:
    """``logs`` and ``states``: schemas by table; every table has a vehicle_id.  ``dated``: the time column of a log, which its event_date follows."""

    def __init__(self, spark: SparkSession, root: str, logs: dict[str, str], states: dict[str, str], dated: dict[str, str], buckets: int = 16) -> None:
        self.spark, self.root, self.logs, self.states, self.dated, self.buckets = spark, root.rstrip("/"), logs, states, dated, buckets

    # folders: names and marks alone, never rows
    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (self.root, *parts))))

    def _list(self, *parts: object) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _drop(self, *parts: object) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self, table: str, below: int | None = None) -> list[int]:
        """Complete versions, newest first."""
        found = [int(name.split("=")[1]) for name in self._list(table) if name.startswith("version=")]
        return sorted((v for v in found if (below is None or v < below) and "_SUCCESS" in self._list(table, f"version={v}")), reverse=True)

    def _write(self, table: str, rows: DataFrame, version: int) -> None:
        parts = ["event_date", "bucket"] if table in self.logs else ["bucket"]
        rows.repartition(*parts).write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{table}/version={version}")

    def _read(self, table: str, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/{f}" for f in folders)).filter("vehicle_id IS NOT NULL")

    def touched(self, vehicles: DataFrame) -> list[int]:
        """The buckets of some vehicles: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in vehicles.select(bucket_of(self.buckets)).distinct().collect())

    def days(self, rows: DataFrame, at: str) -> list:
        """The dates of ``at``: a batch's new instants have few, and there are no more than the log has days."""
        return sorted(r[0] for r in rows.select(F.col(at).cast("date")).distinct().collect())

    # rows of one batch, before they are applied
    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once and read back; the next batch's take their place."""
        rows.write.mode("overwrite").parquet(f"{self.root}/_stage/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/_stage/{name}")

    # logs
    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        self._write(table, self._placed(table, rows), batch * STEP)

    def _placed(self, table: str, rows: DataFrame) -> DataFrame:
        date = F.col(self.dated[table]).cast("date") if table in self.dated else F.lit(None).cast("date")
        return rows.withColumn("event_date", date).withColumn("bucket", bucket_of(self.buckets))

    def _standing(self, table: str, below: int | None) -> list[int]:
        """The newest compacted version and all after it."""
        found = self.versions(table, below)
        base = max((v for v in found if v % STEP), default=-1)
        return [v for v in found if v >= base]

    def log(self, table: str, before: int | None = None, touched: list[int] | None = None, parts: bool = False) -> DataFrame:
        """Appended rows, of batches before ``before`` and of some buckets if given; with event_date, bucket and version if ``parts``."""
        below = None if before is None else before * STEP
        rows = self._read(table, f"{self.logs[table]}, {DATED}", [f"version={v}" for v in self._standing(table, below)])
        rows = rows if touched is None else rows.filter(F.col("bucket").isin(touched))
        return rows if parts else rows.drop("version", "event_date", "bucket")

    def compact(self, table: str, rows: DataFrame) -> None:
        """``rows`` become the whole log, one file a date and bucket; what they replace goes once they are complete."""
        standing = self._standing(table, None)
        if standing:
            self._write(table, self._placed(table, rows), standing[0] + 1)
            for v in self.versions(table):
                if v < standing[0] + 1:
                    self._drop(table, f"version={v}")

    # states
    def read(self, table: str, touched: list[int] | None = None, before: int | None = None) -> DataFrame:
        newest: dict[int, int] = {}
        for v in self.versions(table, None if before is None else before * STEP):
            for name in self._list(table, f"version={v}"):
                if name.startswith("bucket="):
                    newest.setdefault(int(name.split("=")[1]), v)
        folders = [f"version={v}/bucket={b}" for b, v in sorted(newest.items()) if touched is None or b in touched]
        return self._read(table, f"{self.states[table]}, {PARTS}", folders).drop("version", "bucket")

    def replace(self, table: str, rows: DataFrame, touched: list[int], batch: int | None = None) -> None:
        """``rows`` become all rows of the touched buckets.  A row without a vehicle marks each, so that an emptied one is written too.

        Without a batch the version is one after the newest.
        """
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        newest = self.versions(table)
        version = batch * STEP if batch is not None else (newest[0] + 1 if newest else 1)
        self._write(table, rows.withColumn("bucket", bucket_of(self.buckets)).unionByName(marks, allowMissingColumns=True), version)

    def vacuum(self, batch: int) -> None:
        """Drop buckets of states that a newer version before ``batch`` replaces; what that batch reads stays."""
        for table in self.states:
            kept: set[str] = set()
            for v in self.versions(table, batch * STEP):
                buckets = {name for name in self._list(table, f"version={v}") if name.startswith("bucket=")}
                for name in buckets & kept:
                    self._drop(table, f"version={v}", name)
                if buckets <= kept:
                    self._drop(table, f"version={v}")
                kept |= buckets
