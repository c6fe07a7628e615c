"""Shared pieces of the text operators: column bridges to Python tasks, sampling, shared scratch.

Rows move between the JVM and Python tasks as Arrow batches.  Every helper takes only the columns
it names, so extra columns (clashing names included) never reach an operator.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows handed to an operator's batch function at once; bounds the Python side's working set.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """Let Python workers of this session import the package from its own folder.

    On a cluster without a shared install, submit the package with --py-files instead.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir.  Where it is unset, a local session (tests) gets a temporary folder; a cluster must name one."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="waybill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the checkpoints that ``frames`` read, once what follows from them is written.

    Spark deletes the shuffle files of finished steps when the driver collects its garbage, so that is asked for, too.
    """
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kept = leaf.rdd().getCheckpointFile() if leaf.nodeName() == "LogicalRDD" else None
            if kept is not None and kept.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def map_batches(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str) -> DataFrame:
    """Run ``make()(col1, col2, ...)`` over batches of rows in Python tasks.

    ``make`` runs once a task and returns a function from lists of column values to a dict of
    lists.  The lists may have any length, so a batch may give more or fewer rows than it had.
    """
    share_code(df.sparkSession)
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of five; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == 0


def bounded_sample(rows: DataFrame, label: str, key: list[str], per_label: int, max_labels: int = 256) -> DataFrame:
    """About ``per_label`` distinct rows of each label, chosen by a hash of ``key``; all rows of rarer labels.

    ``rows`` is read twice: once for the numbers of distinct keys a label, and once for the sample.  The draw
    uses 63 bits of the hash, so it works for any number of rows.  Rows that repeat a key and label count once.
    ``max_labels``: a model learns the most frequent labels up to so many; it has a weight vector for each.
    """
    draw = F.shiftrightunsigned(F.xxhash64(*key), 1)
    counts = rows.groupBy(label).agg(F.approx_count_distinct(F.xxhash64(*key)).alias("n")).orderBy(F.desc("n"), F.col(label)).limit(max_labels).collect()
    return _drawn(rows, label, draw, [tuple(r) for r in counts], per_label).dropDuplicates([*key, label])


def _drawn(rows: DataFrame, label: str, draw: Column, counts: list[tuple], per_label: int) -> DataFrame:
    keep = F.lit(False)
    for value, n in counts:
        keep = keep | ((F.col(label) == F.lit(value)) & (draw <= sample_limit(per_label, n)))
    return rows.filter(keep)


def sample_limit(per_label: int, n: int) -> int:
    """The largest 63-bit hash that is drawn, so that about ``per_label`` of ``n`` are."""
    return (1 << 63) - 1 if n <= per_label else (per_label << 63) // n


def within_chars(rows: DataFrame, label: str, key: list[str], chars: int) -> DataFrame:
    """Of drawn ``rows`` (distinct by key and label), those that fit into ``chars`` characters of text, an even share for each label.

    They are taken in the order of a hash of the key; a row that does not fit is passed over.  Only
    hashes and lengths of the drawn rows reach the driver, and texts are filtered where they lie.
    """
    drawn = sorted(tuple(r) for r in rows.select(F.xxhash64(*key), F.length("text"), label).collect())
    share = chars // max(1, len({value for _, _, value in drawn}))
    used: dict = {}
    kept = set()
    for k, n, value in drawn:
        if used.get(value, 0) + n <= share:
            used[value] = used.get(value, 0) + n
            kept.add((k, n))
    chosen = rows.sparkSession.createDataFrame(sorted(kept), "hash_ bigint, size_ int")
    with_hash = rows.withColumn("hash_", F.xxhash64(*key)).withColumn("size_", F.length("text"))
    return with_hash.join(F.broadcast(chosen), ["hash_", "size_"], "left_semi").drop("hash_", "size_")


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """``fit`` of all ``rows``, run in one task, so that the driver holds no training data; what it returns is pickled.

    For samples whose size is bounded by a parameter only.  A lost executor repeats the task.
    """
    import pickle

    share_code(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(held))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if found is None else pickle.loads(found[0])


def bounded_chunks(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """The texts in order, so many at a time that they hold about ``chars`` characters, one at least."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part
