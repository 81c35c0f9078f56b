"""Bronze by Structured Streaming from a directory of Parquet files: append-only, or the last version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _run(rows: DataFrame, checkpoint: str):
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def append(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Append what has come to ``source`` since the last run, stamped with the load time."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("date_chargement", F.current_timestamp())
    _run(rows, checkpoint).format("parquet").option("path", target).start().awaitTermination()


def latest_versions(bronze: DataFrame, key: str, revision: str) -> DataFrame:
    from tenderlake.operators.versions import latest

    return latest(bronze, [key], F.col(revision).desc_nulls_last(), F.col("date_chargement").desc_nulls_last())


def _runs(spark: SparkSession, base: str) -> list[tuple[int, int, int]]:
    """(level, first, last batch) of finished runs, without those that a finished run of a higher level covers."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getParent().getName() for f in files.globStatus(at(f"{base}/run-*/_SUCCESS"))]
    found = [tuple(map(int, n.split("-")[1:])) for n in names]
    return sorted(r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))


def _last(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(revision).desc_nulls_last(), F.col("_batch").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_latest(spark: SparkSession, source: str, schema, base: str, keys: list[str], revision: str, files: int = 1, most: int = 8) -> None:
    """Keep the row of the greatest revision of each key below ``base``, however late it comes.

    A batch writes only its own last rows, as a run under its number; ``most`` runs of a level are
    merged into one of the next, so each row is written again a few times over all batches, not once
    for every batch.  A batch or merge that runs again after a failure writes the same folder, and a run
    counts when it is finished, so the state is never half changed.  Among equal revisions the later
    batch counts.
    """
    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        _last(batch.withColumn("_batch", F.lit(number).cast("long")), keys, revision).write.mode("overwrite").parquet(f"{base}/run-0-{number}-{number}")
        level = 0
        while len(same := [r for r in _runs(own, base) if r[0] == level]) >= most:
            rows = own.read.parquet(*(f"{base}/run-{a}-{b}-{c}" for a, b, c in same))
            level += 1
            _last(rows, keys, revision).write.mode("overwrite").parquet(f"{base}/run-{level}-{same[0][1]}-{same[-1][2]}")
            path = own._jvm.org.apache.hadoop.fs.Path
            for a, b, c in same:
                path(base).getFileSystem(own._jsc.hadoopConfiguration()).delete(path(f"{base}/run-{a}-{b}-{c}"), True)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    _run(rows, f"{base}/progress").foreachBatch(take).start().awaitTermination()


def kept(spark: SparkSession, base: str, keys: list[str], revision: str) -> DataFrame:
    """The state after all batches that ``keep_latest`` has finished."""
    rows = spark.read.parquet(*(f"{base}/run-{a}-{b}-{c}" for a, b, c in _runs(spark, base)))
    return _last(rows, keys, revision).drop("_batch")


def waves(events: DataFrame, keys: list[str], day: str, gap: str = "30 days") -> DataFrame:
    """(keys, debut, fin, nb): notification waves of a stream or a table, by session windows; the
    gap is counted from the last row of a wave, as in the batch chain."""
    return events.groupBy(*keys, F.session_window(day, gap)).agg(F.min(day).alias("debut"), F.max(day).alias("fin"), F.count("*").alias("nb")).drop("session_window")
