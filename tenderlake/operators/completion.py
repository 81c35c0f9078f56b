"""Completion of companies by a remote register under a quota, as a durable queue."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.quality import incomplete, kind_of_id
from tenderlake.sources import clients

ANSWERS = "siren string, statut string, reponse string, demande timestamp"


def register_answer(transport, base: str, key: str, siren: str, **retry) -> tuple[str, str | None]:
    """(statut, JSON text): trouve, introuvable (404), restreint (403), or erreur after all tries."""
    import json

    try:
        got = clients.company(transport, base, siren, key, **retry)
        return ("introuvable", None) if got is None else ("trouve", json.dumps(got, ensure_ascii=False))
    except clients.Restricted:
        return "restreint", None
    except RuntimeError:
        return "erreur", None


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers kept so far; of several to one id the last counts, an error only where there is no other."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANSWERS)
    order = F.struct(F.col("statut") != "erreur", "demande")
    return spark.read.schema(ANSWERS).parquet(path).groupBy("siren").agg(F.max_by(F.struct("statut", "reponse"), order).alias("a")).select("siren", "a.*")


def complete_queue(companies: DataFrame, path: str, ask: Callable[[str], tuple[str, str | None]], per_minute: float = 30, tasks: int = 2, wave: int = 300,
                   waves: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Ask for companies that lack register data, and keep the answers below ``path``; the number asked.

    The queue is what is asked for and not yet answered: incomplete companies with a valid id that have no
    answer but an error.  It is worked off in waves of so many ids, smallest first; a wave's answers are
    appended when it ends, so a run that stops goes on with the wave it was in, and no id of a finished
    wave is asked again.  ``tasks`` share the quota: each waits so long between two requests that all of
    them stay within ``per_minute``.  An id that errs is tried again by the next run, not by this one.
    """
    spark, apart = companies.sparkSession, 60.0 * tasks / per_minute
    todo = incomplete(companies).select("siren").distinct().where(kind_of_id(F.col("siren")) == "valide")

    def fetch(batches):
        first = True
        for b in batches:
            for siren in b.column(0).to_pylist():
                if not first:
                    sleep(apart)
                first = False
                statut, reponse = ask(siren)
                yield pa.RecordBatch.from_arrays([pa.array([siren]), pa.array([statut]), pa.array([reponse], pa.string())], names=["siren", "statut", "reponse"])

    asked, n, last = 0, 0, ""
    while waves is None or n < waves:
        done = answers(spark, path).where("statut <> 'erreur'")
        # A wave is small by its quota: a few hundred ids, taken through the driver so that its tasks are even.
        ids = [r["siren"] for r in todo.join(done, "siren", "left_anti").where(F.col("siren") > last).orderBy("siren").limit(wave).collect()]
        if not ids:
            break
        rows = spark.createDataFrame([(i,) for i in ids], "siren string").repartition(tasks)
        rows.mapInArrow(fetch, "siren string, statut string, reponse string").withColumn("demande", F.current_timestamp()).write.mode("append").parquet(path)
        asked, n, last = asked + len(ids), n + 1, ids[-1]
    return asked
