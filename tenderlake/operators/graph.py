"""Co-winners reached over shared markets, and nearest contracts by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_winners(awards: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(siren, depth, uid): companies within ``depth`` shared markets of ``start``, the least depth
    of each and, of the markets through which it is first reached, the least."""
    pairs = awards.select("uid", "siren").distinct()
    seen = awards.sparkSession.createDataFrame([(start, 0, None)], "siren string, depth int, uid string")
    edge = seen
    for d in range(1, depth + 1):
        markets = pairs.join(edge.select("siren"), "siren", "left_semi").select("uid").distinct()
        edge = pairs.join(markets, "uid").join(seen.select("siren"), "siren", "left_anti").groupBy("siren").agg(
            F.lit(d).alias("depth"), F.min("uid").alias("uid"))
        seen = seen.unionByName(edge)
    return seen.where("depth > 0")


def cosine(a, b):
    """Cosine of two arrays; null where one is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
