"""The four relations that marts are built from, whatever they were read from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.plans.family import family_sql
from tenderlake.sources.adapters import CANON, run, stored

#: What plans read of each relation; gold may hold more.
COLUMNS = {
    "acheteurs": {"siret": "string", "nom": "string", "naf": "string", "departement": "string"},
    "marches": {"uid": "string", "siret_acheteur": "string", "montant": "double", "code_cpv": "string", "date_notification": "date", "duree_mois": "double",
                "duree_restante_mois": "double", "objet": "string"},
    "entreprises": {"siren": "string", "denomination": "string", "etat": "string"},
    "attributions": {"uid": "string", "siren": "string"},
}
#: A buyer with more markets than this has its time line cut into segments of so many days.
LARGE, SPAN = 100_000, 30


@dataclass(frozen=True)
class Star:
    acheteurs: DataFrame
    marches: DataFrame
    entreprises: DataFrame
    attributions: DataFrame
    #: All markets, where ``marches`` are those of some buyers: durations are inferred from these.
    tous: DataFrame | None = None

    @staticmethod
    def of_tables(spark: SparkSession, sf_dir: str) -> Star:
        """The generated tables, by their canonical relations."""
        read = lambda name: run(spark, sf_dir, f"WITH {CANON} SELECT * FROM {name}")
        return Star(*map(read, COLUMNS)).typed()

    def typed(self) -> Star:
        """Each relation with the columns that plans read; one that is missing is null."""
        def cut(df: DataFrame, columns: dict[str, str]) -> DataFrame:
            return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))

        return Star(*(cut(getattr(self, name), columns) for name, columns in COLUMNS.items()))

    def sql(self, text: str) -> DataFrame:
        """A query that names the relations in braces."""
        named = {name: getattr(self, name) for name in COLUMNS} | {"tous": self.tous or self.marches}
        return self.marches.sparkSession.sql(text, **{k: v for k, v in named.items() if f"{{{k}}}" in text})

    def families(self, select: str, levels: tuple[int, ...] = (8,), large: int = LARGE, span: int = SPAN) -> DataFrame:
        """A query over the relations of ``family_sql``.  Families of large buyers go another way, with the
        same rows: their time lines are dealt in segments, so that no task holds all markets of one buyer."""
        many = stored(self.marches.groupBy("siret_acheteur").count().where(F.col("count") > large).select("siret_acheteur"))
        if many.isEmpty():
            return self.sql(family_sql(levels) + select)
        some = lambda how: replace(self, marches=self.marches.join(many, "siret_acheteur", how), tous=self.tous or self.marches)
        return some("left_anti").sql(family_sql(levels) + select).unionByName(some("left_semi").sql(family_sql(levels, span) + select))
