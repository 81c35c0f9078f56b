"""Gold from silver: the business tables of the scope, filled by insert-or-ignore against the published version.

A build takes the silver relations and the gold that is published; keys that gold has stay as they
are, new keys come in.  Nothing is deleted: ``stale`` counts what silver no longer supports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import sinks
from tenderlake.plans.silver import SCOPE
from tenderlake.plans.star import Star
from tenderlake.sources.adapters import stored

#: What stands for a missing name.
NO_BUYER, NO_COMPANY = "Acheteur inconnu", "Inconnu"
KEYS = {"acheteurs": ["siret"], "marches": ["uid"], "entreprises": ["siren"], "attributions": ["uid", "siret_titulaire"]}


def eligible() -> Column:
    """Markets of gold: the buyer is resolved, no other source has it, and it is in scope."""
    return F.col("siret_acheteur").isNotNull() & F.col("doublon_probable_de").isNull() & F.coalesce(F.col("code_cpv").startswith(SCOPE), F.lit(False))


def insert_or_ignore(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` stand, and those of ``new`` whose key is free come in; ``new`` has one row a key."""
    if old is None:
        return new
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


@dataclass(frozen=True)
class Gold:
    acheteurs: DataFrame
    marches: DataFrame
    entreprises: DataFrame
    attributions: DataFrame

    def star(self, units: DataFrame | None = None, places: DataFrame | None = None) -> Star:
        """The relations of marts.  A buyer's activity and department are those that the register's units
        (siren, activitePrincipaleUniteLegale) and places (siret, siren, codePostalEtablissement) give its number."""
        buyers = self.acheteurs
        if units is not None and places is not None:
            of_unit = units.groupBy("siren").agg(F.min(F.nullif("activitePrincipaleUniteLegale", F.lit(""))).alias("naf"))
            of_place = places.groupBy("siret").agg(F.min(F.struct("siren", F.left("codePostalEtablissement", F.lit(2)).alias("departement"))).alias("p"))
            known = of_place.select("siret", "p.*").join(of_unit, "siren").select("siret", "naf", "departement")
            buyers = buyers.join(known, "siret", "left")
        return Star(buyers, self.marches, self.entreprises.withColumn("etat", F.col("etat_administratif")), self.attributions).typed()


def build(silver: DataFrame, awards: DataFrame, before: Gold | None = None) -> Gold:
    """Gold after one more build.  Of several names of a buyer or company the least counts; method and score
    of each award come along, so that sheets can tell a doubtful identity."""
    old = lambda name: None if before is None else getattr(before, name)
    taken = stored(silver.where(eligible()))
    buyers = taken.groupBy(F.col("siret_acheteur").alias("siret")).agg(F.coalesce(F.min("nom_acheteur"), F.lit(NO_BUYER)).alias("nom"))
    markets = taken.select(
        "uid", "siret_acheteur", "objet", "montant", "duree_mois", "duree_restante_mois", "code_cpv", "date_notification", "date_publication",
        F.coalesce("modification_id", F.lit(0)).alias("modification_id"), F.lit(True).alias("donnees_actuelles"), "source")
    won = stored(awards.join(taken.select("uid"), "uid", "left_semi").withColumn("siren", F.left("siret_titulaire", F.lit(9))))
    companies = won.groupBy("siren").agg(F.coalesce(F.min("nom_titulaire"), F.lit(NO_COMPANY)).alias("denomination")).select(
        "siren", "denomination", F.lit(True).alias("est_active"), F.lit(None).cast("string").alias("etat_administratif"))
    links = won.groupBy("uid", "siret_titulaire").agg(
        F.min(F.struct("siren", "methode_resolution", "score_confiance")).alias("x")).select("uid", "siret_titulaire", "x.*")
    new = {"acheteurs": buyers, "marches": markets, "entreprises": companies, "attributions": links}
    return Gold(**{name: insert_or_ignore(old(name), rows, KEYS[name]) for name, rows in new.items()})


def orphans(gold: Gold) -> DataFrame:
    """(lien, nb): rows whose key is missing where it points to; gold is sound if all are 0."""
    missing = lambda rows, key, to, at: rows.join(to.select(F.col(at).alias(key)), key, "left_anti")
    found = {
        "marches.siret_acheteur": missing(gold.marches, "siret_acheteur", gold.acheteurs, "siret"),
        "attributions.uid": missing(gold.attributions, "uid", gold.marches, "uid"),
        "attributions.siren": missing(gold.attributions, "siren", gold.entreprises, "siren"),
    }
    counted = [rows.agg(F.count("*").alias("nb")).select(F.lit(name).alias("lien"), "nb") for name, rows in found.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def stale(gold: Gold, silver: DataFrame) -> DataFrame:
    """Markets of gold that silver no longer supports."""
    return gold.marches.join(silver.where(eligible()).select("uid"), "uid", "left_anti")


def publish(gold: Gold, folder: str) -> int:
    """All four tables as one version: readers see them change together."""
    rows = {name: getattr(gold, name) for name in KEYS}
    return sinks.publish(rows, folder, "gold")


def current(spark: SparkSession, folder: str) -> Gold | None:
    """The published gold, or none before the first build."""
    if sinks.version(spark, folder, "gold") is None:
        return None
    return Gold(**{name: sinks.current(spark, folder, "gold", name) for name in KEYS})
