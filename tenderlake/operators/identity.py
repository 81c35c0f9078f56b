"""Identity resolution: rules, trigrams, persons, continuity, history and web, in order of cost.

Every level works on the rows that earlier ones left and records its method and confidence.
Inputs are distinct keys (key, identifiant, nom, acheteur); the register has (siren, denomination,
etat, nom_personne, prenoms array, siret_siege).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.text import identifier_rules, normalise_name
from tenderlake.operators.name_index import THRESHOLD, NameIndex, of_register
from tenderlake.sources.adapters import stored


def by_rules(keys: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """Level 2: (key, place, siret, siren, methode, score), completed to the head office where known."""
    got = keys.select("key", F.posexplode(identifier_rules(F.col("identifiant"))).alias("place", "r")).select("key", "place", "r.*")
    if register is not None:
        seat = register.groupBy(F.col("siren").alias("_s")).agg(F.min("siret_siege").alias("_siege"))
        got = got.join(seat, got["siren"] == seat["_s"], "left").withColumn("siret", F.coalesce("siret", "_siege")).drop("_s", "_siege")
    return got.withColumn("score", F.lit(1.0))


def similar_names(names: DataFrame, register: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(nom, siren, score): trigram similarity of the normalised name and the upper-cased register."""
    return of_register(register, threshold).similar(names)


def _by_name(keys: DataFrame, register: DataFrame, index: NameIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """Level 3 by distinct names: those that are resolved (nom, siret, siren, methode, score), and the companies
    (nom, siren, siret_siege, score) of those in doubt."""
    best = stored((index or of_register(register)).best(keys)).join(register.select("siren", "etat", "siret_siege"), "siren")
    every, active = Window.partitionBy("nom"), F.coalesce(F.col("etat") == "A", F.lit(False))
    best = best.withColumn("_n", F.count("*").over(every)).withColumn("_live", F.count_if(active).over(every))
    sole, only = F.col("_n") == 1, active & (F.col("_live") == 1) & F.col("siret_siege").isNotNull()
    best = best.withColumn("_only", only).withColumn("_done", F.max("_only").over(every))
    found = best.where(sole | F.col("_only")).select(
        "nom", F.col("siret_siege").alias("siret"), "siren", F.when(sole, "flou").otherwise("flou_desambigue_actif").alias("methode"),
        F.when(sole, F.col("score").cast("double")).otherwise(0.65).alias("score"),
    )
    doubt = best.where((F.col("_n") > 1) & ~F.col("_done")).select("nom", "siren", "siret_siege", "score")
    return found, doubt


def by_similarity(keys: DataFrame, register: DataFrame, index: NameIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """Level 3: (resolved, ambiguous).  A sole best name counts; of several, the sole active one, if it
    has a head office; all others are in doubt with every company of that name."""
    found, doubt = _by_name(keys, register, index)
    return keys.join(found, "nom"), keys.join(doubt, "nom")


def by_continuity(ambiguous: DataFrame, awards: DataFrame) -> DataFrame:
    """Level 4a: the one candidate whom that buyer has awarded before (acheteur, siret)."""
    return _sole(ambiguous.select("key", "acheteur", "siren").join(_past(awards), ["acheteur", "siren"]))


def _continuity_by_name(keys: DataFrame, doubt: DataFrame, awards: DataFrame) -> DataFrame:
    """Level 4a for keys (key, nom, acheteur) whose name is in doubt (nom, siren).  A buyer's past companies meet the
    names they bear before keys meet either: no key is repeated for every company of its name."""
    borne = _past(awards).join(doubt.select("nom", "siren").distinct(), "siren").select("acheteur", "nom", "siret")
    return _sole(keys.select("key", "nom", "acheteur").join(borne, ["acheteur", "nom"]))


def _past(awards: DataFrame) -> DataFrame:
    return awards.select("acheteur", "siret", F.left("siret", F.lit(9)).alias("siren")).distinct()


def _sole(met: DataFrame) -> DataFrame:
    one = met.groupBy("key").agg(F.count_distinct("siret").alias("n"), F.min("siret").alias("siret")).where("n = 1")
    return one.select("key", "siret", F.left("siret", F.lit(9)).alias("siren"), F.lit("continuite_acheteur").alias("methode"), F.lit(0.75).alias("score"))


def by_person(keys: DataFrame, register: DataFrame) -> DataFrame:
    """Level 3+: each word is tried as surname; all others must be first names of that person."""
    words = keys.select("key", F.split(normalise_name(F.col("nom")), " ").alias("w")).where(F.size("w") >= 2)
    tried = words.select("key", "w", F.posexplode("w").alias("i", "nom_personne"))
    rest = F.filter("w", lambda x, j: j != F.col("i"))
    people = register.where("nom_personne is not null and denomination is null").select("siren", "siret_siege", "nom_personne", "prenoms")
    met = tried.withColumn("rest", rest).join(people, "nom_personne").where(F.forall("rest", lambda x: F.array_contains("prenoms", x)))
    one = met.groupBy("key").agg(F.count_distinct("siren").alias("n"), F.min("siren").alias("siren"), F.min("siret_siege").alias("siret")).where("n = 1")
    return one.select("key", "siret", "siren", F.lit("personne_physique").alias("methode"), F.lit(0.9).alias("score"))


def by_history(keys: DataFrame, history: DataFrame) -> DataFrame:
    """Level 4b: one company bore exactly this name in a closed period (siren, siret_siege, denomination, date_fin)."""
    past = history.where("date_fin is not null").select("siren", "siret_siege", normalise_name(F.col("denomination")).alias("_n"))
    met = keys.withColumn("_n", normalise_name(F.col("nom"))).where("_n <> ''").join(past, "_n")
    one = met.groupBy("key").agg(F.count_distinct("siren").alias("n"), F.min("siren").alias("siren"), F.min("siret_siege").alias("siret")).where("n = 1")
    return one.select("key", "siret", "siren", F.lit("historique").alias("methode"), F.lit(0.8).alias("score"))


def by_web(mentions: DataFrame, keys: DataFrame, register: DataFrame) -> DataFrame:
    """Level 5: one company id in two distinct results (key, result, siren), whose name agrees."""
    met = mentions.groupBy("key", "siren").agg(F.count_distinct("result").alias("n")).where("n >= 2")
    sole = met.withColumn("_k", F.count("*").over(Window.partitionBy("key"))).where("_k = 1").select("key", "siren")
    named = sole.join(keys.select("key", normalise_name(F.col("nom")).alias("_n")), "key").join(register, "siren")
    return named.where(F.col("_n") == normalise_name(F.col("denomination"))).select(
        "key", F.col("siret_siege").alias("siret"), "siren", F.lit("web").alias("methode"), F.lit(0.4).alias("score")
    )


def resolve(keys: DataFrame, register: DataFrame, awards: DataFrame | None = None, history: DataFrame | None = None,
            mentions: DataFrame | None = None, index: NameIndex | None = None) -> DataFrame:
    """(key, place, siret, siren, methode, score), the cascade: rules, trigrams, continuity where
    they are in doubt, persons where they found none, history and, last, mentions on the web.  A
    level takes only what all before it left; ``place`` orders the results of one identifier.
    Names are looked up in a stored ``index`` of the register where there is one."""
    cols = ["key", "place", "siret", "siren", "methode", "score"]
    keys = stored(keys)
    done = stored(by_rules(keys, register).select(*cols))
    left = stored(keys.join(done, "key", "left_anti").where("nom is not null"))
    sure, doubt = map(stored, _by_name(left, register, index))

    def take(done: DataFrame, left: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = stored(more.withColumn("place", F.lit(0)).select(*cols))
        return done.unionByName(more), left.join(more, "key", "left_anti")

    done, left = take(done, left, left.join(sure, "nom"))
    if awards is not None:
        done, left = take(done, left, _continuity_by_name(left, doubt, awards))
    done, left = take(done, left, by_person(left.join(doubt, "nom", "left_anti"), register))
    if history is not None:
        done, left = take(done, left, by_history(left, history))
    if mentions is not None:
        done, left = take(done, left, by_web(mentions.join(left.select("key"), "key", "left_semi"), left, register))
    return done
