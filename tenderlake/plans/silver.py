"""The silver layer from bronze text: last versions, typed columns with rejects, identities, flags.

A rebuild is a pure function of the bronze relations; it is written to a new folder and then
published by its name (``tenderlake.sinks.publish``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tenderlake import sinks
from tenderlake.operators import identity, name_index
from tenderlake.operators.versions import first_writer_wins, latest
from tenderlake.sources.adapters import shared, stored

#: The category prefix within which costly levels run, and the first plausible day.
SCOPE, FIRST_DAY = "72", "2000-01-01"
SIRET = r"^[0-9]{14}\z"
#: What a market takes of bronze; the rest differs from winner to winner.
DECP = ["uid", "acheteur_id", "acheteur_nom", "objet", "montant", "code_cpv", "date_notification", "date_publication", "duree_mois", "duree_restante_mois", "modification_id", "date_chargement"]
TED = ["publication_number", "buyer_identifier", "buyer_name", "objet", "montant", "code_cpv", "publication_date", "date_chargement"]


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def plausible(day: Column, today: Column, first: str = FIRST_DAY) -> Column:
    """A day from ``first`` to two years after ``today``, else null."""
    return F.when(day.between(F.lit(first).cast("date"), F.add_months(today, 24)), day)


def _typed(rows: DataFrame, source: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Text columns cast where they can be; ``rejets`` lists those that were not empty and could not."""
    cast = {name: _text(raw).try_cast(kind) for name, (raw, kind) in columns.items()}
    bad = [F.when(_text(raw).isNotNull() & cast[name].isNull(), F.lit(name)) for name, (raw, _) in columns.items()]
    return rows.select("*", F.lit(source).alias("_source"), *(c.alias(f"_{n}") for n, c in cast.items()), F.array_compact(F.array(*bad)).alias("rejets"))


def markets(decp: DataFrame, ted: DataFrame, today: Column, first: str = FIRST_DAY) -> DataFrame:
    """One row a market: the last version of each, typed, with buyer numbers of level 1 only.

    ``decp`` has uid, acheteur_id, acheteur_nom, objet, montant, code_cpv, date_notification,
    date_publication, duree_mois, duree_restante_mois, modification_id, date_chargement; ``ted``
    has publication_number, buyer_identifier, buyer_name, objet, montant, code_cpv,
    publication_date, date_chargement.  Rows without key go; malformed text is null and named
    in ``rejets``; dates out of bounds are null.  Bronze has a row a winner, of which the versions
    of a market are left, once each, before they are put in order.
    """
    decp, ted = decp.select(*DECP).distinct(), ted.select(*TED).distinct()
    revision = F.coalesce(_text("modification_id").try_cast("int"), F.lit(0))
    last = latest(decp.where("uid IS NOT NULL"), ["uid"], revision.desc(), F.col("date_chargement").desc_nulls_last(), F.hash(*decp.columns))
    kinds = {"montant": ("montant", "decimal(38,6)"), "date_notification": ("date_notification", "date"), "date_publication": ("date_publication", "date"),
             "duree_mois": ("duree_mois", "decimal(38,6)"), "duree_restante_mois": ("duree_restante_mois", "decimal(38,6)"), "modification_id": ("modification_id", "int")}
    d = _typed(last, "DECP", kinds).select(
        "uid", F.col("_source").alias("source"), F.when(F.col("acheteur_id").rlike(SIRET), F.col("acheteur_id")).alias("siret_acheteur"),
        _text("acheteur_nom").alias("nom_acheteur"), _text("objet").alias("objet"), F.col("_montant").alias("montant"), _text("code_cpv").alias("code_cpv"),
        F.col("_date_notification").alias("date_notification"), F.col("_date_publication").alias("date_publication"), F.col("_duree_mois").alias("duree_mois"),
        F.col("_duree_restante_mois").alias("duree_restante_mois"), F.coalesce("_modification_id", F.lit(0)).alias("modification_id"), "rejets",
    )
    last = latest(ted.where("publication_number IS NOT NULL"), ["publication_number"], F.col("date_chargement").desc_nulls_last(), F.hash(*ted.columns))
    t = _typed(last, "TED", {"montant": ("montant", "decimal(38,6)"), "date_notification": ("publication_date", "date")}).select(
        ted_key().alias("uid"), F.col("_source").alias("source"), F.when(F.col("buyer_identifier").rlike(SIRET), F.col("buyer_identifier")).alias("siret_acheteur"),
        _text("buyer_name").alias("nom_acheteur"), _text("objet").alias("objet"), F.col("_montant").alias("montant"), _text("code_cpv").alias("code_cpv"),
        F.col("_date_notification").alias("date_notification"), F.col("_date_notification").alias("date_publication"), F.lit(None).cast("decimal(38,6)").alias("duree_mois"),
        F.lit(None).cast("decimal(38,6)").alias("duree_restante_mois"), F.lit(None).cast("int").alias("modification_id"), "rejets",
    )
    every = d.unionByName(t)
    return every.withColumns({c: plausible(F.col(c), today, first) for c in ("date_notification", "date_publication")})


def ted_key() -> Column:
    return F.concat(F.lit("TED-"), F.col("publication_number"))


def _buyers(decp: DataFrame, ted: DataFrame) -> DataFrame:
    """Raw ids of buyers that need work, a row a version and not one a winner: made distinct for each source by
    itself, they need no winners at all."""
    raw = (decp.select("uid", F.col("acheteur_id").alias("identifiant"), F.col("acheteur_nom").alias("nom"), "date_chargement"),
           ted.select(ted_key().alias("uid"), F.col("buyer_identifier").alias("identifiant"), F.col("buyer_name").alias("nom"), "date_chargement"))
    d, t = (rows.where(_needs_work(F.col("identifiant"))).distinct() for rows in raw)
    return d.unionByName(t)


def _winners(decp: DataFrame, ted: DataFrame) -> DataFrame:
    return decp.select("uid", F.col("titulaire_id").alias("identifiant"), F.col("titulaire_nom").alias("nom"), F.lit("DECP").alias("source")).unionByName(
        ted.select(ted_key().alias("uid"), F.col("winner_identifier").alias("identifiant"), F.col("winner_name").alias("nom"), F.lit("TED").alias("source"))
    ).distinct()


def _needs_work(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(SIRET)


def _by_keys(rows: DataFrame, keys: list[str], cascade) -> DataFrame:
    """Results of the cascade for distinct keys, joined back to the rows that asked by the keys themselves, nulls alike."""
    asked = stored(rows.select(*keys).distinct().withColumn("key", F.monotonically_increasing_id()))
    found = cascade(asked).where("siret IS NOT NULL").join(asked.withColumnsRenamed({k: f"_{k}" for k in keys}), "key")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(found, same).drop("key", *(f"_{k}" for k in keys))


def resolve_buyers(silver: DataFrame, decp: DataFrame, ted: DataFrame, register: DataFrame, index=None) -> DataFrame:
    """Markets within the scope whose buyer has no number yet take that of levels 2 and 3; one
    that has a number keeps it.  Of several raw ids of a market the newest version counts."""
    open_ = silver.where(F.col("siret_acheteur").isNull() & F.col("code_cpv").startswith(SCOPE)).select("uid")
    raw = _buyers(decp, ted).join(open_, "uid", "left_semi")
    raw = raw.withColumn("acheteur", F.lit(None).cast("string"))
    found = _by_keys(raw, ["identifiant", "nom", "acheteur"], lambda keys: identity.resolve(keys, register, index=index))
    one = latest(found, ["uid"], F.col("date_chargement").desc_nulls_last(), F.col("place").asc_nulls_last(), "siret").select(
        "uid", F.col("siret").alias("_siret"), _text("nom").alias("_nom"), F.col("methode").alias("methode_resolution_acheteur"),
        F.col("score").alias("score_confiance_acheteur"),
    )
    return silver.join(one, "uid", "left").withColumn("nom_acheteur", F.coalesce("nom_acheteur", F.when(F.col("siret_acheteur").isNull(), F.col("_nom")))).withColumn(
        "siret_acheteur", F.coalesce("siret_acheteur", "_siret")).drop("_siret", "_nom")


def awards(silver: DataFrame, decp: DataFrame, ted: DataFrame, register: DataFrame, index=None) -> DataFrame:
    """(uid, siret_titulaire, nom_titulaire, source, methode_resolution, score_confiance), one a
    market and winner: exact numbers first, then level 2 for every sector without foreign ones,
    then the whole cascade within the scope; what an earlier stage has stands.  Continuity with
    the buyer looks at the stages before, not at rows of its own."""
    raw = stored(_winners(decp, ted).join(silver.select("uid", "siret_acheteur", "code_cpv", F.col("source")), ["uid", "source"]))
    none = lambda kind: F.lit(None).cast(kind)
    exact = raw.where(F.col("identifiant").rlike(SIRET)).select(
        "uid", F.col("identifiant").alias("siret_titulaire"), F.col("nom").alias("nom_titulaire"), "source",
        none("string").alias("methode_resolution"), none("double").alias("score_confiance"))
    rest = raw.where(_needs_work(F.col("identifiant"))).withColumn("acheteur", F.col("siret_acheteur"))

    def stage(rows: DataFrame, score: Column) -> DataFrame:
        return rows.select("uid", F.col("siret").alias("siret_titulaire"), F.col("nom").alias("nom_titulaire"), "source",
                           F.col("methode").alias("methode_resolution"), score.alias("score_confiance"))

    rules = _by_keys(rest, ["identifiant"], lambda k: identity.by_rules(k, register).where("methode <> 'etranger'"))
    second = stored(stage(rules, none("double")))
    known = first_writer_wins(["uid", "siret_titulaire"], exact, second)
    past = known.join(silver.select("uid", "siret_acheteur"), "uid").where("siret_acheteur IS NOT NULL").select(
        F.col("siret_acheteur").alias("acheteur"), F.col("siret_titulaire").alias("siret")).distinct()
    scoped = rest.where(F.col("code_cpv").startswith(SCOPE) & F.col("nom").isNotNull() & ((F.col("source") != "DECP") | (F.col("nom") != "")))
    third = stage(_by_keys(scoped, ["identifiant", "nom", "acheteur"], lambda k: identity.resolve(k, register, past, index=index)), F.when(F.col("methode") != "etranger", F.col("score")))
    return first_writer_wins(["uid", "siret_titulaire"], exact, second, third)


def flag_duplicates(silver: DataFrame, share: float = 0.01, days: int = 30) -> DataFrame:
    """``doublon_probable_de``: for a TED market the DECP market of the same buyer and category
    family whose amount differs by at most ``share`` of its own and whose date by at most
    ``days``, the closest in date.  Candidates meet on (buyer, family, period): a period is
    ``days`` long and each TED row looks at its own and its neighbours, so one buyer with very
    many markets is not one key."""
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(days + 1))
    side = silver.where("siret_acheteur IS NOT NULL AND code_cpv IS NOT NULL AND montant IS NOT NULL AND date_notification IS NOT NULL")
    key = F.left("code_cpv", F.lit(4)).alias("famille")
    t = side.where("source = 'TED'").select(F.col("uid").alias("t_uid"), "siret_acheteur", key, F.col("montant").alias("t_montant"), F.col("date_notification").alias("t_date"),
                                            F.explode(F.array(*(bucket("date_notification") + i for i in (-1, 0, 1)))).alias("periode"))
    d = side.where("source = 'DECP'").select(F.col("uid").alias("d_uid"), "siret_acheteur", key, F.col("montant").alias("d_montant"), F.col("date_notification").alias("d_date"),
                                             bucket("date_notification").alias("periode"))
    apart = F.abs(F.datediff("t_date", "d_date"))
    met = t.join(d, ["siret_acheteur", "famille", "periode"]).where(
        (F.abs(F.col("t_montant") - F.col("d_montant")) <= F.lit(share) * F.greatest("d_montant", F.lit(1))) & (apart <= days)
    )
    best = met.groupBy("t_uid").agg(F.min(F.struct(apart.alias("ecart"), "d_uid")).alias("m"))
    return silver.join(best.select(F.col("t_uid").alias("uid"), F.col("m.d_uid").alias("doublon_probable_de")), "uid", "left")


def rebuild(decp: DataFrame, ted: DataFrame, register: DataFrame, today: Column, first: str = FIRST_DAY, index=None) -> tuple[DataFrame, DataFrame]:
    """(silver markets, silver awards).  Buyers and winners are looked up in one stored index of names: the
    ``index`` given, kept from run to run, or one that is built here."""
    register = stored(register)
    index = index or name_index.build(register, f"{shared(register.sparkSession)}/noms")
    silver = stored(resolve_buyers(stored(markets(decp, ted, today, first)), decp, ted, register, index))
    silver = stored(flag_duplicates(silver))
    return silver, awards(silver, decp, ted, register, index)


def volumes(silver: DataFrame, attributed: DataFrame) -> DataFrame:
    """One row of counts of both tables."""
    a = silver.agg(F.count("*").alias("marches"), F.count_distinct("uid").alias("uid_distincts"), F.count_if(F.col("source") == "DECP").alias("decp"),
                   F.count_if(F.col("source") == "TED").alias("ted"), F.count_if(F.col("siret_acheteur").isNull()).alias("sans_acheteur"),
                   F.count("doublon_probable_de").alias("doublons"), F.count_if(F.size("rejets") > 0).alias("rejetes"))
    return a.crossJoin(F.broadcast(attributed.agg(F.count("*").alias("attributions"))))  # one row each


def methods(silver: DataFrame, attributed: DataFrame) -> DataFrame:
    """(table, methode, nb): how buyers and winners were resolved."""
    b = silver.where("siret_acheteur IS NOT NULL").groupBy(F.coalesce("methode_resolution_acheteur", F.lit("siret_exact")).alias("methode")).count()
    w = attributed.groupBy(F.col("methode_resolution").alias("methode")).count()
    both = b.select(F.lit("acheteurs").alias("cote"), "methode", F.col("count").alias("nb")).unionByName(w.select(F.lit("titulaires").alias("cote"), "methode", F.col("count").alias("nb")))
    return both.orderBy("cote", F.desc("nb"), F.asc_nulls_last("methode"))


class TooManyRejects(Exception):
    """More rows hold text that does not cast than a rebuild may have."""


def publish(silver: DataFrame, attributed: DataFrame, folder: str, most: float = 0.05) -> dict:
    """Publish a rebuild as one version: ``marches``, ``attributions`` and ``rejets``, the rows with text that did not cast.

    Rows and rejects are counted while they are written; above a share of ``most`` the version is not
    published, readers keep the one before, and ``TooManyRejects`` says how many.  Returns the counts.
    """
    seen = Observation()
    bad = F.size("rejets") > 0
    counted = silver.observe(seen, F.count("*").alias("marches"), F.count_if(bad).alias("rejetes"))

    def check() -> None:
        if (n := seen.get)["rejetes"] > most * n["marches"]:
            raise TooManyRejects(f"{n['rejetes']} of {n['marches']} rows")

    number = sinks.publish({"marches": counted, "attributions": attributed, "rejets": silver.where(bad)}, folder, "silver", check=check)
    return seen.get | {"version": number}
