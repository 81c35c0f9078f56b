"""Quality of the layers: checks, sentinels, enrichment, cross-checks and golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import normalise_name

#: States that say why a company has no register data.
SENTINELS = ("INTROUVABLE_API", "ETRANGER", "SIREN_MALFORME", "NON_DIFFUSIBLE")


def incomplete(companies: DataFrame) -> DataFrame:
    """Companies without activity that no earlier run has marked."""
    return companies.where(F.col("code_naf").isNull() & ~F.coalesce("etat_administratif", F.lit("")).isin(*SENTINELS))


def kind_of_id(siren: Column) -> Column:
    """What a company id is: valide (nine digits), etranger (two capitals first) or malforme."""
    return F.when(siren.rlike(r"^[0-9]{9}\z"), "valide").when(siren.rlike("^[A-Z]{2}"), "etranger").otherwise("malforme")


def complete(companies: DataFrame, answers: DataFrame) -> DataFrame:
    """Companies with what the register answered (siren, statut, denomination, forme_juridique,
    code_naf, etat_administratif, est_active).  ``statut`` is trouve, introuvable, restreint or
    erreur; of the incomplete, foreign and malformed ids are marked without an answer, an error
    changes nothing, and a name is replaced only where it is missing or unknown."""
    todo = incomplete(companies).select("siren", kind_of_id(F.col("siren")).alias("_kind"))
    side = answers.select("siren", F.col("statut").alias("_statut"), *(F.col(c).alias(f"_{c}") for c in ("denomination", "forme_juridique", "code_naf", "etat_administratif", "est_active")))
    rows = companies.join(todo, "siren", "left").join(side.dropDuplicates(["siren"]), "siren", "left")
    ok = (F.col("_kind") == "valide") & (F.col("_statut") == "trouve")
    state = (
        F.when(F.col("_kind") == "etranger", "ETRANGER").when(F.col("_kind") == "malforme", "SIREN_MALFORME")
        .when((F.col("_kind") == "valide") & (F.col("_statut") == "introuvable"), "INTROUVABLE_API")
        .when((F.col("_kind") == "valide") & (F.col("_statut") == "restreint"), "NON_DIFFUSIBLE")
        .when(ok, F.col("_etat_administratif")).otherwise(F.col("etat_administratif"))
    )
    unknown = F.col("denomination").isNull() | (F.col("denomination") == "Inconnu")
    new = {
        "etat_administratif": state, "denomination": F.when(ok & unknown, F.coalesce("_denomination", "denomination")).otherwise(F.col("denomination")),
        **{c: F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("forme_juridique", "code_naf", "est_active") if c in companies.columns},
    }
    return rows.select(*((new[c] if c in new else F.col(c)).alias(c) for c in companies.columns))


def enrich(companies: DataFrame, units: DataFrame, establishments: DataFrame) -> DataFrame:
    """Companies with the register's legal data and their head office's address; companies that
    the register lacks stay as they are.  Of several rows of a key the least counts."""
    u = units.groupBy("siren").agg(F.min(F.struct(
        F.nullif("denominationUniteLegale", F.lit("")).alias("raison"), F.nullif("activitePrincipaleUniteLegale", F.lit("")).alias("naf"),
        F.nullif("etatAdministratifUniteLegale", F.lit("")).alias("etat"))).alias("u"))
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    e = establishments.where("etablissementSiege = 'true'").groupBy("siren").agg(F.min(F.struct(
        F.col("siret").alias("siret"), F.nullif(F.trim(F.concat_ws(" ", part("numeroVoieEtablissement"), part("typeVoieEtablissement"), part("libelleVoieEtablissement"))), F.lit("")).alias("adresse"),
        part("codePostalEtablissement").alias("code_postal"))).alias("e"))
    rows = companies.join(u, "siren", "left").join(e, "siren", "left")
    unknown = F.col("denomination").isNull() | (F.col("denomination") == "Inconnu")
    have = F.col("u").isNotNull()
    return rows.select(
        "siren", F.when(unknown, F.coalesce("u.raison", "denomination")).otherwise(F.col("denomination")).alias("denomination"),
        F.when(have, F.col("u.naf")).otherwise(F.col("code_naf")).alias("code_naf"), F.when(have, F.col("u.etat")).otherwise(F.col("etat_administratif")).alias("etat_administratif"),
        F.col("e.siret").alias("siret_siege"), F.col("e.adresse").alias("adresse"), F.col("e.code_postal").alias("code_postal"),
    )


def enrichment(before: DataFrame, after: DataFrame, units: DataFrame) -> DataFrame:
    """One row: companies with an activity before and after, with a known name, unknown to the register."""
    missing = after.join(units.select("siren"), "siren", "left_anti").agg(F.count("*").alias("introuvables"))
    a = before.agg(F.count("code_naf").alias("naf_avant"))
    b = after.agg(F.count("*").alias("entreprises"), F.count("code_naf").alias("naf_apres"), F.count_if(F.col("denomination").isNotNull() & (F.col("denomination") != "Inconnu")).alias("noms_connus"))
    return b.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(missing))  # one row each


def establishments_of(winners: DataFrame, register: DataFrame, old: DataFrame) -> DataFrame:
    """Establishments of winners as the register has them, replacing earlier rows of the same number."""
    new = winners.select("siret").distinct().join(register, "siret").select(
        "siret", "siren", (F.col("etablissementSiege") == "true").alias("est_siege"), F.col("codePostalEtablissement").alias("code_postal"))
    return old.join(new, "siret", "left_anti").select(*new.columns).unionByName(new)


def invalid_keys(rows: DataFrame, key: str, digits: int) -> DataFrame:
    """One row: keys that are not ``digits`` digits, reported and left in place."""
    return rows.agg(F.count_if(F.col(key).isNull() | ~F.col(key).rlike(rf"^[0-9]{{{digits}}}\z")).alias("invalides"), F.count("*").alias("lignes"))


def checks(units: DataFrame, establishments: DataFrame, companies: DataFrame, own: DataFrame, awards: DataFrame,
           least_units: int = 25_000_000, least_establishments: int = 40_000_000, least_share: float = 0.95) -> DataFrame:
    """(controle, ok, detail): the eight checks of the register part, each over its whole tables."""
    u = units.agg(F.count("*").alias("n"), F.count_distinct("siren").alias("k"), F.count_if(F.col("denominationUniteLegale") == "").alias("vides"))
    e = establishments.agg(F.count("*").alias("m"), F.count_distinct("siret").alias("l"))
    c = companies.agg(F.count("*").alias("c"), F.count_if(F.col("code_naf").isNotNull() | F.coalesce("etat_administratif", F.lit("")).isin(*SENTINELS)).alias("connues"),
                      F.count_if(F.trim("denomination") == "").alias("blancs"), F.count_if(F.col("etat_administratif") == "ETRANGER").alias("etrangers"))
    orphans = own.join(companies.select("siren"), "siren", "left_anti").agg(F.count("*").alias("orphelins"))
    asked = awards.where("siret_titulaire IS NOT NULL").select("siret_titulaire").distinct()
    cover = asked.join(own.select(F.col("siret").alias("siret_titulaire"), F.lit(1).alias("la")).distinct(), "siret_titulaire", "left").agg(F.count("*").alias("demandes"), F.count("la").alias("couverts"))
    one = u
    for side in (e, c, orphans, cover):
        one = one.crossJoin(F.broadcast(side))  # one row each
    share = F.coalesce(F.try_divide("couverts", "demandes"), F.lit(0.0))
    word = lambda *parts: F.concat_ws(" ", *(F.lit(p) if not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts))
    rules = [
        ("volumetrie", (F.col("n") > least_units) & (F.col("m") > least_establishments), word("$n", "unites,", "$m", "etablissements")),
        ("cles_uniques", (F.col("n") == F.col("k")) & (F.col("m") == F.col("l")), word("$k", "et", "$l", "cles")),
        ("statut_connu", F.col("connues") == F.col("c"), word("$connues", "sur", "$c")),
        ("sans_nom_vide", F.col("blancs") == 0, word("$blancs")),
        ("sans_orphelin", F.col("orphelins") == 0, word("$orphelins")),
        ("couverture_etablissements", share >= least_share, word("$couverts", "sur", "$demandes")),
        ("etrangers_isoles", F.col("etrangers") > 0, word("$etrangers")),
        ("sans_texte_vide", F.col("vides") == 0, word("$vides")),
    ]
    lines = F.array(*(F.struct(F.lit(n).alias("controle"), ok.alias("ok"), d.alias("detail")) for n, ok, d in rules))
    return one.select(F.explode(lines).alias("x")).select("x.*")


def cross_check(notices: DataFrame, markets: DataFrame, buyers: DataFrame, days: int = 90) -> DataFrame:
    """Notices (idweb, nomacheteur, date_parution, codes_cpv) with ``recoupe``: whether a market of
    a buyer of the same normalised name and category family lies within ``days``.  Both sides
    meet on (name, family, period), each notice looking at its own period and its neighbours."""
    period = lambda c: F.floor(F.unix_date(c) / F.lit(days + 1))
    known = markets.where("date_notification IS NOT NULL").join(buyers, markets["siret_acheteur"] == buyers["siret"]).select(
        normalise_name(F.col("nom")).alias("nom_n"), F.left(F.coalesce("code_cpv", F.lit("")), F.lit(4)).alias("famille"), "date_notification", period("date_notification").alias("periode")).distinct()
    asked = notices.withColumn("_jour", F.substring("date_parution", 1, 10).try_cast("date")).withColumn("nom_n", normalise_name(F.col("nomacheteur")))
    rows = asked.where("_jour IS NOT NULL AND nom_n <> ''").select("idweb", "nom_n", "_jour", F.explode(F.array_distinct(F.transform("codes_cpv", lambda c: F.left(c, F.lit(4))))).alias("famille"))
    rows = rows.select("*", F.explode(F.array(*(period("_jour") + i for i in (-1, 0, 1)))).alias("periode"))
    met = rows.join(known, ["nom_n", "famille", "periode"]).where(F.abs(F.datediff("date_notification", "_jour")) <= days).select("idweb").distinct()
    return notices.join(met.withColumn("_m", F.lit(True)), "idweb", "left").withColumn("recoupe", F.coalesce("_m", F.lit(False))).drop("_m")


def cross_check_report(checked: DataFrame, samples: int = 10) -> DataFrame:
    """One row: notices, those met and not met, the share, and ``samples`` of those not met."""
    alone = F.filter(F.collect_list(F.struct("date_parution", "nomacheteur", "idweb")), lambda x: F.lit(True))
    few = checked.where("NOT recoupe").orderBy("date_parution", "idweb").limit(samples).agg(alone.alias("exemples"))
    total = checked.agg(F.count("*").alias("avis"), F.count_if("recoupe").alias("recoupes"), F.count_if(~F.col("recoupe")).alias("sans_correspondance"))
    return total.withColumn("part", F.try_divide("recoupes", "avis")).crossJoin(F.broadcast(few))  # one row each


def identity_accuracy(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(type_cas, corrects, total, part) for cases (cas, type_cas, siren_attendu) and results (cas,
    siren): right if the expected company is among the results, or, where none is expected, if
    no result has a company id."""
    got = found.groupBy("cas").agg(F.collect_set("siren").alias("sirens"))
    sirens = F.coalesce("sirens", F.array().cast("array<string>"))
    right = F.when(F.col("siren_attendu").isNull(), F.size(sirens) == 0).otherwise(F.array_contains(sirens, F.col("siren_attendu")))
    rows = cases.join(got, "cas", "left").withColumn("ok", right)
    return rows.groupBy("type_cas").agg(F.count_if("ok").alias("corrects"), F.count("*").alias("total")).withColumn("part", F.try_divide("corrects", "total"))


def incumbent_accuracy(cases: DataFrame, families: DataFrame, left_out: str = "cas_ambigu_multi_titulaires") -> DataFrame:
    """One row: cases right, cases judged, cases left out, and confidences as expected, for cases
    (siret_acheteur, code_cpv, siren_sortant_attendu, confiance_attendue, type_cas)."""
    rows = cases.join(families.select("siret_acheteur", "code_cpv", "siren_sortant", "confiance"), ["siret_acheteur", "code_cpv"], "left")
    out = F.col("type_cas") == left_out
    sure = F.coalesce("confiance", F.lit("aucune")) == F.coalesce("confiance_attendue", F.coalesce("confiance", F.lit("aucune")))
    return rows.agg(F.count_if(~out & F.col("siren_sortant").eqNullSafe(F.col("siren_sortant_attendu"))).alias("corrects"), F.count_if(~out).alias("evalues"),
                    F.count_if(out).alias("exclus"), F.count_if(sure).alias("confiances"))
