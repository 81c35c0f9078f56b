"""Fact sheets, decision blocks and their text for every (buyer, category) at once.

A family with fewer than two markets is widened: to the first category prefix that has two,
and, for competitors and prices alone, to buyers of the same activity (same department first,
else the whole country).  Every fact has a provenance and a coverage from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.plans.family import SCORES
from tenderlake.plans.star import Star
from tenderlake.sources.adapters import stored

# Thresholds, purchasing bodies and the wording of results, which must read the same everywhere.
ENOUGH, SHOWN, COMPARABLE, FOREIGN_MOST = 2, 10, 20, 0.33
BODIES = ("UGAP", "RESAH", "CAIH", "UNIHA")
UNKNOWN_BUYER = "Aucun marché trouvé pour cet acheteur, sur aucun CPV — acheteur sans historique."
NOTHING_FOUND = "Aucune expansion (CPV parent, acheteurs comparables, périmètre national) n'a permis de trouver une donnée exploitable pour cet acheteur/CPV."
NO_FAMILY = "Aucun marché trouvé pour cet acheteur et ce CPV"
BODY = (
    "Marché notifié par une centrale d'achat (%s, détectée via le nom '%s'). L'organisme bénéficiaire réel n'est pas identifiable "
    "dans les données disponibles : DECP/TED rattachent le marché au SIRET de la centrale, jamais à l'établissement final."
)
NO_COMPETITOR = "aucun autre concurrent observé"
PROVENANCE = {
    "titulaire_actuel": "table entreprises, via jointure attributions/marches",
    "duree_restante_mois": "table marches, champ duree_restante_mois (source DECP)",
    "reelle": "calculé : date_notification + durée réelle (table marches)",
    "inferee_famille_cpv": "calculé : date_notification + durée médiane observée sur ce CPV (durée réelle absente de la source, notamment tous les marchés TED)",
    "inconnue": "non calculable : aucune durée, réelle ou inférable, disponible pour ce CPV",
    "date_dernier_marche": "table marches, champ date_notification",
    "nombre_marches_historique": "COUNT sur marches filtré par acheteur et code_cpv",
    "concurrents_observes": "table attributions, entreprises distinctes hors sortant sur la même famille CPV",
    "fourchette_prix_min": "MIN(montant) sur marches de la même famille",
    "fourchette_prix_max": "MAX(montant) sur marches de la même famille",
    "ponderation_acheteur": "aucune source connectée ne publie les critères de pondération prix/technique",
    "elargissement_applique": "agent d'expansion pilotée par la couverture",
    "nb_concurrents_hors_france": "table entreprises, champ etat_administratif = 'ETRANGER'",
}
LEVELS = (8, 6, 4, 2)


def purchasing_body(name: Column) -> Column:
    """The listed purchasing body that a buyer's name contains, else null."""
    return F.coalesce(*(F.when(F.upper(name).contains(b), F.lit(b)) for b in BODIES))


def comparable_buyers(buyers: DataFrame) -> DataFrame:
    """(siret, zone, comparables, liste): up to ``COMPARABLE`` other buyers of the same activity, the
    smallest first; of the same department, else of the country.  Of a group its first 21 rows
    give every member 20 others, so no pair of a whole group is made.  ``liste`` is the same for
    buyers with the same list: all of a group but its first 20, who leave themselves out."""
    def near(zone: str, *keys: str) -> DataFrame:
        known = buyers.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        first = known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("siret"))).where(F.col("_n") <= COMPARABLE + 1)
        lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list("siret")).alias("_all"))
        found = F.slice(F.filter("_all", lambda s: s != F.col("siret")), 1, COMPARABLE)
        out = F.when(F.array_contains(F.slice("_all", 1, COMPARABLE), F.col("siret")), F.col("siret"))
        which = F.struct(F.lit(zone).alias("zone"), *((F.col(k).cast("string") if k in keys else F.lit("")).alias(k) for k in ("naf", "departement")), F.coalesce(out, F.lit("")).alias("sauf"))
        return known.join(lists, list(keys)).select("siret", F.lit(zone).alias("zone"), found.alias(f"c_{zone}"), which.alias(f"l_{zone}"))

    local, wide = near("departement", "naf", "departement"), near("national", "naf")
    met = wide.select("siret", "c_national", "l_national").join(local.select("siret", "c_departement", "l_departement"), "siret", "left")
    some = F.size(F.coalesce("c_departement", F.array())) > 0
    return met.select("siret", F.when(some, "departement").otherwise("national").alias("zone"), F.when(some, F.col("c_departement")).otherwise(F.col("c_national")).alias("comparables"),
                      F.when(some, F.col("l_departement")).otherwise(F.col("l_national")).alias("liste"))


def expansion(star: Star, families: DataFrame | None = None) -> DataFrame:
    """One row for each (buyer, category) of the markets: the level used, what was tried, and
    the comparable buyers that widen competitors and prices."""
    found = (families if families is not None else star.families("SELECT * FROM families", LEVELS)).select("siret_acheteur", "niveau", "famille", "nb_marches")
    asked = star.marches.select("siret_acheteur", "code_cpv").distinct()
    levels = asked.withColumn("niveau", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("famille", F.left("code_cpv", F.col("niveau")))
    counted = levels.join(found, ["siret_acheteur", "niveau", "famille"], "left").groupBy("siret_acheteur", "code_cpv").agg(
        *(F.coalesce(F.max(F.when(F.col("niveau") == n, F.col("nb_marches"))), F.lit(0)).alias(f"n{n}") for n in LEVELS)
    )
    enough = F.coalesce(*(F.when(F.col(f"n{n}") >= ENOUGH, n) for n in LEVELS))
    some = F.coalesce(*(F.when(F.col(f"n{n}") >= 1, n) for n in LEVELS))
    poor = F.col("n8") < ENOUGH
    buyers = star.acheteurs
    chosen = counted.withColumn("niveau", F.coalesce(enough, some, F.lit(8))).withColumn("enough", enough.isNotNull()).withColumn("poor", poor)
    tried = [F.when(F.col("poor") & (~F.col("enough") | (F.col("niveau") <= n)), F.concat(F.lit("cpv_parent: "), F.left("code_cpv", F.lit(n)))) for n in LEVELS[1:]]
    near = comparable_buyers(buyers)
    joined = chosen.join(buyers.select(F.col("siret").alias("siret_acheteur"), "nom", "naf", "departement"), "siret_acheteur", "left").join(
        near.withColumnRenamed("siret", "siret_acheteur"), "siret_acheteur", "left"
    )
    used = F.when(F.col("poor"), F.coalesce("comparables", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    joined = joined.withColumn("comparables", used)
    count = F.size("comparables").cast("string")
    said = F.when(F.size("comparables") > 0, F.when(F.col("zone") == "departement", F.concat(
        F.lit("acheteurs_comparables_departement: "), count, F.lit(" acheteur(s), NAF "), "naf", F.lit(", département "), F.col("departement").cast("string")
    )).otherwise(F.concat(F.lit("perimetre_geographique_national: "), count, F.lit(" acheteur(s), NAF "), "naf", F.lit(", France entière"))))
    tried = F.array_compact(F.array(*tried, said, F.when(F.col("poor"), F.lit("fenetre_temporelle: non applicable"))))
    return joined.select(
        "siret_acheteur", "code_cpv", "nom", "poor", "niveau", F.left("code_cpv", F.col("niveau")).alias("famille"),
        "comparables", F.when(F.size("comparables") > 0, F.col("liste")).alias("liste"), F.when(F.col("poor"), tried).otherwise(F.array().cast("array<string>")).alias("expansions"),
    )


def _rivals(star: Star, asked: DataFrame) -> DataFrame:
    """(fid, total, elargi, prix_min, prix_max, combien, etrangers, rivaux) of every asked ``fid``: prices and other
    companies, from its own dated awards and from those of comparable buyers; ``rivaux`` are the ``SHOWN`` most frequent.

    Awards are counted once for each (buyer, category, company).  Buyers share lists of comparable ones, so what a list
    adds is summed once for each (list, level, prefix) and meets an asked family as one row: its figures, corrected by
    the family's own companies, and its most frequent companies.  One more than is shown is enough of these: the
    incumbent goes, and a company that the family has itself only rises.
    """
    keys, row = ["niveau", "famille"], F.struct
    rows = star.sql("""SELECT m.siret_acheteur AS _autre, m.code_cpv, e.denomination, a.siren, m.date_notification, m.montant,
      CAST(coalesce(e.etat = 'ETRANGER', false) AS INT) AS etranger FROM {marches} m JOIN {attributions} a ON m.uid = a.uid JOIN {entreprises} e ON a.siren = e.siren""")
    dated, amount = F.col("date_notification").isNotNull(), F.when(F.col("montant") != 0, F.col("montant"))
    base = stored(rows.groupBy("_autre", "code_cpv", "denomination").agg(
        F.count("*").alias("tous"), F.count_if(dated).alias("propres"), F.max("etranger").alias("etranger"), F.max(F.when(dated, F.col("etranger"))).alias("etranger_propre"),
        F.min("montant").alias("bas"), F.max("montant").alias("haut"), F.min(F.when(dated, amount)).alias("bas_propre"), F.max(F.when(dated, amount)).alias("haut_propre"),
        F.min(F.when(dated, F.struct((-F.unix_date("date_notification")).alias("j"), F.col("siren").alias("s")))).alias("vu"),
    ))
    within = F.left("code_cpv", F.col("niveau")) == F.col("famille")
    order = lambda o, j, s, e: row((-F.col("nb")).alias("n"), F.lit(o).alias("o"), j.alias("j"), s.alias("s"), "denomination", "nb", (F.col(e) == 1).alias("etranger"))

    # What each list adds.  Each (list, level, prefix) has a number, so that rows which go through exchanges do not carry its texts.
    lists = stored(asked.where("liste IS NOT NULL").select("liste", *keys).distinct().withColumn("lid", F.monotonically_increasing_id()))
    members = comparable_buyers(star.acheteurs).select("liste", "comparables").distinct().select("liste", F.explode("comparables").alias("_autre"))
    near = stored(lists.join(members, "liste").drop("liste").join(base, "_autre").where(within).groupBy("lid", "denomination").agg(
        F.sum("tous").alias("nb"), F.max("etranger").alias("e"), F.min("bas").alias("bas"), F.max("haut").alias("haut")))
    named = F.col("denomination").isNotNull()
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("nb"), F.asc_nulls_last("denomination"))))
    first = F.collect_list(F.when(named & (F.col("_r") <= SHOWN + 2), order(1, F.lit(0), F.col("denomination"), "e")))  # one null name may be among them
    of_list = ranked.groupBy("lid").agg(
        F.sum("nb").alias("l_total"), F.min("bas").alias("l_bas"), F.max("haut").alias("l_haut"), F.count_if(named).alias("l_combien"),
        F.sum(F.when(named, F.col("e"))).alias("l_etrangers"), first.alias("l_premiers"))

    # What each family has itself.
    ask = asked.join(lists, ["liste", *keys], "left").select("fid", "sortant", F.col("siret_acheteur").alias("_autre"), "lid", *keys)
    other = F.coalesce(F.col("denomination") != F.col("sortant"), F.lit(False))

    def own(some: DataFrame) -> DataFrame:
        return some.join(base.where("propres > 0"), "_autre").where(within).groupBy("_autre", "fid", "sortant", "lid", "denomination").agg(
            F.sum("propres").alias("propres"), F.max("etranger_propre").alias("e"), F.min("bas_propre").alias("bas"), F.max("haut_propre").alias("haut"), F.min("vu").alias("vu"))

    def summed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("nb", F.col("propres") + F.coalesce("l_nb", F.lit(0))).withColumn("_e", F.greatest("e", "l_e")).withColumn("_r", F.row_number().over(
            Window.partitionBy("_autre", "fid").orderBy(other.desc(), F.desc("nb"), F.col("vu.j"), F.col("vu.s"), "denomination")))
        met = F.col("l_nb").isNotNull()
        return rows.groupBy("_autre", "fid", "sortant", "lid").agg(
            F.sum("propres").alias("total"), F.min("bas").alias("bas"), F.max("haut").alias("haut"),
            (F.count_if(other & ~met) - F.count_if((F.col("denomination") == F.col("sortant")) & met)).alias("combien"),
            F.sum(F.when(other, F.col("_e")).otherwise(0) - F.when(other | (F.col("denomination") == F.col("sortant")), F.coalesce("l_e", F.lit(0))).otherwise(0)).alias("etrangers"),
            F.collect_list(F.when(other & (F.col("_r") <= SHOWN), order(0, F.col("vu.j"), F.col("vu.s"), "_e"))).alias("premiers"))

    figures = ["fid", "total", "elargi", "prix_min", "prix_max", "combien", "etrangers", "rivaux"]
    alone = summed(own(ask.where("lid IS NULL")).withColumn("l_nb", F.lit(None).cast("long")).withColumn("l_e", F.lit(None).cast("int"))).select(
        "*", F.lit(0).alias("elargi"), F.col("bas").alias("prix_min"), F.col("haut").alias("prix_max"), F.array_sort("premiers").alias("rivaux"))
    more = near.select("lid", "denomination", F.col("nb").alias("l_nb"), F.col("e").alias("l_e"))
    wide = summed(own(ask.where("lid IS NOT NULL")).join(more, ["lid", "denomination"], "left")).join(of_list, "lid", "left")
    new = F.filter(F.coalesce("l_premiers", F.array_except("premiers", "premiers")), lambda x: (x["denomination"] != F.col("sortant")) & ~F.array_contains(F.transform("premiers", lambda y: y["denomination"]), x["denomination"]))
    wide = wide.select(
        "fid", (F.col("total") + F.coalesce("l_total", F.lit(0))).alias("total"), F.when(F.col("l_total").isNotNull(), 1).otherwise(0).alias("elargi"),
        F.least("bas", "l_bas").alias("prix_min"), F.greatest("haut", "l_haut").alias("prix_max"), (F.col("combien") + F.coalesce("l_combien", F.lit(0))).alias("combien"),
        (F.col("etrangers") + F.coalesce("l_etrangers", F.lit(0))).alias("etrangers"), F.slice(F.array_sort(F.concat("premiers", new)), 1, SHOWN).alias("rivaux"))
    return alone.select(*figures).unionByName(wide.select(*figures))


def _fact(cle: str, couverture: Column, texte=None, nombre=None, liste=None, provenance=None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        F.lit(cle).alias("cle"), (texte if texte is not None else none("string")).alias("texte"),
        (nombre.cast("double") if nombre is not None else none("double")).alias("nombre"),
        (liste if liste is not None else none("array<string>")).alias("liste"),
        (provenance if provenance is not None else F.lit(PROVENANCE[cle])).alias("provenance"), couverture.cast("double").alias("couverture"),
    )


def fact_sheets(star: Star) -> DataFrame:
    """siret_acheteur, code_cpv, nom, confiance, faits (cle, texte, nombre, liste, provenance,
    couverture), couverture_globale, raison, marches_support, nb_marches: one row for each (buyer, category)
    of the markets.  ``faits`` is empty, and ``raison`` says why, for purchasing bodies and where
    no widening finds anything.  A fact's value is a text, a number or a list; none if unknown."""
    families = stored(star.families("SELECT * FROM families", LEVELS))
    asked = expansion(star, families)
    key = ["siret_acheteur", "code_cpv"]
    found = stored(asked.drop("comparables", "poor").join(families.drop("transitions", "coherentes"), ["siret_acheteur", "niveau", "famille"], "left").withColumn("fid", F.monotonically_increasing_id()))
    rivals = _rivals(star, found.select("fid", "siret_acheteur", "niveau", "famille", "liste", "sortant").where("sortant IS NOT NULL"))
    f = found.join(rivals, "fid", "left").withColumn("combien", F.coalesce("combien", F.lit(0).cast("long")))
    foreign = F.coalesce("etrangers", F.lit(0).cast("long"))
    shown = F.transform(F.slice("rivaux", 1, SHOWN), lambda r: F.concat(
        r["denomination"], F.when(r["etranger"], F.lit(" [hors France]")).otherwise(F.lit("")), F.lit(" ("), r["nb"].cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" attribution(s))")))
    more = F.col("combien") - SHOWN
    rest = F.when(more > 0, F.array(F.concat(F.lit("... et "), more.cast("string"), F.lit(" autre(s) concurrent(s) observé(s)")))).otherwise(F.array().cast("array<string>"))
    score = F.coalesce(*(F.when(F.col("confiance") == c, F.lit(v)) for c, v in SCORES.items()), F.lit(0.0))
    half = F.coalesce(F.col("elargi") == 1, F.lit(False))
    dated = F.col("date_expiration").isNotNull()
    f = f.withColumn("score", score).withColumn("etrangers", foreign).withColumn("corps", purchasing_body(F.col("nom")))
    expiry = F.when(dated & (F.col("duree_source") == "reelle"), F.col("score")).when(dated & (F.col("duree_source") == "inferee_famille_cpv"), F.round(F.col("score") * 0.5, 2)).otherwise(0.0)
    rivalry = F.when(F.coalesce("total", F.lit(0)) > 1, F.col("score")).otherwise(0.0)
    rivalry = F.when(F.col("etrangers") > 0, F.least(rivalry, F.lit(FOREIGN_MOST))).otherwise(rivalry)
    price = F.when(F.col("prix_min").isNotNull(), F.col("score")).otherwise(0.0)
    rivalry, price = (F.when(half, F.round(c * 0.5, 2)).otherwise(c) for c in (rivalry, price))
    source = F.coalesce(*(F.when(F.col("duree_source") == s, F.lit(PROVENANCE[s])) for s in ("reelle", "inferee_famille_cpv")), F.lit(PROVENANCE["inconnue"]))
    facts = [
        _fact("titulaire_actuel", F.col("score"), texte=F.col("sortant")),
        _fact("duree_restante_mois", F.when(F.col("duree_restante_mois").isNotNull(), F.col("score")).otherwise(0.0), nombre=F.col("duree_restante_mois")),
        _fact("date_expiration_estimee", expiry, texte=F.coalesce(F.col("date_expiration").cast("string"), F.lit("inconnue")), provenance=source),
        _fact("date_dernier_marche", F.col("score"), texte=F.col("date_dernier").cast("string")),
        _fact("nombre_marches_historique", F.col("score"), nombre=F.col("nb_marches")),
        _fact("concurrents_observes", rivalry, texte=F.when(F.col("combien") == 0, F.lit(NO_COMPETITOR)), liste=F.when(F.col("combien") > 0, F.concat(shown, rest))),
        _fact("fourchette_prix_min", price, nombre=F.col("prix_min")),
        _fact("fourchette_prix_max", price, nombre=F.col("prix_max")),
        _fact("ponderation_acheteur", F.lit(0.0), texte=F.lit("non disponible")),
    ]
    widened = F.when(F.size("expansions") > 0, _fact("elargissement_applique", F.lit(0.5), texte=F.array_join("expansions", "; ")))
    abroad = F.when(F.col("etrangers") > 0, _fact("nb_concurrents_hors_france", F.lit(1.0), nombre=F.col("etrangers")))
    full = F.array_compact(F.array(*facts, widened, abroad))
    f = f.withColumn("_faits", full)
    body = F.col("corps").isNotNull()
    empty = body | F.col("sortant").isNull()
    mean = F.round(F.aggregate("_faits", F.lit(0.0), lambda s, x: s + x["couverture"]) / F.size("_faits"), 2)
    reason = F.when(body, F.format_string(BODY, "nom", "corps")).when(F.col("sortant").isNull() & F.col("liste").isNotNull(), NO_FAMILY).when(F.col("sortant").isNull(), NOTHING_FOUND)
    return f.select(
        *key, "nom", "confiance", F.when(empty, F.filter("_faits", lambda x: F.lit(False))).otherwise(F.col("_faits")).alias("faits"),
        F.when(empty, 0.0).otherwise(mean).alias("couverture_globale"), reason.alias("raison"),
        F.when(~empty, F.col("marches_support")).alias("marches_support"), F.when(~empty, F.col("nb_marches")).alias("nb_marches"),
    )


def section_coverage(sheets: DataFrame) -> DataFrame:
    """(cle, fiches, renseignees, couverture): of each section how many sheets have it, in how many it is covered, and its mean coverage."""
    each = sheets.select(F.explode("faits").alias("f")).select("f.cle", "f.couverture")
    return each.groupBy("cle").agg(F.count("*").alias("fiches"), F.count_if(F.col("couverture") > 0).alias("renseignees"), F.round(F.avg("couverture"), 4).alias("couverture"))


def fact(cle: str) -> Column:
    """The fact of a name in ``faits``, null where it is missing."""
    return F.get(F.filter("faits", lambda x: x["cle"] == cle), 0)


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def money(c: Column) -> Column:
    """Whole euros with blanks between thousands."""
    return F.translate(F.format_number(c.cast("double"), 0), ",", " ")


def _number(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def decision_lines(sheets: DataFrame) -> Column:
    """The block of eight lines, or of three where there are no facts."""
    said = lambda c: F.coalesce(fact(c)["texte"], F.array_join(fact(c)["liste"], ", "))
    cover = lambda c: F.concat(F.lit("(couverture: "), percent(fact(c)["couverture"]), F.lit(")"))
    n = _number(fact("nombre_marches_historique")["nombre"])
    low, high = fact("fourchette_prix_min")["nombre"], fact("fourchette_prix_max")["nombre"]
    price = F.when(low.isNull(), F.concat(F.lit("non disponible (n="), n, F.lit(", aucun montant publié sur cette famille)"))).otherwise(
        F.concat(money(low), F.lit(" € — "), money(high), F.lit(" € (n="), n, F.lit(", indicatif)")))
    support = F.when(F.size("marches_support") > 0, F.concat(
        F.lit(" — marché du sortant : "), F.get("marches_support", F.lit(0)), F.lit(" (sur "), F.col("nb_marches").cast("long").cast("string"), F.lit(" marché(s) en source)"))).otherwise(F.lit(""))
    head = F.concat(F.lit("Acheteur : "), F.coalesce("nom", "siret_acheteur"), F.lit(" | Objet CPV : "), "code_cpv")
    full = F.array(
        head,
        F.concat(F.lit("Sortant probable : "), said("titulaire_actuel"), F.lit(", confiance "), "confiance", F.lit(" "), cover("titulaire_actuel")),
        F.concat(F.lit("Échéance estimée : "), said("date_expiration_estimee"), F.lit(" (dernier marché: "), said("date_dernier_marche"), F.lit(") "), cover("date_expiration_estimee")),
        F.concat(F.lit("Concurrents observés : "), said("concurrents_observes"), F.lit(" "), cover("concurrents_observes")),
        F.concat(F.lit("Fourchette de prix : "), price, F.lit(" "), cover("fourchette_prix_min")),
        F.concat(F.lit("Pondération de l'acheteur : "), said("ponderation_acheteur"), F.lit(" "), cover("ponderation_acheteur")),
        F.concat(F.lit("Historique : "), n, F.lit(" marché(s) similaire(s) observé(s)"), support),
        F.concat(F.lit("COUVERTURE GLOBALE : "), percent(F.col("couverture_globale"))),
    )
    few = F.array(head, F.concat(F.lit("DONNÉES INSUFFISANTES : "), F.coalesce("raison", F.lit("aucune information disponible"))), F.lit("COUVERTURE GLOBALE : 0%"))
    return F.when(F.size("faits") == 0, few).otherwise(full)


def template_text() -> Column:
    """The sentence of a sheet by the fixed template; what is missing is said to be missing."""
    said = lambda c: fact(c)["texte"]
    n = _number(fact("nombre_marches_historique")["nombre"])
    low, high = fact("fourchette_prix_min")["nombre"], fact("fourchette_prix_max")["nombre"]
    rivals = F.concat(F.lit("Concurrents observés : "), F.coalesce(F.array_join(fact("concurrents_observes")["liste"], ", "), said("concurrents_observes")), F.lit("."))
    price = F.when(low.isNull(), F.concat(F.lit("non disponible (n="), n, F.lit(", aucun montant publié sur cette famille)"))).otherwise(
        F.concat(_number(low), F.lit(" € à "), _number(high), F.lit(" € (n="), n, F.lit(", indicatif)")))
    full = F.concat(
        F.lit("Titulaire actuel probable : "), said("titulaire_actuel"), F.lit(" (dernier marché notifié le "), said("date_dernier_marche"),
        F.lit(", échéance estimée : "), said("date_expiration_estimee"), F.lit("). "), rivals, F.lit(" Fourchette de prix constatée : "), price,
        F.lit(". Pondération de l'acheteur : "), said("ponderation_acheteur"), F.lit(". Basé sur "), n,
        F.lit(" marché(s) similaire(s) (couverture globale : "), percent(F.col("couverture_globale")), F.lit(")."),
    )
    few = F.concat(F.lit("Données insuffisantes : "), F.regexp_replace(F.coalesce("raison", F.lit("aucune information disponible")), r"[. ]+\z", ""), F.lit("."))
    return F.when(F.size("faits") == 0, few).otherwise(full)
