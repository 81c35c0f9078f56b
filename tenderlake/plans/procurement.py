"""Queries that apply the library's own functions to the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions import text
from tenderlake.functions.verify import verify
from tenderlake.operators import identity, quality, vector_index, vectors, versions
from tenderlake.plans import facts, gold, silver
from tenderlake.plans.family import FAMILY
from tenderlake.plans.star import Star
from tenderlake.sources import notices, readers
from tenderlake.sources.adapters import BRONZE, CANON, run, shared, stored
from tenderlake import sinks

#: The day that "today" is for these tables, and the first plausible one.
TODAY, FIRST = "1998-06-30", "1993-01-01"


def _family(columns: str, source: str = "families", levels: tuple[int, ...] = (8,)):
    return lambda spark, sf_dir: Star.of_tables(spark, sf_dir).families(f"SELECT {columns} FROM {source}", levels)


_KEY = "siret_acheteur, famille AS code_cpv"
incumbent_by_family = _family(f"""{_KEY}, siren_sortant, sortant, uid_dernier, date_dernier, date_expiration, duree_source, CAST(nb_marches AS BIGINT) AS nb_marches,
  CAST(nb_vagues AS BIGINT) AS nb_vagues, round(ratio, 6) AS ratio, confiance""")
renewal_chain_position = _family(f"{_KEY}, uid, date_notification, CAST(position AS BIGINT) AS position", "chained")
notification_waves = _family(f"{_KEY}, CAST(vague AS BIGINT) AS vague, debut, fin, nb AS nb_marches", "vagues")
wave_coherence = _family(f"{_KEY}, CAST(nb_vagues AS BIGINT) AS nb_vagues, CAST(transitions AS BIGINT) AS transitions, CAST(coherentes AS BIGINT) AS coherentes, round(ratio, 6) AS ratio, confiance")
estimated_expiry = _family(f"{_KEY}, uid, fin AS date_expiration, duree_source", "chained")
price_range = _family(f"{_KEY}, min(montant) AS prix_min, max(montant) AS prix_max, count(*) AS n", f"chained GROUP BY {FAMILY}")
incumbent_by_prefix = _family("siret_acheteur, famille, siren_sortant, date_expiration, duree_source, CAST(nb_marches AS BIGINT) AS nb_marches, confiance", levels=(6, 4, 2))
median_duration_by_category = _family("code_cpv, mediane", "medians")


def near_duplicates(spark: SparkSession, sf_dir: str, share: float = 0.01, days: int = 30) -> DataFrame:
    rows = silver.flag_duplicates(run(spark, sf_dir, f"WITH {CANON} SELECT * FROM marches"), share, days).where("doublon_probable_de IS NOT NULL")
    return rows.select(F.col("uid").alias("uid_ted"), F.col("doublon_probable_de").alias("uid_decp"))


def _sheet_figures(sheets: DataFrame) -> DataFrame:
    cover = lambda c: facts.fact(c)["couverture"]
    return sheets.where(F.size("faits") > 0).select(
        "siret_acheteur", "code_cpv", cover("titulaire_actuel").alias("couv_titulaire"), cover("date_expiration_estimee").alias("couv_expiration"),
        cover("concurrents_observes").alias("couv_concurrents"), cover("fourchette_prix_min").alias("couv_prix"), facts.fact("fourchette_prix_min")["nombre"].alias("prix_min"),
        facts.fact("fourchette_prix_max")["nombre"].alias("prix_max"), F.size("faits").cast("long").alias("nb_faits"),
        F.coalesce(facts.fact("nb_concurrents_hors_france")["nombre"].cast("long"), F.lit(0).cast("long")).alias("hors_france"), "couverture_globale",
        facts.fact("duree_restante_mois")["nombre"].alias("mois_restants"),
    )


def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet_figures(facts.fact_sheets(Star.of_tables(spark, sf_dir))).drop("mois_restants")


def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.section_coverage(facts.fact_sheets(Star.of_tables(spark, sf_dir)))


def silver_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a published silver whose text did not cast, and what did not."""
    decp, ted, _ = _bronze(spark, sf_dir)
    typed = stored(silver.markets(decp, ted, F.lit(TODAY).cast("date"), FIRST))
    folder = shared(spark)
    silver.publish(typed, typed.select("uid"), folder, most=0.5)
    return sinks.current(spark, folder, "silver", "rejets").select("uid", "source", F.array_join("rejets", ",").alias("rejets"))


def competitor_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitors of each family by number of awards, the ten most frequent and how many more."""
    star = Star.of_tables(spark, sf_dir)
    # The incumbent comes from the chain itself, so that its windows run once.
    rows = star.families(f"""SELECT siret_acheteur, famille AS code_cpv, uid, date_notification,
      first_value(denomination) OVER (PARTITION BY {FAMILY} ORDER BY date_notification DESC, siren, uid) AS sortant FROM chained""")
    won = star.attributions.join(star.entreprises.select("siren", "denomination"), "siren")
    key = ["siret_acheteur", "code_cpv"]
    each = rows.join(won, "uid").where("denomination <> sortant").groupBy(*key, "denomination").agg(F.count("*").alias("nb"), F.max(F.unix_date("date_notification")).alias("vu"))
    w = Window.partitionBy(*key)
    ranked = each.withColumn("autres", F.greatest(F.count("*").over(w) - 10, F.lit(0))).withColumn(
        "rang", F.row_number().over(w.orderBy(F.desc("nb"), F.desc("vu"), "denomination")))
    return ranked.where("rang <= 10").select(*key, "denomination", "nb", F.col("rang").cast("long").alias("rang"), "autres")


def decision_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts.fact_sheets(Star.of_tables(spark, sf_dir))
    lines = s.select("siret_acheteur", "code_cpv", facts.decision_lines(s).alias("l"))
    return lines.select("siret_acheteur", "code_cpv", *(F.get("l", F.lit(i)).alias(f"ligne_{i + 1}") for i in range(8)))


def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(facts.fact_sheets(Star.of_tables(spark, sf_dir)), facts.template_text()).select("siret_acheteur", "code_cpv", "texte", "valide")


def rejected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an invented amount, name and date, and what the check finds in them."""
    said = F.concat(facts.template_text(), F.lit(" Zorglub Conseil, 7 654 321 € le 30/02/2031, QWERTZ GROUPE"))
    rows = verify(facts.fact_sheets(Star.of_tables(spark, sf_dir)), said)
    list_ = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("siret_acheteur", "code_cpv", "valide", F.array_contains("nombres_non_justifies", "7654321").alias("nombre_vu"),
                       list_("noms_non_justifies").alias("noms"), list_("dates_non_justifiees").alias("dates"))


def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.expansion(Star.of_tables(spark, sf_dir))
    return e.select("siret_acheteur", "code_cpv", F.col("niveau").cast("long").alias("niveau"), F.size("comparables").cast("long").alias("nb_comparables"), F.array_join("expansions", "; ").alias("essais"))


def comparable_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = run(spark, sf_dir, f"WITH {CANON} SELECT siret, CASE WHEN siret LIKE '%7' THEN concat(naf, siret) ELSE naf END AS naf, CASE WHEN siret LIKE '%3' THEN siret ELSE CAST(departement AS STRING) END AS departement FROM acheteurs")
    return facts.comparable_buyers(b).select("siret", "zone", F.posexplode("comparables").alias("n", "comparable")).withColumn("n", F.col("n").cast("long") + 1)


def purchasing_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = run(spark, sf_dir, "SELECT c_custkey, concat(CASE c_custkey % 5 WHEN 0 THEN 'Ugap ' WHEN 1 THEN 'GCS UniHA ' WHEN 2 THEN 'Resah-' ELSE '' END, c_name) AS nom FROM customer")
    body = facts.purchasing_body(F.col("nom"))
    return b.select("c_custkey", body.alias("centrale"), F.format_string(facts.BODY, "nom", body).alias("message")).where("centrale IS NOT NULL")


def _bronze(spark: SparkSession, sf_dir: str):
    read = lambda name: run(spark, sf_dir, f"WITH {BRONZE} SELECT * FROM {name}")
    register = read("registre").select(
        "siren", "denomination", "etat", F.lit(None).cast("string").alias("nom_personne"), F.lit(None).cast("array<string>").alias("prenoms"), "siret_siege")
    return read("bronze_decp"), read("bronze_ted"), register


def _silver(spark, sf_dir):
    decp, ted, register = _bronze(spark, sf_dir)
    return silver.rebuild(decp, ted, register, F.lit(TODAY).cast("date"), FIRST)


def silver_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    decp, ted, _ = _bronze(spark, sf_dir)
    return silver.markets(decp, ted, F.lit(TODAY).cast("date"), FIRST).select(
        "uid", "source", "siret_acheteur", "nom_acheteur", "objet", F.col("montant").cast("double").alias("montant"), "code_cpv", "date_notification",
        F.col("duree_mois").cast("double").alias("duree_mois"), "modification_id", F.array_join("rejets", ",").alias("rejets"))


def silver_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    decp, ted, register = _bronze(spark, sf_dir)
    typed = silver.markets(decp, ted, F.lit(TODAY).cast("date"), FIRST)
    return silver.resolve_buyers(typed, decp, ted, register).select(
        "uid", "siret_acheteur", "nom_acheteur", "methode_resolution_acheteur", F.round("score_confiance_acheteur", 4).alias("score_confiance_acheteur"))


def silver_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir)[1].withColumn("score_confiance", F.round("score_confiance", 4))


def silver_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.volumes(*_silver(spark, sf_dir))


def silver_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.methods(*_silver(spark, sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[gold.Gold, DataFrame]:
    """Gold after two builds, the first from half of silver, through a published version; and silver."""
    markets, awards = _silver(spark, sf_dir)
    awards, folder = stored(awards), shared(spark)
    gold.publish(gold.build(markets.where("crc32(uid) % 2 = 0"), awards), folder)
    gold.publish(gold.build(markets, awards, gold.current(spark, folder)), folder)
    return gold.current(spark, folder), markets


def gold_star_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)[0].acheteurs


def gold_from_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold markets: buyer resolved, no duplicate, in scope."""
    return _gold(spark, sf_dir)[0].marches.select("uid", "siret_acheteur", "code_cpv", "date_notification")


def gold_star_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)[0].entreprises.select("siren", "denomination", "est_active")


def gold_star_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards of gold with the method and score that silver gave them."""
    return _gold(spark, sf_dir)[0].attributions.withColumn("score_confiance", F.round("score_confiance", 4))


def gold_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken links of gold, and its markets that a later silver without one category no longer supports."""
    built, markets = _gold(spark, sf_dir)
    gone = gold.stale(built, markets.where("code_cpv <> '72220000'")).agg(F.count("*").alias("nb"))
    return gold.orphans(built).unionByName(gone.select(F.lit("perimes").alias("lien"), "nb"))


def gold_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact sheets of gold from bronze text, with what is left of contracts; the register knows some buyers."""
    built, _ = _gold(spark, sf_dir)
    units = run(spark, sf_dir, "SELECT concat('9', lpad(CAST(c_custkey AS STRING), 8, '0')) AS siren, c_mktsegment AS activitePrincipaleUniteLegale FROM customer")
    places = run(spark, sf_dir, "SELECT concat('9', lpad(CAST(c_custkey AS STRING), 8, '0')) AS siren, concat('9', lpad(CAST(c_custkey AS STRING), 8, '0'), '00002') AS siret, concat(lpad(CAST(c_nationkey AS STRING), 2, '0'), '000') AS codePostalEtablissement FROM customer")
    return _sheet_figures(facts.fact_sheets(built.star(units, places)))


def identifier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run(spark, sf_dir, """SELECT doc_id, CASE doc_id % 7
       WHEN 0 THEN lpad(CAST(doc_id AS STRING), 14, '1') WHEN 1 THEN concat('SIRET: 123 456 789 ', lpad(CAST(doc_id AS STRING), 5, '0'))
       WHEN 2 THEN concat('FR12', lpad(CAST(doc_id AS STRING), 9, '0')) WHEN 3 THEN concat('siren ', lpad(CAST(doc_id AS STRING), 9, '0'))
       WHEN 4 THEN concat('DE', CAST(doc_id AS STRING)) WHEN 5 THEN concat(lpad(CAST(doc_id AS STRING), 9, '2'), '; ', lpad(CAST(doc_id AS STRING), 14, '3'))
       ELSE concat('x', CAST(doc_id AS STRING)) END AS identifiant FROM documents""")
    return raw.select("doc_id", F.posexplode(text.identifier_rules(F.col("identifiant"))).alias("place", "r")).select(
        "doc_id", F.col("place").cast("long").alias("place"), "r.siret", "r.siren", "r.methode", "r.pays_etranger")


def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = run(spark, sf_dir, "SELECT doc_id, coalesce(text, '') AS text FROM documents")
    n = lambda c: F.size(c).cast("long")
    return docs.select("doc_id", n(text.numbers(F.col("text"))).alias("nombres"), n(text.dates(F.col("text"))).alias("dates"), n(text.capitalised_words(F.col("text"))).alias("mots"))


def siren_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, """SELECT s_suppkey, concat('Siren ', CASE s_suppkey % 3 WHEN 0 THEN lpad(CAST(s_suppkey AS STRING), 9, '4')
      WHEN 1 THEN concat('444.444.', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0')) ELSE concat('444 444 ', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0')) END, ', tel 0102030405') AS t FROM supplier""")
    return rows.select("s_suppkey", F.explode(text.siren_mentions(F.col("t"))).alias("siren"))


def html_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a search page made of supplier and nation names."""
    pages = run(spark, sf_dir, """SELECT n_nationkey, concat('<div>', array_join(transform(array_sort(collect_list(s_name)), s -> concat('<a class="result__a" href="/x">', s, ' &amp; <b>Co</b></a>\n<p><a class="result__snippet">siège : ', n_name, '</a>')), ''), '</div>') AS html
      FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
    found = notices.search_results(pages, "n_nationkey")
    return found.select("n_nationkey", F.col("rang").cast("long").alias("rang"), "resultat")


def web_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company ids that two results of a supplier's search state, where the register has that name."""
    mentions = run(spark, sf_dir, """SELECT CAST(s_suppkey AS STRING) AS key, r AS result, concat('n° ', lpad(CAST(CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + r ELSE s_suppkey END AS STRING), 9, '0')) AS t
      FROM supplier LATERAL VIEW explode(array(1, 2)) x AS r""").select("key", "result", F.explode(text.siren_mentions(F.col("t"))).alias("siren"))
    keys = run(spark, sf_dir, "SELECT CAST(s_suppkey AS STRING) AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'Autre' ELSE s_name END AS nom FROM supplier")
    register = run(spark, sf_dir, "SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, concat('SARL ', s_name) AS denomination, concat(lpad(CAST(s_suppkey AS STRING), 9, '0'), '00001') AS siret_siege FROM supplier")
    return identity.by_web(mentions, keys, register)


def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old names of companies, from answers with periods, found by names that nobody bears now."""
    answers = run(spark, sf_dir, """SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, to_json(named_struct('uniteLegale', named_struct('periodesUniteLegale', array(
        named_struct('denominationUniteLegale', s_name, 'dateDebut', '2015-01-01', 'dateFin', CAST(NULL AS STRING)),
        named_struct('denominationUniteLegale', concat('Ancienne ', s_name), 'dateDebut', '2001-01-01', 'dateFin', '2014-12-31'))))) AS reponse FROM supplier""")
    history = notices.past_names(answers).withColumn("siret_siege", F.concat("siren", F.lit("00001")))
    keys = run(spark, sf_dir, "SELECT CAST(s_suppkey AS STRING) AS key, CASE WHEN s_suppkey % 2 = 0 THEN concat('ANCIENNE ', s_name, ' SARL') ELSE s_name END AS nom FROM supplier")
    return identity.by_history(keys, history)


def json_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result notices with a category as an object, as a list, or unreadable."""
    raw = run(spark, sf_dir, """SELECT to_json(named_struct('idweb', CAST(event_id AS STRING), 'nomacheteur', event_type, 'titulaire', CAST(NULL AS STRING), 'objet', 'o', 'dateparution', CAST(CAST(ts AS DATE) AS STRING),
      'code_departement', array('75', '92'), 'donnees', CASE event_id % 4
        WHEN 0 THEN concat('{"OBJET":{"CPV":{"PRINCIPAL":"72', lpad(CAST(user_id % 100 AS STRING), 6, '0'), '"}}}')
        WHEN 1 THEN concat('{"OBJET":{"CPV":[{"PRINCIPAL":"45000000"},{"PRINCIPAL":"72', lpad(CAST(user_id % 100 AS STRING), 6, '0'), '"}]}}')
        WHEN 2 THEN '{"OBJET":{"CPV":[{"PRINCIPAL":"45000000"}]}}' ELSE 'illisible' END)) AS avis FROM events""")
    got = notices.boamp_notices(raw)
    return got.select("idweb", "nomacheteur", "titulaire", "date_parution", "code_departement", F.array_join("codes_cpv", ",").alias("codes"))


def ted_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run(spark, sf_dir, """SELECT CASE WHEN c_custkey % 10 = 9 THEN 'illisible' ELSE concat('{"publication-number":"', c_custkey, '","publication-date":"2026-04-28+02:00","buyer-name":',
      CASE c_custkey % 3 WHEN 0 THEN concat('{"eng":["E ', c_name, '"],"fra":["F ', c_name, '"]}') WHEN 1 THEN concat('{"deu":"D ', c_name, '"}') ELSE 'null' END,
      ',"buyer-country":["', CASE WHEN c_custkey % 4 = 0 THEN 'BEL' ELSE 'FRA' END, '"],"winner-identifier":["', c_custkey, '","2"],"classification-cpv":["45000000","722', lpad(c_custkey % 100, 5, '0'), '"],"total-value":', c_custkey, '.5,"notice-title":"titre"}') END AS avis FROM customer""")
    return notices.ted_notices(raw, "72").select("publication_number", "publication_date", "buyer_name", "buyer_country", "winner_identifier", "winner_name", "code_cpv", "montant", "objet")


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = run(spark, sf_dir, """SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, concat(lpad(CAST(s_suppkey AS STRING), 9, '0'), '00001') AS siret, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE CAST(s_suppkey AS STRING) END AS numeroVoieEtablissement,
      'RUE' AS typeVoieEtablissement, CAST(NULL AS STRING) AS libelleVoieEtablissement, CASE WHEN s_suppkey % 3 = 0 THEN 'false' ELSE 'true' END AS etablissementSiege, '75001' AS codePostalEtablissement,
      CASE WHEN s_suppkey % 5 = 0 THEN '2020-13-40' ELSE '2020-01-31T00:00:00' END AS dateCreationEtablissement FROM supplier""")
    u = run(spark, sf_dir, """SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS denominationUniteLegale, 'NOM' AS nomUniteLegale,
      CASE WHEN s_suppkey % 7 = 0 THEN 'C' ELSE 'A' END AS etatAdministratifUniteLegale, '62.01Z' AS activitePrincipaleUniteLegale FROM supplier WHERE s_suppkey % 11 <> 0""")
    return notices.register_rows(e, u).select("siren", "raison_sociale_legale", "code_naf", "date_creation", "etat_administratif", "est_active", "est_siege", "adresse", "code_postal")


_COMPANIES = """SELECT CASE s_suppkey % 6 WHEN 0 THEN concat('BE', CAST(s_suppkey AS STRING)) WHEN 1 THEN 'x' || CAST(s_suppkey AS STRING) ELSE lpad(CAST(s_suppkey AS STRING), 9, '0') END AS siren,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Inconnu' ELSE s_name END AS denomination, CASE WHEN s_suppkey % 10 = 2 THEN '62.01Z' END AS code_naf,
  CASE WHEN s_suppkey % 10 = 3 THEN 'NON_DIFFUSIBLE' END AS etat_administratif, CAST(NULL AS BOOLEAN) AS est_active FROM supplier"""


def register_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = run(spark, sf_dir, _COMPANIES)
    raw = run(spark, sf_dir, """SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, CASE s_suppkey % 5 WHEN 0 THEN 'introuvable' WHEN 1 THEN 'restreint' WHEN 2 THEN 'erreur' ELSE 'trouve' END AS statut,
      to_json(named_struct('uniteLegale', named_struct('denominationUniteLegale', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, 'periodesUniteLegale',
      array(named_struct('denominationUniteLegale', concat('P ', s_name), 'activitePrincipaleUniteLegale', '62.02A', 'etatAdministratifUniteLegale', 'A'))))) AS reponse FROM supplier""")
    answers = raw.select("siren", "statut").join(notices.company_answers(raw), "siren")
    return quality.complete(companies, answers)


def register_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.enrich(run(spark, sf_dir, _COMPANIES), *_register(spark, sf_dir))


def _register(spark, sf_dir):
    units = run(spark, sf_dir, "SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, s_name AS denominationUniteLegale, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '62.03Z' END AS activitePrincipaleUniteLegale, 'A' AS etatAdministratifUniteLegale FROM supplier WHERE s_suppkey % 9 <> 0")
    places = run(spark, sf_dir, """SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, concat(lpad(CAST(s_suppkey AS STRING), 9, '0'), '0000', n) AS siret, CASE n WHEN 1 THEN 'true' ELSE 'false' END AS etablissementSiege,
      CAST(s_suppkey AS STRING) AS numeroVoieEtablissement, '' AS typeVoieEtablissement, 'DU PORT' AS libelleVoieEtablissement, '13002' AS codePostalEtablissement FROM supplier LATERAL VIEW explode(array(1, 2)) x AS n""")
    return units, places


def enrichment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies, (units, places) = run(spark, sf_dir, _COMPANIES), _register(spark, sf_dir)
    return quality.enrichment(companies, quality.enrich(companies, units, places), units)


def winner_establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = _register(spark, sf_dir)
    winners = run(spark, sf_dir, "SELECT DISTINCT concat(lpad(CAST(l_suppkey AS STRING), 9, '0'), '00001') AS siret FROM lineitem WHERE l_suppkey % 2 = 0")
    old = run(spark, sf_dir, "SELECT concat(lpad(CAST(s_suppkey AS STRING), 9, '0'), '00001') AS siret, lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, false AS est_siege, 'ancien' AS code_postal FROM supplier WHERE s_suppkey % 3 = 0")
    return quality.establishments_of(winners, places, old)


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, places = _register(spark, sf_dir)
    awards = run(spark, sf_dir, "SELECT DISTINCT concat(lpad(CAST(l_suppkey AS STRING), 9, '0'), '00001') AS siret_titulaire FROM lineitem")
    return quality.checks(units, places, run(spark, sf_dir, _COMPANIES), places.where("siren <> '000000005'"), awards, 50, 150)


def cross_source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, f"WITH {CANON} SELECT m.*, b.nom FROM marches m JOIN acheteurs b ON b.siret = m.siret_acheteur")
    asked = rows.where("source = 'TED'").select(F.col("uid").alias("idweb"), F.col("nom").alias("nomacheteur"), F.col("date_notification").cast("string").alias("date_parution"), F.array("code_cpv").alias("codes_cpv"))
    buyers = run(spark, sf_dir, f"WITH {CANON} SELECT siret, nom FROM acheteurs")
    return quality.cross_check(asked, rows.where("source = 'DECP'").drop("nom"), buyers).select(F.col("idweb").alias("uid"), "recoupe")


def cross_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = cross_source_window(spark, sf_dir).select(F.col("uid").alias("idweb"), "recoupe", F.lit("2024-01-01").alias("date_parution"), F.lit("n").alias("nomacheteur"))
    return quality.cross_check_report(checked).select("avis", "recoupes", "sans_correspondance", F.round("part", 6).alias("part"), F.size("exemples").cast("long").alias("exemples"))


def identity_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of every shape through the cascade, judged by type."""
    _, _, register = _bronze(spark, sf_dir)
    cases = run(spark, sf_dir, """SELECT s_suppkey AS cas, CASE s_suppkey % 4 WHEN 0 THEN 'niveau2_siren' WHEN 1 THEN 'niveau2_etranger' WHEN 2 THEN 'niveau3_nom' ELSE 'impossible' END AS type_cas,
      CASE WHEN s_suppkey % 4 IN (0, 2) THEN lpad(CAST(s_suppkey AS STRING), 9, '0') END AS siren_attendu,
      CASE s_suppkey % 4 WHEN 0 THEN lpad(CAST(s_suppkey AS STRING), 9, '0') WHEN 1 THEN concat('BE', CAST(s_suppkey AS STRING)) ELSE '' END AS identifiant,
      CASE s_suppkey % 4 WHEN 2 THEN s_name WHEN 3 THEN 'zzzz qqqq' END AS nom, CAST(NULL AS STRING) AS acheteur FROM supplier""")
    found = identity.resolve(cases.select(F.col("cas").alias("key"), "identifiant", "nom", "acheteur"), register)
    return quality.identity_accuracy(cases, found.where("siren IS NOT NULL").select(F.col("key").alias("cas"), "siren"))


def incumbent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = incumbent_by_family(spark, sf_dir)
    cases = run(spark, sf_dir, f"""WITH {CANON}, w AS (SELECT m.siret_acheteur, m.code_cpv, max(struct(m.date_notification, m.uid)) AS d FROM marches m GROUP BY m.siret_acheteur, m.code_cpv)
      SELECT siret_acheteur, code_cpv, (SELECT min(a.siren) FROM attributions a WHERE a.uid = w.d.uid) AS siren_sortant_attendu, 'faible' AS confiance_attendue,
        CASE WHEN siret_acheteur LIKE '%9' THEN 'cas_ambigu_multi_titulaires' ELSE 'simple' END AS type_cas FROM w""")
    return quality.incumbent_accuracy(cases, families)


def _vectors(spark, sf_dir):
    return run(spark, sf_dir, "SELECT CAST(vec_id AS STRING) AS uid, CASE WHEN label % 5 <> 4 THEN CAST(72000000 + label AS STRING) END AS code_cpv, embedding AS objet_embedding FROM embeddings")


def similar_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of one market that are of another category, or of none."""
    return vectors.similar_to(_vectors(spark, sf_dir), "0", 10, other_category=True)


def category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the 20 nearest of two markets, without and with the refusal below 0.7."""
    rows = _vectors(spark, sf_dir)
    near = vectors.similar_to(rows, "1", vectors.NEIGHBOURS)
    return vectors.vote(near, 0.0).withColumn("seuil", F.lit(0.0)).unionByName(vectors.vote(near).withColumn("seuil", F.lit(vectors.LEAST)))


def told_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every market without a category the one that its 20 nearest vote for, by the index of all
    vectors; ``proche`` is the similarity of the nearest that has one."""
    rows = _vectors(spark, sf_dir)
    index = vector_index.build(rows, f"{shared(spark)}/vecteurs")
    unknown = rows.where("code_cpv IS NULL").select(F.col("uid").alias("cle"), F.col("objet_embedding").alias("vecteur"))
    return vectors.vote(index.nearest(unknown), 0.0, "cle")


def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the documents that have none yet, by the encoder without a model."""
    docs = run(spark, sf_dir, "SELECT doc_id AS uid, text AS objet FROM documents")
    old = docs.where("uid % 2 = 0").select("uid", F.array(F.lit(1.0).cast("float")).alias("objet_embedding"))
    got = vectors.embed_missing(old, docs)
    return got.select("uid", F.size("objet_embedding").cast("long").alias("taille"))


def register_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register with blanks and repeated keys, of which the last row read stays."""
    raw = run(spark, sf_dir, "SELECT CASE WHEN user_id % 50 = 0 THEN ' ' ELSE CAST(user_id AS STRING) END AS siren, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE concat(' ', event_type, ' ') END AS nom, event_id FROM events")
    return sinks.clean_register(raw, "siren", "event_id")


def invalid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.invalid_keys(run(spark, sf_dir, _COMPANIES), "siren", 9)


def decp_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of the last three years, through a CSV export that is read again as text."""
    rows = run(spark, sf_dir, "SELECT CAST(o_orderkey AS STRING) AS uid, o_orderkey % 3 > 0 AS donneesActuelles, CAST(CAST(o_orderdate AS DATE) AS STRING) AS datePublicationDonnees, concat('a\n\"b\" ', o_orderstatus) AS objet FROM orders")
    kept = readers.in_window(rows, F.lit(TODAY).cast("date"))
    path = f"{shared(spark)}/decp"
    sinks.export_csv(kept.select("uid", "objet"), path)
    return readers.text_csv(spark, path)


def bronze_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of notices appended to bronze, and what silver would take of them."""
    path = f"{shared(spark)}/bronze"
    rows = run(spark, sf_dir, "SELECT o_orderkey AS uid, o_totalprice AS montant FROM orders")
    for day, some in (("2024-01-01", rows), ("2024-01-02", rows.where("uid % 2 = 0").withColumn("montant", F.col("montant") * 2))):
        sinks.append_bronze(some, path, F.lit(day).cast("timestamp"))
    back = spark.read.parquet(path)
    last = versions.latest(back, ["uid"], F.col("date_chargement").desc_nulls_last())
    return last.select("uid", F.round(F.col("montant").cast("double"), 4).alias("montant"), F.to_date("date_chargement").alias("jour"))


def published_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published four times; readers see the last, and old versions go."""
    folder = shared(spark)
    rows = run(spark, sf_dir, "SELECT n_nationkey, n_name FROM nation")
    for some in (rows.limit(1), rows.limit(2), rows.limit(3), rows):
        sinks.publish(some, folder, "pays")
    return sinks.current(spark, folder, "pays")


def notice_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices through the JSON cache, and a cache that does not exist."""
    folder = shared(spark)
    sinks.write_cache(run(spark, sf_dir, "SELECT s_suppkey, concat('é ', s_name) AS nom FROM supplier"), f"{folder}/avis")
    schema = "s_suppkey long, nom string"
    return sinks.read_cache(spark, f"{folder}/avis", schema).unionByName(sinks.read_cache(spark, f"{folder}/rien", schema))


def late_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each key kept by a stream, revisions of any age taken."""
    from tenderlake.streaming import bronze

    base = shared(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
    bronze.keep_latest(spark, f"{base}/in", events.schema, base, ["user_id"], "event_id")
    return bronze.kept(spark, base, ["user_id"], "event_id")


QUERIES = {f.__name__: f for f in (
    fact_coverage, section_coverage, silver_rejects, competitor_frequency, decision_block, template_text, rejected_text, expansion, comparable_buyers, purchasing_bodies, silver_typed, silver_buyers, silver_awards,
    silver_volumes, silver_methods, gold_from_silver, gold_star_buyers, gold_star_companies, gold_star_awards, gold_integrity, gold_sheets, identifier_rules, text_mentions, siren_mentions, html_results, web_corroboration, name_history, json_categories, ted_notices,
    register_rows, register_completion, register_enrichment, enrichment_coverage, winner_establishments, quality_checks, cross_source_window, cross_source_report,
    identity_accuracy, incumbent_accuracy, similar_markets, category_vote, told_categories, embedding_backfill, register_cleaning, invalid_keys, decp_window, bronze_reload,
    published_rebuild, notice_cache, late_revisions,
)} | {
    "near_duplicates": near_duplicates, "near_duplicates_wide": lambda spark, sf_dir: near_duplicates(spark, sf_dir, 0.1, 90),
    "incumbent_by_family": incumbent_by_family, "renewal_chain_position": renewal_chain_position, "notification_waves": notification_waves, "wave_coherence": wave_coherence,
    "estimated_expiry": estimated_expiry, "price_range": price_range, "incumbent_by_prefix": incumbent_by_prefix, "median_duration_by_category": median_duration_by_category,
}
