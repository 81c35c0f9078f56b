"""Records of notices and register rows from nested JSON, as projections on one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.sources.readers import first_date, multilingual, plain_html, scoped_code, subject_codes, tolerant_date

UNKNOWN_BUYER = "Acheteur inconnu"
_LIST = "array<string>"


def parsed(raw: DataFrame, column: str, fields: list[str], whole: bool = True) -> DataFrame:
    """``raw`` with ``_n``, the fields of the JSON object in ``column`` as texts (nested values as they
    are written); unreadable texts are left out or, without ``whole``, have a null field each.

    A generator parses a text once: filters on the fields stay above it, where those on a projection
    would go below it and parse again.
    """
    schema = ", ".join(f"`{f}` string" for f in [*fields, "_illisible"])
    one = F.array(F.from_json(column, schema, {"columnNameOfCorruptRecord": "_illisible"}))
    return raw.withColumn("_n", F.explode(F.filter(one, lambda x: x.isNotNull() & x["_illisible"].isNull()) if whole else one))


def _list(value: Column) -> Column:
    """A JSON list of strings; a lone string is a list of one; else empty."""
    return F.when(value.isNull(), F.array().cast(_LIST)).when(value.startswith("["), F.from_json(value, _LIST)).otherwise(F.array(value))


#: Fields of an award notice.
NOTICE = ["publication-number", "notice-identifier", "publication-date", "buyer-name", "buyer-country", "buyer-identifier", "winner-name",
          "winner-country", "winner-identifier", "classification-cpv", "total-value", "notice-title", "procedure-type"]
#: Fields of a result notice.
RESULT = ["idweb", "nomacheteur", "titulaire", "objet", "dateparution", "code_departement", "donnees"]
#: Fields of a company, which its periods have too.
COMPANY = {"denominationUniteLegale": "denomination", "categorieJuridiqueUniteLegale": "forme_juridique", "activitePrincipaleUniteLegale": "code_naf",
           "etatAdministratifUniteLegale": "etat_administratif"}


def ted_notices(raw: DataFrame, prefix: str | None = None, country: str | None = "FRA", column: str = "avis") -> DataFrame:
    """Thirteen text columns of each award notice; the country that a notice states is checked
    again, as the request's own filter lets others through.  Unreadable JSON is left out."""
    field = lambda name: F.col("_n")[name]
    first = lambda name: F.get(_list(field(name)), 0)
    out = parsed(raw, column, NOTICE).select(
        field("publication-number").alias("publication_number"), field("notice-identifier").alias("notice_identifier"),
        first_date(field("publication-date")).alias("publication_date"), F.coalesce(multilingual(field("buyer-name")), F.lit(UNKNOWN_BUYER)).alias("buyer_name"),
        first("buyer-country").alias("buyer_country"), first("buyer-identifier").alias("buyer_identifier"), multilingual(field("winner-name")).alias("winner_name"),
        first("winner-country").alias("winner_country"), first("winner-identifier").alias("winner_identifier"), scoped_code(_list(field("classification-cpv")), prefix).alias("code_cpv"),
        field("total-value").alias("montant"), multilingual(field("notice-title")).alias("objet"), field("procedure-type").alias("procedure_type"),
    )
    return out if country is None else out.where(F.col("buyer_country") == country)


def boamp_notices(raw: DataFrame, prefix: str | None = "72", column: str = "avis") -> DataFrame:
    """Seven columns of each result notice with at least one category of the prefix.  A notice
    whose ``donnees`` is missing, unreadable or no object is left out."""
    notice = parsed(raw, column, RESULT).select(F.col("_n").alias("_avis"))
    place = F.col("_avis.code_departement")
    out = parsed(notice, "_avis.donnees", ["OBJET"]).select(
        *(F.col(f"_avis.{c}").alias(c) for c in ("idweb", "nomacheteur", "titulaire", "objet")), F.col("_avis.dateparution").alias("date_parution"),
        F.when(place.startswith("["), F.get(F.from_json(place, _LIST), 0)).otherwise(place).alias("code_departement"), subject_codes(F.col("_n.OBJET")).alias("codes_cpv"),
    )
    return out if prefix is None else out.where(F.exists("codes_cpv", lambda c: c.startswith(prefix)))


#: Fields of an address, in order of writing.
ADDRESS = ("complementAdresseEtablissement", "numeroVoieEtablissement", "indiceRepetitionEtablissement", "dernierNumeroVoieEtablissement",
           "indiceRepetitionDernierNumeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement")


def register_rows(establishments: DataFrame, units: DataFrame) -> DataFrame:
    """Enrichment records: an establishment with its company; rows without company id go.  Empty
    text counts as missing; only ``true`` marks a head office, whatever its case of type."""
    some = lambda df: df.select(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in df.columns))
    e, u = some(establishments).alias("e"), some(units).alias("u")
    have = lambda side, names: [F.col(f"{side}.{n}") for n in names if n in (establishments if side == "e" else units).columns]
    pick = lambda *cols: F.coalesce(*(c for part in cols for c in part), F.lit(None))
    joined = e.join(u, F.col("e.siren") == F.col("u.siren"), "left")
    state = pick(have("u", ["etatAdministratifUniteLegale"]))
    return joined.where(F.col("e.siren").isNotNull()).select(
        F.col("e.siren").alias("siren"), F.col("e.siret").alias("siret"), pick(have("u", ["denominationUniteLegale", "nomUniteLegale"])).alias("raison_sociale_legale"),
        pick(have("u", ["categorieJuridiqueUniteLegale"])).alias("forme_juridique"),
        pick(have("u", ["activitePrincipaleUniteLegale", "activitePrincipaleNAF25UniteLegale"])).alias("code_naf"),
        tolerant_date(pick(have("e", ["dateCreationEtablissement"]), have("u", ["dateCreationUniteLegale"]))).alias("date_creation"),
        state.alias("etat_administratif"), F.coalesce(state == "A", F.lit(False)).alias("est_active"),
        F.coalesce(F.lower(pick(have("e", ["etablissementSiege"]))) == "true", F.lit(False)).alias("est_siege"),
        F.nullif(F.concat_ws(" ", *have("e", ADDRESS)), F.lit("")).alias("adresse"),
        pick(have("e", ["codePostalEtablissement"])).alias("code_postal"), pick(have("e", ["libelleCommuneEtablissement", "commune"])).alias("commune"),
    )


def company_answers(answers: DataFrame, column: str = "reponse") -> DataFrame:
    """(siren, denomination, forme_juridique, code_naf, etat_administratif, est_active) of register
    answers (siren, JSON): a field of the company, else of its newest period."""
    fields = ", ".join(f"{f}: string" for f in COMPANY)
    answer = F.from_json(column, f"uniteLegale struct<{fields}, periodesUniteLegale: array<struct<{fields}>>>")
    unit = answers.withColumn("_u", F.explode(F.array(answer["uniteLegale"])))
    said = lambda f: F.coalesce(*(F.nullif(x[f], F.lit("")) for x in (F.col("_u"), F.get("_u.periodesUniteLegale", 0))))
    return unit.select("siren", *(said(f).alias(c) for f, c in COMPANY.items())).withColumn("est_active", F.coalesce(F.col("etat_administratif") == "A", F.lit(False)))


def past_names(answers: DataFrame, column: str = "reponse") -> DataFrame:
    """(siren, denomination, date_debut, date_fin): every period of register answers (siren, JSON)."""
    periods = F.from_json(F.get_json_object(column, "$.uniteLegale.periodesUniteLegale"), "array<struct<denominationUniteLegale:string,dateDebut:string,dateFin:string>>")
    return answers.select("siren", F.explode(periods).alias("p")).select(
        "siren", F.col("p.denominationUniteLegale").alias("denomination"), tolerant_date(F.col("p.dateDebut")).alias("date_debut"), tolerant_date(F.col("p.dateFin")).alias("date_fin"))


def search_results(pages: DataFrame, key: str, html: str = "html", title: str = r'class="result__a"[^>]*>(.*?)</a>',
                   extract: str = r'class="result__snippet"[^>]*>(.*?)</a>', most: int = 10) -> DataFrame:
    """(key, rang, resultat): "title — extract" of the first ``most`` results of each page; a page
    without any has no rows."""
    both = F.regexp_extract_all(html, F.lit(f"(?s){title}.*?{extract}"), 0)
    part = lambda x, p: plain_html(F.regexp_extract(x, f"(?s){p}", 1))
    rows = pages.select(key, F.posexplode(F.slice(both, 1, most)).alias("rang", "r"))
    return rows.select(key, (F.col("rang") + 1).alias("rang"), F.concat(part(F.col("r"), title), F.lit(" — "), part(F.col("r"), extract)).alias("resultat"))
