"""Whether a text says only what its fact sheet says: numbers, names and dates, all native."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import text as T

#: Words of the template, which need no fact.
TEMPLATE_WORDS = (
    "Titulaire actuel probable dernier marché notifié le échéance estimée Concurrents concurrent observés observé Aucun dans les données "
    "disponibles Fourchette de prix constatée non disponible indicatif aucun montant publié sur cette famille Pondération de l'acheteur Basé "
    "marchés similaires couverture globale Données insuffisantes Sortant Échéance Historique"
)
VOCABULARY = sorted({w.lower() for w in re.findall(r"[^\W\d_]+", TEMPLATE_WORDS)})
_NONE = "array<string>"


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-zà-ÿ]+"), lambda w: w != "")


def _joined(texts: Column) -> Column:
    """Texts as one, parted by a character that no number, name, date or word has: a pattern goes through all of them at once."""
    return F.array_join(texts, "\u0001")


def allowed_values(known: Column | None = None) -> Column:
    """Every text and number that the sheet of a row (faits, couverture_globale, raison) and the
    caller's ``known`` inputs allow."""
    percent = lambda c: F.bround(c * 100, 0).cast("int").cast("string")

    def said(f: Column) -> Column:
        return F.array_compact(F.concat(F.array(f["texte"]), F.coalesce(f["liste"], F.array().cast(_NONE))))

    def number(f: Column) -> Column:
        return F.array_compact(F.array(f["nombre"].cast("decimal(38,2)").cast("string"), f["nombre"].cast("string"), f["nombre"].cast("long").cast("string"), F.bround(f["nombre"], 0).cast("long").cast("string"), percent(f["couverture"])))

    texts = F.concat(F.flatten(F.transform("faits", said)), F.array(F.coalesce("raison", F.lit(""))))
    given = known if known is not None else F.array().cast(_NONE)
    return F.array_distinct(F.concat(
        texts, F.flatten(F.transform("faits", number)), F.array(percent(F.col("couverture_globale"))), T.numbers(_joined(texts)), T.upper_names(_joined(texts)),
        given, T.numbers(_joined(given)),
    ))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns of a row by a generator: the optimiser would write them into the functions that go through the words,
    numbers and dates of a text, and compute all that a sheet allows again for each of these."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def verify(sheets: DataFrame, text: Column, known: Column | None = None) -> DataFrame:
    """``sheets`` with texte, valide and the three lists of what no fact justifies:
    nombres_non_justifies, noms_non_justifies, dates_non_justifiees."""
    rows = _once(sheets.withColumn("texte", text), _ok=allowed_values(known))
    words = F.concat(_words(_joined(F.col("_ok"))), F.array(*map(F.lit, VOCABULARY)))
    great = T.capitalised_words(F.col("texte"))
    rows = _once(rows, _grands=great, _inconnus=F.array_except(_words(_joined(great)), words), _jours=T.dates(_joined(F.col("_ok"))))
    strange = F.filter("_grands", lambda w: F.arrays_overlap(_words(w), F.col("_inconnus")))
    rows = rows.withColumns({
        "nombres_non_justifies": F.filter(T.numbers(F.col("texte")), lambda n: ~F.array_contains("_ok", n)),
        "noms_non_justifies": F.concat(F.filter(T.upper_names(F.col("texte")), lambda n: ~F.array_contains("_ok", n)), strange),
        "dates_non_justifiees": F.filter(T.dates(F.col("texte")), lambda d: ~F.array_contains("_jours", d)),
    })
    none = lambda c: F.size(c) == 0
    return rows.withColumn("valide", none("nombres_non_justifies") & none("noms_non_justifies") & none("dates_non_justifiees")).drop("_ok", "_grands", "_inconnus", "_jours")
