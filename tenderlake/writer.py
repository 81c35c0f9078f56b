"""Text of a fact sheet by a language model, never used unless it passes the mechanical check."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.verify import verify
from tenderlake.plans.facts import template_text

TRIES = 3
INSTRUCTIONS = (
    "Transforme la fiche de faits JSON en une phrase de synthèse, sans autre source. N'utilise aucun nombre, nom ou date absents de la fiche ; "
    "dis « non disponible » de ce qui manque. Réponds par la phrase seule."
)


def sheet_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)


def written(sheet: DataFrame, client: Callable[[str, list[dict]], str | None] | None = None, tries: int = TRIES) -> str:
    """The text of the one row of ``sheet``.  ``client`` (instructions, messages) -> text, or None
    if it declines.  A text with a number, name or date that no fact justifies is sent back with
    all that was rejected; after ``tries`` of them, on an error or without a client the template
    speaks."""
    row = sheet.select("*", template_text().alias("_texte")).first()
    if client is None or not row["faits"]:
        return row["_texte"]
    messages = [{"role": "user", "content": sheet_json(sheet.first())}]
    for _ in range(tries):
        try:
            text = client(INSTRUCTIONS, messages)
        except Exception:  # whatever a client raises: the template is the answer then
            return row["_texte"]
        if not text:
            return row["_texte"]
        checked = verify(sheet, F.lit(text.strip())).first()
        if checked["valide"]:
            return text.strip()
        wrong = {k: checked[k] for k in ("nombres_non_justifies", "noms_non_justifies", "dates_non_justifiees")}
        messages += [{"role": "assistant", "content": text}, {"role": "user", "content": f"Absents de la fiche : {json.dumps(wrong, ensure_ascii=False)}. Corrige."}]
    return row["_texte"]
