"""Writers: append-only bronze, published rebuilds, exports and the schemas of results."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.versions import blanks_to_null, last_of_key


def append_bronze(rows: DataFrame, path: str, loaded: Column | None = None) -> None:
    """Rows as text, appended with their load time and dealt into folders by its day."""
    text = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    text = text.withColumn("date_chargement", loaded if loaded is not None else F.current_timestamp())
    text.withColumn("jour", F.to_date("date_chargement")).write.mode("append").partitionBy("jour").parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, folder: str, name: str) -> dict[int, dict]:
    """Complete versions by number: the folder of each table."""
    files, at = _files(spark, f"{folder.rstrip('/')}/{name}/_versions")
    found = {}
    for f in files.listStatus(at) if files.exists(at) else []:
        if f.getPath().getName().isdigit():
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(f.getPath()), "UTF-8")
            if text.endswith("\n"):  # the last byte written
                found[int(f.getPath().getName())] = json.loads(text)
    return found


def _commit(spark: SparkSession, folder: str, name: str, tables: dict[str, str]) -> int:
    """Name tables as the next version.  The file is created only if no other has its number."""
    files, at = _files(spark, f"{folder.rstrip('/')}/{name}/_versions")
    files.mkdirs(at)
    number = max((int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()), default=0)
    while True:
        number += 1
        _, path = _files(spark, f"{folder.rstrip('/')}/{name}/_versions/{number:010d}")
        try:
            out = files.create(path, False)
        except Exception as e:  # another writer took the number
            if not files.exists(path):
                raise e
            continue
        out.write(bytearray((json.dumps(tables) + "\n").encode()))
        out.close()
        return number


def publish(rows: DataFrame | dict[str, DataFrame], folder: str, name: str, keep: int = 2, check: Callable[[], None] | None = None) -> int:
    """Write a rebuilt table, or several that change together, as the next version of ``name``.

    Tables are written to folders of their own; then one small file, which is created whole or not at
    all, names them.  Readers take the complete version of the highest number: before that file, and
    after a run that stops anywhere, they see the version before.  Of older versions the last
    ``keep`` stay, for readers that have begun; folders that no version names are left by stopped runs
    and go with the next ``clean``.  Two writers get two numbers where the store creates files
    exclusively (as HDFS and local files do); elsewhere there may be one writer at a time.  ``check``
    is called when all tables are written: where it raises, there is no new version.
    """
    tables = rows if isinstance(rows, dict) else {"": rows}
    spark = next(iter(tables.values())).sparkSession
    paths = {}
    for part, df in tables.items():
        paths[part] = f"{folder.rstrip('/')}/{name}/data-{uuid.uuid4().hex}"
        df.write.parquet(paths[part])
    if check is not None:
        check()
    number = _commit(spark, folder, name, paths)
    clean(spark, folder, name, keep)
    return number


def clean(spark: SparkSession, folder: str, name: str, keep: int = 2, hours: float = 168) -> None:
    """Remove versions before the last ``keep``, and folders without a version that are older than ``hours``."""
    found = _versions(spark, folder, name)
    files, root = _files(spark, f"{folder.rstrip('/')}/{name}")
    for number in sorted(found)[:-keep]:
        _, at = _files(spark, f"{folder.rstrip('/')}/{name}/_versions/{number:010d}")
        files.delete(at, False)  # the name first, so that no version names what is gone
        for path in found.pop(number).values():
            files.delete(_files(spark, path)[1], True)
    named, now = {p.rsplit("/", 1)[-1] for v in found.values() for p in v.values()}, time.time() * 1000
    for f in files.listStatus(root):
        own = f.getPath().getName()
        if own.startswith("data-") and own not in named and now - f.getModificationTime() > hours * 3_600_000:
            files.delete(f.getPath(), True)


def version(spark: SparkSession, folder: str, name: str) -> int | None:
    """The number that readers see, if any."""
    return max(_versions(spark, folder, name), default=None)


def current(spark: SparkSession, folder: str, name: str, part: str = "") -> DataFrame:
    """The published table of a name."""
    found = _versions(spark, folder, name)
    return spark.read.parquet(found[max(found)][part])


def export_csv(rows: DataFrame, path: str) -> int:
    """CSV with a header and every field quoted; the number of rows, counted from the table, as
    a field may hold line ends."""
    rows.write.mode("overwrite").option("escape", '"').csv(path, header=True, quoteAll=True)
    return rows.count()


def write_cache(rows: DataFrame, path: str) -> None:
    """JSON lines; text beyond ASCII stays as it is."""
    rows.write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache of JSON, one array or lines; a missing one is empty."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))


def clean_register(raw: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """A register read from CSV: blanks are null, and of rows of one key the last read stays;
    rows without a key all stay."""
    rows = blanks_to_null(raw)
    if sequence is None:
        sequence, rows = "_read", rows.withColumn("_read", F.monotonically_increasing_id())
    out = last_of_key(rows, key, sequence)
    return out.drop("_read")


def json_value(sheet: dict) -> str:
    """A fact sheet as JSON text; every fact keeps ``valeur``, null too."""
    facts = []
    for f in sheet["faits"]:
        number = f["nombre"]
        value = f["liste"] if f["liste"] is not None else f["texte"] if f["texte"] is not None else int(number) if number is not None and number == int(number) else number
        facts.append({"cle": f["cle"], "valeur": value, "provenance": f["provenance"], "couverture": f["couverture"]})
    out = {"faits": facts, "couverture_globale": sheet["couverture_globale"]}
    out |= {k: sheet[k] for k in ("raison", "marches_support") if sheet[k] is not None}
    return json.dumps(check_sheet(out), ensure_ascii=False, indent=2)


def check_sheet(sheet: dict) -> dict:
    """The sheet itself, or ValueError where a fact has no key or provenance, or a coverage out of bounds."""
    whole = [sheet["couverture_globale"], *(f["couverture"] for f in sheet["faits"])]
    if not all(0 <= c <= 1 for c in whole) or not all(f["cle"] and f["provenance"] and "valeur" in f for f in sheet["faits"]):
        raise ValueError("not a fact sheet")
    if any(not isinstance(f["valeur"], (str, int, float, list, type(None))) for f in sheet["faits"]):
        raise ValueError("a value is of no kind that a fact may have")
    return sheet


def check_block(lines: list[str]) -> list[str]:
    """One to ten lines, none blank, or ValueError."""
    if not 1 <= len(lines) <= 10 or any(not x.strip() for x in lines):
        raise ValueError("a block has one to ten lines, none blank")
    return lines


_TEXT = {"type": "string", "minLength": 1}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
#: JSON Schemas of the two results.
SCHEMAS = {
    "fiche_de_faits": {"type": "object", "required": ["faits", "couverture_globale"], "properties": {
        "faits": {"type": "array", "items": {"type": "object", "required": ["cle", "valeur", "provenance", "couverture"], "properties": {
            "cle": _TEXT, "valeur": {"type": ["string", "number", "array", "null"]}, "provenance": _TEXT, "couverture": _SHARE}}},
        "couverture_globale": _SHARE, "raison": {"type": ["string", "null"]}, "marches_support": {"type": ["array", "null"], "items": {"type": "string"}}}},
    "bloc_de_decision": {"type": "object", "required": ["lignes"], "properties": {"lignes": {"type": "array", "minItems": 1, "maxItems": 10, "items": _TEXT}}},
}


def write_schemas(folder: str) -> None:
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, schema in SCHEMAS.items():
        Path(folder, f"{name}.schema.json").write_text(json.dumps(schema, ensure_ascii=False, indent=2), "utf-8")
