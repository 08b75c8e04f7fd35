"""Imports of JSON entities and exports as JSON, folders, zip, CSV and all-text tables."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def listed(spark: SparkSession, path: str, name_pattern: str, whole: bool = False) -> list[str]:
    """The files below a path of any Hadoop file system whose name (or, with whole, whose path below it) matches."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, files = fs.makeQualified(top).toString().rstrip("/") + "/", [], fs.listFiles(top, whole)
    while files.hasNext():
        at = files.next().getPath()
        if re.search(name_pattern, at.toString().removeprefix(base) if whole else at.getName()):
            found.append(at.toString())
    return sorted(found)


def read_entities(spark: SparkSession, path: str, name_pattern: str | None = None, schema: str | None = None, whole: bool = False) -> DataFrame:
    """Files that hold JSON arrays (or objects); of a folder, or of a container of folders with whole, those that match the
    pattern: names are matched first, so that no other file is read."""
    reader = spark.read.option("multiLine", True)
    reader = reader.schema(schema) if schema else reader
    if not name_pattern:
        return reader.json(path)
    files = listed(spark, path, name_pattern, whole)
    return reader.json(files) if files else spark.createDataFrame([], schema or "id string, entityType string")


def as_requests(rows: DataFrame, data_source: str) -> DataFrame:
    """Raw documents wrapped as merge requests by their entityType and id."""
    return rows.select(F.lit(data_source).alias("DataSource"), F.col("entityType").alias("SourceEntityType"), F.col("id").cast("string").alias("SourceEntityId"), F.to_json(F.struct("*")).alias("Data"))


def key_summary(keys: Column) -> Column:
    """Alternate keys as text: key=value, ..."""
    return F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k["Key"], k["Value"])), ", ")


def file_name(entity_type: str, ident: str) -> str:
    return re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", f"{entity_type}_{ident}.json")


def export(rows: DataFrame, path: str, entity_type: str = "entityType", ident: str = "id", doc: str = "doc") -> str:
    """By extension: .zip with a file for each entity, .json as one array, else a distributed folder of JSON lines.

    The first two are single files by nature and are streamed through the driver."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.select(entity_type, ident, doc).toLocalIterator():
                z.writestr(file_name(r[0], str(r[1])), r[2])
    elif path.endswith(".json"):
        with Path(path).open("w", encoding="utf-8") as f:
            f.write("[")
            for k, r in enumerate(rows.select(doc).toLocalIterator()):
                f.write((",\n" if k else "") + r[0])
            f.write("]")
    else:
        rows.write.mode("overwrite").partitionBy(entity_type).json(path)
    return path


def export_csv(rows: DataFrame, path: str, columns: list[str], delimiter: str = ",", humanize: bool = False) -> None:
    names = [re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", c).replace("_", " ").strip().title() if humanize else c for c in columns]
    rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def data_table(docs: DataFrame, columns: list[str], doc: str = "doc") -> DataFrame:
    """All-text projection of JSON documents; what is missing is '', and what looks like a date with time is written in ISO
    form with seven digits of a second and its offset."""

    def text(c: str) -> Column:
        value = F.get_json_object(doc, f"$.{c}")
        whole = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,7})\d*)?(Z|[+-]\d\d:\d\d)?$"
        iso = F.concat(F.regexp_extract(value, whole, 1), F.lit("."), F.rpad(F.regexp_extract(value, whole, 2), 7, "0"), F.regexp_extract(value, whole, 3))
        return F.when(value.rlike(whole), iso).otherwise(F.coalesce(value, F.lit("")))

    return docs.select(*[text(c).alias(c) for c in columns])
