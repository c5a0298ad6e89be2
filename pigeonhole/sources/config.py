"""Type files and packs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TYPE_FILE = ("struct<types:array<struct<id:string,name:string,what:string,not_for:string,examples:array<string>>>,"
             "none_of_these:struct<name:string,what:string>>")
PACK = ("id string, structuralVocabulary array<string>, typeFile " + TYPE_FILE + ", settings map<string,string>, "
        "limits map<string,string>, pins map<string,struct<id:string,policy:string,date:string,reason:string>>")


def type_rows(files: DataFrame, text: str = "value") -> DataFrame:
    """Types of each type file text: ``type_version`` (hash of the exact text), position and the type's fields."""
    parsed = files.select(F.sha2(text, 256).alias("type_version"), F.from_json(text, TYPE_FILE).alias("f"))
    return parsed.select("type_version", F.posexplode("f.types").alias("position", "t")).select("type_version", "position", "t.*")


def none_rows(files: DataFrame, text: str = "value") -> DataFrame:
    return files.select(F.sha2(text, 256).alias("type_version"), F.from_json(text, TYPE_FILE).alias("f")).select("type_version", "f.none_of_these.*")


def load_types(spark: SparkSession, path: str) -> DataFrame:
    """Types of every type file below ``path`` (one JSON document per file)."""
    return type_rows(spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path))


def load_packs(spark: SparkSession, path: str) -> DataFrame:
    """Packs with a fixed schema; the type file stays nested."""
    return spark.read.schema(PACK).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
