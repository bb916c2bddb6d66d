"""Registry state as JSON (SRC3, SNK1, SNK5)."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources import json_members

_RECORD = (
    "struct<essay_id:string,title:string,url:string,date:string,raw_date_str:string,read:boolean,last_seen:string>"
)
ENTRIES = "essays"


def _text_of(value: Column) -> Column:
    """A JSON string, null without a value."""
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("k"))), F.lit(r'^\{"k":|\}$'), F.lit(""))
    return F.when(value.isNull(), "null").otherwise(quoted)


def _registry_columns(record: str) -> list[Column]:
    e = F.col(record)
    return [
        F.coalesce(e["title"], F.lit("")).alias("title"),
        F.coalesce(e["url"], F.lit("")).alias("url"),
        e["date"].alias("date"),
        e["raw_date_str"].alias("raw_date_str"),
        F.coalesce(e["read"], F.lit(False)).alias("read"),
        F.try_to_timestamp(e["last_seen"]).alias("last_seen"),
    ]


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: registry rows of state files, each read by as many tasks as it has blocks (``json_members``).

    The map key is the id; missing titles and urls are '', missing read is false; a file that is not valid JSON gives no
    rows. ``first_pos`` counts the entries of a file from 0.
    """
    entries, _ = json_members.members(spark, path, ENTRIES, _RECORD)
    return entries.select(F.col("key").alias("doc_id"), *_registry_columns("value"), F.col("pos").alias("first_pos"))


def read_last_update(spark: SparkSession, path: str) -> DataFrame:
    """When each valid state file was written, null where it does not say."""
    return json_members.members(spark, path, ENTRIES, _RECORD)[1].select(F.col("values")["last_update"].alias("last_update"))


def write_state_files(registry: DataFrame, path: str, last_update: dt.datetime, documents: int = 100_000) -> None:
    """SNK1: whole state files in the indented layout, one for each ``documents`` places, in folders by number.

    Each file is one object and written by one task; ``write_state`` makes one object of any size out of parts.
    """
    fields = ("doc_id", "title", "url", "date", "raw_date_str", "read", "last_seen")
    seen = F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    values = {"read": F.col("read").cast("string"), "last_seen": _text_of(seen)}
    lines = [
        F.concat(F.lit(f'      "{"essay_id" if c == "doc_id" else c}": '), values.get(c, _text_of(F.col(c)))) for c in fields
    ]
    entry = F.concat(F.lit("    "), _text_of(F.col("doc_id")), F.lit(": {\n"), F.concat_ws(",\n", *lines), F.lit("\n    }"))
    head = f'{{\n  "last_update": {json.dumps(last_update.isoformat())},\n  "{ENTRIES}": {{\n'
    of_file = Window.partitionBy("file").orderBy("first_pos", "doc_id")
    rows = registry.select(F.floor(F.col("first_pos") / documents).alias("file"), "first_pos", "doc_id", entry.alias("entry"))
    value = F.concat(
        F.when(F.row_number().over(of_file) == 1, head).otherwise(""),
        "entry",
        F.when(F.lead("doc_id").over(of_file).isNull(), "\n  }\n}").otherwise(","),
    )
    rows.select("file", value.alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def state_lines(registry: DataFrame, last_update: dt.datetime) -> DataFrame:
    """SNK1: the state object as lines (rank, pos, value): head, one entry per document, foot.

    No row holds more than one document, so the file can be written by many tasks; the parts, concatenated in order, are
    one JSON object.
    """
    spark = registry.sparkSession
    record = F.struct(
        F.col("doc_id").alias("essay_id"), "title", "url", "date", "raw_date_str", "read",
        F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_seen"),
    )
    entry = F.concat(_text_of(F.col("doc_id")), F.lit(": "), F.to_json(record, {"ignoreNullFields": "false"}))
    first = registry.agg(F.min("first_pos")).scalar()
    entries = registry.select(
        F.lit(1).alias("rank"),
        F.col("first_pos").alias("pos"),
        F.concat(F.when(F.col("first_pos") == first, F.lit("")).otherwise(","), entry).alias("value"),
    )
    head = f'{{"last_update": {json.dumps(last_update.isoformat())}, "essays": {{'
    frame = spark.createDataFrame([(0, 0, head), (2, 0, "}}")], "rank int, pos bigint, value string")
    return frame.unionByName(entries)


def write_state(registry: DataFrame, path: str, last_update: dt.datetime) -> None:
    """SNK1: write ``state_lines`` as ordered text parts."""
    state_lines(registry, last_update).orderBy("rank", "pos").select("value").write.mode("overwrite").text(path)


def parse_state_lines(lines: DataFrame) -> DataFrame:
    """Registry rows of state lines (column ``value``), each line on its own."""
    entries = lines.filter(~F.startswith("value", F.lit('{"last_update"')) & (F.col("value") != "}}"))
    body = F.regexp_replace("value", F.lit(r"^,"), F.lit(""))
    one = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"map<string,{_RECORD}>")
    return entries.select(F.explode(one).alias("doc_id", "e")).select("doc_id", *_registry_columns("e"))


def read_state_parts(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_state`` wrote, line by line and in parallel."""
    return parse_state_lines(spark.read.text(path))
