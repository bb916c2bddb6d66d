"""Members of one object inside JSON files, read by many tasks, however large a file is and however it is broken into lines.

A file is read in pieces that end at a closing brace, so Spark splits it like any text. Whether a piece starts inside a
string, and how deep it starts, depends on everything before it. Both are prefix sums: each piece says how many quotes it
holds and how far it goes up or down for either start; sums by block of a file are shifted by those of the blocks before,
of which there is one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_SCALAR = rf'(?:{_STRING}|\[(?:[^\[\]{{}}"]++|{_STRING})*+\]|[^\s"{{}}\[\],:]++)'
#: From the start of a unit to the brace that opens a member of the root: 1 what leads, 2 members before, 3 the name.
_OPENING = rf"(?s)^\s*([{{,])\s*((?:{_STRING}\s*:\s*{_SCALAR}\s*,\s*)*+)({_STRING})\s*:\s*\{{"
_BEFORE = (Window.unboundedPreceding, -1)


def _sum_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def _steps(pieces: Column, start: int) -> Column:
    """How much deeper the text goes that is outside of strings, if it starts outside (0) or inside (1) of one."""
    outside = F.array_join(F.filter(pieces, lambda _, i: i % 2 == start), "")
    ends_outside = (start + F.size(pieces) - 1) % 2 == 0
    opened = F.regexp_count(outside, F.lit(r"[{\[]")) - F.regexp_count(outside, F.lit(r"\]"))
    return (opened - F.when(ends_outside, 1).otherwise(0)).cast("bigint")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value, quotes, out, inside): texts up to each brace, with their order and their steps."""
    raw = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    bare = raw.withColumn("parts", F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1))
    return bare.select(
        "file", "size", "block", "row", "value", (F.size("parts") - 1).cast("bigint").alias("quotes"),
        _steps(F.col("parts"), 0).alias("out"), _steps(F.col("parts"), 1).alias("inside"),
    )


def units(spark: SparkSession, path: str) -> DataFrame:
    """(file, unit, section, before, after, text): the text up to each brace that closes the root (after = 0), a member of
    it (1) or a member of that (2), of files whose quotes and brackets match and that hold one object."""
    in_block = Window.partitionBy("file", "block").orderBy("row")
    pieces = _pieces(spark, path).withColumn("odd", _sum_before(F.col("quotes"), in_block) % 2 == 1)
    pieces = pieces.withColumns({
        "if_out": F.when(F.col("odd"), F.col("inside")).otherwise(F.col("out")),
        "if_in": F.when(F.col("odd"), F.col("out")).otherwise(F.col("inside")),
    })
    pieces = pieces.withColumns({f"sum_{c}": _sum_before(F.col(c), in_block) for c in ("if_out", "if_in")})

    of_file, whole = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file")
    blocks = pieces.groupBy("file", "block").agg(
        F.max("size").alias("size"),
        F.sum("quotes").alias("quotes"),
        F.sum("if_out").alias("d0"),
        F.sum("if_in").alias("d1"),
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"),
        F.max_by(F.trim(F.regexp_replace("value", r"\s", "")) == "", "row").alias("blank"),
    )
    blocks = blocks.withColumn("inside_at", _sum_before(F.col("quotes"), of_file) % 2 == 1)
    blocks = blocks.withColumn("step", F.when(F.col("inside_at"), F.col("d1")).otherwise(F.col("d0")))
    blocks = blocks.withColumns({
        "depth_at": _sum_before(F.col("step"), of_file),
        "end": F.sum("step").over(whole),
        "all_quotes": F.sum("quotes").over(whole),
        "over": F.sum("bytes").over(whole) - F.col("size"),
        "last_blank": F.max_by("blank", "block").over(whole),
    })
    # Every piece counts a brace at its end. The file's last one has none if the pieces are a byte longer than the file.
    ended = (F.col("over") == 0) & (F.col("end") == 0)
    trailing = (F.col("over") == 1) & (F.col("end") == -1) & F.col("last_blank")
    sound = blocks.where((F.col("all_quotes") % 2 == 0) & (ended | trailing))

    found = pieces.join(sound.select("file", "block", "inside_at", "depth_at"), ["file", "block"])
    starts_in = F.col("inside_at") != F.col("odd")
    found = found.select(
        "file", "block", "row", "value",
        (F.col("depth_at") + F.when(F.col("inside_at"), F.col("sum_if_in")).otherwise(F.col("sum_if_out"))).alias("before"),
        F.when(starts_in, F.col("inside")).otherwise(F.col("out")).alias("step"),
        ((starts_in.cast("int") + F.col("quotes")) % 2 == 0).alias("outside"),
    ).withColumn("after", F.col("before") + F.col("step"))
    found = found.withColumns({
        "ends": (F.col("outside") & F.col("after").between(0, 2)).cast("bigint"),
        "closes": (F.col("outside") & (F.col("after") == 1)).cast("bigint"),
        "roots": (F.col("outside") & (F.col("after") == 0)).cast("bigint"),
        "under": (F.col("after") < 0).cast("bigint"),
    })
    counts = found.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("ends", "closes", "roots", "under")])
    counts = counts.withColumns({
        "units_at": _sum_before(F.col("ends"), of_file),
        "sections_at": _sum_before(F.col("closes"), of_file),
        "all_roots": F.sum("roots").over(whole),
        "all_under": F.sum("under").over(whole),
    })
    # The blank tail of a file counts as a piece below its root.
    counts = counts.where("all_roots = 1 and all_under <= 1").select("file", "block", "units_at", "sections_at")
    numbered = found.where("after >= 0").join(counts, ["file", "block"]).withColumns({
        "unit": F.col("units_at") + _sum_before(F.col("ends"), in_block),
        "section": F.col("sections_at") + _sum_before(F.col("closes"), in_block),
    })
    order = F.struct("block", "row")
    return numbered.groupBy("file", "unit").agg(
        F.min("section").alias("section"),
        F.min_by("before", order).alias("before"),
        F.max_by("after", order).alias("after"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "row", "value"))), lambda p: F.concat(p["value"], F.lit("}"))), "")
        .alias("text"),
    )


def members(spark: SparkSession, path: str, name: str, record: str) -> tuple[DataFrame, DataFrame]:
    """The members of the object that the root's member ``name`` holds, as (file, pos, key, value of type ``record``), and
    the root's other values as (file, values map<string,string>), of every file that is JSON throughout.

    Files that are cut off, not JSON, or have a member of ``name`` that is no object give no rows, as do empty ones. Of
    a key that a file repeats the last value counts, at the place of the first; likewise of a repeated ``name``. A member
    of the root may be a string, a number, a list without objects or an object. A member of a member is one value of the
    output and so one row; nothing larger is ever held.
    """
    found = units(spark, path)
    top = F.col("before") <= 1
    opens = top & (F.col("after") >= 1)
    part = lambda n: F.regexp_extract("text", _OPENING, n)
    lead = F.when(F.col("before") == 0, "{").otherwise(",")
    read = found.withColumns({
        "opened": F.when(opens, part(0)),
        "name": F.when(opens, part(3)),
        "root": F.when(opens & (part(1) == lead), F.concat(F.lit("{"), part(2), part(3), F.lit(": null}")))
        .when(top & (F.col("before") == 0) & (F.col("after") == 0), F.col("text"))
        .when(top & F.rlike("text", F.lit(r"^\s*\}$")), "{}")
        .when(top & ~F.rlike("text", F.lit(r"^\s*,\s*\}$")), F.regexp_replace("text", r"^\s*,", "{")),
    })
    roots = read.where(top).select("file", "unit", "section", "name", "opened", F.from_json("root", "map<string,string>").alias("values"))
    wanted = roots.where(F.col("name") == F.lit(f'"{name}"')).groupBy("file").agg(F.max(F.struct("section", "unit")).alias("first"))
    # One row a file on the right: Spark broadcasts it by its measured size, or splits the files of many rows.
    inner = read.join(wanted, "file").where((F.col("section") == F.col("first.section")) & (F.col("after") >= 1))
    rest = F.when(opens, F.expr("substring(text, length(opened) + 1)"))
    follows = F.when(F.rlike("text", F.lit(r"^\s*,\s*\"")), F.regexp_replace("text", r"^\s*,", ""))
    body = F.when(opens, rest).when(F.col("after") == 2, follows).otherwise(F.col("text"))
    inner = inner.withColumn("body", body).select(
        "file",
        "after",
        (F.col("unit") - F.col("first.unit")).alias("pos"),
        F.rlike("body", F.lit(r"^\s*\}$")).alias("blank"),
        F.when(F.col("after") == 2, F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), f"map<string,{record}>")).alias("one"),
    )
    single = (F.size("one") == 1) & F.get(F.map_values("one"), F.lit(0)).isNotNull()
    inner_bad = inner.where(~F.coalesce(F.when(F.col("after") == 1, F.col("blank")).otherwise(single), F.lit(False)))
    bad = inner_bad.select("file").union(roots.where("values IS NULL").select("file")).distinct()

    rows = inner.where("after = 2").select("file", "pos", F.explode("one").alias("key", "value"))
    rows = rows.groupBy("file", "key").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
    rest_of_root = roots.select("file", "unit", F.explode("values").alias("k", "v")).groupBy("file", "k").agg(F.max_by("v", "unit").alias("v"))
    rest_of_root = rest_of_root.where(F.col("v").isNotNull() & (F.col("k") != name))
    files = roots.select("file").distinct().join(bad, "file", "left_anti")
    pairs = rest_of_root.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))
    return rows.join(bad, "file", "left_anti").select("file", "pos", "key", "value"), files.join(pairs, "file", "left")
