"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.llm.registry import load, query
from quire.llm.scratch import new_path

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 10
BATCHES = 4
FAN = 2  # runs of a level that are merged into one of the next
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased; ``lower`` is the quick way where all is ASCII."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """The lines seen so far as runs of (h1, h2, owner), each sorted and bucketed by its 128-bit hash.

    ``levels[k]`` are the names of the runs of level k. A batch becomes a run of level 0; as soon as a level has ``fan``
    runs they are merged into one of the next level, so n batches leave about log(n) runs and each hash is rewritten
    about log(n) times. Runs and batches have the same buckets, so joining them moves neither.
    """

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan, self.levels, self.paths = spark, fan, [[]], {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, *HASH)
        writer = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        self.paths[name] = new_path(self.spark, "line-run")
        writer.option("path", self.paths[name]).saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select(*HASH, "owner")

    def add(self, lines: DataFrame) -> DataFrame:
        """Take (h1, h2, doc) of a batch whose documents come after all earlier ones; return (h1, h2, owner) of its
        repeated lines, owner being the smallest document that has the line."""
        judged = lines.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        owners = []
        for name in (name for level in self.levels for name in level):  # one merge join a run
            owners.append(f"owner{len(owners)}")
            judged = judged.join(self._run(name).withColumnRenamed("owner", owners[-1]), list(HASH), "left")
        judged = judged.select(
            *HASH, "first", "last", F.coalesce(*owners, "first").alias("owner"),
            (F.coalesce(*owners).isNull() if owners else F.lit(True)).alias("fresh"),
        )
        name = self._write(judged)
        self.levels[0].append(name)
        self._compact()
        # read without its buckets, so that the join with all places of a hot line is one that AQE may split
        plain = self.spark.read.schema(self.spark.table(name).schema).parquet(self.paths[name])
        return plain.where("NOT fresh OR first <> last").select(*HASH, "owner")

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan:
                merged = reduce(DataFrame.union, [self._run(name) for name in self.levels[level]])
                self.levels[level] = []
                self.levels.extend([[]] * (level + 2 - len(self.levels)))
                self.levels[level + 1].append(self._write(merged.withColumn("fresh", F.lit(True))))
            level += 1


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, batches: int = BATCHES
) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, plus n_lines and n_dropped.

    A line of at least ``shortest`` characters after stripping, found in two or more documents (equal but for A-Z case),
    stays only in the document with the smallest key. Documents are taken in ``batches`` ranges of the key, smallest
    first. Lines are told apart by 128-bit hashes. Hot lines are pre-aggregated before the shuffle; the join back to
    their places has a plain large side that AQE may split. Null and empty texts are one empty line. Rows of one key are
    one document, whatever their texts. A null key takes no part and loses nothing. An empty table gives none. Columns
    of ``docs`` named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    text_of = F.coalesce(F.col(text), F.lit(""))
    borders = docs.agg(F.percentile_approx(key, [i / batches for i in range(1, batches)])).first()[0] or []
    batch = sum((F.when(F.col("doc") > x, 1).otherwise(0) for x in sorted(set(borders))), F.lit(0))
    lines = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text_of).alias("version"), F.posexplode(F.split(text_of, "\n", -1)).alias("pos", "line")
    )
    lines = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= shortest)
    lines = lines.select(
        batch.alias("batch"), "doc", "version", "pos",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"),
    )
    path = new_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(lines.drop("batch").schema.add("batch", IntegerType())).parquet(path)

    runs, dropped = LineRuns(spark), []
    for n in range(len(set(borders)) + 1):
        own = stored.where(F.col("batch") == n)
        repeated = runs.add(own)
        dropped.append(own.join(repeated, list(HASH)).where("doc <> owner").select("doc", "version", "pos"))
    places = reduce(DataFrame.union, dropped).distinct().groupBy("doc", "version").agg(F.collect_list("pos").alias("gone"))

    all_lines = F.split(text_of, "\n", -1)
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(all_lines, i)), "\n")
    places = places.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    joined = docs.join(places, (F.col(key) == F.col("__doc")) & (F.xxhash64(text_of) == F.col("__version")), "left")
    added = {
        "n_lines": F.size(all_lines).cast("long"),
        "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept),
    }
    return joined.select(
        *[added[c].alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        added["n_lines"].alias("n_lines"), added["n_dropped"].alias("n_dropped"),
    )


SQL_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
KEPT_LINES_SQL = f"""
  l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  k AS (SELECT *, translate(trim(line, {SQL_BLANK}), '{UPPER}', '{LOWER}') AS key FROM l),
  o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
  j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))"""


@query(
    "op3_line_dedup",
    sql=f"""WITH {KEPT_LINES_SQL}
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
      FROM j GROUP BY doc_id""",
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(load(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
