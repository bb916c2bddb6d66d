"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import load, query
from quire.llm.scratch import settle

TERM = "[a-z0-9]+(?:[.][0-9]+)*"
HEADER_LEAST, FILE_LEAST = 0.7, 0.5
WHOLE = -1  # the unit that is a whole file; others are lines
#: Notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


def _counts(text: str) -> dict[str, int]:
    found = re.findall(TERM, text.lower())
    return {t: found.count(t) for t in found}


def anchors(vectors: dict[str, dict[str, float]], least: float) -> list[str]:
    """Terms of which a text must have one to reach ``least`` with some template.

    By Cauchy-Schwarz, sharing only a set of terms gives a cosine of at most that set's part of the template's length;
    each template leaves out its lightest terms as long as their part stays below ``least``.
    """
    kept: set[str] = set()
    for vector in vectors.values():
        total, part = sum(w * w for w in vector.values()), 0.0
        for term, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            part += w * w
            if part >= least * least * total * (1 - 1e-9):
                kept.add(term)
    return sorted(kept)


def scan(
    files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] = TEMPLATES,
    header_least: float = HEADER_LEAST, file_least: float = FILE_LEAST,
) -> DataFrame:
    """All columns of ``files`` with licence, via (``header``, ``directory`` or null) and score.

    A file has the licence of its line nearest to a template, if that reaches ``header_least``. A file whose whole text
    reaches ``file_least`` is a licence file of its directory; where a directory has several, the nearest to a template
    counts, then the smallest path. Other files inherit from the nearest directory above that has one. Cosines are
    rounded to six digits; ties go to the first template by name. Weights are 1 + ln((n + 1) / (df + 1)) over all files,
    terms outside the templates counting as df 0. Only texts with an anchor term are weighed, which loses none.

    Null and empty texts have no licence of their own, null paths inherit none. Rows of one path and text get the same.
    An empty table gives none. Columns of ``files`` called licence, via or score are replaced.
    """
    spark = files.sparkSession
    counted = {name: _counts(t) for name, t in templates.items()}
    vocabulary = sorted({t for c in counted.values() for t in c})
    own_terms = terms(F.col(text))
    total = files.count()
    seen = files.select(F.explode(F.array_intersect(own_terms, F.array(*map(F.lit, vocabulary)))).alias("term"))
    df = {r["term"]: r["count"] for r in seen.groupBy("term").count().collect()}  # at most one row a template term
    unknown = 1 + math.log(total + 1)
    idf = {t: 1 + math.log((total + 1) / (df.get(t, 0) + 1)) for t in vocabulary}
    vectors = {name: {t: n * idf[t] for t, n in c.items()} for name, c in counted.items()}
    wanted = F.array(*map(F.lit, anchors(vectors, min(header_least, file_least))))

    version = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    likely = files.where(F.col(path).isNotNull() & F.arrays_overlap(own_terms, wanted))
    likely = settle(likely.select(F.col(path).alias("p"), version.alias("ver"), F.col(text).alias("t")).distinct(), "likely")
    lines = likely.select("p", "ver", F.posexplode(F.split("t", "\n", -1)).alias("unit", "t"))
    units = lines.where(F.arrays_overlap(terms(F.col("t")), wanted)).union(likely.select("p", "ver", F.lit(WHOLE), "t"))
    tf = units.select("p", "ver", "unit", F.explode(terms(F.col("t"))).alias("term")).groupBy("p", "ver", "unit", "term").count()

    names = sorted(vectors)
    norms = {n: math.sqrt(sum(x * x for x in v.values())) for n, v in vectors.items()}
    rows = [(t, w, [vectors[n].get(t, 0.0) / norms[n] for n in names]) for t, w in idf.items()]
    # one row for each term of the templates
    weights = F.broadcast(spark.createDataFrame(rows, "term string, idf double, shares array<double>"))
    unit = ["p", "ver", "unit"]
    tf = tf.join(weights, "term", "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(unknown)))
    dots = [F.sum(F.col("w") * F.get("shares", F.lit(i))).alias(f"dot{i}") for i in range(len(names))]
    sums = tf.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    each = [F.struct(F.lit(n).alias("name"), F.round(F.col(f"dot{i}") / F.col("norm"), 6).alias("cos")) for i, n in enumerate(names)]
    near = settle(sums.select(*unit, F.inline(F.array(*each))).where("cos IS NOT NULL"), "near")

    best = F.min(F.struct((-F.col("cos")).alias("c"), "name")).alias("b")
    headers = near.where((F.col("unit") != WHOLE) & (F.col("cos") >= header_least)).groupBy("p", "ver").agg(best)
    headers = headers.select(F.col("p").alias("__p"), F.col("ver").alias("__ver"), F.col("b").alias("__own"))
    granting = near.where((F.col("unit") == WHOLE) & (F.col("cos") >= file_least))
    granting = granting.withColumn("dir", F.regexp_replace("p", "/[^/]*$", "")).groupBy("dir")
    granting = granting.agg(F.min(F.struct((-F.col("cos")).alias("c"), "p", "name")).alias("g"))

    above = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", 1, i), "/").alias("dir")),
    )
    paths = files.where(F.col(path).isNotNull()).select(F.col(path).alias("p")).distinct()
    paths = paths.withColumn("parts", F.split("p", "/", -1)).where(F.size("parts") > 1)
    inherited = paths.select("p", F.inline(above)).join(granting, "dir")
    inherited = inherited.groupBy(F.col("p").alias("__q")).agg(F.max_by("g", "depth").alias("__dir"))

    # the hash is a column before the join, so that a text nobody asks for does not travel with it
    joined = files.withColumn("__version", version)
    joined = joined.join(headers, (F.col(path) == F.col("__p")) & (F.col("__version") == F.col("__ver")), "left")
    joined = joined.join(inherited, F.col(path) == F.col("__q"), "left")
    has, gets = F.col("__own").isNotNull(), F.col("__dir").isNotNull()
    return joined.select(
        *[F.col(c) for c in files.columns if c not in ("licence", "via", "score")],
        F.when(has, F.col("__own.name")).otherwise(F.col("__dir.name")).alias("licence"),
        F.when(has, "header").when(gets, "directory").alias("via"),
        F.when(has, -F.col("__own.c")).otherwise(-F.col("__dir.c")).alias("score"),
    )


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query("op6_licenses", sql=f"""
  WITH f AS (SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
  n AS (SELECT count(*) AS total FROM f),
  t AS (SELECT * FROM (VALUES {_values(list(TEMPLATES.items()))}) AS v(name, text)),
  tt AS (SELECT name, term, count(*) AS tf FROM (
           SELECT name, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM t) GROUP BY ALL),
  vocabulary AS (SELECT DISTINCT term FROM tt),
  df AS (SELECT term, count(*) AS df FROM (
           SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM f)
         WHERE term IN (FROM vocabulary) GROUP BY term),
  idf AS (SELECT term, 1 + ln((total + 1) / (coalesce(df, 0) + 1)) AS idf FROM vocabulary LEFT JOIN df USING (term), n),
  tv AS (SELECT name, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY name)) AS norm
         FROM tt JOIN idf USING (term)),
  units AS (
    SELECT doc_id, path, -1 AS unit, text FROM f WHERE regexp_matches(lower(text), 'licen')
    UNION ALL SELECT doc_id, path, unit, text FROM (
      SELECT doc_id, path, unnest(string_split(text, chr(10))) AS text,
             generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM f) WHERE regexp_matches(lower(text), 'licen')),
  w AS (SELECT doc_id, path, unit, term, count(*) * coalesce(idf, 1 + ln(total + 1)) AS w FROM (
          SELECT doc_id, path, unit, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM units)
        LEFT JOIN idf USING (term), n GROUP BY doc_id, path, unit, term, idf, total),
  norms AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
  near AS (SELECT doc_id, path, unit, name, round(sum(w.w * tv.w) / max(tv.norm) / max(norms.norm), 6) AS cos
           FROM w JOIN tv USING (term) JOIN norms USING (doc_id, unit) GROUP BY doc_id, path, unit, name),
  own AS (SELECT doc_id, name, cos FROM near WHERE unit <> -1 AND cos >= {HEADER_LEAST}
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, name) = 1),
  g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, name, cos FROM near WHERE unit = -1 AND cos >= {FILE_LEAST}
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cos DESC, path, name) = 1),
  d AS (SELECT f.doc_id, g.name, g.cos FROM f, g WHERE starts_with(f.path, g.dir || '/')
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(g.dir) DESC) = 1)
  SELECT f.doc_id, f.path, coalesce(own.name, d.name) AS licence,
         CASE WHEN own.name IS NOT NULL THEN 'header' WHEN d.name IS NOT NULL THEN 'directory' END AS via,
         coalesce(own.cos, d.cos) AS score
  FROM f LEFT JOIN own USING (doc_id) LEFT JOIN d USING (doc_id)""")  # fmt: skip
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /source/lang/doc_id.txt."""
    docs = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    return scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "licence", "via", "score")
