"""A Merkle tree over a dataset: parents by slot pivot, proofs by leaving the own slot out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.line_runs import LOWER, UPPER
from quire.llm.registry import load, query
from quire.llm.scratch import settle

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (grp, ...) with idx, the place within the group, and size, the rows of the group.

    Ranges of (grp, order) are sorted by a task each, and each range is shifted by what earlier ones hold of its group;
    a group of any size is so numbered by many tasks. The window is over one row for each group and range.
    """
    order = (F.col("grp").asc(), *order)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = settle(ranged.withColumn("place", F.monotonically_increasing_id()), "places")
    stored = stored.withColumn("part", F.shiftright("place", 33))
    sizes = stored.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "grp", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("grp")).alias("size"),
    )
    numbered = stored.join(settle(shifts, "shifts"), ["grp", "part"])
    return numbered.withColumn("idx", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """Slot pivot: (grp, idx, size, c0.., r0.., digest), one row for every ``fanout`` nodes in a row of a group.

    Conditional aggregates spread the digests and records of the children into columns; the digest is the hash of the
    columns put together. A parent has ``fanout`` children at most, so no group of the aggregate is large.
    """
    slots = range(fanout)
    spread = [f"max(CASE WHEN idx % {fanout} = {j} THEN {c} END) AS {n}{j}" for n, c in (("c", "digest"), ("r", "rec")) for j in slots]
    rows = nodes.withColumn("up", F.expr(f"idx div {fanout}")).groupBy("grp", "up", "size").agg(*map(F.expr, spread))
    whole = f"sha2(concat_ws('', {', '.join(f'c{j}' for j in slots)}), 256) AS digest"  # without the empty slots
    return rows.selectExpr("grp", "up AS idx", f"(size + {fanout - 1}) div {fanout} AS size", "* EXCEPT (grp, up, size)", whole)


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The parents of ``nodes``, their parents and so on, each level a written table, until no group has two nodes."""
    most, levels, current = nodes.agg(F.max("size")).first()[0] or 0, [], nodes
    while most > 1:
        current = settle(_parents(current.where("size > 1"), fanout), "level")
        levels.append(current)
        most = -(-most // fanout)
        current = current.withColumn("rec", F.lit(None).cast("string"))
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, digest) of the one node that remains of each group."""
    return reduce(DataFrame.union, [x.where("size = 1").select("grp", "digest") for x in (nodes, *levels)])


def _children(parents: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """The nodes below ``parents``: the siblings are the columns without the own one, put in front of the parent's path."""
    slots = range(fanout)

    def others(some: range) -> str:
        return f"concat_ws('', {', '.join(f'c{i}' for i in some)})" if len(some) else "''"

    each = [
        f"struct(idx * {fanout} + {j} AS idx, c{j} AS digest, r{j} AS rec, "
        f"{others(slots[:j])} AS before, {others(slots[j + 1 :])} AS after)"
        for j in slots
    ]
    rows = parents.selectExpr("grp", *carried, "path AS up", f"inline(array({', '.join(each)}))").where("digest IS NOT NULL")
    path = f"concat(cast(array(struct(before, after)) AS {PATH}), up) AS path"
    return rows.selectExpr("grp", "idx", "digest", "rec", path, *carried)


def _paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """``nodes`` with the path up to the root, and what ``tops`` (grp, path, ...) says of their group.

    Paths come down level by level; only rows of a level's own size are joined, the last time one for ``fanout`` leaves.
    """
    below = None
    for parents in reversed(levels):
        found = parents.where("size = 1").join(tops, "grp")
        if below is not None:
            known = below.select("grp", "idx", "path", *carried)
            found = found.unionByName(parents.where("size > 1").join(known, ["grp", "idx"]))
        below = _children(found, fanout, carried)
    alone = nodes.where("size = 1").join(tops, "grp").select("grp", "idx", "digest", "rec", "path", *carried)
    return alone if below is None else below.unionByName(alone)


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", carry: tuple[str, ...] = (), fanout: int = FANOUT
) -> DataFrame:
    """(key, *carry, leaf, path, subroot, root) of every row of ``docs``.

    A leaf is the SHA-256 of the row's ``fields``, each with its length, so that no two rows of other values give the
    same bytes; digests are lower-case hex. The leaves of a group ascend by key, null first, equal keys by leaf; every
    ``fanout`` of them in a row become one node, the last few too, until one is left, the subroot. Subroots, by group and
    null first, make the root in the same way. ``path`` has for each level, from leaf to root, the siblings in front of
    the node and behind it, put together; ``folded`` walks it. Repeated rows are leaves each. A null group is one of its
    own. An empty table gives none. Columns other than those named are not looked at.
    """
    marked = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first
    rec = F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)])
    leaves = docs.select(marked.alias("grp"), leaf_of(*map(F.col, fields)).alias("digest"), rec.alias("rec"))
    nodes = _numbered(settle(leaves, "leaves"), F.col("rec.key").asc_nulls_first(), F.col("digest").asc())
    nodes = settle(nodes.select("grp", "idx", "size", "digest", "rec"), "nodes")
    levels = _levels(nodes, fanout)

    subroots = _tops(nodes, levels).select(F.lit("").alias("grp"), "digest", F.col("grp").alias("rec"))
    heads = settle(_numbered(subroots, F.col("rec").asc()).select("grp", "idx", "size", "digest", "rec"), "nodes")
    upper = _levels(heads, fanout)
    root = _tops(heads, upper).select("grp", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = _paths(heads, upper, root, fanout, ["root"])
    tops = settle(tops.select(F.col("rec").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "subroots")

    found = _paths(nodes, levels, tops, fanout, ["subroot", "root"])
    named = [F.col("rec.key").alias(key), *[F.col(f"rec.x{i}").alias(c) for i, c in enumerate(carry)]]
    return found.select(*named, F.col("digest").alias("leaf"), "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof_digest(path: Column) -> Column:
    """One hash over all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def _oracle(levels: int = 9, upper: int = 3) -> str:
    """The tree in SQL, level by level; groups of up to 8^9 rows and up to 8^3 languages."""

    def enc(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in (*FIELDS[:-1], text)) + ")"

    def level(prefix: str, k: int) -> str:
        return f"""{prefix}{k + 1} AS (SELECT grp, idx // 8 AS idx, (any_value(size) + 7) // 8 AS size,
          sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {prefix}{k} WHERE size > 1 GROUP BY grp, idx // 8)"""

    def step(prefix: str, k: int, row: str, grp: str) -> str:
        """The rows of table ``row``{k} one level up; node is the digest folded so far, proof the siblings put together."""
        return f"""{row}{k + 1} AS (SELECT d.* REPLACE (
            CASE WHEN s.grp IS NULL THEN d.node ELSE sha256(coalesce(s.before, '') || d.node || coalesce(s.after, '')) END AS node,
            d.proof || coalesce(s.before, '') || coalesce(s.after, '') AS proof, d.pl // 8 AS pl)
          FROM {row}{k} d LEFT JOIN (SELECT d.row, d.{grp} AS grp, string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < d.pl) AS before,
              string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > d.pl) AS after
            FROM {row}{k} d JOIN {prefix}{k} n ON n.grp = d.{grp} AND n.idx // 8 = d.pl // 8 AND n.size > 1
            GROUP BY d.row, d.{grp}) s ON s.row = d.row)"""

    bits = """list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))),
      lambda i: (ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) >> (i % 8)::INT)::BIGINT & 1)"""
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}),
      lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))))"""
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"""g AS (SELECT {", ".join(FIELDS)}, coalesce('1' || lang, '0') AS grp, {leaf('text')} AS leaf,
          CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM documents)""",
        """n AS (SELECT *, row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS row,
          row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM g)""",
        "l0 AS (SELECT grp, idx, size, leaf AS digest FROM n)",
        *[level("l", k) for k in range(levels)],
        "sub AS (" + " UNION ALL ".join(f"SELECT grp, digest FROM l{k} WHERE size = 1" for k in range(levels + 1)) + ")",
        """m0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS size, digest, grp AS name FROM sub)""",
        "u0 AS (SELECT grp, idx, size, digest FROM m0)",
        *[level("u", k) for k in range(upper)],
        "top AS (" + " UNION ALL ".join(f"SELECT digest FROM u{k} WHERE size = 1" for k in range(upper + 1)) + ")",
        "d0 AS (SELECT row, doc_id, leaf, grp, '' AS one, idx AS pl, changed AS node, '' AS proof FROM n)",
        *[step("l", k, "d", "grp") for k in range(levels)],
        f"e0 AS (SELECT d.* REPLACE (m.idx AS pl), m.digest AS subroot FROM d{levels} d JOIN m0 m ON m.name = d.grp)",
        *[step("u", k, "e", "one") for k in range(upper)],
    ]
    return f"""WITH {", ".join(ctes)} SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256,
      node AS folded_root, node = top.digest AS verified FROM e{upper}, top"""


SQL_TEXT = _oracle()


@query("op12_manifest", sql=SQL_TEXT)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", UPPER, LOWER)
    tampered = F.when(altered, leaf_of(*[lower if c == "text" else F.col(c) for c in FIELDS]))
    found = manifest(docs.withColumn("__tampered", tampered), carry=("__tampered",))
    found = found.withColumn("folded_root", folded(F.coalesce("__tampered", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
