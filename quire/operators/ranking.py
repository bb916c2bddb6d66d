"""Row numbers per group that hold when one group is a large part of the data."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_RANGES = 1024  # ranges a table is numbered in; more rows make longer ranges, which their sort may spill
SAMPLES = 32  # sampled keys for each range, and borders looked at in each of the two steps of a search


@dataclass(frozen=True)
class Key:
    """A part of a sort order: nulls first on the way up, last on the way down, as in ``asc()`` and ``desc()``."""

    value: Column
    down: bool = False

    def column(self) -> Column:
        return self.value.desc() if self.down else self.value.asc()

    def before(self, a: Column, b: Column) -> Column:
        if self.down:
            return F.coalesce(a > b, a.isNotNull() & b.isNull())
        return F.coalesce(a < b, a.isNull() & b.isNotNull())


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for intermediate data; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context.getCheckpointDir()


def numbered_by_window(df: DataFrame, group: list[Column], order: list[Key], into: str) -> DataFrame:
    inside = Window.partitionBy(*group).orderBy(*[k.column() for k in order])
    return df.withColumn(into, F.row_number().over(inside).cast("bigint"))


def _borders(keyed: DataFrame, names: list[str], before: Callable[[Column, Column], Column], ranges: int) -> list[Column]:
    """Borders of about even ranges of the sort keys, as scalar subqueries: every 32nd of them, and all, in order.

    A key is sampled by its own hash, so the same rows give the same borders whenever they are computed. Repeats of a
    sampled key count once, so there are about ``SAMPLES`` keys for each range, whatever the table.
    """
    wanted = F.lit(float(ranges * SAMPLES))
    share = wanted / F.greatest(keyed.select(F.count(F.lit(1))).scalar(), F.lit(1))
    chance = F.shiftrightunsigned(F.xxhash64(*names), 11) / F.lit(float(1 << 53))
    sampled = keyed.select(*names).where(chance < share).distinct()
    way = lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)
    keys = sampled.agg(F.array_sort(F.collect_list(F.struct(*names)), way).alias("keys"))
    every = lambda array, n: F.filter(array, lambda _, i: F.pmod(i, n) == 0)
    step = F.greatest(F.ceil(F.size("keys") / F.lit(ranges)).cast("int"), F.lit(1))
    return [keys.select(every("keys", step * n)).scalar() for n in (SAMPLES, 1)]


def placed_in_ranges(df: DataFrame, keys: list[Key], names: list[str], ranges: int) -> DataFrame:
    """``df`` with its sort keys under ``names`` and the number of its range, ``__range``."""

    def before(a: Column | None, b: Column) -> Column:
        pairs = [(k, F.col(n) if a is None else a[n], b[n]) for k, n in zip(keys, names)]
        return reduce(lambda rest, p: p[0].before(*p[1:]) | (p[1].eqNullSafe(p[2]) & rest), reversed(pairs), F.lit(False))

    keyed = df.withColumns(dict(zip(names, [k.value for k in keys])))
    some, all_of_them = _borders(keyed, names, before, ranges)
    passed = lambda some: F.size(F.filter(some, lambda b: ~before(None, b)))
    # each value is used once, so that Spark puts the subquery where its column stands and copies it into no row
    placed = keyed.withColumns({"__some": some, "__all": all_of_them})
    first = lambda n: F.greatest(n - 1, F.lit(0)) * SAMPLES
    near = lambda n: passed(F.slice("__all", first(n) + 1, F.lit(SAMPLES)))
    found = F.get(F.transform(F.array(passed(F.col("__some"))), lambda n: first(n) + near(n)), F.lit(0))
    return placed.withColumn("__range", found).drop("__some", "__all")


def numbered_by_range(
    df: DataFrame, group: list[Column], order: list[Key], into: str, ranges: int | None = None
) -> DataFrame:
    """Number rows from 1 per group with no group bound to one task, in one plan without a job or a stored table.

    Rows go to the range of their group and sort keys, are numbered inside it, and shifted by the number of rows of the
    same group in earlier ranges. Borders follow from the rows alone (``_borders``), so a range that is computed again,
    for the counts or after a lost executor, has the same rows. ``df`` must give the same rows each time, too. Rows of
    one group that agree in all keys share a range; their numbers among each other are arbitrary.
    """
    if ranges is None:
        ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    keys = [*map(Key, group), *order]
    names = [f"__key{i}" for i in range(len(keys))]
    groups = names[: len(group)]
    placed = placed_in_ranges(df, keys, names, ranges)
    window = Window.partitionBy("__range", *groups).orderBy(*[Key(F.col(n), k.down).column() for n, k in zip(names, keys)])
    inside = placed.withColumn("__inside", F.row_number().over(window))
    # the last number of each range and group: as many rows a group as there are ranges
    earlier = Window.partitionBy(*[f"r{n}" for n in groups]).orderBy("r__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = inside.groupBy("__range", *groups).agg(F.max("__inside").cast("bigint").alias("__rows"))
    counts = counts.select("__rows", *[F.col(n).alias(f"r{n}") for n in ("__range", *groups)])
    shifts = counts.withColumn("__shift", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).drop("__rows")
    # also null-safe on the range: a plain equality would look each row's range up once more, as a filter in the scan
    same = [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in ("__range", *groups)]
    found = inside.join(shifts, reduce(Column.__and__, same))
    return found.select(*df.columns, (F.col("__inside") + F.col("__shift")).cast("bigint").alias(into))


def numbered(
    df: DataFrame, group: list[Column], order: list[Key], into: str, by_range: bool | None = None
) -> DataFrame:
    """Row numbers per group, by ranges whatever the size; ``by_range=False`` is for groups known to be small."""
    by_range = by_range is None or by_range
    return (numbered_by_range if by_range else numbered_by_window)(df, group, order, into)
