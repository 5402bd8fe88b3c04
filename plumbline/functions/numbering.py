"""Numbers of rows within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.tables import written

#: Rows of the table of range sizes that are broadcast at most; beyond, they meet their rows in a shuffle join.
SIZES = 100_000
#: A row's place in its range: the low bits of monotonically_increasing_id, whose high bits are the range.
PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, group: list[str], order: list[str], number: str = "_n", total: str = "_all") -> DataFrame:
    """``rows`` with their ``number`` (from 0) in their group by ``order`` (nulls first), and the group's ``total``.

    No task gets a group: rows are dealt into ranges of (group, order) and sorted there; a row's number is its place among its group's rows of the range plus the
    sizes of the group's earlier ranges. There are at most as many sizes as groups and ranges together. Rows that are equal in group and order share a
    range and are numbered in any order: name columns in ``order`` that tell rows apart. The input is read twice, so give it a table.
    """
    at, low, before = (f"_{part}_of_{number}" for part in ("place", "low", "before"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order)
    dealt = written(dealt.withColumn(at, F.monotonically_increasing_id()), "ranges")
    span = F.shiftright(F.col(at), 33)
    sizes = dealt.groupBy(*group, span.alias("_range")).agg(F.count("*").alias("_rows"), F.min(F.col(at).bitwiseAND(F.lit(PLACE))).alias(low))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({before: F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), total: F.sum("_rows").over(Window.partitionBy(*group))})
    sizes = written(sizes.select(*[F.col(c).alias(f"_own_{i}") for i, c in enumerate(group)], "_range", low, before, total), "range-sizes")
    same = span == F.col("_range")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_own_{i}"))
    joined = dealt.join(sizes.hint("broadcast" if sizes.count() <= SIZES else "shuffle_hash"), same)
    place = F.col(at).bitwiseAND(F.lit(PLACE)) - F.col(low) + F.col(before)
    return joined.select(*[c for c in rows.columns if c not in (number, total)], place.alias(number), F.col(total))
