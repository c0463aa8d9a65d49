"""Numbers without gaps within a group, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recovery import cut


def placed(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the order of their group; ties are in any order.

    Rows are dealt by ranges of group and order, so a large group is spread. They are
    numbered within its part of a range, and parts are moved by the rows of
    those before, of which there is one sum per group and range.
    """
    part, base, within = (f"{name}_{x}" for x in ("part", "base", "within"))
    ranged = rows.repartitionByRange(group, *order)
    stored = cut(ranged.withColumn(part, F.spark_partition_id()))
    sums = stored.groupBy(group, part).agg(F.count(F.lit(1)).alias(base))
    before = F.sum(base).over(W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    moved = sums.select(F.col(group).alias(f"{name}_group"), F.col(part).alias(f"{name}_of"), F.coalesce(before, F.lit(0)).alias(base))
    own = F.row_number().over(W.partitionBy(group, part).orderBy(*order))
    numbered = stored.withColumn(within, own)
    out = numbered.join(moved, F.col(group).eqNullSafe(F.col(f"{name}_group")) & (F.col(part) == F.col(f"{name}_of")))
    return out.withColumn(name, (F.col(base) + F.col(within)).cast("int")).select(*rows.columns, name)
