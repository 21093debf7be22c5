"""As-of join: the last earlier row of another table, without pairing rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scans import running


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """Each left row with `take` of the latest right row of its group at or before it (null without one).

    Both tables stand on one time line per group and the last right row is carried forward, over ranges
    where a group is large, so rows are sorted once and never paired. Of right rows at one time the greatest values of `take` count.
    """
    packed = F.struct(F.col(on), *take)
    line = left.withColumn("_right", F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(1))
    other = right.select(*by, on, packed.alias("_right"), F.lit(0).alias("_side"))
    both = running(line.unionByName(other, allowMissingColumns=True), by, [on, "_side", "_right"], {"_last": ("last", F.col("_right"))}).where("_side = 1")
    near = F.lit(True) if tolerance is None else F.col(on) - F.col(f"_last.{on}") <= tolerance
    return both.select(*left.columns, *(F.when(near, F.col(f"_last.{c}")).alias(c) for c in take))
