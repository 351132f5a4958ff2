"""A bounded sample of labelled rows, taken alike at every size of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_UNIT = 1 << 32


class Sample:
    """Of each label the rows(label) ids of least hash, or all, if there are fewer.

    labelled: id (long), label, and what else is wanted.  Rows without id or label
    are not sampled.  `near` has, of a label with n ids, only the rows whose hash is
    in the first 2 * rows / n of its range: what is shuffled or broadcast further is
    a few thousand ids, however many there are.
    """

    def __init__(self, labelled: DataFrame, rows: Callable[[object], int]):
        known = labelled.where("id is not null and label is not null").withColumn("at", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(_UNIT)))
        sizes = known.groupBy("label").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()  # a row for each label
        self._most = {r.label: rows(r.label) for r in sizes}
        near = F.lit(False)
        for r in sizes:
            near = near | ((F.col("label") == F.lit(r.label)) & (F.col("at") < min(_UNIT, 2 * self._most[r.label] * _UNIT // max(1, r.n))))
        self.near = known.where(near)

    def texts(self, near: DataFrame) -> list[tuple]:
        """[(label, id, text)] from `near` with a column text; of rows that share id and label the least text counts, nulls not."""
        once = near.where("text is not null").groupBy("label", "id", "at").agg(F.min("text").alias("text"))
        most = F.lit(0)
        for label, n in self._most.items():
            most = F.when(F.col("label") == F.lit(label), n).otherwise(most)
        order = Window.partitionBy("label").orderBy("at", "id")
        picked = once.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most)
        return sorted((r.label, r.id, r.text) for r in picked.select("label", "id", "text").collect())
