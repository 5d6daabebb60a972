"""Context windows: consecutive rows of a group joined to one text."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 1_000_000


class Contextualizer:
    """contextualize(df, order).window(6).stride(3).group_by("doc").text_column("token").to_df()

    A window starts at every `stride` rows of a group; it stays if it is full or holds
    min_window_size rows or more.  Its other columns are those of its first row.  Windows of
    ungrouped rows cross documents.  Inputs of up to CELL_ROWS rows take one sorted window a group.  Larger ones are cut
    into cells by ranges of (group, order) and numbered in two levels, and each row goes to the windows
    that hold it: so one group, or no group at all, is still many pieces of work.
    """

    def __init__(self, frame: DataFrame, order: str | Sequence[str]) -> None:
        self._frame, self._order = frame, [order] if isinstance(order, str) else list(order)
        self._window = self._stride = self._text = None
        self._groups: list[str] = []
        self._least = 2

    def window(self, rows: int) -> Contextualizer:
        self._window = rows
        return self

    def stride(self, rows: int) -> Contextualizer:
        self._stride = rows
        return self

    def group_by(self, *columns: str) -> Contextualizer:
        self._groups = list(columns)
        return self

    def text_column(self, column: str) -> Contextualizer:
        self._text = column
        return self

    def min_window_size(self, rows: int) -> Contextualizer:
        self._least = rows
        return self

    def _in_cells(self, cells: int) -> DataFrame:
        """The windows, each gathered from its own rows."""
        columns, groups = self._frame.columns, [f"_g{i}" for i in range(len(self._groups))]
        named = self._frame.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{self._text}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(g) for c, g in zip(self._groups, groups, strict=True)], *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(self._order)])
        order = [f"_o{i}" for i in range(len(self._order))]
        ranged = named.repartitionByRange(cells, *groups, *order).withColumn("_cell", F.spark_partition_id())
        from ..sources.scratch import shared_dir

        path = f"{shared_dir(named.sparkSession)}/skerry-context-{uuid.uuid4().hex}"
        ranged.write.parquet(path)  # so that every later step sees one and the same dealing
        held = named.sparkSession.read.schema(ranged.schema).parquet(path)
        sizes = held.groupBy(*groups, "_cell").agg(F.count("*").alias("_n"))
        before = sizes.select(*[F.col(g).alias(f"{g}b") for g in groups], F.col("_cell").alias("_cellb"), (F.sum("_n").over(Window.partitionBy(*groups).orderBy("_cell")) - F.col("_n")).alias("_before"))
        here = held.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(*order)) - 1)
        same = [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in groups] + [F.col("_cell") == F.col("_cellb")]
        on = same[0]
        for c in same[1:]:
            on = on & c
        placed = here.join(before, on).withColumn("_at", F.col("_at") + F.col("_before"))
        first = F.greatest(F.lit(0), F.ceil((F.col("_at") - self._window + 1) / F.lit(self._stride))).cast("long")
        last = F.floor(F.col("_at") / F.lit(self._stride)).cast("long")
        spread = placed.withColumn("_w", F.explode(F.when(first <= last, F.sequence(first, last))))  # a stride beyond the window leaves rows out
        made = spread.groupBy(*groups, "_w").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_text", F.lit("")).alias("t")))).alias("_texts"), F.min_by("_row", "_at").alias("_row"))
        kept = made.filter((F.col("_n") == self._window) | (F.col("_n") >= self._least))
        text = F.array_join(F.transform("_texts", lambda x: x["t"]), " ")
        return kept.select(*[text.alias(c) if c == self._text else F.col("_row")[c].alias(c) for c in columns])

    def to_df(self, cell_rows: int = CELL_ROWS) -> DataFrame:
        if self._text not in self._frame.columns:
            raise ValueError(f"no text column {self._text}")
        if not self._window or self._window < 1:
            raise ValueError("window must be at least 1")
        if not self._stride or self._stride < 1:
            raise ValueError("stride must be at least 1")
        cells = -(-self._frame.count() // cell_rows)
        if cells > 1:
            return self._in_cells(cells)
        order = Window.partitionBy(*self._groups).orderBy(*self._order)
        ahead = order.rowsBetween(0, self._window - 1)
        # rows from here to the end of the window at most: enough to know whether it is full
        rows = self._frame.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(ahead), "_texts": F.collect_list(F.coalesce(F.col(f"`{self._text}`").cast("string"), F.lit(""))).over(ahead)})
        starts = rows.filter((F.col("_at") % self._stride == 0) & ((F.col("_n") == self._window) | (F.col("_n") >= self._least)))
        return starts.withColumn(self._text, F.array_join("_texts", " ")).drop("_at", "_n", "_texts")

    def to_pandas(self):
        return self.to_df().toPandas()


def contextualize(frame: DataFrame, order: str | Sequence[str]) -> Contextualizer:
    return Contextualizer(frame, order)
