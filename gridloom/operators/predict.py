"""Prediction: a pluggable model whose output the structure operators decode.

A predictor turns region rows (page_id, table_index, ...) into ids, boxes and class logits. Offline the
default reads them from a table; a stub serves tests.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "page_id long, table_index int, ids array<int>, boxes array<array<float>>, logits array<array<float>>"


class Predictor(Protocol):
    def predict(self, regions: DataFrame) -> DataFrame:
        """Rows of OUTPUT, one for each region."""


class TablePredictor:
    """Predictions that were stored before."""

    def __init__(self, stored: DataFrame) -> None:
        self.stored = stored

    def predict(self, regions: DataFrame) -> DataFrame:
        return regions.select("page_id", "table_index").join(self.stored, ["page_id", "table_index"])


class StubPredictor:
    """A fixed grid of full cells, ``rows`` by ``columns``, for tests."""

    def __init__(self, rows: int = 2, columns: int = 2) -> None:
        self.rows, self.columns = rows, columns

    def predict(self, regions: DataFrame) -> DataFrame:
        ids = [2, *([5] * self.columns + [9]) * self.rows, 3]
        boxes = [[(c + 0.5) / self.columns, (r + 0.5) / self.rows, 1 / self.columns, 1 / self.rows] for r in range(self.rows) for c in range(self.columns)]

        def run(batches):
            for t in batches:
                yield pd.DataFrame({"page_id": t["page_id"], "table_index": t["table_index"], "ids": [ids] * len(t), "boxes": [boxes] * len(t), "logits": [[[0.0, 0.0, 1.0]] * len(boxes)] * len(t)})

        return regions.select("page_id", "table_index").mapInPandas(run, OUTPUT)


def default_regions(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """The given regions, or the full page where a page has none: page_id, table_index, l, t, r, b."""
    j = pages.select("page_id", "width", "height").join(regions, "page_id", "left")
    none = F.col("table_index").isNull()
    full = {"l": F.lit(0.0), "t": F.lit(0.0), "r": F.col("width").cast("double"), "b": F.col("height").cast("double")}
    return j.select("page_id", F.coalesce("table_index", F.lit(0)).alias("table_index"), *(F.when(none, full[k]).otherwise(F.col(k)).alias(k) for k in "ltrb"))
