"""Metrics of a run by step: scalars, histograms, tables, texts, images and graphs, each logged once.

Every kind is a table of its own below the root; what one call logs is a batch of the sink, keyed by step
and name, so a step that is repeated after a crash leaves its metrics as they are. Histograms and graphs are made
by Spark from whole columns; only scalars, tables and images come from the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.sources import sink

KINDS = {
    "scalars": "step long, name string, value double",
    "histograms": "step long, name string, bin int, low double, high double, n long",
    "tables": "step long, name string, row int, header string, value string",
    "texts": "step long, name string, text string",
    "images": "step long, name string, format string, image binary",
    "graphs": "step long, name string, source string, target string, n long",
}


@dataclass(frozen=True)
class Metrics:
    spark: SparkSession
    root: str

    def _add(self, kind: str, step: int, name: str, rows: DataFrame) -> bool:
        key = re.sub(r"[^\w.-]", lambda m: f"-{ord(m[0]):x}-", f"{step}-{name}")
        columns = [c.strip().split(" ")[0] for c in KINDS[kind].split(",")]
        return sink.publish(rows.withColumn("step", F.lit(step).cast("long")).select(columns), f"{self.root}/{kind}", key)

    def scalars(self, step: int, values: dict[str, float], name: str = "scalars") -> bool:
        return self._add("scalars", step, name, self.spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double"))

    def histogram(self, step: int, name: str, rows: DataFrame, column: str, bins: int = 30) -> bool:
        """Equal bins from the least to the largest number; nulls and NaN are left out, and of equal numbers there is one bin."""
        x = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
        low, high = x.agg(F.min("x"), F.max("x")).first()
        if low is None:
            return self._add("histograms", step, name, self.spark.createDataFrame([], KINDS["histograms"]))
        n = bins if high > low else 1
        width = (high - low) / n
        at = F.least(F.floor((F.col("x") - low) / (width or 1.0)).cast("int"), F.lit(n - 1))
        counts = x.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
        every = self.spark.range(n).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
        edge = lambda i: F.lit(low) + i * F.lit(width)
        return self._add("histograms", step, name, every.select(F.lit(name).alias("name"), "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n")))

    def table(self, step: int, name: str, rows: list[list]) -> bool:
        """The first row is the header; rows of another width are an error."""
        if not rows or any(len(r) != len(rows[0]) for r in rows):
            raise ValueError("a table's rows must be as wide as its header")
        cells = [(name, i, str(h), str(v)) for i, r in enumerate(rows[1:]) for h, v in zip(rows[0], r)]
        return self._add("tables", step, name, self.spark.createDataFrame(cells, "name string, row int, header string, value string"))

    def texts(self, step: int, name: str, rows: DataFrame) -> bool:
        """rows: name and text."""
        return self._add("texts", step, name, rows)

    def image(self, step: int, name: str, body: bytes, kind: str = "png") -> bool:
        return self._add("images", step, name, self.spark.createDataFrame([(name, kind, bytearray(body))], "name string, format string, image binary"))

    def graph(self, step: int, name: str, edges: DataFrame) -> bool:
        """edges: source and target; how often each is there."""
        counted = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).groupBy("source", "target").agg(F.count("*").alias("n"))
        return self._add("graphs", step, name, counted.withColumn("name", F.lit(name)))

    def read(self, kind: str) -> DataFrame:
        return sink.read(self.spark, f"{self.root}/{kind}", KINDS[kind]).drop("batch")
