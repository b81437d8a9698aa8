"""Incremental screening of a parsed table as a stream (an extension: the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docgauge.plans.run import measured
from docgauge.sources.grid import Grid, load_grid


def screen_stream(docs: DataFrame, grid: Grid | None = None) -> DataFrame:
    """Route of every new document: all expressions are stateless, so they run on a stream as on a table."""
    m = measured(docs, grid or load_grid())
    return m.select("doc_id", "route", "reason", "n_tokens", "non_alpha_fraction", "duplicate_line_fraction", "mattr")


def screen_new_files(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, grid: Grid | None = None) -> StreamingQuery:
    """Screen the Parquet files that arrived since the last run and stop; each file is read once."""
    new = spark.readStream.schema(schema).parquet(folder)
    return screen_stream(new, grid).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
