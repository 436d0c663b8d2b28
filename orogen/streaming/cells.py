"""Cells that arrive as a stream: suitability and masks as they come.

Row-local operators and joins with fixed dimension tables need no state, so they
run on a stream unchanged; stencils need whole neighbourhoods and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.responses import suitability
from ..operators.dither import mask


def masks(fields: DataFrame, thresholds: DataFrame, side: int = 64) -> DataFrame:
    """(z, x, feature, p, v) for each arriving field cell (z, x, h, slope_deg)."""
    return mask(suitability(fields), thresholds, side, side)


def run(spark: SparkSession, source: str, schema: str, thresholds: DataFrame, sink: str, checkpoint: str, side: int = 64) -> StreamingQuery:
    """Reads Parquet cells as they arrive and appends their masks; restarts resume from the checkpoint."""
    out = masks(spark.readStream.schema(schema).parquet(source), thresholds, side)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
