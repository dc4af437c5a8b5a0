"""Filters and sinks on streams.

The row-wise filters are the same transforms as in batch.  First-per-headword
keeps its state in Spark (without a watermark it grows with the keys), and one
stream can feed several sinks by ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import headword
from ..operators import filters

#: Filters that need an order or a group over all rows have no row-wise form.
NOT_ROWWISE = ("skip_duplicate_headword", "prevent_duplicate_terms")


def filtered_stream(stream: DataFrame, config: dict | None = None, languages: tuple[str, ...] = ()) -> DataFrame:
    config = dict(config or {})
    unique = config.pop("skip_duplicate_headword", False)
    if config.get("prevent_duplicate_terms"):
        raise ValueError("numbering of repeats needs all rows; run it on the batch")
    out = filters.apply(stream, config, languages)
    return out.withColumn("_h", headword()).dropDuplicates(["_h"]).drop("_h") if unique else out


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes to every sink; the batch is read once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of entries from tab-separated files that arrive in a folder."""
    from ..functions import text

    lines = spark.readStream.text(folder)
    cut = F.split("value", "\t", 2)
    rows = lines.filter(F.col("value").contains("\t") & ~F.col("value").startswith("#"))
    return rows.select(
        F.lit(None).cast("long").alias("seq"), F.lit(0).alias("part"), text.split_bar_unescape_ntb(F.get(cut, F.lit(0))).alias("terms"), text.unescape_ntb(F.get(cut, F.lit(1))).alias("defi"),
        F.lit("m").alias("defi_format"), F.lit(False).alias("is_data"), F.lit(None).cast("string").alias("fname"), F.lit(None).cast("binary").alias("data"),
    )
