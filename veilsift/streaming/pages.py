"""Pages as they arrive: the batch scan is stateless, so a stream of files goes through the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilsift.operators.reduce import scan


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_stream(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return scan(pages, html_col).drop(html_col)


def write_labelled(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Labelled pages to a table, each once: the file sink commits a batch as a whole."""
    hits = scan_stream(pages).where(F.col("label").isNotNull())
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
