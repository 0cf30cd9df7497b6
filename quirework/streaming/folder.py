"""Documents as they arrive: a stream over a folder of markdown, converted batch by batch.

Every operator is per document, so a batch needs no state of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import Config
from ..plans.convert import from_markdown


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, markdown of new files."""
    s = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).schema("value string")
    return s.load(folder).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("markdown"))


def convert(spark: SparkSession, folder: str, out: str, checkpoint: str, config: Config | None = None, once: bool = True) -> StreamingQuery:
    """Write a table of outputs (doc_id, format, content) a batch; a batch that is run again replaces its own folder."""
    config = config or Config(formats=("md",))

    def batch(df: DataFrame, number: int) -> None:
        made = from_markdown(df, config).outputs(config)
        for kind, table in made.items():
            table.write.mode("overwrite").parquet(f"{out}/{kind}/batch={number}")

    q = incoming(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
