"""Running streams over files; their state and results lie below a shared folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as a stream with a declared schema."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows a stream has written; none when its input was empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_append(stream: DataFrame, root: str) -> DataFrame:
    """Append the rows of a stream to a table until its input is read."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _written(spark, f"{root}/rows", stream.schema)


def run_upsert(stream: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """Latest version of every changed row of an aggregating stream.

    Each batch overwrites its own folder, so a repeated batch changes nothing;
    the newest batch of a key wins when the table is read.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    rows = _written(spark, f"{root}/rows", schema)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
