"""Reading and writing of JSON documents and line-delimited streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_documents(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None, strict: bool = True) -> DataFrame:
    """One row per JSON document (a whole file each) with a declared schema and
    the file's name. ``pattern`` limits the file names. Strict reading fails
    on a document that doesn't fit; else it goes to ``_corrupt_record``."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path).withColumn("file_name", F.col("_metadata.file_name"))


def write_json_documents(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Documents by the job committer: readers never see half-written files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def assemble_chunks(lines: DataFrame, key: list[str], order: str, line: str, content: str = "$.message.content", error: str = "$.error") -> DataFrame:
    """Responses put together from line-delimited JSON chunks: key, text, error.

    Chunks are joined in order; the first error is kept; lines that are no
    JSON count as empty."""
    read = lines.select(*key, F.col(order).alias("__at"), F.get_json_object(line, content).alias("__c"), F.get_json_object(line, error).alias("__e"))
    out = read.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("__at", F.coalesce("__c", F.lit("")).alias("c")))).alias("__parts"),
        F.min_by("__e", F.when(F.col("__e").isNotNull(), F.col("__at"))).alias("error"),
    )
    return out.select(*key, F.array_join(F.transform("__parts", lambda x: x["c"]), "").alias("text"), "error")
