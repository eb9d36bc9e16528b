"""JSON-lines, CSV and JSON in and out, through Spark's readers and writers only."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a known schema; blank lines are skipped, a missing path is empty, a bad row is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "true").json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame | None:
    """An annotator's CSV, all columns as text; None if there is none."""
    try:
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    except AnalysisException:
        return None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines; 0 if the path is missing."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def to_json(row: DataFrame) -> str:
    """A report of one row as indented JSON."""
    return json.dumps(row.limit(1).toPandas().to_dict("records")[0], indent=2, default=str)


def required(df: DataFrame, *columns: str, **allowed: tuple) -> DataFrame:
    """The rows, with an error at run time for a null in a required column or a value outside its set."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    for c, values in allowed.items():
        df = df.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin(*values), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} may not be "), F.col(c)))))
    return df
