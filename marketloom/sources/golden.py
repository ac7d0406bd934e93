"""Sets of labelled titles that a model is graded on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "title string, expected_component string, expected_product_key string"


def golden(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The items of a JSON array; a path that does not exist has none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def annotated(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Each item with the answer for its title, and whether that is right; without an answer it is not."""
    rows = items.join(answers.select("title", "component_type"), "title", "left")
    return rows.withColumn("correct", F.coalesce(F.col("component_type") == F.col("expected_component"), F.lit(False)))
