"""Small driver-side tables (rules, hot groups) as DataFrames that need no job to read."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    columns = {f.name: [row[i] for row in rows] for i, f in enumerate(schema.fields)}
    df = spark.createDataFrame(pa.table(columns))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
