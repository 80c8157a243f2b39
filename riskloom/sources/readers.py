"""Readers (S1, S2, S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schema as S

JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def conform(df: DataFrame, schema) -> DataFrame:
    """Select the schema's columns in order, cast to its types; missing columns become null."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def conform_transactions(df: DataFrame) -> DataFrame:
    """Labelled transaction schema; zone-less timestamps are read as UTC ``timestamp``."""
    return conform(df, S.TRANSACTION)


# S1
def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan of labelled transactions (column pruning and filter pushdown apply to
    whatever the caller selects and filters afterwards)."""
    return conform_transactions(spark.read.parquet(path))


# S2
def read_profiles(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Profile table, or an empty frame with the profile schema when there is none (every
    transaction then takes the no-profile defaults)."""
    if path:
        try:
            return conform(spark.read.parquet(path), S.PROFILE)
        except Exception as e:  # missing path → no profiles
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
    return spark.createDataFrame([], S.PROFILE)


# S4
def requests_from_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """Scoring requests from JSON text (one object per row); currency defaults to USD and
    country to US."""
    r = lines.select(F.from_json(F.col(col), S.REQUEST,
                                 {"timestampFormat": JSON_TS_FORMAT}).alias("r")).select("r.*")
    return (r.withColumn("currency", F.coalesce("currency", F.lit("USD")))
            .withColumn("country", F.coalesce("country", F.lit("US"))))


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(S.REQUEST).option("timestampFormat", JSON_TS_FORMAT).json(path)
    return (raw.withColumn("currency", F.coalesce("currency", F.lit("USD")))
            .withColumn("country", F.coalesce("country", F.lit("US"))))
