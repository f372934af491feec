"""Nested metadata: anomaly descriptions and equipment attributes held as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed layout of an anomaly description.
ANOMALY_SCHEMA = """anomalies ARRAY<STRUCT<
  id: STRING, hasBeginning: STRING, hasEnd: STRING,
  wasOriginatedBy: STRUCT<Observation: STRUCT<
    label: STRING,
    madeBySensor: STRUCT<Sensor: STRUCT<id: STRING>>,
    observedProperty: STRUCT<ObservableProperty: STRING>,
    hasFeatureOfInterest: STRUCT<FeatureOfInterest: STRING>>>>>"""


def read_json(spark: SparkSession, path: str, schema: str = ANOMALY_SCHEMA, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def flatten_anomalies(df: DataFrame, keep: Sequence[str] = (), column: str = "anomalies") -> DataFrame:
    """One flat row per anomaly."""
    a = F.col("a")
    seen = a["wasOriginatedBy"]["Observation"]
    return df.select(*keep, F.explode(column).alias("a")).select(
        *keep,
        a["id"].alias("id"),
        a["hasBeginning"].alias("begin"),
        a["hasEnd"].alias("end"),
        seen["madeBySensor"]["Sensor"]["id"].alias("sensor"),
        seen["label"].alias("observation"),
        seen["observedProperty"]["ObservableProperty"].alias("property"),
        seen["hasFeatureOfInterest"]["FeatureOfInterest"].alias("feature"),
    )


def parse_anomalies(text: Column) -> Column:
    return F.from_json(text, ANOMALY_SCHEMA)["anomalies"]


def extra_fields(df: DataFrame, metadata: str, fields: Mapping[str, str]) -> DataFrame:
    """Read ``extra_fields.<name>.value`` of a JSON column into columns, ``{column: field name}``."""
    return df.withColumns({
        name: F.get_json_object(F.col(metadata), f"$.extra_fields['{field}'].value") for name, field in fields.items()
    })


def json_columns(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON text column once and add its top-level fields as columns."""
    parsed = df.withColumn("__json", F.from_json(F.col(column), schema))
    names = parsed.schema["__json"].dataType.names
    return parsed.withColumns({n: F.col(f"__json.{n}") for n in names}).drop("__json")
