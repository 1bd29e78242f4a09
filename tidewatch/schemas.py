"""Record schemas and the conversions between Avro and Spark types (PRJ1, PRJ7, PRJ12, PRJ13)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the power columns, of the joints and of each joint's columns.
POWER_COLUMNS = [
    "robot_action_id",
    "apparent_power",
    "current",
    "frequency",
    "phase_angle",
    "power",
    "power_factor",
    "reactive_power",
    "voltage",
]
JOINTS = 7
JOINT_COLUMNS = [
    "x_acc",
    "y_acc",
    "z_acc",
    "x_ang_velocity",
    "y_ang_velocity",
    "z_ang_velocity",
    "01_quartenion_orientation",
    "02_quartenion_orientation",
    "03_quartenion_orientation",
    "04_quartenion_orientation",
    "temperature",
]
MOTION_COLUMNS = [f"j{j:02d}_{c}" for j in range(1, JOINTS + 1) for c in JOINT_COLUMNS]
FAMILIES = {
    "control_power": POWER_COLUMNS,
    "accelerometer_gyro": MOTION_COLUMNS,
    "robot_data": POWER_COLUMNS + MOTION_COLUMNS,
}
AVRO_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def record_schema(family: str, timestamp_type: str = "long") -> str:
    """Avro schema text of a column family plus its source timestamp."""
    fields = [{"name": c, "type": "float"} for c in FAMILIES[family]]
    fields.append({"name": "source_timestamp", "type": timestamp_type})
    return json.dumps({"type": "record", "name": family, "fields": fields})


TEMPERATURE_SCHEMA = json.dumps(
    {
        "type": "record",
        "name": "SensorData",
        "fields": [
            {"name": "source_timestamp", "type": "long"},
            {"name": "temperature", "type": "double"},
        ],
    }
)

# Schema of the records a topic delivers.
TOPIC_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
    "timestampType int, headers array<struct<key: string, value: binary>>"
)


def avro_to_struct(schema_json: str) -> T.StructType:
    """Flat Avro record schema as a StructType; all fields nullable, other types rejected."""
    fields = []
    for f in json.loads(schema_json)["fields"]:
        kind = f["type"]
        if not isinstance(kind, str) or kind not in AVRO_TYPES:
            raise ValueError(f"unsupported field type: {kind}")
        fields.append(T.StructField(f["name"], AVRO_TYPES[kind], True))
    return T.StructType(fields)


def widen_floats(schema_json: str) -> str:
    """The same schema with every float field as double."""
    schema = json.loads(schema_json)
    for f in schema["fields"]:
        if f["type"] == "float":
            f["type"] = "double"
    return json.dumps(schema)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Rows in the shape of `schema`: missing fields from `defaults`, values cast.

    A missing field without default, or a type that cannot be cast, is an error.
    """
    defaults = defaults or {}
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in defaults]
    if missing:
        raise ValueError(f"missing fields without default: {', '.join(missing)}")
    cols = []
    for f in schema:
        c = F.col(f.name) if f.name in df.columns else F.lit(defaults[f.name])
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols).to(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def select_family(df: DataFrame, family: str) -> DataFrame:
    """The columns of one data type."""
    if family not in FAMILIES:
        raise ValueError(f"invalid data type: {family}")
    return df.select(*FAMILIES[family])
