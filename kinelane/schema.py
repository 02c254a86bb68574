"""Column profiles of recordings and the naming rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES = "series_id"
SEQ = "seq"
LENGTH = "n"

ACC = ["acc_x", "acc_y", "acc_z"]
GYRO = ["gyro_x", "gyro_y", "gyro_z"]
AXES = ACC + GYRO

# The column profiles a recording file may have. An eight-column file fits three of
# them, so the caller names the profile and the header is checked where the profile says so.
PROFILES: dict[str, list[str]] = {
    "P8_RAW": ["timestamp_acc", *ACC, "timestamp_gyro", *GYRO],
    "P8_LABEL": ["timestamp", *ACC, *GYRO, "label"],
    "P9_LABEL": ["index", "timestamp", *ACC, *GYRO, "label"],
    "P8_INDEX": ["index", "timestamp", *ACC, *GYRO],
    "P7": ["timestamp", *ACC, *GYRO],
}
DROPPED = {"index"}
INTEGER = {"timestamp_acc", "timestamp_gyro"}


def column_type(name: str) -> T.DataType:
    if name in INTEGER:
        return T.LongType()
    return T.IntegerType() if name == "label" else T.DoubleType()


def kept_columns(profile: str) -> list[str]:
    return [c for c in PROFILES[profile] if c not in DROPPED]
