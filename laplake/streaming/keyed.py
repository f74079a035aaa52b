"""Features from keyed state, for laps that arrive in order.

The state of a driver is small: the last lap times, the best one, the last tyre
age, the stint, and the laps per compound. A lap is enriched once, on arrival.
Laps at or before the last lap seen are ignored; ``FeatureStream`` is the way
for feeds with late laps.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from laplake import constants as C
from laplake.operators.features import degradation_columns, pit_window, valid_laps

_IN = ["session_key", "driver_number", "lap_number", "lap_duration", "tyre_compound", "tyre_age_laps"]

_OUT = StructType([
    StructField("session_key", IntegerType()), StructField("driver_number", IntegerType()),
    StructField("lap_number", IntegerType()), StructField("lap_duration", DoubleType()),
    StructField("tyre_compound", StringType()), StructField("tyre_age_laps", IntegerType()),
    StructField("prev_tyre_age", IntegerType()), StructField("is_new_stint", IntegerType()),
    StructField("stint_number", LongType()), StructField("rolling_avg_lap_time", DoubleType()),
    StructField("personal_best", DoubleType()), StructField("lap_delta", DoubleType()),
    StructField("stint_length", LongType()), StructField("stint_start_lap_time", DoubleType()),
])

_STATE = StructType([StructField("carry", StringType())])


def _optional(value):
    return None if pd.isna(value) else value


def _advance(key, frames, state: GroupState):
    carry = json.loads(state.get[0]) if state.exists else {
        "lap": None, "recent": [], "best": None, "age": None, "stint": 0, "start": None, "counts": {}}
    laps = pd.concat(list(frames)).sort_values("lap_number")
    rows = []
    for lap, duration, compound, age in zip(
            laps["lap_number"], laps["lap_duration"], laps["tyre_compound"], laps["tyre_age_laps"]):
        if carry["lap"] is not None and lap <= carry["lap"]:
            continue
        age, compound = _optional(age), _optional(compound)
        age = None if age is None else int(age)
        before = carry["age"]
        fresh = int(age is not None and before is not None and age < before)
        carry["stint"] += fresh
        if fresh or carry["lap"] is None:
            carry["start"] = float(duration)
        carry["recent"] = [*carry["recent"], float(duration)][-C.ROLLING_LAPS:]
        carry["best"] = float(duration) if carry["best"] is None else min(carry["best"], float(duration))
        name = "" if compound is None else compound
        carry["counts"][name] = carry["counts"].get(name, 0) + 1
        rows.append((
            key[0], key[1], int(lap), float(duration), compound, age, before, fresh, carry["stint"],
            sum(carry["recent"]) / len(carry["recent"]), carry["best"], float(duration) - carry["best"],
            age if age is not None else carry["counts"][name], carry["start"]))
        carry["age"], carry["lap"] = age, int(lap)
    state.update((json.dumps(carry),))
    out = pd.DataFrame(rows, columns=_OUT.names)
    for name in ("tyre_age_laps", "prev_tyre_age"):
        out[name] = out[name].astype("Int64")
    yield out


def ordered_features(laps: DataFrame) -> DataFrame:
    """Enriched laps of an ordered stream, in append mode."""
    keyed = valid_laps(laps).select(*_IN).groupBy("session_key", "driver_number")
    sequence = keyed.applyInPandasWithState(
        _advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    return pit_window(degradation_columns(sequence))
