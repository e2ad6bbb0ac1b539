"""Beyond batch: frames and states as streams. Every function takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scenewright.operators.state import FINAL, ORDER, PROGRESS


def frame_rates(frames: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """frames: ts (timestamp), run. Frames of each run and window of event time; rows later than late are dropped."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "run").agg(F.count("*").alias("n_frames")).select(
        "run", F.col("w.start").alias("window_start"), "n_frames",
    )


def recordings(frames: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs cut into recordings where no frame comes for gap."""
    return frames.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "run").agg(F.count("*").alias("n_frames")).select(
        "run", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n_frames",
    )


def first_sight(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each frame once, also if it is delivered again within the watermark."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run", "frame_id"])


STATES = "artifact_id string, state string, refused long"


def _step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    order = {a: (b, gate) for (a, _), (b, gate) in zip(ORDER, ORDER[1:], strict=False)}
    state, refused = held.get if held.exists else ("REGISTERED", 0)
    for part in parts:
        for to, gate in part.sort_values("seq")[["to_state", "gate_status"]].itertuples(index=False):
            out = to in ("QUARANTINED", "REJECTED")
            back = state == "QUARANTINED" and to == "REGISTERED"
            onward = order.get(state, (None, None))
            if state not in FINAL and to != state and (out or back or (onward[0] == to and gate in PROGRESS)):
                state = to
            else:
                refused += 1
    held.update((state, int(refused)))
    yield pd.DataFrame({"artifact_id": [key[0]], "state": [state], "refused": [refused]})


def artifact_states(moves: DataFrame) -> DataFrame:
    """moves: artifact_id, seq, to_state, gate_status. The state of each artifact after its moves; those not allowed are counted and change nothing."""
    return moves.groupBy("artifact_id").applyInPandasWithState(_step, STATES, "state string, refused long", "update", GroupStateTimeout.NoTimeout)
