"""The baseline of sightings as keyed streaming state, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cmdlake.operators.baseline import LEAST_DAYS, LEAST_SIGHTINGS, MOST_PROBABILITY

OUTPUT = "event_id long, host_id string, signature string, seen_before long, lineage_novel boolean, promoted_upto boolean, known_stable boolean"
STATE = "seen long, flags long, promoted boolean, days array<string>, parents array<string>"


def _sight(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, flags, promoted, days, parents = state.get if state.exists else (0, 0, False, [], [])
    days, parents, out = set(days), set(parents), []
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for event, ts, parent, p in zip(rows["event_id"], rows["ts"], rows["parent_process"], rows["probability"], strict=True):
        novel, stable = parent not in parents, promoted
        parents.add(parent)
        if len(days) < LEAST_DAYS:
            days.add(ts.strftime("%Y-%m-%d"))
        flags += p >= MOST_PROBABILITY
        promoted = seen + 1 >= LEAST_SIGHTINGS and len(days) >= LEAST_DAYS and flags == 0
        out.append((event, *key, seen, novel, promoted, stable and not novel))
        seen += 1
    state.update((int(seen), int(flags), bool(promoted), sorted(days), sorted(parents)))
    yield pd.DataFrame(out, columns=["event_id", "host_id", "signature", "seen_before", "lineage_novel", "promoted_upto", "known_stable"])


def evaluated_stream(stream: DataFrame) -> DataFrame:
    """What the host's baseline knew before each arriving row; equals operators.baseline.evaluated on rows that arrive in order."""
    return stream.groupBy("host_id", "signature").applyInPandasWithState(_sight, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
