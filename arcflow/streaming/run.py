"""Running machines over streams: Structured Streaming with the state of a run kept for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidOperation
from ..plans.model import Fst

#: Rules of one machine that a stream can carry to every executor.
MAX_ARCS = 1_000_000


def transition_table(fst: Fst) -> tuple[int, dict, dict]:
    """The start, {(state, label): (next, weight)} and {state: final weight} of one deterministic machine of bounded size."""
    rows = fst.arcs.select("src", "ilabel", F.col("weight").cast("double").alias("w"), "dst").limit(MAX_ARCS + 1).collect()
    if len(rows) > MAX_ARCS:
        raise InvalidOperation(f"a machine for streams has at most {MAX_ARCS} arcs")
    table = {}
    for r in rows:
        if (r["src"], r["ilabel"]) in table:
            raise InvalidOperation("a machine for streams must be deterministic")
        table[r["src"], r["ilabel"]] = (r["dst"], r["w"])
    start = fst.starts.limit(2).collect()
    if len(start) != 1:
        raise InvalidOperation("a machine for streams has one start")
    ends = fst.finals.select("state", F.col("final_weight").cast("double").alias("w")).limit(MAX_ARCS + 1).collect()
    if len(ends) > MAX_ARCS:
        raise InvalidOperation(f"a machine for streams has at most {MAX_ARCS} finals")
    return start[0]["state"], table, {r["state"]: r["w"] for r in ends}


def run_stream(stream: DataFrame, fst: Fst, key: str, label: str, order: str, timeout_ms: int | None = None) -> DataFrame:
    """Each key's labels fed to a deterministic machine, micro-batch after micro-batch.

    Returns (key, state, weight, accepted, dead, n) whenever a key has new rows: its state after them, the sum of the
    weights so far (tropical), whether it stands on a final, and how many labels it has read. A label without an arc
    makes the run dead. Rows of a micro-batch are taken in `order`. With timeout_ms, keys without rows are forgotten."""
    held_table = stream.sparkSession.sparkContext.broadcast(transition_table(fst))
    out = "key string, state bigint, weight double, accepted boolean, dead boolean, n bigint"

    def step(name: tuple, groups: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        start, table, finals = held_table.value
        state, weight, dead, n = held.get if held.exists else (start, 0.0, False, 0)
        rows = pd.concat(list(groups)).sort_values("__order")
        for x in rows["__label"]:
            n += 1
            if not dead:
                move = table.get((state, x))
                dead = move is None
                if move:
                    state, weight = move[0], weight + move[1]
        held.update((state, weight, dead, n))
        if timeout_ms:
            held.setTimeoutDuration(timeout_ms)
        ok = not dead and state in finals
        yield pd.DataFrame({"key": [name[0]], "state": [state], "weight": [weight + (finals[state] if ok else 0.0)], "accepted": [ok], "dead": [dead], "n": [n]})

    kept = "state bigint, weight double, dead boolean, n bigint"
    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    rows = stream.select(F.col(key).cast("string").alias("__key"), F.col(label).cast("bigint").alias("__label"), F.col(order).alias("__order"))
    return rows.groupBy("__key").applyInPandasWithState(step, out, kept, "update", wait)
