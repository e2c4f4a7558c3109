"""Machines that are made while they are walked: a callable tells the arcs of a frontier of states.

Nothing but the states that the starts reach is ever made, so the machine itself may be unbounded in its description.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..functions.semiring import Semiring
from ..plans.model import ARC, Fst
from ..plans.storage import Rounds, store

Step = Callable[[DataFrame], DataFrame]


def rounds(starts: DataFrame, step: Step, max_states: int, max_depth: int | None = None) -> Iterator[tuple[DataFrame, DataFrame, Rounds, Rounds]]:
    """Round by round the new states (fst_id, state) and the arcs that leave them, each written before the next round."""
    spark = starts.sparkSession
    seen, made = Rounds(spark, "lazy-states"), Rounds(spark, "lazy-arcs")
    front = seen.add(starts.select("fst_id", "state").distinct())
    total, depth = seen.last, 0
    while seen.last:
        if total > max_states:
            raise AlgorithmError(f"more than {max_states} states")
        arcs = made.add(step(front).select(*ARC))
        yield front, arcs, seen, made
        depth += 1
        if max_depth is not None and depth > max_depth:
            return
        front = seen.add(arcs.select("fst_id", F.col("dst").alias("state")).distinct().join(seen.rows(), ["fst_id", "state"], "left_anti"))
        total += seen.last


def expand(starts: DataFrame, step: Step, finals: Step, semiring: Semiring, max_states: int = 50_000_000) -> Fst:
    """The machines of the starts (fst_id, state). step: states (fst_id, state) to their arcs; finals: states to those that
    are final, with final_weight. More than max_states states are an error."""
    seen = made = None
    for _, _, seen, made in rounds(starts, step, max_states):
        pass
    if seen is None:
        raise AlgorithmError("no start state")
    states = seen.rows()
    ends = finals(states).select("fst_id", "state", semiring.cast(F.col("final_weight")).alias("final_weight"))
    first = starts.select("fst_id", "state", F.lit(True).alias("is_start")).distinct()
    st = states.join(first, ["fst_id", "state"], "left").join(ends, ["fst_id", "state"], "left")
    return Fst(made.rows(), store(st.select("fst_id", "state", F.coalesce("is_start", F.lit(False)).alias("is_start"), "final_weight"), "states"), semiring)


def stream(starts: DataFrame, step: Step, max_states: int = 50_000_000, max_depth: int | None = None) -> Iterator[DataFrame]:
    """The arcs of one round after another, for callers that stop on their own; max_depth ends it after so many arcs."""
    for _, arcs, _, _ in rounds(starts, step, max_states, max_depth):
        yield arcs
