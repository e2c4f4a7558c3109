"""Epsilon removal and synchronization."""

from __future__ import annotations

from itertools import count

from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..plans.model import ARC, EPSILON, STATE, Fst
from ..plans.storage import Rounds, store, store_counted
from .distance import ASK, DELTA
from .rational import arc_sum


def remove_epsilons(fst: Fst, max_rounds: int | None = None, delta: float = DELTA) -> Fst:
    """The same weighted relation without arcs whose labels are both epsilon; states stay.

    The closure (state, target, weight) over epsilon arcs is a distance problem with one source for each state that has
    an epsilon arc; its rows then take over arcs and final weights. Machines without such arcs are not touched."""
    s = fst.semiring
    silent = (F.col("ilabel") == EPSILON) & (F.col("olabel") == EPSILON)
    eps = store(fst.arcs.where(silent).select("fst_id", "src", "dst", "weight"), "silent")
    if eps.isEmpty():
        return fst
    # Sources are part of the key: (fst_id, source) is the machine, target the state.
    heads = eps.select("fst_id", F.col("src").alias("source")).distinct()
    seeds = heads.select(F.struct("fst_id", "source").alias("fst_id"), F.col("source").alias("state"), s.cast(s.one).alias("weight"))
    closure = _closure(seeds, eps, fst, max_rounds, delta)
    loud = fst.arcs.where(~silent)
    moved = closure.join(loud.withColumnRenamed("src", "target"), ["fst_id", "target"]).select("fst_id", F.col("source").alias("src"), "pos", "ilabel", "olabel", s.cast(s.times(F.col("c"), F.col("weight"))).alias("weight"), "dst")
    kept = loud.join(heads.withColumnRenamed("source", "src"), ["fst_id", "src"], "left_anti")
    fin = closure.join(fst.finals.withColumnRenamed("state", "target"), ["fst_id", "target"]).groupBy("fst_id", F.col("source").alias("state")).agg(s.plus_agg(s.times(F.col("c"), F.col("final_weight"))).alias("f"))
    states = fst.states.join(fin, ["fst_id", "state"], "left").select("fst_id", "state", "is_start", s.cast(F.coalesce("f", "final_weight")).alias("final_weight"))
    out = fst.with_(arcs=kept.select(*ARC).unionByName(moved.select(*ARC)), states=states)
    return arc_sum(out)


def _closure(seeds, eps, fst: Fst, max_rounds: int | None, delta: float):
    """fst_id, source, target, c: sums over all silent paths."""
    s = fst.semiring
    known, found = store_counted(seeds.withColumns({"residual": F.col("weight"), "live": F.lit(True)}), "closure", live=F.col("live"))
    limit = max_rounds
    for turn in count():
        if limit is None and turn == ASK:
            limit = max(ASK, fst.states.count() + 1)
        if turn == limit:
            raise AlgorithmError(f"the closure did not converge within {limit} rounds")
        front = known.where("live").select(F.col("fst_id").alias("k"), F.col("fst_id.fst_id").alias("fst_id"), F.col("state").alias("src"), "residual")
        if not found["live"]:
            return known.select(F.col("fst_id.fst_id").alias("fst_id"), F.col("fst_id.source").alias("source"), F.col("state").alias("target"), F.col("weight").alias("c"))
        step = front.join(eps, ["fst_id", "src"]).groupBy(F.col("k").alias("fst_id"), F.col("dst").alias("state")).agg(s.plus_agg(s.times(F.col("residual"), F.col("weight"))).alias("m")).withColumn("m", s.cast(F.col("m")))
        both = known.select("fst_id", "state", "weight").join(step, ["fst_id", "state"], "full")
        new = F.when(F.col("weight").isNull(), F.col("m")).when(F.col("m").isNull(), F.col("weight")).otherwise(s.cast(s.plus(F.col("weight"), F.col("m"))))
        changed = F.col("m").isNotNull() & (F.col("weight").isNull() | ~new.eqNullSafe(F.col("weight")))
        if not s.idempotent and s.size is not None and s.type == "double":
            changed = F.col("m").isNotNull() & (F.col("weight").isNull() | (F.abs(new - F.col("weight")) > delta))
        known, found = store_counted(both.select("fst_id", "state", new.alias("weight"), (new if s.idempotent else F.col("m")).alias("residual"), F.coalesce(changed, F.lit(False)).alias("live")), "closure", live=F.col("live"))


def synchronize(fst: Fst, max_delay: int | None = None) -> Fst:
    """The same relation with inputs and outputs as close together as they can be: each arc reads one label of both
    sides until one side ends, and what is left is written behind the finals.

    States are (state, labels read but not answered, labels written ahead); one of both arrays is empty. A machine with
    unbounded delay is an error."""
    s = fst.semiring
    if fst.starts.isEmpty():
        raise AlgorithmError("no start state")
    none = F.array().cast("array<bigint>")
    key = lambda q, x, y: F.struct(q.alias("q"), x.alias("x"), y.alias("y"))
    first = lambda a: F.when(F.size(a) > 0, F.get(a, 0)).otherwise(F.lit(0).cast("bigint"))
    rest = lambda a: F.when(F.size(a) > 0, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    arcs = store(fst.arcs, "edges")
    fst = fst.with_(states=store(fst.states.select(*STATE), "states"))
    end = fst.states.select("fst_id", F.col("state").alias("q"), "final_weight")
    seen, made = Rounds(fst.spark, "sync"), Rounds(fst.spark, "sync-arcs")
    start = fst.starts.select("fst_id", key(F.col("state"), none, none).alias("state"))
    front = seen.add(start)
    # A delay beyond the number of states has passed some state with two different delays: it grows without bound.
    most = max_delay if max_delay is not None else fst.states.count()
    while True:
        here = front.select("fst_id", F.col("state").alias("src0"), "state.q", "state.x", "state.y")
        j = here.where("q is not null").join(arcs.withColumnRenamed("src", "q"), ["fst_id", "q"])
        x = F.when(F.col("ilabel") == 0, F.col("x")).otherwise(F.array_append("x", F.col("ilabel")))
        y = F.when(F.col("olabel") == 0, F.col("y")).otherwise(F.array_append("y", F.col("olabel")))
        j = j.withColumns({"x2": x, "y2": y}).withColumn("both", (F.size("x2") > 0) & (F.size("y2") > 0))
        take = lambda a: F.when(F.col("both"), first(F.col(a))).otherwise(F.lit(0).cast("bigint"))
        left = lambda a: F.when(F.col("both"), rest(F.col(a))).otherwise(F.col(a))
        go = j.select("fst_id", F.col("src0").alias("src"), "pos", take("x2").alias("ilabel"), take("y2").alias("olabel"), "weight", key(F.col("dst"), left("x2"), left("y2")).alias("dst"))
        # At a final, or in the tail behind one (q null), what is left is written out.
        tail = here.join(end, ["fst_id", "q"], "left").where("(q is null or final_weight is not null) and size(x) + size(y) > 0")
        w = F.when(F.col("q").isNull(), s.cast(s.one)).otherwise(F.col("final_weight"))
        write = tail.select("fst_id", F.col("src0").alias("src"), F.lit(1 << 40).cast("bigint").alias("pos"), first(F.col("x")).alias("ilabel"), first(F.col("y")).alias("olabel"), w.alias("weight"), key(F.lit(None).cast(fst.states.schema["state"].dataType), rest(F.col("x")), rest(F.col("y"))).alias("dst"))
        out = made.add(go.unionByName(write), late=F.size("dst.x") + F.size("dst.y") > most)
        if made.found["late"]:
            raise AlgorithmError(f"a delay of more than {most} labels")
        new = out.select("fst_id", F.col("dst").alias("state")).distinct()
        old = seen.rows().select(F.col("fst_id").alias("f"), F.col("state").alias("s"))
        front = seen.add(new.join(old, F.expr("fst_id <=> f and state <=> s"), "left_anti"))
        if not seen.last:
            break
    every = seen.rows().select("fst_id", "state", "state.q", "state.x", "state.y").join(end, ["fst_id", "q"], "left")
    final = F.when(F.size("x") + F.size("y") > 0, F.lit(None).cast(s.type)).when(F.col("q").isNull(), s.cast(s.one)).otherwise(F.col("final_weight"))
    states = every.join(start.withColumn("first", F.lit(True)), ["fst_id", "state"], "left").select("fst_id", "state", F.coalesce("first", F.lit(False)).alias("is_start"), final.alias("final_weight"))
    from ..plans.model import renumber

    named = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    plain = Fst(made.rows().select("fst_id", named(F.col("src")).alias("src"), "pos", "ilabel", "olabel", "weight", named(F.col("dst")).alias("dst")), states.withColumn("state", named(F.col("state"))).select(*STATE), s)
    return renumber(plain).stored("synchronized")
