"""Reachability and distances: loops that move only what changed."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..plans.model import ARC, STATE, Fst
from ..plans import small
from ..plans.scalar import SCALARS
from ..plans.small import by_machine, divide, reach
from ..plans.storage import Rounds, fresh_path, remove, store, store_counted

#: Rounds after which a loop asks whether there are more states than rounds: no path without a cycle is longer.
ASK = 1000
DELTA = 1e-9


def turned(fst: Fst) -> DataFrame:
    """The arcs from their ends."""
    return fst.arcs.withColumns({"src": F.col("dst"), "dst": F.col("src")}).select(*ARC)


def spread(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """(fst_id, state): all that arcs (fst_id, src, dst) reach from the seeds, themselves included.

    Small machines are walked each in a task; large ones round by round over the cluster."""
    kind, large = divide(arcs, seeds)
    if kind is None:
        return _spread(seeds, arcs)
    bare = seeds.select(F.col("fst_id").cast("bigint").alias("fst_id"), F.lit(None).cast(kind).alias("src"), F.col("state").alias("dst"))
    rows = arcs.select(F.col("fst_id").cast("bigint").alias("fst_id"), "src", "dst").unionByName(bare)
    if large is None:
        return by_machine(rows, reach, f"state {kind}", "reach")
    few = by_machine(rows.join(large, "fst_id", "left_anti"), reach, f"state {kind}", "reach")
    return store(few.unionByName(_spread(seeds.join(large, "fst_id", "left_semi"), arcs.join(large, "fst_id", "left_semi"))), "reach")


def _spread(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    rounds = Rounds(seeds.sparkSession, "reach")
    edges = store(arcs.select("fst_id", "src", "dst").where(~F.col("src").eqNullSafe(F.col("dst"))).distinct(), "edges")
    front = rounds.add(seeds.select("fst_id", "state").distinct())
    while rounds.last:
        seen = rounds.rows()
        step = front.withColumnRenamed("state", "src").join(edges, ["fst_id", "src"]).select("fst_id", F.col("dst").alias("state")).distinct()
        front = rounds.add(step.join(seen, ["fst_id", "state"], "left_anti"))
    return rounds.rows()


def accessible(fst: Fst) -> DataFrame:
    return spread(fst.starts, fst.arcs)


def coaccessible(fst: Fst) -> DataFrame:
    return spread(fst.finals, turned(fst))


def restrict(fst: Fst, states: DataFrame) -> Fst:
    """The part of the machines on some states."""
    keep = states.select("fst_id", "state").distinct()
    arcs = fst.arcs.join(keep.withColumnRenamed("state", "src"), ["fst_id", "src"], "left_semi").join(keep.withColumnRenamed("state", "dst"), ["fst_id", "dst"], "left_semi")
    return fst.with_(arcs=arcs.select(*ARC), states=fst.states.join(keep, ["fst_id", "state"], "left_semi").select(*STATE))


def connect(fst: Fst) -> Fst:
    """Only states on a path from a start to a final. A collection without any start is an error."""
    if fst.starts.isEmpty():
        raise AlgorithmError("no start state")
    return restrict(fst, accessible(fst).join(coaccessible(fst), ["fst_id", "state"], "left_semi"))


def distances(seeds: DataFrame, arcs: DataFrame, fst: Fst, max_rounds: int | None = None, delta: float = DELTA, reverse: bool = False) -> DataFrame:
    """(fst_id, state, weight): the sum over all paths from the seeds (fst_id, state, weight).

    Small machines take one pass each in a task, in topological order where there is no cycle. Large ones, and compound
    weights, take rounds that move the residuals of the states that changed. With an idempotent sum a state changes when
    its weight does; otherwise a residual is passed on until it is no larger than delta, so no path is counted twice.
    Rounds end by themselves without cycles; max_rounds (else as many as there are states, and 1000) stops cycles
    whose sums do not converge."""
    s = fst.semiring
    kind, large = divide(arcs, seeds)
    if kind is None or s.name not in SCALARS:
        return _distances(seeds, arcs, fst, max_rounds, delta, reverse)
    end = lambda df, src, dst, w: df.select(F.col("fst_id").cast("bigint").alias("fst_id"), src.cast(kind).alias("src"), dst.alias("dst"), w.alias("w"))
    rows = end(arcs, F.col("src"), F.col("dst"), s.cast(F.col("weight"))).unionByName(end(seeds, F.lit(None), F.col("state"), s.cast(F.col("weight"))))
    walk = small.distances(SCALARS[s.name], max_rounds, delta)
    schema = f"state {kind}, weight {s.type}"
    if large is None:
        return by_machine(rows, walk, schema, "dist")
    few = by_machine(rows.join(large, "fst_id", "left_anti"), walk, schema, "dist")
    return few.unionByName(_distances(seeds.join(large, "fst_id", "left_semi"), arcs.join(large, "fst_id", "left_semi"), fst, max_rounds, delta, reverse))


def _distances(seeds: DataFrame, arcs: DataFrame, fst: Fst, max_rounds: int | None, delta: float, reverse: bool) -> DataFrame:
    s = fst.semiring
    spark = seeds.sparkSession
    edges = store(arcs.select("fst_id", "src", "dst", F.col("weight").alias("w")), "edges")
    path = fresh_path(spark, "dist")
    known, found = store_counted(seeds.groupBy("fst_id", "state").agg(s.plus_agg(F.col("weight")).alias("weight")).withColumn("weight", s.cast(F.col("weight"))).withColumns({"residual": F.col("weight"), "live": F.lit(True)}), path=path, live=F.col("live"))
    limit = max_rounds
    for turn in count():
        if not found["live"]:
            return known.select("fst_id", "state", "weight")
        if limit is None and turn == ASK:
            limit = max(ASK, fst.states.count() + 1)
        if turn == limit:
            raise AlgorithmError(f"distances did not converge within {limit} rounds")
        front = known.where("live").select("fst_id", F.col("state").alias("src"), "residual")
        product = s.times(F.col("w"), F.col("residual")) if reverse else s.times(F.col("residual"), F.col("w"))
        step = front.join(edges, ["fst_id", "src"]).select("fst_id", F.col("dst").alias("state"), product.alias("m"))
        step = step.groupBy("fst_id", "state").agg(s.plus_agg(F.col("m")).alias("m")).withColumn("m", s.cast(F.col("m"))).where(~s.is_zero(F.col("m")))
        both = known.select("fst_id", "state", "weight").join(step, ["fst_id", "state"], "full")
        new = F.when(F.col("weight").isNull(), F.col("m")).when(F.col("m").isNull(), F.col("weight")).otherwise(s.cast(s.plus(F.col("weight"), F.col("m"))))
        if s.idempotent:
            live = F.col("m").isNotNull() & (F.col("weight").isNull() | ~new.eqNullSafe(F.col("weight")))
            residual = new
        else:
            live = F.col("m").isNotNull() & ((F.abs(F.col("m").cast("double")) > delta) if s.name in ("probability", "real") else (new - F.col("weight") != 0) | F.col("weight").isNull() if s.name == "integer" else (F.col("weight").isNull() | (F.abs((new - F.col("weight")).cast("double")) > delta)) if s.size else F.lit(True))
            residual = F.col("m")
        new_path = fresh_path(spark, "dist")
        known, found = store_counted(both.select("fst_id", "state", new.alias("weight"), residual.alias("residual"), F.coalesce(live, F.lit(False)).alias("live")), path=new_path, live=F.col("live"))
        remove(spark, path)
        path = new_path


def shortest_distance(fst: Fst, max_rounds: int | None = None, delta: float = DELTA) -> DataFrame:
    """(fst_id, state, weight) from the start to every state, final weights left out; unreachable states have zero."""
    if fst.starts.isEmpty():
        raise AlgorithmError("no start state")
    s = fst.semiring
    found = distances(fst.starts.withColumn("weight", s.cast(s.one)), fst.arcs, fst, max_rounds, delta)
    return fst.states.select("fst_id", "state").join(found, ["fst_id", "state"], "left").select("fst_id", "state", F.coalesce("weight", s.cast(s.zero)).alias("weight"))


def distance_to_final(fst: Fst, max_rounds: int | None = None, delta: float = DELTA) -> DataFrame:
    """(fst_id, state, weight): the sum over all paths to a final, its weight included; only of states that reach one."""
    return distances(fst.finals.withColumnRenamed("final_weight", "weight"), turned(fst), fst, max_rounds, delta, reverse=True)


def total_weight(fst: Fst) -> DataFrame:
    """(fst_id, weight): the sum over all accepted paths."""
    s = fst.semiring
    j = shortest_distance(fst).join(fst.finals, ["fst_id", "state"])
    return j.groupBy("fst_id").agg(s.plus_agg(s.times(F.col("weight"), F.col("final_weight"))).alias("weight"))


# -- paths ---------------------------------------------------------------------------------------
def shortest_path(fst: Fst, k: int | None = 1, unique: bool = False) -> DataFrame:
    """The k best loopless paths of each machine (None: all): fst_id, rank, weight, ilabels, olabels, states (with epsilons).

    Small machines are searched best-first, each in a task. Over the cluster, beginnings of paths are extended round by round, and one is given up when even its best completion (the distance to
    a final) is worse than the k-th best complete path found: exact, since no completion can be better. unique: of paths
    with equal labels only the best. Ties are broken by labels, then states."""
    s = fst.semiring
    order = s.need("order")
    if fst.starts.isEmpty():
        raise AlgorithmError("no start state")
    if k is not None and k <= 0:
        return fst.states.select("fst_id", F.lit(0).alias("rank"), "final_weight", F.array().cast("array<bigint>").alias("ilabels"), F.array().cast("array<bigint>").alias("olabels"), F.array("state").alias("states")).withColumnRenamed("final_weight", "weight").limit(0)
    fst = fst.with_(states=store(fst.states.select(*STATE), "states"))
    kind, large = divide(fst.arcs, fst.states)
    if kind is None or s.name not in SCALARS:
        return _shortest_path(fst, k, unique)
    end = lambda df, name, src, dst, w, i=F.lit(None), o=F.lit(None): df.select(F.col("fst_id").cast("bigint").alias("fst_id"), F.lit(name).alias("kind"), src.cast(kind).alias("src"), F.col(dst).alias("dst"), i.cast("bigint").alias("ilabel"), o.cast("bigint").alias("olabel"), s.cast(w).alias("w"))
    rows = end(fst.arcs, "arc", F.col("src"), "dst", F.col("weight"), F.col("ilabel"), F.col("olabel")).unionByName(end(fst.starts, "start", F.lit(None), "state", s.one)).unionByName(end(fst.finals, "final", F.lit(None), "state", F.col("final_weight")))
    walk, schema = small.best_paths(SCALARS[s.name], k, unique), f"rank int, weight {s.type}, ilabels array<bigint>, olabels array<bigint>, states array<{kind}>"
    if large is None:
        return by_machine(rows, walk, schema, "paths")
    few = by_machine(rows.join(large, "fst_id", "left_anti"), walk, schema, "paths")
    big = fst.with_(arcs=fst.arcs.join(large, "fst_id", "left_semi"), states=fst.states.join(large, "fst_id", "left_semi"))
    return few.unionByName(_shortest_path(big, k, unique))


def _shortest_path(fst: Fst, k: int | None, unique: bool) -> DataFrame:
    s = fst.semiring
    order = s.order
    useful = store(distance_to_final(fst).withColumnRenamed("weight", "rest"), "rest")
    arcs = store(fst.arcs.join(useful.select("fst_id", F.col("state").alias("dst"), "rest"), ["fst_id", "dst"]).select("fst_id", "src", "dst", "ilabel", "olabel", F.col("weight").alias("w"), "rest"), "edges")
    none = F.array().cast("array<bigint>")
    front = fst.starts.join(useful, ["fst_id", "state"], "left_semi").select("fst_id", "state", s.cast(s.one).alias("weight"), none.alias("ilabels"), none.alias("olabels"), F.array("state").alias("states"))
    front = store(front, "paths")
    best = None
    labels = ["ilabels", "olabels"]
    rank = Window.partitionBy("fst_id").orderBy(order(F.col("weight")), "ilabels", "olabels", "states")
    while True:  # a loopless path has no more arcs than there are states
        done = front.join(fst.finals, ["fst_id", "state"]).select("fst_id", s.cast(s.times(F.col("weight"), F.col("final_weight"))).alias("weight"), *labels, "states")
        every = done if best is None else best.unionByName(done)
        if unique:
            first = Window.partitionBy("fst_id", *labels).orderBy(order(F.col("weight")), "states")
            every = every.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        if k is None:
            best, front, found = store(every, "best"), *_extend(front, arcs, s)
            if not found["n"]:
                return best.withColumn("rank", F.row_number().over(rank))
            continue
        best = store(every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank"), "best")
        bound = best.groupBy("fst_id").agg(F.count("*").alias("__n"), F.max(order(F.col("weight"))).alias("__worst"))
        front, found = _extend(front, arcs, s, bound, k)
        if not found["n"]:
            return best.withColumn("rank", F.row_number().over(rank))


def _extend(front: DataFrame, arcs: DataFrame, s, bound: DataFrame | None = None, k: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """The beginnings with one arc more; with a bound (__n paths so far, the __worst of them) only the promising ones."""
    step = front.withColumnRenamed("state", "src").join(arcs, ["fst_id", "src"]).where(~F.array_contains("states", F.col("dst")))
    if bound is not None:
        total = s.cast(s.times(s.times(F.col("weight"), F.col("w")), F.col("rest")))
        step = step.join(bound, "fst_id", "left").where((F.coalesce("__n", F.lit(0)) < k) | (s.order(total) <= F.col("__worst")))
    return store_counted(step.select("fst_id", F.col("dst").alias("state"), s.cast(s.times(F.col("weight"), F.col("w"))).alias("weight"), F.array_append("ilabels", F.col("ilabel")).alias("ilabels"), F.array_append("olabels", F.col("olabel")).alias("olabels"), F.array_append("states", F.col("dst")).alias("states")), "paths")


def best_path(fst: Fst) -> DataFrame:
    return shortest_path(fst, 1)


def paths_to_fst(paths: DataFrame, fst: Fst) -> Fst:
    """The machine of a relation of paths: a common start, and a chain of its own for each path."""
    s = fst.semiring
    steps = paths.select("fst_id", "rank", "weight", F.posexplode(F.arrays_zip("ilabels", "olabels")).alias("at", "x"))
    name = lambda at: F.when(at == 0, F.lit("start")).otherwise(F.concat_ws("/", F.col("rank").cast("string"), at.cast("string")))
    arcs = steps.select("fst_id", name(F.col("at")).alias("src"), F.col("rank").cast("bigint").alias("pos"), F.col("x.ilabels").alias("ilabel"), F.col("x.olabels").alias("olabel"), F.when(F.col("at") == 0, F.col("weight")).otherwise(s.cast(s.one)).alias("weight"), name(F.col("at") + 1).alias("dst"))
    from ..plans.model import from_edges, renumber

    finals = paths.groupBy("fst_id", name(F.size("ilabels")).alias("state")).agg(s.plus_agg(F.when(F.size("ilabels") == 0, F.col("weight")).otherwise(s.cast(s.one))).alias("final_weight"))
    return renumber(from_edges(arcs, paths.select("fst_id", F.lit("start").alias("state")).distinct(), finals, s))


def random_paths(fst: Fst, n: int = 1, seed: int = 0, max_length: int = 100, weighted: bool = False) -> DataFrame:
    """n random accepted paths of each machine: fst_id, path, ilabels, olabels, states.

    Steps are uniform, or in proportion to exp(-weight) of the tropical and log semirings and to the weight of the
    others; stopping at a final is one more choice, of weight one. Paths cut off by max_length are dropped. The same
    seed gives the same paths."""
    s = fst.semiring
    fst = fst.with_(states=store(fst.states.select(*STATE), "states"))
    arcs = store(restrict(fst, coaccessible(fst)).arcs, "edges")
    chance = (F.exp(-F.col("weight").cast("double")) if s.name in ("tropical", "log", "min") else F.greatest(F.col("weight").cast("double"), F.lit(0.0))) if weighted else F.lit(1.0)
    none = F.array().cast("array<bigint>")
    front = fst.starts.select("fst_id", "state", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n > 0 else F.array().cast("array<bigint>")).alias("path")).select("fst_id", "path", "state", none.alias("ilabels"), none.alias("olabels"), F.array("state").alias("states"))
    draw = lambda i, c: -F.ln((F.abs(F.xxhash64("fst_id", "path", *c)) % (1 << 52) + 1) / float((1 << 52) + 1))
    out = Rounds(fst.spark, "random")
    front = store(front, "random")
    for i in range(max_length + 1):
        stop = front.join(fst.finals.select("fst_id", "state"), ["fst_id", "state"]).select("fst_id", "path", "ilabels", "olabels", "states", F.lit(None).cast("bigint").alias("il"), F.lit(None).cast("bigint").alias("ol"), F.col("state").alias("to"), F.lit(True).alias("stop"), F.lit(1.0).alias("c"), F.lit(-1).cast("bigint").alias("pos"))
        a = arcs.withColumn("c", chance).withColumnRenamed("src", "state")
        go = front.join(a, ["fst_id", "state"]).select("fst_id", "path", "ilabels", "olabels", "states", F.col("ilabel").alias("il"), F.col("olabel").alias("ol"), F.col("dst").alias("to"), F.lit(False).alias("stop"), "c", "pos")
        every = go.unionByName(stop).where("c > 0")
        key = draw(i, [F.lit(seed), F.lit(i), F.col("to"), F.col("il"), F.col("ol"), F.col("pos"), F.col("stop")]) / F.col("c")
        pick = every.groupBy("fst_id", "path").agg(F.min_by(F.struct("ilabels", "olabels", "states", "il", "ol", "to", "stop"), key).alias("x")).select("fst_id", "path", "x.*")
        pick = store(pick, "random")
        out.add(pick.where("stop").select("fst_id", "path", "ilabels", "olabels", "states"))
        front, found = store_counted(pick.where("not stop").select("fst_id", "path", F.col("to").alias("state"), F.array_append("ilabels", F.col("il")).alias("ilabels"), F.array_append("olabels", F.col("ol")).alias("olabels"), F.array_append("states", F.col("to")).alias("states")), "random")
        if not found["n"]:
            break
    return out.rows()


# -- pruning and pushing -------------------------------------------------------------------------
def prune(fst: Fst, threshold: float | None = None, beam: bool = False, npath: int | None = None) -> Fst:
    """Arcs, finals and states on some path that is good enough.

    threshold: the best path through it weighs no more (with beam: no more than the threshold times the best path of
    its machine). npath: it lies on one of the n best loopless paths."""
    s = fst.semiring
    order = s.need("order")
    if npath is not None:
        paths = shortest_path(fst, npath) if not fst.starts.isEmpty() else None
        if paths is None or npath <= 0:
            return fst.with_(arcs=fst.arcs.limit(0), states=fst.states.limit(0))
        hops = paths.select("fst_id", F.explode(F.expr("transform(sequence(1, greatest(size(ilabels), 1)), i -> struct(states[i - 1] as src, ilabels[i - 1] as il, olabels[i - 1] as ol, states[i] as dst))")).alias("h")).select("fst_id", "h.*").distinct()
        on = paths.select("fst_id", F.explode("states").alias("state")).distinct()
        arcs = fst.arcs.join(hops.withColumnsRenamed({"il": "ilabel", "ol": "olabel"}), ["fst_id", "src", "dst", "ilabel", "olabel"], "left_semi").select(*ARC)
        return fst.with_(arcs=arcs, states=fst.states.join(on, ["fst_id", "state"], "left_semi").select(*STATE))
    if fst.starts.isEmpty():
        return fst.with_(arcs=fst.arcs.limit(0), states=fst.states.limit(0))
    fst = fst.with_(states=store(fst.states.select(*STATE), "states"))
    d = store(distances(fst.starts.withColumn("weight", s.cast(s.one)), fst.arcs, fst).withColumnRenamed("weight", "d"), "d")
    b = store(distance_to_final(fst).withColumnRenamed("weight", "b"), "b")
    limit = s.cast(F.lit(threshold))
    through = d.join(b, ["fst_id", "state"]).select("fst_id", "state", "d", "b", s.cast(s.times(F.col("d"), F.col("b"))).alias("t"))
    if beam:
        best = fst.starts.join(b, ["fst_id", "state"]).groupBy("fst_id").agg(s.plus_agg(F.col("b")).alias("best"))
        through = through.join(best, "fst_id").withColumn("limit", s.cast(s.times(F.col("best"), limit)))
    else:
        through = through.withColumn("limit", limit)
    keep = store(through.where(order(F.col("t")) <= order(F.col("limit"))), "keep")
    states = fst.states.join(keep.select("fst_id", "state", "d", "limit"), ["fst_id", "state"])
    good = order(s.cast(s.times(F.col("d"), F.col("final_weight")))) <= order(F.col("limit"))
    states = states.withColumn("final_weight", F.when(good, F.col("final_weight"))).select(*STATE)
    arcs = fst.arcs.join(keep.select("fst_id", F.col("state").alias("src"), "d", "limit"), ["fst_id", "src"]).join(keep.select("fst_id", F.col("state").alias("dst"), "b"), ["fst_id", "dst"])
    arcs = arcs.where(order(s.cast(s.times(s.times(F.col("d"), F.col("weight")), F.col("b")))) <= order(F.col("limit"))).select(*ARC)
    return fst.with_(arcs=arcs, states=states)


def push_weights(fst: Fst, to: str = "initial", remove_total: bool = False) -> Fst:
    """Weights moved as near as possible to the start (or the finals); the weight of every path stays the same.

    To initial, the potentials are distances to the finals, and what is left over multiplies the arcs of the start,
    or the finals where a cycle passes through the start (remove_total leaves it out). To final, they are distances from the start."""
    from .rational import reweight

    s = fst.semiring
    if fst.starts.isEmpty():
        return fst
    if to == "final":
        v = distances(fst.starts.withColumn("weight", s.cast(s.one)), fst.arcs, fst).withColumnRenamed("weight", "potential")
        return reweight(restrict(fst, v), v, "final")
    v = store(distance_to_final(fst).withColumnRenamed("weight", "potential"), "potential")
    pushed = reweight(restrict(fst, v), v, "initial")
    if remove_total:
        return pushed
    first = fst.starts.join(v, ["fst_id", "state"])
    if not s.commutative:
        arcs = pushed.arcs.join(first.select("fst_id", F.col("state").alias("src"), "potential"), ["fst_id", "src"], "left")
        arcs = arcs.withColumn("weight", F.when(F.col("potential").isNotNull(), s.cast(s.times(F.col("potential"), F.col("weight")))).otherwise(F.col("weight"))).select(*ARC)
        states = pushed.states.join(v, ["fst_id", "state"], "left")
        states = states.withColumn("final_weight", F.when(F.col("is_start") & F.col("final_weight").isNotNull(), s.cast(s.times(F.col("potential"), F.col("final_weight")))).otherwise(F.col("final_weight"))).select(*STATE)
        loops = store(fst.arcs.join(first.select("fst_id", F.col("state").alias("dst")), ["fst_id", "dst"], "left_semi").select("fst_id").distinct(), "loops")
        old_a, old_s = fst.arcs.join(loops, "fst_id", "left_semi").select(*ARC), fst.states.join(loops, "fst_id", "left_semi").select(*STATE)
        return fst.with_(arcs=arcs.join(loops, "fst_id", "left_anti").unionByName(old_a), states=states.join(loops, "fst_id", "left_anti").unionByName(old_s))
    # A cycle through the start would take the total more than once: there the finals take it.
    loops = store(fst.arcs.join(first.select("fst_id", F.col("state").alias("dst")), ["fst_id", "dst"], "left_semi").select("fst_id").distinct(), "loops")
    once = first.join(loops, "fst_id", "left_anti")
    arcs = pushed.arcs.join(once.select("fst_id", F.col("state").alias("src"), "potential"), ["fst_id", "src"], "left")
    arcs = arcs.withColumn("weight", F.when(F.col("potential").isNotNull(), s.cast(s.times(F.col("potential"), F.col("weight")))).otherwise(F.col("weight"))).select(*ARC)
    plain = pushed.states.join(loops, "fst_id", "left_anti").join(v, ["fst_id", "state"], "left")
    plain = plain.withColumn("final_weight", F.when(F.col("is_start") & F.col("final_weight").isNotNull(), s.cast(s.times(F.col("potential"), F.col("final_weight")))).otherwise(F.col("final_weight"))).select(*STATE)
    looped = pushed.with_(states=pushed.states.join(loops, "fst_id", "left_semi").select(*STATE))
    return fst.with_(arcs=arcs, states=plain.unionByName(total_at_finals(looped, first).states))


def total_at_finals(fst: Fst, totals: DataFrame) -> Fst:
    """Final weights times the potential (fst_id, potential) of their machine."""
    s = fst.semiring
    states = fst.states.join(totals.select("fst_id", "potential"), "fst_id", "left")
    return fst.with_(states=states.withColumn("final_weight", s.cast(s.times(F.col("final_weight"), F.col("potential")))).select(*STATE))


def push_labels(fst: Fst) -> Fst:
    """Output labels moved towards the start: a state's common first output label is taken by the arcs that lead to it.

    One label a round, as long as some state other than a start or a final has a common first output label and every
    arc into it can take one (its own output is epsilon)."""
    now = fst.stored("push")
    while True:  # every round moves labels nearer to the start
        fixed = now.states.where("is_start or final_weight is not null").select("fst_id", "state")
        out = now.arcs.groupBy("fst_id", F.col("src").alias("state")).agg(F.min("olabel").alias("a"), F.max("olabel").alias("b")).where("a = b and a <> 0")
        into = now.arcs.groupBy("fst_id", F.col("dst").alias("state")).agg(F.max("olabel").alias("m"), F.bool_or(F.col("src").eqNullSafe(F.col("dst"))).alias("self")).where("m = 0 and not self")
        move = out.join(into, ["fst_id", "state"]).join(fixed, ["fst_id", "state"], "left_anti").select("fst_id", "state", F.col("a").alias("label"))
        # Neighbours may not move in the same round.
        busy = now.arcs.join(move.withColumnRenamed("state", "src"), ["fst_id", "src"]).select("fst_id", F.col("dst").alias("state")).distinct()
        move, found = store_counted(move.join(busy, ["fst_id", "state"], "left_anti"), "move")
        if not found["n"]:
            return now
        arcs = now.arcs.join(move.select("fst_id", F.col("state").alias("src"), F.col("label").alias("gone")), ["fst_id", "src"], "left").join(move.select("fst_id", F.col("state").alias("dst"), "label"), ["fst_id", "dst"], "left")
        arcs = arcs.withColumn("olabel", F.when(F.col("label").isNotNull(), F.col("label")).when(F.col("gone").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("olabel"))).select(*ARC)
        now = now.with_(arcs=store(arcs, "push"))
