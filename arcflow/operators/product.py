"""Products and normal forms: composition, intersection, difference, determinization, minimization."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AlgorithmError, InvalidOperation
from ..plans import small
from ..plans.model import ARC, EPSILON, STATE, Fst, number_rows, numbered, renumber
from ..plans.scalar import SCALARS
from ..plans.small import KINDS, LOCAL_PAIRS, LOCAL_ROWS, by_machine, compose_rows, divide, machines
from ..plans.storage import Rounds, fresh_path, remove, store
from .distance import connect, distance_to_final, push_weights, total_at_finals

MAX_STATES = 50_000_000


def compose(a: Fst, b: Fst, match: Callable[[Column, Column], Column] | None = None, epsilon: bool = False, max_states: int = MAX_STATES, shared: bool = False) -> Fst:
    """Paths of a whose outputs are inputs of b. States are structs (s1, s2), and f with epsilon moves.

    Machines are paired by fst_id; with shared, every machine of a meets the one machine of b. By default label 0 matches
    only label 0; `epsilon` lets either side move alone on it, by the three-state filter that takes each path once. match
    replaces label equality by a condition on (olabel, ilabel).

    Only states that the starts reach are made. Pairs of small machines are walked each in a task (a small shared machine
    is broadcast). For large ones, each round joins the new states to both arc relations on state and label, so Spark
    chooses a hash or a sort-merge join, and hot labels are split like any skewed key."""
    s = a.semiring
    if s.name != b.semiring.name:
        raise InvalidOperation("both machines need the same semiring")
    if a.starts.isEmpty() or b.starts.isEmpty():
        raise AlgorithmError("no start state")
    left = store(a.arcs.select("fst_id", F.col("src").alias("s1"), F.col("pos").alias("p1"), "ilabel", F.col("olabel").alias("m1"), F.col("weight").alias("w1"), F.col("dst").alias("d1")), "left")
    right = store(b.arcs.select("fst_id", F.col("src").alias("s2"), F.col("pos").alias("p2"), F.col("ilabel").alias("m2"), "olabel", F.col("weight").alias("w2"), F.col("dst").alias("d2")), "right")
    first, second = a.starts.withColumnRenamed("state", "s1"), b.starts.withColumnRenamed("state", "s2")
    if shared:
        right, second = right.drop("fst_id"), second.drop("fst_id")
    plain = all(x.starts.schema["state"].dataType.simpleString() in ("bigint", "string") for x in (a, b)) and a.arcs.schema["fst_id"].dataType.simpleString() in ("bigint", "int")
    if match is not None or not plain:
        arcs, seen = _compose_rounds(left, right, first, second, s, match, epsilon, max_states)
    else:
        n1, n2 = left.groupBy("fst_id").agg(F.count("*").alias("n1")), right.groupBy(*([] if shared else ["fst_id"])).agg(F.count("*").alias("n2"))
        sizes = n1.crossJoin(n2) if shared else n1.join(n2, "fst_id")  # one row on the right
        large = store(sizes.where(f"n1 > {LOCAL_ROWS} or n2 > {LOCAL_ROWS} or n1 * n2 > {LOCAL_PAIRS}").select("fst_id"), "large")
        if large.isEmpty():
            arcs, seen = _compose_small(left, right, first, second, s, epsilon, shared)
        else:
            of = lambda df, how: df.join(large, "fst_id", how) if "fst_id" in df.columns else df
            parts = [_compose_rounds(*(of(x, "left_semi") for x in (left, right, first, second)), s, None, epsilon, max_states)]
            if shared and right.count() > LOCAL_ROWS:
                parts = [_compose_rounds(left, right, first, second, s, None, epsilon, max_states)]
            else:
                parts.append(_compose_small(*(of(x, "left_anti") for x in (left, right, first, second)), s, epsilon, shared))
            arcs, seen = parts[0]
            for x, y in parts[1:]:
                arcs, seen = arcs.unionByName(x), seen.unionByName(y)
    key = [] if shared else ["fst_id"]
    f1, f2 = a.finals.select("fst_id", F.col("state").alias("s1"), F.col("final_weight").alias("w1")), b.finals.select(*key, F.col("state").alias("s2"), F.col("final_weight").alias("w2"))
    start = first.join(second, "fst_id") if not shared else first.crossJoin(second)
    start = start.distinct().withColumn("first", F.lit(True))
    if epsilon:
        start = start.withColumn("f", F.lit(0))
    st = seen.select("fst_id", "state", "state.*").join(f1, ["fst_id", "s1"], "left").join(f2, [*key, "s2"], "left").join(start, ["fst_id", "s1", "s2", *["f"] * epsilon], "left")
    final = F.when(F.col("w1").isNotNull() & F.col("w2").isNotNull(), s.cast(s.times(F.col("w1"), F.col("w2"))))
    states = st.select("fst_id", "state", F.coalesce("first", F.lit(False)).alias("is_start"), final.alias("final_weight"))
    states = store(states.withColumn("final_weight", F.when(~s.is_zero(F.col("final_weight")), F.col("final_weight"))), "states")
    return Fst(arcs, states, s)


def _pair(x: Column, y: Column, f: Column, epsilon: bool) -> Column:
    return F.struct(x.alias("s1"), y.alias("s2"), f.cast("int").alias("f")) if epsilon else F.struct(x.alias("s1"), y.alias("s2"))


def _compose_small(left: DataFrame, right: DataFrame, first: DataFrame, second: DataFrame, s, epsilon: bool, shared: bool) -> tuple[DataFrame, DataFrame]:
    """Arcs and states; each pair of machines is held by one task, and weights stay Arrow columns until Spark multiplies them."""
    arc, start = F.lit(0), F.lit(1)
    l = left.select("fst_id", F.lit(0).alias("side"), arc.alias("kind"), F.col("s1").alias("a"), F.col("d1").alias("b"), F.col("m1").alias("m"), F.col("ilabel").alias("l"), F.col("p1").alias("p"), F.col("w1").alias("w"))
    r = right.select(*[c for c in right.columns if c == "fst_id"], F.lit(1).alias("side"), arc.alias("kind"), F.col("s2").alias("c"), F.col("d2").alias("d"), F.col("m2").alias("m"), F.col("olabel").alias("l"), F.col("p2").alias("p"), F.col("w2").alias("w"))
    l = l.unionByName(first.select("fst_id", F.lit(0).alias("side"), start.alias("kind"), F.col("s1").alias("b")), allowMissingColumns=True)
    r = r.unionByName(second.select(*[c for c in second.columns if c == "fst_id"], F.lit(1).alias("side"), start.alias("kind"), F.col("s2").alias("d")), allowMissingColumns=True)
    kinds = {c: left.schema[c].dataType.simpleString() for c in ("s1", "w1")} | {"s2": right.schema["s2"].dataType.simpleString()}
    rows, other = (l, r) if shared else (l.withColumns({"c": F.lit(None).cast(kinds["s2"]), "d": F.lit(None).cast(kinds["s2"])}).unionByName(r.withColumns({"a": F.lit(None).cast(kinds["s1"]), "b": F.lit(None).cast(kinds["s1"])})), None)
    held = left.sparkSession.sparkContext.broadcast(other.sort("p").toArrow()) if shared else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = lambda t, a, b: t.select(["kind", a, b, "m"]).rename_columns(["kind", "a", "b", "m"])
        for i, table in machines(batches):
            x = table if shared else table.filter(pc.equal(table.column("side"), 0))
            y = held.value if shared else table.filter(pc.equal(table.column("side"), 1))
            x, y = x.sort_by([("p", "ascending")]), y if shared else y.sort_by([("p", "ascending")])
            arcs, states = compose_rows(ends(x, "a", "b"), ends(y, "c", "d"), epsilon)
            n, k = pa.array([v[2] for v in arcs], pa.int64()), pa.array([v[3] for v in arcs], pa.int64())
            zero = lambda t, at: pc.fill_null(t.column("l").combine_chunks().take(at), 0) if len(t) else pa.array([0] * len(at), pa.int64())
            none = pa.nulls(len(states), pa.int64())
            columns = [pa.array([i] * (len(arcs) + len(states)), pa.int64()), pa.array([False] * len(arcs) + [True] * len(states))]
            columns += [pa.array([v[0][j] for v in arcs] + [q[j] for q in states], t) for j, t in enumerate((KINDS[kinds["s1"]], KINDS[kinds["s2"]], pa.int32()))]
            columns += [pa.array([v[1][j] for v in arcs] + [None] * len(states), t) for j, t in enumerate((KINDS[kinds["s1"]], KINDS[kinds["s2"]], pa.int32()))]
            columns += [pa.concat_arrays([pa.array(range(len(arcs)), pa.int64()), none]), pa.concat_arrays([zero(x, n), none]), pa.concat_arrays([zero(y, k), none])]
            columns += [pa.concat_arrays([t.column("w").combine_chunks().take(at) if len(t) else pa.nulls(len(at), t.schema.field("w").type), pa.nulls(len(states), t.schema.field("w").type)]) for t, at in ((x, n), (y, k))]
            yield pa.RecordBatch.from_arrays(columns, ["fst_id", "is_state", "s1", "s2", "f", "d1", "d2", "g", "pos", "ilabel", "olabel", "w1", "w2"])

    schema = f"fst_id bigint, is_state boolean, s1 {kinds['s1']}, s2 {kinds['s2']}, f int, d1 {kinds['s1']}, d2 {kinds['s2']}, g int, pos bigint, ilabel bigint, olabel bigint, w1 {kinds['w1']}, w2 {kinds['w1']}"
    found = store(rows.withColumn("fst_id", F.col("fst_id").cast("bigint")).repartition("fst_id").sortWithinPartitions("fst_id").mapInArrow(run, schema), "composed")
    w = F.when(F.col("w1").isNull(), F.col("w2")).when(F.col("w2").isNull(), F.col("w1")).otherwise(s.cast(s.times(F.col("w1"), F.col("w2"))))
    src, dst = _pair(F.col("s1"), F.col("s2"), F.col("f"), epsilon), _pair(F.col("d1"), F.col("d2"), F.col("g"), epsilon)
    arcs = found.where("not is_state").select("fst_id", src.alias("src"), "pos", "ilabel", "olabel", w.alias("weight"), dst.alias("dst"))
    return arcs.select(*ARC), found.where("is_state").select("fst_id", src.alias("state"))


def _compose_rounds(left: DataFrame, right: DataFrame, first: DataFrame, second: DataFrame, s, match, epsilon: bool, max_states: int) -> tuple[DataFrame, DataFrame]:
    """Arcs and states, by rounds over the cluster. Places are the pairs of both machines' places, numbered by state at the end."""
    spark = left.sparkSession
    key = [c for c in right.columns if c == "fst_id"]
    pair = lambda x, y, f: _pair(x, y, f, epsilon)
    start = first.join(second, "fst_id") if key else first.crossJoin(second)
    start = store(start.select("fst_id", pair(F.col("s1"), F.col("s2"), F.lit(0)).alias("state")), "starts")
    seen, made = Rounds(spark, "seen"), Rounds(spark, "made")
    front = seen.add(start.distinct())
    total = seen.last
    place = lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    none, zero = F.lit(None), F.lit(EPSILON).cast("bigint")
    while seen.last:
        here = front.select("fst_id", F.col("state").alias("src"), F.col("state.s1").alias("s1"), F.col("state.s2").alias("s2"), (F.col("state")["f"] if epsilon else F.lit(0)).alias("f"))
        l = left.where("m1 <> 0") if epsilon else left
        r = right.where("m2 <> 0") if epsilon else right
        j = here.join(l, ["fst_id", "s1"])
        both = j.join(r, [*key, "s2"]).where(match(F.col("m1"), F.col("m2"))) if match is not None else j.withColumn("m2", F.col("m1")).join(r, [*key, "s2", "m2"])
        w = s.cast(s.times(F.col("w1"), F.col("w2")))
        out = both.select("fst_id", "src", place(F.col("p1"), F.col("p2")).alias("pos"), "ilabel", "olabel", w.alias("weight"), pair(F.col("d1"), F.col("d2"), F.lit(0)).alias("dst"))
        if epsilon:
            alone1 = here.where("f <> 2").join(left.where("m1 = 0"), ["fst_id", "s1"]).select("fst_id", "src", place(F.col("p1"), none).alias("pos"), "ilabel", zero.alias("olabel"), F.col("w1").alias("weight"), pair(F.col("d1"), F.col("s2"), F.lit(1)).alias("dst"))
            alone2 = here.where("f <> 1").join(right.where("m2 = 0"), [*key, "s2"]).select("fst_id", "src", place(none, F.col("p2")).alias("pos"), zero.alias("ilabel"), "olabel", F.col("w2").alias("weight"), pair(F.col("s1"), F.col("d2"), F.lit(2)).alias("dst"))
            zeros = here.where("f = 0").join(left.where("m1 = 0"), ["fst_id", "s1"]).join(right.where("m2 = 0"), [*key, "s2"]).select("fst_id", "src", place(F.col("p1"), F.col("p2")).alias("pos"), "ilabel", "olabel", w.alias("weight"), pair(F.col("d1"), F.col("d2"), F.lit(0)).alias("dst"))
            out = out.unionByName(alone1).unionByName(alone2).unionByName(zeros)
        arcs = made.add(out)
        new = arcs.select("fst_id", F.col("dst").alias("state")).distinct().join(seen.rows(), ["fst_id", "state"], "left_anti")
        front = seen.add(new)
        total += seen.last
        if total > max_states:
            raise AlgorithmError(f"more than {max_states} states")
    number = F.row_number().over(Window.partitionBy("fst_id", "src").orderBy("pos", "ilabel", "olabel", "dst")) - 1
    return made.rows().withColumn("pos", number.cast("bigint")).select(*ARC), seen.rows()


def is_acceptor(fst: Fst) -> bool:
    return fst.arcs.where("ilabel <> olabel").isEmpty()


def intersect(a: Fst, b: Fst, **options) -> Fst:
    """The paths that both acceptors have; weights multiply."""
    return compose(a, b, **options)


# -- determinization -----------------------------------------------------------------------------
def determinize(fst: Fst, max_states: int = MAX_STATES, max_depth: int | None = None) -> Fst:
    """The deterministic machine over input labels (outputs become inputs). States are numbers from 0 within each machine.

    Weighted subset construction: the weight of an arc is the sum of what its label offers, the residuals are what is
    left. Semirings without division need weights of one, like the boolean. It ends for machines with the twins
    property; max_states, and max_depth (labels from the start) if given, guard the others. Epsilon is a label like others: remove epsilons before.

    Small machines are walked each in a task; large ones, and those of many large subsets, round by round over the cluster."""
    s = fst.semiring
    if fst.starts.isEmpty():
        raise AlgorithmError("no start state")
    fst = fst.with_(arcs=store(fst.arcs.select(*ARC), "edges"), states=store(fst.states.select(*STATE), "states"))
    kind, large = divide(fst.arcs, fst.states, most=small.LOCAL_SUBSETS)
    if kind is None or s.name not in SCALARS:
        return renumber(_determinize(fst, max_states, max_depth)).stored("subsets")
    end = lambda df, name, src, dst, w, i=F.lit(None): df.select(F.col("fst_id").cast("bigint").alias("fst_id"), F.lit(name).alias("kind"), src.cast(kind).alias("src"), F.col(dst).alias("dst"), i.cast("bigint").alias("ilabel"), s.cast(w).alias("w"))
    rows = end(fst.arcs, "arc", F.col("src"), "dst", F.col("weight"), F.col("ilabel")).unionByName(end(fst.starts, "start", F.lit(None), "state", s.one)).unionByName(end(fst.finals, "final", F.lit(None), "state", F.col("final_weight")))
    if large is not None:
        rows = rows.join(large, "fst_id", "left_anti")
    found = by_machine(rows, small.subsets(SCALARS[s.name], max_states, max_depth), f"kind string, src bigint, ilabel bigint, dst bigint, w {s.type}", "subsets")
    arcs = found.where("kind = 'arc'").select("fst_id", "src", F.col("ilabel").alias("pos"), "ilabel", F.col("ilabel").alias("olabel"), F.col("w").alias("weight"), "dst")
    states = found.where("kind in ('start', 'state')").select("fst_id", F.col("src").alias("state"), (F.col("kind") == "start").alias("is_start"), F.col("w").alias("final_weight"))
    if states.where("not is_start").count() > max_states:
        raise AlgorithmError(f"more than {max_states} states")
    rest = found.where("kind = 'large'").select("fst_id")
    rest = store(rest if large is None else rest.unionByName(large.select(F.col("fst_id").cast("bigint").alias("fst_id"))), "large")
    if not rest.isEmpty():
        big = renumber(_determinize(fst.with_(arcs=fst.arcs.join(rest, "fst_id", "left_semi"), states=fst.states.join(rest, "fst_id", "left_semi")), max_states, max_depth)).stored("subsets")
        arcs, states = arcs.unionByName(big.arcs.select(*ARC)), states.unionByName(big.states.select(*STATE))
    return Fst(arcs.select(*ARC), states, s)


def _determinize(fst: Fst, max_states: int, max_depth: int | None) -> Fst:
    """determinize by rounds. No row holds a subset: its members (state q, residual r) are rows, and its name is a digest of
    256 bits that is put together by partial aggregates from the digests of the members, in any order."""
    s = fst.semiring
    plain = s.divide is None
    rest = (lambda w, least: w) if plain else (lambda w, least: s.cast(s.divide(w, least)))
    # A residual of -0.0 is one of 0.0.
    even = (lambda w: s.cast(w + F.lit(0.0))) if s.type in ("float", "double") else (lambda w: w)

    def named(members: DataFrame, *keys: str, **others: Column) -> DataFrame:
        one = members.withColumn("__h", F.sha2(F.to_json(F.struct("q", "r"), {"ignoreNullFields": "false"}), 256))
        parts = [F.bit_xor(F.xxhash64(F.lit(i), "__h")).cast("string") for i in range(4)]
        return one.groupBy(*keys).agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *parts), 256).alias("state"), *(c.alias(k) for k, c in others.items()))

    arcs = store(fst.arcs.select("fst_id", F.col("src").alias("q"), "ilabel", F.col("weight").alias("w"), "dst"), "edges")
    first = store(fst.starts.select("fst_id", F.col("state").alias("q"), s.cast(s.one).alias("r")), "starts")
    seen, made, held = Rounds(fst.spark, "subsets"), Rounds(fst.spark, "subset-arcs"), Rounds(fst.spark, "members")
    start = seen.add(named(first, "fst_id").select("fst_id", "state"))
    front = held.add(first.join(start, "fst_id").select("fst_id", F.col("state").alias("src"), "q", "r"))
    total = 0
    for turn in count():
        if max_depth is not None and turn > max_depth:
            raise AlgorithmError(f"determinization did not end within {max_depth} labels")
        path = fresh_path(fst.spark, "moves")
        to = front.join(arcs, ["fst_id", "q"]).groupBy("fst_id", "src", "ilabel", "dst").agg(s.plus_agg(s.times(F.col("r"), F.col("w"))).alias("w")).withColumn("w", s.cast(F.col("w"))).where(~s.is_zero(F.col("w")))
        to = store(to, path=path)
        if plain:
            members = to.withColumn("weight", s.cast(s.one))
        else:
            sums = to.groupBy("fst_id", "src", "ilabel").agg(s.cast(s.plus_agg(F.col("w"))).alias("weight")).select(F.col("fst_id").alias("f"), F.col("src").alias("a"), F.col("ilabel").alias("i"), "weight")
            members = to.join(sums, F.expr("fst_id <=> f and src = a and ilabel <=> i")).drop("f", "a", "i")
        members = members.select("fst_id", "src", "ilabel", F.col("dst").alias("q"), even(rest(F.col("w"), F.col("weight"))).alias("r"), "weight")
        arcs_out = made.add(named(members, "fst_id", "src", "ilabel", weight=F.first("weight")).select("fst_id", "src", F.col("ilabel").alias("pos"), "ilabel", F.col("ilabel").alias("olabel"), "weight", F.col("state").alias("dst")))
        # Of the arcs into a new subset, the first brings its members.
        new = arcs_out.groupBy("fst_id", F.col("dst").alias("state")).agg(F.min(F.struct("src", "ilabel")).alias("by")).join(seen.rows().select("fst_id", "state"), ["fst_id", "state"], "left_anti")
        new = store(new, "new")
        seen.add(new.select("fst_id", "state"))
        total += seen.last
        if not seen.last:
            break
        if total > max_states:
            raise AlgorithmError(f"more than {max_states} states")
        by = new.select(F.col("fst_id").alias("f"), F.col("by.src").alias("a"), F.col("by.ilabel").alias("i"), "state")
        front = held.add(members.join(by, F.expr("fst_id <=> f and src = a and ilabel <=> i")).select("fst_id", F.col("state").alias("src"), "q", "r"))
        remove(fst.spark, path)
    every = seen.rows()
    fin = held.rows().withColumnRenamed("src", "state").join(fst.finals.withColumnRenamed("state", "q"), ["fst_id", "q"]).groupBy("fst_id", "state").agg(s.plus_agg(s.times(F.col("r"), F.col("final_weight"))).alias("final_weight"))
    st = every.join(start.withColumn("first", F.lit(True)), ["fst_id", "state"], "left").join(fin, ["fst_id", "state"], "left")
    states = st.select("fst_id", "state", F.coalesce("first", F.lit(False)).alias("is_start"), s.cast(F.col("final_weight")).alias("final_weight"))
    return Fst(made.rows().select(*ARC), store(states, "states"), s)


# -- bisimulation and minimization ---------------------------------------------------------------
def partition(fst: Fst, dense: bool = True) -> DataFrame:
    """(fst_id, state, class): bisimulation classes, from final weights refined by the multisets of (labels, weight, class).

    A class goes by its least state while it is refined, so no round numbers anything; dense turns that into numbers
    from 0 within each machine. Small machines are refined each in a task, large ones round by round over the cluster."""
    s = fst.semiring
    arcs = store(fst.arcs.select("fst_id", "src", "ilabel", "olabel", "weight", "dst"), "edges")
    kind, large = divide(arcs, fst.states)
    if kind is None:
        return _partition(arcs, fst.states, dense)
    even = lambda c: F.col(c) + F.lit(0.0) if s.type in ("float", "double") else F.col(c)
    text = lambda w, *c: F.to_json(F.struct(*c, even(w).alias("w")), {"ignoreNullFields": "false"}).alias("text")
    i = F.col("fst_id").cast("bigint").alias("fst_id")
    rows = arcs.select(i, "src", "dst", text("weight", "ilabel", "olabel")).unionByName(fst.states.select(i, F.lit(None).cast(kind).alias("src"), F.col("state").alias("dst"), text("final_weight")))
    if large is not None:
        rows = rows.join(large, "fst_id", "left_anti")
    few = by_machine(rows, small.bisimilar, f"state {kind}, class {kind}, n bigint", "classes")
    few = few.select("fst_id", "state", F.col("n").alias("class") if dense else "class")
    if large is None:
        return few
    big = _partition(arcs.join(large, "fst_id", "left_semi"), fst.states.join(large, "fst_id", "left_semi"), dense)
    return few.unionByName(big.select(i, "state", "class"))


def _partition(arcs: DataFrame, states: DataFrame, dense: bool) -> DataFrame:
    # Joins and partial minima, no window: nearly all states of a machine share one class at first.
    finals = store(states.select("fst_id", "state", "final_weight"), "finals")
    heads = finals.groupBy("fst_id", "final_weight").agg(F.min("state").alias("class")).select(F.col("fst_id").alias("f"), F.col("final_weight").alias("w"), "class")
    now = store(finals.join(heads, F.expr("fst_id <=> f and final_weight <=> w")).select("fst_id", "state", "class"), "classes")
    n = now.select("fst_id", "class").distinct().count()
    while True:  # the number of classes grows, and is bounded by the states
        out = arcs.join(now.select("fst_id", F.col("state").alias("dst"), F.col("class").alias("to")), ["fst_id", "dst"]).groupBy("fst_id", F.col("src").alias("state")).agg(F.sort_array(F.collect_list(F.struct("ilabel", "olabel", "weight", "to"))).alias("out"))
        signed = now.join(out, ["fst_id", "state"], "left")
        least = signed.groupBy("fst_id", "class", "out").agg(F.min("state").alias("new"))
        least = least.select(F.col("fst_id").alias("f"), F.col("class").alias("c"), F.col("out").alias("o"), "new")
        new = signed.join(least, F.expr("fst_id <=> f and class <=> c and out <=> o")).select("fst_id", "state", F.col("new").alias("class"))
        now = store(new, "classes")
        k = now.select("fst_id", "class").distinct().count()
        if k == n:
            if not dense:
                return now
            names = number_rows(now.select("fst_id", "class").distinct(), ["fst_id", "class"], "n")
            names = names.join(names.groupBy("fst_id").agg(F.min("n").alias("least")), "fst_id").select("fst_id", "class", (F.col("n") - F.col("least")).alias("n"))
            return now.join(names, ["fst_id", "class"]).select("fst_id", "state", F.col("n").alias("class"))
        n = k


def merge_classes(fst: Fst, classes: DataFrame) -> Fst:
    """One state for each class. Arcs of one representative are kept, so weights are not added up."""
    c = store(classes, "classes")
    head = c.groupBy("fst_id", "class").agg(F.min("state").alias("state"))
    arcs = fst.arcs.join(head.select("fst_id", F.col("state").alias("src"), F.col("class").alias("a")), ["fst_id", "src"]).join(c.select("fst_id", F.col("state").alias("dst"), F.col("class").alias("b")), ["fst_id", "dst"])
    arcs = arcs.select("fst_id", F.col("a").alias("src"), "pos", "ilabel", "olabel", "weight", F.col("b").alias("dst"))
    st = fst.states.join(c, ["fst_id", "state"]).groupBy("fst_id", F.col("class").alias("state")).agg(F.bool_or("is_start").alias("is_start"), F.first("final_weight", ignorenulls=True).alias("final_weight"))
    return fst.with_(arcs=arcs, states=st.select(*STATE))


def is_deterministic(fst: Fst) -> bool:
    return fst.arcs.groupBy("fst_id", "src", "ilabel").count().where("count > 1").isEmpty() and fst.starts.groupBy("fst_id").count().where("count > 1").isEmpty()


def minimize(fst: Fst) -> Fst:
    """The smallest deterministic machine of the same weighted language (input labels).

    Determinizes if need be, trims, pushes weights towards the start where the semiring divides (so that equal futures
    have equal weights), and merges bisimulation classes. An empty collection stays empty."""
    if fst.states.isEmpty() or fst.starts.isEmpty():
        return fst
    det = fst if is_deterministic(fst) and is_acceptor(fst) else determinize(fst)
    trim = connect(det)
    if trim.states.isEmpty():
        return trim
    if trim.states.schema["state"].dataType.simpleString() != "bigint":
        trim = renumber(trim)
    trim = trim.stored("trim")
    s = trim.semiring
    if s.divide is None or not s.commutative:
        pushed = trim if s.divide is None else push_weights(trim)
        return merge_classes(pushed, partition(pushed)).stored("minimal")
    # Pushed without the totals, equal futures have equal weights; the totals go to the finals, which every path ends in.
    rest = store(distance_to_final(trim).withColumnRenamed("weight", "potential"), "rest")
    pushed = push_weights(trim, remove_total=True).stored("pushed")
    pushed = total_at_finals(pushed, trim.starts.join(rest, ["fst_id", "state"]))
    return merge_classes(pushed, partition(pushed)).stored("minimal")


# -- difference ----------------------------------------------------------------------------------
def complete(fst: Fst, alphabet: DataFrame) -> Fst:
    """A deterministic acceptor with an arc for every label (fst_id, label) at every state: missing ones lead to a sink
    (-1). States are numbers. Its arcs are states times labels; `difference` does without it."""
    s = fst.semiring
    sink = fst.starts.select("fst_id", F.lit(-1).cast("bigint").alias("state"), F.lit(False).alias("is_start"), F.lit(None).cast(s.type).alias("final_weight")).distinct()
    states = fst.states.unionByName(sink)
    every = states.select("fst_id", F.col("state").alias("src")).join(alphabet.select("fst_id", F.col("label").alias("ilabel")).distinct(), "fst_id")
    missing = every.join(fst.arcs.select("fst_id", "src", "ilabel"), ["fst_id", "src", "ilabel"], "left_anti")
    arcs = missing.select("fst_id", "src", F.col("ilabel").alias("pos"), "ilabel", F.col("ilabel").alias("olabel"), s.cast(s.one).alias("weight"), F.lit(-1).cast("bigint").alias("dst"))
    return fst.with_(arcs=fst.arcs.unionByName(arcs), states=states)


def beside(a: Fst, det: Fst) -> Fst:
    """The product of an acceptor with the complement of a deterministic one (states are numbers), weights of a: where det
    has no arc, it goes to a sink -1 that is never written out. States are structs (s1, s2).

    Small machines are walked each in a task, large ones round by round over the cluster."""
    kind, large = divide(a.arcs.select("fst_id").unionByName(det.arcs.select("fst_id")), a.states)
    if kind is None or a.semiring.type not in KINDS:
        return _beside(a, det)
    arcs, start = F.lit("arc").alias("kind"), F.lit("start").alias("kind")
    i = F.col("fst_id").cast("bigint").alias("fst_id")
    rows = a.arcs.select(i, F.lit(0).alias("side"), arcs, F.col("src").alias("a"), F.col("dst").alias("b"), "ilabel", "pos", "olabel", F.col("weight").alias("w"))
    parts = [a.starts.select(i, F.lit(0).alias("side"), start, F.col("state").alias("b")), det.arcs.select(i, F.lit(1).alias("side"), arcs, F.col("src").alias("c"), F.col("dst").alias("d"), "ilabel"), det.starts.select(i, F.lit(1).alias("side"), start, F.col("state").alias("d"))]
    for x in parts:
        rows = rows.unionByName(x, allowMissingColumns=True)
    if large is not None:
        rows = rows.join(large, "fst_id", "left_anti")
    found = by_machine(rows, small.beside_rows, f"kind string, s1 {kind}, s2 bigint, d1 {kind}, d2 bigint, pos bigint, ilabel bigint, olabel bigint, w {a.semiring.type}", "beside")
    pair = lambda x, y: F.struct(F.col(x).alias("s1"), F.col(y).alias("s2"))
    made = found.where("kind = 'arc'").select("fst_id", pair("s1", "s2").alias("src"), "pos", "ilabel", "olabel", F.col("w").alias("weight"), pair("d1", "d2").alias("dst"))
    f1, f2 = a.finals.withColumnRenamed("state", "s1"), det.finals.select("fst_id", F.col("state").alias("s2"), F.lit(True).alias("out"))
    st = found.where("kind <> 'arc'").join(f1, ["fst_id", "s1"], "left").join(f2, ["fst_id", "s2"], "left")
    states = store(st.select("fst_id", pair("s1", "s2").alias("state"), (F.col("kind") == "start").alias("is_start"), F.when(F.col("out").isNull(), F.col("final_weight")).alias("final_weight")), "states")
    few = Fst(made.select(*ARC), states, a.semiring)
    if large is None:
        return few
    big = _beside(*(m.with_(arcs=m.arcs.join(large, "fst_id", "left_semi"), states=m.states.join(large, "fst_id", "left_semi")) for m in (a, det)))
    return few.with_(arcs=few.arcs.unionByName(big.arcs), states=few.states.unionByName(big.states))


def _beside(a: Fst, det: Fst) -> Fst:
    spark = a.spark
    pair = lambda x, y: F.struct(x.alias("s1"), y.alias("s2"))
    left = store(a.arcs.select("fst_id", F.col("src").alias("s1"), "pos", "ilabel", "olabel", "weight", F.col("dst").alias("d1")), "left")
    right = store(det.arcs.select("fst_id", F.col("src").alias("s2"), "ilabel", F.col("dst").alias("d2")), "right")
    start = a.starts.withColumnRenamed("state", "s1").join(det.starts.withColumnRenamed("state", "s2"), "fst_id", "left")
    start = store(start.select("fst_id", pair(F.col("s1"), F.coalesce("s2", F.lit(-1).cast("bigint"))).alias("state")), "starts")
    seen, made = Rounds(spark, "seen"), Rounds(spark, "made")
    front = seen.add(start)
    while seen.last:
        step = front.select("fst_id", F.col("state").alias("src"), "state.s1", "state.s2").join(left, ["fst_id", "s1"]).join(right, ["fst_id", "s2", "ilabel"], "left")
        arcs = made.add(step.select("fst_id", "src", "pos", "ilabel", "olabel", "weight", pair(F.col("d1"), F.coalesce("d2", F.lit(-1).cast("bigint"))).alias("dst")))
        front = seen.add(arcs.select("fst_id", F.col("dst").alias("state")).distinct().join(seen.rows(), ["fst_id", "state"], "left_anti"))
    f1 = a.finals.withColumnRenamed("state", "s1")
    f2 = det.finals.select("fst_id", F.col("state").alias("s2"), F.lit(True).alias("out"))
    st = seen.rows().select("fst_id", "state", "state.*").join(f1, ["fst_id", "s1"], "left").join(f2, ["fst_id", "s2"], "left").join(start.withColumn("first", F.lit(True)), ["fst_id", "state"], "left")
    states = st.select("fst_id", "state", F.coalesce("first", F.lit(False)).alias("is_start"), F.when(F.col("out").isNull(), F.col("final_weight")).alias("final_weight"))
    return Fst(made.rows().select(*ARC), store(states, "states"), a.semiring)


def difference(a: Fst, b: Fst) -> Fst:
    """What a accepts and b does not, with the weights of a. Both must be acceptors, with a label between them.
    States are numbers."""
    s = a.semiring
    for m in (a, b):
        if not is_acceptor(m):
            raise InvalidOperation("difference needs acceptors")
    if a.arcs.where("ilabel <> 0").isEmpty() and b.arcs.where("ilabel <> 0").isEmpty():
        raise InvalidOperation("the alphabet is empty")
    from ..functions.semiring import BOOLEAN
    from .epsilon import remove_epsilons
    from .rational import weight_convert

    support = weight_convert(b, lambda w: ~s.is_zero(w), BOOLEAN)
    det = determinize(remove_epsilons(support)) if not b.starts.isEmpty() else support
    det = det if det.states.schema["state"].dataType.simpleString() == "bigint" else renumber(det)
    return connect_if(numbered(beside(remove_epsilons(a), det.stored("subtract"))).stored("difference"))


def connect_if(fst: Fst) -> Fst:
    """connect, but an empty result instead of an error where nothing starts."""
    return connect(fst) if not fst.starts.isEmpty() else fst
