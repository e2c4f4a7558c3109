"""Structure of machines: components, orders, isomorphism, properties, grammar expansion."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AlgorithmError, InvalidOperation
from ..plans.model import ARC, STATE, Fst, numbered, renumber
from ..plans.small import FACTS, by_machine, divide, facts, hops, levels, same_shape, strong_components
from ..plans.storage import Rounds, store, store_counted
from .distance import accessible, coaccessible, restrict


# -- strongly connected components ---------------------------------------------------------------
def components(fst: Fst) -> DataFrame:
    """(fst_id, state, component): strongly connected components, named by one of their states.

    Small machines are searched each in a task; large ones over the cluster. Colouring: the least state that reaches a state is its colour; what reaches the colour's own state backwards within
    the colour is its component. Components leave, and the rest is coloured again. States that nothing enters or
    nothing leaves (single components) leave first."""
    kind, large = divide(fst.arcs, fst.states)
    if kind is None:
        return _components(fst)
    bare = fst.states.select(F.col("fst_id").cast("bigint").alias("fst_id"), F.lit(None).cast(kind).alias("src"), F.col("state").alias("dst"))
    rows = fst.arcs.select(F.col("fst_id").cast("bigint").alias("fst_id"), "src", "dst").unionByName(bare)
    if large is None:
        return by_machine(rows, strong_components, f"state {kind}, component {kind}", "components")
    small = by_machine(rows.join(large, "fst_id", "left_anti"), strong_components, f"state {kind}, component {kind}")
    big = fst.with_(arcs=fst.arcs.join(large, "fst_id", "left_semi"), states=fst.states.join(large, "fst_id", "left_semi"))
    return store(small.unionByName(_components(big)), "components")


def _components(fst: Fst) -> DataFrame:
    out = Rounds(fst.spark, "components")
    edges = store(fst.arcs.select("fst_id", "src", "dst").where(~F.col("src").eqNullSafe(F.col("dst"))).distinct(), "edges")
    left = store(fst.states.select("fst_id", "state").distinct(), "left")
    while True:  # every round takes states away
        if left.isEmpty():
            return out.rows()
        heads, tails = edges.select("fst_id", F.col("dst").alias("state")).distinct(), edges.select("fst_id", F.col("src").alias("state")).distinct()
        inner = store(left.join(heads, ["fst_id", "state"], "left_semi").join(tails, ["fst_id", "state"], "left_semi"), "inner")
        out.add(left.join(inner, ["fst_id", "state"], "left_anti").select("fst_id", "state", F.col("state").alias("component")))
        before = left.count()
        if inner.count() == before:
            colour = _least(inner, edges)
            same = edges.join(colour.select("fst_id", F.col("state").alias("src"), F.col("c").alias("a")), ["fst_id", "src"]).join(colour.select("fst_id", F.col("state").alias("dst"), F.col("c").alias("b")), ["fst_id", "dst"]).where("a = b")
            back = store(same.select("fst_id", "a", F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
            rounds = Rounds(fst.spark, "back")
            front = rounds.add(colour.where("state = c").select("fst_id", "state", F.col("c").alias("a")))
            while rounds.last:
                step = front.withColumnRenamed("state", "src").join(back, ["fst_id", "a", "src"]).select("fst_id", F.col("dst").alias("state"), "a").distinct()
                front = rounds.add(step.join(rounds.rows(), ["fst_id", "state", "a"], "left_anti"))
            found = out.add(rounds.rows().select("fst_id", "state", F.col("a").alias("component")))
            inner = store(inner.join(found, ["fst_id", "state"], "left_anti"), "inner")
        left = inner
        edges = store(edges.join(left.withColumnRenamed("state", "src"), ["fst_id", "src"], "left_semi").join(left.withColumnRenamed("state", "dst"), ["fst_id", "dst"], "left_semi").select("fst_id", "src", "dst"), "edges")


def _least(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(fst_id, state, c): the least state that reaches each."""
    now = store(states.select("fst_id", "state", F.col("state").alias("c"), F.lit(True).alias("live")), "colour")
    while True:
        front = now.where("live").select("fst_id", F.col("state").alias("src"), "c")
        if front.isEmpty():
            return now.select("fst_id", "state", "c")
        step = front.join(edges, ["fst_id", "src"]).groupBy("fst_id", F.col("dst").alias("state")).agg(F.min("c").alias("m"))
        both = now.select("fst_id", "state", "c").join(step, ["fst_id", "state"], "left")
        now = store(both.select("fst_id", "state", F.least("c", "m").alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("live")), "colour")


def condense(fst: Fst) -> Fst:
    """One state for each strongly connected component, no loops; parallel arcs and final weights are summed."""
    s = fst.semiring
    c = store(components(fst), "components")
    arcs = fst.arcs.join(c.select("fst_id", F.col("state").alias("src"), F.col("component").alias("a")), ["fst_id", "src"]).join(c.select("fst_id", F.col("state").alias("dst"), F.col("component").alias("b")), ["fst_id", "dst"]).where("a <> b")
    arcs = arcs.groupBy("fst_id", "a", "ilabel", "olabel", "b").agg(s.plus_agg(F.col("weight")).alias("weight"), F.min("pos").alias("pos"))
    st = fst.states.join(c, ["fst_id", "state"]).groupBy("fst_id", "component").agg(F.bool_or("is_start").alias("is_start"), s.plus_agg(F.col("final_weight")).alias("f"), F.count("final_weight").alias("n"))
    states = st.select("fst_id", F.col("component").alias("state"), "is_start", F.when(F.col("n") > 0, s.cast(F.col("f"))).alias("final_weight"))
    return fst.with_(arcs=arcs.select("fst_id", F.col("a").alias("src"), "pos", "ilabel", "olabel", s.cast(F.col("weight")).alias("weight"), F.col("b").alias("dst")), states=states)


# -- orders --------------------------------------------------------------------------------------
def topological_levels(fst: Fst) -> DataFrame:
    """(fst_id, state, level): the longest path to each state; a cycle is an error.

    Small machines are walked each in a task. In large ones, states whose incoming arcs are all settled are peeled off
    round by round."""
    bare = fst.states.select("fst_id", "state")
    return _by_size(fst.arcs, bare, bare, levels, _topological_levels, fst)


def _by_size(arcs: DataFrame, seeds: DataFrame, states: DataFrame, walk, rounds, fst: Fst) -> DataFrame:
    """(fst_id, state, level) of small machines by walk in tasks, with the seeds as arcs from nowhere; else by rounds."""
    kind, large = divide(arcs, states)
    if kind is None:
        return rounds(fst)
    row = lambda df, src, dst: df.select(F.col("fst_id").cast("bigint").alias("fst_id"), src.cast(kind).alias("src"), F.col(dst).alias("dst"))
    rows = row(arcs, F.col("src"), "dst").unionByName(row(seeds, F.lit(None), "state"))
    if large is None:
        return by_machine(rows, walk, f"state {kind}, level bigint", "levels")
    few = by_machine(rows.join(large, "fst_id", "left_anti"), walk, f"state {kind}, level bigint", "levels")
    return few.unionByName(rounds(fst.with_(arcs=fst.arcs.join(large, "fst_id", "left_semi"), states=fst.states.join(large, "fst_id", "left_semi"))))


def _topological_levels(fst: Fst) -> DataFrame:
    edges = store(fst.arcs.select("fst_id", "src", "dst"), "edges")
    out = Rounds(fst.spark, "levels")
    left, rest = store_counted(fst.states.select("fst_id", "state").distinct(), "left")
    for level in count():
        if not rest["n"]:
            return out.rows()
        entered = edges.select("fst_id", F.col("dst").alias("state")).distinct()
        free = out.add(left.join(entered, ["fst_id", "state"], "left_anti").withColumn("level", F.lit(level).cast("bigint")))
        if not out.last:
            raise AlgorithmError("there is a cycle")
        left, rest = store_counted(left.join(free, ["fst_id", "state"], "left_anti"), "left")
        edges = store(edges.join(free.select("fst_id", F.col("state").alias("src")), ["fst_id", "src"], "left_anti").select("fst_id", "src", "dst"), "edges")


def breadth_levels(fst: Fst) -> DataFrame:
    """(fst_id, state, level): the fewest arcs from a start; only of states that one reaches."""
    return _by_size(fst.arcs, fst.starts, fst.states, hops, _breadth_levels, fst)


def _breadth_levels(fst: Fst) -> DataFrame:
    rounds = Rounds(fst.spark, "breadth")
    edges = store(fst.arcs.select("fst_id", "src", "dst").distinct(), "edges")
    front = rounds.add(fst.starts.withColumn("level", F.lit(0).cast("bigint")))
    n = 0
    while rounds.last:
        n += 1
        step = front.select("fst_id", F.col("state").alias("src")).join(edges, ["fst_id", "src"]).select("fst_id", F.col("dst").alias("state")).distinct()
        front = rounds.add(step.join(rounds.rows().select("fst_id", "state"), ["fst_id", "state"], "left_anti").withColumn("level", F.lit(n).cast("bigint")))
    return rounds.rows()


def _rename(fst: Fst, order: DataFrame) -> Fst:
    """States numbered in the order of (fst_id, key): key is any ordered column."""
    k = store(order, "order")
    one = Fst(
        fst.arcs.join(k.select("fst_id", F.col("state").alias("src"), F.struct("key", F.col("state").alias("s")).alias("a")), ["fst_id", "src"]).join(k.select("fst_id", F.col("state").alias("dst"), F.struct("key", F.col("state").alias("s")).alias("b")), ["fst_id", "dst"]).select("fst_id", F.col("a").alias("src"), "pos", "ilabel", "olabel", "weight", F.col("b").alias("dst")),
        fst.states.join(k, ["fst_id", "state"]).select("fst_id", F.struct("key", "state").alias("state"), "is_start", "final_weight"), fst.semiring,
    )
    one = one.with_(states=one.states.select("fst_id", F.struct(F.col("state.key").alias("key"), F.col("state.state").alias("s")).alias("state"), "is_start", "final_weight"))
    return renumber(one)


def topsort(fst: Fst) -> Fst:
    """States numbered so that every arc leads to a larger one; a cycle is an error."""
    return _rename(fst, topological_levels(fst).withColumnRenamed("level", "key"))


def state_sort(fst: Fst, by: str = "breadth") -> Fst:
    """States numbered in breadth-first, depth-first or topological order; unreachable states follow in their own order.

    Breadth-first order is by level, then by the place of the arc that found a state. Depth-first order is sequential by
    nature: machines are dealt by a hash of fst_id and walked in Python, many small ones in each task; one machine must
    fit one task."""
    if by == "topological":
        return topsort(fst)
    if fst.states.isEmpty():
        return fst
    if fst.starts.isEmpty():
        raise AlgorithmError("no start state")
    if by == "breadth":
        order = _breadth_order(fst)
    elif by == "depth":
        order = _depth_order(numbered(fst))
        fst = numbered(fst)
    else:
        raise InvalidOperation(f"no order {by}")
    every = fst.states.select("fst_id", "state").join(order, ["fst_id", "state"], "left").select("fst_id", "state", F.coalesce("key", F.lit(1 << 60)).alias("key"))
    return _rename(fst, every)


def _breadth_order(fst: Fst) -> DataFrame:
    rounds = Rounds(fst.spark, "breadth")
    edges = store(fst.arcs.select("fst_id", "src", "dst", "pos"), "edges")
    front = rounds.add(fst.starts.withColumn("key", F.lit(0).cast("bigint")))
    at = 1
    while rounds.last:
        step = front.select("fst_id", F.col("state").alias("src"), "key").join(edges, ["fst_id", "src"]).groupBy("fst_id", F.col("dst").alias("state")).agg(F.min(F.struct("key", "pos")).alias("k"))
        new = step.join(rounds.rows().select("fst_id", "state"), ["fst_id", "state"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("fst_id").orderBy("k", "state"))
        front = rounds.add(new.select("fst_id", "state", (rank + at).cast("bigint").alias("key")))
        at += max(1, front.groupBy("fst_id").count().agg(F.max("count").alias("n")).first()["n"] or 1)
    return rounds.rows()


def _depth_order(fst: Fst) -> DataFrame:
    spark = fst.spark
    rows = fst.starts.select("fst_id", F.lit(-1).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("pos"), F.col("state").alias("dst")).unionByName(fst.arcs.select("fst_id", "src", "pos", "dst"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, own in group.sort_values(["fst_id", "src", "pos", "dst"]).groupby("fst_id"):
            after: dict[int, list[int]] = {}
            for s, d in zip(own["src"], own["dst"]):
                after.setdefault(s, []).append(d)
            seen: set[int] = set()
            stack = [iter(after.get(-1, []))]
            while stack:
                state = next(stack[-1], None)
                if state is None:
                    stack.pop()
                elif state not in seen:
                    seen.add(state)
                    out.append((i, state, len(seen) - 1))
                    stack.append(iter(after.get(state, [])))
        return pd.DataFrame(out, columns=["fst_id", "state", "key"]).astype("int64")

    return rows.withColumn("b", F.pmod(F.xxhash64("fst_id"), F.lit(n))).groupBy("b").applyInPandas(lambda g: walk(g.drop(columns="b")), "fst_id bigint, state bigint, key bigint")


# -- isomorphism ---------------------------------------------------------------------------------
def isomorphic(a: Fst, b: Fst) -> DataFrame:
    """(fst_id, same): whether the machines of an id are the same up to the names of states.

    Pairs of small machines are decided each in a task, exactly: colours are refined over both, and ties are tried out.
    In large ones starts are paired, and each pair pairs the targets of its arcs in the order of (labels, weight). A difference of
    arcs, finals or counts, or a state paired twice, ends it. States that no start reaches are compared by number only.
    For states with several arcs of the same labels and weight the pairing is by target, so a true isomorphism may be
    missed there."""
    sides = list(enumerate((a, b)))
    kind, large = divide(a.arcs.select("fst_id").unionByName(b.arcs.select("fst_id")), a.states)
    if kind is None or b.states.schema["state"].dataType.simpleString() != kind:
        return _isomorphic(a, b)
    i = lambda df: df["fst_id"].cast("bigint").alias("fst_id")
    text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("text")
    rows = [m.arcs.select(i(m.arcs), F.lit(n).alias("side"), "src", "dst", text("ilabel", "olabel", "weight")) for n, m in sides]
    rows += [m.states.select(i(m.states), F.lit(n).alias("side"), F.lit(None).cast(kind).alias("src"), F.col("state").alias("dst"), text("is_start", "final_weight")) for n, m in sides]
    every = rows[0]
    for x in rows[1:]:
        every = every.unionByName(x)
    if large is None:
        return by_machine(every, same_shape, "same boolean", "same")
    few = by_machine(every.join(large, "fst_id", "left_anti"), same_shape, "same boolean", "same")
    big = [m.with_(arcs=m.arcs.join(large, "fst_id", "left_semi"), states=m.states.join(large, "fst_id", "left_semi")) for m in (a, b)]
    return few.unionByName(_isomorphic(*big))


def _isomorphic(a: Fst, b: Fst) -> DataFrame:
    ids = a.states.select("fst_id").union(b.states.select("fst_id")).distinct()
    place = F.row_number().over(Window.partitionBy("fst_id", "src").orderBy("ilabel", "olabel", "weight", "dst"))
    x = store(a.arcs.withColumn("i", place).select("fst_id", F.col("src").alias("p"), "i", "ilabel", "olabel", "weight", F.col("dst").alias("p2")), "left")
    y = store(b.arcs.withColumn("i", place).select("fst_id", F.col("src").alias("q"), "i", F.col("ilabel").alias("il"), F.col("olabel").alias("ol"), F.col("weight").alias("w"), F.col("dst").alias("q2")), "right")
    pairs = Rounds(a.spark, "pairs")
    front = pairs.add(a.starts.withColumnRenamed("state", "p").join(b.starts.withColumnRenamed("state", "q"), "fst_id"))
    while pairs.last:
        step = front.join(x, ["fst_id", "p"]).join(y, ["fst_id", "q", "i"]).select("fst_id", F.col("p2").alias("p"), F.col("q2").alias("q")).distinct()
        front = pairs.add(step.join(pairs.rows(), ["fst_id", "p", "q"], "left_anti"))
    every = pairs.rows()
    twice = every.groupBy("fst_id", "p").count().where("count > 1").select("fst_id").union(every.groupBy("fst_id", "q").count().where("count > 1").select("fst_id"))
    lx, ly = every.join(x, ["fst_id", "p"]), every.join(y, ["fst_id", "q"])
    arcs = lx.join(ly, ["fst_id", "p", "q", "i"], "full").where("not (ilabel <=> il) or not (olabel <=> ol) or not (weight <=> w)").select("fst_id")
    fx, fy = a.states.select("fst_id", F.col("state").alias("p"), F.col("final_weight").alias("f")), b.states.select("fst_id", F.col("state").alias("q"), F.col("final_weight").alias("g"))
    finals = every.join(fx, ["fst_id", "p"]).join(fy, ["fst_id", "q"]).where("not (f <=> g)").select("fst_id")
    ca, cb = a.counts(), b.counts().withColumnsRenamed({"n_states": "m_states", "n_arcs": "m_arcs", "n_finals": "m_finals"})
    counts = ca.join(cb, "fst_id", "full").where("not (n_states <=> m_states) or not (n_arcs <=> m_arcs) or not (n_finals <=> m_finals)").select("fst_id")
    starts = a.starts.groupBy("fst_id").count().join(b.starts.groupBy("fst_id").agg(F.count("*").alias("m")), "fst_id", "full").where("not (count <=> m)").select("fst_id")
    bad = store(twice.union(arcs).union(finals).union(counts).union(starts).distinct().withColumn("bad", F.lit(True)), "differ")
    return ids.join(bad, "fst_id", "left").select("fst_id", F.col("bad").isNull().alias("same"))


# -- grammar expansion ---------------------------------------------------------------------------
def string_rule(spark, semiring, label: int, texts: list[str]) -> Fst:
    """A rule whose body is a choice of strings, one label for each character."""
    from ..plans.model import build

    arcs, finals, n = [], {}, 1
    for t in texts:
        at = 0
        for c in t:
            arcs.append((at, ord(c), ord(c), None, n))
            at, n = n, n + 1
        finals[at] = None
    one = {"tropical": 0.0, "log": 0.0, "boolean": True, "integer": 1}.get(semiring.name, 1.0)
    return build(spark, semiring, {label: {"arcs": [(a, i, o, one, d) for a, i, o, _, d in arcs], "start": 0, "finals": dict.fromkeys(finals, one), "states": n}})


def validate_grammar(rules: Fst, root: int) -> list[str]:
    """What is wrong with a grammar: no root, rules without start, cycles of rules."""
    found = []
    keys = rules.states.select("fst_id").distinct()
    if keys.where(F.col("fst_id") == root).isEmpty():
        found.append("the root has no rule")
    lame = keys.join(rules.starts, "fst_id", "left_anti")
    found += [f"rule {r['fst_id']} has no start" for r in lame.orderBy("fst_id").collect()]  # as many as the grammar has rules
    uses = rules.arcs.select("fst_id", F.col("ilabel").alias("to")).join(keys.withColumnRenamed("fst_id", "to"), "to", "left_semi").distinct()
    edges = uses.select(F.lit(0).alias("fst_id"), F.col("fst_id").alias("src"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("ilabel"), F.lit(0).cast("bigint").alias("olabel"), rules.semiring.cast(rules.semiring.one).alias("weight"), F.col("to").alias("dst"))
    states = keys.select(F.lit(0).alias("fst_id"), F.col("fst_id").alias("state"), F.lit(False).alias("is_start"), F.lit(None).cast(rules.semiring.type).alias("final_weight"))
    loops = components(Fst(edges, states, rules.semiring)).groupBy("component").count().where("count > 1")
    selfish = uses.where("fst_id = to")
    if not loops.isEmpty() or not selfish.isEmpty():
        found.append("rules are recursive")
    return found


def replace(rules: Fst, root: int, max_depth: int = 100, keep_label: bool = False, remove_epsilon: bool = False) -> Fst:
    """The machine of rule `root` with every arc whose input is a rule's label replaced by that rule's machine.

    rules: one machine for each rule, keyed by its label. The arc becomes an epsilon arc (with keep_label, one of its
    input label) with its weight into a copy of the rule, whose finals lead back by epsilon arcs with their weights.
    Each round replaces all such arcs at once; more than max_depth rounds (recursive rules) are an error. A missing root
    gives one final state."""
    from .epsilon import remove_epsilons

    s = rules.semiring
    spark = rules.spark
    root_states = rules.states.where(F.col("fst_id") == root)
    if root_states.isEmpty():
        from ..plans.model import build

        one = spark.range(1).select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state"), F.lit(True).alias("is_start"), s.cast(s.one).alias("final_weight"))
        return build(spark, s, {}).with_(states=one)
    text = lambda c: F.col(c).cast("string")
    body_a = store(rules.arcs.select(F.col("fst_id").alias("rule"), text("src").alias("src"), "pos", "ilabel", "olabel", "weight", text("dst").alias("dst")), "rules")
    body_s = store(rules.states.select(F.col("fst_id").alias("rule"), text("state").alias("state"), "is_start", "final_weight"), "rule-states")
    keys = body_s.select(F.col("rule").alias("ilabel")).distinct()
    arcs = store(body_a.where(F.col("rule") == root).drop("rule"), "arcs")
    states = store(body_s.where(F.col("rule") == root).drop("rule"), "states")
    for depth in range(max_depth + 1):
        calls = arcs.join(keys, "ilabel", "left_semi")
        if calls.isEmpty():
            break
        if depth == max_depth:
            raise AlgorithmError(f"rules are nested more than {max_depth} deep")
        # A copy is named after the arc that calls it.
        calls = store(calls.withColumn("call", F.concat_ws("|", F.col("src"), F.col("pos").cast("string"), F.col("ilabel").cast("string"), F.col("olabel").cast("string"), F.col("dst"))), "calls")
        zero = F.lit(0).cast("bigint")
        name = lambda c: F.concat(F.lit("("), F.col("call"), F.lit(")"), F.col(c))
        c = calls.select("call", F.col("src").alias("from"), F.col("dst").alias("to"), F.col("pos").alias("p"), F.col("ilabel").alias("rule"), F.col("weight").alias("w"))
        inside = c.join(body_a, "rule").select(name("src").alias("src"), "pos", "ilabel", "olabel", "weight", name("dst").alias("dst"))
        copies = c.join(body_s, "rule")
        into = copies.where("is_start").select(F.col("from").alias("src"), F.col("p").alias("pos"), (F.col("rule") if keep_label else zero).alias("ilabel"), zero.alias("olabel"), F.col("w").alias("weight"), name("state").alias("dst"))
        back = copies.where("final_weight is not null").select(name("state").alias("src"), F.lit(1 << 40).cast("bigint").alias("pos"), zero.alias("ilabel"), zero.alias("olabel"), F.col("final_weight").alias("weight"), F.col("to").alias("dst"))
        rest = arcs.join(keys, "ilabel", "left_anti").select("src", "pos", "ilabel", "olabel", "weight", "dst")
        if keep_label:
            # The entering arc has a rule's label but is no call any more.
            raise_label = into.withColumn("ilabel", -F.col("ilabel"))
            into = raise_label
        new_states = copies.select(name("state").alias("state"), F.lit(False).alias("is_start"), F.lit(None).cast(s.type).alias("final_weight"))
        states = store(states.unionByName(new_states), "states")
        arcs = store(rest.unionByName(inside).unionByName(into).unionByName(back), "arcs")
    one = F.lit(root).cast("bigint").alias("fst_id")
    out = Fst(arcs.select(one, "src", "pos", F.abs("ilabel").alias("ilabel"), "olabel", "weight", "dst"), states.select(one, *STATE[1:]), s)
    out = renumber(out)
    return remove_epsilons(out.stored("replace")) if remove_epsilon else out


# -- properties ----------------------------------------------------------------------------------
def properties(fst: Fst) -> DataFrame:
    """One row for each machine: counts and properties as booleans. All are computed, so none is null.

    Small machines are read each by a task in one pass; of large ones every property is a relation of its own."""
    s = fst.semiring
    fst = fst.with_(arcs=store(fst.arcs.select(*ARC), "edges"), states=store(fst.states.select(*STATE), "states"))
    kind, large = divide(fst.arcs, fst.states)
    if kind is None:
        j = _facts(fst)
    else:
        i = F.col("fst_id").cast("bigint").alias("fst_id")
        arcs = fst.arcs.select(i, F.lit("arc").alias("kind"), "src", "dst", "pos", "ilabel", "olabel", (~s.is_one(F.col("weight"))).alias("flag"))
        bare = fst.states.select(i, F.lit("state").alias("kind"), F.col("state").alias("dst"), F.col("is_start").alias("flag"), F.col("final_weight").isNotNull().alias("final"))
        rows = arcs.unionByName(bare, allowMissingColumns=True)
        if large is not None:
            rows = rows.join(large, "fst_id", "left_anti")
        j = by_machine(rows, facts, FACTS, "facts")
        if large is not None:
            big = _facts(fst.with_(arcs=fst.arcs.join(large, "fst_id", "left_semi"), states=fst.states.join(large, "fst_id", "left_semi")))
            j = j.unionByName(big.select(i, *j.columns[1:]))
    j = j.join(twins(fst), "fst_id", "left")
    no, yes = F.lit(False), F.lit(True)
    f = lambda c, d=no: F.coalesce(F.col(c), d)
    is_acc, is_co = f("n_acc", F.lit(0)) == F.col("n_states"), f("n_co", F.lit(0)) == F.col("n_states")
    return j.select(
        "fst_id", "n_states", f("n_arcs", F.lit(0)).alias("n_arcs"), "n_finals", f("epsilons").alias("epsilons"), f("input_epsilons").alias("input_epsilons"), f("output_epsilons").alias("output_epsilons"),
        f("acceptor", yes).alias("acceptor"), f("weighted").alias("weighted"), f("cyclic").alias("cyclic"), (~f("round_start")).alias("initial_acyclic"), (f("i_deterministic", yes) & ~f("input_epsilons") | ~f("twins")).alias("unambiguous"), is_acc.alias("accessible"), is_co.alias("coaccessible"), (is_acc & is_co).alias("connected"),
        f("i_deterministic", yes).alias("input_deterministic"), f("o_deterministic", yes).alias("output_deterministic"), (f("i_deterministic", yes) & ~f("input_epsilons")).alias("functional"),
        f("input_sorted", yes).alias("input_sorted"), f("output_sorted", yes).alias("output_sorted"), f("top_sorted", yes).alias("top_sorted"),
        (f("single", yes) & (F.col("n_finals") == 1) & is_acc & ~f("cyclic")).alias("string"),
    )


def _facts(fst: Fst) -> DataFrame:
    """The columns of small.FACTS by relations; they may be null where a machine has no arcs."""
    s = fst.semiring
    flags = fst.arcs.groupBy("fst_id").agg(
        F.count("*").alias("n_arcs"), F.bool_or(F.expr("ilabel = 0 and olabel = 0")).alias("epsilons"), F.bool_or(F.expr("ilabel = 0")).alias("input_epsilons"), F.bool_or(F.expr("olabel = 0")).alias("output_epsilons"),
        F.bool_and(F.expr("ilabel = olabel")).alias("acceptor"), F.bool_or(~s.is_one(F.col("weight"))).alias("weighted"), F.bool_and(F.expr("src < dst")).alias("top_sorted"),
    )
    degree = lambda label: fst.arcs.groupBy("fst_id", "src", label).count().groupBy("fst_id").agg((F.max("count") == 1).alias(f"{label[0]}_deterministic"))
    order = Window.partitionBy("fst_id", "src").orderBy("pos")
    sort = fst.arcs.select("fst_id", (F.col("ilabel") >= F.lag("ilabel", 1, 0).over(order)).alias("i"), (F.col("olabel") >= F.lag("olabel", 1, 0).over(order)).alias("o")).groupBy("fst_id").agg(F.bool_and("i").alias("input_sorted"), F.bool_and("o").alias("output_sorted"))
    fan = fst.arcs.groupBy("fst_id", "src").count().groupBy("fst_id").agg((F.max("count") == 1).alias("single"))
    comp = store(components(restrict(fst, acc := store(accessible(fst), "acc"))), "scc")
    loops = fst.arcs.join(acc.select("fst_id", F.col("state").alias("src")), ["fst_id", "src"], "left_semi").where(F.col("src").eqNullSafe(F.col("dst"))).select("fst_id").distinct()
    cyclic = comp.groupBy("fst_id", "component").count().where("count > 1").select("fst_id").union(loops).distinct().withColumn("cyclic", F.lit(True))
    reach = fst.states.groupBy("fst_id").agg(F.count("*").alias("n_states"), F.count("final_weight").alias("n_finals"))
    na, nc = acc.groupBy("fst_id").agg(F.count("*").alias("n_acc")), coaccessible(fst).groupBy("fst_id").agg(F.count("*").alias("n_co"))
    at_start = comp.join(fst.starts, ["fst_id", "state"]).select("fst_id", "component")
    round_start = at_start.join(comp.groupBy("fst_id", "component").count().where("count > 1"), ["fst_id", "component"], "left_semi").select("fst_id").union(loops_of(fst, fst.starts)).distinct().withColumn("round_start", F.lit(True))
    j = reach.join(round_start, "fst_id", "left")
    for t in (flags, degree("ilabel"), degree("olabel"), sort, fan, cyclic, na, nc):
        j = j.join(t, "fst_id", "left")
    return j


def loops_of(fst: Fst, states: DataFrame) -> DataFrame:
    """fst_id of the machines in which one of the states has an arc to itself."""
    own = fst.arcs.where(F.col("src").eqNullSafe(F.col("dst"))).select("fst_id", F.col("src").alias("state"))
    return own.join(states.select("fst_id", "state"), ["fst_id", "state"], "left_semi").select("fst_id").distinct()


def twins(fst: Fst) -> DataFrame:
    """(fst_id, twins): the machines with two different paths of the same input labels from a start to finals.

    Pairs of different states that the same inputs reach are followed (silent arcs count as a label of their own); machines
    without two arcs of a label at some state, and with one start, are left out beforehand."""
    arcs = fst.arcs.select("fst_id", "src", "ilabel", "dst", F.struct("olabel", "pos").alias("n"))
    split = arcs.groupBy("fst_id", "src", "ilabel").count().where("count > 1").select("fst_id").union(fst.starts.groupBy("fst_id").count().where("count > 1").select("fst_id")).distinct()
    split = store(split, "split")
    if split.isEmpty():
        return split.withColumn("twins", F.lit(True))
    trim = fst.with_(arcs=fst.arcs.join(split, "fst_id", "left_semi"), states=fst.states.join(split, "fst_id", "left_semi"))
    useful = store(coaccessible(trim).join(accessible(trim), ["fst_id", "state"], "left_semi"), "useful")
    arcs = store(arcs.join(split, "fst_id", "left_semi").join(useful.withColumnRenamed("state", "src"), ["fst_id", "src"], "left_semi").join(useful.withColumnRenamed("state", "dst"), ["fst_id", "dst"], "left_semi").select("fst_id", "src", "ilabel", "dst", "n"), "edges")
    x = arcs.select("fst_id", F.col("src").alias("p"), "ilabel", F.col("dst").alias("p2"), F.col("n").alias("n1"))
    y = arcs.select("fst_id", F.col("src").alias("q"), "ilabel", F.col("dst").alias("q2"), F.col("n").alias("n2"))
    # A pair is apart once its paths have taken different arcs.
    ends = fst.starts.join(useful, ["fst_id", "state"], "left_semi")
    seen = Rounds(fst.spark, "twins")
    front = seen.add(ends.withColumnRenamed("state", "p").join(ends.withColumnRenamed("state", "q"), "fst_id").select("fst_id", "p", "q", (F.col("p") != F.col("q")).alias("apart")).distinct())
    while seen.last:
        step = front.join(x, ["fst_id", "p"]).join(y, ["fst_id", "q", "ilabel"])
        step = step.select("fst_id", F.col("p2").alias("p"), F.col("q2").alias("q"), (F.col("apart") | (F.col("n1") != F.col("n2")) | (F.col("p2") != F.col("q2"))).alias("apart")).distinct()
        front = seen.add(step.join(seen.rows(), ["fst_id", "p", "q", "apart"], "left_anti"))
    last = fst.finals.select("fst_id", "state")
    both = seen.rows().where("apart").join(last.withColumnRenamed("state", "p"), ["fst_id", "p"], "left_semi").join(last.withColumnRenamed("state", "q"), ["fst_id", "q"], "left_semi")
    return both.select("fst_id").distinct().withColumn("twins", F.lit(True))


def degree_statistics(fst: Fst) -> DataFrame:
    """By machine: mean, largest and spread of out-degrees, distinct labels and their entropy in bits."""
    out = fst.states.select("fst_id", "state").join(fst.arcs.groupBy("fst_id", F.col("src").alias("state")).count(), ["fst_id", "state"], "left").groupBy("fst_id").agg(F.avg(F.coalesce("count", F.lit(0))).alias("mean_degree"), F.max(F.coalesce("count", F.lit(0))).alias("max_degree"), F.stddev_pop(F.coalesce("count", F.lit(0))).alias("sd_degree"))
    p = fst.arcs.groupBy("fst_id", "ilabel").agg(F.count("*").alias("n"))
    total = p.groupBy("fst_id").agg(F.sum("n").alias("all"))
    h = p.join(total, "fst_id").groupBy("fst_id").agg(F.count("*").alias("n_labels"), (-F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("all")))).alias("entropy"))
    return out.join(h, "fst_id", "left").withColumn("variation", F.try_divide("sd_degree", "mean_degree"))


def recommend_storage(fst: Fst) -> DataFrame:
    """By machine, the Parquet codec that suits its labels and size."""
    d = degree_statistics(fst).join(fst.counts(), "fst_id")
    kind = F.when((F.col("n_labels") < 256) & (F.col("mean_degree") > 50), "dictionary").when(F.col("n_labels") < 10, "delta").when(F.col("n_arcs") > 10_000, "lz4").otherwise("plain")
    return d.select("fst_id", kind.alias("codec"))



