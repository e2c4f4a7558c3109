"""Machines in tasks and over the cluster, and the operators that need exact structure."""

import pytest
from pyspark.sql import functions as F

from arcflow.errors import AlgorithmError, InvalidOperation
from arcflow.functions import semiring as S
from arcflow.operators import apps, distance, graph, lazy, product, rational
from arcflow.plans import model, small
from arcflow.plans.model import build
from arcflow.streaming import run as streams
from tests.test_operators import language, machine

T = S.TROPICAL


def test_minimal_machine_with_a_cycle_through_the_start(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (0, 2, 2, 2.0, 2), (1, 3, 3, 3.0, 3), (2, 3, 3, 2.0, 3), (3, 4, 4, 0.5, 0)], {3: 5.0})
    least = product.minimize(m)
    assert least.counts().first()["n_states"] == 3
    want, got = language(m), language(least)
    assert want[0].keys() == got[0].keys() and all(abs(want[0][k] - got[0][k]) < 1e-5 for k in want[0])
    pushed = language(distance.push_weights(m))
    assert all(abs(want[0][k] - pushed[0][k]) < 1e-5 for k in want[0])


def test_isomorphism_with_ties(spark):
    a = build(spark, T, {i: {"arcs": [(0, 1, 1, 0.0, 1), (0, 1, 1, 0.0, 2), (1, 5, 5, 0.0, 3), (2, 6, 6, 0.0, 3)], "start": 0, "finals": {3: 0.0}} for i in range(3)})
    b = build(spark, T, {
        0: {"arcs": [(0, 1, 1, 0.0, 1), (0, 1, 1, 0.0, 2), (1, 6, 6, 0.0, 3), (2, 5, 5, 0.0, 3)], "start": 0, "finals": {3: 0.0}},
        1: {"arcs": [(0, 1, 1, 0.0, 1), (0, 1, 1, 0.0, 2), (1, 6, 6, 0.0, 3), (2, 6, 6, 0.0, 3)], "start": 0, "finals": {3: 0.0}},
        2: {"arcs": [(0, 1, 1, 0.0, 1), (0, 1, 1, 0.0, 1), (1, 5, 5, 0.0, 3), (2, 6, 6, 0.0, 3)], "start": 0, "finals": {3: 0.0}},
    })
    assert {r["fst_id"]: r["same"] for r in graph.isomorphic(a, b).collect()} == {0: True, 1: False, 2: False}


def test_ways_agree(spark, monkeypatch):
    """What tasks do with small machines, rounds over the cluster do too."""
    a = machine(spark, [(0, 1, 1, 1.0, 1), (0, 2, 0, 2.0, 2), (1, 3, 2, 0.5, 2), (2, 0, 3, 1.0, 3)], {3: 0.0})
    b = machine(spark, [(0, 1, 7, 0.0, 1), (1, 2, 8, 1.0, 1), (1, 0, 9, 0.5, 2), (2, 3, 4, 0.0, 2)], {2: 0.0, 1: 2.0})
    arcs = lambda m: sorted(map(str, m.arcs.collect()))
    keys = lambda df: sorted(map(str, df.collect()))

    def all_of():
        c = product.compose(a, b, epsilon=True)
        return keys(c.arcs.drop("pos")), keys(c.states), arcs(model.renumber(product.compose(a, b, epsilon=True, shared=True)).with_(arcs=c.arcs.drop("pos").withColumn("pos", F.lit(0)))), keys(distance.shortest_distance(a)), keys(distance.shortest_path(a, 3).withColumn("rank", F.col("rank").cast("bigint"))), keys(graph.topological_levels(a)), keys(graph.breadth_levels(a))

    near = all_of()
    monkeypatch.setattr(small, "LOCAL_ROWS", 0)
    monkeypatch.setattr(product, "LOCAL_ROWS", 0)
    assert all_of() == near


def test_long_chain(spark):
    n = 10_000
    arcs = spark.range(n).select(F.lit(0).cast("bigint").alias("fst_id"), F.col("id").alias("src"), F.lit(0).cast("bigint").alias("pos"), F.col("id").alias("ilabel"), F.col("id").alias("olabel"), F.lit(1.0).cast("float").alias("weight"), (F.col("id") + 1).alias("dst"))
    one = spark.range(1).select(F.col("id").alias("fst_id"), F.lit(0).cast("bigint").alias("state"))
    m = model.from_edges(arcs, one, one.select("fst_id", F.lit(n).cast("bigint").alias("state"), F.lit(0.0).alias("final_weight")), T)
    best = distance.shortest_path(m).first()
    assert best["weight"] == n and len(best["ilabels"]) == n
    assert len(small.strong_components({"src": list(range(60_000)), "dst": list(range(1, 60_001))})) == 60_001


def test_negative_cycle_ends(spark):
    m = machine(spark, [(0, 1, 1, -1.0, 1), (1, 1, 1, -1.0, 0)], {1: 0.0})
    with pytest.raises(AlgorithmError):
        distance.shortest_distance(m).collect()


def test_encoding_labels_keeps_weights(spark):
    m = machine(spark, [(0, 1, 2, 1.5, 1), (1, 1, 2, 2.5, 2)], {2: 3.0}, semiring=S.REAL)
    coded, table = rational.encode(m, weights=False)
    back = rational.decode(coded, table, S.REAL)
    assert sorted((r["ilabel"], r["olabel"], r["weight"]) for r in back.arcs.collect()) == [(1, 2, 1.5), (1, 2, 2.5)]
    assert [r["final_weight"] for r in back.finals.collect()] == [3.0]


def test_lazy_machines(spark):
    start = spark.createDataFrame([(0, 0)], "fst_id bigint, state bigint")
    step = lambda f: f.select("fst_id", F.col("state").alias("src"), F.lit(0).cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("ilabel"), F.lit(1).cast("bigint").alias("olabel"), F.lit(1.0).cast("float").alias("weight"), ((F.col("state") + 1) % 5).alias("dst"))
    m = lazy.expand(start, step, lambda st: st.where("state = 4").withColumn("final_weight", F.lit(0.0)), T)
    assert distance.shortest_path(m).first()["weight"] == 4.0
    with pytest.raises(AlgorithmError):
        lazy.expand(start, step, lambda st: st.limit(0).withColumn("final_weight", F.lit(0.0)), T, max_states=3)
    assert sum(x.count() for x in lazy.stream(start, step, max_depth=2)) == 3


def test_normalized_texts(spark):
    cases = {
        "I have twenty-three apples": "I have 23 apples", "two hundred five thousand and one": "205000 and 1", "one two": "1 2", "the twenty-first day": "the 21st day",
        "on March 5th, 2021 pay fifty dollars": "on 2021-03-05 pay $50", "call (555) 123-4567 now": "call +1-555-123-4567 now", "": "", "no number": "no number",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["result"] for r in apps.normalize_text(df, "t").collect()} == cases
    n = spark.createDataFrame([(x,) for x in (0, 7, 40, 115, 1000, 20_013, 999_999, 1_000_001, 305_000_000_000)], "n bigint")
    assert all(r["back"] == str(r["n"]) for r in apps.normalize_text(n.withColumn("t", apps.spell_number(F.col("n"))), "t", "back").collect())


def test_ways_to_keep_machines(spark):
    m = machine(spark, [(0, 1, 2, 1.5, 1)], {1: 0.0})
    for way in ("construction", "production", "memory_constraints", "repeated_access", "sparse_access"):
        assert model.materialize(m, way).arcs.collect() == m.arcs.collect()
    with pytest.raises(InvalidOperation):
        model.materialize(m, "other")


def test_streams_check_their_finals(spark, monkeypatch):
    monkeypatch.setattr(streams, "MAX_ARCS", 1)
    with pytest.raises(InvalidOperation):
        streams.transition_table(machine(spark, [(0, 1, 1, 0.0, 1)], {0: 0.0, 1: 0.0}))


def test_ambiguity(spark):
    m = build(spark, T, {
        0: {"arcs": [(0, 1, 1, 0.0, 1), (0, 1, 2, 0.0, 2), (1, 2, 2, 0.0, 3), (2, 2, 2, 0.0, 3)], "start": 0, "finals": {3: 0.0}},
        1: {"arcs": [(0, 1, 1, 0.0, 1), (0, 1, 2, 0.0, 2), (1, 2, 2, 0.0, 3), (2, 3, 3, 0.0, 3)], "start": 0, "finals": {3: 0.0}},
        2: {"arcs": [(0, 1, 1, 0.0, 1), (1, 2, 2, 0.0, 0)], "start": 0, "finals": {1: 0.0}},
    })
    found = {r["fst_id"]: (r["unambiguous"], r["initial_acyclic"]) for r in graph.properties(m).collect()}
    assert found == {0: (False, True), 1: (True, True), 2: (True, False)}
