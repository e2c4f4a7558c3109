"""Subsets, products with complements, classes and properties of machines: what tasks do, rounds over the cluster do too."""

import random

from arcflow import queries
from arcflow.functions import semiring as S
from arcflow.operators import distance, graph, product
from arcflow.plans import small
from arcflow.plans.model import build
from tests.test_operators import dag, language, machine


def keys(df):
    return sorted(map(str, df.collect()))


def some(spark, n=12, semiring=S.BOOLEAN):
    """Machines with and without cycles, several arcs of a label at a state, and states that nothing reaches."""
    one, found = {"boolean": True, "tropical": 0.0}[semiring.name], {}
    for k in range(n):
        rng = random.Random(k)
        m = rng.randint(2, 8)
        arcs = [(rng.randrange(m), rng.randint(1, 2), rng.randrange(m)) for _ in range(rng.randint(0, 14))]
        found[k] = {"arcs": [(a, i, i, one, d) for a, i, d in arcs if k % 2 or a < d], "start": 0 if k % 5 else None, "finals": {rng.randrange(m): one}, "states": m}
    return build(spark, semiring, found)


def chains(spark, n=40):
    """Two chains of n labels that differ in the last one, from one start."""
    arcs = [(0, 1, 1, True, 1), (0, 1, 1, True, n)]
    arcs += [(k, 1, 1, True, k + 1) for k in range(1, n - 1)] + [(n + k, 1 if k < n - 2 else 2, 1 if k < n - 2 else 2, True, n + k + 1) for k in range(n - 1)]
    return machine(spark, arcs, {n - 1: True, 2 * n - 1: True}, semiring=S.BOOLEAN)


def no_rounds(monkeypatch, *where):
    def raises(*_, **__):
        raise AssertionError("rounds over the cluster")

    for module, name in where:
        monkeypatch.setattr(module, name, raises)


def test_determinize_ways_agree(spark, monkeypatch):
    """no state is the array of all its members."""
    m = some(spark)
    w = build(spark, S.TROPICAL, {k: dict(zip(("arcs", "finals"), dag(k, n=6, m=12, labels=2)), start=0) for k in range(3)})
    w = w.with_(arcs=w.arcs.withColumn("olabel", w.arcs["ilabel"]))
    near, weighted = product.determinize(m), product.determinize(w)
    assert near.states.schema["state"].dataType.simpleString() == "bigint"
    assert product.is_deterministic(near)
    monkeypatch.setattr(small, "LOCAL_MEMBERS", 2)
    assert keys(product.determinize(m).counts()) == keys(near.counts())
    monkeypatch.setattr(small, "LOCAL_SUBSETS", 0)
    far = product.determinize(m)
    assert far.states.schema["state"].dataType.simpleString() == "bigint"
    assert all(r["same"] for r in graph.isomorphic(near, far).collect())
    assert language(product.determinize(w)) == language(weighted) == language(w)


def test_difference_ways_agree(spark, monkeypatch):
    """a product that fits a task takes no rounds, and its states are numbers."""
    a = some(spark)
    b = product.determinize(some(spark, 9))
    near = product.beside(a, b)
    far = product._beside(a, b)
    assert keys(near.arcs) == keys(far.arcs) and keys(near.states) == keys(far.states)
    no_rounds(monkeypatch, (product, "_beside"), (product, "_determinize"), (distance, "_spread"))
    m = chains(spark)
    left = product.difference(m, machine(spark, [(0, 1, 1, True, 0)], {0: True}, semiring=S.BOOLEAN))
    assert left.states.schema["state"].dataType.simpleString() == "bigint"
    assert [x for x, _ in language(left, 50, plus=max, times=min, one=True)[0]] == [(1,) * 39 + (2,)]
    assert queries.language(product.difference(m, m)).collect() == []


def test_language_of_an_intersection(spark, monkeypatch):
    """the paths of a small product are searched in a task."""
    no_rounds(monkeypatch, (distance, "_shortest_path"), (distance, "_distances"), (product, "_determinize"))
    m = chains(spark)
    both = product.intersect(product.determinize(m), product.determinize(m))
    assert {r["w"] for r in queries.language(both).collect()} == {",".join(["1"] * 39), ",".join(["1"] * 39 + ["2"])}


def test_minimize_in_tasks(spark, monkeypatch):
    """subsets and classes of a small machine take no rounds."""
    no_rounds(monkeypatch, (product, "_determinize"), (product, "_partition"), (distance, "_spread"))
    assert product.minimize(chains(spark)).states.count() == 41


def test_partition_ways_agree(spark, monkeypatch):
    """with cycles and without, by one pass in a task or by rounds."""
    m = some(spark, 20, S.TROPICAL)
    far = keys(product._partition(m.arcs, m.states, True))
    no_rounds(monkeypatch, (product, "_partition"))
    assert keys(product.partition(m)) == far
    assert keys(product.partition(m, dense=False).select("fst_id").distinct()) == keys(m.states.select("fst_id").distinct())


def test_properties_ways_agree(spark, monkeypatch):
    """one pass in a task tells what the relations tell."""
    arcs = [(0, 1, 0, 1.0, 1), (0, 0, 0, 0.0, 1), (1, 2, 2, 0.0, 0), (2, 1, 1, 0.0, 2)]
    more = build(spark, S.TROPICAL, {100: {"arcs": arcs, "start": 0, "finals": {1: 0.0}}, 101: {"arcs": arcs[:1], "start": None, "finals": {}, "states": 3}})
    m = some(spark, 20, S.TROPICAL)
    m = m.with_(arcs=m.arcs.unionByName(more.arcs), states=m.states.unionByName(more.states))
    with monkeypatch.context() as way:
        way.setattr(small, "LOCAL_ROWS", -1)
        far = keys(graph.properties(m))
    no_rounds(monkeypatch, (graph, "_facts"))
    assert keys(graph.properties(m)) == far


def test_language_of_a_minimal_machine(spark, monkeypatch):
    """from alternatives to the strings of the minimal machine without rounds."""
    no_rounds(monkeypatch, (distance, "_shortest_path"), (distance, "_distances"), (distance, "_spread"), (product, "_determinize"), (product, "_partition"))
    assert len(queries.language(product.minimize(chains(spark))).collect()) == 2


def test_language_of_a_deterministic_machine(spark, monkeypatch):
    """F8: the states of a deterministic machine are numbers, so its paths are searched in a task."""
    no_rounds(monkeypatch, (distance, "_shortest_path"), (distance, "_distances"), (product, "_determinize"))
    assert len(queries.language(product.determinize(chains(spark))).collect()) == 2
