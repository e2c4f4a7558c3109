import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arcflow.errors import AlgorithmError, FstError, InvalidOperation
from arcflow.functions import semiring as S
from arcflow.operators import apps, distance, epsilon, graph, product, rational
from arcflow.plans import small
from arcflow.plans.model import build, from_lexicon, from_sequences, renumber

T = S.TROPICAL


def machine(spark, arcs, finals, start=0, semiring=T, states=0):
    return build(spark, semiring, {0: {"arcs": arcs, "start": start, "finals": finals, "states": states}})


def language(fst, limit=12, plus=min, times=lambda a, b: a + b, one=0.0):
    """{fst_id: {(inputs, outputs): weight}} of all paths of at most `limit` arcs, epsilons left out."""
    out = defaultdict(lambda: defaultdict(list))
    after = defaultdict(list)
    for r in fst.arcs.collect():
        after[r["fst_id"], r["src"]].append(r)
    finals = {(r["fst_id"], r["state"]): r["final_weight"] for r in fst.finals.collect()}
    front = [(r["fst_id"], r["state"], (), (), one) for r in fst.starts.collect()]
    for _ in range(limit + 1):
        step = []
        for i, s, x, y, w in front:
            if (i, s) in finals:
                out[i][x, y].append(times(w, finals[i, s]))
            for a in after[i, s]:
                step.append((i, a["dst"], x + ((a["ilabel"],) if a["ilabel"] else ()), y + ((a["olabel"],) if a["olabel"] else ()), times(w, a["weight"])))
        front = step
    total = {}
    for i, own in out.items():
        total[i] = {}
        for k, ws in own.items():
            w = ws[0]
            for v in ws[1:]:
                w = plus(w, v)
            total[i][k] = round(w, 4) if isinstance(w, float) else w
    return total


def dag(seed, n=6, m=9, labels=3, eps=0.0, integer=False):
    rng = random.Random(seed)
    arcs = []
    for _ in range(m):
        a, b = sorted(rng.sample(range(n), 2))
        i, o = (rng.randint(1, labels) if rng.random() >= eps else 0 for _ in range(2))
        arcs.append((a, i, o, rng.randint(1, 4) if integer else float(rng.randint(1, 5)), b))
    return arcs, {n - 1: 1 if integer else 1.0}


def random_fst(spark, seed, acceptor=False, **kw):
    arcs, finals = dag(seed, **kw)
    if acceptor:
        arcs = [(a, i, i, w, b) for a, i, _, w, b in arcs]
    return machine(spark, arcs, finals, semiring=S.INTEGER if kw.get("integer") else T)


def sequences(lang):
    return {k[0]: v for k, v in lang.get(0, {}).items()}


# -- distances and paths -------------------------------------------------------------------------
@pytest.mark.parametrize(
    "semiring,arcs,finals,want",
    [
        (T, [(0, 1, 1, 1.0, 1), (1, 2, 2, 2.0, 2)], {2: 0.5}, {0: 0, 1: 1, 2: 3}),
        (T, [(0, 1, 1, 1.0, 1), (0, 2, 2, 2.0, 1)], {1: 0.0}, {0: 0, 1: 1}),
        (T, [(0, 1, 1, 1.0, 1), (1, 2, 2, 10.0, 0)], {1: 0.0}, {0: 0, 1: 1}),
        (T, [(0, 0, 0, 0.5, 1), (1, 1, 1, 1.0, 2)], {}, {0: 0, 1: 0.5, 2: 1.5}),
        (S.INTEGER, [(0, 1, 1, 1, 1), (0, 2, 2, 1, 2), (1, 3, 3, 1, 3), (2, 4, 4, 1, 3)], {3: 1}, {0: 1, 1: 1, 2: 1, 3: 2}),
        (S.INTEGER, [(0, 1, 1, 3, 1), (0, 2, 2, 5, 1), (1, 3, 3, 2, 2)], {2: 1}, {0: 1, 1: 8, 2: 16}),
        (S.PROBABILITY, [(0, 1, 1, 0.3, 1), (0, 1, 1, 0.4, 1)], {1: 1.0}, {0: 1, 1: 0.7}),
        (S.PROBABILITY, [(0, 1, 1, 0.5, 0), (0, 2, 2, 0.5, 1)], {1: 1.0}, {0: 2, 1: 1}),
        (S.BOOLEAN, [(0, 1, 1, True, 1), (1, 1, 1, True, 0)], {1: True}, {0: True, 1: True}),
    ],
)
def test_shortest_distance(spark, semiring, arcs, finals, want):
    got = {r["state"]: r["weight"] for r in distance.shortest_distance(machine(spark, arcs, finals, semiring=semiring)).collect()}
    assert all(math.isclose(got[s], w, abs_tol=1e-6) for s, w in want.items())


def test_distance_of_unreachable_states_and_no_start(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1)], {1: 0.0}, states=4)
    assert {r["state"]: r["weight"] for r in distance.shortest_distance(m).collect()}[3] == float("inf")
    with pytest.raises(AlgorithmError):
        distance.shortest_distance(machine(spark, [(0, 1, 1, 1.0, 1)], {1: 0.0}, start=None))


@pytest.mark.parametrize(
    "arcs,finals,k,costs",
    [
        ([(0, 1, 1, 1.0, 1), (1, 2, 2, 2.0, 2), (0, 3, 3, 5.0, 2)], {2: 0.0}, 1, [3]),
        ([(0, 1, 1, 1.0, 1), (0, 2, 2, 2.0, 1), (0, 3, 3, 3.0, 1)], {1: 0.0}, 3, [1, 2, 3]),
        ([(0, 1, 1, 1.0, 1), (1, 2, 2, 1.0, 3), (0, 3, 3, 2.0, 2), (2, 4, 4, 1.0, 3)], {3: 0.0}, 2, [2, 3]),
        ([(0, 1, 1, 1.0, 1), (0, 2, 2, 1.0, 2)], {1: 0.5, 2: 2.0}, 2, [1.5, 3]),
        ([(0, 1, 1, 1.0, 1), (1, 2, 2, 1.0, 2), (1, 3, 3, 0.125, 0)], {2: 0.0}, 10, [2]),
        ([(0, 1, 1, 1.0, 1)], {1: 0.0}, 0, []),
    ],
)
def test_shortest_paths(spark, arcs, finals, k, costs):
    got = distance.shortest_path(machine(spark, arcs, finals), k).orderBy("rank").collect()
    assert [r["weight"] for r in got] == costs


def test_unique_paths(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (1, 2, 2, 1.0, 3), (0, 1, 1, 2.0, 2), (2, 2, 2, 2.0, 3)], {3: 0.0})
    assert distance.shortest_path(m, 5).count() == 2
    assert distance.shortest_path(m, 5, unique=True).count() == 1
    back = distance.paths_to_fst(distance.shortest_path(m, 5), m)
    assert language(back) == language(m)


@pytest.mark.parametrize("seed", range(3))
def test_paths_against_enumeration(spark, seed):
    m = random_fst(spark, seed, n=6, m=12)
    every = sorted(w for own in language_paths(m) for w in own)
    assert [round(r["weight"], 4) for r in distance.shortest_path(m, 4).orderBy("rank").collect()] == every[:4]


def language_paths(m):
    after = defaultdict(list)
    for r in m.arcs.collect():
        after[r["src"]].append(r)
    finals = {r["state"]: r["final_weight"] for r in m.finals.collect()}

    def walk(s, w):
        if s in finals:
            yield w + finals[s]
        for a in after[s]:
            yield from walk(a["dst"], w + a["weight"])

    yield list(walk(0, 0.0))


def test_random_paths(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (0, 2, 2, 1.0, 2), (1, 3, 3, 1.0, 3), (2, 4, 4, 1.0, 3), (3, 5, 5, 1.0, 0)], {3: 0.0})
    a = {(r["path"], tuple(r["ilabels"])) for r in distance.random_paths(m, 5, seed=1, weighted=True).collect()}
    assert a == {(r["path"], tuple(r["ilabels"])) for r in distance.random_paths(m, 5, seed=1, weighted=True).collect()}
    assert len(a) == 5 and all(t[-1] in (3, 4) for _, t in a)


# -- rational operations -------------------------------------------------------------------------
def test_rational(spark):
    a = machine(spark, [(0, 1, 1, 1.0, 1)], {1: 0.5})
    b = machine(spark, [(0, 2, 3, 2.0, 1)], {1: 0.0})
    la, lb = sequences(language(a)), sequences(language(b))
    assert sequences(language(rational.union(a, b))) == la | lb
    assert sequences(language(rational.concat(a, b))) == {(1, 2): 3.5}
    star = sequences(language(rational.closure(a), 9))
    assert star[()] == 0 and star[1,] == 1.5 and star[1, 1] == 3.0
    plus = sequences(language(rational.closure_plus(a), 9))
    assert () not in plus and plus[1,] == 1.5 and plus[1, 1] == 3.0
    two = rational.reverse(machine(spark, [(0, 1, 1, 1.0, 1), (1, 2, 2, 3.0, 2)], {2: 2.0}))
    assert sequences(language(two)) == {(2, 1): 6.0}
    assert two.states.count() == 4
    assert language(rational.project(b, "output")) == {0: {((3,), (3,)): 2.0}}
    counts = rational.concat(a, b).counts().first()
    assert counts["n_states"] == 4
    nothing = machine(spark, [], {}, start=None)
    assert sequences(language(rational.concat(a, nothing))) == la
    assert sequences(language(rational.union(a, nothing))) == la


def test_many_machines_at_once(spark):
    m = build(spark, T, {i: {"arcs": [(0, i + 1, i + 1, float(i), 1)], "start": 0, "finals": {1: 0.0}} for i in range(5)})
    got = language(rational.concat(m, m))
    assert {i: list(v) for i, v in got.items()} == {i: [((i + 1,) * 2, (i + 1,) * 2)] for i in range(5)}


def test_arc_operators(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (0, 1, 1, 2.0, 1), (1, 2, 2, 1.0, 2), (1, 2, 2, 1.0, 2), (2, 3, 3, 1.0, 3)], {3: 0.0})
    assert rational.arc_unique(m).arcs.count() == 4
    s = rational.arc_sum(m)
    assert s.arcs.count() == 3
    assert [r["weight"] for r in distance.shortest_distance(s).orderBy("state").collect()] == [0, 1, 2, 3]
    p = machine(spark, [(0, 1, 1, 0.3, 1), (0, 1, 1, 0.4, 1)], {1: 1.0}, semiring=S.PROBABILITY)
    assert rational.arc_sum(p).arcs.first()["weight"] == pytest.approx(0.7)
    c = rational.weight_convert(machine(spark, [(0, 1, 1, 3.7, 1)], {1: 5.2}), F.floor, S.INTEGER)
    assert c.arcs.first()["weight"] == 3 and c.finals.first()["final_weight"] == 5
    arcs = [(0, 3, 1, 1.0, 1), (0, 1, 2, 1.0, 1), (0, 1, 1, 1.0, 1), (0, 3, 1, 2.0, 1)]
    order = lambda by: [r["weight"] * 10 + r["ilabel"] for r in rational.arc_sort(machine(spark, arcs, {1: 0.0}), by).arcs.orderBy("pos").collect()]
    assert order("input") == [11, 11, 13, 23] and order("output") == [13, 11, 23, 11]


def test_encode_decode(spark):
    m = random_fst(spark, 4)
    coded, table = rational.encode(m)
    assert coded.arcs.where("weight <> 0 or ilabel <> olabel or ilabel < 1").isEmpty()
    assert language(rational.decode(coded, table, T, m.finals)) == language(m)
    only, t2 = rational.encode(m, labels=True, weights=False)
    assert only.arcs.where("ilabel <> olabel").isEmpty()
    with pytest.raises(Exception, match="no such code"):
        rational.decode(coded, table.where("code > 2"), T).arcs.collect()


def test_reweight(spark):
    m = machine(spark, [(0, 1, 1, 3.0, 1)], {1: 5.0})
    pot = lambda a, b: spark.createDataFrame([(0, 0, a), (0, 1, b)], "fst_id bigint, state bigint, potential float")
    r = rational.reweight(m, pot(0.0, 2.0), "initial")
    assert r.arcs.first()["weight"] == 5 and r.finals.first()["final_weight"] == 3
    r = rational.reweight(m, pot(1.0, 0.0), "final")
    assert r.arcs.first()["weight"] == 4 and r.finals.first()["final_weight"] == 5
    with pytest.raises(Exception, match="potential"):
        rational.reweight(m, pot(0.0, 2.0).where("state = 0"), "initial").arcs.collect()
    with pytest.raises(InvalidOperation):
        rational.reweight(rational.weight_convert(m, lambda w: w > 0, S.BOOLEAN), pot(0.0, 1.0))


# -- trimming, pruning, pushing ------------------------------------------------------------------
def test_connect(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (2, 2, 2, 1.0, 3)], {1: 0.0})
    assert {r["state"] for r in distance.connect(m).states.collect()} == {0, 1}
    assert distance.connect(machine(spark, [(0, 1, 1, 1.0, 1)], {})).states.isEmpty()
    with pytest.raises(AlgorithmError):
        distance.connect(machine(spark, [(0, 1, 1, 1.0, 1)], {1: 0.0}, start=None))


def test_large_machines_take_the_loops(spark, monkeypatch):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (1, 1, 1, 1.0, 2), (2, 1, 1, 1.0, 1), (2, 1, 1, 1.0, 3), (5, 1, 1, 1.0, 6)], {3: 0.0})
    a, c = distance.accessible(m).collect(), graph.components(m).collect()
    monkeypatch.setattr(small, "LOCAL_ROWS", 1)
    same = lambda x, y: {tuple(r) for r in x} == {tuple(r) for r in y}
    assert same(a, distance.accessible(m).collect()) and same(c, graph.components(m).collect())


def test_prune(spark):
    m = machine(spark, [(0, 1, 1, 1.0, 1), (0, 2, 2, 10.0, 2)], {1: 0.0, 2: 0.0})
    assert {r["state"] for r in distance.prune(m, 5.0).states.collect()} == {0, 1}
    assert {r["state"] for r in distance.prune(m, 9.0, beam=True).states.collect()} == {0, 1, 2}
    assert {r["state"] for r in distance.prune(m, npath=1).states.collect()} == {0, 1}
    assert distance.prune(m, npath=0).states.isEmpty()


@pytest.mark.parametrize("to", ["initial", "final"])
def test_push_keeps_the_language(spark, to):
    m = distance.connect(random_fst(spark, 7))
    pushed = distance.push_weights(m, to)
    assert language(pushed) == language(m)
    if to == "initial":
        best = pushed.arcs.unionByName(pushed.finals.selectExpr("fst_id", "state src", "0 pos", "0 ilabel", "0 olabel", "final_weight weight", "0 dst"))
        least = {r["src"]: r["w"] for r in best.groupBy("src").agg(F.min("weight").alias("w")).collect()}
        assert all(w == 0 for s, w in least.items() if s != 0)


def test_push_labels(spark):
    m = machine(spark, [(0, 1, 0, 0.0, 1), (1, 2, 5, 0.0, 2), (2, 3, 6, 0.0, 3)], {3: 0.0})
    pushed = distance.push_labels(m)
    assert language(pushed) == language(m)
    assert [r["olabel"] for r in pushed.arcs.orderBy("src").collect()][0] == 5


# -- products ------------------------------------------------------------------------------------
def compose_brute(a, b):
    out = {}
    for (x, y), v in a.items():
        for (p, q), w in b.items():
            if y == p:
                out[x, q] = min(out.get((x, q), math.inf), round(v + w, 4))
    return out


def test_compose_fixtures(spark):
    a = machine(spark, [(0, 1, 2, 1.0, 1)], {1: 0.0})
    b = machine(spark, [(0, 2, 3, 2.0, 1)], {1: 0.0})
    assert language(product.compose(a, b)) == {0: {((1,), (3,)): 3.0}}
    with pytest.raises(AlgorithmError):
        product.compose(a, machine(spark, [], {}, start=None))


@pytest.mark.parametrize("seed", range(3))
def test_compose_against_enumeration(spark, seed):
    a, b = random_fst(spark, seed, labels=2, eps=0.3), random_fst(spark, seed + 50, labels=2, eps=0.3)
    want = compose_brute(language(a).get(0, {}), language(b).get(0, {}))
    assert language(product.compose(a, b, epsilon=True), 14).get(0, {}) == want
    counted = product.compose(random_fst(spark, seed, labels=2, eps=0.3, integer=True), random_fst(spark, seed + 50, labels=2, eps=0.3, integer=True), epsilon=True)
    total = distance.total_weight(renumber(counted)).collect()
    pairs = 0
    la, lb = (language(random_fst(spark, s, labels=2, eps=0.3, integer=True), plus=lambda x, y: x + y, times=lambda x, y: x * y, one=1).get(0, {}) for s in (seed, seed + 50))
    for (_, y), v in la.items():
        pairs += sum(v * w for (p, _), w in lb.items() if p == y)
    assert (total[0]["weight"] if total else 0) == pairs  # every path once


def test_compose_with_a_condition(spark):
    a = machine(spark, [(0, 1, 4, 1.0, 1)], {1: 0.0})
    b = machine(spark, [(0, 2, 9, 1.0, 1), (0, 5, 8, 1.0, 1)], {1: 0.0})
    assert language(product.compose(a, b, match=lambda o, i: o < i)) == {0: {((1,), (8,)): 2.0}}


@pytest.mark.parametrize("seed", range(3))
def test_determinize_and_minimize(spark, seed):
    m = random_fst(spark, seed, acceptor=True, n=6, m=12, labels=2)
    det = product.determinize(m)
    assert product.is_deterministic(det)
    assert language(renumber(det)) == language(m)
    low = product.minimize(m)
    assert language(low) == language(m)
    n = low.states.count()
    assert n <= max(1, distance.connect(det).states.count())
    assert product.partition(renumber(low)).select("class").distinct().count() == n


def test_minimize_edge_cases(spark):
    assert product.minimize(machine(spark, [], {}, start=None)).states.isEmpty()
    b = machine(spark, [(0, 1, 1, True, 1), (0, 2, 2, True, 2), (1, 3, 3, True, 3), (2, 3, 3, True, 4)], {3: True, 4: True}, semiring=S.BOOLEAN)
    assert product.minimize(b).states.count() == 3


def test_partition(spark):
    c = {r["state"]: r["class"] for r in product.partition(machine(spark, [(0, 1, 1, 0.0, 1), (0, 2, 2, 0.0, 2)], {1: 0.0, 2: 0.0})).collect()}
    assert c[1] == c[2] != c[0] and set(c.values()) == {0, 1}
    c = {r["state"]: r["class"] for r in product.partition(machine(spark, [(0, 1, 1, 0.0, 2), (1, 1, 1, 0.0, 3)], {2: 0.0, 3: 0.0})).collect()}
    assert c[0] == c[1] and c[2] == c[3]


def test_difference(spark):
    a = machine(spark, [(0, 1, 1, 0.0, 1), (0, 2, 2, 3.0, 1)], {1: 0.0})
    b = machine(spark, [(0, 2, 2, 7.0, 1)], {1: 0.0})
    assert sequences(language(product.difference(a, b))) == {(1,): 0.0}
    assert sequences(language(product.difference(b, a))) == {}
    assert sequences(language(product.difference(b, machine(spark, [(0, 1, 1, 1.0, 1)], {1: 0.0})))) == {(2,): 7.0}
    with pytest.raises(InvalidOperation):
        product.difference(machine(spark, [(0, 1, 2, 0.0, 1)], {1: 0.0}), a)
    with pytest.raises(InvalidOperation):
        product.difference(machine(spark, [], {0: 0.0}), machine(spark, [], {0: 0.0}))


# -- epsilons ------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_remove_epsilons(spark, seed):
    arcs, finals = dag(seed, n=6, m=12)
    arcs = [(a, 0, 0, w, b) if k % 3 == 0 else (a, i, o, w, b) for k, (a, i, o, w, b) in enumerate(arcs)]
    m = machine(spark, arcs, finals)
    r = epsilon.remove_epsilons(m)
    assert r.arcs.where("ilabel = 0 and olabel = 0").isEmpty()
    assert language(r) == language(m)


def test_remove_epsilon_cycle(spark):
    m = machine(spark, [(0, 0, 0, 0.5, 0), (0, 1, 1, 0.5, 1)], {1: 1.0}, semiring=S.PROBABILITY)
    assert epsilon.remove_epsilons(m).arcs.first()["weight"] == pytest.approx(1.0, abs=1e-6)


def test_synchronize(spark):
    m = machine(spark, [(0, 1, 0, 1.0, 1), (1, 2, 0, 1.0, 2), (2, 0, 7, 1.0, 3), (2, 3, 8, 2.0, 3)], {3: 0.5})
    s = epsilon.synchronize(m)
    assert language(s) == language(m)
    assert s.arcs.where("ilabel <> 0 and olabel <> 0").count() >= 2
    with pytest.raises(AlgorithmError):
        epsilon.synchronize(machine(spark, [(0, 1, 0, 1.0, 0)], {0: 0.0}), max_delay=5)


# -- structure -----------------------------------------------------------------------------------
def test_condense(spark):
    one = graph.condense(machine(spark, [(0, 1, 1, 1.0, 1), (1, 2, 2, 1.0, 2), (2, 3, 3, 1.0, 1), (2, 4, 4, 1.0, 3)], {3: 0.0}))
    assert one.states.count() == 3 and one.arcs.where("src = dst").isEmpty()
    assert graph.condense(machine(spark, [(0, 1, 1, 1.0, 0), (0, 2, 2, 1.0, 1)], {1: 0.0})).states.count() == 2


@pytest.mark.parametrize("by", ["breadth", "depth", "topological"])
def test_state_sort(spark, by):
    m = machine(spark, [(0, 1, 1, 1.0, 2), (2, 2, 2, 1.0, 1), (1, 3, 3, 1.0, 3), (0, 4, 4, 1.0, 3)], {3: 0.0}, states=5)
    s = graph.state_sort(m, by)
    assert language(s) == language(m)
    assert sorted(r["state"] for r in s.states.collect()) == list(range(5))
    if by != "breadth":
        assert s.arcs.where("src >= dst").isEmpty()


def test_topsort_of_a_cycle(spark):
    with pytest.raises(AlgorithmError):
        graph.topsort(machine(spark, [(0, 1, 1, 1.0, 1), (1, 1, 1, 1.0, 0)], {1: 0.0}))
    s = graph.topsort(machine(spark, [(0, 1, 1, 1.0, 2), (2, 2, 2, 1.0, 1), (1, 3, 3, 1.0, 2 + 1)], {3: 0.0}))
    assert s.arcs.where("src >= dst").isEmpty()


def test_isomorphic(spark):
    arcs = [(0, 1, 1, 1.0, 1), (1, 2, 2, 1.0, 2), (0, 3, 3, 2.0, 2)]
    a = machine(spark, arcs, {2: 0.0})
    b = machine(spark, [({0: 5, 1: 7, 2: 6}[x], i, o, w, {0: 5, 1: 7, 2: 6}[y]) for x, i, o, w, y in arcs], {6: 0.0}, start=5)
    same = lambda x, y: graph.isomorphic(x, y).first()["same"]
    assert same(a, b)
    assert not same(a, machine(spark, arcs, {2: 1.0}))
    assert not same(a, machine(spark, arcs[:2], {2: 0.0}))


def test_properties(spark):
    p = graph.properties(machine(spark, [(0, 1, 2, 1.0, 1), (1, 0, 0, 0.0, 0)], {1: 0.0}, states=3)).first()
    assert p["cyclic"] and p["epsilons"] and p["weighted"] and not p["acceptor"] and not p["accessible"] and not p["string"]
    p = graph.properties(machine(spark, [(0, 1, 1, 0.0, 1), (1, 2, 2, 0.0, 2)], {2: 0.0})).first()
    assert p["string"] and p["acceptor"] and p["top_sorted"] and p["connected"] and not p["weighted"] and p["functional"]
    p = graph.properties(machine(spark, [], {0: 0.0})).first()
    assert p["acceptor"] and not p["cyclic"] and p["string"]
    assert graph.recommend_storage(machine(spark, [(0, 1, 1, 0.0, 1)], {1: 0.0})).first()["codec"] == "delta"


def test_replace(spark):
    rules = build(spark, T, {
        100: {"arcs": [(0, 1, 1, 0.0, 1), (1, 101, 101, 1.0, 2)], "start": 0, "finals": {2: 0.0}},
        101: {"arcs": [(0, 102, 102, 0.0, 1), (0, 9, 9, 2.0, 1)], "start": 0, "finals": {1: 0.5}},
        102: {"arcs": [(0, 7, 7, 0.0, 1)], "start": 0, "finals": {1: 0.0}},
    })
    assert graph.validate_grammar(rules, 100) == []
    out = graph.replace(rules, 100)
    assert {k[0]: v for k, v in language(out)[100].items()} == {(1, 7): 1.5, (1, 9): 3.5}
    assert graph.replace(rules, 100, remove_epsilon=True).arcs.where("ilabel = 0 and olabel = 0").isEmpty()
    loop = build(spark, T, {1: {"arcs": [(0, 1, 1, 0.0, 1)], "start": 0, "finals": {1: 0.0}}})
    assert graph.validate_grammar(loop, 1) == ["rules are recursive"]
    with pytest.raises(AlgorithmError):
        graph.replace(loop, 1, max_depth=3)
    assert graph.replace(rules, 999).states.count() == 1


# -- applications --------------------------------------------------------------------------------
PAIRS = [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("hello", "hallo", 1), ("abc", "abc", 0), ("abc", "def", 3), ("", "abc", 3), ("abc", "", 3), ("", "", 0)]


def test_edit_distance_and_alignment(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, want int")
    assert all(r["distance"] == r["want"] for r in apps.edit_distance(df, "a", "b").collect())
    for r in apps.edit_lattice(df, "a", "b").collect():
        assert r["cost"] == r["want"] == sum(o != 1 for o in r["ops"])
        assert sum(o in (1, 2, 4) for o in r["ops"]) == len(r["a"]) and sum(o in (1, 2, 3) for o in r["ops"]) == len(r["b"])


def test_spell_check(spark):
    words = ["cat", "car", "cart", "dog", "a", "catalog", "über"]

    def lev(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    targets = ["cat", "crt", "uber", "", "xyzxyz"]
    got = {(r["target"], r["word"]): r["distance"] for r in apps.spell_check(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(t,) for t in targets], "t string"), "t", 2, 100).collect()}
    assert got == {(t, w): lev(t, w) for t in targets for w in words if lev(t, w) <= 2}


def test_text_applications(spark):
    df = spark.createDataFrame([("shchi",), ("",), ("ashx",)], "t string")
    assert [r["result"] for r in apps.transliterate(df, "t", {"shch": "щ", "sh": "ш", "i": "и", "a": "а"}).collect()] == ["щи", "", "ашx"]
    said = apps.pronounce(df.where("t <> ''").withColumnRenamed("t", "word"), "word", spark.createDataFrame([("ashx", "AX"), ("ashx", "ASH")], "word string, pronunciation string"), {"s": "S"})
    assert {(r["word"], r["pronunciation"], r["source"]) for r in said.collect()} == {("ashx", "AX", "lexicon"), ("ashx", "ASH", "lexicon"), ("shchi", "Shchi", "rules")}
    forms = apps.analyze(spark.createDataFrame([("walks",), ("walk",)], "w string"), "w", spark.createDataFrame([("walk",), ("wal",)], "stem string"), spark.createDataFrame([("s",), ("",), ("ks",)], "suffix string"))
    assert {tuple(r) for r in forms.collect()} == {("walks", "walk", "s"), ("walks", "wal", "ks"), ("walk", "walk", "")}


def test_lexicon_and_sequences(spark):
    m = from_lexicon(spark.createDataFrame([("ab",), ("ac",), ("",), (None,)], "w string"), "w", T)
    assert m.states.count() == 4 and m.finals.count() == 3
    assert {k[0] for k in language(m)[0]} == {(), (97, 98), (97, 99)}
    s = from_sequences(spark.createDataFrame([(1, 2, 5), (1, 1, 4), (2, 1, 6)], "fst_id bigint, t int, l int"), ["t"], "l", T)
    assert {i: list(v)[0][0] for i, v in language(s).items()} == {1: (4, 5), 2: (6,)}


def test_errors_have_one_base():
    assert issubclass(AlgorithmError, FstError) and issubclass(InvalidOperation, ValueError)
