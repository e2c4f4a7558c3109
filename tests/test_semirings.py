import math

import pytest
from pyspark.sql import functions as F

from arcflow.errors import InvalidOperation
from arcflow.functions import semiring as S

VALUES = {
    "tropical": [float("inf"), 0.0, 1.5, 3.0], "log": [float("inf"), 0.0, 0.7, 2.0], "probability": [0.0, 1.0, 0.25, 0.5], "real": [0.0, 1.0, -2.0, 0.5], "integer": [0, 1, 2, 5],
    "boolean": [False, True, True, False], "min": [float("inf"), float("-inf"), 1.0, 2.0], "max": [float("-inf"), float("inf"), 1.0, 2.0], "string": [b"\xff", b"", b"abc", b"abd"],
}


def close(a, b):
    if isinstance(a, float) and not (math.isinf(a) or math.isinf(b)):
        return math.isclose(a, b, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", list(S.SEMIRINGS))
def test_laws(spark, name):
    s = S.semiring(name)
    rows = [(a, b, c) for a in VALUES[name] for b in VALUES[name] for c in VALUES[name]]
    df = spark.createDataFrame(rows, f"a {s.type}, b {s.type}, c {s.type}")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    zero, one = s.cast(s.zero), s.cast(s.one)
    laws = [
        (s.plus(a, b), s.plus(b, a)), (s.plus(s.plus(a, b), c), s.plus(a, s.plus(b, c))), (s.plus(a, zero), a), (s.times(a, one), a), (s.times(one, a), a),
        (s.times(a, zero), zero), (s.times(s.times(a, b), c), s.times(a, s.times(b, c))), (s.times(a, s.plus(b, c)), s.plus(s.times(a, b), s.times(a, c))),
    ]
    if name in ("real", "probability", "min", "max"):
        laws = [x for i, x in enumerate(laws) if i != 5 or name != "real"]
    if s.idempotent:
        laws.append((s.plus(a, a), a))
    out = df.select(*(F.struct(x.alias("x"), y.alias("y")).alias(f"l{i}") for i, (x, y) in enumerate(laws))).collect()
    for r in out:
        for i in range(len(laws)):
            assert close(r[f"l{i}"]["x"], r[f"l{i}"]["y"]), (i, r)


@pytest.mark.parametrize("name", list(S.SEMIRINGS))
def test_aggregate_is_plus(spark, name):
    s = S.semiring(name)
    v = VALUES[name]
    df = spark.createDataFrame([(x,) for x in v], f"w {s.type}")
    got = df.agg(s.cast(s.plus_agg(F.col("w"))).alias("w")).first()["w"]
    expr = F.lit(v[0]).cast(s.type)
    for x in v[1:]:
        expr = s.plus(expr, F.lit(x).cast(s.type))
    assert close(got, spark.range(1).select(s.cast(expr).alias("w")).first()["w"])


@pytest.mark.parametrize("variant,want", [("left", [1, 2]), ("right", [5]), ("min", [1, 2, 3, 5]), ("restrict", []), ("union", [1, 2])])
def test_gallic(spark, variant, want):
    g = S.gallic(S.TROPICAL, variant)
    df = spark.createDataFrame([(([1, 2, 3, 5], 1.0),), (([1, 2, 4, 5], 2.0),)], f"w {g.type}")
    got = df.agg(g.plus_agg(F.col("w")).alias("w")).first()["w"]
    assert got["labels"] == want
    two = df.agg(g.plus(F.min_by("w", "w.w"), F.max_by("w", "w.w")).alias("w")).first()["w"]
    assert two["labels"] == want and two["w"] == got["w"]
    one = spark.createDataFrame([(([1, 2, 3], 5.0), ([3], 2.0))], f"a {g.type}, b {g.type}").select(g.divide(F.col("a"), F.col("b")).alias("w")).first()["w"]
    assert one["labels"] == [1, 2] and one["w"] == 3.0


def test_product(spark):
    p = S.product(S.TROPICAL, S.INTEGER)
    df = spark.createDataFrame([((1.0, 2),), ((0.5, 3),)], f"w {p.type}")
    got = df.agg(p.plus_agg(F.col("w")).alias("w")).first()["w"]
    assert (got["w1"], got["w2"]) == (0.5, 5)
    assert S.product(S.TROPICAL, S.MIN).order is not None and p.order is None


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(S.log_from_probability(F.lit(0.0))) == float("inf")
    assert one(S.log_to_probability(F.lit(0.0))) == 1.0
    assert one(S.parse_weight(F.lit("∞"), S.TROPICAL)) == float("inf")
    assert one(S.parse_weight(F.lit("x"), S.REAL)) is None
    assert one(S.parse_weight(F.lit("true"), S.BOOLEAN)) is True
    assert one(S.code_points(F.lit("aé🙂"))) == [97, 233, 128578]
    assert one(S.inverse(F.lit(0.0))) is None
    assert one(S.PROBABILITY.star(F.lit(0.5))) == 2.0
    assert one(S.quantize(F.lit(0.4), "linear", 0, 1, 3)) == 0.5
    with pytest.raises(InvalidOperation):
        S.semiring("none")
    with pytest.raises(InvalidOperation):
        S.INTEGER.need("order")
