"""The registered queries over the package's own operators, each with the DuckDB SQL of the same result.

Machines are made from the ordinary tables: OT (a chain of orders for each customer), GEO (root, regions, nations,
customers), SUP (parallel arcs from brands to supplier nations), EV (transitions between event types), UP (a chain of
events for each user), CV (a chain of roles for each conversation), LEX (the trie of the words of part names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import semiring as S
from .operators import apps, distance, epsilon, graph, lazy, product, rational
from .plans.model import ARC, Fst, arcs_of, build, from_edges, from_sequences, materialize, numbered
from .plans.storage import fresh_path, store
from .sources import formats
from .streaming.run import run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- machines from tables ------------------------------------------------------------------------
def ot(spark, d) -> Fst:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("fst_id"), "o_orderdate", "o_orderkey", F.ascii("o_orderstatus").alias("i"), F.ascii("o_orderpriority").alias("o"), "o_totalprice")
    return from_sequences(o, ["o_orderdate", "o_orderkey"], "i", S.REAL, olabel="o", weight=F.col("o_totalprice"))


OT = """ot AS (
  SELECT o_custkey AS fst_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS src,
    ascii(o_orderstatus)::BIGINT AS ilabel, ascii(o_orderpriority)::BIGINT AS olabel, o_totalprice AS weight,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst
  FROM orders
)"""


def geo(spark, d, semiring=S.TROPICAL, weight: Callable[[Column], Column] = lambda w: w, orphans: bool = False) -> Fst:
    """root 0, regions from 1, nations from 100, customers from 1000; integer weights 1 to 10; customers are final."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    long = lambda x: x.cast("bigint")
    a = r.select(F.lit(0).cast("bigint").alias("s"), long(F.col("r_regionkey") + 1).alias("t"), long(F.col("r_regionkey") + 1).alias("w"))
    b = n.select(long(F.col("n_regionkey") + 1).alias("s"), long(F.col("n_nationkey") + 100).alias("t"), long(F.col("n_nationkey") % 7 + 1).alias("w"))
    e = c.select(long(F.col("c_nationkey") + 100).alias("s"), long(F.col("c_custkey") + 1000).alias("t"), long(F.col("c_custkey") % 10 + 1).alias("w"))
    edges = a.union(b).union(e)
    if orphans:
        edges = edges.union(c.select(long(-F.col("c_custkey")).alias("s"), long(F.col("c_nationkey") + 100).alias("t"), F.lit(1).cast("bigint").alias("w")))
    arcs = arcs_of(edges, semiring, src="s", dst="t", ilabel=F.col("t"), weight=weight(F.col("w")))
    start = spark.range(1).select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state"))
    finals = c.select(F.lit(0).cast("bigint").alias("fst_id"), long(F.col("c_custkey") + 1000).alias("state"), semiring.cast(semiring.one).alias("final_weight"))
    return from_edges(arcs, start, finals, semiring)


GEO = """geo AS (
  SELECT 0::BIGINT AS src, (r_regionkey + 1)::BIGINT AS dst, (r_regionkey + 1)::BIGINT AS w FROM region
  UNION ALL SELECT n_regionkey + 1, n_nationkey + 100, n_nationkey % 7 + 1 FROM nation
  UNION ALL SELECT c_nationkey + 100, c_custkey + 1000, c_custkey % 10 + 1 FROM customer
), d1 AS (SELECT dst AS state, w AS d FROM geo WHERE src = 0),
d2 AS (SELECT g.dst AS state, d1.d, g.w FROM d1 JOIN geo g ON g.src = d1.state),
d3 AS (SELECT g.dst AS state, d2.d AS a, d2.w AS b, g.w AS c FROM d2 JOIN geo g ON g.src = d2.state)"""


def sup(spark, d, semiring=S.REAL, weight: Callable[[Column], Column] = lambda w: w) -> Fst:
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    j = li.join(p.select("p_partkey", "p_brand"), li["l_partkey"] == p["p_partkey"]).join(s.select("s_suppkey", "s_nationkey"), li["l_suppkey"] == s["s_suppkey"])
    arcs = arcs_of(j, semiring, src=F.regexp_extract("p_brand", r"\d+", 0).cast("bigint"), dst=(F.col("s_nationkey") + 1000).cast("bigint"), ilabel=F.ascii("l_returnflag").cast("bigint"), olabel=F.ascii("l_linestatus").cast("bigint"), weight=weight(F.col("l_quantity")), pos=(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint"))
    none = spark.range(0).select(F.col("id").alias("fst_id"), F.col("id").alias("state"))
    return from_edges(arcs, none, none.withColumn("final_weight", F.lit(None).cast(semiring.type)), semiring)


SUP = """sup AS (
  SELECT regexp_extract(p_brand, '[0-9]+')::BIGINT AS src, (s_nationkey + 1000)::BIGINT AS dst, ascii(l_returnflag)::BIGINT AS ilabel,
    ascii(l_linestatus)::BIGINT AS olabel, l_quantity AS w, l_orderkey * 10 + l_linenumber AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def ev(spark, d, semiring=S.TROPICAL) -> Fst:
    """Transitions between event types, named by their first letters; weights -ln of their share, rounded. Clicks start, purchases end."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = e.select(F.ascii("event_type").cast("bigint").alias("s"), F.lead(F.ascii("event_type")).over(w).cast("bigint").alias("t")).where("t is not null").groupBy("s", "t").count()
    share = F.round(-F.ln(F.col("count") / F.sum("count").over(Window.partitionBy("s"))), 3)
    arcs = arcs_of(n.withColumn("w", share), semiring, src="s", dst="t", ilabel=F.col("t"), weight=F.col("w"))
    one = spark.range(1)
    start = one.select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(99).cast("bigint").alias("state"))
    fin = one.select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(112).cast("bigint").alias("state"), semiring.cast(semiring.one).alias("final_weight"))
    return from_edges(arcs, start, fin, semiring)


EV = """steps AS (
  SELECT ascii(event_type)::BIGINT AS src, ascii(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS dst FROM events
), counted AS (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT src, dst, round(-ln(n / sum(n) OVER (PARTITION BY src)), 3) AS w FROM counted)"""


def cv(spark, d, semiring=S.BOOLEAN, odd: int | None = None) -> Fst:
    c = table(spark, d, "conversations")
    if odd is not None:
        c = c.where(F.col("conv_id") % 2 == odd)
    return from_sequences(c.select(F.col("conv_id").alias("fst_id"), "turn", F.ascii("role").alias("i"), "text"), ["turn", "i", "text"], "i", semiring)


def up(spark, d, semiring=S.TROPICAL) -> Fst:
    e = table(spark, d, "events").select(F.col("user_id").alias("fst_id"), "ts", "event_id", F.ascii("event_type").alias("i"))
    return from_sequences(e, ["ts", "event_id"], "i", semiring)


UP = """up AS (
  SELECT user_id AS fst_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS src, ascii(event_type)::BIGINT AS ilabel,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events
), ends AS (SELECT fst_id, max(dst) AS n FROM up GROUP BY 1)"""


def number(df: DataFrame) -> DataFrame:
    """Weights as rounded doubles."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("weight", "final_weight") if c in df.columns})


# -- loop-free operators -------------------------------------------------------------------------
for _side, _label in (("input", "ilabel"), ("output", "olabel")):
    query(f"project_{_side}", f"WITH {OT} SELECT fst_id, src, {_label} AS ilabel, {_label} AS olabel, weight, dst FROM ot")(lambda s, d, side=_side: rational.project(ot(s, d), side).arcs.drop("pos"))


@query("reverse", f"""WITH {OT}, n AS (SELECT fst_id, max(dst) AS n FROM ot GROUP BY 1)
SELECT fst_id, dst AS src, ilabel, olabel, weight, src AS dst FROM ot
UNION ALL SELECT fst_id, n + 1, 0, 0, 1.0, n FROM n""")
def _(s, d):
    return rational.reverse(ot(s, d)).arcs.drop("pos")


query("weight_convert_log", f"WITH {SUP} SELECT pos, src, round(ln(w), 6) AS weight, dst FROM sup")(lambda s, d: rational.weight_convert(sup(s, d), lambda w: F.round(F.ln(w), 6), S.LOG).arcs.select("pos", "src", "weight", "dst"))
query("weight_convert_boolean", f"WITH {SUP} SELECT pos, src, w > 25 AS weight, dst FROM sup")(lambda s, d: rational.weight_convert(sup(s, d), lambda w: w > 25, S.BOOLEAN).arcs.select("pos", "src", "weight", "dst"))
query("weight_convert_integer", f"WITH {SUP} SELECT pos, src, floor(w / 7)::BIGINT AS weight, dst FROM sup")(lambda s, d: rational.weight_convert(sup(s, d), lambda w: F.floor(w / 7), S.INTEGER).arcs.select("pos", "src", "weight", "dst"))

SUMS = {
    "tropical": (S.TROPICAL, lambda w: w, "min(w)"), "min": (S.MIN, lambda w: w, "min(w)"), "max": (S.MAX, lambda w: w, "max(w)"), "real": (S.REAL, lambda w: w, "sum(w)"),
    "probability": (S.PROBABILITY, lambda w: w / 50, "sum(w / 50)"), "integer": (S.INTEGER, lambda w: w, "sum(w)"), "boolean": (S.BOOLEAN, lambda w: w > 49, "bool_or(w > 49)::INT"), "log": (S.LOG, lambda w: w / 10, "-ln(sum(exp(-w / 10)))"),
}
for _name, (_semiring, _weight, _sql) in SUMS.items():
    query(f"arc_sum_{_name}", f"WITH {SUP} SELECT src, ilabel, olabel, dst, round(({_sql})::DOUBLE, 4) AS weight FROM sup GROUP BY 1, 2, 3, 4")(
        lambda s, d, k=_semiring, w=_weight: rational.arc_sum(sup(s, d, k, w)).arcs.select("src", "ilabel", "olabel", "dst", F.round((F.col("weight").cast("int") if k == S.BOOLEAN else F.col("weight")).cast("double"), 4).alias("weight"))
    )

SHIP = "CASE WHEN w < 25 THEN 'ship ' || (w::INT)::VARCHAR ELSE 'sail ' || (w::INT)::VARCHAR END"

@query("arc_sum_string", f"WITH {SUP}, t AS (SELECT src, dst, {SHIP} AS x FROM sup), e AS (SELECT src, dst, min(x) AS a, max(x) AS b FROM t GROUP BY 1, 2) SELECT src, dst, substr(a, 1, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i)))) AS weight FROM e")
def _(s, d):
    w = lambda q: F.when(q < 25, F.concat(F.lit("ship "), q.cast("int").cast("string"))).otherwise(F.concat(F.lit("sail "), q.cast("int").cast("string"))).cast("binary")
    m = sup(s, d, S.STRING, w)
    one = m.with_(arcs=m.arcs.withColumns({"ilabel": F.lit(1).cast("bigint"), "olabel": F.lit(1).cast("bigint")}))
    return rational.arc_sum(one).arcs.select("src", "dst", F.col("weight").cast("string").alias("weight"))


@query("arc_sum_product", f"WITH {SUP} SELECT src, ilabel, olabel, dst, min(w) AS w1, max(w) AS w2 FROM sup GROUP BY 1, 2, 3, 4")
def _(s, d):
    m = sup(s, d, S.product(S.TROPICAL, S.MAX), lambda w: F.struct(w.cast("float").alias("w1"), w.cast("float").alias("w2")))
    return rational.arc_sum(m).arcs.select("src", "ilabel", "olabel", "dst", F.col("weight.w1").cast("double").alias("w1"), F.col("weight.w2").cast("double").alias("w2"))


def gallic_sum(s, d, variant):
    k = S.gallic(S.TROPICAL, variant)
    m = sup(s, d, k, lambda w: F.struct(F.array(F.lit(7).cast("bigint"), F.floor(w / 10).cast("bigint"), F.lit(9).cast("bigint")).alias("labels"), w.cast("float").alias("w")))
    return rational.arc_sum(m).arcs.select("src", "ilabel", "olabel", "dst", F.array_join(F.col("weight.labels").cast("array<string>"), ",").alias("labels"), F.col("weight.w").cast("double").alias("w"))


_ONE = "count(DISTINCT floor(w / 10)) = 1"
_ALL = "'7,' || floor(min(w) / 10)::BIGINT || ',9'"
for _name, _labels, _w in (("left", f"CASE WHEN {_ONE} THEN {_ALL} ELSE '7' END", "min(w)"), ("right", f"CASE WHEN {_ONE} THEN {_ALL} ELSE '9' END", "min(w)"), ("min", _ALL, "min(w)"), ("restrict", f"CASE WHEN {_ONE} THEN {_ALL} ELSE '' END", f"CASE WHEN {_ONE} THEN min(w) ELSE 'Infinity'::DOUBLE END")):
    query(f"arc_sum_gallic_{_name}", f"WITH {SUP} SELECT src, ilabel, olabel, dst, {_labels} AS labels, {_w} AS w FROM sup GROUP BY 1, 2, 3, 4")(lambda s, d, v=_name: gallic_sum(s, d, v))


@query("arc_unique", f"WITH {SUP} SELECT DISTINCT src, ilabel, olabel, w AS weight, dst FROM sup")
def _(s, d):
    return rational.arc_unique(sup(s, d)).arcs.select("src", "ilabel", "olabel", "weight", "dst")


for _by, _keys in rational.SORTS.items():
    query(f"arc_sort_{_by}", f"WITH {SUP} SELECT pos AS old, src, row_number() OVER (PARTITION BY src ORDER BY {', '.join(_keys)}, pos, dst) - 1 AS pos FROM sup")(
        lambda s, d, by=_by: rational.arc_sort((m := sup(s, d)).with_(arcs=m.arcs.withColumn("old", F.col("pos"))), by).arcs.select("old", "src", "pos")
    )


@query("union", f"WITH {UP}, a AS (SELECT * FROM up WHERE fst_id % 2 = 0) SELECT fst_id, src + 1 AS src, ilabel, 0.0::DOUBLE AS weight, dst + 1 AS dst FROM up UNION ALL SELECT fst_id, src + n + 2, ilabel, 0.0, dst + n + 2 FROM a JOIN ends USING (fst_id) UNION ALL SELECT fst_id, 0, 0, 0.0, 1 FROM ends UNION ALL SELECT fst_id, 0, 0, 0.0, n + 2 FROM ends WHERE fst_id % 2 = 0")
def _(s, d):
    m = up(s, d)
    even = m.with_(arcs=m.arcs.where("fst_id % 2 = 0"), states=m.states.where("fst_id % 2 = 0"))
    return number(rational.union(m, even).arcs.select("fst_id", "src", "ilabel", "weight", "dst"))


@query("concat", f"WITH {UP} SELECT fst_id, src, ilabel, dst FROM up UNION ALL SELECT fst_id, src + n + 1, ilabel, dst + n + 1 FROM up JOIN ends USING (fst_id) UNION ALL SELECT fst_id, n, 0, n + 1 FROM ends")
def _(s, d):
    return rational.concat(up(s, d), up(s, d)).arcs.select("fst_id", "src", "ilabel", "dst")


_CLOSED = f"WITH {UP} SELECT fst_id, 'arc' AS kind, src, ilabel, dst FROM up UNION ALL SELECT fst_id, 'arc', n + 1, 0, 0 FROM ends UNION ALL SELECT fst_id, 'arc', n, 0, n + 1 FROM ends UNION ALL "


def closed(m: Fst) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return m.arcs.select("fst_id", F.lit("arc").alias("kind"), "src", "ilabel", "dst").unionByName(m.finals.select("fst_id", F.lit("final").alias("kind"), F.col("state").alias("src"), none.alias("ilabel"), none.alias("dst")))


query("closure", _CLOSED + "SELECT fst_id, 'final', n + 1, NULL, NULL FROM ends")(lambda s, d: closed(rational.closure(up(s, d))))
query("closure_plus", _CLOSED + "SELECT fst_id, 'final', n, NULL, NULL FROM ends")(lambda s, d: closed(rational.closure_plus(up(s, d))))


@query("quantize_linear", f"WITH {SUP} SELECT pos, round(1 + round((least(greatest(w, 1), 40) - 1) / 39 * 7) / 7 * 39, 6) AS weight FROM sup")
def _(s, d):
    return rational.quantize_weights(sup(s, d), "linear", 1, 40, 8).arcs.select("pos", F.round("weight", 6).alias("weight"))


@query("quantize_log", f"WITH {SUP} SELECT pos, round(exp(round(ln(least(greatest(w, 1), 40)) / ln(40) * 15) / 15 * ln(40)), 6) AS weight FROM sup")
def _(s, d):
    return rational.quantize_weights(sup(s, d), "log", 1, 40, 16).arcs.select("pos", F.round("weight", 6).alias("weight"))


_KINDS = f"WITH {OT}, r AS (SELECT *, round(weight / 50000) AS w FROM ot), kinds AS (SELECT ilabel, olabel, w, row_number() OVER (ORDER BY ilabel, olabel, w) AS code FROM (SELECT DISTINCT ilabel, olabel, w FROM r))"


def coarse(s, d) -> Fst:
    return rational.weight_convert(ot(s, d), lambda w: F.round(w / 50000), S.REAL)


query("encode", _KINDS + " SELECT fst_id, src, code AS ilabel, dst FROM r JOIN kinds USING (ilabel, olabel, w)")(lambda s, d: rational.encode(coarse(s, d))[0].arcs.select("fst_id", "src", "ilabel", "dst"))


@query("decode", _KINDS + " SELECT fst_id, src, ilabel, olabel, w AS weight, dst FROM r")
def _(s, d):
    m = coarse(s, d)
    return rational.decode(*rational.encode(m), m.semiring).arcs.select("fst_id", "src", "ilabel", "olabel", "weight", "dst")


_POT = f"WITH {GEO}, v AS (SELECT DISTINCT s AS state, (s % 5)::DOUBLE AS v FROM (SELECT src AS s FROM geo UNION SELECT dst FROM geo))"


def potentials(m: Fst) -> DataFrame:
    return m.states.select("fst_id", "state", (F.col("state") % 5).cast("float").alias("potential"))


query("reweight_initial", _POT + " SELECT src, dst, w + b.v - a.v AS weight FROM geo JOIN v a ON a.state = src JOIN v b ON b.state = dst")(lambda s, d: number(rational.reweight(m := geo(s, d), potentials(m), "initial").arcs.select("src", "dst", "weight")))
query("reweight_final", _POT + " SELECT src, dst, w + a.v - b.v AS weight FROM geo JOIN v a ON a.state = src JOIN v b ON b.state = dst")(lambda s, d: number(rational.reweight(m := geo(s, d), potentials(m), "final").arcs.select("src", "dst", "weight")))


# -- loops over graphs ---------------------------------------------------------------------------
_ORPHAN = f"WITH RECURSIVE {GEO}, g AS (SELECT src, dst FROM geo UNION ALL SELECT -c_custkey, c_nationkey + 100 FROM customer)"
query("accessible", _ORPHAN + ", r AS (SELECT 0::BIGINT AS state UNION SELECT dst FROM r JOIN g ON src = state) SELECT state FROM r")(lambda s, d: distance.accessible(geo(s, d, orphans=True)).select("state"))
query("coaccessible", _ORPHAN + ", r AS (SELECT c_custkey + 1000 AS state FROM customer UNION SELECT src FROM r JOIN g ON dst = state) SELECT state FROM r")(lambda s, d: distance.coaccessible(geo(s, d, orphans=True)).select("state"))
query("connect", _ORPHAN + ", r AS (SELECT 0::BIGINT AS state UNION SELECT dst FROM r JOIN g ON src = state), q AS (SELECT c_custkey + 1000 AS state FROM customer UNION SELECT src FROM q JOIN g ON dst = state) SELECT src, dst FROM g WHERE src IN (FROM r) AND dst IN (FROM r) AND src IN (FROM q) AND dst IN (FROM q)")(lambda s, d: distance.connect(geo(s, d, orphans=True)).arcs.select("src", "dst"))


def _layers(one: str, step: Callable[[str, str], str], agg: Callable[[str], str], first: Callable[[str], str]) -> str:
    a, b, c = first("d"), first("w"), None
    ab = step(a, b)
    c = step(step(first("a"), first("b")), first("c"))
    return f"WITH {GEO} SELECT 0::BIGINT AS state, {one} AS weight UNION ALL SELECT state, round(({agg(first('d'))})::DOUBLE, 4) FROM d1 GROUP BY 1 UNION ALL SELECT state, round(({agg(ab)})::DOUBLE, 4) FROM d2 GROUP BY 1 UNION ALL SELECT state, round(({agg(c)})::DOUBLE, 4) FROM d3 GROUP BY 1"


_plus, _times = lambda a, b: f"({a} + {b})", lambda a, b: f"({a} * {b})"
DISTANCES = {
    "tropical": (S.TROPICAL, lambda w: w, _layers("0.0::DOUBLE", _plus, lambda x: f"min({x})", lambda x: x)),
    "log": (S.LOG, lambda w: w, _layers("0.0::DOUBLE", _plus, lambda x: f"-ln(sum(exp(-({x})::DOUBLE)))", lambda x: x)),
    "min": (S.MIN, lambda w: w, _layers("'-Infinity'::DOUBLE", lambda a, b: f"greatest({a}, {b})", lambda x: f"min({x})", lambda x: x)),
    "max": (S.MAX, lambda w: w, _layers("'Infinity'::DOUBLE", lambda a, b: f"least({a}, {b})", lambda x: f"max({x})", lambda x: x)),
    "integer": (S.INTEGER, lambda w: w, _layers("1.0::DOUBLE", _times, lambda x: f"sum({x})", lambda x: x)),
    "probability": (S.PROBABILITY, lambda w: w / 10, _layers("1.0::DOUBLE", _times, lambda x: f"sum({x})", lambda x: f"({x} / 10)")),
    "real": (S.REAL, lambda w: w / 4, _layers("1.0::DOUBLE", _times, lambda x: f"sum({x})", lambda x: f"({x} / 4)")),
    "boolean": (S.BOOLEAN, lambda w: w > 1, _layers("1.0::DOUBLE", lambda a, b: f"({a} AND {b})", lambda x: f"bool_or({x})::INT", lambda x: f"({x} > 1)")),
}
for _name, (_semiring, _weight, _sql) in DISTANCES.items():
    query(f"shortest_distance_{_name}", _sql)(lambda s, d, k=_semiring, w=_weight: distance.shortest_distance(geo(s, d, k, w)).select("state", F.round((F.col("weight").cast("int") if k == S.BOOLEAN else F.col("weight")).cast("double"), 4).alias("weight")))

_LOOPLESS = f"""WITH RECURSIVE {EV}, p AS (
  SELECT 99::BIGINT AS state, 0.0::DOUBLE AS weight, [99::BIGINT] AS states, []::BIGINT[] AS labels
  UNION ALL SELECT e.dst, p.weight + e.w, list_append(states, e.dst), list_append(labels, e.dst) FROM p JOIN ev e ON e.src = p.state WHERE NOT list_contains(states, e.dst)
)"""
query("shortest_distance_cyclic", _LOOPLESS + " SELECT state, round(min(weight), 3) AS weight FROM p GROUP BY 1")(lambda s, d: distance.shortest_distance(ev(s, d)).select("state", F.round(F.col("weight").cast("double"), 3).alias("weight")))
query("total_weight", f"WITH {GEO} SELECT sum(a * b * c)::BIGINT AS weight FROM d3")(lambda s, d: distance.total_weight(geo(s, d, S.INTEGER)).select("weight"))


def shown(paths: DataFrame) -> DataFrame:
    return paths.select(F.col("rank").cast("bigint").alias("rank"), F.round(F.col("weight").cast("double"), 3).alias("weight"), F.array_join(F.col("ilabels").cast("array<string>"), ",").alias("labels"))


_BEST = " SELECT row_number() OVER (ORDER BY round(weight, 3), labels) AS rank, round(weight, 3) AS weight, array_to_string(labels, ',') AS labels FROM p WHERE state = 112"
query("shortest_path", _LOOPLESS + _BEST + " QUALIFY rank <= 1")(lambda s, d: shown(distance.shortest_path(ev(s, d, S.TROPICAL))))
query("k_shortest_paths", _LOOPLESS + _BEST + " QUALIFY rank <= 8")(lambda s, d: shown(distance.shortest_path(ev(s, d, S.TROPICAL), 8)))
query("k_shortest_unique", _LOOPLESS + _BEST + " QUALIFY rank <= 5")(lambda s, d: shown(distance.shortest_path(ev(s, d, S.TROPICAL), 5, unique=True)))

_THROUGH = f"WITH {GEO}, t AS (SELECT n.src AS reg, g.src AS nat, g.dst AS cus, r.w AS a, n.w AS b, g.w AS c FROM geo g JOIN geo n ON n.dst = g.src JOIN geo r ON r.dst = n.src)"
_KEPT = "SELECT DISTINCT * FROM (SELECT 0::BIGINT AS src, reg AS dst FROM k UNION ALL SELECT reg, nat FROM k UNION ALL SELECT nat, cus FROM k)"
query("prune_threshold", _THROUGH + f", k AS (SELECT * FROM t WHERE a + b + c <= 6) {_KEPT}")(lambda s, d: distance.prune(geo(s, d), 6.0).arcs.select("src", "dst"))
query("prune_beam", _THROUGH + f", k AS (SELECT * FROM t WHERE a + b + c <= (SELECT min(a + b + c) FROM t) + 5) {_KEPT}")(lambda s, d: distance.prune(geo(s, d), 5.0, beam=True).arcs.select("src", "dst"))
query("prune_npath", _LOOPLESS + ", k AS (SELECT * FROM p WHERE state = 112 ORDER BY round(weight, 3), labels LIMIT 3) SELECT DISTINCT states[i] AS src, states[i + 1] AS dst FROM (SELECT states, unnest(range(1, len(states))) AS i FROM k)")(lambda s, d: distance.prune(ev(s, d), npath=3).arcs.select("src", "dst"))
query("push_weights", _THROUGH + """, best AS (SELECT min(a + b + c) AS m FROM t)
SELECT 0::BIGINT AS src, reg AS dst, min(a + b + c)::DOUBLE AS weight FROM t GROUP BY reg
UNION ALL SELECT reg, nat, (min(b + c) - (SELECT min(u.b + u.c) FROM t u WHERE u.reg = t.reg))::DOUBLE FROM t GROUP BY reg, nat
UNION ALL SELECT nat, cus, (c - (SELECT min(u.c) FROM t u WHERE u.nat = t.nat))::DOUBLE FROM t""")(lambda s, d: number(distance.push_weights(geo(s, d)).arcs.select("src", "dst", "weight")))


_ROLES = "r AS (SELECT conv_id AS fst_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, ascii(role), text) - 1 AS src, ascii(role)::BIGINT AS i FROM conversations)"


@query("push_labels", f"WITH {_ROLES} SELECT fst_id, string_agg(i::VARCHAR, ',' ORDER BY src) AS outputs, min(i) FILTER (WHERE src = 0) AS first FROM r GROUP BY 1")
def _(s, d):
    """Chains whose outputs come one arc late: pushing brings each back to its own arc."""
    some = cv(s, d, S.TROPICAL)
    w = Window.partitionBy("fst_id").orderBy("src")
    late = some.arcs.withColumn("olabel", F.coalesce(F.lag("ilabel").over(w), F.lit(0).cast("bigint")))
    last = some.finals.withColumnRenamed("state", "dst").join(some.arcs, ["fst_id", "dst"]).select("fst_id", F.col("dst").alias("src"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("ilabel"), F.col("ilabel").alias("olabel"), "weight", (F.col("dst") + 1).alias("dst"))
    ends = last.select("fst_id", F.col("dst").alias("state"), F.lit(False).alias("is_start"), F.col("weight").alias("final_weight"))
    states = some.states.withColumn("final_weight", F.lit(None).cast("float")).unionByName(ends)
    pushed = distance.push_labels(some.with_(arcs=late.unionByName(last.select(*ARC)), states=states))
    out = pushed.arcs.groupBy("fst_id").agg(F.sort_array(F.collect_list(F.struct("src", "olabel"))).alias("x"), F.min_by("olabel", "src").alias("first"))
    text = F.array_join(F.transform(F.filter("x", lambda v: v["olabel"] != 0), lambda v: v["olabel"].cast("string")), ",")
    return out.select("fst_id", text.alias("outputs"), "first")


@query("remove_epsilons", f"WITH {UP} SELECT fst_id, src, ilabel, dst FROM up UNION ALL SELECT fst_id, src + n + 1, ilabel, dst + n + 1 FROM up JOIN ends USING (fst_id) UNION ALL SELECT fst_id, n, ilabel, dst + n + 1 FROM up JOIN ends USING (fst_id) WHERE src = 0")
def _(s, d):
    return epsilon.remove_epsilons(rational.concat(up(s, d), up(s, d))).arcs.select("fst_id", "src", "ilabel", "dst")


# -- products ------------------------------------------------------------------------------------
def rules(m: Fst, semiring) -> Fst:
    """One state, an arc from each order priority to its class, for every machine of m."""
    ids = m.states.select("fst_id").distinct()
    each = ids.select("fst_id", F.explode(F.sequence(F.lit(49).cast("bigint"), F.lit(53).cast("bigint"))).alias("p"))
    arcs = each.select("fst_id", F.lit(0).cast("bigint").alias("src"), F.col("p").alias("pos"), F.col("p").alias("ilabel"), F.when(F.col("p") <= 50, 1).otherwise(2).cast("bigint").alias("olabel"), semiring.cast(F.col("p") - 48).alias("weight"), F.lit(0).cast("bigint").alias("dst"))
    states = ids.select("fst_id", F.lit(0).cast("bigint").alias("state"), F.lit(True).alias("is_start"), semiring.cast(semiring.one).alias("final_weight"))
    return Fst(arcs, states, semiring)


@query("compose", f"WITH {OT} SELECT fst_id, src, ilabel, CASE WHEN olabel <= 50 THEN 1 ELSE 2 END::BIGINT AS olabel, round(weight * (olabel - 48), 2) AS weight, dst FROM ot")
def _(s, d):
    m = ot(s, d)
    return product.compose(m, rules(m, m.semiring)).arcs.select("fst_id", "src.s1", "ilabel", "olabel", F.round("weight", 2).alias("weight"), F.col("dst.s1").alias("dst")).withColumnRenamed("s1", "src")


@query("compose_epsilon", f"WITH {OT} SELECT fst_id, src, ilabel, CASE WHEN olabel <= 50 THEN 1 ELSE 2 END::BIGINT AS olabel, dst FROM ot")
def _(s, d):
    m = ot(s, d)
    return product.compose(m, rules(m, m.semiring), epsilon=True).arcs.select("fst_id", F.col("src.s1").alias("src"), "ilabel", "olabel", F.col("dst.s1").alias("dst"))


_CV = "lang AS (SELECT conv_id, string_agg(ascii(role)::VARCHAR, ',' ORDER BY turn, ascii(role), text) AS w, count(*) AS n FROM conversations GROUP BY 1)"


def pool(m: Fst) -> Fst:
    """All chains of a collection as alternatives of one machine."""
    key = lambda c: F.when(F.col(c) == 0, F.lit("start")).otherwise(F.concat_ws("/", F.col("fst_id").cast("string"), F.col(c).cast("string")))
    arcs = m.arcs.select(F.lit(0).cast("bigint").alias("fst_id"), key("src").alias("src"), F.col("fst_id").alias("pos"), "ilabel", "olabel", "weight", key("dst").alias("dst"))
    fin = m.finals.select(F.lit(0).cast("bigint").alias("fst_id"), key("state").alias("state"), "final_weight")
    return from_edges(arcs, m.spark.range(1).select(F.lit(0).cast("bigint").alias("fst_id"), F.lit("start").alias("state")), fin, m.semiring)


def language(m: Fst) -> DataFrame:
    """The accepted label strings of an acyclic acceptor; none if nothing starts."""
    if m.starts.isEmpty():
        return m.spark.createDataFrame([], "w string")
    one = rational.weight_convert(numbered(m), lambda w: F.lit(0.0), S.TROPICAL)
    return distance.shortest_path(one, None, unique=True).select(F.array_join(F.col("ilabels").cast("array<string>"), ",").alias("w")).distinct()


query("intersect", f"WITH {_CV} SELECT DISTINCT w FROM lang WHERE conv_id % 2 = 0 INTERSECT SELECT w FROM lang WHERE conv_id % 2 = 1")(lambda s, d: language(product.intersect(product.determinize(pool(cv(s, d, odd=0))), product.determinize(pool(cv(s, d, odd=1))))))
query("difference", f"WITH {_CV} SELECT DISTINCT w FROM lang WHERE conv_id % 2 = 0 EXCEPT SELECT w FROM lang WHERE conv_id % 2 = 1")(lambda s, d: language(product.difference(product.determinize(pool(cv(s, d, odd=0))), pool(cv(s, d, odd=1)))))

_PREFIX = f"WITH {_CV}, l AS (SELECT DISTINCT string_split(w, ',') AS w FROM lang), pre AS (SELECT DISTINCT array_to_string(w[1:i], ',') AS p, w[i + 1] IS NULL AS whole FROM (SELECT w, unnest(range(0, len(w) + 1)) AS i FROM l))"


@query("determinize", _PREFIX + " SELECT count(DISTINCT p)::BIGINT AS n_states, (count(DISTINCT p) - 1)::BIGINT AS n_arcs, (count(*) FILTER (WHERE whole))::BIGINT AS n_finals FROM pre")
def _(s, d):
    return product.determinize(pool(cv(s, d))).counts().select("n_states", "n_arcs", "n_finals")


@query("minimize", f"WITH {_CV}, l AS (SELECT DISTINCT string_split(w, ',') AS w FROM lang), pre AS (SELECT DISTINCT array_to_string(w[1:i], ',') AS p, array_to_string(w[i + 1:], ',') AS rest FROM (SELECT w, unnest(range(0, len(w) + 1)) AS i FROM l)), fut AS (SELECT p, list_sort(list(rest)) AS f FROM pre GROUP BY p) SELECT count(DISTINCT f)::BIGINT AS n_states FROM fut")
def _(s, d):
    return product.minimize(pool(cv(s, d))).counts().select("n_states")


@query("partition", f"WITH {UP} SELECT fst_id, (max(dst) + 1)::BIGINT AS n_classes FROM up GROUP BY 1")
def _(s, d):
    return product.partition(up(s, d)).groupBy("fst_id").agg(F.countDistinct("class").alias("n_classes"))


# -- structure -----------------------------------------------------------------------------------
@query("condense", f"WITH RECURSIVE {EV}, reach AS (SELECT src AS a, dst AS b FROM ev UNION SELECT a, dst FROM reach JOIN ev ON src = b), ids AS (SELECT src AS s FROM ev UNION SELECT dst FROM ev) SELECT count(DISTINCT c)::BIGINT AS n_states FROM (SELECT s, least(s, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = s), s)) AS c FROM ids)")
def _(s, d):
    return graph.condense(ev(s, d)).states.agg(F.count("*").alias("n_states"))


_TWO = "WITH RECURSIVE e AS (SELECT DISTINCT (l_partkey % 97)::BIGINT AS src, (l_suppkey % 89 + 20)::BIGINT AS dst FROM lineitem), ids AS (SELECT src AS s FROM e UNION SELECT dst FROM e), reach AS (SELECT s AS a, s AS b FROM ids UNION SELECT a, dst FROM reach JOIN e ON src = b)"


@query("components", _TWO + " SELECT x.a AS state, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem")
    arcs = arcs_of(li, S.BOOLEAN, src=(F.col("l_partkey") % 97).cast("bigint"), dst=(F.col("l_suppkey") % 89 + 20).cast("bigint"))
    none = s.range(0).select(F.col("id").alias("fst_id"), F.col("id").alias("state"))
    m = from_edges(arcs, none, none.withColumn("final_weight", F.lit(None).cast("boolean")), S.BOOLEAN)
    c = store(graph.components(m), "c")
    return c.join(c.groupBy("component").agg(F.min("state").alias("least")), "component").select("state", F.col("least").alias("component"))


_DEPTH = f"WITH {GEO} SELECT 0::BIGINT AS state, 0::BIGINT AS level UNION ALL SELECT state, 1 FROM d1 UNION ALL SELECT state, 2 FROM d2 UNION ALL SELECT state, 3 FROM d3"
query("topological_levels", _DEPTH)(lambda s, d: graph.topological_levels(geo(s, d)).select("state", "level"))
query("breadth_levels", _DEPTH)(lambda s, d: graph.breadth_levels(geo(s, d)).select("state", "level"))


def ordered(m: Fst) -> DataFrame:
    """Whether all arcs go up, and the numbers used."""
    return m.arcs.agg(F.bool_and(F.col("src") < F.col("dst")).alias("up"), F.count("*").alias("n_arcs"), F.max("dst").alias("last"))


_UPWARD = f"WITH {GEO} SELECT TRUE AS up, count(*)::BIGINT AS n_arcs, count(*)::BIGINT AS last FROM geo"
query("topsort", _UPWARD)(lambda s, d: ordered(graph.topsort(geo(s, d))))
query("state_sort_breadth", _UPWARD)(lambda s, d: ordered(graph.state_sort(geo(s, d), "breadth")))
query("state_sort_depth", _UPWARD)(lambda s, d: ordered(graph.state_sort(geo(s, d), "depth")))


@query("isomorphic", f"WITH {_CV}, x AS (SELECT (conv_id - conv_id % 2) // 2 AS k, max(w) FILTER (WHERE conv_id % 2 = 0) AS a, max(w) FILTER (WHERE conv_id % 2 = 1) AS b FROM lang GROUP BY 1) SELECT k::BIGINT AS fst_id, a IS NOT DISTINCT FROM b AS same FROM x")
def _(s, d):
    half = lambda m: m.with_(arcs=m.arcs.withColumn("fst_id", F.floor(F.col("fst_id") / 2)), states=m.states.withColumn("fst_id", F.floor(F.col("fst_id") / 2)))
    return graph.isomorphic(half(cv(s, d, odd=0)), half(cv(s, d, odd=1)))


@query("properties", f"WITH {UP} SELECT fst_id, (n + 1)::BIGINT AS n_states, n::BIGINT AS n_arcs, 1::BIGINT AS n_finals, FALSE AS epsilons, TRUE AS acceptor, FALSE AS weighted, FALSE AS cyclic, TRUE AS accessible, TRUE AS coaccessible, TRUE AS input_deterministic, TRUE AS top_sorted, TRUE AS string FROM ends")
def _(s, d):
    return graph.properties(up(s, d)).select("fst_id", "n_states", "n_arcs", "n_finals", "epsilons", "acceptor", "weighted", "cyclic", "accessible", "coaccessible", "input_deterministic", "top_sorted", "string")


@query("degree_statistics", f"WITH {SUP}, s AS (SELECT src AS state FROM sup UNION SELECT dst FROM sup), g AS (SELECT state, count(src) AS n FROM s LEFT JOIN sup ON src = state GROUP BY 1), l AS (SELECT ilabel, count(*) AS n FROM sup GROUP BY 1) SELECT round(avg(n), 4) AS mean_degree, max(n)::BIGINT AS max_degree, round(stddev_pop(n), 4) AS sd_degree, (SELECT count(*) FROM l)::BIGINT AS n_labels, (SELECT round(-sum(n / t * log2(n / t)), 4) FROM l, (SELECT sum(n) AS t FROM l)) AS entropy FROM g")
def _(s, d):
    return graph.degree_statistics(sup(s, d)).select(F.round("mean_degree", 4).alias("mean_degree"), "max_degree", F.round("sd_degree", 4).alias("sd_degree"), "n_labels", F.round("entropy", 4).alias("entropy"))


@query("synchronize", f"WITH {_ROLES} SELECT fst_id, string_agg(i::VARCHAR, ',' ORDER BY src) AS ins, string_agg((i + 1000)::VARCHAR, ',' ORDER BY src) AS outs, count(*)::BIGINT AS n FROM r GROUP BY 1")
def _(s, d):
    """Chains that read a label on one arc and write on the next, brought together and read off: one arc for each label."""
    c = table(s, d, "conversations").select(F.col("conv_id").alias("fst_id"), "turn", F.ascii("role").alias("r"), "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    c = c.withColumns({"i": F.when(F.col("k") == 0, F.col("r")).otherwise(0), "o": F.when(F.col("k") == 1, F.col("r") + 1000).otherwise(0)})
    m = from_sequences(c, ["turn", "r", "text", "k"], "i", S.TROPICAL, olabel="o")
    paths = distance.shortest_path(epsilon.synchronize(m))
    pairs = F.size(F.filter(F.arrays_zip("ilabels", "olabels"), lambda x: (x["ilabels"] != 0) & (x["olabels"] == x["ilabels"] + 1000))).cast("bigint")
    text = lambda c: F.array_join(F.filter(F.col(c), lambda x: x != 0).cast("array<string>"), ",")
    return paths.select("fst_id", text("ilabels").alias("ins"), text("olabels").alias("outs"), pairs.alias("n"))


@query("replace", "SELECT '7,' || (n_nationkey + 1000)::VARCHAR || ',8' AS w FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(s, d):
    """A sentence (7 REGION 8) whose REGION is a choice of regions, each a choice of nations."""
    r, n = table(s, d, "region"), table(s, d, "nation")
    long = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
    row = lambda f, a, i, b: (long(f).alias("f"), long(a).alias("s"), long(i).alias("i"), long(b).alias("t"))
    lit = lambda x: F.lit(x)
    one = s.range(1)
    edges = one.select(*row(lit(100), lit(0), lit(7), lit(1))).union(one.select(*row(lit(100), lit(1), lit(101), lit(2)))).union(one.select(*row(lit(100), lit(2), lit(8), lit(3))))
    edges = edges.union(r.select(*row(lit(101), lit(0), F.col("r_regionkey") + 200, lit(1)))).union(n.select(*row(F.col("n_regionkey") + 200, lit(0), F.col("n_nationkey") + 1000, lit(1))))
    arcs = arcs_of(edges, S.TROPICAL, fst_id="f", src="s", dst="t", ilabel="i", pos="i")
    ids = edges.select("f").distinct()
    fin = ids.select(F.col("f").alias("fst_id"), F.when(F.col("f") == 100, 3).otherwise(1).cast("bigint").alias("state"), F.lit(0.0).cast("float").alias("final_weight"))
    m = from_edges(arcs, ids.select(F.col("f").alias("fst_id"), F.lit(0).cast("bigint").alias("state")), fin, S.TROPICAL)
    return language(epsilon.remove_epsilons(graph.replace(m, 100)))


# -- formats -------------------------------------------------------------------------------------
def small_ot(s, d) -> Fst:
    return rational.weight_convert(ot(s, d), lambda w: F.floor(w), S.TROPICAL)


_OT_FLOOR = f"WITH {OT} SELECT fst_id, src, ilabel, olabel, floor(weight)::FLOAT::DOUBLE AS weight, dst FROM ot"


def plain_arcs(m: Fst) -> DataFrame:
    return m.arcs.select("fst_id", F.col("src").cast("bigint").alias("src"), "ilabel", "olabel", F.col("weight").cast("double").alias("weight"), F.col("dst").cast("bigint").alias("dst"))


query("text_roundtrip", _OT_FLOOR)(lambda s, d: plain_arcs(formats.parse_text(formats.text_lines(small_ot(s, d)), S.TROPICAL)))
query("binary_roundtrip", _OT_FLOOR)(lambda s, d: plain_arcs(formats.parse_binary(formats.to_binary(small_ot(s, d)), S.TROPICAL)))
query("tropical_roundtrip", _OT_FLOOR)(lambda s, d: plain_arcs(formats.parse_binary(formats.to_binary(small_ot(s, d), "tropical"), S.TROPICAL, "tropical")))


@query("parquet_roundtrip", _OT_FLOOR)
def _(s, d):
    formats.write_parquet(small_ot(s, d), path := fresh_path(s, "parquet"))
    return plain_arcs(formats.read_parquet(s, path, S.TROPICAL))


query("symbol_table", "SELECT 0::BIGINT AS label, '<eps>' AS symbol UNION ALL SELECT row_number() OVER (ORDER BY p_type), p_type FROM (SELECT DISTINCT p_type FROM part)")(lambda s, d: formats.symbol_table(table(s, d, "part"), "p_type").select("label", "symbol"))

# -- applications --------------------------------------------------------------------------------
_WORDS = "words AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '')"
TARGETS = ["rin", "smal", "widgt", "bluue", "grae"]


def part_words(s, d) -> DataFrame:
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''").select(F.lower("w").alias("w")).distinct()


@query("spell_check", f"WITH {_WORDS}, t AS (SELECT unnest(['rin', 'smal', 'widgt', 'bluue', 'grae']) AS target) SELECT target, w AS word, levenshtein(target, w)::BIGINT AS distance FROM t, words WHERE levenshtein(target, w) <= 2")
def spell_check(s, d):
    return apps.spell_check(part_words(s, d), "w", s.createDataFrame([(t,) for t in TARGETS], "target string"), "target", 2, 1000)


@query("edit_distance", f"WITH {_WORDS}, t AS (SELECT unnest(['rin', 'smal', 'widgt', 'bluue', 'grae']) AS target) SELECT target, w, levenshtein(target, w)::BIGINT AS distance FROM t, words")
def _(s, d):
    t = part_words(s, d).withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    return apps.edit_distance(t, "target", "w").select("target", "w", "distance")


@query("alignment", f"WITH {_WORDS}, t AS (SELECT unnest(['rin', 'smal', 'widgt', 'bluue', 'grae']) AS target) SELECT target, w, levenshtein(target, w)::BIGINT AS cost, length(target)::BIGINT AS read, length(w)::BIGINT AS written FROM t, words")
def _(s, d):
    t = part_words(s, d).withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    count = lambda *ops: F.size(F.filter("ops", lambda o: o.isin(*ops))).cast("bigint")
    return apps.edit_lattice(t, "target", "w").select("target", "w", count(2, 3, 4).alias("cost"), count(1, 2, 4).alias("read"), count(1, 2, 3).alias("written"))


query("transliterate", "SELECT DISTINCT p_name, replace(replace(replace(p_name, 'ee', 'i'), 'l', 'r'), 'w', 'vv') AS result FROM part")(lambda s, d: apps.transliterate(table(s, d, "part").select("p_name").distinct(), "p_name", {"ee": "i", "l": "r", "w": "vv"}))


def shift(s, a: str, b: str) -> Fst:
    """A rule that writes b for a, over the lower-case letters."""
    letters = s.range(97, 123).select(F.col("id").alias("c"))
    arcs = arcs_of(letters, S.TROPICAL, src=F.lit(0).cast("bigint"), dst=F.lit(0).cast("bigint"), pos="c", ilabel="c", olabel=F.when(F.col("c") == ord(a), ord(b)).otherwise(F.col("c")).cast("bigint"))
    one = s.range(1).select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state"))
    return from_edges(arcs, one, one.withColumn("final_weight", F.lit(0.0).cast("float")), S.TROPICAL)


@query("rule_cascade", f"WITH {_WORDS} SELECT w, replace(replace(replace(w, 'a', 'e'), 'e', 'i'), 'i', 'o') AS result FROM words")
def _(s, d):
    """Vowel shifts as transducers over the letters: a to e, then e to i, then i to o."""
    w = store(part_words(s, d).withColumn("fst_id", F.xxhash64("w")), "words")
    out = distance.shortest_path(apps.apply_rules(apps.string_acceptors(w, "fst_id", "w"), [shift(s, "a", "e"), shift(s, "e", "i"), shift(s, "i", "o")]))
    return out.select("fst_id", F.array_join(F.transform("olabels", lambda c: F.char(c)), "").alias("result")).join(w, "fst_id").select("w", "result")


@query("random_paths")
def _(s, d):
    """Random walks over event types from a click to a purchase; each is a path of the machine (tested)."""
    return distance.random_paths(ev(s, d), 20, seed=7).select("path", F.array_join(F.col("ilabels").cast("array<string>"), ",").alias("labels"))



# -- further operators, helpers and options ------------------------------------------------------
query("arc_sum_gallic_union", f"WITH {SUP} SELECT src, ilabel, olabel, dst, CASE WHEN {_ONE} THEN {_ALL} ELSE '7' END AS labels, min(w) AS w FROM sup GROUP BY 1, 2, 3, 4")(lambda s, d: gallic_sum(s, d, "union"))


@query("weight_helpers", """SELECT p_partkey, round(1 / x, 6) AS inverse, round(1 / (1 - x), 6) AS real_star, CASE WHEN x >= 1 THEN 'Infinity'::DOUBLE ELSE round(1 / (1 - x), 6) END AS probability_star,
  round(-ln(x), 6) AS log, round(exp(-x), 6) AS back, round(-ln(1 - exp(-x)), 6) * -1 AS log_star, p_size / 7.0 AS fraction
FROM (SELECT p_partkey, p_size, p_retailprice / 1000 AS x FROM part) WHERE x <> 1""".replace("round(-ln(1 - exp(-x)), 6) * -1", "round(ln(1 - exp(-x)), 6)").replace("p_size / 7.0", "round(p_size / 7, 6)"))
def _(s, d):
    x = F.col("p_retailprice") / 1000
    r = lambda c, n: F.round(c, 6).alias(n)
    rows = table(s, d, "part").where(x != 1)
    return rows.select("p_partkey", r(S.inverse(x), "inverse"), r(S.REAL.star(x), "real_star"), r(S.PROBABILITY.star(x), "probability_star"), r(S.log_from_probability(x), "log"), r(S.log_to_probability(x), "back"), r(S.LOG.star(x), "log_star"), r(S.real_from_fraction(F.col("p_size"), F.lit(7)), "fraction"))


query("compose_filter", f"WITH {OT} SELECT fst_id, src, ilabel, CASE WHEN olabel <= 50 THEN 1 ELSE 2 END::BIGINT AS olabel, dst FROM ot")(
    lambda s, d: product.compose(m := ot(s, d), rational.transform_arcs(rules(m, m.semiring), ilabel=F.col("ilabel") - 48), match=lambda o, i: o - 48 == i).arcs.select("fst_id", F.col("src.s1").alias("src"), "ilabel", "olabel", F.col("dst.s1").alias("dst"))
)


@query("compose_insertions", f"WITH {OT} SELECT fst_id, src AS s1, 0 AS s2, ilabel, olabel, dst AS d1, 1 AS d2 FROM ot UNION ALL SELECT fst_id, dst, 1, 0, 7, dst, 0 FROM ot")
def _(s, d):
    """A machine that writes 7 behind every label, on an arc that reads nothing."""
    m = ot(s, d)
    letters = s.range(49, 54).select(F.lit(0).alias("s"), F.lit(1).alias("t"), F.col("id").alias("i"), F.col("id").alias("o"))
    edges = letters.union(s.range(1).select(F.lit(1).alias("s"), F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("i"), F.lit(7).cast("bigint").alias("o")))
    arcs = arcs_of(edges, m.semiring, src=F.col("s").cast("bigint"), dst=F.col("t").cast("bigint"), ilabel="i", olabel="o", pos="i")
    one = s.range(1).select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state"))
    rule = from_edges(arcs, one, one.withColumn("final_weight", F.lit(1.0)), m.semiring)
    a = product.compose(m, rule, epsilon=True, shared=True).arcs
    # The filter's mark tells how a state was reached, so the same arc may leave two marks of a state.
    return a.select("fst_id", "src.s1", F.col("src.s2").cast("int").alias("s2"), "ilabel", "olabel", F.col("dst.s1").alias("d1"), F.col("dst.s2").cast("int").alias("d2")).distinct()


query("determinize_language", f"WITH {_CV} SELECT DISTINCT w FROM lang")(lambda s, d: language(product.determinize(pool(cv(s, d)))))
query("minimize_language", f"WITH {_CV} SELECT DISTINCT w FROM lang")(lambda s, d: language(product.minimize(pool(cv(s, d)))))


@query("minimize_cycles", "SELECT s_suppkey AS fst_id, 3::BIGINT AS n_states, (s_nationkey + 4)::DOUBLE AS best FROM supplier")
def _(s, d):
    """By supplier: x/1 and y/2 to two states that read z at weights 3 and 2 into a final, from which w leads back; the two
    states have the same future up to a weight, so three states suffice. The final weighs the supplier's nation."""
    sup_ = table(s, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("fst_id"), F.col("s_nationkey").alias("n"))
    arc = lambda a, i, w, b: F.struct(F.lit(a).cast("bigint").alias("s"), F.lit(i).cast("bigint").alias("i"), F.lit(w).cast("float").alias("w"), F.lit(b).cast("bigint").alias("t"))
    edges = sup_.select("fst_id", F.explode(F.array(arc(0, 1, 1.0, 1), arc(0, 2, 2.0, 2), arc(1, 3, 3.0, 3), arc(2, 3, 2.0, 3), arc(3, 4, 0.5, 0))).alias("e")).select("fst_id", "e.*")
    arcs = arcs_of(edges, S.TROPICAL, fst_id="fst_id", src="s", dst="t", ilabel="i", pos="i", weight="w")
    m = from_edges(arcs, sup_.select("fst_id", F.lit(0).cast("bigint").alias("state")), sup_.select("fst_id", F.lit(3).cast("bigint").alias("state"), F.col("n").cast("float").alias("final_weight")), S.TROPICAL)
    least = product.minimize(m)
    best = distance.shortest_path(least).select("fst_id", F.round(F.col("weight").cast("double"), 3).alias("best"))
    return least.counts().select("fst_id", "n_states").join(best, "fst_id")


@query("isomorphic_ties", "SELECT s_suppkey AS fst_id, s_suppkey % 3 <> 0 AS same FROM supplier")
def _(s, d):
    """Two arcs of the same label and weight to states that only their futures tell apart, listed in the other order."""
    sup_ = table(s, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("fst_id"))

    def one(first: int, second: int, last: Column) -> Fst:
        arc = lambda a, i, b: F.struct(F.lit(a).cast("bigint").alias("s"), (i if isinstance(i, Column) else F.lit(i)).cast("bigint").alias("i"), F.lit(b).cast("bigint").alias("t"))
        edges = sup_.select("fst_id", F.explode(F.array(arc(0, 1, 1), arc(0, 1, 2), arc(first, 5, 3), arc(second, last, 3))).alias("e")).select("fst_id", "e.*")
        arcs = arcs_of(edges, S.TROPICAL, fst_id="fst_id", src="s", dst="t", ilabel="i", pos="i")
        return from_edges(arcs, sup_.select("fst_id", F.lit(0).cast("bigint").alias("state")), sup_.select("fst_id", F.lit(3).cast("bigint").alias("state"), F.lit(0.0).cast("float").alias("final_weight")), S.TROPICAL)

    return graph.isomorphic(one(1, 2, F.lit(6)), one(2, 1, F.when(F.col("fst_id") % 3 == 0, 7).otherwise(6)))


def line(s, n: int) -> Fst:
    """A chain of n arcs with weights 1 to 7."""
    arcs = arcs_of(s.range(n), S.TROPICAL, src="id", dst=F.col("id") + 1, ilabel=F.col("id") % 7 + 1, weight=F.col("id") % 7 + 1)
    one = s.range(1)
    return from_edges(arcs, one.select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state")), one.select(F.lit(0).cast("bigint").alias("fst_id"), F.lit(n).cast("bigint").alias("state"), F.lit(0.0).alias("final_weight")), S.TROPICAL)


_LINE = "WITH l AS (SELECT range AS i, range % 7 + 1 AS w FROM range(10000))"
query("chain_distance", _LINE + " SELECT 0::BIGINT AS state, 0.0::DOUBLE AS weight UNION ALL SELECT i + 1, sum(w) OVER (ORDER BY i)::DOUBLE FROM l")(lambda s, d: distance.shortest_distance(line(s, 10_000)).select("state", F.col("weight").cast("double").alias("weight")))
query("chain_path", _LINE + " SELECT sum(w)::DOUBLE AS weight, count(*)::BIGINT AS n, sum(w * (i % 1000))::BIGINT AS labels FROM l")(
    lambda s, d: distance.shortest_path(line(s, 10_000)).select(F.col("weight").cast("double").alias("weight"), F.size("ilabels").cast("bigint").alias("n"), F.expr("aggregate(transform(ilabels, (x, i) -> x * (i % 1000)), 0L, (a, x) -> a + x)").alias("labels"))
)


def supply(s, d) -> Fst:
    """0 to parts (their size) to suppliers (quantity of a line); suppliers are final (their nation)."""
    p, li, su = (table(s, d, t) for t in ("part", "lineitem", "supplier"))
    long = lambda x: x.cast("bigint")
    a = p.select(F.lit(0).cast("bigint").alias("s"), long(F.col("p_partkey") + 1_000_000_000).alias("t"), F.col("p_size").cast("double").alias("w"))
    b = li.select(long(F.col("l_partkey") + 1_000_000_000).alias("s"), long(F.col("l_suppkey") + 2_000_000_000).alias("t"), F.col("l_quantity").cast("double").alias("w"))
    arcs = arcs_of(a.union(b), S.TROPICAL, src="s", dst="t", ilabel="t", weight="w")
    one = F.lit(0).cast("bigint").alias("fst_id")
    return from_edges(arcs, s.range(1).select(one, F.lit(0).cast("bigint").alias("state")), su.select(one, long(F.col("s_suppkey") + 2_000_000_000).alias("state"), F.col("s_nationkey").alias("final_weight")), S.TROPICAL)


_SUPPLY = "WITH t AS (SELECT (p_size + l_quantity + s_nationkey)::DOUBLE AS w, (p_partkey + 1000000000)::VARCHAR || ',' || (s_suppkey + 2000000000)::VARCHAR AS labels, s_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"
query("k_shortest_supply", _SUPPLY + " SELECT row_number() OVER (ORDER BY w, labels) AS rank, w AS weight, labels FROM t QUALIFY rank <= 20")(lambda s, d: shown(distance.shortest_path(supply(s, d), 20)))
query("shortest_distance_supply", _SUPPLY + " SELECT (s_suppkey + 2000000000)::BIGINT AS state, min(w) AS weight FROM t GROUP BY 1")(
    lambda s, d: distance.shortest_distance(m := supply(s, d)).join(m.finals, ["fst_id", "state"]).where("not isnan(weight) and weight < double('infinity')").select("state", (F.col("weight") + F.col("final_weight")).cast("double").alias("weight"))
)

_TREE = f"WITH {GEO}, t AS (SELECT 1 AS level, dst AS reg, 0 AS nat, 0 AS cus, dst AS old FROM geo WHERE src = 0 UNION ALL SELECT 2, g.src, g.dst, 0, g.dst FROM geo g JOIN region ON g.src = r_regionkey + 1 UNION ALL SELECT 3, n.src, g.src, g.dst, g.dst FROM geo g JOIN geo n ON n.dst = g.src WHERE g.src >= 100)"
for _by, _keys in (("breadth", "level, reg, nat, cus"), ("depth", "reg, nat, cus"), ("topological", "level, old")):
    query(f"state_order_{_by}", f"{_TREE} SELECT old, row_number() OVER (ORDER BY {_keys}) AS new FROM t")(
        lambda s, d, by=_by: graph.state_sort((m := geo(s, d)).with_(arcs=m.arcs.withColumn("pos", F.col("ilabel"))), by).arcs.select(F.col("ilabel").alias("old"), F.col("dst").alias("new"))
    )

query("push_weights_final", _THROUGH + " SELECT cus AS state, (a + b + c)::DOUBLE AS weight FROM t")(lambda s, d: distance.push_weights(geo(s, d), to="final").finals.select("state", F.col("final_weight").cast("double").alias("weight")))
query("encode_labels", _KINDS.replace("ilabel, olabel, w, row_number() OVER (ORDER BY ilabel, olabel, w) AS code FROM (SELECT DISTINCT ilabel, olabel, w FROM r)", "ilabel, olabel, row_number() OVER (ORDER BY ilabel, olabel) AS code FROM (SELECT DISTINCT ilabel, olabel FROM r)") + " SELECT fst_id, src, code AS ilabel, w AS weight, dst FROM r JOIN kinds USING (ilabel, olabel)")(
    lambda s, d: rational.encode(coarse(s, d), weights=False)[0].arcs.select("fst_id", "src", "ilabel", "weight", "dst")
)
query("recommend_storage", f"WITH {OT}, c AS (SELECT fst_id, count(*) AS n, count(DISTINCT ilabel) AS k FROM ot GROUP BY 1) SELECT fst_id, CASE WHEN k < 10 THEN 'delta' WHEN n > 10000 THEN 'lz4' ELSE 'plain' END AS codec FROM c")(lambda s, d: graph.recommend_storage(ot(s, d)))

_STORED = f"WITH {OT} SELECT fst_id, src, ilabel, olabel, weight, dst FROM ot"
for _strategy in ("construction", "production", "memory_constraints", "repeated_access", "sparse_access"):
    query(f"materialize_{_strategy}", _STORED)(lambda s, d, k=_strategy: materialize(ot(s, d), k).arcs.drop("pos"))


@query("text_files", f"WITH {GEO} SELECT src, dst AS ilabel, dst, w::DOUBLE AS weight FROM geo")
def _(s, d):
    formats.write_text(geo(s, d), path := fresh_path(s, "text"))
    return number(formats.read_text(s, path, S.TROPICAL).arcs.select(F.col("src").cast("bigint").alias("src"), "ilabel", F.col("dst").cast("bigint").alias("dst"), "weight"))


@query("lazy_expand", "SELECT s_suppkey AS fst_id, r.range AS src, l.range AS ilabel, (2 * r.range + l.range) % (s_suppkey % 211 + 2) AS dst FROM supplier, range(213) r, range(2) l WHERE r.range < s_suppkey % 211 + 2")
def _(s, d):
    """By supplier the machine of binary numbers by their remainder, made from 0 on."""
    starts = table(s, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("fst_id"), F.lit(0).cast("bigint").alias("state"))
    digits = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("ilabel")
    step = lambda front: front.select("fst_id", F.col("state").alias("src"), digits).select("fst_id", "src", F.col("ilabel").alias("pos"), "ilabel", F.col("ilabel").alias("olabel"), F.lit(0.0).cast("float").alias("weight"), ((2 * F.col("src") + F.col("ilabel")) % (F.col("fst_id") % 211 + 2)).alias("dst"))
    return lazy.expand(starts, step, lambda st: st.where("state = 0").withColumn("final_weight", F.lit(0.0)), S.TROPICAL).arcs.select("fst_id", "src", "ilabel", "dst")


@query("normalize_text", "SELECT o_orderkey, 'pay $' || o_custkey || ' by ' || strftime(o_orderdate, '%Y-%m-%d') AS result FROM orders")
def _(s, d):
    """Sums and dates in words, written by the inverse operator, and read back."""
    o = table(s, d, "orders")
    text = F.concat(F.lit("pay "), apps.spell_number(F.col("o_custkey")), F.lit(" dollars by "), F.date_format("o_orderdate", "MMMM d, yyyy"))
    return apps.normalize_text(o.select("o_orderkey", text.alias("t")), "t").select("o_orderkey", "result")


@query("pronounce", f"WITH {_WORDS} SELECT w AS word, CASE WHEN length(w) % 2 = 1 THEN upper(w) ELSE replace(replace(w, 'ee', 'i'), 'c', 'k') END AS pronunciation, CASE WHEN length(w) % 2 = 1 THEN 'lexicon' ELSE 'rules' END AS source FROM words")
def _(s, d):
    w = part_words(s, d)
    lexicon = w.where(F.length("w") % 2 == 1).select(F.col("w").alias("word"), F.upper("w").alias("pronunciation"))
    return apps.pronounce(w, "w", lexicon, {"ee": "i", "c": "k"})


@query("analyze", f"WITH {_WORDS}, cut AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words), parts AS (SELECT w AS word, substr(w, 1, i) AS stem, substr(w, i + 1) AS suffix FROM cut) SELECT * FROM parts WHERE stem IN (SELECT substr(w, 1, 3) FROM words) AND suffix IN (SELECT substr(w, 4) FROM words)")
def _(s, d):
    w = part_words(s, d)
    return apps.analyze(w, "w", w.select(F.substring("w", 1, 3).alias("stem")), w.select(F.expr("substring(w, 4)").alias("suffix")))


query("spell_check_names", "WITH c AS (SELECT DISTINCT c_name AS w FROM customer), t AS (SELECT DISTINCT substr(c_name, 1, 13) || substr(c_name, 15) AS target FROM customer WHERE c_custkey % 97 = 0) SELECT target, w AS word, levenshtein(target, w)::BIGINT AS distance FROM t, c WHERE levenshtein(target, w) <= 1")(
    lambda s, d: apps.spell_check(c := table(s, d, "customer"), "c_name", c.where("c_custkey % 97 = 0").select(F.concat(F.substring("c_name", 1, 13), F.expr("substring(c_name, 15)")).alias("target")), "target", 1, None)
)


@query("rule_cascade_six", f"WITH {_WORDS} SELECT w, translate(w, 'abcdef', 'gggggg') AS result FROM words")
def _(s, d):
    """Six rules one after another: a to b, b to c and so on to g."""
    w = store(part_words(s, d).withColumn("fst_id", F.xxhash64("w")), "words")
    out = distance.shortest_path(apps.apply_rules(apps.string_acceptors(w, "fst_id", "w"), [shift(s, chr(c), chr(c + 1)) for c in range(97, 103)]))
    return out.select("fst_id", F.array_join(F.transform("olabels", lambda c: F.char(c)), "").alias("result")).join(w, "fst_id").select("w", "result")


@query("validate_grammar", "SELECT 'rule ' || (n_nationkey + 1000) || ' has no start' AS problem FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'rules are recursive'")
def _(s, d):
    """A rule for each nation, a fifth of them without a start, and one that calls itself."""
    n = table(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("f"), "n_nationkey")
    arcs = arcs_of(n.withColumn("i", F.when(F.col("n_nationkey") == 1, F.col("f")).otherwise(7)), S.TROPICAL, fst_id="f", src=F.lit(0).cast("bigint"), dst=F.lit(1).cast("bigint"), ilabel=F.col("i").cast("bigint"))
    key = n.select(F.col("f").alias("fst_id"), "n_nationkey")
    m = from_edges(arcs, key.where("n_nationkey % 5 <> 0").select("fst_id", F.lit(0).cast("bigint").alias("state")), key.select("fst_id", F.lit(1).cast("bigint").alias("state"), F.lit(0.0).alias("final_weight")), S.TROPICAL)
    return s.createDataFrame([(x,) for x in graph.validate_grammar(m, 1001)], "problem string")


@query("replace_options", "SELECT unnest(['7,102,97,98,8', '7,102,99,8']) AS w")
def _(s, d):
    """A rule of strings in a sentence, with its label kept on the way in."""
    rule = graph.string_rule(s, S.TROPICAL, 102, ["ab", "c"])
    top = build(s, S.TROPICAL, {100: {"arcs": [(0, 7, 7, 0.0, 1), (1, 102, 102, 0.0, 2), (2, 8, 8, 0.0, 3)], "start": 0, "finals": {3: 0.0}}})
    both = Fst(top.arcs.unionByName(rule.arcs), top.states.unionByName(rule.states), S.TROPICAL)
    return language(graph.replace(both, 100, max_depth=5, keep_label=True, remove_epsilon=True))


@query("stream_run", "SELECT user_id::VARCHAR AS key, count(*)::BIGINT AS n, max_by(event_type, (ts, event_id)) = 'purchase' AS accepted FROM events GROUP BY user_id")
def _(s, d):
    """A stream of events through the machine whose state is the last event; purchases are final."""
    e = table(s, d, "events")
    kinds = e.select(F.col("event_type").alias("k")).distinct()
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 31)) + 1
    froms = kinds.select(code("k").alias("a")).union(s.range(1))
    edges = froms.crossJoin(kinds.select(code("k").alias("b"), F.col("k")))  # a few event types
    one = F.lit(0).cast("bigint").alias("fst_id")
    m = from_edges(arcs_of(edges, S.TROPICAL, src="a", dst="b", ilabel="b"), s.range(1).select(one, F.col("id").alias("state")), kinds.where("k = 'purchase'").select(one, code("k").alias("state"), F.lit(0.0).alias("final_weight")), S.TROPICAL)
    path = fresh_path(s, "stream")
    source = s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d) if not d.endswith(".parquet") else s.readStream.schema(e.schema).parquet(d)
    rows = source.select(F.col("user_id").cast("string").alias("u"), code("event_type").alias("l"), F.struct("ts", "event_id").alias("t"))
    rows = rows.withColumn("t", F.unix_micros(F.col("t.ts").cast("timestamp")) * 1000 + F.pmod(F.col("t.event_id"), F.lit(1000)))
    found = run_stream(rows, m, "u", "l", "t")
    found.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = s.read.schema(found.schema).parquet(f"{path}/out").groupBy("key").agg(F.max("n").alias("n"), F.max_by("accepted", "n").alias("accepted"))
    return last


query("properties_branching", f"WITH {GEO} SELECT (SELECT count(*) FROM geo)::BIGINT AS n_arcs, FALSE AS cyclic, TRUE AS initial_acyclic, TRUE AS unambiguous, TRUE AS input_deterministic, TRUE AS weighted, FALSE AS string, FALSE AS accessible")(
    lambda s, d: graph.properties(geo(s, d, orphans=True).with_()).select((F.col("n_arcs") - table(s, d, "customer").count()).alias("n_arcs"), "cyclic", "initial_acyclic", "unambiguous", "input_deterministic", "weighted", "string", "accessible")
)
query("properties_cycles", f"WITH {EV} SELECT count(*)::BIGINT AS n_arcs, TRUE AS cyclic, FALSE AS initial_acyclic, TRUE AS unambiguous, TRUE AS input_deterministic, TRUE AS weighted, FALSE AS string FROM ev")(
    lambda s, d: graph.properties(ev(s, d)).select("n_arcs", "cyclic", "initial_acyclic", "unambiguous", "input_deterministic", "weighted", "string")
)
