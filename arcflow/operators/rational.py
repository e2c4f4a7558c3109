"""Operators without loops: rational operations, projections, merging and sorting of arcs, conversions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidOperation
from ..functions.semiring import BOOLEAN, TROPICAL, Semiring, quantize
from ..plans.model import ARC, EPSILON, STATE, Fst, move_states, number_rows, numbered, sizes
from ..plans.storage import store


def _arc(semiring: Semiring, src: Column, dst: Column, weight: Column | None = None) -> list[Column]:
    zero = F.lit(EPSILON).cast("bigint")
    w = semiring.cast(semiring.one) if weight is None else weight
    return [F.col("fst_id"), src.alias("src"), F.lit(0).cast("bigint").alias("pos"), zero.alias("ilabel"), zero.alias("olabel"), w.alias("weight"), dst.alias("dst")]


# -- projections and conversions -----------------------------------------------------------------
def project(fst: Fst, side: str) -> Fst:
    """Both labels of every arc become its input or its output label."""
    label = {"input": "ilabel", "output": "olabel"}[side]
    return fst.with_(arcs=fst.arcs.withColumns({"ilabel": F.col(label), "olabel": F.col(label)}))


def weight_convert(fst: Fst, f: Callable[[Column], Column], semiring: Semiring) -> Fst:
    """Every arc and final weight mapped to another semiring; a final weight that becomes zero is no longer final."""
    final = semiring.cast(f(F.col("final_weight")))
    states = fst.states.withColumn("final_weight", F.when(F.col("final_weight").isNotNull() & ~semiring.is_zero(final), final))
    return Fst(fst.arcs.withColumn("weight", semiring.cast(f(F.col("weight")))), states, semiring)


def quantize_weights(fst: Fst, mode: str, low: float, high: float, levels: int) -> Fst:
    """Weights on a grid: the lossy form of weight compression."""
    return weight_convert(fst, lambda w: quantize(w, mode, low, high, levels), fst.semiring)


def transform_arcs(fst: Fst, **columns: Column) -> Fst:
    """Any of the arcs' columns replaced by an expression."""
    return fst.with_(arcs=fst.arcs.withColumns(columns))


# -- merging and sorting -------------------------------------------------------------------------
def arc_sum(fst: Fst) -> Fst:
    """Parallel arcs with the same labels become one, with the sum of their weights."""
    merged = fst.arcs.groupBy("fst_id", "src", "ilabel", "olabel", "dst").agg(fst.semiring.plus_agg(F.col("weight")).alias("weight"), F.min("pos").alias("pos"))
    return fst.with_(arcs=merged.withColumn("weight", fst.semiring.cast(F.col("weight"))).select(*ARC))


def arc_unique(fst: Fst) -> Fst:
    """Exact duplicates, weight included, become one; the first position stays."""
    return fst.with_(arcs=fst.arcs.groupBy("fst_id", "src", "ilabel", "olabel", "weight", "dst").agg(F.min("pos").alias("pos")).select(*ARC))


SORTS = {"input": ["ilabel"], "output": ["olabel"], "input_output": ["ilabel", "olabel"], "output_input": ["olabel", "ilabel"]}


def arc_sort(fst: Fst, by: str = "input") -> Fst:
    """New positions in the order of labels; equal labels keep their order."""
    place = F.row_number().over(Window.partitionBy("fst_id", "src").orderBy(*SORTS[by], "pos", "dst"))
    return fst.with_(arcs=fst.arcs.withColumn("pos", (place - 1).cast("bigint")))


# -- rational operations -------------------------------------------------------------------------
def union(a: Fst, b: Fst) -> Fst:
    """A new start 0 with epsilon arcs to the starts of both. Machines are paired by fst_id; one may be absent."""
    a, b, s = numbered(a), numbered(b), a.semiring
    na, nb = sizes(a), sizes(b)
    ids = na.select("fst_id").union(nb.select("fst_id")).distinct()
    one = F.lit(1).cast("bigint")
    left = move_states(a, ids.withColumn("n", one))
    right = move_states(b, ids.join(na, "fst_id", "left").select("fst_id", (F.coalesce("n", F.lit(0)) + 1).alias("n")))
    new = left.starts.withColumn("p", F.lit(0)).union(right.starts.withColumn("p", F.lit(1)))
    into = new.select(*_arc(s, F.lit(0).cast("bigint"), F.col("state")), "p").withColumn("pos", F.col("p").cast("bigint")).select(*ARC)
    start = ids.select("fst_id", F.lit(0).cast("bigint").alias("state"), F.lit(True).alias("is_start"), F.lit(None).cast(s.type).alias("final_weight"))
    old = left.states.unionByName(right.states).withColumn("is_start", F.lit(False))
    return Fst(left.arcs.unionByName(right.arcs).unionByName(into), start.unionByName(old.select(*STATE)), s)


def concat(a: Fst, b: Fst) -> Fst:
    """Finals of a lead by epsilon arcs, which carry their weights, to the start of b. Without a start of b, a stays as it is."""
    a, b, s = numbered(a), numbered(b), a.semiring
    right = move_states(b, sizes(a))
    to = right.starts.withColumnRenamed("state", "to")
    bridge = a.finals.join(to, "fst_id").select(*_arc(s, F.col("state"), F.col("to"), F.col("final_weight")))
    bridge = bridge.withColumn("pos", F.lit(1 << 40).cast("bigint"))
    has = to.select("fst_id", F.lit(True).alias("has")).distinct()
    states = a.states.join(has, "fst_id", "left").withColumn("final_weight", F.when(F.col("has").isNull(), F.col("final_weight"))).select(*STATE)
    return Fst(a.arcs.unionByName(right.arcs).unionByName(bridge), states.unionByName(right.states.withColumn("is_start", F.lit(False))), s)


def closure(fst: Fst, plus: bool = False) -> Fst:
    """Kleene star (or plus): a new start with an epsilon arc to the old one, and epsilon arcs from old finals to it.

    For the star the new start is the only final; for the plus the old finals stay final and the new start is not."""
    fst, s = numbered(fst), fst.semiring
    n = sizes(fst)
    first = fst.starts.join(n, "fst_id").select(*_arc(s, F.col("n"), F.col("state")))
    back = fst.finals.join(n, "fst_id").select(*_arc(s, F.col("state"), F.col("n"), F.col("final_weight"))).withColumn("pos", F.lit(1 << 40).cast("bigint"))
    final = F.lit(None).cast(s.type) if plus else s.cast(s.one)
    start = n.select("fst_id", F.col("n").alias("state"), F.lit(True).alias("is_start"), final.alias("final_weight"))
    old = fst.states.withColumn("is_start", F.lit(False))
    if not plus:
        old = old.withColumn("final_weight", F.lit(None).cast(s.type))
    return Fst(fst.arcs.unionByName(first).unionByName(back), old.select(*STATE).unionByName(start), s)


def closure_plus(fst: Fst) -> Fst:
    """One or more repetitions."""
    return closure(fst, plus=True)


def reverse(fst: Fst) -> Fst:
    """Arcs turned round; a new start leads by epsilon arcs with the final weights to the old finals; the old start is final."""
    fst, s = numbered(fst), fst.semiring
    n = sizes(fst)
    turned = fst.arcs.withColumns({"src": F.col("dst"), "dst": F.col("src")}).select(*ARC)
    into = fst.finals.join(n, "fst_id").select(*_arc(s, F.col("n"), F.col("state"), F.col("final_weight"))).withColumn("pos", F.col("dst"))
    start = n.select("fst_id", F.col("n").alias("state"), F.lit(True).alias("is_start"), F.lit(None).cast(s.type).alias("final_weight"))
    old = fst.states.select("fst_id", "state", F.lit(False).alias("is_start"), F.when(F.col("is_start"), s.cast(s.one)).alias("final_weight"))
    return Fst(turned.unionByName(into), old.unionByName(start), s)


# -- encoding ------------------------------------------------------------------------------------
def encode(fst: Fst, labels: bool = True, weights: bool = True) -> tuple[Fst, DataFrame]:
    """Labels, weights or both replaced by one label. Returns the machine over the tropical semiring and the table
    (code, ilabel, olabel, weight); codes are dense from 1, in the order of what they stand for. Final weights are kept
    in the table too, under negative codes by state, so that decoding loses nothing."""
    s = fst.semiring
    a = fst.arcs.withColumns({"il": F.col("ilabel"), "ol": F.col("olabel") if labels else F.col("ilabel"), "w": F.col("weight") if weights else s.cast(s.one)})
    kinds = a.select("il", "ol", "w").distinct()
    table = number_rows(kinds, ["il", "ol", "w"], "code").select((F.col("code") + 1).alias("code"), F.col("il").alias("ilabel"), F.col("ol").alias("olabel"), F.col("w").alias("weight"))
    table = store(table, "encode")
    t = table.select(F.col("code"), F.col("ilabel").alias("il"), F.col("olabel").alias("ol"), F.col("weight").alias("w"))
    coded = a.join(t, ["il", "ol", "w"])
    out = coded.select("fst_id", "src", "pos", F.col("code").alias("ilabel"), (F.col("code") if labels else F.col("olabel")).alias("olabel"), (TROPICAL.cast(TROPICAL.one) if weights else F.col("weight")).alias("weight"), "dst")
    if not weights:
        return Fst(out, fst.states, s), table
    states = fst.states.withColumn("final_weight", F.when(F.col("final_weight").isNotNull(), TROPICAL.cast(TROPICAL.one)))
    return Fst(out, states, TROPICAL), table


def decode(fst: Fst, table: DataFrame, semiring: Semiring, finals: DataFrame | None = None) -> Fst:
    """The labels and weights that the codes stand for; label 0 stays epsilon. An unknown code is an error.

    finals (fst_id, state, final_weight) brings back the final weights; without it they are one."""
    t = table.select(F.col("code"), F.col("ilabel").alias("i"), F.col("olabel").alias("o"), F.col("weight").alias("w"))
    j = fst.arcs.join(t, fst.arcs["ilabel"] == t["code"], "left")
    bad = F.col("code").isNull() & (F.col("ilabel") != 0)
    known = lambda c, none: F.when(bad, F.raise_error(F.concat(F.lit("no such code: "), F.col("ilabel").cast("string"))).cast(c[1])).otherwise(F.coalesce(F.col(c[0]), none))
    same = fst.semiring == semiring  # weights were not encoded, or are all one
    w = known(("w", semiring.type), semiring.cast(semiring.one))
    w = semiring.cast(semiring.times(F.col("weight"), w)) if same else w
    arcs = j.select("fst_id", "src", "pos", known(("i", "bigint"), F.lit(0).cast("bigint")).alias("ilabel"), known(("o", "bigint"), F.lit(0).cast("bigint")).alias("olabel"), w.alias("weight"), "dst")
    states = fst.states if same else fst.states.withColumn("final_weight", F.when(F.col("final_weight").isNotNull(), semiring.cast(semiring.one)))
    if finals is not None:
        states = fst.states.drop("final_weight").join(finals.select("fst_id", "state", "final_weight"), ["fst_id", "state"], "left").select(*STATE)
    return Fst(arcs, states, semiring)


# -- reweighting ---------------------------------------------------------------------------------
def reweight(fst: Fst, potentials: DataFrame, to: str = "initial") -> Fst:
    """Weights shifted along paths by potentials (fst_id, state, potential); a state without one is an error.

    to initial: V[src]^-1 w V[dst] and V^-1 rho; to final: V[src] w V[dst]^-1 and V rho, for semirings that commute."""
    s = fst.semiring
    divide = s.need("divide")
    if to not in ("initial", "final"):
        raise InvalidOperation(f"weights go to initial or final, not to {to}")
    p = potentials.select("fst_id", F.col("state").alias("src"), F.col("potential").alias("v_src"))
    q = potentials.select("fst_id", F.col("state").alias("dst"), F.col("potential").alias("v_dst"))
    need = lambda c: F.when(F.col(c).isNull() | s.is_zero(F.col(c)), F.raise_error(F.lit("a potential is missing or zero")).cast(s.type)).otherwise(s.cast(F.col(c)))
    j = fst.arcs.join(p, ["fst_id", "src"], "left").join(q, ["fst_id", "dst"], "left")
    if to == "initial":
        w = divide(s.times(F.col("weight"), need("v_dst")), need("v_src"))
        rho = lambda v: divide(F.col("final_weight"), v)
    else:
        w = divide(s.times(need("v_src"), F.col("weight")), need("v_dst"))
        rho = lambda v: s.times(v, F.col("final_weight"))
    st = fst.states.join(potentials.select("fst_id", "state", F.col("potential").alias("v")), ["fst_id", "state"], "left")
    states = st.withColumn("final_weight", F.when(F.col("final_weight").isNotNull(), s.cast(rho(need("v"))))).select(*STATE)
    return fst.with_(arcs=j.withColumn("weight", s.cast(w)).select(*ARC), states=states)


def as_boolean(fst: Fst) -> Fst:
    """The support of a machine."""
    return weight_convert(fst, lambda w: ~fst.semiring.is_zero(w), BOOLEAN)
