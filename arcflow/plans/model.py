"""The data model: transducers as two relations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidOperation
from ..functions.semiring import Semiring
from .storage import fresh_path, store

EPSILON = 0
ARC = ["fst_id", "src", "pos", "ilabel", "olabel", "weight", "dst"]
STATE = ["fst_id", "state", "is_start", "final_weight"]


@dataclass(frozen=True)
class Fst:
    """Transducers keyed by fst_id.

    arcs: fst_id, src, pos, ilabel, olabel, weight, dst. `pos` orders the arcs of a state. Label 0 is epsilon.
    states: fst_id, state, is_start, final_weight (null: not final). States may be of any type that can be joined and
    ordered; operators that make new states next to old ones number them first.
    """

    arcs: DataFrame
    states: DataFrame
    semiring: Semiring

    def __post_init__(self):
        for df, names in ((self.arcs, ARC), (self.states, STATE)):
            if missing := [c for c in names if c not in df.columns]:
                raise InvalidOperation(f"columns missing: {missing}")

    @property
    def spark(self) -> SparkSession:
        return self.arcs.sparkSession

    def with_(self, **parts) -> Fst:
        return replace(self, **parts)

    def stored(self, name: str = "fst") -> Fst:
        """The same machines, written to the shared folder and read back."""
        return self.with_(arcs=store(self.arcs.select(*ARC), f"{name}-arcs"), states=store(self.states.select(*STATE), f"{name}-states"))

    @property
    def starts(self) -> DataFrame:
        return self.states.where("is_start").select("fst_id", "state")

    @property
    def finals(self) -> DataFrame:
        return self.states.where("final_weight is not null").select("fst_id", "state", "final_weight")

    def counts(self) -> DataFrame:
        """fst_id, n_states, n_arcs, n_finals."""
        s = self.states.groupBy("fst_id").agg(F.count("*").alias("n_states"), F.count("final_weight").alias("n_finals"))
        a = self.arcs.groupBy("fst_id").agg(F.count("*").alias("n_arcs"))
        return s.join(a, "fst_id", "left").select("fst_id", "n_states", F.coalesce("n_arcs", F.lit(0)).alias("n_arcs"), "n_finals")


def arcs_of(df: DataFrame, semiring: Semiring, **columns: Column | str) -> DataFrame:
    """Arcs from a DataFrame; columns that are not given have the usual defaults (one machine, epsilon, weight one)."""
    at = {c: F.col(v) if isinstance(v, str) else v for c, v in columns.items()}
    at = {"fst_id": F.lit(0).cast("bigint"), "pos": F.lit(0).cast("bigint"), "ilabel": F.lit(EPSILON).cast("bigint"), "weight": semiring.one} | at
    at.setdefault("olabel", at["ilabel"])
    return df.select(*(semiring.cast(at[c]).alias(c) if c == "weight" else at[c].alias(c) for c in ARC))


def from_edges(arcs: DataFrame, starts: DataFrame, finals: DataFrame, semiring: Semiring, extra_states: DataFrame | None = None) -> Fst:
    """Machines from arcs, (fst_id, state) starts and (fst_id, state, final_weight) finals. A zero final weight is no final."""
    ends = arcs.select("fst_id", F.col("src").alias("state")).union(arcs.select("fst_id", "dst"))
    ends = ends.union(starts.select("fst_id", "state")).union(finals.select("fst_id", "state"))
    if extra_states is not None:
        ends = ends.union(extra_states.select("fst_id", "state"))
    fin = finals.select("fst_id", "state", semiring.cast(F.col("final_weight")).alias("final_weight")).where(~semiring.is_zero(F.col("final_weight")))
    states = ends.distinct().join(starts.select("fst_id", "state", F.lit(True).alias("is_start")).distinct(), ["fst_id", "state"], "left").join(fin, ["fst_id", "state"], "left")
    return Fst(arcs, states.select("fst_id", "state", F.coalesce("is_start", F.lit(False)).alias("is_start"), "final_weight"), semiring)


def build(spark: SparkSession, semiring: Semiring, machines: dict[int, dict]) -> Fst:
    """Small machines from Python values, for tests and rule tables.

    machines: {fst_id: {"arcs": [(src, ilabel, olabel, weight, dst)], "start": state, "finals": {state: weight}, "states": n}}
    """
    arcs, states = [], []
    for i, m in machines.items():
        own = {s for a in m.get("arcs", []) for s in (a[0], a[4])} | set(m.get("finals", {})) | set(range(m.get("states", 0))) | ({m["start"]} if m.get("start") is not None else set())
        arcs += [(i, s, p, il, ol, w, d) for p, (s, il, ol, w, d) in enumerate(m.get("arcs", []))]
        states += [(i, s, s == m.get("start"), m.get("finals", {}).get(s)) for s in sorted(own)]
    a = spark.createDataFrame(arcs, f"fst_id bigint, src bigint, pos bigint, ilabel bigint, olabel bigint, weight {semiring.type}, dst bigint")
    s = spark.createDataFrame(states, f"fst_id bigint, state bigint, is_start boolean, final_weight {semiring.type}")
    return Fst(a, s.withColumn("final_weight", F.when(~semiring.is_zero(F.col("final_weight")), F.col("final_weight"))), semiring)


def from_sequences(df: DataFrame, order: list, label: Column | str, semiring: Semiring, fst_id: str = "fst_id", olabel: Column | str | None = None, weight: Column | None = None) -> Fst:
    """One linear machine a group: a chain of its rows in order."""
    label = F.col(label) if isinstance(label, str) else label
    out = label if olabel is None else F.col(olabel) if isinstance(olabel, str) else olabel
    at = (F.row_number().over(Window.partitionBy(fst_id).orderBy(*order)) - 1).cast("bigint")
    w = semiring.cast(weight if weight is not None else semiring.one)
    arcs = df.select(F.col(fst_id).cast("bigint").alias("fst_id"), at.alias("src"), F.lit(0).cast("bigint").alias("pos"), label.cast("bigint").alias("ilabel"), out.cast("bigint").alias("olabel"), w.alias("weight"))
    arcs = arcs.withColumn("dst", F.col("src") + 1)
    ends = arcs.groupBy("fst_id").agg(F.max("dst").alias("n"))
    states = ends.select("fst_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("state"))
    states = states.select("fst_id", "state", (F.col("state") == 0).alias("is_start"), F.when(F.col("state") == F.col("n"), semiring.cast(semiring.one)).alias("final_weight"))
    return Fst(arcs.select(*ARC), states, semiring)


def from_lexicon(df: DataFrame, word: str, semiring: Semiring, fst_id: Column | None = None, weight: Column | None = None) -> Fst:
    """The trie of a set of words: states are their beginnings (strings), labels code points."""
    one = fst_id if fst_id is not None else F.lit(0).cast("bigint")
    words = df.where(F.col(word).isNotNull()).select(one.alias("fst_id"), F.col(word).alias("w"), semiring.cast(weight if weight is not None else semiring.one).alias("weight"))
    at = words.where("w <> ''").select("fst_id", F.explode(F.expr("transform(sequence(1, length(w)), i -> struct(substring(w, 1, i - 1) as src, substring(w, 1, i) as dst, substring(w, i, 1) as c))")).alias("e")).distinct()
    label = F.conv(F.hex(F.encode(F.col("e.c"), "UTF-32")), 16, 10).cast("bigint")
    arcs = at.select("fst_id", F.col("e.src").alias("src"), label.alias("pos"), label.alias("ilabel"), label.alias("olabel"), semiring.cast(semiring.one).alias("weight"), F.col("e.dst").alias("dst"))
    finals = words.groupBy("fst_id", F.col("w").alias("state")).agg(semiring.plus_agg(F.col("weight")).alias("final_weight"))
    return from_edges(arcs, words.select("fst_id", F.lit("").alias("state")).distinct(), finals, semiring)


# -- numbering -----------------------------------------------------------------------------------
def number_rows(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with a dense number from 0 in the given order, without a single-task sort: ranges are sorted apart, and the
    sizes of the ranges (one row each) shift their numbers."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = store(cut.withColumn("__m", F.monotonically_increasing_id()), "numbering")
    part = F.shiftright(F.col("__m"), 33)
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg((F.max(F.col("__m").bitwiseAND((1 << 33) - 1)) + 1).alias("n")).collect())
    shifts, total = [], 0
    for p, n in sizes:
        shifts.append((p, total))
        total += n
    table = kept.sparkSession.createDataFrame(shifts, "__p bigint, __shift bigint")
    joined = kept.withColumn("__p", part).join(F.broadcast(table), "__p")
    return joined.withColumn(name, F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__shift")).drop("__m", "__p", "__shift")


def renumber(fst: Fst) -> Fst:
    """States as numbers from 0 within each machine, in the order of their keys."""
    every = number_rows(fst.states.select("fst_id", "state").distinct(), ["fst_id", "state"], "n")
    first = every.groupBy("fst_id").agg(F.min("n").alias("first"))
    ids = store(every.join(first, "fst_id").select("fst_id", "state", (F.col("n") - F.col("first")).alias("id")), "ids")
    states = fst.states.join(ids, ["fst_id", "state"]).select("fst_id", F.col("id").alias("state"), "is_start", "final_weight")
    a = ids.select("fst_id", F.col("state").alias("src"), F.col("id").alias("src_id"))
    b = ids.select("fst_id", F.col("state").alias("dst"), F.col("id").alias("dst_id"))
    arcs = fst.arcs.join(a, ["fst_id", "src"]).join(b, ["fst_id", "dst"])
    return fst.with_(arcs=arcs.select("fst_id", F.col("src_id").alias("src"), "pos", "ilabel", "olabel", "weight", F.col("dst_id").alias("dst")), states=states)


def numbered(fst: Fst) -> Fst:
    """fst, renumbered unless its states are numbers already."""
    return fst if fst.states.schema["state"].dataType.simpleString() == "bigint" else renumber(fst)


def sizes(fst: Fst) -> DataFrame:
    """fst_id and n: one more than its largest state number."""
    return fst.states.groupBy("fst_id").agg((F.max("state") + 1).alias("n"))


def move_states(fst: Fst, by: DataFrame) -> Fst:
    """State numbers shifted by a number of each machine (fst_id, n)."""
    arcs = fst.arcs.join(by, "fst_id", "left").withColumns({"src": F.col("src") + F.coalesce("n", F.lit(0)), "dst": F.col("dst") + F.coalesce("n", F.lit(0))}).select(*ARC)
    states = fst.states.join(by, "fst_id", "left").withColumn("state", F.col("state") + F.coalesce("n", F.lit(0))).select(*STATE)
    return fst.with_(arcs=arcs, states=states)


# -- how machines are kept -----------------------------------------------------------------------
def materialize(fst: Fst, strategy: str = "production", level: str = "MEMORY_AND_DISK") -> Fst:
    """The same machines, kept in another way.

    construction: the plans as they are, cheap to change. production: written once to the shared folder, clustered by
    machine and state and sorted by place, so that filters skip row groups. memory_constraints: the same with the
    strongest compression. repeated_access: persisted at a storage level (call `release` after use). sparse_access:
    nothing is computed before it is asked for."""
    if strategy in ("construction", "sparse_access"):
        return fst
    if strategy == "repeated_access":
        kept = getattr(StorageLevel, level, None)
        if kept is None:
            raise InvalidOperation(f"no storage level {level}")
        return fst.with_(arcs=fst.arcs.select(*ARC).persist(kept), states=fst.states.select(*STATE).persist(kept))
    if strategy in ("production", "memory_constraints"):
        codec = {"compression": "zstd", "parquet.compression.codec.zstd.level": "19"} if strategy == "memory_constraints" else {}
        parts = []
        for name, df, keys in (("arcs", fst.arcs.select(*ARC), ["fst_id", "src", "pos"]), ("states", fst.states.select(*STATE), ["fst_id", "state"])):
            path = fresh_path(fst.spark, f"kept-{name}")
            df.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys).write.options(**codec).parquet(path)
            parts.append(fst.spark.read.schema(df.schema).parquet(path))
        return fst.with_(arcs=parts[0], states=parts[1])
    raise InvalidOperation(f"no strategy {strategy}")


def release(fst: Fst) -> None:
    """Give up what materialize(..., "repeated_access") persists."""
    fst.arcs.unpersist()
    fst.states.unpersist()
