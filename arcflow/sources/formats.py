"""Sources and sinks: text, binary, the fixed-width tropical binary, Parquet, and symbol tables.

Text and Parquet are read and written by Spark. The two binary formats hold one machine a file; files are read as
binary rows and decoded in Arrow batches, and written as bytes of one row for each machine.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.semiring import TROPICAL, Semiring, parse_weight
from ..plans.model import ARC, STATE, Fst, from_edges, number_rows

# Fixed values of the formats.
BINARY_MAGIC, BINARY_VERSION, NO_STATE = 0x46535442, 1, 0xFFFFFFFF
TROPICAL_MAGIC = 2125659606


# -- symbols -------------------------------------------------------------------------------------
def symbol_table(df: DataFrame, column: str, name: str = "symbols") -> DataFrame:
    """(table, label, symbol): <eps> is 0, and the distinct symbols of a column follow in their order."""
    words = df.where(F.col(column).isNotNull() & (F.col(column) != "<eps>")).select(F.col(column).cast("string").alias("symbol")).distinct()
    ids = number_rows(words, ["symbol"], "n")
    eps = df.sparkSession.range(1).select(F.lit(name).alias("table"), F.lit(0).cast("bigint").alias("label"), F.lit("<eps>").alias("symbol"))
    return eps.unionByName(ids.select(F.lit(name).alias("table"), (F.col("n") + 1).alias("label"), "symbol"))


def with_symbols(fst: Fst, symbols: DataFrame) -> DataFrame:
    """The arcs with isymbol and osymbol; `?` where a label has none."""
    t = symbols.select("label", "symbol")
    j = fst.arcs.join(t.select(F.col("label").alias("ilabel"), F.col("symbol").alias("isymbol")), "ilabel", "left").join(t.select(F.col("label").alias("olabel"), F.col("symbol").alias("osymbol")), "olabel", "left")
    return j.withColumns({"isymbol": F.coalesce("isymbol", F.lit("?")), "osymbol": F.coalesce("osymbol", F.lit("?"))})


# -- text ----------------------------------------------------------------------------------------
def parse_text(lines: DataFrame, semiring: Semiring, symbols: DataFrame | None = None) -> Fst:
    """Machines from lines (fst_id, value): `START s`, `STATE s`, `FINAL s w` (or the older `s w`), `src dst i o w`.

    Other lines are ignored. Labels are numbers, or symbols of the table; unknown symbols are 0. State names are kept
    as they are written."""
    at = next((c for c in ("line",) if c in lines.columns), None)
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select("fst_id", f.alias("f"), (F.col(at) if at else F.monotonically_increasing_id()).alias("line")).withColumn("n", F.size("f"))
    g = lambda i: F.get(F.col("f"), i)
    starts = rows.where((F.col("n") == 2) & (g(0) == "START")).select("fst_id", g(1).alias("state"))
    named = rows.where((F.col("n") == 2) & (g(0) == "STATE")).select("fst_id", g(1).alias("state"))
    old = rows.where((F.col("n") == 2) & ~g(0).isin("START", "STATE")).select("fst_id", g(0).alias("state"), parse_weight(g(1), semiring).alias("final_weight"))
    finals = rows.where((F.col("n") == 3) & (g(0) == "FINAL")).select("fst_id", g(1).alias("state"), parse_weight(g(2), semiring).alias("final_weight"))
    arcs = rows.where("n = 5").select("fst_id", g(0).alias("src"), F.col("line").alias("pos"), g(2).alias("i"), g(3).alias("o"), parse_weight(g(4), semiring).alias("weight"), g(1).alias("dst"))
    if symbols is None:
        arcs = arcs.withColumns({"ilabel": F.coalesce(F.col("i").try_cast("bigint"), F.lit(0)), "olabel": F.coalesce(F.col("o").try_cast("bigint"), F.lit(0))})
    else:
        t = symbols.select("label", "symbol")
        arcs = arcs.join(t.select(F.col("label").alias("il"), F.col("symbol").alias("i")), "i", "left").join(t.select(F.col("label").alias("ol"), F.col("symbol").alias("o")), "o", "left")
        arcs = arcs.withColumns({"ilabel": F.coalesce("il", F.lit(0)), "olabel": F.coalesce("ol", F.lit(0))})
    return from_edges(arcs.select(*ARC), starts, finals.unionByName(old).where("final_weight is not null"), semiring, named)


def read_text(spark: SparkSession, path: str, semiring: Semiring, symbols: DataFrame | None = None, fst_id: int = 0) -> Fst:
    """One machine from the lines of all files of a path."""
    lines = spark.read.text(path).select(F.lit(fst_id).cast("bigint").alias("fst_id"), "value")
    return parse_text(lines, semiring, symbols)


def text_lines(fst: Fst, symbols: DataFrame | None = None) -> DataFrame:
    """(fst_id, line, value): the machine as text, in the order START, all STATE, then arcs and FINAL of each state."""
    weight = lambda c: F.regexp_replace(F.col(c).cast("string"), "Infinity", "∞")
    name = lambda c: F.col(c).cast("string")
    a = fst.arcs.withColumns({"i": F.col("ilabel").cast("string"), "o": F.col("olabel").cast("string")}) if symbols is None else with_symbols(fst, symbols).withColumnsRenamed({"isymbol": "i", "osymbol": "o"})
    none = F.lit(None).cast(fst.states.schema["state"].dataType)
    low = F.lit(0).cast("bigint")
    first = fst.starts.select("fst_id", F.lit(0).alias("k"), none.alias("s"), low.alias("p"), F.concat_ws("\t", F.lit("START"), name("state")).alias("value"))
    every = fst.states.select("fst_id", F.lit(1).alias("k"), F.col("state").alias("s"), low.alias("p"), F.concat_ws("\t", F.lit("STATE"), name("state")).alias("value"))
    arcs = a.select("fst_id", F.lit(2).alias("k"), F.col("src").alias("s"), F.col("pos").alias("p"), F.concat_ws("\t", name("src"), name("dst"), "i", "o", weight("weight")).alias("value"))
    fin = fst.finals.select("fst_id", F.lit(2).alias("k"), F.col("state").alias("s"), F.lit((1 << 62)).alias("p"), F.concat_ws("\t", F.lit("FINAL"), name("state"), weight("final_weight")).alias("value"))
    rows = first.unionByName(every).unionByName(arcs).unionByName(fin)
    return number_rows(rows, ["fst_id", "k", "s", "p", "value"], "line").select("fst_id", "line", "value")


def write_text(fst: Fst, path: str, symbols: DataFrame | None = None) -> None:
    """A folder fst_id=.../ of text files, lines in order."""
    text_lines(fst, symbols).repartitionByRange("fst_id", "line").sortWithinPartitions("fst_id", "line").select("fst_id", "value").write.partitionBy("fst_id").text(path)


# -- Parquet: the native format ------------------------------------------------------------------
def write_parquet(fst: Fst, path: str, mode: str = "error", codec: str = "zstd") -> None:
    """Both relations, clustered by machine and state so that row groups can be skipped."""
    fst.arcs.select(*ARC).repartitionByRange("fst_id", "src").sortWithinPartitions("fst_id", "src", "pos").write.mode(mode).option("compression", codec).parquet(f"{path}/arcs")
    fst.states.select(*STATE).repartitionByRange("fst_id", "state").sortWithinPartitions("fst_id", "state").write.mode(mode).option("compression", codec).parquet(f"{path}/states")


def read_parquet(spark: SparkSession, path: str, semiring: Semiring) -> Fst:
    return Fst(spark.read.parquet(f"{path}/arcs"), spark.read.parquet(f"{path}/states"), semiring)


# -- binary --------------------------------------------------------------------------------------
PACK = {"float": "<f", "double": "<d", "bigint": "<q", "boolean": "<?"}


def _adjacency(fst: Fst) -> DataFrame:
    """fst_id, start and the states in order, each with its final weight and arcs in order. A machine is one row here,
    as it is one file there."""
    out = fst.arcs.groupBy("fst_id", F.col("src").alias("state")).agg(F.sort_array(F.collect_list(F.struct("pos", "ilabel", "olabel", "weight", "dst"))).alias("arcs"))
    s = fst.states.join(out, ["fst_id", "state"], "left").select("fst_id", F.struct("state", "is_start", "final_weight", "arcs").alias("s"))
    return s.groupBy("fst_id").agg(F.sort_array(F.collect_list("s")).alias("states"))


def encode_binary(start: int | None, states: list[dict], kind: str) -> bytes:
    """The general binary format: weights as length and value, little-endian."""
    pack = struct.Struct(PACK[kind])
    weight = lambda w: struct.pack("<I", pack.size) + pack.pack(w)
    out = [struct.pack("<IIII", BINARY_MAGIC, BINARY_VERSION, len(states), NO_STATE if start is None else start)]
    for s in states:
        arcs = s["arcs"] or []
        out.append(b"\x00" if s["final_weight"] is None else b"\x01" + weight(s["final_weight"]))
        out.append(struct.pack("<I", len(arcs)))
        out += [struct.pack("<II", a["ilabel"], a["olabel"]) + weight(a["weight"]) + struct.pack("<I", a["dst"]) for a in arcs]
    return b"".join(out)


def decode_binary(data: bytes, kind: str) -> tuple[int | None, list[dict]]:
    pack, at = struct.Struct(PACK[kind]), 16
    magic, version, n, start = struct.unpack_from("<IIII", data)
    if magic != BINARY_MAGIC or version != BINARY_VERSION:
        raise FormatError("not a binary machine of version 1")

    def weight():
        nonlocal at
        (size,) = struct.unpack_from("<I", data, at)
        if size != pack.size:
            raise FormatError(f"a weight of {size} bytes where {kind} has {pack.size}")
        (w,) = pack.unpack_from(data, at + 4)
        at += 4 + size
        return w

    states = []
    for _ in range(n):
        final, at = data[at], at + 1
        final = weight() if final else None
        (k,) = struct.unpack_from("<I", data, at)
        at += 4
        arcs = []
        for p in range(k):
            i, o = struct.unpack_from("<II", data, at)
            at += 8
            w = weight()
            (d,) = struct.unpack_from("<I", data, at)
            at += 4
            arcs.append({"pos": p, "ilabel": i, "olabel": o, "weight": w, "dst": d})
        states.append({"final_weight": final, "arcs": arcs})
    return None if start == NO_STATE else start, states


def encode_tropical(start: int | None, states: list[dict]) -> bytes:
    """The fixed-width tropical format. A machine without a start has -1 there."""
    n_arcs = sum(len(s["arcs"] or []) for s in states)
    out = [struct.pack("<i8s16siiqqqq", TROPICAL_MAGIC, b"vector", b"standard", 2, 0, 0, -1 if start is None else start, len(states), n_arcs)]
    for s in states:
        arcs = s["arcs"] or []
        out.append(struct.pack("<fq", float("inf") if s["final_weight"] is None else s["final_weight"], len(arcs)))
        out += [struct.pack("<iifi", a["ilabel"], a["olabel"], a["weight"], a["dst"]) for a in arcs]
    return b"".join(out)


def decode_tropical(data: bytes) -> tuple[int | None, list[dict]]:
    head = struct.Struct("<i8s16siiqqqq")
    magic, _, _, _, _, _, start, n, _ = head.unpack_from(data)
    if magic != TROPICAL_MAGIC:
        raise FormatError("not a tropical machine")
    at, states = head.size, []
    for _ in range(n):
        final, k = struct.unpack_from("<fq", data, at)
        at += 12
        arcs = []
        for p in range(k):
            i, o, w, d = struct.unpack_from("<iifi", data, at)
            at += 16
            arcs.append({"pos": p, "ilabel": i, "olabel": o, "weight": w, "dst": d})
        states.append({"final_weight": None if final == float("inf") else final, "arcs": arcs})
    return None if start in (-1, NO_STATE) else start, states


def to_binary(fst: Fst, form: str = "binary") -> DataFrame:
    """(fst_id, content): the bytes of each machine, form binary or tropical. States are numbers from 0 without gaps."""
    kind = fst.semiring.type
    if form == "tropical" and fst.semiring != TROPICAL:
        raise FormatError("this format holds tropical weights only")
    if form == "binary" and kind not in PACK:
        raise FormatError(f"no binary form of {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for states in batch.column(1).to_pylist():
                if [s["state"] for s in states] != list(range(len(states))):
                    raise FormatError("states must be numbered from 0 without gaps; renumber first")
                start = next((s["state"] for s in states if s["is_start"]), None)
                out.append(encode_tropical(start, states) if form == "tropical" else encode_binary(start, states, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["fst_id", "content"])

    return _adjacency(fst).mapInArrow(run, "fst_id bigint, content binary")


def parse_binary(rows: DataFrame, semiring: Semiring, form: str = "binary") -> Fst:
    """Machines from (fst_id, content)."""
    kind = semiring.type
    fields = f"fst_id bigint, state bigint, is_start boolean, final_weight {kind}, arcs array<struct<pos:bigint,ilabel:bigint,olabel:bigint,weight:{kind},dst:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = {"float": pa.float32(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]
        arc = pa.list_(pa.struct([("pos", pa.int64()), ("ilabel", pa.int64()), ("olabel", pa.int64()), ("weight", w), ("dst", pa.int64())]))
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start, states = decode_tropical(data) if form == "tropical" else decode_binary(data, kind)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(states), pa.int64()), pa.array(range(len(states)), pa.int64()), pa.array([n == start for n in range(len(states))], pa.bool_()), pa.array([s["final_weight"] for s in states], w), pa.array([s["arcs"] for s in states], arc)], ["fst_id", "state", "is_start", "final_weight", "arcs"])

    every = rows.select(F.col("fst_id").cast("bigint").alias("fst_id"), "content").mapInArrow(run, fields)
    arcs = every.select("fst_id", F.col("state").alias("src"), F.explode("arcs").alias("a")).select("fst_id", "src", "a.pos", "a.ilabel", "a.olabel", "a.weight", "a.dst")
    return Fst(arcs.select(*ARC), every.select(*STATE), semiring)


def read_binary(spark: SparkSession, path: str, semiring: Semiring, form: str = "binary") -> Fst:
    """Every file of a path as one machine, numbered in the order of the paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse_binary(number_rows(files, ["path"], "fst_id").select("fst_id", "content"), semiring, form)


def write_binary(fst: Fst, folder: str, form: str = "binary") -> DataFrame:
    """<fst_id>.fst files in a folder that all executors mount. Returns (fst_id, path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, n = [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{folder}/{i}.fst"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.{os.getpid()}", path)
                paths.append(path)
                n.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(n, pa.int64())], ["fst_id", "path", "bytes"])

    return to_binary(fst, form).mapInArrow(run, "fst_id bigint, path string, bytes bigint")
