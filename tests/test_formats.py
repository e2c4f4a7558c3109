import pytest

from arcflow.errors import FormatError
from arcflow.functions import semiring as S
from arcflow.plans.model import build, number_rows, renumber
from arcflow.sources import formats
from arcflow.streaming.run import run_stream
from tests.test_operators import language, random_fst

T = S.TROPICAL


def chain(spark, n=100):
    return build(spark, T, {3: {"arcs": [(i, i + 1, i + 1, 0.1 * i, i + 1) for i in range(n - 1)], "start": 0, "finals": {n - 1: 0.0}}})


@pytest.mark.parametrize("form", ["binary", "tropical"])
def test_binary(spark, tmp_path, form):
    m = chain(spark)
    out = formats.write_binary(m, str(tmp_path), form).collect()
    assert len(out) == 1
    back = formats.read_binary(spark, str(tmp_path), T, form)
    key = lambda x: {(r["src"], r["ilabel"], r["olabel"], round(r["weight"], 5), r["dst"]) for r in x.arcs.collect()}
    assert key(back) == key(m)
    assert back.starts.count() == 1 and back.finals.first()["state"] == 99


def test_binary_kinds_and_errors(spark):
    for s, w in ((S.REAL, 1.5), (S.INTEGER, -7), (S.BOOLEAN, True)):
        m = build(spark, s, {0: {"arcs": [(0, 1, 2, w, 1)], "start": None, "finals": {1: w}, "states": 3}})
        back = formats.parse_binary(formats.to_binary(m), s)
        assert back.arcs.first()["weight"] == w and back.starts.isEmpty() and back.states.count() == 3
    with pytest.raises(FormatError):
        formats.to_binary(build(spark, S.REAL, {}), "tropical")
    with pytest.raises(FormatError):
        formats.decode_binary(b"\0" * 16, "float")
    with pytest.raises(FormatError):
        formats.decode_tropical(b"\0" * 80)
    none = formats.parse_binary(formats.to_binary(build(spark, T, {0: {"arcs": [(0, 1, 1, 0.5, 1)], "start": None, "finals": {}}}), "tropical"), T, "tropical")
    assert none.starts.isEmpty() and none.arcs.count() == 1


def test_text(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("START\ta\nSTATE\tlonely\na\tb\t1\t2\t0.5\nFINAL\tb\t∞\nFINAL\tc\t1.5\nb c 3 x 2\nnot a line\nd 2.5\n")
    m = formats.read_text(spark, str(path), T)
    assert {r["state"] for r in m.states.collect()} == {"a", "b", "c", "d", "lonely"}
    assert {(r["state"], r["final_weight"]) for r in m.finals.collect()} == {("c", 1.5), ("d", 2.5)}
    assert {(r["src"], r["ilabel"], r["olabel"]) for r in m.arcs.collect()} == {("a", 1, 2), ("b", 3, 0)}
    n = renumber(m)
    back = formats.parse_text(formats.text_lines(n), T)
    assert language(renumber(back)) == language(n)
    formats.write_text(n, str(tmp_path / "out"))
    again = formats.read_text(spark, str(tmp_path / "out"), T)
    assert again.arcs.count() == 2 and again.states.count() == 5


def test_symbols(spark):
    words = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("<eps>",)], "w string")
    table = formats.symbol_table(words, "w")
    assert {(r["label"], r["symbol"]) for r in table.collect()} == {(0, "<eps>"), (1, "a"), (2, "b")}
    m = build(spark, T, {0: {"arcs": [(0, 1, 9, 0.5, 1)], "start": 0, "finals": {1: 0.0}}})
    r = formats.with_symbols(m, table).first()
    assert (r["isymbol"], r["osymbol"]) == ("a", "?")
    lines = [r["value"] for r in formats.text_lines(m, table).orderBy("line").collect()]
    assert lines == ["START\t0", "STATE\t0", "STATE\t1", "0\t1\ta\t?\t0.5", "FINAL\t1\t0.0"]
    back = formats.parse_text(formats.text_lines(m, table), T, table)
    assert back.arcs.first()["ilabel"] == 1 and back.arcs.first()["olabel"] == 0


def test_parquet(spark, tmp_path):
    m = random_fst(spark, 3)
    formats.write_parquet(m, str(tmp_path / "p"))
    assert language(formats.read_parquet(spark, str(tmp_path / "p"), T)) == language(m)


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS k")
    got = [(r["k"], r["n"]) for r in number_rows(df, ["k"], "n").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(1000)) and [k for k, _ in got] == sorted(k for k, _ in got)


def test_stream(spark, tmp_path):
    m = build(spark, T, {0: {"arcs": [(0, 1, 1, 1.0, 1), (1, 2, 2, 0.5, 2)], "start": 0, "finals": {2: 0.25}}})
    (tmp_path / "in").mkdir()
    rows = [("u", 1, 1), ("v", 2, 1), ("u", 2, 2), ("w", 1, 1)]
    spark.createDataFrame(rows, "k string, l int, t int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, l int, t int").json(str(tmp_path / "in"))
    q = run_stream(stream, m, "k", "l", "t").writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["key"]: (r["state"], r["weight"], r["accepted"], r["dead"], r["n"]) for r in spark.table("runs").collect()}
    assert got == {"u": (2, 1.75, True, False, 2), "v": (0, 0.0, False, True, 1), "w": (1, 1.0, False, False, 1)}
