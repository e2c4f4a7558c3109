import os

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from arcflow.llm import queries  # noqa: E402
from tests.llm.test_text_operators import brute_lines, brute_quality, brute_words  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, docs, tmp_path):
    """Every stage takes every kind of row and returns the columns of documents, whatever else they are called."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert last.count() == docs.count()


def test_stage_decisions(spark, docs, tmp_path):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, "").collect()}
    for i, t in pairs:
        n, _, _, _, repeat = brute_quality(t)
        if n < 10 or 100 * repeat > 20 * n:
            assert i not in kept
    assert {1, 2, 3} <= kept
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    for i, n, dropped, text in brute_lines(pairs):
        if n > dropped and i is not None:
            assert lines[i] == text
        elif i is not None:
            assert i not in lines
    one = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert 1 in one and 2 not in one
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert "quick brown" not in clean[1] and brute_words(clean[1]) == "the near the river bank today".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, DATA)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = sorted(str(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in cur.fetchall())
        assert sorted(str(tuple(r[c] for c in sorted(names))) for r in got.collect()) == want, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run_against_brute_force(spark):
    """The five stages one after another on whole tables, each by a plain version."""
    import hashlib
    import struct

    from tokenizers import Tokenizer

    from tests.llm.test_near_copies import brute as brute_near

    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    refs = corpus_pipeline.quality.references(table)
    now = []
    for i, t, lang in docs:
        n, _, _, _, repeat = brute_quality(t)
        if n >= 10 and 100 * repeat <= 20 * n:
            _, by_class, by_word = refs.distances(lang, (t or "").encode()) if n >= 50 else (None, 0, 0)
            if by_class <= 0.31 and by_word <= 0.48:
                now.append((i, t))
    lines = brute_lines(now)
    now = sorted((i, t) for i, n, dropped, t in lines if dropped < n)
    first = brute_near(now)
    now = [(i, t) for i, t in now if first[i] == i]
    windows = {}
    for item, t in items:
        w = brute_words(t or "")
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(item)
    sizes = {len(w) for w in windows}
    clean = {}
    for i, t in now:
        w, hit, found = brute_words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        if len(found) < 2:
            clean[i] = (t, [x for k, x in enumerate(w) if k not in hit])
    tokenizer = Tokenizer.from_file(queries.word_bpe())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got.keys() == clean.keys()
    for i, (t, words) in clean.items():
        assert brute_words(got[i]["text"]) == words
        if len(words) == len(brute_words(t)):
            assert got[i]["text"] == t
        ids = tokenizer.encode(got[i]["text"], add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["n_chars"] == len(got[i]["text"])
