import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from arcflow.llm import bpe, decontaminate, language_id, line_dedup, quality, simhash
from arcflow.llm.queries import word_bpe

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- BPE -----------------------------------------------------------------------------------------
TEXTS = ["", "Hello, World's don't 12³", "a" * 300, "ΑΣ ΑΣΑ ΟΔΟΣ", "x<|endoftext|>yy <|startoftext|>", "é é ﬁ Å İ", "a\x1cb\x85c　d​e", "thequick" * 60, "\n\t ", "🙂👍🏽 ok"]


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(word_bpe()), bpe.load(word_bpe())
    for t in TEXTS:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_scan_and_heap_agree():
    own = bpe.load(word_bpe())
    word = b"internationalization" * 4
    parts = [*(own.inner[b] for b in word[:-1]), own.final[word[-1]]]
    assert own._scan(list(parts)) == own._heap(list(parts))


def test_bpe_over_rows(spark, docs):
    out = rows(bpe.encode_decode(docs, word_bpe(), keep=("doc_id", "n_words"), ids=True, decoded=True))
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == 0
    assert by[4]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[1]["ids_sha256"] == hashlib.sha256(np.array(by[1]["ids"], "<u4").tobytes()).hexdigest()
    assert by[1]["decoded_sha256"] == hashlib.sha256(by[1]["decoded"].encode()).hexdigest()
    assert by[8]["n_tokens"] > 100_000
    assert bpe.encode_decode(docs.limit(0), word_bpe()).count() == 0


# -- quality -------------------------------------------------------------------------------------
def brute_quality(t):
    t = t or ""
    words = re.findall(f"[^{SPACES}]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_counts(spark, docs):
    found = rows(quality.judge(docs, quality.references(docs), keep=("doc_id", "text")))
    assert len(found) == docs.count()
    for r in found:
        n, chars, symbols, dup, repeat = brute_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("text", ["a b c d e f a b c d e f", "a a a a a a a", "a b c d e", "é b c d e é b c d e x", "A b c d e a b c d e"])
def test_repeated_words(text):
    assert quality.repeated_words(text.encode().split()) == brute_quality(text)[4]


def test_quality_divergence(spark):
    rng = np.random.default_rng(0)
    words = ["the", "of", "and", "house", "river", "tree", "walks", "under", "bright", "sky", "stone"]
    clean = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    junk = [" ".join(f"{w}$$$ ###%" for w in rng.choice(["qxz", "vv", "kkw", "zzz", "jq"], 80)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r for r in rows(quality.judge(df, quality.references(df)))}
    bad = [i for i in range(60, 63) if found[i]["kept"] and not found[i]["base_failed"]]
    assert not bad
    assert all(found[i]["class_distance"] < 0.2 for i in range(60))
    assert quality.references(df.limit(0)).by_lang == {}
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0


# -- line dedup ----------------------------------------------------------------------------------
def brute_lines(docs):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(SPACES))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def test_line_dedup(spark, docs):
    store = line_dedup.LineStore.build(docs, shards=3)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows(store.apply(docs)))
    assert got == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_line_dedup_is_reversible(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "doc_id bigint, text string")
    first = [(1, "one shared line\nalpha beta gamma"), (2, "one shared line\ndelta epsilon"), (5, "quite another line")]
    more = [(0, "quite another line"), (7, "alpha beta gamma\nnew words again")]
    store = line_dedup.LineStore.build(make(first), shards=2).insert(make(more))
    show = lambda s, d: Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows(s.apply(make(d))))
    assert show(store, first + more) == brute_lines(first + more)
    gone = store.delete(spark.createDataFrame([(1,), (0,)], "doc_id bigint"))
    left = [d for d in first + more if d[0] not in (0, 1)]
    assert show(gone, left) == brute_lines(left)


def test_line_store_through_updates(spark, monkeypatch):
    """Updates read through each other, and past the written-anew tables, decide as a store of the documents that are left."""
    monkeypatch.setattr(line_dedup, "LAYERS", 1)
    line = "a line of shared text, number {}".format
    make = lambda rows: spark.createDataFrame([(i, "\n".join(map(line, lines))) for i, lines in rows.items()], "doc_id bigint, text string")
    have = {1: [1, 2, 3], 2: [2, 4], 3: [5]}
    store = line_dedup.LineStore.build(make(have), shards=2)
    # The last insertion repeats what document 7 holds.
    for more, gone in (({4: [3, 5, 6], 5: [1, 6]}, [1]), ({6: [4, 4, 7]}, [4, 9]), ({7: [1, 5], 1: [2]}, []), ({7: [1, 5]}, [2])):
        have |= more
        store = store.insert(make(more))
        if gone:
            have = {i: x for i, x in have.items() if i not in gone}
            store = store.delete(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
        fresh = line_dedup.LineStore.build(make(have), shards=2)
        assert sorted(map(tuple, store.shared.collect())) == sorted(map(tuple, fresh.shared.collect()))
        assert sorted(store.apply(make(have)).collect()) == sorted(fresh.apply(make(have)).collect())


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    f = line_dedup.CuckooFilter(10_000)  # too small on purpose: what overflows is kept too
    f.add(keys[:15_000])
    assert f.has(keys[:15_000]).all()
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.has(keys[:15_000]).all()
    f = line_dedup.CuckooFilter(20_000)
    f.add(keys[:15_000])
    assert f.has(keys[15_000:]).mean() < 0.01
    f.remove(keys[:5_000])
    assert f.has(keys[5_000:15_000]).all()
    assert f.has(keys[:5_000]).mean() < 0.02


# -- SimHash -------------------------------------------------------------------------------------
def brute_print(t):
    words = re.findall(f"[^{SPACES}]+", lower(t))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, docs):
    found = rows(simhash.cluster(docs, keep=("doc_id", "text")))
    assert len(found) == docs.count()
    fps = [brute_print(r["text"]) for r in found]
    assert [r["fingerprint"] for r in found] == [f"{f:016x}" for f in fps]
    ids = [r["doc_id"] for r in found]
    root = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    for i, r in enumerate(found):
        assert r["component_id"] == min((ids[j] for j in range(len(ids)) if root[j] == root[i] and ids[j] is not None), default=None)
    assert simhash.cluster(docs.limit(0)).count() == 0


def test_majority_over_255_hashes():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    sizes = np.array([0, 1, 255, 256, 700, 788, 0])
    got, at = simhash.majority(h, sizes), 0
    for f, n in zip(got.tolist(), sizes.tolist()):
        own = h[at : at + n].tolist()
        assert f == sum(1 << b for b in range(64) if n and 2 * sum(v >> b & 1 for v in own) > n)
        at += n


def closed_links(fps):
    want = np.arange(len(fps))
    while True:
        before = want.copy()
        for i in range(len(fps)):
            near = np.bitwise_count(fps ^ fps[i]) <= 2
            want[near] = want[near].min()
        if (want == before).all():
            return {int(x): int(fps[r]) for x, r in zip(fps.view(np.int64), want)}


@pytest.mark.parametrize("cell, full", [(2048, 16384), (8, 32), (64, 40)])
def test_links_of_large_balls(spark, monkeypatch, cell, full):
    """Many near fingerprints: in one table, or cut by fixed pivots and by their own, the classes are those of all pairs."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "FULL", full)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    balls = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, wide, (60, k)).astype(np.uint64), axis=1) for b, wide, k in zip(base, (32, 32, 64, 12, 64, 64), (2, 2, 3, 2, 6, 9))]
    fps = np.unique(np.concatenate([*balls, rng.integers(0, 1 << 64, 200, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    got = {r["node"]: r["root"] for r in rows(simhash.components(simhash.links(df)))}
    want = closed_links(fps)
    least = {}
    for x, r in want.items():
        least[r] = min(least.get(r, x), x)
    assert got == {x: least[r] for x, r in want.items() if sum(q == r for q in want.values()) > 1}


def test_pivot_table_discards_pairs():
    fps = np.random.default_rng(5).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert simhash.table_share(fps) < 1e-4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in rows(simhash.components(edges))}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- decontamination -----------------------------------------------------------------------------
def brute_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def test_decontamination(spark, docs):
    item = "Füchse laufen schnell über die alte Brücke am Fluss entlang heute"
    bench = [(1, "quick brown fox jumps over the lazy dog near the river"), (2, "jumps over the lazy dog near the river bank"), (3, item), (4, None), (5, "..."), (6, "kurzer text"), (None, "lorem ipsum"), (7, "lorem ipsum dolor sit amet lorem ipsum dolor sit")]
    more = spark.createDataFrame([(20, f"davor {item.upper()} danach", "de", None, 0, "x", 1, 2)], docs.schema)
    every = docs.unionByName(more)
    found = rows(decontaminate.decontaminate(every, spark.createDataFrame(bench, "item_id bigint, text string"), keep=("doc_id", "text")))
    windows = defaultdict(set)
    for i, t in bench:
        w = brute_words(t)
        for k in range(len(w) - min(8, len(w)) + 1) if w and i is not None else ():
            windows[tuple(w[k : k + 8])].add(str(i))
    for r in found:
        w, hit, items = brute_words(r["text"]), set(), set()
        for k in range(len(w)):
            for n in range(1, 9):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(items)), r["doc_id"]
        assert r["contaminated"] == (len(items) >= 2)
        assert sorted(x for a, b in r["spans"] for x in range(a, b)) == sorted(hit)
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert none.where("contaminated or n_hit > 0").isEmpty()


def test_fm_index_against_scan():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(1, 5, 400), np.tile([2, 3, 2, 1], 60)])
    index = decontaminate.FMIndex(text)
    phrases = [tuple(rng.integers(1, 6, rng.integers(1, 9)).tolist()) for _ in range(200)] + [(2, 3, 2, 1, 2, 3, 2, 1)]
    table = np.zeros((len(phrases), 8), np.int64)
    for n, p in enumerate(phrases):
        table[n, 8 - len(p) :] = p
    a, b = index.search(table, np.array([len(p) for p in phrases]))
    whole = text.tolist()
    for p, x, y in zip(phrases, a, b):
        assert sorted(index.locate(np.arange(x, y)).tolist()) == [i for i in range(len(whole) - len(p) + 1) if tuple(whole[i : i + len(p)]) == p]


def test_remove_spans():
    assert decontaminate.remove_spans("Ein Satz, über Füchse; Ende.", [[1, 4]]) == "Ein ; Ende."


# -- language ------------------------------------------------------------------------------------
def test_language_id(spark, docs):
    rng = np.random.default_rng(5)
    kinds = {"en": ["the", "thing", "with", "and", "wheel", "river"], "es": ["los", "niño", "que", "para", "ción", "está"], "fr": ["les", "eaux", "où", "être", "avec", "çela"]}
    data = [(i, " ".join(rng.choice(kinds[g], 12)), g) for i, g in enumerate(list(kinds) * 60)]
    odd = [(1000, None, "en"), (1001, "12 ... !", None), (1002, "", "es"), (None, "the wheel", "en"), (1003, "la niño que está" * 3000, None)]
    df = spark.createDataFrame(data + odd, "doc_id bigint, text string, lang string")
    df = df.withColumn("held_out", language_id.held_out(df["doc_id"]))
    got = {r["doc_id"]: r for r in rows(language_id.predict(df, language_id.fit(df), keep=("doc_id", "held_out", "lang")))}
    held = [r for i, r in got.items() if i is not None and i < 1000 and r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert got[1003]["lang_pred"] == "es"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in rows(language_id.predict(df, none))} == {"und"}


def test_gram_hashes_do_not_depend_on_neighbours():
    texts = ["Abc def", "", "x", "ÄÖ-ü", "123"]
    joint, sizes = language_id.gram_hashes(texts)
    alone = [language_id.gram_hashes([t]) for t in texts]
    assert sizes.tolist() == [int(n[0]) for _, n in alone]
    assert joint.tolist() == [x for g, _ in alone for x in g.tolist()]


# -- what grows ----------------------------------------------------------------------------------
def test_every_code_point_is_encoded_like_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe())
    library.no_truncation()
    library.no_padding()
    model = bpe.load(word_bpe())
    known, unknown = bpe.newer_letters()
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(known[::7]) + list(unknown[::7])
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{c}b {c}" for c in points[at : at + 4096])
        assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(points[at]))


def test_filters_grow(spark):
    """Thirty times the keys that the filters were built for: nothing overflows, and the decisions are those of a new store."""
    line = lambda k: f"a line of text with number {k:05d}"
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    small = [(1, "\n".join(line(k) for k in range(50))), (2, "\n".join(line(k) for k in range(50)))]
    more = [(3, "\n".join(line(k) for k in range(50, 1600))), (4, "\n".join(line(k) for k in range(50, 1600)))]
    store = line_dedup.LineStore.build(make(small), shards=2).insert(make(more))
    for r in store.filters.collect():
        f = line_dedup.CuckooFilter.load(bytes(r["filter"]))
        assert not f.overflow and (f.table != 0).sum() > 600
    want = line_dedup.LineStore.build(make(small + more), shards=2).apply(make(small + more))
    assert sorted(map(str, store.apply(make(small + more)).collect())) == sorted(map(str, want.collect()))


def test_benchmark_in_many_blocks(spark, monkeypatch):
    """One block after another finds what one block of all finds, and cuts the same texts."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words, rng.integers(3, 30)))) for i in range(40)]
    texts = [" ".join(rng.choice(words, 60)) + " " + items[i % 40][1] + " tail " + items[(i * 7) % 40][1] for i in range(50)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    run = lambda: sorted(map(str, decontaminate.decontaminate(d, b, keep=("doc_id",), cut=True).collect()))
    want = run()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert decontaminate.benchmark_items(b)[1] > 5
    assert run() == want


def test_kept_columns_that_clash(spark, docs):
    """A kept column with the name of a result's comes back as input_<name>."""
    clash = docs.withColumnsRenamed({"kept": "fingerprint"}).withColumn("kept", F.lit("mine")).withColumn("ids", F.lit(1)).withColumn("items", F.lit(2))
    keep = ("doc_id", "text", "kept", "n_words", "fingerprint", "ids", "items")
    judged = quality.judge(clash, quality.references(clash), keep)
    assert judged.columns[:4] == ["doc_id", "text", "input_kept", "input_n_words"] and {r["input_kept"] for r in judged.collect()} == {"mine"}
    assert "input_fingerprint" in simhash.cluster(clash, keep).columns
    assert "input_ids" in bpe.encode_decode(clash, word_bpe(), keep=keep, ids=True).columns
    found = decontaminate.decontaminate(clash, spark.createDataFrame([(1, "quick brown fox jumps")], "item_id bigint, text string"), keep)
    assert {r["input_items"] for r in found.collect()} == {2}


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 1)
    df = spark.createDataFrame([(i, "some words of a text that is long enough to count as one here", x) for i, x in enumerate("ab")], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        quality.references(df)
