import random

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402
from arcflow.llm import near_copies, simhash  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {d: min(e for (e, _), r in zip(rows, root) if r == root[i]) for i, (d, _) in enumerate(rows)}


def planted():
    """Texts with copies in which every word of some places is another one: similarities from 0.7 to 1."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, near = [], []
    for _ in range(20):
        base = rng.choices(words, k=rng.randint(60, 300))
        for at in (0.7, 0.8, 0.82, 0.85, 0.9, 0.95):
            copy = list(base)
            while similarity(shingles(" ".join(base)), shingles(" ".join(copy))) > at + 0.02:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            near.append(similarity(shingles(" ".join(base)), shingles(" ".join(copy))))
            rows.append(" ".join(copy))
        rows.append(" ".join(base))
    rng.shuffle(rows)
    return list(enumerate(rows)), near


def test_planted_near_copies(spark):
    rows, near = planted()
    assert sum(0.8 <= s < 0.95 for s in near) > 40
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = brute(rows)
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == {i for i, first in want.items() if i == first}


def test_star_rounds_lose_no_link(spark, monkeypatch):
    """A large ball of near copies, links across its rim, and odd rows."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.choice((rng.randrange(4), rng.randrange(60)))] = f"u{rng.randrange(30)}"
        rows.append(" ".join(copy))
    rows += ["", None, " \n", "a b", "A b", "a b c d e", "a b c d e f"]
    rows = list(enumerate(rows))
    monkeypatch.setattr(near_copies, "PAIRS_A_ROW", 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.cluster(docs, keep=("doc_id", "text"), size=5, similarity=(4, 5))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute(rows)
