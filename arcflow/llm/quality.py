"""Quality rules by distribution divergence.

Two histograms of a text, its character classes and its common words, are compared with the reference of its
language by Jensen-Shannon distance (base 2, so 0 to 1). References are sums over all documents that pass the
base rules, weighted so that no document counts for more than `SHARE` words. A text shorter than `MIN_WORDS`
words has too coarse a histogram to be judged by it (minimum-length guard), so only the base rules hold for it.

Base rules: a text fails with fewer than ten words, or when more than a fifth of its words lie in 5-word windows
that occur in it at least twice.

Defined results: a null text has no words and so fails; a null or unknown language is compared with the nearest
reference; with no reference at all (an empty table), only the base rules hold; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Carry, byte_texts, per_batch, released

WINDOW = 5
MIN_TOTAL_WORDS = 10
#: Percent of words in repeated windows above which a text fails.
MAX_REPEATED = 20
#: Fewest words from which the histograms are judged.
MIN_WORDS = 50
#: Common words of each language.
COMMON = 64
#: Most different labels: a reference is broadcast for each, so more of them are an error (not a language column).
MAX_LANGUAGES = 4096
#: Jensen-Shannon distances above which a text is rejected.
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.48
#: A longer text counts for no more than this many words in a reference.
SHARE = 1000

CLASSES = ["lower", "upper", "digit", "blank", "newline", "stop", "quote", "bracket", "symbol", "other_ascii", "control", "beyond_ascii"]


def class_table() -> np.ndarray:
    """The class of each byte; UTF-8 continuation bytes belong to none (the last, uncounted number)."""
    t = np.full(256, CLASSES.index("other_ascii"), np.uint8)
    t[:32] = t[127] = CLASSES.index("control")
    for name, chars in (("blank", " \t"), ("newline", "\n\r"), ("stop", ".,;:!?"), ("quote", "'\"`"), ("bracket", "()[]{}"), ("symbol", "#*$%&|<>")):
        t[list(chars.encode())] = CLASSES.index(name)
    t[48:58], t[65:91], t[97:123] = CLASSES.index("digit"), CLASSES.index("upper"), CLASSES.index("lower")
    t[128:192], t[192:] = len(CLASSES), CLASSES.index("beyond_ascii")
    return t


BYTE_CLASS = class_table()


def class_histogram(text: bytes) -> np.ndarray:
    return np.bincount(BYTE_CLASS[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more. Hashes propose windows, words confirm them."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen = Counter(tuple(words[i : i + WINDOW]) for i in at)
    if len(seen) * 2 > len(at):  # some hash of two different windows is the same
        at = np.array([i for i in at if seen[tuple(words[i : i + WINDOW])] > 1], np.int64)
    if not len(at):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    dup = 0
    if text.count(b"\n"):
        lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
        dup = len(lines) - len(set(lines))
    return chars, symbols, dup, repeated_words(words)


def fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_TOTAL_WORDS or 100 * n_repeat > MAX_REPEATED * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2. An empty histogram is at distance 0 of any."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return 0.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d, 0.0) / 2))


# -- references ----------------------------------------------------------------------------------
def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task by language: of classes (kind c), words (w) and documents (d). Flushed when large."""
    sums: dict[tuple, int] = {}

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()), pa.array(list(sums.values()), pa.int64())], ["lang", "kind", "item", "n"])
        sums.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch.column("text"))):
            words = text.split()
            if lang is None or fails(len(words), repeated_words(words)):
                continue
            # Whole thousandths for each text, so the sums do not depend on how the texts are dealt to tasks.
            part = lambda n, size=max(SHARE, len(words)): 1000 * n * SHARE // size
            for i, n in enumerate(class_histogram(text).tolist()):
                if n:
                    k = (lang, "c", b"%d" % i)
                    sums[k] = sums.get(k, 0) + part(n)
            for w, n in Counter(text.translate(LOWER).split()).items():
                k = (lang, "w", w)
                sums[k] = sums.get(k, 0) + part(n)
            sums[lang, "d", b""] = sums.get((lang, "d", b""), 0) + 1
        if len(sums) > 150_000:
            yield flush()
    yield flush()


class References:
    """By language: the class histogram, the common words and their counts with all other words last."""

    def __init__(self, rows: list[tuple[str, str, bytes, int, int]]):
        self.by_lang: dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]] = {}
        parts: dict[str, tuple[np.ndarray, list]] = {}
        for lang, kind, item, n, total in rows:
            classes, words = parts.setdefault(lang, (np.zeros(len(CLASSES)), []))
            if kind == "c":
                classes[int(item)] = n
            elif kind == "w":
                words.append((-n, item, total))
        for lang, (classes, words) in parts.items():
            words.sort()
            counts = np.array([-w[0] for w in words] + [(words[0][2] if words else 0) + sum(w[0] for w in words)], float)
            self.by_lang[lang] = classes, {w[1]: i for i, w in enumerate(words)}, counts

    def distances(self, lang: str | None, text: bytes) -> tuple[str | None, float, float]:
        """The language compared with, and the distances of classes and of common words."""
        if not self.by_lang:
            return None, 0.0, 0.0
        classes, counts = class_histogram(text).astype(float), Counter(text.translate(LOWER).split())
        total, best = sum(counts.values()), None
        for name in [lang] if lang in self.by_lang else sorted(self.by_lang):
            ref_classes, places, ref_counts = self.by_lang[name]
            own = np.zeros(len(ref_counts))
            for w, i in places.items():
                own[i] = counts.get(w, 0)
            own[-1] = total - own.sum()
            found = js_distance(own, ref_counts), js_distance(classes, ref_classes), name
            best = min(best or found, found)
        return best[2], best[1], best[0]


def references(docs: DataFrame) -> References:
    """Learn the references from all documents. What reaches the driver is bounded by MAX_LANGUAGES and COMMON."""
    sums = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(released(gather), "lang string, kind string, item binary, n bigint")
    sums = sums.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    if sums.where("kind = 'd'").limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels")
    total = sums.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = sums.withColumn("place", place).where(F.col("place") <= COMMON).drop("place")
    rows = top.join(total, ["lang", "kind"]).collect() if not docs.isStreaming else []
    return References([(r["lang"], r["kind"], bytes(r["item"]), r["n"], r["total"]) for r in rows])


# -- judging -------------------------------------------------------------------------------------
REPORT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, reference string, class_distance double, word_distance double"


def judge(docs: DataFrame, refs: References, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang") -> DataFrame:
    """`keep` and the report of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    carry = Carry(docs, keep, text=text, lang=lang)
    held, at, names = carry.held, carry.at, [*carry.held, *(x.split()[0] for x in REPORT.split(", "))]

    def make():
        known = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for lang, text in zip(batch.column(at["lang"]).to_pylist(), byte_texts(batch.column(at["text"]))):
                words = text.split()
                chars, symbols, dup, repeat = base_counts(text, words)
                bad = fails(len(words), repeat)
                name, by_class, by_word = known.distances(lang, text) if len(words) >= MIN_WORDS else (None, 0.0, 0.0)
                out.append((len(words), chars, symbols, dup, repeat, bad, not bad and by_class <= MAX_CLASS_DISTANCE and by_word <= MAX_WORD_DISTANCE, name, by_class, by_word))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
            return pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        return work

    return carry.run(per_batch(make), REPORT)
