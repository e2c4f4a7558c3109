"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are n-grams of 1 to `ORDER` characters of the lower-cased letters of a text, with one blank for every run of
other characters, hashed to `DIMENSIONS`. Term frequencies are shares of the text's n-grams; document frequencies are
counted over all training documents. The model is trained with follow-the-regularised-leader (per-coordinate rates,
L1 and L2 penalties) on a sample of at most about `SAMPLE` labelled documents of each language, chosen by the hash of
their doc_id; a fifth of the sample is kept apart and sets the temperature of the softmax.

A text is scored by gathering the weights of its n-grams, so a whole text of any length takes one pass.

Defined results: `und` with score 0 for a null text or one without a letter; likewise when nothing was labelled;
rows with a null label, or a null doc_id, are never learned from; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carry, per_batch, pieces, released

ORDER = 3
DIMENSIONS = 1 << 16
#: The sample bound of the classifier: labelled documents of each language, and bytes of text of one batch of it.
SAMPLE = 1500
#: Most different labels: the weights of each are broadcast, so more of them are an error (not a language column).
MAX_LANGUAGES = 256
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-5
UNKNOWN = "und"

#: Lower bound of surrogate-free code points; the letter test covers them all.
LETTER = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter. Built once a process."""
    if not LETTER.any():
        LETTER[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return LETTER


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one after another, and the number of each text's. A text without letters has none."""
    table = letters()
    joined = "".join([t.lower() + "\n" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    is_letter = table[codes]
    # A blank stands for each run of other characters; the last character of every text is one.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    of_text = np.add.reduceat(keep, np.concatenate(([0], ends[:-1])), dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    c = np.where(is_letter, codes, 32)[keep].astype(np.uint32)
    out = []
    h = np.zeros(len(c), np.uint32)
    # The n-gram that ends at each place; before a text's first character stands what the text before it ended in,
    # a blank, and before that one the hash is cut by the length.
    starts = np.cumsum(of_text) - of_text
    inside = np.arange(len(c)) - np.repeat(starts, of_text)
    for n in range(1, ORDER + 1):
        back = np.zeros(len(c), np.uint32)
        back[n - 1 :] = c[: len(c) - n + 1]
        back[inside < n - 1] = 32
        h = h * np.uint32(0x01000193) ^ back * np.uint32(0x9E3779B1)
        m = h ^ (h >> np.uint32(15))
        m = m * np.uint32(0x85EBCA6B + 2 * n)
        out.append(((m ^ (m >> np.uint32(13))) & np.uint32(DIMENSIONS - 1)).astype(np.int32))
    return np.stack(out, 1).ravel() if len(c) else np.zeros(0, np.int32), of_text * ORDER


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each hashed n-gram stands, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        mark = np.zeros(DIMENSIONS, bool)
        for batch in batches:
            for texts in pieces([t or "" for t in batch.column(0).to_pylist()]):
                grams, sizes = gram_hashes(texts)
                at = 0
                for k in sizes.tolist():
                    mark[grams[at : at + k]] = True
                    df += mark
                    mark[:] = False
                    at += k
                n += len(texts)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], ["gram", "n"])

    rows = train.select("text").mapInArrow(released(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams, n = np.asarray(rows.column("gram")), np.asarray(rows.column("n"))
    df = np.zeros(DIMENSIONS, np.int64)
    df[grams[grams >= 0]] = n[grams >= 0]
    return df, int(n[grams < 0].sum())


class Model:
    """Weights already multiplied by the inverse document frequencies, and the temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def logits(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias, (len(sizes), 1)).astype(np.float64)
        full = np.flatnonzero(sizes)
        if len(full):
            begin = np.cumsum(sizes)[full] - sizes[full]
            for c in range(len(self.langs)):
                out[full, c] += np.add.reduceat(self.weights[c][grams], begin, dtype=np.float64) / sizes[full]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, sizes = gram_hashes(texts)
        p = softmax(self.logits(grams, sizes) / self.temperature)
        best = p.argmax(1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, sizes)], np.where(sizes > 0, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (features, values, class). Returns weights and bias; the bias has no L1 penalty."""
    z, n = np.zeros((DIMENSIONS + 1, n_classes)), np.zeros((DIMENSIONS + 1, n_classes))
    l1 = np.full(DIMENSIONS + 1, L1)
    l1[-1] = 0

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1[i][:, None], 0.0, -(zi - np.sign(zi) * l1[i][:, None]) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for features, values, y in rows:
            i, x = np.append(features, DIMENSIONS), np.append(values, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g2
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the documents with a label that are not held out."""
    train = docs.select(F.col("doc_id").cast("string").alias("id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    train = train.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    found = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels")
    if not found:
        return Model([], np.zeros((0, DIMENSIONS)), np.zeros(0), 1.0)
    langs = sorted(r["lang"] for r in found)
    share = F.create_map(*(x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE / r["count"])))))
    df, n = document_frequencies(train)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.where(draw < share[F.col("lang")])

    # Only the hashed n-grams of the sample reach the driver: at most DIMENSIONS of each text, whatever its length.
    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, sizes = gram_hashes(batch.column("text").to_pylist())
        keys, values = [], []
        for part in np.split(grams, np.cumsum(sizes)[:-1]):
            k, c = np.unique(part, return_counts=True)
            keys.append(k.astype(np.int32))
            values.append((c / max(1, len(part)) * idf[k]).astype(np.float32))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["id", "lang", "k", "v"])

    table = sample.mapInArrow(per_batch(lambda: features), "id string, lang string, k array<int>, v array<float>").toArrow()
    place = {x: i for i, x in enumerate(langs)}
    rows = [(k.values.to_numpy(), v.values.to_numpy().astype(float), place[x], i) for i, x, k, v in zip(table.column("id").to_pylist(), table.column("lang").to_pylist(), table.column("k"), table.column("v")) if len(k)]
    rows.sort(key=lambda r: (hash_of(r[3]), r[2]))
    check, learn = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    w, bias = train_ftrl([r[:3] for r in learn], len(langs))
    temperature = 1.0
    if check:
        logits = np.stack([v @ w[k] + bias for k, v, _, _ in check])
        temperature = fit_temperature(logits, np.array([r[2] for r in check]))
    return Model(langs, np.ascontiguousarray((w * idf[:, None]).T.astype(np.float32)), bias, temperature)


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode(), 7)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = Carry(docs, keep, text=text)
    held, at = carry.held, carry.at["text"]

    def make():
        known = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = [], []
            for part in pieces([t or "" for t in batch.column(at).to_pylist()]):
                found = known.predict(part)
                langs += found[0]
                scores.append(found[1])
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(langs), pa.array(np.concatenate(scores))], [*held, "lang_pred", "score"])

        return work

    return carry.run(per_batch(make), "lang_pred string, score double")
