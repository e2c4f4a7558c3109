"""Benchmark decontamination by FM-index.

Documents are indexed in shards of at most `SHARD_WORDS` words, one after another within a task. The index of a shard
(`FMIndex`) holds the Burrows-Wheeler transform of its word ids in a wavelet tree (bit planes with sampled ranks), the
counts of smaller symbols, and suffix positions sampled by text position. A test phrase is searched backward, all
phrases of a block at once; its rows are located by walking to the next sample, and the spans are merged into the
spans to remove.

Only words of the test phrases can take part in a match, and only where at least as many of them stand together as
the shortest phrase has. Every other word is left out of the index: a run of them becomes one separator. That loses no
occurrence and keeps the index small beside the text.

Phrases: the windows of `WINDOW` consecutive words of each item; an item of fewer words, but at least one, is one
phrase. Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased.

Benchmarks are read in blocks of about `BLOCK_BYTES` of text (an item is never divided), held as arrays. Only one block is
broadcast at a time: with more than one, the documents are numbered and written once and each block's pass writes the
documents it hits, before its broadcast is given up; a document's spans and items are the union over the blocks.

Defined results: a null or empty text has no words and no hits; items without words are ignored; equal windows of
several items count for each of them; a null item_id is ignored; an empty benchmark leaves every document clean; a kept
column with the name of one of the result's comes back as input_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carry, byte_texts, materialize, new_path, pieces, released

WINDOW = 8
#: Fewest different items with an occurring window that make a document contaminated.
MIN_ITEMS = 2
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 4 << 20
#: A rank is stored for every so many bits.
RANK_EVERY = 64
#: A suffix position is stored for every so many text positions.
SAMPLE_EVERY = 8

#: Bytes of words, lower-cased; all others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Phrases:
    """A block of test phrases: distinct windows as word ids (ids from 2; 0 ends the text, 1 separates)."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids: dict[bytes, int] = {}
        names: dict[str, int] = {}
        rows, owners = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = words_of(text)
            if item is None or not words:
                continue
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 2) for w in words], np.int32)
            if len(ids) < WINDOW:
                own = np.zeros((1, WINDOW), np.int32)  # filled from the right
                own[0, WINDOW - len(ids) :] = ids
            else:
                own = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
            rows.append(own)
            owners.append(np.full(len(own), names.setdefault(str(item), len(names)), np.int32))
        table, owner = np.concatenate(rows), np.concatenate(owners)
        self.items = list(names)
        #: Different windows as rows, and of each the places of its items: owners[first[i] : first[i + 1]].
        self.table, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        both = np.unique(np.stack((which.ravel(), owner), 1), axis=0) if len(table) else np.zeros((0, 2), np.int64)
        self.owners = both[:, 1]
        self.first = np.searchsorted(both[:, 0], np.arange(len(self.table) + 1))
        self.lengths = (self.table > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of text, by doubling the length of the compared prefixes. text ends in its only 0."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        later[:-step] = rank[step:] + 1
        both = rank * (n + 2 + int(rank.max())) + later if rank.max() < 1 << 30 else None
        order = np.argsort(both, kind="stable") if both is not None else np.lexsort((later, rank))
        a, b = rank[order], later[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = new
        if rank.max() == n - 1:
            return order
        step *= 2


class BitRank:
    """A bit sequence with the number of ones before any place, from counts at every RANK_EVERY bits."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        words = -(-self.n // RANK_EVERY) + 1
        packed = np.zeros(words * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        at, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks of symbols in a sequence: a bit plane for each level, from the highest bit, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.planes, self.zeros = [], []
        now = symbols.astype(np.int64)
        for level in reversed(range(self.bits)):
            bit = (now >> level) & 1
            self.planes.append(BitRank(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(i)
        i = i.copy()
        for n, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = (symbol >> (self.bits - 1 - n)) & 1
            a, b = plane.ones(low), plane.ones(i)
            low = np.where(one == 1, zeros + a, low - a)
            i = np.where(one == 1, zeros + b, i - b)
        return i - low

    def get(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        i = i.copy()
        for plane, zeros in zip(self.planes, self.zeros):
            one = plane.get(i).astype(np.int64)
            ones = plane.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one == 1, zeros + ones, i - ones)
        return symbol


class FMIndex:
    """Full-text index of a sequence of symbols from 1 on; an end symbol 0 is added."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0)
        order = suffix_order(text)
        self.n = len(text)
        bwt = text[order - 1]
        top = int(text.max())
        self.tree = WaveletTree(bwt, top)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        sampled = (order % SAMPLE_EVERY == 0).astype(np.uint8)
        self.marks, self.samples = BitRank(sampled), order[sampled == 1]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each phrase (rows of the table are filled from the right)."""
        a, b = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width, top = phrases.shape[1], len(self.smaller) - 1
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (a < b))
            if not len(live):
                break
            s = phrases[live, width - 1 - k]
            known = s < top
            b[live[~known]] = a[live[~known]]
            live, s = live[known], s[known]
            a[live] = self.smaller[s] + self.tree.rank(s, a[live])
            b[live] = self.smaller[s] + self.tree.rank(s, b[live])
        return a, np.maximum(a, b)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps back until a sampled one."""
        rows = rows.copy()
        out, steps, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            here = rows[live]
            hit = self.marks.get(here) == 1
            out[live[hit]] = self.samples[self.marks.ones(here[hit])] + steps
            live, here = live[~hit], here[~hit]
            s = self.tree.get(here)
            rows[live] = self.smaller[s] + self.tree.rank(s, here)
            steps += 1
        return out


def candidate_runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols to index and the place of each in ids: runs of phrase words of length shortest or more, a 1 before each."""
    known = ids > 1
    edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= shortest
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes) + np.repeat(starts, sizes) - 1
    symbols = ids[np.maximum(place, 0)].copy()
    symbols[first] = 1
    return symbols, place


def find(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(start, phrase) of every occurrence of a phrase in ids, by the index of the shard."""
    symbols, place = candidate_runs(ids, phrases.shortest)
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(symbols)
    a, b = index.search(phrases.table, phrases.lengths)
    n = b - a
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    return place[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def merge(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans as one; (n, 2), sorted."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return np.stack((starts[new], ends[last]), 1)


class Shard:
    """Texts of a task as word ids, until there are enough of them for an index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.ids, self.counts, self.words = phrases, [], [], 0

    def add(self, texts: list[bytes]) -> None:
        get = self.phrases.ids.get
        for t in texts:
            own = [get(x, 1) for x in words_of(t)]
            self.counts.append(len(own))
            self.words += len(own)
            own.append(1)  # a word of no phrase stands after each text
            self.ids.append(np.array(own, np.int32))

    def scan(self) -> list[tuple[int, list[list[int]], list[str]]]:
        """Of each text: its words, the merged spans of words to remove, and the items found."""
        phrases, n = self.phrases, len(self.counts)
        begin = np.concatenate(([0], np.cumsum(np.array(self.counts, np.int64) + 1)))
        spans, items = [np.zeros((0, 2), np.int64)] * n, [[] for _ in range(n)]
        if len(phrases.lengths) and n:
            starts, which = find(np.concatenate(self.ids).astype(np.int64), phrases)
            doc = np.searchsorted(begin, starts, side="right") - 1
            order = np.argsort(doc, kind="stable")
            doc, starts, which = doc[order], starts[order], which[order]
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(doc)]):
                d = int(doc[a])
                at = starts[a:b] - begin[d]
                spans[d] = merge(at, at + phrases.lengths[which[a:b]])
                owners = np.concatenate([phrases.owners[phrases.first[w] : phrases.first[w + 1]] for w in np.unique(which[a:b])])
                items[d] = sorted(phrases.items[i] for i in np.unique(owners))
        return [(c, s.tolist(), i) for c, s, i in zip(self.counts, spans, items)]


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """(item, text) and the number of blocks."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return items, max(1, -(-size // BLOCK_BYTES))


def phrase_block(items: DataFrame, k: int, blocks: int):
    """The broadcast phrases of a block."""
    rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
    return items.sparkSession.sparkContext.broadcast(Phrases([(r["item"], r["text"].encode()) for r in rows]))


LIST = pa.list_(pa.list_(pa.int64()))
FOUND = "n_words bigint, spans array<array<bigint>>, n_hit bigint, items array<string>, n_items bigint, contaminated boolean"


def scan(rows: DataFrame, held: list[str], fields: list[str], text: str, block, cut: bool, hits_only: bool) -> DataFrame:
    """held, and FOUND of each text by one block (with cut, cut_text too); hits_only leaves out the texts without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept = Shard(block.value), []

        def done() -> Iterator[pa.RecordBatch]:
            found, at = shard.scan(), 0
            for batch in kept:
                own = found[at : at + batch.num_rows]
                at += batch.num_rows
                out = [batch.column(c) for c in held]
                out += [pa.array([f[0] for f in own], pa.int64()), pa.array([f[1] for f in own], LIST), pa.array([sum(b - a for a, b in s) for _, s, _ in own], pa.int64())]
                out += [pa.array([f[2] for f in own], pa.list_(pa.string())), pa.array([len(f[2]) for f in own], pa.int64()), pa.array([len(f[2]) >= MIN_ITEMS for f in own], pa.bool_())]
                names = [*held, *(x.split()[0] for x in FOUND.split(", "))]
                if cut:
                    out.append(cut_texts(batch.column(text), [f[1] for f in own]))
                    names.append("cut_text")
                result = pa.RecordBatch.from_arrays(out, names)
                yield result.filter(pa.array([bool(f[1]) for f in own])) if hits_only else result

        size = 0
        for batch in batches:
            if batch.num_rows:
                for part in pieces(byte_texts(batch.column(text))):
                    shard.add(part)
                kept.append(batch)
                size += batch.nbytes
                if shard.words >= SHARD_WORDS or size >= SHARD_WORDS * 6:
                    yield from done()
                    shard, kept, size = Shard(block.value), [], 0
        yield from done()

    return rows.mapInArrow(released(run), ", ".join([*fields, FOUND, *["cut_text string"] * cut]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cut: bool = False) -> DataFrame:
    """`keep`, n_words, spans (array of [first word, word after the last]), n_hit, items, n_items and contaminated.

    cut: also cut_text, the text without the words of the spans and what stands between them (null where it is null)."""
    items, blocks = benchmark_items(benchmark)
    carry = Carry(docs, keep, text=text)
    at = carry.at["text"]
    own = [x.split()[0] for x in FOUND.split(", ")] + ["cut_text"] * cut
    if blocks == 1:
        return carry.named(scan(carry.rows, carry.held, carry.fields, at, phrase_block(items, 0, 1), cut, False), own)
    folder = new_path(docs.sparkSession, "blocks")
    rows = materialize(carry.rows.withColumn("__row", F.monotonically_increasing_id()), "rows", f"{folder}/rows")
    hits = None
    for k in range(blocks):
        block = phrase_block(items, k, blocks)
        new = materialize(scan(rows, ["__row"], ["__row bigint"], at, block, False, True).select("__row", "spans", "items"), "hits", f"{folder}/{k}")
        block.destroy()
        hits = new if hits is None else hits.unionByName(new)
    merged = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    joined = rows.join(merged, "__row", "left").drop("__row")
    held = carry.held

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merge(*np.array(s, np.int64).reshape(-1, 2).T).tolist() if s else [] for s in batch.column("__spans").to_pylist()]
            found = [i or [] for i in batch.column("__items").to_pylist()]
            counts = [len(words_of(t)) for t in byte_texts(batch.column(at))]
            out = [batch.column(c) for c in held] + [pa.array(counts, pa.int64()), pa.array(spans, LIST), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array(found, pa.list_(pa.string()))]
            out += [pa.array([len(f) for f in found], pa.int64()), pa.array([len(f) >= MIN_ITEMS for f in found], pa.bool_())]
            out += [cut_texts(batch.column(at), spans)] if cut else []
            yield pa.RecordBatch.from_arrays(out, [*held, *own])

    return carry.run(released(finish), FOUND + ", cut_text string" * cut, joined)


def items_digest(items) -> F.Column:
    """Lower-case hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """text without the words of the spans and what stands between them."""
    data = text.encode()
    mapped = data.translate(WORD_BYTES)
    at, places = 0, []
    for w in mapped.split(b" "):
        if w:
            places.append((at, at + len(w)))
        at += len(w) + 1
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def cut_texts(texts: pa.Array, spans: list[list[list[int]]]) -> pa.Array:
    """The texts without their spans; only texts that have one are taken out of the column."""
    at = [i for i, s in enumerate(spans) if s and texts[i].is_valid]
    if not at:
        return texts
    new = dict(zip(at, (remove_spans(texts[i].as_py(), spans[i]) for i in at)))
    return pa.array([new[i] if i in new else texts[i].as_py() for i in range(len(texts))], pa.string())
