"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Fingerprints that differ in at
most `MAX_BITS` bits link, and links are closed into components.

Pairs are found among different fingerprints only, by their Hamming distances to pivots. By the triangle inequality the
distances of a linked pair to any pivot differ by no more than MAX_BITS, so:

1. Cells: a pivot cuts a cell in two at a distance m, into the fingerprints up to m + MAX_BITS and those beyond m. Of a
   linked pair both lie in at least one half. `levels` fixed pivots deal all fingerprints to cells in one pass.
2. A cell of more than `FULL` fingerprints is cut again, by a pivot out of the cell itself and at the median distance,
   round by round and spread over the cluster, until none is left. What lies within MAX_BITS of its pivot links to it,
   so a cell that is nothing but that is done. Where cuts do not help (a ball in which all distances are alike), the
   cell's fingerprints are dealt to blocks, and the blocks to pairs of blocks. Every way is exact; nothing is capped.
3. Within a cell, a table holds each fingerprint's distances to `PIVOTS` references: it is sorted by the first, whose
   window proposes pairs, the largest difference over the others discards them, and the survivors are compared bit by
   bit (`table_share` tells how many pairs the table leaves).

A cell hands on at most one link for each fingerprint (to the root of its part of the cell), which keeps links linear in
the input. Components are closed by alternating large-star and small-star rounds on DataFrames, each written to the
shared folder.

With `similarity`, documents link by the Jaccard similarity of their sets of shingles instead (see `near_copies`).

Defined results: a null or empty text has fingerprint zero and links like any other; a component whose documents all
lack a doc_id has a null component_id; repeated rows are all returned; a kept column called fingerprint or component_id
comes back as input_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, Carry, byte_texts, delete_path, materialize, new_path, per_batch, released

SHINGLE = 3
MAX_BITS = 2
PIVOTS = 12
#: Fingerprints that the fixed pivots aim at in a cell, and from which on a cell is cut again.
CELL, FULL = 2048, 16384
SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the text's shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; a bit is 1 if it is set in over half of the run. An empty run gives 0.

    Eight byte lanes are summed at once over pieces of at most 255 hashes."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    first = np.cumsum(n) - n
    per = -(-n // 255)
    run = np.repeat(np.arange(len(full)), per)
    piece = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per)
    starts = first[run] + piece * 255
    heads = np.cumsum(per) - per
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        for lane in range(8):
            out[full] |= (2 * ones[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`keep` and fp (the fingerprint's bits as a bigint)."""
    carry = Carry(docs, keep, text=text)
    held, at = carry.held, carry.at["text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes(t, size) for t in byte_texts(batch.column(at))]
        flat = np.fromiter((h for f in found for h in f), np.uint64)
        fp = majority(flat, np.array([len(f) for f in found], np.int64))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(fp.view(np.int64))], [*held, "fp"])

    return carry.run(per_batch(lambda: work), "fp bigint")


# -- links ---------------------------------------------------------------------------------------
def pivots(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


#: The references of the tables, and those that deal cells.
REFERENCES, DEALERS = pivots(PIVOTS, SEED), pivots(32, SEED + 1)


def table_share(fps: np.ndarray) -> float:
    """The share of all pairs of different fingerprints that the table leaves to be compared bit by bit."""
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    left = sum(int((np.abs(table[i + 1 :] - table[i]) <= MAX_BITS).all(1).sum()) for i in range(len(fps)))
    return left / max(1, len(fps) * (len(fps) - 1) // 2)


def pivot_pairs(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs within MAX_BITS, in pieces, by the pivot distance table."""
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    ends = np.searchsorted(first, first + MAX_BITS, side="right")
    wide = ends - np.arange(len(fps)) - 1
    at = 0
    while at < len(fps):
        to = at + max(1, int(np.searchsorted(np.cumsum(wide[at:]), 1 << 20)))
        n = wide[at:to]
        a = np.repeat(np.arange(at, at + len(n)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
        a, b = order[a], order[b]
        for p in range(1, PIVOTS):
            near = np.abs(table[a, p] - table[b, p]) <= MAX_BITS
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
        yield a[near], b[near]
        at = to


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a and b: the smaller index becomes the root."""
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)


def cell_links(fps: np.ndarray) -> np.ndarray | None:
    """(2, n): each linked fingerprint of a cell with the root of its part of the cell."""
    fps = np.unique(fps)
    root = np.arange(len(fps))
    for a, b in pivot_pairs(fps):
        union(root, a, b)
    while (root[root] != root).any():
        root = root[root]
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack((fps[linked], fps[root[linked]])) if len(linked) else None


def links_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell. Rows come sorted by cell; only one cell's fingerprints are held, eight bytes each."""

    def close(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = cell_links(np.concatenate(pieces)) if pieces else None
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, fp = (np.asarray(batch.column(c)) for c in range(2))
        new = np.flatnonzero(np.diff(cell) != 0) + 1
        for a, b in zip([0, *new], [*new, len(fp)]):
            if cell[a] != now:
                yield from close(held)
                now, held = cell[a], []
            held.append(fp[a:b].view(np.uint64).copy())
    yield from close(held)


def deal_cells(distinct: DataFrame, levels: int) -> DataFrame:
    """(cell, fp): the fingerprints in the cells of the first fixed pivots, cut at the mean distance 31.5."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        cell = np.zeros(len(fp), np.int64)
        for p in DEALERS[:levels]:
            d = np.bitwise_count(fp ^ p)
            near, far = d <= 31 + MAX_BITS, d > 31
            fp, cell = np.concatenate((fp[near], fp[far])), np.concatenate((2 * cell[near], 2 * cell[far] + 1))
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp.view(np.int64))], ["cell", "fp"])

    return distinct.select("fp").mapInArrow(per_batch(lambda: work), "cell bigint, fp bigint")


def cut_cells(full: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(cell, fp) of the halves (or pairs of blocks) of overfull cells, and the links (a, b) to their pivots.

    The median is an approximate one: where a cell is cut affects its cost only."""
    reference = full.groupBy("cell").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), F.col("fp").alias("pivot"))).alias("p")).select("cell", "p.pivot")
    far = full.join(reference, "cell").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))))
    far = materialize(far, "distances")
    span = far.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("most"), F.percentile_approx("d", F.lit(0.5)).alias("m"))
    span = span.withColumn("m", F.least("m", F.col("most") - MAX_BITS - 1))
    halves = far.join(span.drop("n", "most"), "cell").groupBy("cell").agg(F.count_if(F.col("d") <= F.col("m") + MAX_BITS).alias("near"), F.count_if(F.col("d") > F.col("m")).alias("far"))
    span = materialize(span.join(halves, "cell").withColumn("bad", (F.col("near") + F.col("far") > 1.5 * F.col("n")) | (F.greatest("near", "far") > 0.9 * F.col("n"))), "cuts")
    to_pivot = far.where((F.col("d") <= MAX_BITS) & (F.col("d") > 0)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    rows = far.join(span.where(f"most > {MAX_BITS}"), "cell")
    sides = F.array_compact(F.array(F.when(F.col("d") <= F.col("m") + MAX_BITS, 0), F.when(F.col("d") > F.col("m"), 1)))
    blocks = F.ceil(F.col("n") / (FULL // 4)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(turn), F.lit("block")), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * 65536 + F.greatest(own, j) + 2)
    part = F.explode(F.when(F.col("bad"), pairs).otherwise(sides)).alias("part")
    return rows.select("cell", "fp", "bad", part).select(F.xxhash64("cell", "part", F.lit(turn)).alias("cell"), "fp", "bad"), to_pivot


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints whose closure is that of all links."""
    n = distinct.count()
    levels = min(len(DEALERS), max(0, ceil(log(max(1, n / CELL)) / log(1 / 0.6))))
    cells = materialize(deal_cells(distinct, levels), "cells")
    ready, found, turn = [], [], 0
    while True:
        full = materialize(cells.groupBy("cell").count().where(F.col("count") > FULL).select("cell"), "full")
        if full.isEmpty():
            ready.append(cells)
            break
        ready.append(cells.join(full, "cell", "left_anti"))
        cut, to_pivot = cut_cells(cells.join(full, "cell"), turn)
        cut = materialize(cut, "cells")
        found.append(to_pivot)
        ready.append(cut.where("bad").drop("bad"))
        cells, turn = cut.where("not bad").drop("bad"), turn + 1
    every = ready[0]
    for x in ready[1:]:
        every = every.unionByName(x)
    out = every.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(links_of_cells), "a bigint, b bigint")
    for x in found:
        out = out.unionByName(x)
    return out.where("a <> b").dropDuplicates()


# -- components ----------------------------------------------------------------------------------
def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node it reaches.

    Alternates large-star and small-star (connect each node's neighbours to its smallest neighbour) with partial
    minima, until no edge changes. A hub's rows are only joined, never grouped whole, so they can be split."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").dropDuplicates()
    path = new_path(spark, name)
    now = materialize(now, name, path)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").dropDuplicates()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        moved = moved.where("a <> b").dropDuplicates()
        new_at = new_path(spark, name)
        new = materialize(moved, name, new_at)
        # Done when every node has one edge, to a node that has none itself: each tree is a star.
        deep = new.alias("x").join(new.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi")
        twice = new.groupBy("a").count().where("count > 1").select("a")
        done = deep.select("a").unionByName(twice).isEmpty()
        delete_path(spark, path)
        path, now = new_at, new
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).dropDuplicates())


def cluster(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SHINGLE, doc_id: str = "doc_id", similarity: tuple[int, int] | None = None) -> DataFrame:
    """`keep`, fingerprint (hex) and component_id, the least doc_id of the component.

    similarity: a fraction (4, 5) of at least a half; documents link by the Jaccard similarity of their shingle sets."""
    if similarity:
        from .near_copies import groups

        return groups(docs, keep, text, doc_id, size, similarity)
    carry = Carry(docs, keep, text=text, id=docs[doc_id].cast("long"))
    held, at = carry.held, carry.at["text"]
    prints = fingerprints(carry.rows, (*held, "__id"), at, size)
    prints = materialize(prints, "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min(F.col("__id").cast("long")).alias("first")), "firsts")
    roots = components(links(firsts.select("fp")))
    named = roots.join(firsts, F.col("node") == F.col("fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # A table of its own, so that the join below can split a fingerprint that a third of the rows may share.
    ids = materialize(firsts.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "ids")
    found = prints.join(ids, "fp").select(*held, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return carry.named(found, ["fingerprint", "component_id"])
