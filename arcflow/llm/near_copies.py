"""SimHash near-dedup at a similarity: documents whose sets of word shingles have a Jaccard similarity of at least 4/5
(or another fraction) link, and links are closed into components.

1. Documents with the same set of shingles are one node, named by a hash of the set; each has the SimHash fingerprint of
   its set.
2. The pivot distance tables of `simhash` link the fingerprints within two bits; the sets of these links are compared,
   and those that are near become edges. That thins dense groups of copies before any pair is listed.
3. At a similarity of 0.8 fingerprints of 64 bits differ by about ten bits, at which distance the table of a pivot
   leaves nearly all pairs. So the links beyond two bits are completed exactly: a set's shingles are put in an order that
   all sets share, and two near sets have a shingle in common among the first n - ceil(4n/5) + 1 of each; only these are
   dealt out as keys. The order puts shingles of a low count first; the counts are kept in `SLOTS` hashed slots, which is
   enough since any shared order is exact.
4. A key of many nodes is thinned before its pairs are listed: in a star round each of its nodes is compared with one
   node of the key, and what links becomes one component. Then all pairs of a key that lie in different components,
   and that their sizes and places allow, are listed and verified, however many they are.

Shingles are hashes of 64 bits, combined from hashes of their words; sets are compared by these values.

Defined results: a text without words is a near copy of every other such text; a text of fewer words than a shingle has
one shingle; a component whose documents all lack a doc_id has a null component_id; repeated rows are all returned; a
kept column called fingerprint or component_id comes back as input_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, SPACES, Carry, byte_texts, materialize, per_batch, pieces, released
from .simhash import components, links, majority

SHINGLE = 5
#: The least similarity as a fraction.
NEAR = (4, 5)
#: Slots of the counts that order the shingles.
SLOTS = 1 << 18
#: Pairs of different components for each row of a key up to which no star round is needed.
PAIRS_A_ROW = 16
#: Shingles that a verifying task keeps of the texts before.
HELD = 1 << 20
#: Bytes whose words are hashed at once.
PART = 1 << 19
#: Lower-cased, and every white space a blank.
BLANK = bytes(32 if b in SPACES else LOWER[b] for b in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xFF51AFD7ED558CCD)
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR and its inverse modulo 2^64, to the powers 0 to n - 1; the longest so far is kept."""
    if len(POWERS[0]) < n:
        inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
        for i, x in enumerate((FACTOR, inverse)):
            POWERS[i] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x))), dtype=np.uint64)
    return POWERS[0][:n], POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of blank-separated bytes begins, and its hash: the polynomial of its bytes in FACTOR, mixed.

    Sums of all bytes times rising powers give every word's polynomial at once; long texts are cut at blanks."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end + 1
        codes = np.frombuffer(data, np.uint8, end - at, at)
        letter = np.concatenate(([False], codes != 32, [False]))
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        first, last = edges[::2], edges[1::2]
        up, down = powers(len(codes))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
        starts.append(first + at)
        hashes.append(mixed((total[last] - total[first]) * down[first]))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's different shingles, sorted, one text after another, and how many each has."""
    places, h = word_hashes(b" ".join(texts).translate(BLANK))
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    cuts = np.searchsorted(places, bounds)
    counts, first = np.diff(cuts), cuts[:-1]
    whole = np.minimum(counts, size)
    sizes = counts - whole + (counts > 0)
    starts = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    width = np.repeat(whole, sizes)
    short = bool((width < size).any())
    value = width.astype(np.uint64)
    for k in range(size):
        # A text shorter than a shingle is combined of the words it has.
        new = mixed(value * FACTOR + h[np.minimum(starts + k, len(h) - 1)])
        value = np.where(k < width, new, value) if short else new
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        value[a:b].sort()
    doc = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(texts)).astype(np.int64)


def runs_of(batch_texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingle_sets of pieces of a batch, so that what is held stays small."""
    for part in pieces(batch_texts):
        yield shingle_sets(part, size)


def each(hashes: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        yield hashes[a:b]


def prefix_length(n: np.ndarray, near: tuple[int, int]) -> np.ndarray:
    return np.where(n > 0, n + (-near[0] * n) // near[1] + 1, 0)


def named(rows: DataFrame, text: str, size: int) -> DataFrame:
    """rows with id (the hash of the text's set of shingles) and fp (the set's fingerprint)."""
    names = rows.columns

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, fps = [], []
            for hashes, sizes in runs_of(byte_texts(batch.column(text)), size):
                ids += [xxh64_intdigest(x.tobytes()) for x in each(hashes, sizes)]
                fps.append(majority(hashes, sizes))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64))], [*names, "id", "fp"])

        return work

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(per_batch(make), f"{fields}, id bigint, fp bigint")


def slot_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets have a shingle of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for hashes, _ in runs_of(byte_texts(batch.column(0)), size):
                counts += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["slot", "n"])

    found = texts.select("text").mapInArrow(released(run), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[np.asarray(found.column("slot"))] = np.asarray(found.column("n"))
    return counts


def prefixes(texts: DataFrame, size: int, near: tuple[int, int]) -> DataFrame:
    """(key, id, size, place): the shingles of each set that come first in the shared order."""
    shared = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, size))

    def make():
        counts = np.minimum(shared.value, (1 << 24) - 1).astype(np.uint64)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sets = [], []
            for hashes, sizes in runs_of(byte_texts(batch.column(1)), size):
                # By count, then by hash: the sets are sorted, and the sort below keeps that order in ties.
                order = (counts[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)] << np.uint64(40)) | (hashes >> np.uint64(24))
                for own, by, k in zip(each(hashes, sizes), each(order, sizes), prefix_length(sizes, near).tolist()):
                    keys.append(own[np.argsort(by, kind="stable")[:k]])
                sets.append(sizes)
            sizes = np.concatenate(sets)
            n = np.array([len(k) for k in keys], np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = np.repeat(np.asarray(batch.column(0)), n)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(ids), pa.array(np.repeat(sizes, n).astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "id", "size", "place"])

        return work

    return texts.select("id", "text").mapInArrow(per_batch(make), "key bigint, id bigint, size int, place int")


def verified(pairs: DataFrame, texts: DataFrame, size: int, near: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of a similarity of at least near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            keep = []
            sides = [(batch.column(c).to_pylist(), byte_texts(batch.column(f"text_{c}"))) for c in ("a", "b")]
            for i in range(batch.num_rows):
                own = []
                for ids, found in sides:
                    one = sets.get(ids[i])
                    if one is None:
                        one = shingle_sets([found[i]], size)[0]
                        if held > HELD:
                            sets, held = {}, 0
                        sets[ids[i]] = one
                        held += len(one)
                    own.append(one)
                x, y = own
                both = len(np.intersect1d(x, y, assume_unique=True))
                if near[1] * both >= near[0] * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")), c)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a bigint, b bigint")


def sizes_allow(a: str, b: str, near: tuple[int, int], one_way: bool = False) -> Column:
    """Whether sets of these sizes can be near; one_way asks only that a is large enough for b."""
    if one_way:
        return F.col(a) * near[1] >= F.col(b) * near[0]
    return (F.col(a) * near[1] >= F.col(b) * near[0]) & (F.col(b) * near[1] >= F.col(a) * near[0])


def print_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of sets that the pivot tables of the fingerprints link: sets of one fingerprint with its first, and firsts."""
    firsts = materialize(sets.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    same = sets.join(firsts, "fp").where(F.col("id") != F.col("first")).select(F.col("id").alias("a"), F.col("first").alias("b"))
    linked = links(firsts.select("fp"))
    for c in ("a", "b"):
        linked = linked.join(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"id_{c}")), c)
    return same.unionByName(linked.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))).dropDuplicates()


def star_pairs(now: DataFrame, degree: DataFrame, turn: int, near: tuple[int, int]) -> DataFrame:
    """Each node of a key with one node of the key: the one with most shared keys, and in odd turns any, another each turn.

    Copies of one text have keys of their own for what was changed in them; the text itself shares nearly all of its keys."""
    by = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "root", "size") if turn % 2 else F.struct(-F.col("degree"), F.xxhash64("id", F.lit(turn)).alias("h"), "id", "root", "size")
    leaders = now.join(degree, "id").groupBy("key").agg(F.min(by).alias("l"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    leaders = leaders.select("key", F.col("l.id").alias("l_id"), F.col("l.root").alias("l_root"), F.col("l.size").alias("l_size"))
    met = now.join(leaders, "key").where((F.col("root") != F.col("l_root")) & sizes_allow("size", "l_size", near))
    return met.select(F.greatest("id", "l_id").alias("a"), F.least("id", "l_id").alias("b")).dropDuplicates()


def cross_pairs(now: DataFrame, parts: DataFrame, near: tuple[int, int]) -> DataFrame:
    """All pairs of a key that lie in different components and can be near by their sizes and places.

    Components of a key are paired first, by the bounds of their sizes and rests, so the nodes of one component never meet,
    nor those of two that are too different."""
    left, right = (parts.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("root", "low", "high", "rest"))) for s in ("x", "y"))
    may = sizes_allow("x_high", "y_low", near, True) & sizes_allow("y_high", "x_low", near, True)
    may &= F.least("x_rest", "y_rest") * sum(near) >= (F.col("x_low") + F.col("y_low")) * near[0]
    met = left.join(right, "key").where((F.col("x_root") < F.col("y_root")) & may).select("key", "x_root", "y_root")
    for s in ("x", "y"):
        met = met.join(now.select("key", F.col("root").alias(f"{s}_root"), F.col("id").alias(s), F.col("size").alias(f"{s}_size"), F.col("place").alias(f"{s}_place")), ["key", f"{s}_root"])
    # From the first shingle that both have on, the rest must hold near / (1 + near) of both sizes.
    rest = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    met = met.where(sizes_allow("x_size", "y_size", near) & (rest * sum(near) >= (F.col("x_size") + F.col("y_size")) * near[0]))
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).dropDuplicates()


def groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """`keep`, fingerprint (hex) and component_id, the least doc_id of the near copies."""
    carry = Carry(docs, keep, text=text, id=docs[doc_id].cast("long"))
    sets = materialize(named(carry.rows, carry.at["text"], size), "sets")
    texts = sets.select("id", F.col(carry.at["text"]).alias("text"))
    dealt = materialize(prefixes(texts, size, near), "prefixes")
    shared = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    rows = materialize(dealt.join(shared, "key").dropDuplicates(["key", "id"]), "candidates")
    wanted = materialize(rows.groupBy("id").agg(F.count("*").alias("degree")), "wanted")
    texts = materialize(texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
    # Sets that share no key are near to none, so the fingerprints of the others suffice.
    prints = sets.select("id", "fp").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    edges = materialize(verified(print_pairs(materialize(prints, "nodes")), texts, size, near), "near")
    turn, before = 0, None
    while True:
        roots = materialize(components(edges), "roots")
        now = rows.join(roots, F.col("id") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "id").alias("root"))
        parts = now.groupBy("key", "root").agg(F.count("*").cast("double").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - F.col("place")).alias("rest"))
        all_of = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        total = all_of.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0)).alias("pairs")).first()
        # Once the stars no longer halve the pairs, all that are left are listed.
        last = total["pairs"] <= PAIRS_A_ROW * total["n"] or (before is not None and total["pairs"] > before / 2)
        before = total["pairs"]
        pairs = materialize(cross_pairs(now, parts, near) if last else star_pairs(now, wanted, turn, near), "pairs")
        edges = materialize(verified(pairs, texts, size, near).unionByName(edges), "near")
        if last:
            break
        turn += 1
    roots = components(edges)
    firsts = sets.groupBy("id").agg(F.min(F.col("__id").cast("long")).alias("first"), F.count("*").alias("rows"))
    firsts = materialize(firsts.join(roots, F.col("id") == F.col("node"), "left").select("id", "first", "rows", F.col("root")), "firsts")
    least = firsts.where("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    # Only sets that are linked or shared need a row; a table of its own lets the join below split a set of many rows.
    some = firsts.where("rows > 1 or root is not null").join(least, "root", "left").select("id", F.coalesce("component_id", "first").alias("component"))
    ids = materialize(some, "ids")
    found = sets.join(ids, "id", "left").select(*carry.held, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", F.col("__id").cast("long")).alias("component_id"))
    return carry.named(found, ["fingerprint", "component_id"])
