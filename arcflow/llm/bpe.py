"""BPE encoding and decoding with a contiguous rank array.

A short word is held as two parallel arrays: the token of each part (its boundary) and the rank of the
merge of that part with the next one. The encoder scans the ranks for the minimum, deletes the boundary
between the two parts, and refreshes the two neighbouring ranks, until no merge is left. That costs the
square of a word's length, which suits short words; longer words keep a heap over the same arrays
(`HEAP_FROM`), so that a word of a million letters costs n log n.

Words repeat, so a bounded cache of two generations keeps the results for white-space separated chunks.

Defined results: a null or empty text has no tokens; special tokens written in a text keep their ids, as the
tokenizers library does; repeated rows give repeated results; columns that the operator does not use are
passed through when named in `keep`, as input_<name> where they bear the name of one of the result's. Letters that are
newer than Python's Unicode tables are classed and normalised by the tables of the tokenizers library, if it is there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

try:
    import tokenizers
except ImportError:  # then letters newer than Python's Unicode tables are symbols
    tokenizers = None

from .common import Carry, released

#: Parts from which on a word's merges are kept in a heap.
HEAP_FROM = 64
#: Chunks in one generation of the cache of a Python worker.
CACHE = 120_000
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def newer_letters() -> tuple[str, str]:
    """Letters and digits that the regex module knows and Python's Unicode tables do not yet, and those of them that are
    neither to the tokenizers library, whose tables are of a third age (all of them where it is not installed)."""
    found = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    newer = "".join(c for c in found if unicodedata.category(c) == "Cn")
    if tokenizers is None:
        return newer, newer
    pieces = tokenizers.pre_tokenizers.Split(tokenizers.Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(newer)
    return newer, "".join(t for t, _ in pieces)


class RankArrayBPE:
    """Encoder and decoder for a tokenizer file of the kind `word_bpe` (BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_alphabet()
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + suffix) for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        splits = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.usual = regex.compile(splits).findall
        known, unknown = newer_letters()
        self.newer = frozenset(known)
        newer = f"[{unknown}]" if unknown else "[^\\s\\S]"
        for kind in ("L", "N"):
            splits = splits.replace(rf"[\p{{{kind}}}]", rf"[\p{{{kind}}}--{newer}]")
        splits = splits.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{newer})")
        self.unusual = regex.compile(splits, regex.VERSION1).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.markers = tuple(self.special)
        ids = sorted(self.names)
        self.id_bytes = {i: i.to_bytes(4, "little") for i in ids}
        self.name_bytes = {i: f"{self.names[i]} ".encode() for i in ids}
        self.clear()

    def clear(self) -> None:
        """Empty the caches: of chunks of text and of words, each in two generations."""
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.new_words: dict[str, tuple[bytes, bytes]] = {}
        self.old_words: dict[str, tuple[bytes, bytes]] = {}

    # -- merging ---------------------------------------------------------------------------------
    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one word given as bytes; the last part carries the word end."""
        parts = [*(self.inner[b] for b in word[:-1]), self.final[word[-1]]]
        parts = [p for p in parts if p is not None]
        if len(parts) < 2:
            return parts
        return self._scan(parts) if len(parts) < HEAP_FROM else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        ranks = [self.ranks.get(p, NO_RANK) for p in zip(parts, parts[1:])]
        get = self.ranks.get
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            token = parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((token, parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1], token), NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        ranks, n = self.ranks, len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def pieces(self, chunk: str) -> list[str]:
        return self.usual(chunk) if max(chunk, default="") < "\u0500" else self.unusual(chunk)

    # -- texts -----------------------------------------------------------------------------------
    def normalize(self, chunk: str) -> str:
        if tokenizers is not None and not self.newer.isdisjoint(chunk):
            return NORMALIZER.normalize_str(chunk)  # cases and compositions of letters that Python does not know
        chunk = unicodedata.normalize("NFC", chunk)
        return chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Ids (little-endian) and token strings (UTF-8, each followed by a space) of a word."""
        found = self.new_words.get(word) or self.old_words.get(word)
        if found is None:
            ids = self.merge_word(word.encode())
            found = b"".join(map(self.id_bytes.__getitem__, ids)), b"".join(map(self.name_bytes.__getitem__, ids))
        if len(word) < 64:
            if len(self.new_words) >= CACHE:
                self.old_words, self.new_words = self.new_words, {}
            self.new_words[word] = found
        return found

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """The same of text without white space."""
        found = self.old.get(chunk)
        if found is None:
            if chunk.isascii() and chunk.isalpha():
                found = self._word(chunk.lower())
            else:
                words = [self._word(w) for w in self.pieces(self.normalize(chunk))]
                found = words[0] if len(words) == 1 else (b"".join([w[0] for w in words]), b"".join([w[1] for w in words]))
        if len(chunk) < 64:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[chunk] = found
        return found

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        if self.cut and any(m in text for m in self.markers):
            out = []
            for section in self.cut(text):
                if section in self.special:
                    out.append((np.array([self.special[section]], "<u4").tobytes(), f"{section} ".encode()))
                else:
                    out += [self.new.get(c) or self._chunk(c) for c in split(section)]
            return out
        get, make = self.new.get, self._chunk
        return [get(c) or make(c) for c in split(text)]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(p[0] for p in self.parts(text or "")), "<u4")

    def decode(self, ids) -> str:
        """The strings of the tokens, joined by spaces, as the library does for a file without a decoder."""
        return " ".join(self.names[int(i)] for i in ids if int(i) in self.names)


NORMALIZER = tokenizers and tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()])
#: Characters that str.split() takes for white space and the tokenizer's pattern does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def split(text: str) -> list[str]:
    """Chunks between white space in the sense of the tokenizer file."""
    if any(c in text for c in NOT_SPACE):
        return [c for c in regex.split(r"[^\S\x1c-\x1f]+", text) if c]
    return text.split()


@lru_cache(maxsize=2)
def load(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns `keep`, n_tokens, ids_sha256 and decoded_sha256, and where they are asked for ids (array<int>) and decoded.
    """
    own = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ids * ", ids array<int>" + decoded * ", decoded string"
    carry = Carry(df, keep, text=text)
    held, at = carry.held, carry.at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, dec_sha, all_ids, all_dec = [], [], [], [], []
            for t in batch.column(at).to_pylist():
                parts = model.parts(t or "")
                found = b"".join([p[0] for p in parts])
                text = b"".join([p[1] for p in parts])[:-1]
                n.append(len(found) >> 2)
                ids_sha.append(hashlib.sha256(found).hexdigest())
                dec_sha.append(hashlib.sha256(text).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(found, "<u4").astype(np.int32))
                if decoded:
                    all_dec.append(text.decode())
            out = [batch.column(c) for c in held] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            names = [*held, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if decoded:
                out.append(pa.array(all_dec, pa.string()))
                names.append("decoded")
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            if batch.num_rows:
                yield work(batch)
        model.clear()  # workers are used again

    return carry.run(released(run), own)
