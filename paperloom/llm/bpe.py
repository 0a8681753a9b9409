"""Byte-level BPE encoding and decoding in two tiers.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a
vocabulary entry (the stored bytes are compared, so a foreign pre-token never passes). Tier 2: the
others go through the merge rule, with a heap of candidate merges over a doubly linked list of
parts; a long run of letters costs n log n. A bounded memo keeps the results of short pre-tokens.

Documents are encoded where they are read (mapInArrow): no shuffle, no state between rows but the
memo. The rank table (under 1 MB) and three patterns are all that is sent to executors.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from paperloom.llm.common import Scratch, map_batches, rows_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of each of the memo's two generations in a task (about 250 bytes each), and the longest pre-token kept.
MEMO_ENTRIES, MEMO_CHARS = 100_000, 48
_MASK = (1 << 64) - 1


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """Ranks by bytes, from a file with a base64 token and its rank on each line."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = h ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class MinimalPerfectHash:
    """n distinct 64-bit keys to 0..n-1 without gaps, in about 4 bits a key.

    Level by level, keys are hashed to a bit array; a key that is alone at its place is settled, the
    others go to the next level. The index of a key is the number of settled places before its own.
    A key that was not in the set gets some index or -1: callers compare what is stored there.
    """

    def __init__(self, keys: np.ndarray, load: float = 2.0):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys share a 64-bit hash; use another seed")
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # size, places, settled before each
        settled, seed = 0, 0
        while len(keys):
            m = max(64, int(load * len(keys)))
            at = (_mixed(keys, seed) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            self.levels.append((m, alone, settled + np.cumsum(alone) - alone))
            settled += int(alone.sum())
            keys, seed = keys[~alone[at]], seed + 1

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for seed, (m, places, before) in enumerate(self.levels):
            at = (_mixed(keys[left], seed) % np.uint64(m)).astype(np.int64)
            hit = places[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def _ranges(chars: Iterable[str]) -> str:
    """The characters as the inside of a character class."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: Texts below this code point are split by the standard library's engine with explicit classes.
LOW = 0x250


@functools.cache
def split_patterns(pattern: str) -> tuple[str, str, str, str]:
    """The patterns for low texts, for others, for texts with odd characters, and of what is odd (empty: nothing). Made by the driver.

    The regex engines carry different Unicode editions. The target's classes are read from the
    target library itself; a character on which they differ sends its text to the third pattern.
    Below LOW the classes are few ranges, which the quicker engine takes as they are.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    low, careful, odd = pattern, pattern, set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        single = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(single.decode_bytes(single.encode_ordinary(every)).decode())
        ours = set(regex.findall(kind, every))
        more, less = theirs - ours, ours - theirs
        odd |= more | less
        if more or less:
            inner = "[" + kind + (f"--[{_ranges(less)}]" if less else "") + (f"||[{_ranges(more)}]" if more else "") + "]"
            careful = careful.replace(kind, inner)
        here = _ranges(c for c in theirs if ord(c) < LOW)
        low = re.sub(rf"(?<!\[)(?<!\[\^){re.escape(kind)}(?![^\[]*\])", lambda _, x=here: f"[{x}]", low)  # on its own
        low = low.replace(kind, here)  # within a class
    low = low.replace(r"\S", f"[^{_ranges(c for c in regex.findall(r'\s', every) if ord(c) < LOW)}]")
    return low, pattern, "(?V1)" + careful, f"[{_ranges(odd)}]" if odd else ""


class Encoder:
    """encode(text) -> ids, decode(ids) -> bytes. Special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], patterns: tuple[str, str, str, str] | None = None):
        low, plain, careful, odd = patterns or split_patterns(default_pattern())
        self.low, self.plain, self.careful = re.compile(low), regex.compile(plain), regex.compile(careful)
        self.high, self.odd = re.compile(f"[^\\x00-\\u{LOW - 1:04x}]"), regex.compile(odd) if odd else None
        tokens = list(ranks)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
        self.mph = MinimalPerfectHash(keys)
        order = self.mph.index(keys)
        self.stored: list[bytes] = [b""] * len(tokens)
        self.ids: list[int] = [0] * len(tokens)
        for at, t in zip(order.tolist(), tokens, strict=True):
            self.stored[at], self.ids[at] = t, ranks[t]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        #: for the rank of a left part: rank of the merged part by the rank of the right part
        self.pairs: list[dict[int, int]] = [{} for _ in self.bytes_of]
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None:
                    self.pairs[x][y] = i
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.high.search(text):
            return self.low.findall(text)
        return (self.careful if self.odd and self.odd.search(text) else self.plain).findall(text)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The lowest-ranked adjacent pair is merged first, the leftmost of equals.

        The heap holds rank and place of the left part in one number; an entry counts only if the
        two parts that now meet there still have that rank.
        """
        single, pairs = self.single, self.pairs
        part = [single[b] for b in word]
        n = len(part)
        bits = n.bit_length()
        heap = [r << bits | i for i, (x, y) in enumerate(zip(part, part[1:])) if (r := pairs[x].get(y)) is not None]
        if not heap:
            return tuple(part)
        if len(heap) > 1:
            heapify(heap)
        after, before, mask = list(range(1, n + 1)), list(range(-1, n)), (1 << bits) - 1
        part.append(-1)
        while heap:
            top = heappop(heap)
            i = top & mask
            j = after[i]
            r = top >> bits
            if (x := part[i]) < 0 or pairs[x].get(part[j]) != r:
                continue
            part[i], part[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs[r].get(part[k])) is not None:
                    heappush(heap, x << bits | i)
            if (h := before[i]) >= 0 and (x := pairs[part[h]].get(r)) is not None:
                heappush(heap, x << bits | h)
        return tuple([p for p in part if p >= 0])

    def resolve(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Both tiers for distinct pre-tokens, through the memo of two generations; long ones are returned, not kept."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.older = {}, self.memo
        memo, older, long = self.memo, self.older, {}
        new = []
        for w in words.difference(memo):
            if (known := older.get(w)) is not None:
                memo[w] = known
            else:
                new.append(w)
        if new:
            raw = [w.encode() for w in new]
            at = self.mph.index(np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(raw))).tolist()
            stored, ids, merge = self.stored, self.ids, self.merge
            for w, b, i in zip(new, raw, at, strict=True):
                (memo if len(w) <= MEMO_CHARS else long)[w] = (ids[i],) if i >= 0 and stored[i] == b else merge(b)
        return long

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[int, ...]]]:
        words = [self.split(t) for t in texts]
        long = self.resolve(set(chain.from_iterable(words)))
        of = self.memo.__getitem__
        if long:
            return ([long[w] if w in long else of(w) for w in ws] for ws in words)
        return (list(map(of, ws)) for ws in words)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(p)) for p in self.pieces(texts)]

    def count_all(self, texts: list[str]) -> list[int]:
        return [sum(map(len, p)) for p in self.pieces(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


#: Rows encoded together; fewer if their texts exceed so many characters.
GROUP_ROWS, GROUP_CHARS = 256, 4_000_000


def _mapped(docs: DataFrame, schema: str, rows, columns: dict[str, pa.DataType], ranks, pattern, source: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then what rows(encoder, values) gives for a group of rows."""
    shared = docs.sparkSession.sparkContext.broadcast((tuple((ranks or vocabulary()).items()), split_patterns(pattern or default_pattern())))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, patterns = shared.value
        enc = Encoder(dict(packed), patterns)  # a quarter of a second; kept by the worker, it would take memory from all later tasks
        for b in batches:
            step = max(1, min(GROUP_ROWS, GROUP_CHARS * b.num_rows // max(1, b.column(n).nbytes)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                cols = rows(enc, part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(c, t) for c, t in zip(cols, columns.values(), strict=True))], names=[*keep, *columns])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows_of(docs, *keep, source), run, f"{kept}, {schema}")


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _texts(values: list[str | None]) -> list[str]:
    return [v or "" for v in values]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., ids array<int>: one row per row of docs, repeated ones too.

    Null and empty texts have no ids; long texts are encoded whole. An empty table gives an empty
    result. Columns that aren't kept are never looked at.
    """
    return _mapped(docs, "ids array<int>", lambda e, v: [e.encode_all(_texts(v))], {"ids": pa.list_(pa.int32())}, ranks, pattern, text_col, keep)


def tokenized(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., n_tokens, ids array<int>, decoded_sha256: encode_documents, and the digest of what the ids decode to.

    The table is saved, in small batches: what reads it, however often, encodes nothing again.
    """

    def rows(enc: Encoder, values: list[str | None]):
        every = enc.encode_all(_texts(values))
        return [list(map(len, every)), every, [_sha(enc.decode(ids)) for ids in every]]

    columns = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded_sha256": pa.string()}
    return Scratch(docs.sparkSession, "bpe").save(_mapped(docs, "n_tokens long, ids array<int>, decoded_sha256 string", rows, columns, ranks, pattern, "text", keep))


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """doc_id, decoded binary: the bytes of each row's ids (null: empty). An unknown id fails the job."""
    return _mapped(encoded, "decoded binary", lambda e, v: [[e.decode(ids or ()) for ids in v]], {"decoded": pa.binary()}, ranks, None, "ids")


def count_tokens(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens long, by the same encoder, without handing the ids on."""
    return _mapped(docs, "n_tokens long", lambda e, v: [e.count_all(_texts(v))], {"n_tokens": pa.int64()}, ranks, pattern, "text")


def round_trip(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids decoded again.

    ids_sha256 is over the decimal ids joined by one space. One row per row of docs, as in encode_documents.
    """

    def rows(enc: Encoder, values: list[str | None]):
        every = enc.encode_all(_texts(values))
        return [list(map(len, every)), [_sha(enc.decimal(ids).encode()) for ids in every], [_sha(enc.decode(ids)) for ids in every]]

    return _mapped(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, ranks, pattern, "text")
