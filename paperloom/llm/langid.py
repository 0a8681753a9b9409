"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot is a mask with one bit for each language
(of several words where there are more than 64), and an n-gram sets its language's bit in HASHES slots.
The AND of an n-gram's slots is the set of languages that contain it. Per language the hits are counted, corrected for the share
that false positives add, and weighed by how few languages a hit leaves open; the best one decides.

Learning: each task counts byte n-grams of its documents by language (exact 64-bit codes of 6 bytes),
Spark adds the counts, and n-grams above a share of their language's total are kept. At most
1 / MIN_SHARE n-grams a language can have that share, whatever the input: that bounds the filter,
which is what is sent to executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, id_crc, map_batches, rows_of

N = 6
HASHES = 4
#: An n-gram is kept if it makes up this share of its language's n-grams.
MIN_SHARE = 5e-6
#: Slots for each kept n-gram of the largest language.
SLOTS_PER_GRAM = 12
UNDEFINED = "und"
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and the offsets of each (null: empty)."""
    col = col.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def grams(data: np.ndarray, n: int = N) -> np.ndarray:
    """The code of the n bytes from each position on: A-Z lower-cased, gaps and digits as one space, padded by spaces at the end."""
    x = np.where((data >= 65) & (data <= 90), data + 32, data)
    x = np.where(_GAPS[x] | ((x >= 48) & (x <= 57)), 32, x).astype(np.uint64)
    x = np.concatenate([x, np.full(n - 1, 32, dtype=np.uint64)])
    code = np.zeros(len(data), dtype=np.uint64)
    for i in range(n):
        code = code << np.uint64(8) | x[i : i + len(data)]
    return code


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """True for positions whose n-gram lies within one text (one gap past its end is allowed)."""
    ok = np.ones(offsets[-1], dtype=bool)
    for k in range(1, n - 1):
        at = offsets[1:] - k
        ok[at[at >= offsets[:-1]]] = False
    return ok


def slots(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(33)) | np.uint64(1)
    for _ in range(HASHES):
        yield (h & np.uint64(size - 1)).astype(np.int64)
        h = h + step


class Filter:
    """Words of slots of language masks, the languages, and each language's share of false positives."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = sorted(by_language)
        most = max([1, *(len(g) for g in by_language.values())])
        self.size = 1 << int(np.ceil(np.log2(most * SLOTS_PER_GRAM)))
        width = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(self.languages) <= bits or bits == 64)
        self.bits = np.dtype(width).itemsize * 8
        self.words = [np.zeros(self.size, dtype=width) for _ in range(0, len(self.languages), self.bits)]
        for i, name in enumerate(self.languages):
            for at in slots(by_language[name], self.size):
                self.words[i // self.bits][at] |= width(1 << i % self.bits)
        self.false = [float(np.mean(self.bit(self.words, i))) ** HASHES for i in range(len(self.languages))]

    def bit(self, words: list[np.ndarray], language: int) -> np.ndarray:
        """1 where the masks hold the language, else 0."""
        w = words[language // self.bits]
        return w >> w.dtype.type(language % self.bits) & w.dtype.type(1)

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, all languages that contain it (and, rarely, one that doesn't), in words."""
        out: list[np.ndarray] = []
        for at in slots(codes, self.size):
            out = [m & w[at] for m, w in zip(out, self.words, strict=True)] if out else [w[at] for w in self.words]
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected weight of hits by text and language."""
        masks, outside = self.masks(grams(data)), ~_inside(offsets, N)
        for m in masks:
            m[outside] = 0
        bits = [self.bit(masks, i).astype(np.float64) for i in range(len(self.languages))]
        open_ = np.maximum(sum(bits), 1)
        n = np.diff(offsets).astype(np.float64)
        cols = []
        for b, false in zip(bits, self.false, strict=True):
            run = np.concatenate([[0.0], np.cumsum(b / open_**2)])
            hits = run[offsets[1:]] - run[offsets[:-1]]
            cols.append(np.maximum(hits - n * false, 0) / (1 - min(false, 0.99)))
        return np.stack(cols, axis=1) if cols else np.zeros((len(n), 0))


def learn(docs: DataFrame, min_share: float = MIN_SHARE) -> Filter:
    """docs: text and lang. Rows without a text or lang teach nothing; n-grams are counted over all others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def added(lang: str, codes: np.ndarray, n: np.ndarray) -> None:
            if lang in sums:
                codes, n = np.concatenate([sums[lang][0], codes]), np.concatenate([sums[lang][1], n])
            codes, inverse = np.unique(codes, return_inverse=True)
            sums[lang] = codes, np.bincount(inverse, weights=n).astype(np.int64)

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            for lang in [k for k, v in sums.items() if len(v[0]) > least]:
                codes, n = sums.pop(lang)
                for at in range(0, len(codes), 100_000):
                    c = codes[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c)), "gram": c.astype(np.int64), "n": n[at : at + 100_000]})

        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                langs = b.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    data, offsets = _buffer(b.column(0).filter(pa.array([x == lang for x in langs])))
                    codes = grams(data)[_inside(offsets, N)]
                    added(lang, *np.unique(codes, return_counts=True))
                yield from flushed(1_000_000)
        yield from flushed(-1)

    rows = rows_of(docs, "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = map_batches(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession, "langid")
    saved = scratch.save(counted)
    totals = saved.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = saved.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.greatest(F.lit(2), F.col("total") * min_share)).groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams"))  # at most 1 / min_share a language
    by = {r["lang"]: np.zeros(0, dtype=np.uint64) for r in totals.select("lang").collect()}
    for batch in kept.toArrow().to_batches():
        grams_of = batch.column(1)
        by |= {lang: np.sort(grams_of[i].values.to_numpy().view(np.uint64)) for i, lang in enumerate(batch.column(0).to_pylist())}
    scratch.drop(saved)
    return Filter(by)


def predict(docs: DataFrame, model: Filter, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra..., lang_pred, score: one row per row of docs, from the text alone.

    `und` with score 0 for a null text, a text without a letter, or an empty model. A text without
    any hit gets the first language, with score 0. Ties go to the first language in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDEFINED], dtype=object)
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                s = m.scores(*_buffer(b.column(len(keep))))
                lettered = b.column(len(keep) + 1).fill_null(False).to_numpy(zero_copy_only=False)
                if not m.languages:
                    best, top, total = np.zeros(len(s), dtype=np.int64), np.zeros(len(s)), np.ones(len(s))
                    lettered = np.zeros(len(s), dtype=bool)
                else:
                    best, top, total = s.argmax(axis=1), s.max(axis=1), s.sum(axis=1)
                score = np.where(lettered & (total > 0), top / np.maximum(total, 1e-12), 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(names[np.where(lettered, best, len(names) - 1)]), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    lettered = F.col("text").rlike(r"\p{L}").alias("lettered__")
    return map_batches(docs.select(*keep, "text", lettered), run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows that aren't held out, predicted for all; one row per row of docs.

    Repeated rows teach as often as they are there; a null id is held out or not as the empty text. An
    empty table gives an empty result, and rows without a language to learn from give `und` throughout.
    Long texts count whole. Columns but doc_id, text and lang are never looked at.
    """
    d = rows_of(docs, "doc_id", "text", "lang").withColumn("held_out", id_crc(F.col("doc_id")) % modulus == held)
    model = learn(d.filter(~F.col("held_out")))
    return predict(d.select("doc_id", "held_out", "text"), model, ("held_out",))
