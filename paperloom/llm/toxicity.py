"""Toxicity by weak supervision.

1. Lexicon. Words, and beginnings of words, that are far more frequent in documents labelled toxic
   are collected from at most MAX_LABELLED labelled documents (the rows with the least hash of id).
2. Voters. Each strong term is a voter, the others are dealt out to shared voters; patterns (shouting,
   exclamation, address, density of hits) vote as well. A voter fires on a document or not.
3. Label model. Over all documents, the rates at which voters fire, alone and in pairs, are counted.
   For three voters that are independent given the label, the covariances give each one's strength
   (c_ij c_ik / c_jk); its median over all triples is used. What a pair's covariance holds beyond the
   product of the two strengths is their correlation; correlated voters share their evidence.
4. The model's posterior labels train a logistic regression on the voters and the counts of hits, and
   a scale and an offset fitted to the labelled documents make its scores probabilities.

What is held by the driver: counts for each pair of voters, the terms (each in a fixed share of the
labelled toxic documents at least), and the bounded labelled sample as one short row of numbers each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, id_crc, map_batches, rows_of

#: Labelled documents that terms and weights are learnt from.
MAX_LABELLED = 40_000
#: A term is in at least this share of the toxic labelled documents; at least PRECISE of its labelled documents are toxic; and that is no chance.
LEAST_SHARE, PRECISE, CHANCE = 0.002, 0.5, 20
#: A toxic document with so many words of kept terms supports no further term.
EXPLAINED = 3
#: Voters made of single terms, and of shared ones.
OWN_VOTERS, SHARED_VOTERS = 32, 8
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{4,}\b")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(words: set[str]) -> set[str]:
    """Whole words, marked by a final gap, and beginnings."""
    out = {w + " " for w in words}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def labelled(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, toxic of at most `bound` rows that may teach: not held out, label given; the largest label of a repeated id holds."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(id_crc(F.col("doc_id")) % 4 != 2)
    once = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def first_shingle(text: str, width: int = 5) -> int:
    """The least hash of a text's word shingles: near copies mostly share it, other texts don't."""
    words = text.lower().split()
    if len(words) <= width:
        return xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + width])) for i in range(len(words) - width + 1)) >> 1


def without_copies(sample: DataFrame) -> DataFrame:
    """text, toxic: of documents that share their least shingle, the one of the least id, so that copies don't make their words look telling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([first_shingle(t or "") for t in texts], pa.int64())], names=["doc_id", "text", "toxic", "first"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = map_batches(sample.select("doc_id", "text", "toxic"), run, f"doc_id {kind}, text string, toxic int, first long")
    return rows.groupBy("first").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("r")).select("r.text", "r.toxic")


def surprise(bad: float, good: float, rate: float) -> float:
    """Information (nats) that a term's documents give against the base rate."""
    share = bad / (bad + good) if bad else 0.0
    return bad * math.log(share / rate) + (good * math.log((1 - share) / (1 - rate)) if good else 0.0) if share > rate else 0.0


def mine(sample: DataFrame, scratch: Scratch) -> list[str]:
    """Terms by falling frequency in toxic documents. sample: text, toxic.

    Candidates pass a test of significance over all terms. In order of significance, one is then kept
    only if it still passes on the toxic documents that hold fewer than EXPLAINED kept terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            terms = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "bad": pa.array([sums[1][t] for t in terms], pa.int64()), "good": pa.array([sums[0][t] for t in terms], pa.int64())})
            sums[0].clear()
            sums[1].clear()
            return out

        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[int(toxic > 0)].update(terms_of(words_of(text or "")))
                if len(sums[0]) + len(sums[1]) > 50_000:
                    yield flushed()
        yield flushed()

    n_docs, bad_docs = sample.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    counted = scratch.save(map_batches(sample.select("text", "toxic"), count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    rate = min(max(bad_docs / max(1, n_docs), 1e-3), 0.999)
    least = math.log(max(1, counted.count()) * CHANCE)
    # a share of the toxic documents at least, so the number of candidates is bounded by words a document
    likely = counted.filter((F.col("bad") >= max(2, LEAST_SHARE * bad_docs)) & (F.col("bad") >= PRECISE * (F.col("bad") + F.col("good"))))
    found = {r["term"]: (r["bad"], r["good"]) for r in likely.collect()}
    found = {t: v for t, v in found.items() if surprise(*v, rate) >= least}
    roots = {t.strip()[: PREFIXES[0]] for t in found}

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[w for w in words_of(t or "") if w[: PREFIXES[0]] in roots] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string()))], names=["words"])

    held = [sorted(r["words"]) for r in sample.filter("toxic > 0").select("text").mapInArrow(holding, "words array<string>").collect()]  # at most `bound` rows
    having: dict[str, list[tuple[int, str]]] = {}
    for d, words in enumerate(held):
        for w in words:
            for t in terms_of({w}) & found.keys():
                having.setdefault(t, []).append((d, w))
    hits: list[set[str]] = [set() for _ in held]
    kept = []
    for t in sorted(found, key=lambda t: (-surprise(*found[t], rate), len(t), t)):
        new = {d for d, w in having.get(t, ()) if len(hits[d] - {w}) < EXPLAINED and w not in hits[d]}
        if len(new) >= PRECISE * (len(new) + found[t][1]) and surprise(len(new), found[t][1], rate) >= least:
            kept.append(t)
            for d, w in having[t]:
                hits[d].add(w)
    return sorted(kept, key=lambda t: (-found[t][0], t))


@dataclass
class Voters:
    """terms to voters; after the terms' voters come the patterns'."""

    terms: list[str]

    def __post_init__(self) -> None:
        own = min(OWN_VOTERS, len(self.terms))
        self.voter = {t: i if i < own else own + i % SHARED_VOTERS for i, t in enumerate(self.terms)}
        self.n = own + (SHARED_VOTERS if len(self.terms) > own else 0) + 4
        self.roots = {t.strip()[: PREFIXES[0]] for t in self.terms}

    def look(self, text: str) -> tuple[list[int], int, int]:
        """(voters that fire, distinct words found, all distinct words)."""
        words = words_of(text)
        roots, voter, hits = self.roots, self.voter, set()
        for w in words:
            if w[:4] in roots:
                for t in (w + " ", w[:4], w[:5], w[:6]):
                    if t in voter:
                        hits.add((w, voter[t]))
        fired = {v for _, v in hits}
        n, found = self.n - 4, len({w for w, _ in hits})
        if text.count("!") * 50 > len(words):
            fired.add(n)
        if len(_SHOUT.findall(text)) * 10 > len(words):
            fired.add(n + 1)
        if found >= 2:
            fired.add(n + 2)
        if found * 50 >= len(words) and found:
            fired.add(n + 3)
        return sorted(fired), found, len(words)


def votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """All columns of docs but text, then fired, hits, words: whole texts, null as empty."""
    keep = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                seen = [v.look(t or "") for t in b.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([s[0] for s in seen], pa.list_(pa.int32())), pa.array([s[1] for s in seen], pa.int32()), pa.array([s[2] for s in seen], pa.int32())], names=[*keep, "fired", "hits", "words"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, "text"), run, schema + "fired array<int>, hits int, words int")


def pair_counts(voted: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(documents, how often voters fire together): over all rows."""
    pairs = voted.select(F.explode("fired").alias("i"), "fired").select("i", F.explode("fired").alias("j")).groupBy("i", "j").count().collect()
    both = np.zeros((n, n))
    for r in pairs:
        both[r["i"], r["j"]] = r["count"]
    return voted.count(), both


class LabelModel:
    """Rates at which each voter fires on toxic and on other documents, the pairs' correlations, and posteriors."""

    def __init__(self, n_docs: int, both: np.ndarray, prior: float):
        p = both / max(1, n_docs)
        m = np.diag(p).copy()
        cov = p - np.outer(m, m)
        v = len(m)
        strength = np.zeros(v)
        for i in range(v):
            found = []
            for j in range(v):
                for k in range(j):
                    if i not in (j, k) and cov[i, j] > 0 and cov[i, k] > 0 and cov[j, k] > 0:
                        found.append(cov[i, j] * cov[i, k] / cov[j, k])
            strength[i] = np.sqrt(np.median(found)) if found else 0.0
        self.prior = prior = min(max(prior, 1e-3), 0.999)
        low = 1.0 / max(2, n_docs)
        odds = np.sqrt((1 - prior) / prior)
        self.fires = np.clip(m + strength * odds, low, 1 - low)
        self.errs = np.clip(m - strength / odds, low, 1 - low)
        self.fires = np.maximum(self.fires, self.errs)
        # of a pair's covariance, what the label doesn't explain
        scale = np.sqrt(np.outer(m * (1 - m), m * (1 - m))) + 1e-12
        self.correlation = np.clip((cov - np.outer(strength, strength)) / scale, 0, 1)
        np.fill_diagonal(self.correlation, 1)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """fired: documents x voters, 0 or 1. The evidence of voters that fire together beyond chance counts once between them."""
        share = 1 / np.maximum(fired @ self.correlation, 1)
        yes = np.log(self.fires / self.errs)
        no = np.log((1 - self.fires) / (1 - self.errs))
        z = np.log(self.prior / (1 - self.prior)) + (fired * share) @ yes + (1 - fired) @ no
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(fired: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Voters, then: any term, two, three, log of hits, of their density, and of the length."""
    h, w = hits.astype(float), words.astype(float)
    return np.column_stack([fired, h > 0, h > 1, h > 2, np.log1p(h), np.log1p(1000 * h / (w + 20)), np.log1p(w) / 10])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the offset) by Newton's method; y may be probabilities."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    scale: tuple[float, float]

    def score(self, fired: list[list[int]], hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = features(dense(fired, self.voters.n), hits, words)
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


def dense(fired: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros((len(fired), n))
    for i, f in enumerate(fired):
        out[i, f] = 1
    return out


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, bound: int = MAX_LABELLED) -> tuple[Model, DataFrame]:
    """The model, and the votes of all rows (doc_id, fired, hits, words). Without labels every score is near 0."""
    docs = rows_of(docs, "doc_id", "text")
    known = scratch.save(labelled(docs, labels, bound))
    # at most `bound` rows of two numbers are sent out, and as many texts come in
    texts = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic")
    sample = scratch.save(without_copies(texts))
    voters = Voters(mine(sample, scratch))
    voted = scratch.save(votes(docs, voters))
    n_docs, both = pair_counts(voted, voters.n)
    # one row for each of at most `bound` ids: of texts that share an id, the one with the fewest hits
    rows = voted.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("hits", "words", "fired", "toxic")).alias("r")).select("r.*").toPandas()
    gold = (rows.toxic.to_numpy() > 0).astype(float) if len(rows) else np.zeros(0)
    prior = (gold.sum() + 1) / (len(gold) + 10)
    fired, hits, words = dense(list(rows.fired), voters.n), rows.hits.to_numpy(), rows.words.to_numpy()
    soft = LabelModel(n_docs, both, prior).posterior(fired)
    x = features(fired, hits, words)
    weights = logistic(x, soft)
    z = x @ weights[:-1] + weights[-1]
    a, b = logistic(z[:, None], gold, ridge=0.01) if len(gold) and 0 < gold.sum() < len(gold) else (1.0, -4.0)
    return Model(voters, weights, (float(max(a, 0)), float(b))), voted


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    A null text is scored as empty, a long one as a whole. Repeated rows get equal scores; of an id with
    several texts one teaches, with the id's largest label. Labels without an id or a value, and labels of
    unknown ids, teach nothing; without any, all scores are low. An empty table gives an empty result.
    Columns of docs but doc_id and text are never looked at.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model, voted = learn(docs, labels, scratch, bound)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(voted.select("doc_id", "fired", "hits", "words"), run, f"doc_id {kind}, score double")
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; nulls, repeats and empty tables as in toxicity()."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    model, _ = learn(docs, labels, scratch, bound)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                seen = [m.voters.look(t or "") for t in b.column(at).to_pylist()]
                s = m.score([x[0] for x in seen], np.array([x[1] for x in seen], dtype=float), np.array([x[2] for x in seen], dtype=float))
                yield b.filter(pa.array(s < threshold))

    return scratch.save(map_batches(docs, run, docs.schema))  # saved, so that batches of whole rows stay small
