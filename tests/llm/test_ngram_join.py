"""The n-gram join against all pairs: tables, crowds, shared passages, and the index's guarantee by itself."""

import collections
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import neardup, ngram_join
from paperloom.llm.neardup import shingle_sets

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


def brute(rows, percent, width):
    """Counter of (id, set size, smallest id reachable), by all pairs."""
    sets = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(d, percent=80, width=5, **rules):
    return collections.Counter(map(tuple, ngram_join.jaccard_components(d, percent, width, **rules).collect()))


def test_table(spark, data):
    t = spark.read.parquet(f"{data}/documents.parquet")
    assert found(t) == brute([(r.doc_id, r.text) for r in t.collect()], 80, 5)


@pytest.mark.parametrize("percent,width", [(80, 5), (60, 2)])
def test_odd(spark, percent, width):
    texts = [None, "", " \t\n", "one", "Two words", "a b c", "A B C", "a b c d e f g", "a b c d e f", "a b c d e", "Ünïcödé ﬁ 😀 text", LONG, LONG.upper(), LONG + " end", "to be to be to be to be", "tie", "tie"]
    rows = list(enumerate(texts)) + [(3, "one"), (None, "no id"), (None, LONG + " x"), (3, "a b c d e f h"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("node", "n", "key", "label", "v", "head", "tag", "print")])
    assert found(d, percent, width) == brute(rows, percent, width)
    assert ngram_join.jaccard_components(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(d, percent=50)


def crowds(seed):
    """A chain of small edits, a crowd of edited copies, texts that share passages, pairs among them, short texts one word apart."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(9000)}"
    base, crowd, made = [word() for _ in range(130)], [word() for _ in range(110)], []
    chain = list(base)
    for i in range(12):
        made.append(chain[:])
        chain[5 + 10 * i] = f"edit{i}"
    for i in range(70):
        w = list(crowd)
        for _ in range(rnd.choice([1, 2, 3, 5])):
            w[rnd.randrange(110)] = f"own{i}x{rnd.randrange(9)}"
        made.append(w)
    for n, share in ((100, 0.6), (100, 0.75), (500, 0.7)):
        passage = [word() for _ in range(round(n * share))]
        for i in range(45):
            own = [word() for _ in range(n - len(passage))]
            made.append(passage + own)
            if i % 9 == 0:
                own[rnd.randrange(len(own))] = "edit"
                made.append(passage + own)
    for n in range(1, 30):
        made += [base[:n], [*base[:n], "z"], ["z", *base[:n]]]
    rnd.shuffle(made)
    return [(2000 - i, " ".join(w)) for i, w in enumerate(made)]


@pytest.mark.parametrize("rare,per_class", [(2, 16), (1, 4)])
def test_crowds(spark, monkeypatch, rare, per_class):
    monkeypatch.setattr(ngram_join, "HUB_BLOCK", 7)
    rows = crowds(rare)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rare=rare, per_class=per_class) == brute(rows, 80, 5)


@pytest.mark.parametrize("percent", [80, 85, 60])
@pytest.mark.parametrize("rare,per_class", [(2, 16), (0, 4)])
def test_guarantee(percent, rare, per_class):
    """Any two sets at or above the threshold have a key in common, whatever the order and the classes; and enough of their heads."""
    index = ngram_join.Index(percent, rare, per_class)
    rnd = random.Random(percent + rare)
    linked = 0
    for _ in range(3000):
        n = rnd.choice([2, 3, 4, 5, 7, 9, 20, 63, 70, 150])
        common = {rnd.getrandbits(63) for _ in range(n)}
        extra = [{rnd.getrandbits(63) for _ in range(rnd.randrange(0, n // 2 + 1))} for _ in "ab"]
        sets = [common | e for e in extra]
        if 100 * n < percent * len(sets[0] | sets[1]):
            continue
        linked += 1
        order = {t: (rnd.choice([1, 2, 3, 9]), t) for t in sets[0] | sets[1]}
        ordered = [sorted(s, key=order.get) for s in sets]
        own = [index.signatures(len(s), [(i + 1, order[t][0], t) for i, t in enumerate(s)], True) for s in ordered]
        assert sets[0] == sets[1] or set(own[0]) & set(own[1])
        head = [set(sorted(s)[: index.head_length(len(s))]) for s in sets]
        assert all(len(head[0] & head[1]) >= index.least_common(len(s)) for s in sets)
    assert linked > 100


def test_least_common_column(spark):
    sizes = spark.range(1, 3000).withColumnRenamed("id", "n")
    for percent in (80, 85, 60):
        got = sizes.select("n", ngram_join.Index(percent).least_common_column("n").alias("t")).collect()
        assert all(r.t == ngram_join.Index(percent).least_common(r.n) for r in got)


def test_shingle_sets_are_cheap():
    """Sets are sorted and distinct, and made in less CPU time than np.unique() and a generator of hashes alone take."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50_000, 400)) for _ in range(400)] + [None, "", "a", "a a a a a", "A b c d e f"]

    def least(f, *args) -> float:
        taken = []
        for _ in range(5):
            began = time.process_time()
            f(*args)
            taken.append(time.process_time() - began)
        return min(taken)

    def parts(words: list[list[bytes]]) -> None:
        flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64)
        for at in range(0, len(flat) - 396, 400):
            np.unique(flat[at : at + 396])

    for s in (sets := shingle_sets(texts, 5)):
        assert np.array_equal(np.unique(s.view(np.uint64)), s.view(np.uint64))
    assert [len(s) for s in sets[-5:]] == [0, 0, 1, 1, 2]
    words = [(t or "").encode().lower().split() for t in texts]
    split = lambda: [(t or "").encode().lower().split() for t in texts]
    assert least(shingle_sets, texts, 5) - least(split) < least(parts, words)


def test_shingle_sets_over_pieces(monkeypatch):
    """Words at the ends of pieces, longer than a table's places or a piece: sets agree as the words' shingles do."""
    monkeypatch.setattr(neardup, "PIECE", 64)
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "B", "é", "\x00", "x" * 31, "y" * 32, "z" * 33, "z" * 32 + "w", "Q" * 200, "ab", "ba", " "])
    texts = ["".join(word() + rng.choice([" ", "\n", "\t\r", "\x0b\x0c", ""]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " \n", "q" * 1000]
    plain = []
    for t in texts:
        w = (t or "").encode().lower().split()
        plain.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    sets = [set(s.tolist()) for s in shingle_sets(texts, 3)]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])
