"""Each operator against a brute-force version, and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import collections
import hashlib
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, chat, common, components, exact_dedup, langid, mixing, neardup, quality, sharding, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "Two words", "a b c", "A B C", "a b c d e f g", "a b c d e f", "Ünïcödé ﬁ 😀 text", LONG, LONG.upper(), LONG + " end", "x\ny\nx\n\nx", "to be to be to be to be", "tie", "tie"]
ROWS = [(i, t, None if i % 5 == 0 else f"s{i % 3}", [None, "en", "de"][i % 3]) for i, t in enumerate(TEXTS)] + [(3, "one", "s0", "en"), (None, "no id", "s1", None)]
#: Extra columns named like working columns of the operators.
CLASH = ["size", "name", "node", "key", "bucket", "kept", "n", "level", "pos", "u", "members", "label", "shard", "lang_pred", "score", "h", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def table(spark, data):
    return common.documents(spark, data)


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text or "" for r in table.collect()}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# exact dedup


@pytest.mark.parametrize("block,route", [(4096, F.xxhash64), (16, F.xxhash64), (64, lambda c: F.crc32(c) % 3)])
def test_exact_dedup(docs, block, route):
    got = exact_dedup.exact_dedup(docs, block_bytes=block, route=route).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[lower(t)].append(i)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        want[(i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_exact_dedup_empty_and_stage(docs, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    left = [lower(r.text) for r in kept.collect()]
    assert sorted(left) == sorted(set(lower(t) for _, t, *_ in ROWS))


# byte-level BPE and token counts


def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(), special_tokens={})


def test_bpe_round_trip(docs, table, texts):
    enc = reference_encoding()
    want = {i: enc.encode_ordinary(t) for i, t in texts.items()}
    for r in bpe.round_trip(table).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    odd = bpe.round_trip(docs).collect()
    assert len(odd) == len(ROWS)
    assert {r.decoded_sha256 for r in odd} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS}
    encoded = bpe.encode_documents(docs)
    decoded = bpe.decode_documents(encoded)
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)


def test_bpe_odd_characters(spark):
    enc, mine = reference_encoding(), bpe.Encoder(bpe.vocabulary())
    import random

    rnd = random.Random(7)
    points = [*range(0x300), *range(0x1C80, 0x1CC0), *range(0x2000, 0x2070), *range(0x1E900, 0x1E960), 0x10D40, 0x11DE0, 0x16FF4, 0x20000]
    made = ["".join(chr(rnd.choice(points)) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["'s 'll don't  \n\n x", "ab" * 3000, "<|endoftext|>"]
    assert mine.encode_all(made) == [enc.encode_ordinary(t) for t in made]


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    keys = np.unique(keys)
    assert sorted(bpe.MinimalPerfectHash(keys).index(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.MinimalPerfectHash(np.array([5, 5], dtype=np.uint64))


def test_token_counts(spark, docs, none, table, texts):
    enc = reference_encoding()
    lengths = [len(enc.encode_ordinary(t)) for t in texts.values()]
    for block in (7, 2048):
        sums = token_counts.suffix_sums(token_counts.length_histogram(bpe.count_tokens(table)), block)
        rows = sums.collect()
        assert {r.length for r in rows} == set(lengths)
        for r in rows:
            longer = [x for x in lengths if x > r.length]
            assert tuple(r) == (r.length, lengths.count(r.length), r.length * lengths.count(r.length), len(lengths) - len(longer), len(longer), sum(longer), sum(min(x, r.length) for x in lengths))
        for limit in (0, 1, 50, 333, 10**6):
            assert token_counts.truncated_total(sums, limit).first().total_tokens == sum(min(x, limit) for x in lengths)
        for q in (0.1, 0.5, 0.99, 1.0):
            import math

            assert token_counts.quantile(sums, q).first().length == sorted(lengths)[max(0, math.ceil(q * len(lengths)) - 1)]
    assert token_counts.token_histogram(none).count() == 0
    assert token_counts.token_histogram(docs).agg(F.sum("n_docs")).first()[0] == len(ROWS)


# near duplicates


def brute_components(rows, percent, width):
    """(id, set size, smallest id reachable) of each row, by all pairs."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
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
    return [(d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


#: percent and width of op3, and of the pipeline's stage.
SETTINGS = pytest.mark.parametrize("percent,width", [(85, 3), (80, 5)])


def found_components(d, percent, width):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, percent, width).collect())


@SETTINGS
def test_neardup_table(table, texts, percent, width):
    assert found_components(table, percent, width) == collections.Counter(brute_components(sorted(texts.items()), percent, width))


@SETTINGS
def test_neardup_odd(docs, none, percent, width):
    assert found_components(docs, percent, width) == collections.Counter(brute_components([(i, t) for i, t, *_ in ROWS], percent, width))
    assert neardup.near_duplicates(none, percent, width).count() == 0


def test_neardup_constants():
    """Runs that can't fail for whole sets, by all ways to place the values that aren't common; percentages that can't be met are refused."""
    import itertools

    for percent in (85, 80, 60):
        runs = neardup.key_runs(percent)
        for union in range(2, 13):
            for common in range(-(-percent * union // 100), union):
                for odd in itertools.combinations(range(union), union - common):
                    ends = [-1, *odd, union]
                    longest = max(b - a - 1 for a, b in zip(ends, ends[1:]))
                    for mine in range(len(odd) + 1):  # so many of the others belong to the first set
                        a, b = common + mine, union - mine
                        assert longest >= min(set(runs[a]) & set(runs[b])), (percent, union, odd)
    with pytest.raises(ValueError):
        neardup.run_length(10)


@SETTINGS
def test_crosswise(spark, percent, width):
    """Every pair at or above the threshold is among the candidates; sets around it, of whole and of sampled size."""
    import random

    rnd = random.Random(percent)
    template = [rnd.getrandbits(62) for _ in range(900)]
    sets = []
    for n in (7, 20, 60, 300, 430, 520, 900):
        for _ in range(12):
            own = rnd.uniform(0.02, 0.16)
            k = max(1, round(n * own))
            sets.append(set(template[: n - k]) | {rnd.getrandbits(62) for _ in range(k)})
    rows = [(i, i, len(s), sorted(s)[: neardup.WIDE]) for i, s in enumerate(sets)]
    wide = spark.createDataFrame(rows, "node long, label long, n long, items array<long>")
    got = {tuple(r) for r in neardup.crosswise(wide, percent).collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert links and links <= got
    same = wide.withColumn("label", F.lit(1).cast("long"))
    assert neardup.crosswise(same, percent).count() == 0


@pytest.mark.parametrize("size", [40, 80])
def test_a_large_component_does_not_meet_itself(spark, size):
    """Entries of one label meet those of the few others only: rows in proportion to the component, not with its square."""
    items = list(range(100))
    rows = [(i, 0, 100, items) for i in range(size)] + [(size + i, size + i, 100, items) for i in range(3)]
    wide = spark.createDataFrame(rows, "node long, label long, n long, items array<long>")
    x, y = neardup._met(neardup._entries(wide, 85), 85)
    met = x.join(y, [c for c in x.columns if c in y.columns])
    per_value = met.groupBy("v").count().agg({"count": "max"}).first()[0]
    assert per_value <= 2 * 3 * size + 3 * 3
    pairs = {tuple(r) for r in neardup.crosswise(wide, 85).collect()}
    assert pairs == {(a, b) for b in range(size, size + 3) for a in range(b)}


@pytest.mark.parametrize("size", [60, 120])
def test_copies_short_of_a_link_are_no_candidates(spark, size):
    """Copies of one text, each with changes of its own, that share most values: their pairs grow with the square, the candidates don't. Links are among them, once each."""
    import random

    rnd = random.Random(size)
    template = [rnd.getrandbits(62) for _ in range(398)]
    # two copies differ in some 96 values, links in 64 at most
    sets = [set(rnd.sample(template, 374)) | {rnd.getrandbits(62) for _ in range(24)} for _ in range(size)]
    sets += [set(list(sets[i])[:-2]) | {rnd.getrandbits(62)} for i in range(5)]
    wide = spark.createDataFrame([(i, i, len(s), sorted(s)) for i, s in enumerate(sets)], "node long, label long, n long, items array<long>").repartition(4)
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    got = [tuple(r) for r in neardup.crosswise(wide, 85).collect()]
    assert len(links) == 5 and links <= set(got)
    assert len(got) <= size // 4


def test_crosswise_in_cells(spark, monkeypatch):
    """Every two entries that may be links meet in one cell, however small cells, batches and pieces are."""
    import random

    rnd = random.Random(5)
    template = [rnd.getrandbits(62) for _ in range(200)]
    sets = [set(rnd.sample(template, 200 - k)) | {rnd.getrandbits(62) for _ in range(k)} for k in (rnd.randrange(1, 14) for _ in range(90))]
    wide = spark.createDataFrame([(i, min(i, 30) if i % 3 else i, len(s), sorted(s)) for i, s in enumerate(sets)], "node long, label long, n long, items array<long>")
    whole = sorted(map(tuple, neardup.crosswise(wide, 85).collect()))
    label = {r.node: r.label for r in wide.collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert links and links <= set(whole)
    for name, value in {"LARGE": 7, "SMALL": 16, "PAIRS": 50}.items():
        monkeypatch.setattr(neardup, name, value)
    x, y = neardup._met(neardup._entries(neardup._bitmaps(wide), 85), 85)
    assert x.agg({"cell": "max"}).first()[0] > 20
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        assert sorted(map(tuple, neardup.crosswise(wide, 85).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@SETTINGS
def test_neardup_chain_and_crowd(spark, percent, width):
    """A chain of small edits, many copies of one text each edited in its own way, and texts that share a passage."""
    import random

    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rnd.choice(vocabulary) for _ in range(130)]
    made, chain = [], list(base)
    for i in range(12):
        made.append(" ".join(chain))
        chain[5 + 10 * i] = f"edit{i}"
    crowd = [rnd.choice(vocabulary) for _ in range(100)]
    for i in range(60):
        w = list(crowd)
        for _ in range(rnd.choice([1, 2, 3])):
            w[rnd.randrange(100)] = f"own{i}x{rnd.randrange(9)}"
        made.append(" ".join(w))
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        made.append(" ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 40]))]))
    for n in range(1, 30):  # short texts, one word apart
        made += [" ".join(base[:n]), " ".join([*base[:n], "z"]), " ".join(["z", *base[:n]])]
    rows = [(1000 - i, t) for i, t in enumerate(made)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(d, percent, width) == collections.Counter(brute_components(rows, percent, width))


@SETTINGS
def test_neardup_passages(spark, percent, width):
    """Hundreds of texts with a long passage in common that aren't linked, and pairs among them that are; large sets too."""
    import random

    rnd = random.Random(9)
    word = lambda: f"v{rnd.randrange(20_000)}"
    made = []
    for n, share in ((100, 0.6), (100, 0.75), (700, 0.7)):
        passage = [word() for _ in range(round(n * share))]
        for i in range(120):
            own = [word() for _ in range(n - len(passage))]
            made.append(" ".join(passage + own))
            if i % 10 == 0:
                own[rnd.randrange(len(own))] = "edit"
                made.append(" ".join(passage + own))
    rows = list(enumerate(made))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(d, percent, width) == collections.Counter(brute_components(rows, percent, width))


@pytest.mark.parametrize("percent,width", [(80, 5)])
@pytest.mark.parametrize("ids", [lambda i: i // 5, lambda i: None if i % 3 else i, lambda i: None])
def test_neardup_repeated_ids(spark, ids, percent, width):
    """Long near copies under ids that other texts have too, or under none; some are linked by a medoid or within their list only."""
    import random

    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    made = []
    for _ in range(6):
        base = [rnd.choice(vocabulary) for _ in range(200)]
        for i in range(12):
            w = list(base)
            for _ in range(rnd.choice([1, 3, 5, 7, 9])):
                w[rnd.randrange(200)] = f"own{i}x{rnd.randrange(99)}"
            made.append(" ".join(w))
    rnd.shuffle(made)
    rows = [(ids(i), t) for i, t in enumerate(made)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_components(d, percent, width) == collections.Counter(brute_components(rows, percent, width))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 21), (21, 22), (22, 20), (4, 30), (5, 5)]
    got = {(r.node, r.label) for r in components.components(common.Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 4, 30)} | {(n, 8) for n in (8, 9, 10)} | {(n, 20) for n in (20, 21, 22)}


# mixing


def level_targets(sizes, weights):
    """Target of a source: min(3 * size, level * weight), with the one level that gives the total; found by bisection."""
    total, low, high = sum(sizes.values()), 0.0, 3.0 * (sum(sizes.values()) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weights[s]) for s in sizes) < total else (low, mid)
    return {s: min(3 * sizes[s], high * weights[s]) for s in sizes}


def check_mix(rows, got):
    sizes = collections.Counter()
    for i, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = level_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    taken = collections.Counter()
    for r in got:
        s = r.members[0]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = collections.defaultdict(int)
    for r in got:
        largest[r.members[0]] = max(largest[r.members[0]], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_mixing(table, docs, none, texts):
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    got = mixing.mix_documents(table).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    assert sorted(map(tuple, mixing.mix_documents(table).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)
    odd = mixing.mix_documents(docs).collect()
    assert len(odd) == len(ROWS)
    check_mix(ROWS, odd)
    assert mixing.mix_documents(none).count() == 0
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in got)


def test_targets_and_flow():
    t = mixing.targets({"a": 10, "b": 1000, None: 5})
    assert t["a"] == 30 and t[None] == 15 and abs(t["b"] - 970) < 1e-9
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 18})
    assert sum(f.get("a", 0) for f in flow.values()) == 12 and sum(f.get("b", 0) for f in flow.values()) == 18
    # the shared words are repeated no more than the others
    assert sum(flow[("a",)].values()) >= 10 and sum(flow[("b",)].values()) >= 2
    short = mixing.min_cost_flow({("a",): 1}, {"a": 100, "b": 5})
    assert short == {("a",): {"a": 3}}


@pytest.mark.parametrize("bits,range_rows", [(12, 2000), (2, 5), (3, 40)])
def test_mix_overlapping(spark, monkeypatch, bits, range_rows):
    """Each source is granted its quota, up to half a document for each pattern it is in; the ways to find the edge give the same mix."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    patterns = [["a"], ["a", "b"], ["b"], ["c", "a", None], [None]]
    rows = [(i, patterns[i % 5], 5 + i % 4) for i in range(600)] + [(1, patterns[1], 6), (None, patterns[2], 9), (7, patterns[0], 0)]
    d = spark.createDataFrame(rows + [(999, None, 7), (998, [], 7)], "doc_id long, m array<string>, s long")
    weights = {"a": 3, "b": 1, "c": 2, None: 4}
    mixed = mixing.mix(d, F.col("m"), F.col("s"), weights, bits=bits).collect()
    assert len(mixed) == len(rows) + 2 and all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in mixed)
    assert [r.taken for r in mixed if r.doc_id in (998, 999)] == [0, 0]
    for r in mixed:
        assert sum(g.words for g in r.granted) == r.taken and {g.source for g in r.granted} <= set(r.members or ())
    sizes = collections.Counter()
    for _, m, n in rows:
        for s in m:
            sizes[s] += n
    goal, got = mixing.targets(dict(sizes), weights), collections.Counter()
    for r in mixed:
        for g in r.granted:
            got[g.source] += g.words
    flow = mixing.min_cost_flow({tuple(p): sum(n for _, m, n in rows if m == p) for p in patterns}, {s: round(t) for s, t in goal.items()})
    for s in sizes:
        quota = sum(f.get(s, 0) for f in flow.values())
        assert abs(got[s] - quota) <= 4.5 * sum(s in p for p in patterns), (s, got[s], quota)
    plain = mixing.mix(d, F.col("m"), F.col("s"), weights)
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in mixed) == sorted((r.doc_id or 0, r.size, r.taken) for r in plain.collect())


def test_flow_is_cheapest():
    """Against all ways to grant words in small networks: as much as possible, at the least cost of repeats."""
    import itertools
    import random

    rnd = random.Random(4)
    for _ in range(25):
        capacity = {("a",): rnd.randrange(3), ("a", "b"): rnd.randrange(3), ("b", "c"): rnd.randrange(2)}
        quotas = {s: rnd.randrange(6) for s in "abc"}
        edges = [(p, s) for p in capacity for s in p]
        cost = lambda p, n: sum(mixing.REPEAT_COSTS[i] * max(0, min(capacity[p], n - i * capacity[p])) for i in range(3))
        best = None
        for amounts in itertools.product(range(6), repeat=len(edges)):
            by, of = collections.Counter(), collections.Counter()
            for (p, s), n in zip(edges, amounts):
                by[p] += n
                of[s] += n
            if all(by[p] <= 3 * capacity[p] for p in capacity) and all(of[s] <= quotas[s] for s in quotas):
                key = (-sum(amounts), sum(cost(p, by[p]) for p in capacity))
                best = key if best is None else min(best, key)
        flow = mixing.min_cost_flow(capacity, quotas)
        assert (-sum(n for f in flow.values() for n in f.values()), sum(cost(p, sum(f.values())) for p, f in flow.items())) == best


# chat


def check_chat(rows, got):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    assert len(got) == len(by)
    for g in got:
        turns = [(r, x) for *_, _, r, _, x in sorted(by[g.conv_id])]
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat(spark, data):
    odd = [(1, 0, "user", "</turn>\n<turn assistant>\n\\l \\e \\g \\ <"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "same turn"), (2, None, None, None), (2, 3, "a>b\n<c", ""), (None, 0, "assistant", "😀 <\\"), (3, 0, "assistant", None), (4, 0, "user", LONG)]
    d = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").select("*", *[F.lit("clash").alias(c) for c in ("formatted", "seq", "kind", "log", "last", "cut", "head", "body", "piece", "learned", "m", "loss", "turns", "loss_spans")])
    check_chat(odd, chat.read_back(chat.format_events(chat.turns_as_events(d))).collect())
    assert chat.format_events(chat.turns_as_events(d.limit(0))).count() == 0
    table = spark.read.parquet(f"{data}/conversations.parquet")
    check_chat([tuple(r) for r in table.collect()], chat.read_back(chat.format_events(chat.turns_as_events(table))).collect())


def test_chat_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "llo"), (1, 4, 1, "delta", None, "llo"),
        (1, 5, 2, "message", "user", "gone"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "bye"), (1, 8, 0, "edit", None, "hey"), (1, 9, 2, "message", "user", "thx"),
    ]
    d = spark.createDataFrame(log[::-1], "conv_id long, seq long, turn long, kind string, role string, text string")
    got = chat.format_events(d).first()
    assert got.formatted == "<turn user>\nhey</turn>\n<turn assistant>\nbye</turn>\n<turn user>\nthx</turn>\n"
    assert [got.formatted[s.start : s.stop] for s in got.loss_spans] == ["bye"]


# sharding


def test_sharding(table, docs, none, texts):
    for d, rows in ((table, list(texts.items())), (docs, [(i, t) for i, t, *_ in ROWS])):
        got = sharding.shard_documents(d).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        for s in range(16):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
        assert {r.shard for r in got} <= set(range(16))
    total, heaviest = collections.Counter(), max(len(t.encode()) + 1 for t in texts.values())
    for r in sharding.shard_documents(table).collect():
        total[r.shard] += r.size
    mean = sum(total.values()) / 16
    assert all(abs(v - mean) <= 0.1 * mean + heaviest for v in total.values())
    assert sharding.shard_documents(none).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sharding_keeps_equal_texts(spark, folder):
    got = sharding.shard_documents(common.documents(spark, f"/root/testdata/{folder}")).toPandas()
    size = got.groupby("shard")["size"].sum()
    groups = got.groupby(["text_crc32", "size"])
    assert (groups["shard"].nunique() == 1).all() and (groups.size() > 1).any()
    heaviest = groups["size"].sum().max()
    assert len(size) == 16 and (abs(size - size.mean()) <= heaviest + 0.02 * size.mean()).all()


def test_sharding_by_metadata(spark):
    """Texts of two sources that differ in language and size: no shard but the one at the cut holds both; target_bytes sets the number."""
    rows = [(i, f"{i} " * (2 if i % 2 else 60), "ab"[i % 2], "xy"[i % 2]) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.shard_documents(d, shards=8).toPandas()
    mixed = got.assign(odd=got.doc_id % 2).groupby("shard").odd.nunique()
    assert (mixed > 1).sum() <= 1
    total = got["size"].sum()
    assert sharding.shard_documents(d, target_bytes=int(total // 4)).select("shard").distinct().count() == 5


def test_sharding_heavy_group(spark):
    """Two thirds of the rows are copies: they are cut through; light groups stay together."""
    rows = [(i, "the same text again and again") for i in range(4000)] + [(10_000 + i, f"text {i // 2} " * (i % 7 + 1)) for i in range(2000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() <= 1.05 * size.mean() and size.min() >= 0.95 * size.mean()
    light = got[got.doc_id >= 10_000].groupby(["text_crc32", "size"])["shard"].nunique()
    assert (light == 1).all()


# quality


def test_quality(docs, none, table):
    for d in (table, docs):
        rows = [(r.doc_id, r.text or "") for r in d.collect()]
        got = quality.quality(d).collect()
        assert len(got) == len(rows)
        want = collections.Counter()
        for i, t in rows:
            w = WORD.findall(t)
            tri = list(zip(w, w[1:], w[2:]))
            n = collections.Counter(tri)
            at = {k for j, x in enumerate(tri) if n[x] > 1 for k in (j, j + 1, j + 2)}
            seen, dup = set(), 0
            for x in t.split("\n"):
                if WORD.search(x):
                    dup += x in seen
                    seen.add(x)
            want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(at), len(w) < 50 or 100 * len(at) > 50 * len(w))] += 1
        assert collections.Counter(tuple(r)[:7] for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(none).count() == 0


def test_hosts(spark):
    """A host that fails nearly always is rejected with its good documents; a small host isn't, on little evidence."""
    good = " ".join(f"plain{i} text" for i in range(60))
    rows = [(i, good + f" {i}", f"h{i % 20}") for i in range(2000)] + [(5000 + i, "buy now", "farm") for i in range(300)] + [(9000, good, "farm"), (9001, "short", "tiny")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[9000].kept and not got[9000].base_failed
    assert got[9001].host_rate < 0.6
    assert all(got[i].kept for i in range(2000))


# language


def test_language(table, docs, none, spark):
    got = langid.identify(table).toPandas().merge(table.toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert set(got.held_out) == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.itertuples())
    odd = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= odd
    assert langid.identify(docs).count() == len(ROWS)
    assert langid.identify(none).count() == 0
    digits = spark.createDataFrame([(1, "123 456"), (2, None)], "doc_id long, text string")
    model = langid.learn(table)
    assert {r.lang_pred for r in langid.predict(digits, model).collect()} == {"und"}


def test_language_exact_sets(spark, table):
    """Against the same decision with exact sets of n-grams in plain Python: the filter's false positives change next to nothing."""
    import numpy as np

    model = langid.learn(table.filter("doc_id % 3 != 0"))
    rows = table.filter("doc_id % 3 = 0").collect()
    code = lambda t: langid.grams(np.frombuffer((t or "").encode(), np.uint8))[: max(0, len((t or "").encode()) - langid.N + 2)].tolist()
    counts = collections.defaultdict(collections.Counter)
    for r in table.filter("doc_id % 3 != 0").collect():
        if r.lang is not None and r.text is not None:
            counts[r.lang].update(code(r.text))
    sets = {k: {g for g, n in c.items() if n >= max(2, sum(c.values()) * langid.MIN_SHARE)} for k, c in counts.items()}
    assert model.languages == sorted(sets)
    got = {r.doc_id: r.lang_pred for r in langid.predict(table.filter("doc_id % 3 = 0"), model).collect()}
    same = 0
    for r in rows:
        weight = collections.Counter({k: 0.0 for k in model.languages})
        for g in code(r.text):
            held = [k for k in sets if g in sets[k]]
            for k in held:
                weight[k] += 1 / len(held) ** 2
        best = max(model.languages, key=lambda k: weight[k])
        same += got[r.doc_id] == (best if re.search(r"[^\W\d_]", r.text or "") else "und")
    assert same >= 0.98 * len(rows)


def test_language_held_out(spark):
    """Accuracy on the rows that are held out, by the table's own labels."""
    d = common.documents(spark, "/root/testdata/sf0.01")
    got = langid.identify(d).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() >= 0.97


def test_more_than_64_languages(spark):
    """Seventy made-up languages, each with words of its own."""
    import random

    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(rnd.choice(letters) for _ in range(7)) for _ in range(30)] for i in range(70)}
    rows = [(len(words) * j + i, " ".join(rnd.choice(w) for _ in range(40)), k) for j in range(6) for i, (k, w) in enumerate(words.items())]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(d)
    assert len(model.languages) == 70 and len(model.words) == 2
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, model).collect()}
    assert sum(got[i] == k for i, _, k in rows) >= 0.99 * len(rows)


def test_bloom_masks():
    import numpy as np

    rnd = np.random.default_rng(2)
    for k in (1, 9, 64, 65, 130):
        sets = {f"l{i}": np.unique(rnd.integers(0, 2**48, 4000, dtype=np.uint64)) for i in range(k)}
        f = langid.Filter(sets)
        for i, name in enumerate(f.languages):
            assert f.bit(f.masks(sets[name]), i).all()
        other = rnd.integers(2**49, 2**50, 20_000, dtype=np.uint64)
        assert all(np.mean(f.bit(f.masks(other), i)) < 0.01 for i in range(k))


# toxicity


def test_toxicity(spark, docs, none):
    import random

    rnd = random.Random(11)
    vocabulary = [f"word{i}" for i in range(400)]
    vile = ["vilex", "nasty", "gruntle"]
    rows, marks = [], []
    for i in range(1500):
        bad = i % 8 == 0
        w = [rnd.choice(vocabulary) for _ in range(60)]
        if bad:
            for v in rnd.sample(vile, 2):
                w.insert(rnd.randrange(60), v)
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 3 == 0:
            marks.append((i, 1, int(bad)))
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1, 1), (5, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == 1500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    wrong = sum(r.predicted != int(i % 8 == 0) for i, r in got.items())
    assert wrong <= 15
    clean = toxicity.clean_documents(d.withColumn("hits", F.lit(1)), labels)
    assert clean.columns == ["doc_id", "text", "hits"]
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_held_out(spark):
    """Precision and recall on the rows that are held out, by the table's own labels; none of them teaches."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    d = common.documents(spark, data)
    got = toxicity.toxicity(d, labels).toPandas().merge(labels.select("doc_id", "toxic").toPandas(), on="doc_id")
    held = got[got.held_out & got.toxic.notna()]
    right = ((held.predicted == 1) & (held.toxic == 1)).sum()
    # measured: 96 of 120 found, 100 predicted; some labelled texts hold no toxic word at all
    assert right >= 0.75 * (held.toxic == 1).sum() and right >= 0.9 * held.predicted.sum()
    assert toxicity.labelled(d, labels).filter(common.id_crc(F.col("doc_id")) % 4 == 2).isEmpty()
    assert toxicity.labelled(d, labels, 50).count() == 50


def test_toxicity_odd(spark, docs):
    """A model learnt from real labels on nulls, empty and long texts, repeated ids; an id with thousands of rows teaches once."""
    data = "/root/testdata/sf0.001"
    table = common.documents(spark, data).select("doc_id", "text", *[F.lit("clash").alias(c) for c in CLASH])
    more = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", *CLASH)
    crowd = spark.range(3000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"), *[F.lit("x").alias(c) for c in CLASH])
    d = table.unionByName(more).unionByName(crowd)
    labels = spark.read.parquet(f"{data}/labels.parquet").unionByName(spark.createDataFrame([(0, 1, 0), (0, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == table.count() + len(ROWS) + 3000 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id >= 1_000_000)


# pipeline


@pytest.fixture(scope="module")
def odd_table(spark):
    """Texts under one id, no ids, repeated rows, near copies and no words at all; columns named like working columns."""
    base = [f"w{i}" for i in range(120)]
    near = lambda k: " ".join([*base[: 60 + k], "edit", *base[61 + k :]])
    rows = ROWS + [(None, " ".join(base), "s1", None), (None, near(1), "s0", "en"), (40, near(2), None, "de"), (40, near(3).upper(), "s2", None), (40, near(2), None, "de"), (41, "other " * 30, "s0", "en"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.char_length("text"))
    return d.select("*", *[F.lit("clash").alias(c) for c in [*CLASH, "ids", "tag", "print", "sketch", "mix_id", "hits", "taken", "fired", "block"]])


def test_stages_on_odd_table(spark, data, odd_table):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text, r.source) for r in odd_table.collect()]
    key = lambda x: (repr(x[0]), x[1] or "", repr(x[2]))
    got = {n: stages[n](spark, odd_table, data) for n in stages}
    assert all(got[n].columns == odd_table.columns for n in list(stages)[:-1])
    assert sorted(map(key, rows)) == sorted(key((r.doc_id, r.text, r.source)) for r in got["toxicity"].collect())
    # one row of each text, of the largest id
    best = {}
    for i, t, _ in rows:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    assert collections.Counter((lower(r.text), -1 if r.doc_id is None else r.doc_id) for r in got["exact_dedup"].collect()) == collections.Counter(best.items())
    # one row of each component; of those without words, one for each id and text
    parts = collections.defaultdict(list)
    for (i, t, _), (_, n, least), root in zip(rows, brute_components([(i, t) for i, t, _ in rows], 80, 5), roots([(t) for _, t, _ in rows], 80, 5)):
        if n:
            parts[root].append((i, least))
    want = [least for members in parts.values() for least in {m[1] for m in members}]
    blank = {(i, t or "") for i, t, _ in rows if not WORD.findall(t or "")}
    near = [(r.doc_id, r.text) for r in got["near_dedup"].collect()]
    assert collections.Counter(i for i, t in near if WORD.findall(t or "")) == collections.Counter(want)
    assert {(i, t or "") for i, t in near if not WORD.findall(t or "")} == blank
    # a row as often as it is taken
    times = collections.defaultdict(set)
    for r in mixing.mix_documents(odd_table).collect():
        times[r.doc_id, r.members[0], r.size].add(r.taken // r.size if r.size else 1)
    assert all(len(t) == 1 for t in times.values())
    count = collections.Counter()
    for i, t, s in rows:
        count[i, t, s] += min(times[i, s, len(WORD.findall(t or ""))])
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got["mixing"].collect()) == +count
    enc = reference_encoding()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got["bpe"].collect()) == collections.Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t, _ in rows)


def roots(texts, percent, width):
    """A number for each row: equal for rows of one component."""
    numbered = brute_components([(k, t) for k, t in enumerate(texts)], percent, width)
    return [c for _, _, c in numbered]


def test_stages_on_empty_table(spark, data, odd_table):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_table.limit(0), data).count() == 0, name


def test_stages_keep_texts_of_repeated_ids(spark, data):
    """Two texts under one id, several null ids, and a dropped copy under the id of a text that stays."""
    import corpus_pipeline

    words = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    a, b, c, d, e, f = (words(x, 120) for x in "abcdef")
    rows = [(1, a), (1, b), (1, b.upper()), (2, a), (None, c), (None, d), (None, d), (3, e), (3, e + " end"), (None, f), (None, f + " end"), (4, c + " end"), (5, ""), (6, None), (None, " ")]
    t = spark.createDataFrame([(i, x, "s", k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, source string, k int").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact_dedup"](spark, t, data)
    got = sorted((repr(r.doc_id), lower(r.text)) for r in exact.collect())
    assert exact.columns == t.columns
    # a goes to id 2, the empty text to 6; each other text stays once under its id
    assert got == sorted((repr(i), x) for i, x in [(1, b), (2, a), (None, c), (None, d), (3, e), (3, e + " end"), (None, f), (None, f + " end"), (4, c + " end"), (6, ""), (None, " ")])
    near = stages["near_dedup"](spark, exact, data).collect()
    assert collections.Counter((r.doc_id, lower(r.text)[:2]) for r in near) == {(1, "b0"): 1, (2, "a0"): 1, (4, "c0"): 1, (None, "d0"): 1, (3, "e0"): 1, (None, "f0"): 1, (6, ""): 1, (None, " "): 1}


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = common.documents(spark, data)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    tox = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet")).filter("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.Scratch(spark, "pipeline").save(stage(spark, docs, data))
        if name != names[-1]:
            assert docs.columns == columns
        was, now = [(r.doc_id, r.text) for r in before.collect()], [(r.doc_id, r.text) if name != "bpe" else r.doc_id for r in docs.collect()]
        if name == "toxicity":
            assert {i for i, _ in was} - {i for i, _ in now} == tox
        elif name == "exact_dedup":
            last = {lower(t): max(i for i, x in was if lower(x) == lower(t)) for _, t in was}
            assert sorted(i for i, _ in now) == sorted(last.values())
        elif name == "near_dedup":
            assert sorted(i for i, _ in now) == sorted(d for d, _, c in brute_components(was, 80, 5) if d == c)
        elif name == "mixing":
            assert set(now) <= set(was) and max(collections.Counter(i for i, _ in now).values()) <= 3
        else:
            enc = reference_encoding()
            want = collections.Counter((i, tuple(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in was)
            assert docs.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256"]
            assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in docs.collect()) == want and docs.filter("n_tokens != size(ids)").isEmpty()
