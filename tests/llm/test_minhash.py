"""MinHash near-duplicates against brute force; bands, signatures and stars on their own."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import minhash
from tallyhouse.llm.minhash import near_duplicates
from tallyhouse.llm.queries import QUERIES
from tallyhouse.llm.stars import star_components
from tallyhouse.llm.words import HASH_KEYS, shingle_sets, word_hashes, word_numbers, word_spans

DATA = "/root/testdata/sf0.01/documents.parquet"


def sets_of(text, n, lower=True):
    words = (text or "").encode()
    words = (words.lower() if lower else words).split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def united(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


def brute_force(rows, n, percent):
    sets, holders = {d: sets_of(t, n) for d, t in rows}, {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    near = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    linked = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = united(sets, linked)
    return {d: (len(sets[d]), roots[d], roots[d] == d) for d in sets}


def run(spark, rows, **options):
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert len(found) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}


def family(rng, base, copies, edits):
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_the_query_equals_brute_force_on_the_small_corpus(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}'").fetchall()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op13_minhash"](spark, "/root/testdata/sf0.01").collect()}
    assert found == brute_force(rows, 3, 85)


def families():
    rng, texts = random.Random(11), []
    for size, length, edits in ((150, 80, 6), (80, 200, 14), (30, 12, 1), (20, 30, 3)):
        texts += family(rng, [f"v{rng.randrange(400)}" for _ in range(length)], size, edits)
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[7 * k : 7 * k + 120]) for k in range(25)]  # each links with its neighbours only
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n, percent, shingles", [(3, 85, 2_000_000), (5, 80, 900), (3, 60, 2_000_000)])
def test_families_of_near_copies(spark, monkeypatch, n, percent, shingles):
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    rows = families()
    assert run(spark, rows, words=n, percent=percent) == brute_force(rows, n, percent)


def test_odd_rows(spark):
    long_ = " ".join(f"x{i % 5000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (None, "one"), (7, long_), (8, long_ + " end"), (9, "Ünder one two"), (10, "ünder one two"), (None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, signature int")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, words=3, percent=85).collect()), key=str)
    want = brute_force([r for r in rows if r[0] is not None], 3, 85)
    assert found == sorted([(d, *v) for d, v in want.items()] + [(None, 1, None, False), (None, 0, None, False)], key=str)
    assert want[8][1] == 7 and want[5][1] == 4 and want[10][1] == 10
    assert near_duplicates(docs.where("doc_id = 99")).count() == 0
    repeated = near_duplicates(spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string"), words=3).collect()
    assert [(r["component_id"], r["n_shingles"]) for r in repeated] == [(1, 2)] * 3


def test_bands_signatures_and_hashes():
    assert minhash.banding(85) == (32, 4) and minhash.banding(100)[1] == 128
    for percent in (60, 80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISSED
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    one, other = (minhash.signatures_of(np.array([0, 2000]), s, 2048)[0] for s in (a, b))
    assert abs((one == other).mean() - 1 / 3) < 0.05
    # words that collide modulo 2**64 for every odd base
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    pair = [word, word.translate(str.maketrans("ab", "ba"))]
    raw = np.frombuffer(" ".join(pair).encode(), np.uint8)
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    assert len(start) == 2
    for key in HASH_KEYS:
        assert len(set(word_hashes(word_numbers(raw, start, end)[1], key))) == 2
    starts, found = shingle_sets(raw, np.array([0, 1024, len(raw)]), 3)
    assert starts.tolist() == [0, 1, 2] and found[0] != found[1]


def test_stars_equal_union_find(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(500, 700)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(5, 5), (7, None), (700, 500)]
    nodes = {x for a, b in links if b is not None and a != b for x in (a, b)}
    found = star_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(nodes)
    assert {r["node"]: r["component"] for r in found} == united(nodes, [(a, b) for a, b in links if b is not None and a != b])
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert star_components(spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
