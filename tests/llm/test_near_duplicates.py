"""The Jaccard join and the component search against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import near_duplicates
from tallyhouse.llm.graph import components
from tallyhouse.llm.near_duplicates import linked_documents, one_of_each_group

DATA = "/root/testdata/sf0.01/documents.parquet"


def shingles(text, n, lower=True):
    words = (text or "").encode()
    words = (words.lower() if lower else words).split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if len(words) >= n else {tuple(words)}


def brute_force(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    near = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def run(spark, rows, **options):
    found = linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}


def family(rng, base, copies, edits):
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_matches_brute_force_on_the_small_corpus(spark, n, percent):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}' where doc_id < 700").fetchall()
    assert run(spark, rows, words=n, percent=percent) == brute_force(rows, n, percent)


def test_matches_brute_force_on_families_of_near_copies(spark):
    rng = random.Random(5)
    texts = []
    for size, length, edits in ((120, 80, 6), (60, 200, 12), (30, 12, 1), (20, 30, 3)):
        base = [f"v{rng.randrange(400)}" for _ in range(length)]
        texts += family(rng, base, size, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for n, percent in ((3, 90), (5, 80), (3, 60)):
        assert run(spark, rows, words=n, percent=percent) == brute_force(rows, n, percent)


def test_pairs_at_the_exact_threshold_in_different_groups(spark, monkeypatch):
    # sets of 28, 29 and 30 that share 27: the first two link at 90 % exactly, the third only widens its group's sizes
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 2)
    texts = [" ".join([*(f"{k}own{f}x{i}" for i in range(k)), *(f"s{f}x{i}" for i in range(27))]) for f in range(60) for k in (1, 2, 3)]
    rows = list(enumerate(texts))
    assert run(spark, rows, words=1, percent=90) == brute_force(rows, 1, 90)
    rng = random.Random(9)
    for percent in (60, 80, 90):
        texts = []
        for f in range(60):
            both = rng.randint(5, 40)
            most = both * 100 // percent - both  # words of their own that two sets linked at the threshold have together
            a = rng.randint(0, most)
            texts += [" ".join([*(f"{k}own{f}x{i}" for i in range(own)), *(f"s{f}x{i}" for i in range(both))]) for k, own in enumerate((a, most - a, most - a + 1, most - a + 2))]
        rows = list(enumerate(texts))
        assert run(spark, rows, words=1, percent=percent) == brute_force(rows, 1, percent)


def test_crowds_that_fill_many_groups(spark, monkeypatch):
    # a crowd is compared with one of its own first; what does not link with that one is still found
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 4)
    rng = random.Random(11)
    texts = []
    for size, length, edits in ((90, 80, 6), (60, 150, 12), (60, 40, 2), (40, 40, 0)):
        base = [f"v{size}x{i}" for i in range(length)]
        texts += [f"{t} end{k}" for k, t in enumerate(family(rng, base, size, edits))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for n, percent in ((3, 90), (5, 80), (1, 60)):
        assert run(spark, rows, words=n, percent=percent) == brute_force(rows, n, percent)


def test_groups_of_one_star_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 4)
    met = near_duplicates._met
    counts = []

    def counted(signed, grouped, percent):
        counts.append((met(signed, grouped, percent).count(), met(signed, grouped.withColumn("star", F.lit(0).cast("long")), percent).count()))
        return met(signed, grouped, percent)

    monkeypatch.setattr(near_duplicates, "_met", counted)
    base = " ".join(f"v{i}" for i in range(100))
    rows = [(k, f"{base} end{k}") for k in range(200)]
    assert {c for _, c in run(spark, rows, words=3, percent=90).values()} == {0}
    assert counts[0][0] == 0 and counts[0][1] > 1000


def test_bound_holds_for_every_size_in_the_group(spark):
    for percent in (10, 60, 80, 90, 100):
        rows = [(n, hits, lo, hi) for n in range(1, 40, 3) for lo in range(-(-n * percent // 100), n + 4) for hi in range(lo, min(n * 100 // percent, n + 12) + 1) for hits in range(1, 7)]
        frame = spark.createDataFrame(rows, "n int, hits int, lo int, hi int")
        for r in frame.withColumn("reaches", near_duplicates._reaches(percent)).collect():
            n, hits = r["n"], r["hits"]
            assert r["reaches"] == any(hits - 1 + -(-max(n, m) * percent // 100) >= -(-(n + m) * percent // (100 + percent)) for m in range(r["lo"], r["hi"] + 1)), (percent, r)


def test_nulls_empty_short_long_and_repeated(spark):
    long_text = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, long_text), (8, long_text + " tail"), (9, "É b c d"), (10, "é b c d")]
    assert run(spark, rows, words=3, percent=90) == brute_force(rows, 3, 90)
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in linked_documents(docs).collect()), key=str)
    assert found == [(3, 3), (None, None), (None, None)]
    assert linked_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_document_of_each_group_stays_with_all_columns(spark):
    rows = [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, "z y x w v u t", 7), (None, "a b c d e f g", 8), (4, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["n"] for r in kept.collect())) == [5, 7, 8, 9]


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(i, (i + 1) % 20 + 300) for i in range(300, 320)] + [(5, 5), (900, 7)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, 900, *range(200, 260))} | {i: 300 for i in range(300, 320)}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 5, "x", 7), (2, "a b c d e f g", 6, None, 8), (3, "z y x w v u t", 7, "g", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string, gid long")
    assert {(r["doc_id"], r["component_id"]) for r in linked_documents(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert sorted(tuple(r) for r in one_of_each_group(docs).collect()) == [rows[0], rows[2]]


def test_the_sketch_counts_every_shingle(spark):
    docs = spark.createDataFrame([(k, f"common one {k} tail{k}") for k in range(300)], "doc_id long, text string").repartition(30)
    classes = near_duplicates.shingle_classes(docs, 2, True)
    counts = np.round(2 ** (classes / 8.0) - 1)
    assert abs(counts.sum() - 900) < 60 and counts.max() > 280


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_that_collide_modulo_a_power_of_two_differ(spark, letters):
    pair = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(letters)) for flip in (0, 1)]
    rows = [(k, " ".join([w, "one", "two"])) for k, w in enumerate(pair)] + [(2, pair[0]), (3, pair[1])]
    assert run(spark, rows, words=3, percent=90) == brute_force(rows, 3, 90)


def _edited(rng, base, edits, pool):
    words = list(base)
    for at in rng.sample(range(len(base)), edits):
        words[at] = f"{pool}{at}w{rng.randrange(3)}" if pool else f"w{rng.randrange(10**9)}"
    return " ".join(words)


def test_meetings_of_a_family_grow_no_faster_than_it(spark, monkeypatch):
    # at 80 % a text with four or five edits links with no other, but holds the family's shingles in its prefix
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 8)
    counts = []
    for name in ("_met", "_met_in_families"):
        if met := getattr(near_duplicates, name, None):

            def counted(*given, met=met):
                counts.append(met(*given).count())
                return met(*given)

            monkeypatch.setattr(near_duplicates, name, counted)
    rng = random.Random(17)
    base = [f"v{i}" for i in range(150)]
    for size in (120, 360):
        counts.clear()
        rows = list(enumerate(_edited(rng, base, rng.randint(0, 5), "") for _ in range(size)))
        assert run(spark, rows, words=5, percent=80) == brute_force(rows, 5, 80)
        assert sum(counts) <= 2 * size


def test_family_members_that_link_with_each_other_but_not_with_the_head(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 4)
    rng = random.Random(23)
    texts = []
    for f, (size, length) in enumerate(((60, 60), (80, 120), (40, 25))):
        base = [f"v{f}x{i}" for i in range(length)]
        for _ in range(size):
            # edits from a small pool are shared; some texts are longer or shorter than the head
            words = _edited(rng, base, rng.randint(0, length // 5), rng.choice(["", "p"])).split()
            words = words[rng.randint(0, length // 10) :] if rng.random() < 0.4 else [*words, *(f"t{f}x{i}" for i in range(rng.randint(0, length // 6)))]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for n, percent in ((1, 80), (1, 60), (3, 90), (1, 30)):
        assert run(spark, rows, words=n, percent=percent) == brute_force(rows, n, percent), (n, percent)


def test_prefixes_of_differences_meet_for_every_linked_pair():
    rng = random.Random(31)
    apart, least = near_duplicates._apart, near_duplicates._familiar
    linked = 0
    for _ in range(60_000):
        percent = rng.choice([10, 50, 60, 75, 80, 85, 90, 100])
        h = rng.randint(1, 40)
        head = set(range(h))
        one = {i for i in head if rng.random() < rng.choice([0.6, 0.8, 0.9])} | {100 + i for i in range(8) if rng.random() < 0.4}
        two = {i for i in one if rng.random() < 0.95} | {100 + i for i in range(8) if rng.random() < 0.1}
        sizes = [(len(s), len(s ^ head)) for s in (one, two)]
        if not all(len(s) and len(s & head) >= least(len(s), percent) for s in (one, two)) or len(one ^ two) > apart(len(one) + len(two), percent):
            continue
        near = [x <= apart(n + h, percent) for n, x in sizes]
        if all(near):
            continue
        linked += 1
        take = [near_duplicates._difference_prefixes(n, x, h, percent)[int(other)] for (n, x), other in zip(sizes, reversed(near), strict=True)]
        order = sorted(range(200), key=lambda i: rng.random())
        first = [set(sorted(s ^ head, key=order.index)[:k]) for s, k in zip((one, two), take, strict=True)]
        assert first[0] & first[1], (percent, one, two, head)
    assert linked > 300


def test_family_documents_that_share_an_id_link_through_it(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 4)
    base = [f"v{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(30)]
    other = " ".join(f"z{i}" for i in range(40))
    rows += [(7, other), (90, other + " tail"), (91, " ".join(base[:30] + [f"y{i}" for i in range(30)]))]
    found = linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=90).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {*((k, 0) for k in range(30)), (90, 0), (91, 91)}
