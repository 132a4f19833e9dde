"""Near words, forms and roots against brute force, and the affected-gram bound against every edit."""

import itertools
import random
import zlib
from collections import Counter

import duckdb
import pytest

from tallyhouse.llm import spelling
from tallyhouse.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts, times=10):
    found = {w: [o for o in counts if o != w and near(w, o)] for w in counts}
    forms = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), counts[w], len(found[w]), counts[forms[w]] if forms[w] else None) for w in counts}


def drawn(rng, letters, families, low=7, high=13):
    words = set()
    for _ in range(families):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        words.add(w)
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w + c]))
    return sorted(words)


def run(spark, counts, **options):
    found = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **options).collect()
    assert len(found) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


@pytest.mark.parametrize("letters, dictionary, listed", [("ab", 5, 3), ("abc", 50, 10**9), ("abcdeé", 400, 0), ("abcdefghij", 10**6, 3)])
def test_the_bound_holds_for_all_near_words(monkeypatch, letters, dictionary, listed):
    monkeypatch.setattr(spelling, "LIST", listed)
    for seed in range(5):
        words = drawn(random.Random(seed), letters, 40, 5)
        grams = spelling.grams_of(words, dictionary)
        variable = {w: Counter(w[a:b] for a, b in grams.decomposed(w)) for w in words}
        keys = {w: grams.keys(w) for w in words}
        for a, b in itertools.combinations(words, 2):
            if near(a, b):
                shared = max(keys[a][1], keys[b][1])
                assert sum((variable[a] & variable[b]).values()) >= shared
                assert shared <= 0 or set(keys[a][0]) & set(keys[b][0])


def test_grams_cover_a_word_and_none_covers_another():
    words = drawn(random.Random(1), "abcd", 60)
    grams = spelling.grams_of(words, 200)
    for w in words:
        spans = grams.decomposed(w)
        assert spans[0][0] == 0 and spans[-1][1] == len(w) and all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(spans))


@pytest.mark.parametrize("listed, long_list", [(32, 500), (0, 3), (10**9, 2)])
def test_variants_equal_brute_force(spark, monkeypatch, listed, long_list):
    monkeypatch.setattr(spelling, "LIST", listed)
    monkeypatch.setattr(spelling, "LONG_LIST", long_list)
    rng = random.Random(9)
    words = drawn(rng, "abcdefghijklmnopqrstuvwxyzé", 60) + drawn(rng, "ab", 20) + ["z" * k for k in range(7, 15)] + ["anti" + "".join(rng.choice("xyzw") for _ in range(4)) for _ in range(60)]
    counts = {w: rng.choice([2, 3, 20, 200, 2000]) for w in words}
    assert run(spark, counts) == brute_force(counts)


def test_forms_ties_and_chains(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "abcdehi": 200, "abcdxhi": 2000, "alonewor": 5}
    found = run(spark, counts)
    assert found == brute_force(counts)
    assert found["abcdefg"][:2] == ("abcdefh", "abcdefh") and found["abcdefi"][:2] == ("abcdehi", "abcdxhi")
    assert run(spark, counts, times=1)["abcdefg"][0] == "abcdefh"


def test_word_counts_and_odd_rows(spark):
    rows = [(1, None, 1), (None, "Wanderer wanderer", 2), (2, "", 3), (3, "ÀÉ" + "x" * 60, 4), (3, "WANDERER’s short", 5), (4, "wanderers" * 3000, 6), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "word")
    want = Counter()
    for doc_id, text, _ in rows:
        for word in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            word = "".join(c.lower() if c.isascii() else c for c in word)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                want[word] += 1
    found = {r["word"]: r["n"] for r in spelling.word_counts(docs, min_count=1).collect()}
    assert found == want
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == {w: n for w, n in want.items() if n > 1}
    assert spelling.group_variants(spelling.word_counts(docs.where("doc_id = 9"))).count() == 0


def test_short_words(spark):
    counts = {"a": 2, "b": 30, "": 4, "ab": 500, "é": 1}
    assert run(spark, counts) == brute_force(counts)


def test_the_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    theirs = con.sql(ORACLE_SQL["op12_spelling_variants"])
    assert theirs.columns == columns
    ours = [tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SF).select(*columns).collect()]
    assert len(ours) > 1000 and sorted(ours, key=str) == sorted(theirs.fetchall(), key=str)
