"""Runs of words against brute force, on drawn texts, odd rows and the whole small table."""

import hashlib
import random
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from tallyhouse.llm import periodic_runs
from tallyhouse.llm.periodic_runs import find_runs
from tallyhouse.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def runs_of(words, least=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def local(texts, least=12):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [r for part in periodic_runs._finder(least)(iter([batch])) for r in part.to_pylist()]


def agree(texts, least):
    for row, text in zip(local(texts, least), texts, strict=True):
        words = (text or "").split()
        want = runs_of(words, least)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want, text
        assert row["collapsed"] == collapsed(words, want) and row["n_words"] == len(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "aé", "c"]), max_size=40), max_size=6), st.sampled_from([2, 5, 12]))
def test_drawn_texts(texts, least):
    agree([" \t".join(t) for t in texts], least)


def test_periodic_texts_and_their_neighbours():
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a " * 50, ("a b " * 40 + "c ") * 3]
    for _ in range(400):
        n, letters = rng.randint(1, 90), "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        words = [rng.choice(letters) for _ in range(n)]
        a, p = rng.randrange(n), rng.randint(1, 20)
        texts.append(" ".join(words[i] if i < a else words[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(n)))
    agree(texts, 12)
    agree(texts + texts[::-1], 2)


def test_very_long_texts():
    one, text = " ".join(["x"] * 200_000), " ".join(str(i % 7_919) for i in range(100_000))
    found = local([one, text])
    assert [(r["start"], r["length"], r["period"]) for r in found[0]["runs"]] == [(0, 200_000, 1)] and found[0]["collapsed"] == "x"
    assert [(r["start"], r["length"], r["period"]) for r in found[1]["runs"]] == [(0, 100_000, 7_919)]


def test_odd_rows(spark):
    twelve = "w " * 12
    rows = [(1, None, 0), (None, twelve, 1), (2, "", 2), (3, twelve, 3), (3, twelve, 4), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = find_runs(docs.withColumnRenamed("runs", "collapsed")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), r["collapsed"]) for r in found) == sorted(
        [("1", 0, 0, ""), ("None", 12, 1, "w"), ("2", 0, 0, ""), ("3", 12, 1, "w"), ("3", 12, 1, "w"), ("None", 0, 0, "")]
    )
    assert find_runs(docs.where("doc_id = 99")).count() == 0
    planted = periodic_runs.with_planted_periods(docs).collect()
    assert len(planted) == 6 and {r["text"] for r in planted if r["doc_id"] is None} == {twelve, None}


def test_the_query_on_a_whole_table(spark):
    found = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(found) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs, row = runs_of(words), found[doc_id]
        best = min(((-length, s, p) for s, length, p in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(runs), *want)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5
