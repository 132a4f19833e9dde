"""Repeated windows against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import substring_dedup
from tallyhouse.llm.substring_dedup import level_lengths, repeated_words_digest, without_repeated_words

DATA = "/root/testdata/sf0.01/documents.parquet"


def flags(rows, n):
    least, words_of = {}, []
    for d, t in rows:
        words = (t or "").encode().split()
        words_of.append(words)
        for i in range(len(words) - n + 1):
            key = tuple(words[i : i + n])
            if d is not None and (key not in least or d < least[key]):
                least[key] = d
    for (d, _), words in zip(rows, words_of, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            first = least.get(tuple(words[i : i + n]))
            if first is not None and (d is None or first < d):
                gone[i : i + n] = [True] * n
        yield d, words, gone


def expected(rows, n):
    return sorted(
        ((d, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for d, w, g in flags(rows, n)), key=str
    )


def found(spark, rows, n):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in repeated_words_digest(docs, n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("n", [13, 50])
def test_matches_brute_force_on_the_small_corpus(spark, n):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}'").fetchall()
    assert found(spark, rows, n) == expected(rows, n)


def test_matches_brute_force_on_few_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    for n in (1, 2, 3, 4, 7, 13):
        assert found(spark, rows, n) == expected(rows, n)


def test_nulls_empty_long_and_repeated(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "x\t" + passage), (None, passage), (None, passage), (5, passage + " " + passage), (5, passage), (6, " ".join(f"q{i % 5000}" for i in range(20_000)))]
    assert found(spark, rows, 13) == expected(rows, 13)
    assert repeated_words_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_text_around_removed_words_stays(spark):
    passage = " ".join(f"p{i}" for i in range(6))
    rows = [(1, "keep\n" + passage, "de", 1, 7), (2, " a\tb  " + passage + "\n c ", "en", 2, 8), (3, None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, layout long")
    out = without_repeated_words(docs, 5)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == 1 and got[1]["layout"] == 7
    assert got[2]["text"] == " a\tb  c " and got[2]["n_chars"] == 8
    assert got[3]["text"] is None


def test_lengths_double_up_to_the_window():
    assert level_lengths(50) == [7, 13, 25, 50] and level_lengths(13) == [7, 13] and level_lengths(1) == [1] and level_lengths(8) == [8]
    for n in range(1, 300):
        lengths = level_lengths(n)
        assert lengths[0] <= substring_dedup.START_WORDS and lengths[-1] == n and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:], strict=False))


@pytest.mark.parametrize("shared, levels", [(0, 1), (9, 2), (20, 3), (30, 4), (60, 4)])
def test_levels_stop_when_no_candidate_survives(spark, monkeypatch, shared, levels):
    ran, plain = [], substring_dedup._level
    monkeypatch.setattr(substring_dedup, "_level", lambda level, *rest: (ran.append(level), plain(level, *rest))[1])
    passage = " ".join(f"p{i}" for i in range(shared))
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(70)) + " " + passage + " " + " ".join(f"v{k}x{i}" for i in range(70))) for k in range(8)]
    # the anchors of a window around a short passage lie inside the passage or not, so short ones may end sooner
    assert found(spark, rows, 50) == expected(rows, 50)
    assert ran == list(range(len(ran))) and len(ran) <= levels and (len(ran) == 4 or shared < 60)


def test_a_passage_of_all_documents_is_sent_once_a_cell(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"a{k} {passage} b{k} {passage}") for k in range(3000)]
    assert found(spark, rows, 13) == expected(rows, 13)
    lengths = level_lengths(13)
    counts = []
    for n in (1, 3000):
        table = pa.table({"cell": pa.array([3] * n, pa.int32()), "doc_id": list(range(n)), "text": [passage] * n})
        sent = substring_dedup._level(0, lengths, 4, "cell")(table)
        counts.append(sum(len(x.as_py()) // 4 for x in sent.column("hashes")))
        assert all(set(x.as_py()) == {n > 1} for x in sent.column("several"))
    assert counts[0] == counts[1] > 0


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 111, "m"), (2, "a b c d e", 222, None), (3, "", None, "x")], "doc_id long, text string, layout_cell long, Layout_cell_ string")
    rows = {r["doc_id"]: r for r in without_repeated_words(docs, 3).collect()}
    assert (rows[1]["layout_cell"], rows[2]["layout_cell"], rows[3]["layout_cell"]) == (111, 222, None) and rows[1]["Layout_cell_"] == "m"
    assert rows[1]["text"] == "a b c d e" and rows[2]["text"] == ""


def test_words_that_collide_modulo_a_power_of_two_differ(spark):
    pair = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1)]
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{pair[0]} {rest}"), (2, f"{pair[1]} {rest}"), (3, f"{pair[0]} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeated_words_digest(docs, window=13).collect()), key=str) == expected(rows, 13)
