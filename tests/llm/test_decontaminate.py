"""Decontamination against brute force, and its bounds."""

import random
import resource
import subprocess
import sys
import time

import duckdb

from tallyhouse.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def edited(text, k, rng):
    chars = list(text)
    for _ in range(k):
        at = rng.randrange(1, len(chars) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "q"
        elif kind == 1:
            chars.insert(at, "q")
        else:
            del chars[at]
    return "".join(chars)


def distance_inside(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_are_found_iff_within_the_budget():
    rng = random.Random(11)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 40)))) for i in range(25)]
    index = decontaminate.ItemIndex(items)
    for i, text in items:
        for k in (0, 1, 2, 4, 7):
            page = "some words before " + edited(text, k, rng) + " and after it"
            codes = decontaminate.normalised(page)
            found = {h[0]: h for h in index.find(codes)}
            plain = "".join(map(chr, codes))
            least = distance_inside(text, plain)
            budget = int(index.budget[index.ids.index(i)])
            assert (i in found) == (least <= budget), (i, k, least, budget)
            if i in found:
                assert found[i][3] == least
    assert index.find(decontaminate.normalised("nothing like it " * 50)) == []


def test_edited_copy_of_an_item_with_a_wide_band():
    rng = random.Random(13)
    text = "".join(rng.choice("abcdefgh") for _ in range(32_000))
    index = decontaminate.ItemIndex([(5, text)])
    budget = int(index.budget[0])
    # an insertion for nearly every edit of the budget, and a start late in a band's first half: the alignment ends far right in the band
    page = "z" * 1300 + "".join(text[k * 20 : k * 20 + 20] + "q" for k in range(budget)) + text[budget * 20 :]
    page = page.removesuffix("q")
    assert index.find(decontaminate.normalised(page)) == [(5, 1300, len(page), budget - 1, 32_000)]


def test_planted_passages_and_clean_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    plain = {d: "".join(map(chr, decontaminate.normalised(t))) for d, t in docs}
    exact = {(d, i) for i, t in items for d, p in plain.items() if "".join(map(chr, decontaminate.normalised(t))) in p}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op5_benchmark_decontamination(spark, SF).collect()}
    assert exact <= found and len(found) <= len(exact) + 3
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.find_benchmark_passages(frame, bench, block_chars=3000)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == found
    kept = decontaminate.without_contaminated(frame, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(plain) - {d for d, _ in found}


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a passage of some twenty letters"), (1, "a passage of some twenty letters"), (2, None), (3, "short"), (None, "another passage of more letters")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x A Passage, of some; TWENTY letters!", 0), (4, "another passage of more letters " * 2, 0)], "doc_id long, text string, start int")
    got = sorted(((r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.find_benchmark_passages(docs, bench).collect()), key=str)
    assert got == [(4, None, 0), (4, None, 32), (None, 1, 2), (None, 1, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()) == [1, 2]
    assert decontaminate.find_benchmark_passages(docs, bench.where("false")).count() == 0


def text_of(codes):
    return "".join(map(chr, codes))


def test_short_items_are_found_as_whole_words():
    items = [(n, "abcdefghijklmnopqrstuvwxyz"[:n]) for n in range(1, 26)] + [(30, "a b"), (31, "a b"), (32, "?!")]
    index = decontaminate.ItemIndex(items)
    for n in range(1, 26):
        word = "abcdefghijklmnopqrstuvwxyz"[:n]
        assert n in {h[0] for h in index.find(decontaminate.normalised(f"x, {word.upper()}; y"))}, n
        assert (n, 0, n, 0, n) in index.find(decontaminate.normalised(word))
        if n < decontaminate.EXACT_CHARS:
            assert n not in {h[0] for h in index.find(decontaminate.normalised(f"x z{word} {word}z y"))}
    assert sorted(h[0] for h in index.find(decontaminate.normalised("q a  b q"))) == [1, 30, 31]
    assert index.find(decontaminate.normalised("")) == [] == index.find(decontaminate.normalised("?!"))


def test_long_items_and_texts():
    rng = random.Random(21)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    index = decontaminate.ItemIndex([(7, text)])
    plain = text_of(index.codes[0])
    page = "z" * 5000 + plain[:20_000] + "q" + plain[20_000:40_000] + plain[40_001:]
    started = time.process_time()
    assert index.find(decontaminate.normalised(page)) == [(7, 5000, len(page), 2, len(plain))]
    assert time.process_time() - started < 20


MANY = """
import random, resource, sys
from tallyhouse.llm import decontaminate
rng = random.Random(2)
word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
opening = "which of the following statements about the passage above is most likely to be true "
items = [(i, opening + " ".join(word() for _ in range(20))) for i in range(3000)]
index = decontaminate.ItemIndex(items)
text = opening * 12_000 + items[17][1] + " " + items[2500][1]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = index.find(decontaminate.normalised(text))
assert [h[0] for h in found] == [17, 2500], found
same = [(i, opening + "or " + str(i)) for i in range(3000)]
found = decontaminate.ItemIndex(same).find(decontaminate.normalised(opening * 3 + "or 17 " + opening))
assert 17 in {h[0] for h in found}
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert peak < 500_000, peak
"""


def test_items_that_share_a_phrase_and_a_text_that_repeats_it():
    started = time.time()
    subprocess.run([sys.executable, "-c", MANY], check=True, timeout=300, env={"PYTHONPATH": ":".join(sys.path), "PATH": "/usr/bin:/bin"})
    assert time.time() - started < 200 and resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss > 0


def test_common_q_grams_left_out_lose_nothing(monkeypatch):
    rng = random.Random(4)
    opening = "in which of these places do "
    items = [(i, opening + " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randint(2, 9)))) for i in range(60)]
    pages = ["some words " + edited(t, k, rng) + " end" for _, t in items for k in (0, 2, 3)]
    plain = decontaminate.ItemIndex(items)
    expected = [plain.find(decontaminate.normalised(p)) for p in pages]
    monkeypatch.setattr(decontaminate, "COMMON", 8)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    other = decontaminate.ItemIndex(items)
    assert len(other.gram) < len(plain.gram)
    assert [other.find(decontaminate.normalised(p)) for p in pages] == expected
