"""The corpus pipeline stage by stage against brute force."""

import os
import random

import corpus_pipeline
import duckdb
import pytest

from tallyhouse.llm import decontaminate, language_id
from tests.llm.test_language_id import as_text, brute_phrases, parsed
from tests.llm.test_near_duplicates import brute_force
from tests.llm.test_substring_dedup import flags

SF = "/root/testdata/sf0.01"


def in_a_language(text, model, samples):
    """By plain search for the longest matches in the samples' texts."""
    symbols = parsed(text or "", model)
    if not (symbols != 0).any():
        return False
    needs = []
    if len(symbols) > 2000:  # held against plain search in the operator's own tests
        counts = language_id.phrase_counts([symbols], model)[0].tolist()
        phrases, bits = min(zip(counts, (a.bits for a in model.automata), strict=True), key=lambda n: n[0] * n[1])
        return max(0, phrases - 2) * bits / len(symbols) <= model.limit
    for automaton, sample in zip(model.automata, samples, strict=True):
        needs.append((brute_phrases(as_text(symbols), sample), automaton.bits))
    phrases, bits = min(needs, key=lambda n: n[0] * n[1])
    return max(0, phrases - 2) * bits / len(symbols) <= model.limit


def test_each_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [tuple(r) for r in docs.collect()]
    labelled = docs.where(~language_id.held_out(docs["doc_id"]))
    texts_of = language_id.training_sample(labelled)
    model = language_id.fit(texts_of)
    samples = ["".join(as_text(parsed(" " + t, model)) for t in texts_of[k]) for k in model.languages]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = [tuple(r) for r in docs.collect()]
        texts = [(r[0], r[1]) for r in kept]
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert sorted(got) == sorted(r for r in kept if in_a_language(r[1], model, samples))
        elif k == 1:
            groups = brute_force(texts, 5, 80)
            assert sorted(got) == sorted(r for r in kept if groups[r[0]][1] == r[0])
        elif k == 2:
            words = {d: [w for w, g in zip(ws, gs, strict=True) if not g] for d, ws, gs in flags(texts, corpus_pipeline.PASSAGE_WORDS)}
            assert {r[0]: r[1].encode().split() for r in got} == words
            assert all(r[4] == len(r[1]) for r in got)
        elif k == 3:
            index = decontaminate.ItemIndex(duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
            assert sorted(got) == sorted(r for r in kept if not index.find(decontaminate.normalised(r[1])))
        else:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r[0] for r in kept}
        kept = got


def test_run_gives_the_last_stage_and_leaves_no_other_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file://").removeprefix("file:")))
    assert os.listdir(folder) == ["4"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_rows_and_foreign_texts(spark, tmp_path):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    junk = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, junk, "en", "s", len(junk)), (9004, base[0][1], None, None, 1), (None, base[1][1], "en", "s", 1), (9005, "12 % 34", "en", "s", 7)]
    rows = [(*r, f"q{k}", k) for k, r in enumerate(base + odd)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, layout_cell string, component_id long"
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[k] = [tuple(r) for r in docs.collect()]
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert {(r[0], r[-2], r[-1]) for r in seen[k]} <= {(r[0], r[-2], r[-1]) for r in rows}
    assert {9001, 9002, 9003, 9005} & {r[0] for r in seen[0]} == set() and len(seen[0]) >= len(rows) - 4 - 2
    assert None in {r[0] for r in seen[1]} and 9004 not in {r[0] for r in seen[1]}
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= len(seen[3])


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
