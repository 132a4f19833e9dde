"""Language identification: exact parses, accuracy on the held-out fold, large alphabets, odd texts."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_languages_are_told(spark):
    rows = queries.op8_language_id(spark, SF).collect()
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_phrases(text, sample):
    phrases, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        phrases, at = phrases + 1, max(at + 1, end - 1)
    return phrases


def parsed(text, model):
    return language_id._symbols(language_id.letter_case_fold(text), model.symbol)


def as_text(symbols):
    return "".join(chr(0x4000 + s) for s in symbols.tolist())


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("letters, dense", [("abcd ", 62), ("abcdefgh ", 3), ("abcdefgh ", 0), ("a ", 62)])
def test_phrases_against_brute_force(monkeypatch, letters, dense, few):
    monkeypatch.setattr(language_id, "FEW", few)
    rng = random.Random(3)
    samples = {k: ["".join(rng.choice(letters) for _ in range(n)) for n in (300, 900)] for k in "xy"}
    model = language_id.fit(samples, dense)
    texts = ["".join(rng.choice(letters + "z") for _ in range(n)) for n in (0, 1, 7, 100, 255, 256, 257, 512, 700, 5000)]
    # pieces of the sample (phrases longer than a block), and periods that no block's length is a multiple of
    texts += [samples["x"][1] * 3, samples["x"][1][100:800] + samples["y"][1][5:600], "abc" * 1000, "ab" * 700 + "a", "aaa" * 600, "a " * 900, "abcd abc" * 300]
    symbols = [parsed(t, model) for t in texts]
    found = language_id.phrase_counts(symbols, model)
    for k, name in enumerate(model.languages):
        sample = as_text(np.concatenate([np.append(np.int32(0), parsed(t, model)) for t in samples[name]]))
        for row, text in zip(found, symbols, strict=True):
            assert row[k] == brute_phrases(as_text(text), sample)
    alone = [language_id.phrase_counts([t], model)[0].tolist() for t in symbols]
    assert alone == found.tolist()


def test_large_alphabets_and_letters_beyond_the_first_plane():
    zh = "今天天气很好我们一起去公园散步看见许多人在那里锻炼身体孩子们玩得非常开心晚上回家吃饭然后看书睡觉明天还要上学工作"
    ja = "今日は天気がとてもいいので私たちは公園へ散歩に行きましたたくさんの人が運動をしていて子供たちは楽しく遊んでいました"
    ko = "오늘은 날씨가 매우 좋아서 우리는 함께 공원에 산책하러 갔습니다 많은 사람들이 운동을 하고 있었고 아이들은 즐겁게 놀았습니다"
    ru, el = "сегодня очень хорошая погода и мы вместе пошли гулять в парк", "σήμερα ο καιρός είναι πολύ καλός και πήγαμε μαζί βόλτα στο πάρκο"
    ugly = "𐐨𐐩𐐪𐐫𐐬𐐭 𐐮𐐯𐐰𐐱"
    rng = random.Random(1)
    samples = {k: ["".join(rng.sample(v, len(v))) + v for _ in range(8)] for k, v in {"zh": zh, "ja": ja, "ko": ko, "ru": ru, "el": el, "xx": ugly}.items()}
    model = language_id.fit(samples)
    column = pa.array([zh[10:40], ja[20:50], ko[5:30], ru[9:30], el[8:30], ugly[2:8], "天气很好", "w x y"])
    names, scores, _ = language_id._answers(column, model)
    assert names[:7] == ["zh", "ja", "ko", "ru", "el", "xx", "zh"] and min(scores[:7]) > 0


def test_unequal_samples():
    texts = duckdb.sql(f"select text, lang from '{SF}/documents.parquet' where lang in ('de', 'en') and length(text) > 600 order by doc_id").fetchall()
    de, en = ([t for t, k in texts if k == x] for x in ("de", "en"))
    assert len(de) > 45
    model = language_id.fit({"de": [de[0][100:160]], "en": [t[:1000] for t in en[:24]]})
    names, _, _ = language_id._answers(pa.array(de[1:] + en[24:]), model)
    assert np.mean([n == "de" for n in names[: len(de) - 1]]) > 0.97 and np.mean([n == "en" for n in names[len(de) - 1 :]]) > 0.97


def test_ties_go_to_the_first_language():
    model = language_id.fit({"b": ["same text"], "a": ["same text"]})
    assert language_id._answers(pa.array(["same text", "other"]), model)[:2] == (["a", "a"], [0.0, 0.0])


def test_the_sample_is_drawn_from_whole_texts(spark):
    text = "".join(chr(97 + k % 26) * 10 for k in range(200))
    docs = spark.createDataFrame([(k, text, "xx") for k in range(20)] + [(30, "short", "yy"), (31, None, "yy"), (32, "", "zz"), (33, "no label", None)], "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, pieces=12, chars=100)
    assert sample["yy"] == ["short"] and set(sample) == {"xx", "yy"} and len(sample["xx"]) == 12
    assert len({text.index(p) for p in sample["xx"]}) > 3 and all(p in text for p in sample["xx"])
    assert language_id.training_sample(docs, pieces=12, chars=100) == sample


def test_foreign_texts_and_letter_junk_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    junk = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))
    rows = [(1, junk), (2, "Zażółć gęślą jaźń i pchnąć w tę łódź jeża lub ośm skrzyń fig " * 8), (3, "Ok"), (4, docs.first()["text"]), (5, "东西南北" * 50), (6, "a")]
    extra = spark.createDataFrame([(*r, "q", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    kept = language_id.keep_languages(extra, model)
    assert kept.columns == extra.columns and [r["doc_id"] for r in kept.collect()] == [3, 4, 6]
    assert [r["lang_pred"] for r in language_id.predict_language(extra, model).collect()].count("und") == 0


def test_language_of_odd_texts(spark):
    model = language_id.fit({"a": ["abab abab"], "b": ["cdcd cdcd"]})
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% \n"), (4, "abab"), (5, "cd" * 20_000), (None, "ABAB"), (6, "𝒳𝒴"), (4, "abab")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict_language(docs, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "a"), (5, "b"), (None, "a"), (6, "a"), (4, "a")]
    assert [r["doc_id"] for r in language_id.keep_languages(docs, model).collect()] == [4, 5, None, 6, 4]  # no limit from so few texts
    nothing = language_id.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in language_id.predict_language(docs, nothing).collect()} == {"und"}




@pytest.mark.parametrize("texts", [["123 4 !"], ["1"], ["a"], ["ab 12"], ["ab ab"], ["xq jw zk vx qj"], ["the lonely twenty letters"]])
def test_a_label_with_few_letters_takes_no_texts_of_others(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    sample = language_id.training_sample(docs.where(~language_id.held_out(docs["doc_id"])))
    rows = docs.where("length(text) > 60 and lang is not null").collect()
    names, _, _ = language_id._answers(pa.array([r["text"] for r in rows]), language_id.fit({**sample, "zxx": texts}))
    assert names.count("zxx") == 0
    assert np.mean([n == r["lang"] for n, r in zip(names, rows, strict=True)]) > 0.98
    assert language_id.fit({"zxx": ["123 4 !"]}).languages == []
