"""URL filters, chat rotation, extraction, sharding, fingerprints, language, decontamination."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import chat_format, fingerprints, queries, sharding, url_filter

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("segment_bytes, limit", [(1 << 23, 1 << 26), (100, 1 << 26), (100, 300)])
def test_cascade_is_exact_over_its_universe(spark, segment_bytes, limit):
    rng = random.Random(4)
    names = [f"k{i}" for i in range(5000)] + [""]
    listed = {x for x in names if rng.random() < 0.1}
    keys = spark.createDataFrame([(x, x in listed) for x in names] + [(None, False), ("k1", False), ("k2", None)], "key string, listed boolean")
    cascade = url_filter.build_cascade(keys, segment_bytes, limit=limit)
    found = cascade.mark(keys.select("key", F.lit(5).alias("segment")).where("key is not null"), "key", "found", limit).collect()
    assert len(found) == len(names) + 2 and {r["key"] for r in found if r["found"]} == listed
    assert (cascade.segments > 1) == (segment_bytes == 100) and (len(list(cascade._rounds(limit))) > 1) == (limit == 300)
    nothing = url_filter.build_cascade(keys.where("false"))
    assert nothing.size_bytes == 0 and nothing.mark(keys, "key", "found").where("found").isEmpty()
    everything = url_filter.build_cascade(keys.withColumn("listed", F.lit(True)))
    assert everything.mark(keys.where("key <> ''"), "key", "found").where("not found").isEmpty()


def test_a_table_of_listed_hosts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    hosts = [r[0] for r in pages.select(url_filter.url_host(F.col("url"))).distinct().collect()]
    rng = random.Random(1)
    chosen = set(rng.sample(hosts, len(hosts) // 3))
    listed = spark.createDataFrame([(h,) for h in chosen] + [(f"elsewhere{k}.org",) for k in range(3000)] + [(next(iter(chosen)),)], "key string")
    got = url_filter.judge_urls(pages, listed).collect()
    assert len(got) == pages.count() and all(r["listed"] == (r["host"] in chosen) for r in got)
    assert all(r["verdict"] == ("block" if r["listed"] else "allow") for r in got if r["rule"] is None)


def test_urls_with_odd_forms(spark):
    rows = [
        (1, None, "", "", None, "allow"),
        (2, "no scheme", "", "", None, "allow"),
        (3, "http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (4, "http://example.net", "example.net", "", None, "allow"),
        (5, "x://y://b.net/", "y:", "//b.net/", None, "allow"),
        (6, "http://b.net/#f", "b.net", "/", "net/", "block"),
        (7, "http://bnet/", "bnet", "/", None, "allow"),
        (8, "http://net?/", "net", "", None, "allow"),
        (9, "http://w.example.com/de/", "w.example.com", "/de/", "example.com/de/", "block"),
        (10, "http://x.org/fr/\n", "x.org", "/fr/\n", "org/fr/", "allow"),
        (11, "http://cheap-pills.example.com/", "cheap-pills.example.com", "/", None, "block"),
        (11, "http://ÄB.org/", "Äb.org", "/", None, "allow"),
        (12, "http://long.org/fr/" + "x" * 100_000, "long.org", "/fr/" + "x" * 100_000, "org/fr/", "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h") for r in rows], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages).collect()
    assert sorted((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["url"]) == sorted(rows[1:])
    own = spark.createDataFrame([("bnet",), (None,)], "key string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, own).collect()}
    assert got[7] == "block" and got[1] == "block" and got[3] == "allow"
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_rotation_masks_exactly_the_speaker(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (2, None, None, "x"), (2, 5, "u", "y"), (None, 0, "u", "z"), (None, 0, "u", "z"), (None, 1, "system", "z"), (3, 0, "system", "alone"), (4, 0, "u", "a"), (4, 0, "u", "a"), (4, 300, "u", "<|im_start|>b")]
    frame = spark.createDataFrame([(*t, "q", 1) for t in turns], "conv_id long, turn long, role string, text string, block string, start int")
    rows = chat_format.rotate_perspectives(frame).collect()
    assert sorted(((r["conv_id"], r["participant"], r["block"]) for r in rows), key=str) == [(1, "ann", 0), (1, "bob", 0), (2, "u", 0), (2, "unknown", 0), (4, "u", 0), (None, "u", 0), (None, "u", 0)]
    got = {(r["conv_id"], r["participant"]): r for r in rows}
    ann = got[1, "ann"]
    assert ann["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhé<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    u = got[4, "u"]
    assert u["n_turns"] == 3 and [u["text"][m["start"] : m["end"]] for m in u["mask"]] == ["a<|im_end|>\n", "a<|im_end|>\n", "<|im_start|>b<|im_end|>\n"]
    assert got[None, "u"]["text"] == "<|im_start|>assistant\nz<|im_end|>\n" and got[None, "u"]["mask"][0]["start"] == 22
    assert chat_format.rotate_perspectives(frame.where("false")).collect() == []


def test_rotation_of_a_thousand_turns(spark):
    rng = random.Random(5)
    turns = [(7, 0, "system", "rules")] + [(7, k, rng.choice(["ann", "bob", "é"]), f"text {k} " + "x" * rng.randint(0, 30)) for k in range(1, 1001)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat_format.rotate_perspectives(frame).collect()
    assert len(rows) == 3 and all(r["n_turns"] == 1001 for r in rows)
    for r in rows:
        assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == [t + chat_format.END for _, _, role, t in turns if role == r["participant"]]
        said = ["system" if k == "system" else "assistant" if k == r["participant"] else f"user name={k}" for _, _, k, _ in turns]
        assert r["text"] == "".join(f"<|im_start|>{s}\n{t}<|im_end|>\n" for s, (_, _, _, t) in zip(said, turns, strict=True))
    blocks = chat_format.rotate_perspectives(frame, turns_per_block=300).collect()
    assert {r["block"] for r in blocks} == {0, 1, 2, 3} and all(r["text"].startswith("<|im_start|>system\nrules") for r in blocks)
    assert sum(len(r["mask"]) for r in blocks) == 1000 and all(r["n_turns"] == (101 if r["block"] == 3 else 301) for r in blocks)
    for r in blocks:
        assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == [t + chat_format.END for _, k, role, t in turns if role == r["participant"] and k and (k - 1) // 300 == r["block"]]


def test_rotation_runs_no_python(spark):
    plan = chat_format.rotate_perspectives(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_are_near_equal_gapless_and_keep_groups(spark):
    rows = queries.op9_sharding(spark, SF).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    sizes, slots, home = Counter(), {}, {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert home.setdefault(text, r["shard"]) == r["shard"]
    assert len(rows) == len(texts) and sorted(sizes) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.01 * min(sizes.values())


def spread(places, histogram):
    """bin: bytes in it."""
    loads, ordered = Counter(), sorted(places)
    for (size, first, at, copies), after in zip(ordered, [*ordered[1:], None], strict=False):
        end = after[1] if after and after[0] == size else histogram[size]
        for i in range(end - first):
            loads[at + i // copies] += size
    return loads


def test_best_fit_against_plain_search():
    rng = random.Random(6)
    for most in (5, 60, 60, 100):
        for _ in range(60):
            sizes = [rng.randint(1, most) for _ in range(rng.randint(0, 90))]
            bins = []
            for size in sorted(sizes, reverse=True):
                fits = [(room, b) for b, room in enumerate(bins) if room >= size]
                b = min(fits)[1] if fits else len(bins)
                if not fits:
                    bins.append(100)
                bins[b] -= size
            needed, places = sharding.best_fit_decreasing(Counter(sizes), 100)
            loads = spread(places, Counter(sizes))
            assert needed == len(bins) and sorted(loads.values()) == sorted(100 - room for room in bins)
            few = sharding.best_fit_decreasing(Counter(sizes), 100, len(bins))
            assert few is not None and (not bins or sharding.best_fit_decreasing(Counter(sizes), 100, len(bins) - 1) is None)
    assert sharding.best_fit_decreasing({101: 1}, 100) is None and sharding.best_fit_decreasing({60: 2}, 100, 1) is None


@pytest.mark.parametrize("entries", [4_000_000, 400])
def test_capacity_of_any_number_of_small_groups(spark, monkeypatch, entries):
    monkeypatch.setattr(sharding, "ENTRIES", entries)
    docs = spark.range(40_000).selectExpr("id as doc_id", "lpad(cast(id as string), 10, '0') as text")
    rows = sharding.shard_documents(docs, capacity=30).collect()
    assert Counter(Counter(r["shard"] for r in rows).values()) == {2: 20_000}
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(pow(id % 971, 1.1) as int)) as text", "1 as bytes", "2 as part")
    rows = sharding.shard_documents(docs, capacity=9000).collect()
    loads, homes, slots = Counter(), {}, {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        homes.setdefault(r["size"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) <= 9000 and len(loads) <= 1.01 * sum(loads.values()) / 9000 + 1
    assert all(len(v) == 1 for v in homes.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, capacity=2000)


def test_a_text_that_a_third_of_all_rows_share(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('text ', id, repeat('y', cast(id % 50 as int)))) as text")
    rows = sharding.shard_documents(docs, shards=2).collect()
    assert len(rows) == 9000 and len({r["shard"] for r in rows if r["doc_id"] % 3 == 0}) == 1
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 1.001 * min(loads.values())


def test_sharding_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, None, 0), (3, "", 0), (None, "aé", 0), (None, "aé", 0), (6, "x" * 1000, 0)], "doc_id long, text string, shard int")
    rows = sharding.shard_documents(docs, shards=2).collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 4, 4, 1001]
    few = sharding.shard_documents(docs, capacity=1001).collect()
    assert {r["shard"] for r in few} == {0, 1}
    assert sharding.shard_documents(docs.where("false")).count() == 0


def general_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(5, 80))).encode() for _ in range(120)]
    found = fingerprints.signatures(texts, samples=2048, limit=3000)
    for i in range(len(texts) - 1):
        assert abs(fingerprints.likeness(found[i : i + 1], found[i + 1 : i + 2])[0] - general_jaccard(texts[i], texts[i + 1])) < 0.06
    assert (found == fingerprints.signatures(texts, samples=2048)).all()


def test_frequent_and_null_ids_are_dealt_to_several_tasks(spark):
    rng = random.Random(8)
    rows = [(None, f"n{rng.randrange(40)} b c d e {'x ' * rng.randrange(9)}") for _ in range(300)] + [(None, "same words everywhere")] * 200 + [(None, None), (None, "")]
    rows += [(7, f"seven {rng.randrange(90)} é w") for _ in range(300)] + [(k, f"own {k} text of it") for k in range(300)] + [(50, "twice a b"), (50, "twice a b")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = fingerprints._ranges(clean, 16)
    assert len(ranges.texts[None]) > 3 and len(ranges.texts[7]) > 2
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    expected = []
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text)
        edited = (text[: n - n // 2] + after[: n // 2]).encode()
        own, changed, following = (fingerprints.signatures([x])[0] for x in (text.encode(), edited, after.encode()))
        expected.append((doc_id, n, hashlib.sha256(edited).hexdigest(), fingerprints.fingerprint_text(own), fingerprints.fingerprint_text(changed), (own == changed).mean(), (own == following).mean()))
    found = [tuple(r) for r in fingerprints.fingerprint_edits(docs).collect()]
    assert sorted(found, key=str) == sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in expected), key=str)


def test_edited_texts_follow_the_order_of_ids(spark):
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where doc_id % 3 <> 1").fetchall() + [(10**9, ""), (10**9 + 1, None), (-5, "one"), (None, "a b c d")]
    texts.sort(key=lambda r: (r[0] is None, r[0] or 0))
    rows = fingerprints.fingerprint_edits(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, part int")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for (doc_id, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[doc_id]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = (fingerprints.signatures([t.encode()])[0] for t in (text, edited, after))
        assert r["fingerprint"] == fingerprints.fingerprint_text(own) and r["edited_fingerprint"] == fingerprints.fingerprint_text(changed)
        assert r["near_edited"] == (own == changed).mean() and r["near_next"] == (own == following).mean()
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_chat_rotation"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("pages", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    ours = sorted(map(tuple, found.select(*columns).collect()), key=str)
    theirs = con.sql(queries.ORACLE_SQL[name])
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[k] for k in at) for r in theirs.fetchall()), key=str)
    assert np.isfinite(len(ours))


def test_fingerprints_of_words_that_collide_modulo_a_power_of_two_differ():
    pair = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024)).encode() for flip in (0, 1)]
    found = fingerprints.signatures(pair)
    assert fingerprints.likeness(found[:1], found[1:])[0] == 0
