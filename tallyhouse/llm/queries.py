"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import chat_format, decontaminate, fingerprints, html_extract, language_id, minhash, near_duplicates, packing, periodic_runs, sharding, spelling, substring_dedup, url_filter
from tallyhouse.llm.tables import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.rotate_perspectives(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return rows.select("conv_id", "participant", "n_turns", "text", spans.alias("mask"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words_digest(read(spark, sf_dir, "documents"), window=13)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.linked_documents(read(spark, sf_dir, "documents"), words=3, percent=90, lower=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out))
    found = language_id.predict_language(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_planted_periods(read(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumns({"best": longest, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    length, period = -F.col("best.less"), F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(read(spark, sf_dir, "documents")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_best_fit_packing,
        op3_url_filter,
        op4_chat_rotation,
        op5_benchmark_decontamination,
        op6_substring_dedup,
        op7_ngram_jaccard_join,
        op8_language_id,
        op9_sharding,
        op10_fingerprints,
        op11_periodic_runs,
        op12_spelling_variants,
        op13_minhash,
    )
}

#: Word shingles of whole texts, pairs that share one, links by the sizes of both sets, and what is reached by links.
_LINKED = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n)
SELECT doc_id, n_shingles, component_id{more} FROM c
"""

ORACLE_SQL = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word, CASE WHEN len(w) >= 13 THEN unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i <= len(w) - 12 THEN array_to_string(w[i:i + 12], ' ') END)) END AS run FROM d),
f AS (SELECT run, min(doc_id) AS first FROM w WHERE run IS NOT NULL GROUP BY run),
m AS (SELECT w.doc_id, w.j, w.word, coalesce(f.first < w.doc_id, false) AS hit FROM w LEFT JOIN f ON w.run = f.run),
g AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op7_ngram_jaccard_join": _LINKED.format(percent=90, more=""),
    "op13_minhash": _LINKED.format(percent=85, more=", doc_id = component_id AS kept"),
    "op3_url_filter": r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(says, on_host, under) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, r.on_host || r.under AS rule, r.says,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.on_host || r.under) DESC) AS k
  FROM u JOIN r ON (u.host = r.on_host OR ends_with(u.host, '.' || r.on_host)) AND starts_with(u.path, r.under))
SELECT u.page_id, u.host, u.path, m.rule,
       coalesce(m.says, CASE WHEN list_has_any(string_split(u.host, '.'),
         ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
""",
    "op4_chat_rotation": r"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
d AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_id ELSE 'conversation ' || conv_id END AS dialogue FROM t),
s AS (SELECT DISTINCT dialogue, role AS participant FROM d WHERE role <> 'system'),
p AS (
  SELECT d.dialogue, d.conv_id, s.participant, d.turn, d.role, d.text, d.role = s.participant AS own,
         '<|im_start|>' || CASE WHEN d.role = s.participant THEN 'assistant' WHEN d.role = 'system' THEN 'system'
           ELSE 'user name=' || d.role END || chr(10) AS head,
         d.text || '<|im_end|>' || chr(10) AS body
  FROM d JOIN s ON d.dialogue = s.dialogue),
w AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY dialogue, participant
    ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM p)
SELECT any_value(conv_id) AS conv_id, participant, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(upto AS BIGINT) - length(body) AS VARCHAR) || '-' || CAST(CAST(upto AS BIGINT) AS VARCHAR) END, ','
         ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM w GROUP BY dialogue, participant
""",
    # CRC-32 bit by bit; a replaced code point leaves the same rest without the same place, a deleted one is the other word itself
    "op12_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) r WHERE length(run) >= 7),
keyed AS (SELECT run, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS digits FROM runs),
hashed AS (
  SELECT run, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(digits) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM keyed),
occ AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, count(*) AS n FROM occ WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w) x),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
up(word, root) AS (
  SELECT word, coalesce(form, word) FROM f
  UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
r AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN r ON f.word = r.word
""",
}
