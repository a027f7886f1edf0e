"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chat, decontaminate, fill_middle, long_repeats, near_dups, neighbours, pii, sharding, sketches, spelling, toxicity, url_filter
from shelfmark.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@register(
    "op1_jump_sharding",
    """
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT AS number
  FROM documents
), step_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM range(256) AS g(b)
  )
), sums AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(string_split_regex(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '),
      lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END)),
    lambda a, b: CASE WHEN b IS NULL THEN a ELSE xor(a // 256, t[(xor(a % 256, b) + 1)::INT]) END), 4294967295) AS text_crc32
  FROM rows_, step_table
), walk AS (
  SELECT r, n, number::UHUGEINT AS k, 0::BIGINT AS b, 0::BIGINT AS j FROM rows_, (VALUES (24), (25)) AS s(n)
  UNION ALL
  SELECT r, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT r, n, j, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2 FROM walk WHERE j < n)
), placed AS (
  SELECT r, n, b FROM walk WHERE j >= n
)
SELECT doc_id, size, text_crc32, 'key' AS law, a.b::INT AS shard,
  row_number() OVER (PARTITION BY a.b ORDER BY number // 72057594037927936, text_crc32, number, size, doc_id) - 1 AS slot, g.b::INT AS grown_shard
FROM rows_ JOIN sums USING (r) JOIN placed a USING (r) JOIN placed g USING (r) WHERE a.n = 24 AND g.n = 25
""",
)
def op1_jump_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf, "documents"), 24)


EXTRA_TEXT = "\\### Assistant: </turn> ok"

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register(
    "op2_reply_trees",
    f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length('<turn >' || {_ESC.format("role")} || {_ESC.format("text")} || '</turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""",
)
def op2_reply_trees(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_paths(chat.chain_tree(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.get_json_object("tree", "$.conv_id").cast("bigint").alias("conv_id"), "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@register("op3_learned_partitions")
def op3_learned_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register("op4_spaced_seeds")
def op4_spaced_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op5_weak_supervision")
def op5_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")), "score").drop("text")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register(
    "op6_min_max_hashing",
    """
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_ AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least_ USING (doc_id)
""",
)
def op6_min_max_hashing(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf, "documents"), size=2, percent=80)


@register("op7_disclosure")
def op7_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    rows = pii.all_spans(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")  # noqa: E731
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(pii.spelled(base), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@register("op8_merge_replay")
def op8_merge_replay(spark: SparkSession, sf: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), BPE_RANKS, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, BPE_RANKS).select(
        "doc_id", (F.octet_length("ids_le") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register(
    "op9_recompression",
    """
WITH words AS (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM documents
), lists AS (
  SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM words
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM lists)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, range(20) AS g(k)
), kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM lists) u ANTI JOIN gone USING (doc_id, i) GROUP BY u.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM lists LEFT JOIN kept USING (doc_id)
""",
)
def op9_recompression(spark: SparkSession, sf: str) -> DataFrame:
    return long_repeats.removed_words(table(spark, sf, "documents"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

_URL_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"


@register(
    "op10_url_trie",
    f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), hits AS (
  SELECT *, CASE {' '.join(f"WHEN {_URL_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({', '.join(f"'{h}{p}'" for h, p, v in URL_RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM hits
""",
)
def op10_url_trie(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


@register(
    "op11_scaled_sketch",
    """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars, count(*) AS copies FROM documents GROUP BY ALL
), paired AS (
  SELECT *, coalesce(lead(text) OVER o, first(text) OVER o) AS next_text FROM docs WINDOW o AS (ORDER BY doc_id NULLS FIRST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edited AS (
  SELECT *, left(text, (n_chars - n_chars // 4)::INT) || left(next_text, (n_chars // 4)::INT) AS edited FROM paired
), texts AS (
  SELECT DISTINCT unnest([text, next_text, edited]) AS t FROM edited
), worded AS (
  SELECT t, list_filter(string_split_regex(t, '[ 	-]+'), lambda x: x <> '') AS w FROM texts
), hashes AS (
  SELECT t, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [left(md5(array_to_string(w, ' ')), 16)]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: left(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]), 16))) END AS h FROM worded
), sketches AS (
  SELECT t, CASE WHEN len(list_filter(h, lambda x: x < '2')) > 0 THEN list_sort(list_filter(h, lambda x: x < '2'))
    WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END AS s FROM hashes
), likened AS (
  SELECT e.*, a.s AS s, b.s AS se, c.s AS sn FROM edited e JOIN sketches a ON a.t = e.text JOIN sketches b ON b.t = e.edited JOIN sketches c ON c.t = e.next_text
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(s, ',') AS fingerprint, array_to_string(se, ',') AS edited_fingerprint,
  CASE WHEN len(s) = 0 AND len(se) = 0 THEN 1.0::DOUBLE WHEN len(s) = 0 OR len(se) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s, se))::DOUBLE / least(len(s), len(se)) END AS near_edited,
  CASE WHEN len(s) = 0 AND len(sn) = 0 THEN 1.0::DOUBLE WHEN len(s) = 0 OR len(sn) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s, sn))::DOUBLE / least(len(s), len(sn)) END AS near_next
FROM likened, range(copies) AS g(k)
""",
)
def op11_scaled_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.edited_likeness(table(spark, sf, "documents"))


@register(
    "op12_displacement_scatter",
    """
WITH cuts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d, length(coalesce(text, ''))::BIGINT AS n FROM documents
), draws AS (
  SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM cuts
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws
), pieces AS (
  SELECT *, left(t, p::INT) AS prefix, substr(t, p + 1, m - p) AS middle, substr(t, m + 1) AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
""",
)
def op12_displacement_scatter(spark: SparkSession, sf: str) -> DataFrame:
    planned = fill_middle.plan_cuts(table(spark, sf, "documents").select("doc_id", "text"))
    rows = fill_middle.restore(fill_middle.fill_in_middle(planned).drop("text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@register(
    "op13_blocked_gram",
    """
WITH RECURSIVE runs AS (
  SELECT key, run, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), step_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM range(256) AS g(b)
  )
), sums AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(string_split_regex(rtrim(regexp_replace(hex(encode(key || ':' || run)), '(..)', '\\1 ', 'g')), ' '),
    lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::INT])), 4294967295) AS h
  FROM runs, step_table
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM sums
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, n, i, left(word, i::INT - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.l || a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.l || a.r = b.word
), found AS (
  SELECT word, n, count(near) AS n_near, arg_min({'near': near, 'near_n': near_n}, {'a': -near_n, 'b': near}) AS best FROM words LEFT JOIN near USING (word) GROUP BY word, n
), formed AS (
  SELECT word, n, n_near, CASE WHEN n_near > 0 AND best.near_n >= 10 * n THEN best.near END AS form, CASE WHEN n_near > 0 AND best.near_n >= 10 * n THEN best.near_n END AS form_n FROM found
), walk AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.at AS root FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
""",
)
def op13_blocked_gram(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf, "documents")))
