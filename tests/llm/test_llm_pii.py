"""Personal data against a plain scan, and disclosing terms on a made corpus."""

from __future__ import annotations

import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from shelfmark.llm import pii  # noqa: E402
from shelfmark.llm.queries import op7_disclosure  # noqa: E402


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(2)
    bits = ["a@b.cc", "x.y+z@d-e.f.g", "@", ".", "-", " ", "1", "22", "255", "256.1.1.1", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "+49 (30) 1234-567", "+1", "(", ")", "é", "\u0001", "\u0002", "\u0003", "😀", "a", "_", "%", "\n", "..", "0000000000000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + [None, "", "1-" * 20000, "a." * 20000 + "@x.y", "a@" + "b." * 20000 + "c", "9" * 50000, "+1" + " (" * 20000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string").repartition(4)
    got = {r.doc_id: r.s for r in docs.select("doc_id", pii.spelled(pii.base_spans(F.col("text"))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.spelled(brute.personal(t)), repr(t)[:300]


def test_query_equals_a_plain_scan(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_disclosure(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.personal(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.spelled(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _, _ in want) for j in range(4)]
        assert set(brute.spelled(want).split(",")) <= set(r.spans.split(","))


def test_terms_that_give_an_entity_away_are_generalised(spark):
    fill = ["the quick man of", "said that over", "and then with", "was here for", "from this one"]
    rows = [(i, f"{fill[i % 5]} Zorbax mail jo@ex.org {fill[(i + 2) % 5]} today") for i in range(5)]
    rows += [(10 + i, f"{fill[i % 5]} {fill[(i + 1) % 5]} mail today") for i in range(40)]
    rows += [(60 + i, "copy Quendil writes kim@ex.org here") for i in range(6)]  # one wording only
    rows += [(None, None), (70, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = pii.sanitised(docs.withColumn("terms", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    texts = [r.text or "" for r in out]
    assert not any("Zorbax" in t or "jo@ex.org" in t or "kim@ex.org" in t for t in texts)
    assert sum("<TERM> mail <EMAIL>" in t for t in texts) == 6
    assert sum("copy Quendil writes <EMAIL> here" in t for t in texts) == 6
    assert sorted(t for t in texts if "@" not in t and "<" not in t) == sorted((t or "") for d, t in rows if "@" not in (t or ""))
    assert pii.sanitised(docs.limit(0)).count() == 0


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = "filler words of no note " * 30
    rows = [(i, f"Zorbax {far} jo@ex.org {i} and again Zorbax") for i in range(20)]  # 700 characters apart
    rows += [(30, "asked for ZORBAX in person"), (31, "asked for Zorbaxes in person")]  # the entity is not spelled out
    rows += [(40 + i, f"{w} {far} 192.0.2.7 Quendil") for i, w in enumerate(("note", "filler"))]  # two texts only
    rows += [(50 + i, f"filler words of no note and again asked for {i} in person") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    texts = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert all(texts[i] == f"<TERM> {far} <EMAIL> {i} and again <TERM>" for i in range(20))
    assert texts[30] == "asked for <TERM> in person" and texts[31] == rows[21][1]
    assert [texts[40], texts[41]] == [f"{w} {far} <IP> <TERM>" for w in ("note", "filler")]
    assert all(texts[d] == t for d, t in rows[24:])
    spans = {r.doc_id: r.s for r in pii.all_spans(docs).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()}
    assert spans[30] == "term:10:16" and spans[31] == ""


def test_evidence_of_one_text_counts_in_a_large_corpus(spark):
    rows = [(0, "Quendil wrote from ann@ex.org today")] + [(i, f"they wrote from w{i % 7} today") for i in range(1, 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.text for r in pii.sanitised(docs).collect()} == dict(rows) | {0: "<TERM> wrote from <EMAIL> today"}
