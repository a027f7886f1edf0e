import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import postings as P
from shelfmark.operators import retrieval as R
from shelfmark.plans import q_retrieval


def brute(chunks, queries, k, k1=1.5, b=0.75):
    """BM25 summed pair by pair; rows of one id, null included, add up."""
    docs = [(i, Counter((t or "").split())) for i, t in chunks]
    n, avgdl = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    scores = defaultdict(float)
    for q, text in queries:
        for t in set(text.split()):
            for i, c in docs:
                if c[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    scores[q, i] += idf * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / avgdl))
    out = {}
    for q in {q for q, _ in scores}:
        mine = sorted(((-round(s, 9), i is not None, i or 0) for (p, i), s in scores.items() if p == q))
        out[q] = [(i if known else None, round(-s, 6)) for s, known, i in mine[:k]]
    return out


@pytest.fixture()
def rows():
    words = [f"w{i}" for i in range(12)]
    chunks = [(i, " ".join(words[(i * j + j) % 12] for j in range(1 + i % 5)) + " all") for i in range(60)]
    chunks += [(7, "w1 w2 all"), (7, "w1"), (None, "w3 all"), (None, "w3 w4"), (99, None), (98, "")]
    queries = [(q, f"w{q} w{(q * 5) % 12} all") for q in range(9)] + [(None, "w4 w5"), (3, "w6 all"), (50, "nowhere")]
    return chunks, queries


@pytest.mark.parametrize("sizes", [{}, {"QUERY_TILE": 2, "PACK_CHUNKS": 3, "PACK_POSTINGS": 5, "STEP_PAIRS": 2, "TASK_PAIRS": 16}])
def test_tiles_score_like_pairs(spark, rows, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(P, name, value)
    chunks, queries = rows
    c = spark.createDataFrame(chunks, "chunk_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    want = brute(chunks, [(i, t) for i, t in queries if i != 3], 4)
    got = defaultdict(list)
    out = R.bm25_topk(c, q, k=4)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["chunk_id"], round(r["score"], 6)))
    both = got.pop(3)
    want.pop(3, None)
    assert dict(got) == want
    # a repeated query id: the tokens of both rows, a token of both counted twice
    assert len(both) == 4 and both == sorted(both, key=lambda x: -x[1])


def test_pairs_are_not_aggregated_by_key(spark, rows):
    """Few bytes of postings that meet many queries are dealt by their pairs, and no hash map holds the pairs."""
    chunks, queries = rows
    out = R.bm25_topk(spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), k=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [chunk_id" not in plan


def test_pack_collapses_a_repeated_chunk(spark, monkeypatch):
    monkeypatch.setattr(P, "PACK_POSTINGS", 8)
    rows = spark.createDataFrame([(1, "a", 0.5)] * 30 + [(1, "b", 1.0)] * 3 + [(2, "a", 2.0)], "chunk_id long, token string, part double")
    packs = P._packed(rows.repartition(1).sortWithinPartitions("chunk_id")).collect()
    total = Counter()
    for p in packs:
        for i, t, x in zip(p["chunk_id"], p["token"], p["part"], strict=True):
            total[i, t] += x
    assert total == {(1, "a"): 15.0, (1, "b"): 3.0, (2, "a"): 2.0}
    assert sum(1 in p["chunk_id"] for p in packs) == 1


def test_dense_ties_are_cut_in_the_tile(spark, monkeypatch):
    """Copies of one vector: a tile hands on k rows a query, the smallest ids, and the result is that of a full ranking."""
    k = 5
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [float(i % 7), 1.0]) for i in range(299, -1, -1)], "chunk_id long, embedding array<double>").coalesce(1)
    vectors = vectors.unionByName(spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.0])], vectors.schema)).coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 1.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in R.dense_topk(vectors, queries, k, vector_tile=64).collect()}
    rows = [(r["chunk_id"], r["embedding"]) for r in vectors.collect()]
    for q, v in ((1, (1.0, 0.0)), (2, (0.0, 1.0))):
        best = sorted(((i, v[0] * e[0] + v[1] * e[1]) for i, e in rows), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:k]
        assert [got[q, n] for n in range(1, k + 1)] == best
    assert len(got) == 2 * k
    monkeypatch.setattr(R, "top_per", lambda df, *a, **b: df)
    handed = R.dense_topk(vectors, queries, k, vector_tile=64).groupBy("query_id").count().collect()
    assert max(r["count"] for r in handed) <= k * 7  # 302 rows in tiles of 64, the union's parts apart


def test_catalogue_vectors_stay_where_their_rows_are(spark, tmp_path):
    spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = spark.range(20).select(F.col("id").alias("chunk_id"))
    got = q_retrieval.catalog_vectors(spark, str(tmp_path), rows, "chunk_id", 3, "v")
    assert sorted((r["chunk_id"], r["v"]) for r in got.collect()) == [(i, [float(i % 3)]) for i in range(20)]
    assert "strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()
