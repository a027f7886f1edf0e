"""Near duplicates, long repeats, decontamination, search, toxicity and the pipeline against plain versions."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from shelfmark.llm import bpe, decontaminate, long_repeats, near_dups, neighbours, toxicity  # noqa: E402

DOCS = "doc_id bigint, text string, component_id string, band int"


def edited(words, rng, share):
    return [rng.choice("pqrstuvwxyz") * rng.randrange(3, 9) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    rng = random.Random(size)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = [" ".join(edited(base, rng, 0.045)) for _ in range(160)]  # a group round one text: many pairs just above and below
    texts += [" ".join([*base[:70], *(rng.choice(vocab) for _ in range(rng.randrange(10, 40)))]) for _ in range(60)]  # one passage, own ends
    for _ in range(30):
        own = [rng.choice(vocab) for _ in range(rng.randrange(1, 60))]
        texts += [" ".join(edited(own, rng, s)) for s in (0, 0.01, 0.03, 0.08)]
    texts += [None, "", " \n", "one", "ONE", "one two", "One  two", "one two three", texts[0].upper(), texts[3]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, size, 80).collect()}
    want = brute.components(rows, size, 80)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_duplicates_of_odd_tables(spark):
    rows = [(None, "a b c", "x", 1), (None, "a b c", "x", 1), (5, "a b c", "x", 1), (5, "a b c", "x", 1), (7, "a b c", "x", 1), (8, None, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, 2).collect())))
    assert got == sorted(map(str, [(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]))
    assert near_dups.near_duplicates(docs.limit(0), 2).count() == 0
    assert sorted((r.doc_id or -1) for r in near_dups.one_of_each(docs, 2).collect()) == [-1, -1, 5, 8]


def test_long_repeats_equal_a_plain_scan(spark):
    rng = random.Random(4)
    common = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(n)) for n in (19, 20, 21, 50, 90)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice([rng.choice(common), "z " * rng.randrange(1, 60), "ab cd " * rng.randrange(1, 30), " ".join(str(rng.random()) for _ in range(rng.randrange(1, 30)))]))
        texts.append("\n".join(parts))
    texts += [None, "", "  ", "x y", "  é", common[4], common[4], common[4] + " end"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, block string, part int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in long_repeats.removed_words(docs).collect()}
    assert got == brute.struck(rows, 20)
    odd = spark.createDataFrame([(None, common[4]), (3, common[4]), (3, common[4])], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in long_repeats.removed_words(odd).collect()) == [(-1, 90), (3, 0), (3, 0)]
    assert long_repeats.removed_words(odd.limit(0)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def plain_overlaps(docs, bench):
    """(doc, item) -> equal words of the best stretch, every alignment tried."""
    out = {}
    for d, text in docs:
        w = plain_words(text)
        for i, t in bench:
            v = plain_words(t)
            for shift in range(-len(v) + 1, len(w)):
                a, b = max(0, shift), min(len(w), shift + len(v))
                equal = np.array([w[k] == v[k - shift] for k in range(a, b)], bool)
                if equal.any():
                    _, _, n = decontaminate.best_stretch(equal)
                    if n >= decontaminate.needed(len(v)):
                        out[d, i] = max(n, out.get((d, i), 0))
    return out


def test_decontamination_finds_planted_passages_and_nothing_else(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    bench = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((4, 8, 15, 16, 20, 30, 60))] + [(90, None), (91, ""), (92, "...")]
    docs, planted = [], set()
    for d in range(60):
        parts = [word() for _ in range(rng.randrange(0, 80))]
        if d % 3 == 0:
            i, text = bench[d // 3 % 7]
            words = text.split()
            for k in rng.sample(range(len(words)), len(words) // 6 if len(words) > 9 else 0):
                words[k] = word()
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = [w.upper() + rng.choice(["", ",", ".\n"]) for w in words]
            planted.add((d, i))
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, bench[6][1][: len(bench[6][1]) // 8])]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string").repartition(3)
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.find_overlaps(df, items).collect()}
    want = plain_overlaps(docs, bench)
    assert planted <= set(got) and set(got) <= set(want)
    assert all(got[k] == want[k] for k in got if len(plain_words(bench[k[1]][1])) >= 9 if k[1] < 7)
    left = decontaminate.without_overlaps(df, items)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_overlaps(df, items.limit(0)).count() == 0 and decontaminate.find_overlaps(df.limit(0), items).count() == 0


def test_small_blocks_of_the_benchmark_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.find_overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    assert len(list(decontaminate.benchmark_blocks(bench))) > 2
    assert sorted(map(tuple, decontaminate.find_overlaps(docs, bench).collect())) == whole and whole


def plain_nearest(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_search_reaches_the_recall_asked_for(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 24))
    x[100:140] = x[100]  # equal vectors: ties go to smaller ids
    rows = [(i, [float(v) for v in x[i]]) for i in range(4000)]
    odd = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [float("inf")] + [0.0] * 23), (5080, [1.0, None] + [0.0] * 22), (5100, [1.0]), (5120, []), (None, rows[0][1]), rows[7]]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *odd]], "vec_id bigint, embedding array<float>, rank int").repartition(4)
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = plain_nearest(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in {v for v, _, _ in found}
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert [v for v, _, _ in got[120]][:19] == [v for v, _ in want[120]][:19]
    router = neighbours.fit(df.where(neighbours.usable(F.col("embedding")) & (F.size("embedding") == 24)).select("vec_id", "embedding"))
    assert router.parts > 4 and router.visits < router.parts


def test_search_of_small_tables_is_exact(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got: dict = {}
    for r in neighbours.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain_nearest(rows, 20)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.97 * 20 * len(want)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in neighbours.search(few, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(1, 4.0), (2, 4.0)]
    assert neighbours.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_copies_of_a_row_hide_no_other_id(spark):
    same, other = [1.0, 2.0], [1.0, 1.0]
    rows = [(0, other)] + [(20, same)] * 100 + [(i, same) for i in (31, 30, 45)] + [(60 + i, [0.1, 0.1 + i / 1000]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    lone = neighbours.Router(2, 1, 1, np.zeros((2, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), np.zeros(0, np.int64), np.zeros((0, 2)))
    got = neighbours.search(df, F.col("vec_id").isin(0, 20), 4, lone).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 20), (0, 30), (0, 31), (0, 45), (20, 30), (20, 31), (20, 45), (20, 0)]


def test_balanced_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(1000, 8))
    part = neighbours.balanced_parts(x, neighbours.neighbour_lists(x, 10), 8)
    assert np.bincount(part, minlength=8).min() >= 100 and np.bincount(part, minlength=8).max() <= 140


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, "score").join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("toxic", "score").collect()
    bad, good = [r.score >= 0.5 for r in rows if r.toxic == 1], [r.score >= 0.5 for r in rows if r.toxic == 0]
    assert np.mean(bad) >= 0.85 and np.mean(good) <= 0.02
    assert all(0 <= r.score <= 1 for r in rows)
    # other labels on held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.mine_entries(docs, flipped)[0] == model.entries


def test_toxicity_of_odd_tables(spark):
    rows = [(i, ("you utter gronk " if i % 3 == 0 else "a fine day ") + f"said w{i % 7}", 0.1) for i in range(300)] + [(900, None, 0.1), (None, "", 0.1), (901, "GRONK", 0.1), (901, "GRONK", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxicity double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([-1, 900, *(i for i in range(300) if i % 3)])
    same = {r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()}
    assert len(same) == 1 and same.pop() < 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_of_rare_words_and_of_hundreds(spark):
    rng = np.random.default_rng(6)
    name = lambda i: "zq" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "ix"
    clean = [f"clean{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    common, rare, many = ["gronkle", "blarfing", "snorvex", "wuzzock"], "vilqamor", [name(i) for i in range(300)]

    def run(toxic: list[list[str]]) -> list[dict]:
        rows = [(i, " ".join([*rng.choice(clean, 8), *(toxic[i // 5] if i % 5 == 0 else [])])) for i in range(5 * len(toxic))]
        rows = [(7 * i + 1, t) for i, t in rows]  # ids that are held out or not, whatever the label
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        labels = spark.createDataFrame([(d, int((d - 1) // 7 % 5 == 0)) for d, _ in rows], "doc_id bigint, toxic int")
        scored = toxicity.score(docs, toxicity.fit(docs, labels), "score").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
        return [(r.doc_id - 1) // 7 % 5 == 0 and (r.text, r.score, r.held) or (None, r.score, r.held) for r in scored]

    out = run([[rare] if i % 333 == 0 else list(rng.choice(common, 2)) for i in range(4000)])  # 0.3 per cent of the toxic rows
    assert all(s >= 0.5 for t, s, _ in out if t and rare in t)
    assert np.mean([s >= 0.5 for t, s, held in out if t and held]) >= 0.99 and not any(s >= 0.5 for t, s, _ in out if not t)
    out = run([[many[i % 300]] for i in range(4000)])
    assert np.mean([s >= 0.5 for t, s, held in out if t and held]) >= 0.99 and np.mean([s >= 0.5 for t, s, _ in out if not t]) <= 0.002


def test_label_model_recovers_rates_and_correlation():
    rng = np.random.default_rng(5)
    n, prior = 40000, 0.1
    y = rng.random(n) < prior
    votes = np.zeros((n, toxicity.VOTERS), bool)
    hit, false = rng.uniform(0.3, 0.8, toxicity.VOTERS), rng.uniform(0.0, 0.03, toxicity.VOTERS)
    for j in range(toxicity.VOTERS):
        votes[:, j] = rng.random(n) < np.where(y, hit[j], false[j])
    votes[:, 1] = votes[:, 0]  # a voter that copies another
    model = toxicity.fit_label_model(n, (votes.T.astype(float) @ votes), prior)
    assert np.abs(model.hit - hit)[2:].max() < 0.08 and np.abs(model.false - false)[2:].max() < 0.02
    assert model.correlation[0, 1] > 0.8 and model.weight[0] < 0.7 and model.weight[2:].min() > 0.7
    assert ((model.posterior(votes.astype(float)) > 0.5) == y).mean() > 0.99


def test_pipeline_stage_by_stage(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs = documents.withColumn("extra", F.lit("kept"))
    kept = {"documents": {r.doc_id: r.text for r in documents.collect()}}
    before = kept["documents"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = {r.doc_id: r for r in out.collect()}
        texts = {d: r.text for d, r in rows.items()}
        assert out.count() == len(rows) and all(r.extra == "kept" for r in rows.values())
        if name == "min_max_hashing":
            groups = brute.components(sorted(before.items()), 5, 80)
            assert set(texts) == {d for d, (_, c) in groups.items() if c == d}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            gone = set(before) - set(texts)
            inside = {d for d, t in before.items() for _, b in bench if " ".join(plain_words(b)) in " ".join(plain_words(t))}
            assert inside <= gone and not gone - {d for d, _ in plain_overlaps([(d, before[d]) for d in gone], bench)}
        elif name == "personal_data":
            assert set(texts) == set(before)
            for d, t in before.items():
                assert not brute.personal(t) or texts[d] != t
                assert brute.personal(t) or "<TERM>" in (texts[d] or "") or texts[d] == t
                assert rows[d].n_chars == len(texts[d] or "")
        before, docs = texts, out
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(corpus_pipeline.RANKS))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(final) == set(before) and len(before) < len(kept["documents"])
    for d, t in before.items():
        assert final[d].round_trip and list(np.frombuffer(bytes(final[d].ids_le), "<u4")) == enc.encode_ordinary(t or "")
