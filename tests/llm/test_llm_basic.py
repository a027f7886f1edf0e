"""Sharding, chat formatting, URL filter and BPE on small hand-made tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chat, sharding, url_filter
from shelfmark.llm.queries import BPE_RANKS, EXTRA_TEXT, URL_RULES

DOCS = "doc_id bigint, text string, shard string, number int"
ROWS = [(1, "a b", "x", 1), (2, None, None, None), (3, "", "y", 2), (4, "é" * 3000, "z", 3), (None, "n", "x", 4), (1, "a b", "x", 1), (1, "a b", "x", 1), (1, "other", "x", 1)]


def test_manifest_has_every_row_in_a_gapless_slot(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = sharding.shard_manifest(docs, 3).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted(
        (d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS
    )
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert sharding.shard_manifest(docs.limit(0), 3).count() == 0


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    for n in (1, 5, 24):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a, minlength=n).min() > 0.8 * len(keys) / n


def test_write_shards_keeps_whole_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).drop("shard")
    sharding.write_shards(docs, "doc_id", 3, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


def brute_paths(nodes):
    """Root-to-leaf paths by walking up, on the driver."""
    by = {(t, n): (p, r, x, s) for t, n, p, r, x, s in nodes}
    answered = {(t, p) for t, n, p, *_ in nodes if p is not None}
    out = {}
    for t, n, *_ in nodes:
        if (t, n) in answered:
            continue
        path, at = [], n
        while at is not None and (t, at) in by:
            path.append(at)
            at = by[t, at][0]
        path.reverse()
        out.setdefault(t, []).append((-sum(by[t, m][3] or 0 for m in path), n, path))
    return {t: sorted(v) for t, v in out.items()}


def test_reply_trees_rank_and_format_branches(spark):
    rng = random.Random(5)
    nodes = []
    for t in ("p", "q", "r"):
        for n in range(1, 40):
            parent = rng.randrange(max(1, n - 4), n) if n > 1 else (99 if t == "q" else None)  # 99 is absent
            nodes.append((t, n, parent, rng.choice(["user", "assistant", None]), rng.choice(["<turn x>", "a & b &lt;", None, "</turn>\n", "\\"]), rng.choice([0.5, 1.0, None])))
    nodes += [("loop", 1, 2, "user", "x", 1.0), ("loop", 2, 1, "user", "x", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node bigint, parent bigint, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    back = chat.read_back(chat.format_paths(df, branches=2)).collect()
    want = brute_paths([n for n in nodes if n[0] != "loop"])
    by = {(t, n): (r or "", x or "") for t, n, p, r, x, s in nodes}
    assert len(back) == sum(min(2, len(v)) for v in want.values())
    for r in back:
        score, leaf, path = want[r.tree][r.branch - 1]
        assert (r.leaf, r.n_turns) == (leaf, len(path)) and abs(r.path_score + score) < 1e-9
        assert [tuple(t) for t in r.turns] == [by[r.tree, m] for m in path]
        assert r.loss_text == "".join(by[r.tree, m][1] for m in path if by[r.tree, m][0] == "assistant")
        for (role, text), s in zip([by[r.tree, m] for m in path], r.spans, strict=True):
            assert r.formatted[s.start : s.end].replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&") == text


def test_linear_conversations_with_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, None), (-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.tree: r for r in chat.read_back(chat.format_paths(chat.chain_tree(df))).collect()}
    assert [tuple(t) for t in got['{"conv_id":1}'].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert [tuple(t) for t in got["{}"].turns] == [("", "")]
    assert got['{"conv_id":-7}'].loss_text == EXTRA_TEXT
    assert chat.format_paths(chat.chain_tree(df.limit(0))).count() == 0


URLS = [
    "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "x://m.example.com/en/a/b", "://net/es/", "http://b.net/fr/1?/es/",
    "http://net.com/fr/", "http://com/", "no scheme", "", None, "http://a.com?x=/", "http://b.net#/fr/", "http://b.net/fr", "http://É.com/é", "http://..com/", "a://b://c.net/es/",
]


def plain_verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest)] + [rest.find(c) for c in "/?#" if c in rest])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]
    fits = [(len(h) + len(p), h.count("."), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


RULES = [*URL_RULES, ("example.com", "/e", "allow"), ("net", "/fr/1", "allow"), ("c.net", "", "block"), ("com", "/a/b", "block")]


@pytest.mark.parametrize("rules", [URL_RULES, RULES])
def test_url_trie_and_join_agree_with_a_plain_scan(spark, rules):
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "v")], "page_id bigint, url string, verdict string")
    want = sorted([(i, *plain_verdict(u, rules, "allow")) for i, u in enumerate(URLS)] + [(None, *plain_verdict("http://a.com/", rules, "allow"))], key=str)
    for given in (rules, spark.createDataFrame(rules, "host string, path string, verdict string")):
        assert sorted(map(tuple, url_filter.judge(pages, given).collect()), key=str) == want
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def reference_encoding():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(BPE_RANKS))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library(spark):
    rng = random.Random(3)
    alphabet = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0x1C, 0x1F, 0x2003, 0x200B, 0x3000, 0xE9, 0x301, 0xDF, 0x4E2D, 0xAC00, 0x1F600, 0xBD, 0x661, 0xFEFF, 0x180E)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    texts += ["a" * n for n in range(1, 70)] + ["", None, "<|endoftext|>", "ab" * 5000, "I'm we'll THEY'RE  \n\n  x", "the " * 50000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids_le bigint")
    enc = reference_encoding()
    got = bpe.decode(bpe.encode(docs, BPE_RANKS, P.PATTERN), BPE_RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(np.frombuffer(bytes(r.ids_le), "<u4")) == enc.encode_ordinary(r.text or ""), repr(r.text)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), BPE_RANKS, P.PATTERN).count() == 0


def test_replay_of_odd_merge_orders_equals_the_library():
    """Ranks in an order no training gives: merges that bring up earlier ones."""
    rng = random.Random(8)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)}
        pool = [b"a", b"b", b"c"]
        while len(pool) < 40:
            pool.append(rng.choice(pool) + rng.choice(pool))
        extra = list({p for p in pool if len(p) > 1})
        rng.shuffle(extra)
        ordered = [bytes([b]) for b in range(256)] + extra
        enc = tiktoken.Encoding("odd", pat_str=r"[abc]+", mergeable_ranks={t: i for i, t in enumerate(ordered)}, special_tokens={})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Replay(ordered).encode(words)] == [enc.encode_ordinary(w.decode()) for w in words]
        assert len(tokens) == 256


def test_digests_of_documents_equal_the_library(spark, sf):
    from shelfmark.llm.queries import op8_merge_replay

    enc = reference_encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op8_merge_replay(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
