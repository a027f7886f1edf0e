"""Scaled sketches, fill-in-middle and spelling variants against plain versions on small hand-made tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import fill_middle, sketches, spelling

DOCS = "doc_id bigint, text string, n int, form string, output string, mark string, block int"
CLASH = (1, "x", "y", "z", 2)


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, *CLASH) for d, t in rows], DOCS)


RNG = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "déjà", "漢字", "omega", "😀 kappa", "sigma\ttau", "<", "P>"]
LONG = " ".join(RNG.choice(WORDS) for _ in range(60000))
TEXTS = [(i, " ".join(RNG.choice(WORDS) for _ in range(n))) for i, n in enumerate((0, 1, 2, 4, 5, 6, 30, 200, 3, 40))]
TEXTS += [(20, None), (21, ""), (22, LONG), (23, "a <P> b"), (24, "<S>"), (25, "ends <M>"), (7, "another text of id seven"), (None, "no id at all, but words"), (30, "<<P"), (31, "P>S>M>")]
REPEATED = TEXTS + [TEXTS[6]] * 9 + [TEXTS[-3]] * 3


def plain_sketch(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    hashes = {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4))} if w else set()
    return {h for h in hashes if h < "2"} or ({min(hashes)} if hashes else set())


def plain_likeness(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))


def test_edited_likeness_equals_the_plain_version(spark):
    rows = [(d, t or "") for d, t in REPEATED]
    ordered = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    after = dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))
    want = []
    for d, t in rows:
        nxt = after[d, t][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b = plain_sketch(t), plain_sketch(edited)
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(sorted(a)), ",".join(sorted(b)), plain_likeness(a, b), plain_likeness(a, plain_sketch(nxt))))
    got = [(str(r[0]), *r[1:]) for r in sketches.edited_likeness(docs_of(spark, REPEATED)).collect()]
    assert sorted(got) == sorted(want)
    assert sketches.edited_likeness(docs_of(spark, REPEATED).limit(0)).count() == 0
    alone = sketches.edited_likeness(docs_of(spark, [(1, "one text alone here now")])).first()
    assert alone.near_next == 1.0


def test_sketches_merge_and_estimate_containment_of_unequal_texts(spark):
    rng = random.Random(8)
    small = [str(rng.random()) for _ in range(2000)]
    large = small[:1000] + [str(rng.random()) for _ in range(60000)]
    df = spark.createDataFrame([(" ".join(small), " ".join(large), "two words")], "a string, b string, c string")
    s = df.select(*[sketches.sketch(F.col(c)).alias(c) for c in "abc"], sketches.sketch(F.concat_ws(" ", "a", "b", "c")).alias("all"))
    row = s.select(
        sketches.containment(F.col("a"), F.col("b")).alias("ab"), sketches.containment(F.col("b"), F.col("a")).alias("ba"),
        F.size(F.array_except(sketches.merged(sketches.merged(F.col("c"), F.col("a")), F.col("b")), F.col("all"))).alias("more"),
        sketches.merged(F.col("c"), F.col("c")).eqNullSafe(F.col("c")).alias("same"),
    ).first()
    assert abs(row.ab - 0.5) < 0.15 and abs(row.ba - 1 / 61) < 0.01 and row.more <= 1 and row.same
    groups = spark.createDataFrame([("g", " ".join(small)), ("g", "two words"), ("h", "two words"), (None, "two words"), ("e", None)], "g string, text string")
    rows = sketches.group_sketch(groups, ["g"]).groupBy("g").agg(F.sort_array(F.collect_list("hash")).alias("s")).collect()
    assert {r.g: set(r.s) for r in rows} == {"g": {h for h in plain_sketch(" ".join(small)) | plain_sketch("two words") if h < "2"}, "h": plain_sketch("two words"), None: plain_sketch("two words")}


def test_native_plan_of_sketches(spark):
    plan = sketches.edited_likeness(docs_of(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def plain_fill(doc_id, text):
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = text[:p], text[p:m], text[m:]
    return (n, "spm", p, m - p, f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (n, "psm", p, m - p, f"<P>{a}<S>{c}<M>{b}")


def test_fill_in_middle_and_back(spark):
    rows = REPEATED + [(k, t) for k in range(100, 160) for t in ("é", "<", "P", "ab漢", "x<P", "<P<S")]
    planned = fill_middle.plan_cuts(docs_of(spark, rows))
    got = fill_middle.restore(fill_middle.fill_in_middle(planned)).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fill(r.doc_id, r.text or "")
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(planned.limit(0)).count() == 0


def test_fill_in_middle_in_one_text_slices(spark, monkeypatch):
    planned = fill_middle.plan_cuts(docs_of(spark, [(i, t) for i, t in enumerate([LONG, "", None, LONG])]).coalesce(1))
    assert [r.restored for r in fill_middle.restore(fill_middle.fill_in_middle(planned)).collect()] == [LONG, "", "", LONG]


def plain_words(rows):
    count = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        at = w
        while form[at] is not None:
            at = form[at]
        out.append((w, form[w], at, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made_texts(n=400):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéØß") for _ in range(rng.randrange(7, 11))) for _ in range(40)] + ["elephant", "ELEPHANT", "aaaaaaaa", "×÷×÷×÷×"]
    weights = [1 / (i + 1) for i in range(len(base))]
    rows = [(i, ", ".join(rng.choices(base, weights, k=rng.randrange(0, 120)))) for i in range(n)]
    return rows + [(None, "elephant Elephant"), (5, None), (6, ""), (7, "short"), (8, "m" * 3000), (9, "m" * 3000), (10, "m" * 3001 + " " + "m" * 3001)] + [rows[3]] * 40


def test_variants_equal_the_plain_version(spark):
    rows = made_texts()
    words = plain_words(rows)
    counted = spelling.word_counts(docs_of(spark, rows))
    assert {r.word: r.n for r in counted.collect()} == words
    want = plain_variants(words)
    assert sorted(tuple(r) for r in spelling.variants(counted).collect()) == want
    assert any(r[1] for r in want) and max(r[4] for r in want) > 3
    assert spelling.variants(counted.limit(0)).count() == 0


@pytest.mark.parametrize("tiles", [(1, 1), (3, 2), (1024, 8192)])
def test_tiles_bound_work_not_results(spark, tiles):
    words = spark.createDataFrame([(w, n) for w, n in plain_words(made_texts(120)).items()], "word string, n bigint")
    pairs = spelling.near_pairs(words, *tiles)
    got = [tuple(sorted((r.word, r.near))) for r in pairs.collect()]
    all_ = [r.word for r in words.collect()]
    assert sorted(got) == sorted((a, b) for a in all_ for b in all_ if a < b and one_edit(a, b))


def test_chain_of_forms_leads_to_the_last(spark):
    names = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    words = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(names)] + [("aaaaaaac", 20), ("zzzzzzzz", 3)], "word string, n bigint")
    got = {r.word: (r.form, r.root) for r in spelling.variants(words).collect()}
    assert got["aaaaaaaa"] == ("aaaaaaab", "aaabbbbb") and got["aaabbbbb"] == (None, "aaabbbbb") and got["zzzzzzzz"] == (None, "zzzzzzzz")
