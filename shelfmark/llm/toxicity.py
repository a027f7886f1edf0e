"""Toxicity by weak supervision.

Lexicon entries (words) and patterns (word beginnings) are mined from labelled
training rows and dealt to many voters. A generative label model learns from the
votes on all documents, without labels, how accurate the voters are and which of
them copy each other; a linear classifier over the entries is trained on the
posterior labels it gives and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scale import broadcast_if_small
from shelfmark.llm.common import slices, whole_texts, written

#: Rows for the classifier.
FITTED_ROWS = 20000
#: Beginnings of words that count as patterns, and the voters words and patterns are dealt to.
STEMS = (4, 5, 6, 7, 8)
WORD_VOTERS, STEM_VOTERS = 12, 12
VOTERS = WORD_VOTERS + STEM_VOTERS
#: Least toxic rows and least smoothed log odds of an entry; and what bounds the list: it is held by the driver and by every task.
LEAST_ROWS, LEAST_LOG_ODDS, MAX_ENTRIES = 3, 3.0, 100_000


@dataclass
class LabelModel:
    """What the votes told: prior, each voter's rates on both classes, and its weight after correlations."""

    prior: float
    hit: np.ndarray
    false: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = self.weight * (np.log(self.hit) - np.log(self.false))
        no = self.weight * (np.log1p(-self.hit) - np.log1p(-self.false))
        logit = np.log(self.prior / (1 - self.prior)) + votes @ yes + (1 - votes) @ no
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, found: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(), -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _share(key: Column, share: float) -> Column:
    """A reproducible share of the rows, by their key."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def _beginnings(words: str, size: int) -> Column:
    """The first ``size`` letters of the words that have so many, marked as beginnings."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.concat(F.lit("^"), F.substring(w, 1, size)))


def _sketch(words: str) -> Column:
    """Smallest hash of five words in a row: copies share it, and most near copies."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))
    return F.array_min(runs)


def mine_entries(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool]], float, np.ndarray, float]:
    """Entries (text, is a word beginning) that mark label 1 in the training rows, strongest first, that label's share, the entries' log odds and the least of those that tell.

    All labelled training rows are counted, copies and near copies of toxic ones as one:
    words of a text that was copied often tell no more than those of one text. An entry needs ``LEAST_ROWS`` toxic rows,
    smoothed log odds of ``LEAST_LOG_ODDS``, and more toxic rows than chance gives:
    less than one entry of the table is expected to be there by chance. Entries all of whose
    toxic rows hold a stronger one add no row and are left out with their like (same
    first letters): they are mostly other words of those texts. A beginning in the same rows as a longer one is left out. No more than ``MAX_ENTRIES`` are taken.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known)
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return [], 0.5 / (1 + sum(sizes.values())), np.zeros(0), LEAST_LOG_ODDS
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    rows = docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id").select("toxic", words.alias("words"))
    rows = written(rows.select("toxic", _sketch("words").alias("sketch"), F.array_distinct(F.flatten(F.transform("words", lambda w: F.regexp_extract_all(w, F.lit(r"(\p{L}+)"), 1)))).alias("words")))
    stems = [_beginnings("words", k) for k in STEMS]
    every = F.array_union(F.array_distinct(F.concat(*stems)), F.filter("words", lambda w: F.length(w) >= 3))
    bad = rows.where("toxic = 1").select("sketch").distinct().count()
    good = rows.where("toxic = 0").count()
    prior = sizes[1] / (sizes[0] + sizes[1])
    if not bad or not good:
        return [], prior, np.zeros(0), LEAST_LOG_ODDS
    told = written(rows.where("toxic = 1").select("sketch", F.explode(every).alias("entry")).distinct().groupBy("entry").agg(F.count(F.lit(1)).alias("bad")).where(F.col("bad") >= LEAST_ROWS))
    clean = rows.where("toxic = 0").select(F.explode(every).alias("entry")).join(broadcast_if_small(told.select("entry")), "entry", "left_semi").groupBy("entry").agg(F.count(F.lit(1)).alias("good"))
    counts = told.join(clean, "entry", "left").select("entry", "bad", F.coalesce("good", F.lit(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    least, share = min(LEAST_LOG_ODDS, float(np.log(good + 1.0))), bad / (bad + good)
    both = F.col("bad") + F.col("good")
    # the chance of so many toxic rows of an entry that has nothing to do with the label is at most exp(-surprise)
    surprise = F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0.0)
    best = counts.withColumn("odds", odds).where((F.col("odds") >= least) & (surprise > float(np.log(max(told.count(), 1)))))
    top = best.orderBy((F.col("bad") * F.col("odds")).desc(), "entry").limit(MAX_ENTRIES).collect()
    ranked = docs.sparkSession.createDataFrame([(r.entry, i) for i, r in enumerate(top)], "entry string, rank int")
    first = rows.where("toxic = 1").select("sketch", F.explode(every).alias("entry")).join(broadcast_if_small(ranked), "entry").groupBy("sketch").agg(F.min("rank").alias("rank"))
    roots = {top[r.rank].entry.removeprefix("^")[: STEMS[0]] for r in first.select("rank").distinct().collect()}
    top = [r for r in top if r.entry.removeprefix("^")[: STEMS[0]] in roots]
    same = {(r.entry[:k], r.bad, r.good) for r in top if r.entry[0] == "^" for k in range(1, len(r.entry))}
    top = [r for r in top if r.entry[0] != "^" or (r.entry, r.bad, r.good) not in same]
    return [(r.entry.removeprefix("^"), r.entry.startswith("^")) for r in top], prior, np.array([r.odds for r in top]), max(least, float(np.log((1 - share) / share)))


class Finder:
    """Finds entries in lower-cased text: a word stands alone, a beginning starts a word."""

    def __init__(self, entries: list[tuple[str, bool]]):
        both: dict[str, list[int | None]] = {}
        for i, (text, stem) in enumerate(entries):
            both.setdefault(text, [None, None])[stem] = i
        self.machine = ahocorasick.Automaton()
        for text, ids in both.items():
            self.machine.add_word(text, (len(text), *ids))
        self.empty = not both
        if both:
            self.machine.make_automaton()

    def __call__(self, text: str | None) -> list[int]:
        if not text or self.empty:
            return []
        text = text.lower()
        found = set()
        for end, (size, word, stem) in self.machine.iter(text):
            if end < size or not text[end - size].isalpha():
                if stem is not None:
                    found.add(stem)
                if word is not None and not (end + 1 < len(text) and text[end + 1].isalpha()):
                    found.add(word)
        return sorted(found)


def voter_of(entries: list[tuple[str, bool]]) -> np.ndarray:
    """Voter of each entry: words and beginnings are dealt in turn, so each voter knows strong and weak ones."""
    out, dealt = np.zeros(len(entries), np.int64), [0, 0]
    for i, (_, stem) in enumerate(entries):
        out[i] = WORD_VOTERS + dealt[1] % STEM_VOTERS if stem else dealt[0] % WORD_VOTERS
        dealt[stem] += 1
    return out


def vote_moments(docs: DataFrame, entries: list[tuple[str, bool]]) -> tuple[int, np.ndarray]:
    """Number of documents and, for all pairs of voters, how many documents both vote on: counted over every document."""
    whole_texts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, voter = Finder(entries), voter_of(entries)
        total, n = np.zeros((VOTERS, VOTERS)), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                if found := find(text):
                    v = np.unique(voter[found])
                    total[np.ix_(v, v)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOTERS * VOTERS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(VOTERS * VOTERS + 1)
    for r in cells:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(VOTERS, VOTERS)


def fit_label_model(n: int, both: np.ndarray, prior: float) -> LabelModel:
    """Accuracies and correlations of the voters from their agreements alone.

    Voters that err independently have covariances c_i * c_j, so three of them tell
    each one's c. Pairs that agree more than that are correlated: they are left out
    of the triples, and the evidence of a voter is divided by the company it keeps.
    """
    p = min(max(prior, 1e-4), 0.5)
    mean = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    live = mean > 0
    tied = np.eye(VOTERS, dtype=bool) | ~np.outer(live, live)
    c = np.zeros(VOTERS)
    correlation = np.zeros((VOTERS, VOTERS))
    for _ in range(3):
        for i in np.flatnonzero(live):
            j, k = np.meshgrid(*[np.flatnonzero(~tied[i])] * 2)
            use = (j < k) & ~tied[j, k]
            j, k = j[use], k[use]
            sound = cov[j, k] > 1e-9
            values = cov[i, j[sound]] * cov[i, k[sound]] / cov[j[sound], k[sound]]
            c[i] = np.sqrt(max(float(np.median(values)), 0.0)) if len(values) else deviation[i] * 0.7
        c = np.minimum(c, deviation)
        left = np.sqrt(np.maximum(deviation**2 - c**2, 1e-9))
        correlation = np.clip((cov - np.outer(c, c)) / np.outer(left, left), -1, 1)
        np.fill_diagonal(correlation, 0)
        fresh = np.eye(VOTERS, dtype=bool) | ~np.outer(live, live) | (correlation > 0.5)
        if (~fresh).sum(axis=1).min(initial=VOTERS, where=live) < 3 or (fresh == tied).all():
            break
        tied = fresh
    hit = np.clip(mean + c * np.sqrt((1 - p) / p), 1e-4, 1 - 1e-4)
    false = np.clip(mean - c * np.sqrt(p / (1 - p)), 1e-4, 1 - 1e-4)
    weight = np.where(live & (hit > false), 1 / (1 + np.maximum(correlation, 0).sum(axis=1)), 0.0)
    return LabelModel(p, hit, false, weight, correlation)


def fit_classifier(found: list[list[int]], target: np.ndarray, odds: np.ndarray, bias: float) -> np.ndarray:
    """Logistic regression on entries against posterior labels, both classes weighing the same, by plain gradient steps.

    Weights begin at the entries' log odds and are drawn back to them, so an entry that
    hardly occurs in the rows given keeps what all labelled rows tell of it.
    """
    size = len(odds)
    if not found or not size or not 0 < target.sum() < len(target):
        return odds
    column = np.fromiter((i for f in found for i in f), np.int64)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    heavy = np.where(target > 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9))
    w, moment = odds.astype(np.float64), np.zeros(size)
    rate = 4.0 / max(1.0, float((heavy * (1 + np.bincount(row, minlength=len(found)))).sum()))
    for _ in range(600):
        gap = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(found)) + bias, -30, 30))) - target
        moment = 0.9 * moment + np.bincount(column, (heavy * gap)[row], size) + 1e-3 * (w - odds)
        w = w - rate * moment
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Mine entries, learn the label model from the votes on all documents, train the classifier on its posteriors.

    Labels are read from training rows only (see ``held_out``). All of them are mined
    and about ``FITTED_ROWS`` documents, none of them held out, train the classifier;
    vote counts cover every document.
    Without rows of both labels nothing is learned and every score is the same.
    """
    docs = docs.select("doc_id", "text")
    entries, prior, odds, least = mine_entries(docs, labels)
    if not entries:
        return Model([], LabelModel(prior, *[np.full(VOTERS, 0.5)] * 2, np.zeros(VOTERS), np.zeros((VOTERS, VOTERS))), np.zeros(0), -4.0)
    n, both = vote_moments(docs, entries)
    label_model = fit_label_model(n, both, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(entries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([find(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["found"])

    sample = docs.where(~held_out(F.col("doc_id"))).where(_share(F.col("doc_id"), FITTED_ROWS / max(n, 1)))
    found = [r.found for r in sample.select("text").mapInArrow(run, "found array<int>").collect()]
    voter = voter_of(entries)
    votes = np.zeros((len(found), VOTERS))
    for i, f in enumerate(found):
        votes[i, voter[f]] = 1
    return Model(entries, label_model, fit_classifier(found, label_model.posterior(votes), odds, -least), -least)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs``, whole rows, with the score of each whole text (0 to 1) in column ``name`` (one of that name is replaced).

    Only the text is looked at. Null and empty texts get the score of a text without
    entries; rows keep their number and order; an empty table stays empty.
    """
    whole_texts(docs.sparkSession)
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(shared.value.entries)
        for batch in batches:
            for part in slices(batch, "text"):
                values = [shared.value.score(find(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs``, whole rows, without those that score ``threshold`` or more."""
    scored = score(docs, fit(docs, labels), "__toxicity")
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")
