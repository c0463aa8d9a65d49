"""Toxicity scores from weak supervision.

1. Voters. On a bounded sample of labelled rows of the training fold, words and
   word beginnings that are frequent in toxic and rare in clean texts are mined.
   Whole words are lexicon voters: they vote if they occur. Beginnings are pattern
   voters: they vote if enough of a text's words share them. Further voters look at
   how dense such words are.
2. Label model. Expectation maximisation estimates every voter's rates of firing
   on toxic and clean texts, and the correlations of voters that remain given the
   label; correlated voters share their weight. It yields a posterior per text.
3. Classifier. A logistic regression on the voters' counts is fitted to the
   posteriors; its probability is the score.

Bounds: SAMPLE_ROWS labelled rows, CANDIDATES terms (those of the most toxic texts,
of which the voters are chosen) and MAX_VOTERS voters reach the driver, whatever the
input; all texts are scored whole.

Defined results: null and empty texts get the score of a text without any voter's
word; repeated rows and null ids are scored like any other; without labels there
are no voters and every score is 0. An id with several labels is toxic if one of
them says so, and so is a text that several labelled rows have; of several texts of
a labelled id the smallest is the one to learn from. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, claim, small_batches, training_fold, trim

#: Labelled rows used for fitting, about half of them toxic.
SAMPLE_ROWS = 12_000
MAX_VOTERS = 96
CANDIDATES = 100 * MAX_VOTERS
#: Evidence (nats of likelihood ratio against chance) that a voter needs at least ...
EVIDENCE = 16.0
#: ... and the share of the texts it fires on that are toxic.
PRECISION = 0.9
#: A beginning fires from this many words on, if they are this share of all words.
PATTERN_HITS, PATTERN_SHARE = 2, 0.005
BEGINNINGS = range(4, 9)
THRESHOLD = 0.7
FOLDS = 3


def plain_word(raw: bytes) -> str:
    """Lower case, without marks at its ends."""
    word = raw.decode("utf-8", "replace").lower()
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalnum():
        lo += 1
    while hi > lo and not word[hi - 1].isalnum():
        hi -= 1
    return word[lo:hi]


def _terms(text: bytes) -> list[str]:
    words = Counter(text.split())
    n = sum(words.values())
    terms: Counter = Counter()
    for raw, times in words.items():
        w = plain_word(raw)
        terms[f"={w}"] += times
        for k in BEGINNINGS:
            if len(w) <= k:
                break
            terms[f"^{w[:k]}"] += times
    return [t for t, c in terms.items() if t[0] == "=" or (c >= PATTERN_HITS and c >= PATTERN_SHARE * n)]


def evidence(p: int, n: int, share: float) -> float:
    """Log likelihood ratio of p toxic of p + n texts against the sample's share."""
    rate = p / (p + n)
    return p * math.log(rate / share) + (n * math.log((1 - rate) / (1 - share)) if n else 0.0)


@dataclass
class Model:
    """Voters by their word or beginning, and the classifier's weights."""

    words: dict[str, int] = field(default_factory=dict)
    beginnings: dict[str, int] = field(default_factory=dict)
    n: int = 0
    n_words: int = 0
    weights: np.ndarray | None = None
    rates: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def voter(self, word: str) -> int | None:
        found = self.words.get(word)
        if found is None:
            for k in BEGINNINGS:
                if len(word) < k:
                    break
                found = self.beginnings.get(word[:k])
                if found is not None:
                    break
        return found

    def counts(self, texts: Iterable[bytes], seen: dict[bytes, int | None]) -> np.ndarray:
        """Hits of every voter, zero where it doesn't fire; last, the number of words."""
        texts = list(texts)
        out = np.zeros((len(texts), self.n + 1))
        for row, text in zip(out, texts, strict=True):
            words = text.split()
            row[-1] = len(words)
            for w in set(words).difference(seen):
                if len(seen) > 300_000:
                    seen.clear()
                seen[w] = self.voter(plain_word(w))
            for w in words:
                v = seen[w] if w in seen else self.voter(plain_word(w))
                if v is not None:
                    row[v] += 1
        part = out[:, self.n_words : -1]
        part[(part < PATTERN_HITS) | (part < PATTERN_SHARE * out[:, -1:])] = 0
        return out

    def features(self, counts: np.ndarray) -> np.ndarray:
        hits, words = counts[:, :-1], counts[:, -1]
        total = hits.sum(axis=1)
        return np.column_stack(
            [np.ones(len(counts)), np.log1p(hits), np.log1p(total), total > 0, total > 1, 100 * total / np.maximum(words, 100)]
        )

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(counts))
        return 1 / (1 + np.exp(-np.clip(self.features(counts) @ self.weights, -30, 30)))


def choose_voters(
    rows: list[tuple[str, int, int]], share: float, most: int = MAX_VOTERS
) -> tuple[list[str], list[str]]:
    """Words and beginnings worth a vote, of ``(term, toxic texts, clean texts)``.

    The shortest beginning that is precise enough stands for all words with it; it
    is then made as long as it can be without losing texts.
    """
    found = {
        t: p for t, p, n in rows if p >= PRECISION * (p + n) and len(t) > 1 and evidence(p, n, share) >= EVIDENCE
    }
    words, beginnings = [], []
    for term, p in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        if term[0] != "^" or any(term[1:].startswith(b) or b.startswith(term[1:]) for b in beginnings):
            continue
        longest = max((t for t, q in found.items() if t[0] == "^" and t.startswith(term) and q >= 0.98 * p), key=len)
        if any(t[0] == "=" and t[1:].startswith(longest[1:]) and q >= 0.98 * p for t, q in found.items()):
            continue  # a single word, which the lexicon has
        beginnings.append(longest[1:])
    for term in sorted((t for t in found if t[0] == "="), key=lambda t: (-found[t], t)):
        if not any(term[1:].startswith(b) for b in beginnings):
            words.append(term[1:])
    beginnings = sorted(beginnings, key=lambda b: (-found["^" + b], b))[: most // 2]
    return words[: most - len(beginnings)], beginnings


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior per row, rates ``(2, voters)`` for clean and toxic, correlations.

    ``votes``: 0 or 1. ``start``: first guess of the posteriors.
    """
    post, weight = start.astype(float), np.ones(votes.shape[1])
    corr = np.eye(votes.shape[1])
    rates = np.zeros((2, votes.shape[1]))
    for step in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rates = np.stack(
            [(r @ votes + 0.01) / (r.sum() + 0.02) for r in (1 - post, post)]
        )
        # What is left between voters once the label is known.
        rest = votes - np.outer(1 - post, rates[0]) - np.outer(post, rates[1])
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        corr = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
        off = np.clip(corr - np.diag(np.diag(corr)), 0, 1)
        weight = 1 / (1 + np.where(off > 0.2, off, 0).sum(axis=1))
        yes = (np.log(rates[1]) - np.log(rates[0])) * weight
        no = (np.log1p(-np.clip(rates[1], 0, 1 - 1e-9)) - np.log1p(-np.clip(rates[0], 0, 1 - 1e-9))) * weight
        logit = math.log(prior / (1 - prior)) + votes @ yes + (1 - votes) @ no
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if step and np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, rates, corr


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Newton's method for soft labels."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """About ``rows`` labelled texts of the training fold, half of them toxic if there are so many."""
    gold = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training_fold("doc_id", FOLDS))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    have = {r["toxic"]: r["n"] for r in gold.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in have.items():
        share = F.when(F.col("toxic") == kind, F.lit(rows / 2 / n)).otherwise(share)
    picked = gold.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # SAMPLE_ROWS ids bound what is broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    found = rows.join(F.broadcast(picked), "doc_id")  # an id that many rows have is one labelled text
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS
) -> Model:
    sample = labelled_sample(docs, labels, id_col, text_col, rows)
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text").persist()  # copies are no further evidence

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, texts in blocks(batches):
            each = (Counter(), Counter())
            for mark, text in zip(marks, texts, strict=True):
                each[mark == 1].update(_terms(text))
            terms = sorted(each[0].keys() | each[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in (each[1], each[0])]],
                names=["term", "p", "n"],
            )

    terms = sample.mapInArrow(count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    good = terms.filter((F.col("p") >= 4) & (F.col("p") >= PRECISION * (F.col("p") + F.col("n"))))
    top = good.orderBy(F.desc("p"), "term").limit(CANDIDATES).collect()
    have = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(0.99, max(have.get(1, 0), 1) / max(sum(have.values()), 1))
    words, beginnings = choose_voters([(r["term"], r["p"], r["n"]) for r in top], share)
    model = Model(
        {w: i for i, w in enumerate(words)},
        {b: len(words) + i for i, b in enumerate(beginnings)},
        len(words) + len(beginnings),
        len(words),
    )
    if not model.n:
        sample.unpersist()
        return model

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int | None] = {}
        for marks, texts in blocks(batches):
            counts = model.counts(texts, seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.int64()), pa.array(list(counts), pa.list_(pa.float64()))], names=["toxic", "counts"]
            )

    found = sample.mapInArrow(vote, "toxic long, counts array<double>").collect()
    sample.unpersist()
    counts = np.array([r["counts"] for r in found])
    hits = counts[:, :-1]
    total = hits.sum(axis=1)
    dense = 100 * total / np.maximum(counts[:, -1], 1)
    votes = np.column_stack([hits > 0, total > 1, dense > 0.5, dense > 2]).astype(float)
    gold = np.array([float(r["toxic"] == 1) for r in found])
    post, model.rates, model.correlations = label_model(votes, 0.05 + 0.9 * gold)
    model.weights = fit_logistic(model.features(counts), post)
    return model


def score_column(model: Model, text: Column) -> Column:
    """The score of whole texts as a vectorised column."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        seen: dict[bytes, int | None] = {}
        for texts in batches:
            yield pd.Series(model.score(model.counts(texts, seen)), dtype="float64")
        trim()

    return run(F.coalesce(text.cast("binary"), F.lit(b"")))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
    return out.select(
        "doc_id",
        F.coalesce(~training_fold("doc_id", FOLDS), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    return docs.filter(score_column(model, F.col(text_col)) < THRESHOLD)
