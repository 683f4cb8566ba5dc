"""Toxicity by weak supervision.

Voters: a general insult lexicon, patterns, and a lexicon induced from the
labelled rows (words and word beginnings that toxic rows hold and others
hardly do). A generative label model, fitted by expectation-maximisation to
the votes alone and the labelled share of toxic rows, estimates each voter's
accuracy; voters that agree more than their accuracies explain are
correlated, and share their weight. Its posterior labels train a linear
classifier on the terms' and patterns' counts, which scores whole texts.

Only a bounded sample of labelled rows (``max_toxic``, ``max_clean``) and at
most ``max_terms`` terms are used to fit; every row is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, pieces, remainder, stored

# Common English insults.
INSULTS = ["idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "clown", "disgusting", "dumb", "imbecile", "fool", "garbage", "vermin", "coward", "filthy", "ugly", "jerk", "bastard", "crap", "hate"]
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "threat": re.compile(r"(?i)\b(?:i will|i'll|going to) (?:kill|hurt|destroy) you\b"),
    "address": re.compile(r"(?i)\byou(?: are|'re) (?:a|an|so|such)\b"),
    "bangs": re.compile(r"!{3,}"),
}
VOICES = [*PATTERNS, "shout"]
LOUD = re.compile(r"\b[A-Z]{4,}\b")
MARKS = re.compile(r"\b[A-Z]{4,}\b|!|\n|[a-z]+")
PREFIXES = (4, 5, 6, 7, 8)


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings as ``begin-``."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def shouts(text: str) -> bool:
    """Two words in capitals on a line, and then an exclamation mark before any small letter; in one pass."""
    if "!" not in text or sum(1 for _, _ in zip(LOUD.finditer(text), range(2))) < 2:
        return False
    on_line, armed = 0, False
    for m in MARKS.finditer(text):
        c = m[0][0]
        if c == "!":
            if armed:
                return True
        elif c == "\n":
            on_line = 0
        elif c >= "a":
            armed = False
        else:
            armed, on_line = armed or on_line > 0, on_line + 1
    return False


class Counts:
    """Counts of terms and patterns in a text: terms by index, then patterns, then the number of words."""

    def __init__(self, terms: list[str]):
        self.index, self.known = {t: i for i, t in enumerate(terms)}, {}
        self.size = len(terms)

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.size + len(VOICES) + 1, np.float32)
        words = Counter(WORD.findall((text or "").lower()))
        if len(self.known) > 300_000:
            self.known.clear()
        for w, n in words.items():
            at = self.known.get(w)
            if at is None:
                at = self.known[w] = tuple(i for t in terms_of(w) if (i := self.index.get(t)) is not None)
            if at:
                out[list(at)] += n
        for j, p in enumerate(PATTERNS.values()):
            out[self.size + j] = bool(text and p.search(text))
        out[self.size + len(PATTERNS)] = bool(text) and shouts(text)
        out[-1] = words.total()
        return out


def induce(sample: DataFrame, max_terms: int) -> list[str]:
    """Terms that 1.5 % of the toxic rows of the sample hold (four at least), and that are twenty times as common there as elsewhere."""

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches, 64):
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update({x for w in set(WORD.findall((t or "").lower())) if len(w) > 2 for x in terms_of(w)})
            terms = list(held[0] | held[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([held[y][x] for x in terms], pa.int64()) for y in (1, 0))], ["term", "a", "b"])

    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    one, none = sizes.get(1, 0), sizes.get(0, 0)
    held = sample.select("text", "y").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    lift = (F.col("a") / max(one, 1)) / ((F.col("b") + 0.5) / (none + 1))
    best = held.filter((F.col("a") >= max(4, 0.015 * one)) & (lift >= 20)).orderBy(F.desc("a"), "term").limit(max_terms).collect()
    return [r.term for r in best]


@dataclass
class LabelModel:
    """Log odds of toxic for each voter that speaks, and for a row where no lexicon voter does; a silent voter abstains."""

    prior: float
    speaks: np.ndarray
    silence: float
    lexicon: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + votes @ self.speaks + self.silence * ~votes[:, self.lexicon].any(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def label_model(votes: np.ndarray, lexicon: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """Accuracies by expectation-maximisation; correlations thin out the weights.

    votes: rows x voters, true where a voter says toxic; lexicon: which voters
    are of a lexicon. It starts from "a lexicon voter spoke" and keeps the
    labelled share of toxic rows as its prior.
    """
    weight = np.ones(votes.shape[1])
    quiet = ~votes[:, lexicon].any(1)
    y = np.where(quiet, 0.05, 0.9)
    model = None

    def odds(hits, y):
        """How much likelier a vote is in toxic rows, with the counts of half a vote added."""
        return np.log((hits * y).sum(0) + 0.5) - np.log(y.sum() + 1) - np.log((hits * (1 - y)).sum(0) + 0.5) + np.log((1 - y).sum() + 1)

    for t in range(rounds):
        model = LabelModel(prior, odds(votes, y[:, None]) * weight, float(odds(quiet, y)), lexicon)
        if t == 5 and votes.shape[1] > 1:
            # what two voters share beyond their accuracies, within the likely toxic rows
            dev = (votes - (votes * y[:, None]).sum(0) / (y.sum() + 1)) * np.sqrt(y)[:, None]
            cov = dev.T @ dev
            sd = np.sqrt(np.diag(cov)) + 1e-9
            excess = np.clip(cov / sd / sd[:, None], 0, 1)
            np.fill_diagonal(excess, 0)
            weight = 1 / (1 + np.where(excess > 0.3, excess, 0).sum(0))
        y = model.posterior(votes)
    return model


@dataclass
class Model:
    terms: list[str]
    w: np.ndarray
    bias: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shape(counts, len(self.terms)) @ self.w + self.bias, -50, 50)))


def shape(counts: np.ndarray, terms: int) -> np.ndarray:
    """Counts to features: presence; for all terms, whether one is there and their share of the words."""
    x = np.minimum(counts[:, :-1], 2).astype(np.float64)
    rate = counts[:, :terms].sum(1) / np.maximum(counts[:, -1], 1)
    return np.column_stack([x, np.minimum(1, 20 * rate), 4.0 * counts[:, :terms].any(1)])


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50)))
        g = x1.T @ (p - y) + penalty * w
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def sample_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_toxic: int, max_clean: int) -> tuple[DataFrame, float]:
    """(text, y) of a bounded set of labelled rows that may be learned from, chosen by hash, and the share of toxic rows."""
    known = labels.filter((remainder(key, 4) != 2) & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    known = stored(known.withColumn("h", F.xxhash64(F.lit(23), "k")), "labels")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    few = None
    for y, most in ((1, max_toxic), (0, max_clean)):
        chance = min(1.0, 1.3 * most / max(1, sizes.get(y, 0)))
        some = known.filter((F.col("y") == y) & (F.col("h").cast("double") <= -(2.0**63) + chance * 2.0**64)).orderBy("h", "k").limit(most)
        few = some if few is None else few.unionByName(some)
    few = stored(few.select("k", "y"), "few")  # at most max_toxic + max_clean rows
    rows = docs.join(F.broadcast(few), F.col(f"`{key}`") == F.col("k")).select(F.col(f"`{text}`").alias("text"), "y")
    total = sum(sizes.values())
    return stored(rows, "sample"), (sizes.get(1, 0) + 0.5) / (total + 1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          max_toxic: int = 2000, max_clean: int = 4000, max_terms: int = 400) -> Model:
    """Without any labelled row, only the general lexicon and the patterns vote."""
    sample, prior = sample_rows(docs, labels, key, text, label, max_toxic, max_clean)
    terms = list(dict.fromkeys([*INSULTS, *induce(sample, max_terms)]))

    def run(batches):
        import pyarrow as pa

        counts = Counts(terms)
        for batch in pieces(batches):
            rows = [counts(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["c", "y"])

    got = sorted((bytes(r.c), r.y) for r in sample.mapInArrow(run, "c binary, y int").collect())
    size = len(terms) + len(VOICES)
    counts = np.frombuffer(b"".join(c for c, _ in got), np.float32).reshape(-1, size + 1) if got else np.zeros((0, size + 1), np.float32)
    if not len(counts):
        w = np.r_[np.full(len(INSULTS), 2.0), np.full(len(terms) - len(INSULTS), 2.0), np.full(len(VOICES), 0.1), 1.0, 1.0]
        return Model(terms, w, -3.0)
    share = float(np.clip(np.mean([y for _, y in got]), 0.02, 0.98))
    votes = counts[:, :-1] > 0
    # patterns that clean rows hold as often as toxic ones say nothing; the model finds that from agreement with the lexicon
    lexicon = np.arange(votes.shape[1]) < len(terms)
    posterior = label_model(votes, lexicon, share).posterior(votes)
    w, bias = linear(shape(counts, len(terms)), posterior)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))  # the sample holds more toxic rows than the table
    return Model(terms, w, bias + 0.5 * float(shift))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) appended; null and empty texts get the score of a text without any term.

    An input column called score is replaced. Very long texts are read whole,
    repeated rows score alike, an empty table gives no rows.
    """
    from pyspark.sql import types as T

    docs = free_names(docs, "score")
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        counts = Counts(shared.value.terms)
        for batch in pieces(batches):
            rows = [counts(t) for t in batch.column(at).to_pylist()]
            s = shared.value.score(np.stack(rows)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
