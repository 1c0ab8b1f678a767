"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and their beginnings of 3 to 6 letters, hashed into buckets. A second-order
factorization machine learns a weight for each bucket and, through factors, one for each pair of buckets, such as an insult
together with a mention of a group, which no additive weight can express.

The fit reads a bounded sample of labelled rows on the driver; buckets that tell the labels apart (chi-square) take part.
Scores read the text only, and the whole of it. Defined results: null and empty texts have no terms and get the score of the
bias; without labels of both kinds every score is the share of toxic labels, 0 if there are none; rows are independent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import bounded_sample, col, id_type, map_texts
from chronolex.llm.langid import remainder

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, PREFIXES = 1 << 20, (3, 4, 5, 6)
#: Bound of the fit: labelled rows. They bound the buckets that take part.
SAMPLE_ROWS, FACTORS = 8000, 6
#: A bucket takes part if it is in so many labelled rows and tells the labels apart by so much (chi-square).
LEAST_ROWS, LEAST_CHI2 = 5, 20.0
MEMORY = 300_000


def buckets(word: str) -> set[int]:
    return {zlib.crc32(b"w" + word.encode()) % BUCKETS} | {zlib.crc32(b"p" + word[:k].encode()) % BUCKETS for k in PREFIXES if len(word) >= k}


def terms(text: str | None) -> set[int]:
    """Distinct buckets of a text."""
    found: set[int] = set()
    for w in set(WORD.findall(text.lower())) if text else ():
        found |= buckets(w)
    return found


class Machine:
    """y = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, with x_i 1 for a bucket that is there."""

    def __init__(self, feature_of: dict[int, int], w0: float, w: np.ndarray, v: np.ndarray):
        self.feature_of, self.w0, self.w, self.v = feature_of, w0, w, v

    def score(self, features: list[int]) -> float:
        y = self.w0
        if features:
            v = self.v[features]
            s = v.sum(axis=0)
            y += float(self.w[features].sum() + 0.5 * (s @ s - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(y, -60, 60))))

    def scorer(self):
        """A function of a text; it remembers a bounded number of words."""
        known: dict[str, tuple[int, ...]] = {}
        of = self.feature_of

        def score(text: str | None) -> float:
            if len(known) > MEMORY:
                known.clear()
            found: set[int] = set()
            for w in set(WORD.findall(text.lower())) if text else ():
                t = known.get(w)
                if t is None:
                    t = known[w] = tuple(of[b] for b in buckets(w) if b in of)
                if t:
                    found.update(t)
            return self.score(sorted(found))

        return score


def train(rows: list[tuple[int, list[int]]], factors: int = FACTORS, steps: int = 200, l2: float = 2e-4, l2_pairs: float = 4e-3, rate: float = 0.05, least_chi2: float = LEAST_CHI2, least_rows: int = LEAST_ROWS, pairs: bool = True) -> Machine:
    """Fit on (label, buckets) rows, in a fixed order and from a fixed seed. pairs=False leaves out the interactions."""
    y = np.array([r[0] for r in rows], np.float64)
    n, n1 = len(y), float(y.sum())
    share = n1 / n if n else 0.0
    if not 0 < n1 < n:
        return Machine({}, 60.0 if share else -60.0, np.zeros(0), np.zeros((0, factors)))
    hits, toxic = Counter(), Counter()
    for label, b in rows:
        hits.update(b)
        if label:
            toxic.update(b)

    def chi2(k: int) -> float:
        a, h = toxic[k], hits[k]
        d = h * (n - h) * n1 * (n - n1)
        return n * (a * (n - n1) - (h - a) * n1) ** 2 / d if d else 0.0

    scored = sorted(((-chi2(k), k) for k, h in hits.items() if h >= least_rows))
    chosen = [k for c, k in scored if -c >= least_chi2]
    of = {k: i for i, k in enumerate(chosen)}
    x = np.zeros((n, len(of)), np.float32)
    for r, (_, b) in enumerate(rows):
        x[r, [of[k] for k in b if k in of]] = 1
    rng = np.random.default_rng(7)
    w0, w, v = np.log(share / (1 - share)), np.zeros(len(of)), rng.normal(0, 0.05, (len(of), factors)) * pairs
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    moments = [np.zeros(1), np.zeros(1), np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for step in range(1, steps + 1):
        s = x @ v.astype(np.float32)
        z = w0 + x @ w.astype(np.float32) + 0.5 * ((s * s).sum(axis=1) - x @ (v * v).sum(axis=1).astype(np.float32))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        gx = x.T @ g.astype(np.float32)
        gv = (x.T @ (g[:, None] * s).astype(np.float32) - v * gx[:, None]) * pairs + l2_pairs * v
        for k, (p, d) in enumerate(((None, np.array([g.sum()])), (w, gx + l2 * w), (v, gv))):
            m, q = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * d
            q *= 0.999
            q += 0.001 * d * d
            delta = rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
            if p is None:
                w0 -= float(delta[0])
            else:
                p -= delta
    return Machine(of, float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learn from about sample_rows of the labelled rows. Rows with a null label or id are not learned from; a document with
    two labels is toxic if either says so."""
    known = labels.select(col(id_col).alias("doc_id"), col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = bounded_sample(known, F.col("doc_id").cast("string"), sample_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # bounded by sample_rows

    def make():
        def f(rows):
            return {"doc_id": rows["doc_id"], "label": rows["label"], "buckets": [sorted(terms(t)) for t in rows["text"]]}

        return f

    found = map_texts(rows.select("doc_id", "label", "text"), make, f"doc_id {id_type(docs, id_col)}, label int, buckets array<int>")
    got = sorted((r["doc_id"], r["label"], r["buckets"]) for r in found.toLocalIterator())
    return train([(int(x > 0), b) for _, x, b in got])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row of docs. The machine's size is bounded by its parameters, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        one = shared.value.scorer()

        def f(rows):
            return {"doc_id": rows["doc_id"], "score": [one(t) for t in rows["text"]]}

        return f

    return map_texts(docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), make, f"doc_id {id_type(docs, id_col)}, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels whose crc32(doc_id) has another remainder than `held`."""
    machine = fit(docs, labels.filter(remainder(F.col("doc_id"), folds) != held))
    out = score(docs, machine)
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
