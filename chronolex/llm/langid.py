"""Language identification by known words first, then progressively shorter character n-grams.

A word that was seen in training adds its log frequency in each language. An unseen word is looked up by its character
n-grams (with word ends marked), the longest size first; the first size of which any n-gram is known adds the mean of those.
The model is fitted on a bounded sample of labelled rows, of which it keeps every word and every n-gram; predictions read the
text only, and the whole of it.

Defined results: `und` with score 0 for a null text, a text without letters, or if nothing was learned. A text of which
nothing is known gets the most frequent language. Ties go to the language that sorts first. Rows without a label or an id
are not learned from; a null id counts as held out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import bounded_sample, col, id_type, map_texts, prepare

WORD = re.compile(r"[^\W\d_]+")
SIZES = (5, 4, 3, 2, 1)
#: Bound of the fit: labelled rows. They bound the words and n-grams that are learned.
SAMPLE_ROWS = 6000
#: Unseen words that a predictor remembers; no result depends on it.
MEMORY = 80_000


def remainder(id_col: Column, m: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m))


def grams(word: str, n: int) -> list[str]:
    s = f"<{word}>" if n > 1 else word
    return [s[k : k + n] for k in range(len(s) - n + 1)]


class Model:
    def __init__(self, counts: dict[str, dict[str, int]], docs: dict[str, int]):
        """counts: word counts by language; docs: rows by language."""
        self.langs = sorted(counts)
        at = {lang: k for k, lang in enumerate(self.langs)}
        width = len(self.langs)
        rows = sum(docs.values()) or 1
        self.prior = np.log(np.array([docs.get(x, 0) + 0.5 for x in self.langs]) / (rows + 0.5 * width)) if width else np.zeros(0)
        table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(width))
        for lang, words in counts.items():
            for w, n in words.items():
                table[w][at[lang]] += n
        self.words = self._logs(table)
        self.grams = {}
        for size in SIZES:
            found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(width))
            for w, v in table.items():
                for g in grams(w, size):
                    found[g] += v
            self.grams[size] = self._logs(found)

    @staticmethod
    def _logs(table: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        m = np.array(list(table.values())) if table else np.zeros((0, 0))
        if len(table):
            m = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(table)))
        return {k: i for i, k in enumerate(table)}, m.astype(np.float32)

    def backoff(self, word: str) -> np.ndarray:
        for size in SIZES:
            rows, m = self.grams[size]
            known = [rows[g] for g in grams(word, size) if g in rows]
            if known:
                return m[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predictor(self):
        """A function of a text; it remembers a bounded number of unseen words."""
        rows, m = self.words
        known = dict(rows)
        table = np.concatenate([m, np.zeros((MEMORY, max(1, m.shape[1])), np.float32)]) if len(rows) else np.zeros((MEMORY, max(1, len(self.langs))), np.float32)
        base = len(rows)

        def predict(text: str | None) -> tuple[str, float]:
            nonlocal known
            counts = Counter(WORD.findall(text.lower())) if text else None
            if not counts or not self.langs or not any(c.isalpha() for w in counts for c in w):
                return "und", 0.0
            total, n = np.zeros(len(self.langs)), 0
            items = list(counts.items())
            for at in range(0, len(items), MEMORY):
                part = items[at : at + MEMORY]
                new = [w for w, _ in part if w not in known]
                if len(known) + len(new) > base + MEMORY:
                    known = dict(rows)
                    new = [w for w, _ in part if w not in known]
                for w in new:
                    known[w] = len(known)
                    table[known[w]] = self.backoff(w)
                weights = np.array([c for _, c in part], np.float64)
                total += weights @ table[[known[w] for w, _ in part]]
                n += int(weights.sum())
            x = total * min(1.0, 30 / n) + self.prior
            p = np.exp(x - x.max())
            best = int(np.argmax(x))
            return self.langs[best], float(p[best] / p.sum())

        return predict


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn every word of about sample_rows of the labelled rows given."""
    labelled = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang")).filter("lang is not null and doc_id is not null")
    some = bounded_sample(labelled, F.col("doc_id").cast("string"), sample_rows)

    def make():
        def f(rows):
            counts: dict[str, Counter] = defaultdict(Counter)
            n = Counter()
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                n[lang] += 1
                if text:
                    counts[lang].update(WORD.findall(text.lower()))
            out = [(lang, w, c) for lang, words in counts.items() for w, c in words.items()] + [(lang, None, c) for lang, c in n.items()]
            return dict(zip(("lang", "word", "n"), zip(*out, strict=True) if out else ((),) * 3, strict=True))

        return f

    sums = map_texts(some.select("lang", "text"), make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    rows: dict[str, int] = {}
    for r in sums.toLocalIterator():
        if r["word"] is None:
            rows[r["lang"]] = r["n"]
            counts[r["lang"]] = counts[r["lang"]]
        else:
            counts[r["lang"]][r["word"]] = r["n"]
    return Model({k: dict(sorted(v.items())) for k, v in sorted(counts.items())}, rows)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs. The model's size is bounded by its parameters, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = shared.value.predictor()

        def f(rows):
            out = [one(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "lang_pred": [x for x, _ in out], "score": [s for _, s in out]}

        return f

    return map_texts(docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), make, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double")


def held_out_predictions(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents whose crc32(doc_id) is no multiple of `folds`."""
    model = fit(docs.filter(remainder(F.col("doc_id"), folds) != 0))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """The rows of docs whose language is identified with at least this score; all columns as they were."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(remainder(col(id_col), folds) != 0), id_col, text_col, lang_col))

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.predictor()
        for b in batches:
            yield pd.Series([lang != "und" and score >= least_score for lang, score in map(one, b)], dtype=bool)

    return docs.filter(good(col(text_col).cast("string")))
