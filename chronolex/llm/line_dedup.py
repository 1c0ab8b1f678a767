"""Removal of repeated passages by overlapping three-line windows.

Lines are the pieces between line feeds; a window is three consecutive lines that are not blank, compared without the
white space around each line. Windows are hashed to 128 bits; a window that occurs more than once anywhere keeps its first
occurrence (smallest id, then text digest, then position), and the lines of every later occurrence are covered. Covered positions are merged
and removed, each with the blank lines that follow it.

Defined results: a null text stays null, a text of fewer than three lines that are not blank stays as it is. Rows with one
id and one text count as one occurrence, so repeated rows of a document all keep what the first keeps; rows with one id and
different texts are different documents. A null id is an id like any other and sorts first. Every distinct line that was there before is still somewhere afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import col, id_type, map_texts, prepare, stored, texts

WINDOW = 3
SPACE = " \t\r\x0b\x0c"


def window_hashes(text: str | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """For each window its hash as two signed 64-bit numbers; the place in the list is the place of its first line."""
    if not text:
        return []
    digests = [hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for line in text.split("\n") if (x := line.strip(SPACE))]
    out = []
    for k in range(len(digests) - window + 1):
        d = hashlib.md5(b"".join(digests[k : k + window]), usedforsecurity=False).digest()
        out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
    return out


#: A row's key besides its id: 128 bits of its text.
DIGEST = ("d0", "d1")


def digests(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), text) for k in range(len(DIGEST))]


def occurrences(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """A row for each window: h1, h2, doc_id, d0, d1 (digest of the text), place."""

    def make():
        def f(rows):
            own = zip(rows["doc_id"], *(rows[d] for d in DIGEST), rows["text"], strict=True)
            out = [(h[0], h[1], i, d0, d1, k) for i, d0, d1, t in own for k, h in enumerate(window_hashes(t, window))]
            return dict(zip(("h1", "h2", "doc_id", *DIGEST, "place"), zip(*out, strict=True) if out else ((),) * 6, strict=True))

        return f

    keyed = texts(docs, id_col, text_col).select("doc_id", *(d.alias(n) for d, n in zip(digests(F.col("text")), DIGEST, strict=True)), "text")
    return map_texts(keyed, make, f"h1 long, h2 long, doc_id {id_type(docs, id_col)}, d0 long, d1 long, place int")


def without(text: str | None, places: list[int] | None, window: int = WINDOW) -> str | None:
    """The text without the windows that begin at these places among its lines that are not blank."""
    if text is None or places is None or not len(places):
        return text
    covered = {p + k for p in places for k in range(window)}
    kept, n = [], -1
    for line in text.split("\n"):
        n += bool(line.strip(SPACE))
        if n not in covered:
            kept.append(line)
    return "\n".join(kept)


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, d0, d1 and the places of the text's windows that occur earlier: one row for each document that has any.

    Counting is pre-aggregated, so a window that a third of all documents hold costs one row a task. The join back is on the
    window's hash with the repeated windows only; a frequent window makes one side of it long, which AQE can split.
    """
    at = occurrences(docs, id_col, text_col, window)
    first = at.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", *DIGEST, "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = at.join(stored(first, "repeated-windows"), ["h1", "h2"]).filter(~F.struct("doc_id", *DIGEST, "place").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", *DIGEST).agg(F.collect_set("place").alias("places"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """docs with text_col without repeated passages; all other columns as they were.

    removed_col, if named, is added with the number of windows that were removed.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, places in batches:
            yield pd.Series([without(t, p, window) for t, p in zip(text, places, strict=True)], dtype=object)

    later = later_windows(docs, id_col, text_col, window).select(F.col("doc_id").alias("__later_id"), *(F.col(d).alias(f"__later_{d}") for d in DIGEST), F.col("places").alias("__later_places"))
    same = [d == F.col(f"__later_{n}") for d, n in zip(digests(col(text_col).cast("string")), DIGEST, strict=True)]
    both = docs.join(later, [col(id_col).eqNullSafe(F.col("__later_id")), *same], "left")
    new: Column = F.when(F.col("__later_places").isNull(), col(text_col)).otherwise(cut(col(text_col).cast("string"), F.col("__later_places")))
    out = [new.alias(c) if c == text_col else col(c) for c in docs.columns]
    if removed_col:
        out.append(F.coalesce(F.size("__later_places"), F.lit(0)).cast("long").alias(removed_col))
    return both.select(*out)
