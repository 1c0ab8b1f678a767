"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of each benchmark item; an item with fewer words is one shorter pattern.
Patterns of one length share a matcher: a table of word blocks gives how far the search may jump, blocks that end a pattern
select a bucket by their hash, and the words are then compared directly. Words inside any occurrence are hit.

A benchmark of at most `block_bytes` of text is broadcast with its patterns, and documents are not shuffled. Of a larger one
only the jump tables, whose size is fixed, are broadcast: a place that they do not skip is sent to its bucket by the hash of
its words and compared there, so documents are still searched once, whatever the benchmark's size.

Defined results: null and empty texts have no words and no hits; items without words or ids have no patterns; copies of an
item's id count once; an empty benchmark hits nothing; rows with one id, or none, are judged each by its own text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import col, id_type, map_texts, prepare, stored

WINDOW, BLOCK_BYTES = 13, 1 << 20
#: Entries of a broadcast jump table (a byte each, one table for each pattern length) and words that choose an entry.
SLOTS, SPREAD_BLOCK = 1 << 22, 4
#: ASCII characters but digits and letters end a word; A-Z become a-z; all else stays.
TABLE = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.translate(TABLE).split() if text else []


class WuManber:
    """Finds patterns of m word numbers each; `block` words decide a jump."""

    def __init__(self, patterns: Iterable[tuple[int, ...]], m: int, block: int = 2):
        self.patterns = list(patterns)
        self.m, self.b = m, min(block, m)
        self.far = m - self.b + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for end in range(self.b, m + 1):
                key = hash(p[end - self.b : end])
                jump = m - end
                if self.shift.get(key, self.far) > jump:
                    self.shift[key] = jump
                if not jump:
                    self.bucket.setdefault(key, []).append((p[0], k))

    def search(self, words: list[int]) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence; number 0 is a word that no pattern has."""
        m, b, far, shift, n = self.m, self.b, self.far, self.shift, len(words)
        out, at = [], m - 1
        while at < n:
            if not words[at]:
                at += m
                continue
            key = hash(tuple(words[at - b + 1 : at + 1]))
            jump = shift.get(key, far)
            if jump:
                at += jump
                continue
            start = at - m + 1
            head = words[start]
            for first, k in self.bucket[key]:
                if first == head and tuple(words[start : at + 1]) == self.patterns[k]:
                    out.append((start, k))
            at += 1
        return out


class Benchmark:
    """The matchers of some items: (item id as text, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(ids[k : k + size], set()).add(item)
        self.matchers = [(size, WuManber(p, size), [sorted(x) for x in p.values()]) for size, p in sorted(by_size.items())]

    def hits(self, text: bytes | str | None) -> tuple[int, list[int], set[str], bool]:
        """Number of words, ends of merged hit stretches (start, end, start, end, ...), ids of items that occur, and whether
        any of the occurrences is a whole window."""
        words = words_of(text)
        ids = list(map(self.number.get, words, [0] * len(words)))
        spans, items, whole = [], set(), False
        for size, matcher, of in self.matchers:
            for start, k in matcher.search(ids):
                spans.append((start, start + size))
                items.update(of[k])
                whole |= size == self.window
        return len(words), merged(spans), items, whole


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def n_hit(spans: list[int]) -> int:
    return sum(spans[1::2]) - sum(spans[::2])


def contaminated(hit: int, n: int) -> bool:
    """A twentieth of the words or more are hit."""
    return hit > 0 and 20 * hit >= n


def leaked(hit: int, n: int, whole: bool) -> bool:
    """A text that is not fit for training: it holds a whole window, or short items make up a twentieth of it."""
    return whole or contaminated(hit, n)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(col(item_col).cast("string").alias("item"), col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")


def _small(items: DataFrame, block_bytes: int) -> list[tuple[str, str]] | None:
    """The items, if their texts have block_bytes at most in sum; else nothing is collected."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return [tuple(r) for r in items.toLocalIterator()] if size <= block_bytes else None


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    return _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes).drop("text_key", "leaked")


RESULT = "text_key string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, leaked boolean"


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """The columns of search; text_key, the digest of the text; and leaked."""
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").cast("binary").alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    few = _small(items, block_bytes)
    if few is None:
        return _spread(own, items, window)
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(few, window))

    def make():
        bench = shared.value

        def f(rows):
            out = [(n, n_hit(spans), found, whole) for n, spans, found, whole in map(bench.hits, rows["text"])]
            keys = [hashlib.md5(t or b"", usedforsecurity=False).hexdigest() for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "text_key": keys, "n_words": [n for n, *_ in out], "n_hit": [h for _, h, *_ in out], "n_items": [len(x) for _, _, x, _ in out], "items_sha256": [digest(x) for _, _, x, _ in out], "contaminated": [contaminated(h, n) for n, h, *_ in out], "leaked": [leaked(h, n, w) for n, h, _, w in out]}

        return f

    return map_texts(own, make, f"doc_id {id_type(docs, id_col)}, {RESULT}")


def block_slot(words: list[bytes], end: int, block: int, slots: int) -> int:
    """The table entry of the block of words before `end`."""
    return zlib.crc32(b" ".join(words[end - block : end])) % slots


def jump_tables(items: DataFrame, window: int, slots: int = SLOTS) -> dict[int, np.ndarray]:
    """For each pattern length a byte for each entry: how far a search may jump from a place whose block has that entry.

    Jumps are pre-aggregated by entry, so what reaches the driver is bounded by slots * window, not by the benchmark.
    """

    def make():
        def f(rows):
            least: dict[tuple[int, int], int] = {}
            for w in map(words_of, rows["text"]):
                m = min(window, len(w))
                b = min(SPREAD_BLOCK, m)
                for end in range(b, len(w) + 1) if m else ():
                    key = (m, block_slot(w, end, b, slots))
                    least[key] = min(least.get(key, window), max(0, m - end))
            return {"size": [m for m, _ in least], "slot": [s for _, s in least], "jump": list(least.values())}

        return f

    found = map_texts(items, make, "size int, slot int, jump int").groupBy("size", "slot").agg(F.min("jump").alias("jump")).toPandas()
    out = {}
    for m, rows in found.groupby("size"):
        out[int(m)] = np.full(slots, m - min(SPREAD_BLOCK, m) + 1, np.uint8)
        out[int(m)][rows["slot"].to_numpy()] = rows["jump"].to_numpy()
    return out


def unskipped(words: list[bytes], table: np.ndarray, m: int) -> Iterator[int]:
    """Starts of the windows of m words that the table does not skip."""
    b, slots, at, n = min(SPREAD_BLOCK, m), len(table), m, len(words)
    while at <= n:
        jump = table[block_slot(words, at, b, slots)]
        if not jump:
            yield at - m
        at += int(jump) or 1


def _spread(own: DataFrame, items: DataFrame, window: int, slots: int = SLOTS) -> DataFrame:
    """The same for a benchmark of any size: what the tables do not skip meets the patterns of its bucket in a join."""
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    shared = own.sparkSession.sparkContext.broadcast(jump_tables(items, window, slots))
    kind = own.schema["doc_id"].dataType.simpleString()

    def make_patterns():
        def f(rows):
            out = {(w[k : k + m], item) for item, w in zip(rows["item"], map(tuple, map(words_of, rows["text"])), strict=True) for m in (min(window, len(w)),) if m for k in range(len(w) - m + 1)}
            out = [(b" ".join(p), item) for p, item in out]
            return {"bucket": [signed(xxh64_intdigest(p)) for p, _ in out], "pattern": [p for p, _ in out], "item": [i for _, i in out]}

        return f

    def make_places():
        tables = shared.value

        def f(rows):
            out = {"doc_id": rows["doc_id"], "text_key": [], "n_words": [], "places": []}
            for t in rows["text"]:
                w = words_of(t)
                places = [(m, s, b" ".join(w[s : s + m])) for m, table in tables.items() for s in unskipped(w, table, m)]
                out["text_key"].append(hashlib.md5(t or b"", usedforsecurity=False).hexdigest())
                out["n_words"].append(len(w))
                out["places"].append([{"bucket": signed(xxh64_intdigest(p)), "size": m, "start": s, "words": p} for m, s, p in places])
            return out

        return f

    patterns = stored(map_texts(items, make_patterns, "bucket long, pattern binary, item string").distinct(), "patterns")
    rows = stored(map_texts(own, make_places, f"doc_id {kind}, text_key string, n_words long, places array<struct<bucket:long,size:int,start:int,words:binary>>"), "places")
    key = ["doc_id", "text_key"]
    at = rows.filter(F.size("places") > 0).dropDuplicates(key).select(*key, F.explode("places").alias("p")).select(*key, "p.*")
    same = [at["bucket"] == patterns["bucket"], at["words"] == patterns["pattern"]]
    met = stored(at.join(patterns, same).select(*key, "size", "start", "item"), "occurrences")
    spans = met.groupBy(*key).agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("item").alias("items"), F.max(F.col("size") == window).alias("whole"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans", "items", "whole")
    both = rows.drop("places").join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").drop("__id", "__key")

    def make():
        def f(rows):
            hit = [n_hit(merged((x["start"], x["start"] + x["size"]) for x in s or ())) for s in rows["spans"]]
            items = [x or () for x in rows["items"]]
            both = list(zip(hit, rows["n_words"], strict=True))
            return {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "n_words": rows["n_words"], "n_hit": hit, "n_items": list(map(len, items)), "items_sha256": list(map(digest, items)), "contaminated": [contaminated(h, n) for h, n in both], "leaked": [leaked(h, n, bool(w)) for (h, n), w in zip(both, rows["whole"], strict=True)]}

        return f

    return map_texts(both, make, f"doc_id {kind}, {RESULT}", size=1000)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without benchmark passages, with all their columns.

    A row goes if its text holds a whole window of the benchmark, however long the text; items shorter than a window may be
    everyday phrases and count only where they make up a twentieth of the text. Rows are filtered where they are read; only
    for a benchmark beyond block_bytes are they joined with what was found.
    """
    items = _items(benchmark, item_col, item_text_col)
    few = _small(items, block_bytes)
    if few is None:
        bad = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes).filter("leaked").select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
        own_key: Column = F.md5(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"))
        return docs.join(bad, col(id_col).eqNullSafe(F.col("__bad_id")) & (own_key == F.col("__bad_key")), "left_anti")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(few, window))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bench = shared.value
        for b in batches:
            yield pd.Series([not leaked(n_hit(spans), n, whole) for n, spans, _, whole in map(bench.hits, b)], dtype=bool)

    return docs.filter(clean(col(text_col).cast("string")))
