"""Token-count rollups that are maintained by signed deltas.

A change is an insert (+1 document, +n tokens), a delete (-1, -n) or a revision (0, new - old). A batch's changes are summed
by source, language and tokenizer version and written to a folder of this attempt's own; a small file named after the batch,
renamed into place, says which attempt counts and is the commit. A batch that is committed already is left alone, and an
attempt that was cut short counts for nothing, so replays change nothing, nor do two writers of one batch.

compact() folds exactly the batches that it has listed into a snapshot, with their names beside it; a batch that commits
meanwhile is in none of them and stays open. Folded batches are put away when the next compaction begins, so what a commit
or a reader lists is bounded by the batches since then, and a reader has that long to finish. One compaction runs at a time.

Defined results: null sources, languages and versions are groups of their own; a null count counts 0 tokens; groups whose
documents and tokens are both zero are left out of the totals; no batches give no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.llm.common import col, id_type, map_texts
from chronolex.llm.tokens import FOLDER, rank_bpe, word_bpe

KEYS = ("source", "lang", "tokenizer")
DELTA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(x, T.LongType()) for x in ("docs", "tokens", "changes")])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_byte (byte-level vocabulary), n_word (word vocabulary) and text_key (a digest) of every whole text; null
    texts count as empty. `keep` columns, as strings, go along, so that nothing has to be joined to them."""

    def make():
        byte, word = rank_bpe(folder), word_bpe(folder)

        def f(rows):
            keys = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_byte": [byte.count(t) for t in rows["text"]], "n_word": [len(x) // 4 for x in word.encode(rows["text"])], "text_key": keys} | {f"keep_{k}": rows[f"keep_{k}"] for k in range(len(keep))}

        return f

    own = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"), *(col(c).cast("string").alias(f"keep_{k}") for k, c in enumerate(keep)))
    out = map_texts(own, make, f"doc_id {id_type(docs, id_col)}, n_byte long, n_word long, text_key string" + "".join(f", keep_{k} string" for k in range(len(keep))))
    return out.select("doc_id", "n_byte", "n_word", "text_key", *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)))


def signed(changes: DataFrame, op: Column, n: Column, old: Column) -> DataFrame:
    """Changes as summed deltas. op is insert, delete or revise; old is the count that a revision replaces."""
    n, old = F.coalesce(n, F.lit(0)).cast("long"), F.coalesce(old, F.lit(0)).cast("long")
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null")))))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    rows = changes.select(*(col(k).cast("string").alias(k) for k in KEYS), sign.cast("long").alias("docs"), tokens.alias("tokens"))
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("changes"))


class Rollup:
    """Additive totals in a folder that the driver and all executors share.

    data/<attempt> has a batch's deltas, open/<batch> and done/<batch> name the attempt of a committed batch that is not yet,
    or is, put away, snapshots/<n> has totals and folded/<n> the batches that went into them last.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.folder, *parts)))
        self.fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        top = self._path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(top) if s.getPath().getName()[0] not in "._") if self.fs.exists(top) else []

    def _write(self, text: str, *parts: str) -> None:
        """A small file that is there as a whole or not at all."""
        draft = self._path("drafts", uuid.uuid4().hex)
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self._path(*parts[:-1]))
        if not self.fs.rename(draft, self._path(*parts)):
            self.fs.delete(draft, False)

    def _read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(*parts))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _snapshot(self) -> str | None:
        """The last snapshot that is complete."""
        return next((n for n in reversed(self._names("snapshots")) if self.fs.exists(self._path("snapshots", n, "_SUCCESS"))), None)

    def _folded(self, snap: str | None) -> set[str]:
        return set(self._read("folded", snap).split()) if snap else set()

    def is_committed(self, batch: str) -> bool:
        return self.fs.exists(self._path("open", batch)) or self.fs.exists(self._path("done", batch))

    def commit(self, batch: str, changes: DataFrame, op: Column | None = None, n: Column | None = None, old: Column | None = None) -> bool:
        """Apply a batch once. False if it was committed before; its changes are then not even read."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.is_committed(batch):
            return False
        op, n, old = (F.col(d) if x is None else x for x, d in ((op, "op"), (n, "n_tokens"), (old, "old_tokens")))
        attempt = uuid.uuid4().hex
        signed(changes, op, n, old).write.parquet(f"{self.folder}/data/{attempt}")
        if not self.is_committed(batch):
            self._write(attempt, "open", batch)
        return self.fs.exists(self._path("open", batch)) and self._read("open", batch) == attempt

    def _sum(self, snap: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.folder}/data/{self._read('open', b)}" for b in batches] + ([f"{self.folder}/snapshots/{snap}"] if snap else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "changes")))

    def _open(self, snap: str | None) -> list[str]:
        """Committed batches that the snapshot does not hold."""
        folded = self._folded(snap)
        return [b for b in self._names("open") if b not in folded]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        snap = self._snapshot()
        return self._sum(snap, self._open(snap)).filter("docs <> 0 or tokens <> 0")

    def _put_away(self, snap: str | None) -> None:
        """Move what the last compaction folded out of the lists; a repeated call does the rest of a broken one."""
        self.fs.mkdirs(self._path("done"))
        for batch in sorted(self._folded(snap) & set(self._names("open"))):
            self.fs.delete(self._path("data", self._read("open", batch)), True)
            self.fs.rename(self._path("open", batch), self._path("done", batch))
        for old in self._names("snapshots"):
            if snap and old < snap:
                self.fs.delete(self._path("snapshots", old), True)
                self.fs.delete(self._path("folded", old), False)

    def compact(self) -> None:
        """Fold the committed batches into a snapshot; readers see either the old or the new one."""
        old = self._snapshot()
        self._put_away(old)
        now = self._open(old)
        name = f"{int(old) + 1 if old else 0:012d}"
        self.fs.delete(self._path("folded", name), False)
        self._write("\n".join(now), "folded", name)
        self._sum(old, now).filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/snapshots/{name}")
