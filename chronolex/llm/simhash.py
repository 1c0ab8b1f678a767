"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two fingerprints within `radius` bits
share a value within radius/2 bits of both, so every distinct fingerprint emits all such variants, variants are shuffled,
and fingerprints that meet are deduplicated, verified and linked. Fingerprints in one variant's ball differ from each other
by at most `radius` bits, so linking each to the next one in its ball loses no component, and a ball of half-radius 1 has
65 members at most, whatever the number of documents.

Defined results: null, empty and word-less texts have fingerprint zero and are linked like others. Copies are collapsed to
one fingerprint before any variant is made. Rows with one id are one document. A null id is no id: such rows are linked like
others and link others, but give no component its name, and a component of such rows only has a null one. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolex.llm.common import col, id_type, map_texts, stored, texts
from chronolex.llm.components import connected_components

SEED, BITS, CHUNK = 42, 64, 1 << 15


def shingle_bounds(words: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all shingles in the words joined by single spaces."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return starts[: len(words) - shingle + 1], ends[shingle - 1 :]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint. Shingles are cut and hashed in parts, so a very long text needs little more than its words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h64(line, SEED)
    starts, ends = shingle_bounds(words, shingle)
    del words
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([h64(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.nonzero(2 * total > len(starts))[0].tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def make():
        def f(rows):
            fps = (fingerprint(t, shingle) for t in rows["text"])
            return {"doc_id": rows["doc_id"], "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return f

    return map_texts(texts(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, fp long")


def ball_masks(radius: int) -> list[int]:
    """All 64-bit values with at most radius/2 bits, rounded up, as signed numbers."""
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct_fp: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in 1 to `radius` bits; enough of them to connect all that are linked.

    An odd radius rounds its ball up, so members of a ball may differ by radius + 1 bits. They are then linked through their
    verified pairs only, and neighbours in a ball do not suffice; only even radii are accepted.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius is 2 or 4")
    masks = F.array(*(F.lit(m).cast("long") for m in ball_masks(radius)))
    variants = distinct_fp.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    ball = W.partitionBy("variant").orderBy("fp")
    met = variants.withColumn("a", F.lag("fp").over(ball)).filter("a is not null").select("a", F.col("fp").alias("b"))
    return met.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most `radius` differing bits reach."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    comps = connected_components(links(least.select("fp"), radius))
    of = least.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    of = stored(of, "roots")
    # a third of all fingerprints may have one root: minima are pre-aggregated, and the join's long side can be split
    root_id = stored(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "root-ids")
    of = of.join(root_id, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(of, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_hashes(text: str | None, shingle: int) -> tuple[bytes, set[int]]:
    """The words in one line, and the distinct hashes of their shingles; fewer words are one shingle, none are none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return line, {h64(line, SEED)} if words else set()
    starts, ends = shingle_bounds(words, shingle)
    return line, {h64(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


#: Bands and minima in a band: texts of similarity 0.8 meet in a band with a chance of 0.9996, of 0.5 with one of 0.47.
BANDS, BAND_ROWS = 20, 5


def band_keys(hashes: set[int]) -> list[int]:
    """A signed 64-bit key for each band of minima of the shingle hashes; none without shingles."""
    if not hashes:
        return []
    h = np.fromiter(hashes, np.uint64, len(hashes))
    rng = np.random.default_rng(11)
    mul = rng.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * mul + add
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, x.min(axis=0))
    import xxhash

    keys = (xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS)))
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, same (digest of the words), fp and band keys."""

    def make():
        def f(rows):
            out = {"doc_id": rows["doc_id"], "same": [], "fp": [], "bands": []}
            for t in rows["text"]:
                line, hashes = shingle_hashes(t, shingle)
                x = fingerprint(t, shingle)
                out["same"].append(hashlib.md5(line, usedforsecurity=False).hexdigest())
                out["fp"].append(x - (1 << 64) if x >> 63 else x)
                out["bands"].append(band_keys(hashes))
            return out

        return f

    return map_texts(texts(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, same string, fp long, bands array<long>")


#: Pairs of one centre that are verified together; a centre with more is dealt out by a salt.
PAIRS_AT_ONCE = 500


def _starred(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of each row's doc_id with its key's centre, one doc_id chosen by a hash of key and doc_id; n: rows of the key.

    Choosing is pre-aggregated, pairs are linear in the rows and centres are written before the join, so that Spark can split
    a key that a third of all rows hold.
    """
    ranked = rows.withColumn("rank", F.struct(F.xxhash64(key, "doc_id").alias("h"), "doc_id"))
    centre = ranked.groupBy(key).agg(F.min("rank").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.col("c.doc_id").alias("b"), "n")
    return rows.join(stored(centre, "centres"), key).select(F.col("doc_id").alias("a"), "b", "n")


#: Rows of a bucket in one share; every two shares of a bucket are compared at once.
SHARE = 250
#: Shingles that are counted at once when shares are compared.
COLUMNS = 4096


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """key, i, j, doc_id and root: the rows of every two shares i and j of the keys whose rows are not all linked yet.

    Keys of two rows are settled by their centre, and of keys that the same rows hold one is enough.
    """
    rows = members.join(comps.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "doc_id")).alias(f"d{k}") for k in range(2)]
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *digest).filter("n > 2 and low <> high")
    found = found.groupBy("n", "d0", "d1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    own = rows.join(stored(found, "unsettled"), "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).filter("own <> other or shares = 1")
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "root")


def forest(ids: list, roots: list, sets: list[np.ndarray], least: float) -> list[tuple]:
    """Links (a, b) of similarity `least` or more, of all pairs; as few as connect what they connect across the roots."""
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    if len(number) < 2:
        return []
    label = np.array([number[r] for r in roots])
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row, often = np.repeat(np.arange(len(ids)), sizes), np.bincount(at) > 1
    row, at = row[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((len(ids), len(ids)))
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(at, (first, first + COLUMNS))
        x = np.zeros((len(ids), at[b - 1] - first + 1), np.float32)
        x[row[a:b], at[a:b] - first] = 1
        shared += x @ x.T
    a, b = np.nonzero(np.triu(shared >= least * (sizes[:, None] + sizes - shared), 1))
    out = []
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if len(a):
            out.append((ids[a[0]], ids[b[0]]))
            label[label == label[b[0]]] = label[a[0]]
    return out


def _more_links(unsettled: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) across the roots of unsettled rows. All pairs of two shares are verified in one task, which returns fewer
    links than it has rows; no pair is a row of Spark's."""
    kind = sets.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def links_of(ids, roots, hashes):
            found = forest(ids, roots, hashes, least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], id_arrow) for k in range(2)], names=["a", "b"])

        now, ids, roots, hashes, id_arrow = None, [], [], [], None
        for batch in batches:
            id_arrow = batch.column("doc_id").type
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True)
            ends = batch.column("hashes").offsets.to_numpy()
            flat = batch.column("hashes").values.to_numpy()
            for k, (key, i, r) in enumerate(zip(keys, batch.column("doc_id").to_pylist(), batch.column("root").to_pylist(), strict=True)):
                if key != now:
                    if ids:
                        yield links_of(ids, roots, hashes)
                    now, ids, roots, hashes = key, [], [], []
                ids.append(i)
                roots.append(r)
                hashes.append(flat[ends[k] : ends[k + 1]].copy())
        if ids:
            yield links_of(ids, roots, hashes)

    dealt = unsettled.join(sets, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """doc_id and group_id, the smallest doc_id that links of Jaccard similarity `least` or more on word shingles reach.

    Texts of equal words are collapsed first. Candidates are the fingerprints that meet in ball hashing and, since a pair of
    similarity 0.8 differs in about ten bits and rarely meets there, all pairs of texts with a common band of shingle minima.
    A bucket's texts are first verified against one centre, which settles a bucket that it links as a whole; in every other
    bucket all pairs are verified. Every candidate is verified on its whole shingle set. Ids must not be null; rows with one
    id are one document.
    """
    rows = stored(described(docs, id_col, text_col, shingle), "described")
    classes = stored(rows.groupBy("same").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = rows.join(classes.select("same", F.col("class_id").alias("doc_id")), ["same", "doc_id"], "left_semi")
    heads = stored(heads.select("doc_id", "fp", "bands"), "heads")
    centres = heads.groupBy("fp").agg(F.min("doc_id").alias("c"))
    balls = links(centres.select("fp"), radius)
    balls = balls.join(centres.select(F.col("fp").alias("a"), F.col("c").alias("ca")), "a").join(centres.select(F.col("fp").alias("b"), F.col("c").alias("cb")), "b")
    by_ball = balls.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.lit(1).cast("long").alias("n"))
    members = heads.select("doc_id", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("fp"), "fp")))).alias("key"))
    pairs = by_ball.union(_starred(members, "key")).filter("a <> b").groupBy("a", "b").agg(F.max("n").alias("n"))
    salts = F.ceil(F.col("n") / PAIRS_AT_ONCE).cast("int")
    pairs = stored(pairs.select("a", "b", salts.alias("salts")).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))), "candidates")
    # written, so that Spark knows its size before it decides whether whole texts have to be shuffled to it
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")

    def make():
        def f(rows):
            return {"doc_id": rows["doc_id"], "hashes": [[x - (1 << 64) if x >> 63 else x for x in shingle_hashes(t, shingle)[1]] for t in rows["text"]]}

        return f

    wanted = texts(docs, id_col, text_col).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stored(map_texts(wanted, make, f"doc_id {id_type(docs, id_col)}, hashes array<long>"), "shingles")
    # a document has few centres, but a centre may have very many documents: its set is sent once for each salt
    centres = pairs.select("b", "salts", "salt").distinct().join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(centres, ["b", "salts", "salt"])
    shared = F.size(F.array_intersect("x", "y"))
    linked = both.filter(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("a", "b")
    comps = stored(connected_components(linked), "first-groups")
    more = stored(_more_links(_unsettled(members, comps), sets, least), "more-links")
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    of = classes.join(comps, F.col("class_id") == F.col("node"), "left").select("same", F.coalesce("root", "class_id").alias("group_id"))
    return rows.select("doc_id", "same").join(of, "same").select("doc_id", "group_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of docs whose document is the smallest of its group; documents with a null id all stay."""
    found = similar_groups(docs.filter(col(id_col).isNotNull()), id_col, text_col, shingle, least, radius)
    drop = stored(found.filter("doc_id <> group_id").select(F.col("doc_id").alias("__drop_id")).distinct(), "dropped-ids")  # as above
    return docs.join(drop, col(id_col) == F.col("__drop_id"), "left_anti")
