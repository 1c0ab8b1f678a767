import random
import re
from collections import Counter
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from chronolex.llm import simhash
from chronolex.llm.components import connected_components


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Union:
    def __init__(self, nodes):
        self.p = {x: x for x in nodes}

    def root(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.p[max(a, b)] = min(a, b)


def test_fingerprints(spark, sf):
    for t in (None, "", " \x0b\x1c", "One", "Ünï A B c d", "a b c d a b c d", "x " * 70_000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])
    assert len(simhash.ball_masks(2)) == 65 == len(set(simhash.ball_masks(2)))


def test_components_against_union_find(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    while len(fps) < 400:
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
            x ^= 1 << b
        fps.append(x)
    u = Union(set(fps))
    for a, b in combinations(set(fps), 2):
        if (a ^ b).bit_count() <= 2:
            u.join(a, b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in set(fps)], "fp long")
    comps = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
    groups = lambda of: {frozenset(x for x in of if of[x] == r) for r in set(of.values())}
    got = {signed(x): comps.get(signed(x), signed(x)) for x in set(fps)}
    assert groups(got) == groups({signed(x): signed(u.root(x)) for x in set(fps)})


def test_long_chain_and_star(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(1001, 1400)]
    df = spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 301 + 400


def test_query_against_brute_force(spark, sf):
    from chronolex.llm.registry import op5_simhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    u = Union(texts)
    for a, b in combinations(texts, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            u.join(a, b)
    rows = op5_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", u.root(i)) for i in texts} and len(rows) == len(texts)


def test_groups_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r["doc_id"]: simhash.shingle_hashes(r["text"], 5)[1] for r in docs.collect()}
    u = Union(sets)
    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs).collect()} == {i: u.root(i) for i in sets}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(i for i in sets if u.root(i) == i)


def edited_copies(n, words=200, edits=3, seed=5):
    """One text and n copies of it, each with some of its words replaced by new ones."""
    rng = random.Random(seed)
    first = [f"w{k}" for k in range(words)]
    out = [" ".join(first)]
    for c in range(n):
        copy = list(first)
        for k in rng.sample(range(words), edits):
            copy[k] = f"new{c}x{k}"
        out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_edited_copies_of_one_text_are_one_group(spark):
    """Most copies resemble the original, but few resemble another copy; 1000 make shares of a bucket too."""
    df = spark.createDataFrame(list(enumerate(edited_copies(1000))), "doc_id long, text string").repartition(4)
    sets = {r["doc_id"]: simhash.shingle_hashes(r["text"], 5)[1] for r in df.collect()}
    u = Union(sets)
    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(df).collect()}
    assert got == {i: u.root(i) for i in sets} and set(got.values()) == {0}


def test_forest_finds_all_links():
    rng = random.Random(4)
    base = [rng.getrandbits(62) for _ in range(60)]
    sets = [set(base) - set(rng.sample(base, rng.choice([2, 6, 12, 20]))) | {rng.getrandbits(62) for _ in range(rng.choice([0, 3]))} for _ in range(80)] + [{1}, {1}, {2}]
    roots = [k - k % 2 for k in range(len(sets))]
    u, got = Union(range(len(sets))), Union(range(len(sets)))
    for k, r in enumerate(roots):
        u.join(k, r), got.join(k, r)
    for a, b in combinations(range(len(sets)), 2):
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    for a, b in simhash.forest(list(range(len(sets))), roots, [simhash.np.array(sorted(x)) for x in sets], 0.8):
        assert got.root(a) != got.root(b)
        got.join(a, b)
    assert [got.root(k) for k in range(len(sets))] == [u.root(k) for k in range(len(sets))]


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs.filter("doc_id is not null")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.filter("doc_id is not null").count()
    assert by[0]["fp"] == 0 and {by[k]["component_id"] for k in (0, 1, 2)} == {0} and by[6]["component_id"] == 5 and by[8]["component_id"] == 7
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.filter(F.col("doc_id").isNotNull()).collect()) == [(False, k) for k in (0, 3, 4, 5, 7, 7, 7, 10)]  # 9 is 7 with two words more
    assert kept.filter("doc_id is null").count() == 2


def test_rows_without_an_id_link_but_name_no_component(spark, monkeypatch):
    far = 1 << 50 | 1 << 20 | 1 << 10
    rows = spark.createDataFrame([(7, 0), (None, 1), (3, 7), (None, far), (None, far)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: rows)
    got = sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == [("3", 7, 3), ("7", 0, 3), ("None", 1, 3), ("None", far, None), ("None", far, None)]


def test_groups_against_an_exact_join_of_a_larger_table(spark):
    """All pairs that share a shingle, counted shingle by shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: simhash.shingle_hashes(r["text"], 5)[1] for r in docs.collect()}
    holders = {}
    for i, s in sorted(sets.items()):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for of in holders.values() if len(of) > 1 for p in combinations(of, 2))
    u = Union(sets)
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs).collect()} == {i: u.root(i) for i in sets}


def test_no_edges_have_no_components(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, None)], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
