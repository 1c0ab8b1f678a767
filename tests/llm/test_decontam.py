import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex.llm import decontam, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=13):
    """Hit words and items that occur, by looking at every place."""
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        size = min(window, len(x))
        grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if size else set()
        for k in range(len(w) - size + 1 if size else 0):
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(item)
    return len(w), len(hit), found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab "), max_size=60), st.lists(st.lists(st.sampled_from("ab "), max_size=30), max_size=4))
def test_search_equals_every_place(text, items):
    text, items = "x".join(text).replace("x", " "), [(str(k), " ".join(t)) for k, t in enumerate(items)]
    n, spans, found, whole = decontam.Benchmark(items, window=5).hits(text)
    want = plain(text, items, window=5)
    assert (n, decontam.n_hit(spans), found) == want
    assert whole == bool(plain(text, [(i, t) for i, t in items if len(words(t)) >= 5], window=5)[1])


def test_jumps():
    m = decontam.WuManber([tuple(range(1, 14))], 13)
    text = [0] * 5 + [20, 21, 22] * 30 + list(range(1, 14)) + [7]
    assert m.search(text) == [(95, 0)] and m.far == 12 and m.search([]) == m.search([1]) == []
    assert decontam.words_of("Ünï-x_Y 9Ab") == [w.encode() for w in words("Ünï-x_Y 9Ab")]


def test_query_and_blocks(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    rows = registry.op10_decontamination(spark, sf).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        n, hit, found = plain(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert any(r["contaminated"] for r in rows)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    more = docs.union(docs.limit(3))
    again = {x["doc_id"] for x in docs.limit(3).collect()}
    spread = decontam.search(more, bench, block_bytes=2000)
    assert sorted(map(tuple, spread.select(cols).collect())) == sorted(tuple(r[c] for c in cols) for r in rows + [x for x in rows if x["doc_id"] in again])
    kept = [sorted(str(r["doc_id"]) for r in decontam.keep_clean(more, bench, block_bytes=n).collect()) for n in (decontam.BLOCK_BYTES, 2000)]
    assert kept[0] == kept[1] and len(kept[0]) < more.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab "), max_size=60), st.lists(st.lists(st.sampled_from("ab "), max_size=30), max_size=4))
def test_jump_tables_skip_no_occurrence(text, items):
    """Every place where a pattern is, is left by the tables, also where blocks share an entry."""
    w, found = decontam.words_of("".join(text)), [decontam.words_of("".join(t)) for t in items]
    for slots in (4, 1024):
        least, size = {}, {}
        for x in found:
            m = min(6, len(x))
            b = min(decontam.SPREAD_BLOCK, m)
            for end in range(b, len(x) + 1) if m else ():
                key = (m, decontam.block_slot(x, end, b, slots))
                least[key] = min(least.get(key, 6), max(0, m - end))
            size[m] = b
        for m in filter(None, size):
            table = np.full(slots, m - size[m] + 1, np.uint8)
            for (k, slot), jump in least.items():
                if k == m:
                    table[slot] = jump
            grams = {tuple(x[k : k + m]) for x in found if min(6, len(x)) == m for k in range(len(x) - m + 1)}
            assert {s for s in range(len(w) - m + 1) if tuple(w[s : s + m]) in grams} <= set(decontam.unskipped(w, table, m))


def test_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(20))
    bench = spark.createDataFrame([(1, passage, "c"), (1, passage, "c"), (2, None, "c"), (3, "", "c"), (None, "two words", "c"), (4, "Two Words", "c")], "item_id long, text string, n_words string")
    rows = decontam.search(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["n_words"], by[0]["n_hit"], by[0]["contaminated"]) == (0, 0, False)
    assert (by[4]["n_hit"], by[4]["n_items"], by[4]["contaminated"]) == (2, 1, True)
    assert decontam.search(no_docs, bench).count() == 0 and decontam.search(odd_docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    spread = decontam.search(odd_docs, bench, block_bytes=1)
    assert sorted(map(str, spread.select(columns).collect())) == sorted(map(str, decontam.search(odd_docs, bench).select(columns).collect()))
    assert decontam.search(no_docs, bench, block_bytes=1).count() == 0
    kept = decontam.keep_clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 4").count() == 0 and kept.count() == odd_docs.count() - 1


def test_only_the_contaminated_text_of_an_id_goes(spark):
    bench = spark.createDataFrame([(1, "some short item")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "some short item"), (None, "clean text here"), (None, None), (2, "Some short item!"), (2, "clean too")], "doc_id long, text string")
    assert sorted(str(r["text"]) for r in decontam.keep_clean(docs, bench).collect()) == ["None", "clean text here", "clean too"]


def test_whole_windows_go_from_long_texts_and_everyday_items_stay(spark):
    passage = " ".join(f"w{k}" for k in range(14))
    long = " ".join(f"x{k}" for k in range(2000))
    bench = spark.createDataFrame([(1, passage), (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, f"{long} Short item. {long}"), (3, "a short item, no more"), (4, long)], "doc_id long, text string")
    for n in (decontam.BLOCK_BYTES, 1):
        assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, bench, block_bytes=n).collect()) == [2, 4]
