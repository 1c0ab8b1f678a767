import uuid

from pyspark.sql import functions as F

from chronolex.llm import registry, token_rollup, tokens
from chronolex.llm.common import shared_dir


def rows_of(df):
    return sorted((str(r["source"]), str(r["lang"]), r["tokenizer"], r["docs"], r["tokens"]) for r in df.collect())


def test_deltas_replays_and_snapshots(spark):
    r = token_rollup.Rollup(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    assert r.totals().count() == 0
    made = lambda rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long")
    one = made([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None)])
    assert r.commit("b1", one) and not r.commit("b1", one)
    assert rows_of(r.totals()) == [("None", "None", "v1", 1, 0), ("a", "en", "v1", 2, 15)]
    two = made([("a", "en", "v1", "delete", 5, None), ("a", "en", "v1", "revise", 12, 10)])
    assert r.commit("b2", two)
    assert rows_of(r.totals()) == [("None", "None", "v1", 1, 0), ("a", "en", "v1", 1, 12)]
    r.compact()
    assert not r.commit("b1", one) and not r.commit("b2", two) and rows_of(r.totals()) == [("None", "None", "v1", 1, 0), ("a", "en", "v1", 1, 12)]
    assert r.commit("b3", made([(None, None, "v1", "delete", 0, None), ("b", "fr", "v2", "insert", 7, None)]))
    want = [("a", "en", "v1", 1, 12), ("b", "fr", "v2", 1, 7)]
    assert rows_of(r.totals()) == want
    for _ in range(3):
        r.compact()
        assert rows_of(r.totals()) == want
    assert not r.commit("b1", one) and not r.commit("b3", one) and rows_of(r.totals()) == want
    assert r._names("open") == [] and r._names("data") == [] and len(r._names("snapshots")) <= 2


def insert(spark, n):
    return spark.createDataFrame([("a", "en", "v1", "insert", n, None)], "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long")


def test_an_attempt_cut_short_counts_for_nothing(spark, monkeypatch):
    r = token_rollup.Rollup(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    with monkeypatch.context() as m:
        m.setattr(r, "_write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            r.commit("b1", insert(spark, 10))
        except OSError:
            pass
    assert r.totals().count() == 0 and r.commit("b1", insert(spark, 10))
    assert rows_of(r.totals()) == [("a", "en", "v1", 1, 10)]


def test_two_writers_of_one_batch_count_once(spark, monkeypatch):
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    r, other = token_rollup.Rollup(spark, folder), token_rollup.Rollup(spark, folder)
    asked = []
    real = r.is_committed

    def slow(batch):
        asked.append(batch)
        found = real(batch)
        if len(asked) == 1:  # the other writer is faster
            assert other.commit(batch, insert(spark, 10))
        return found

    monkeypatch.setattr(r, "is_committed", slow)
    assert not r.commit("b1", insert(spark, 10)) and rows_of(r.totals()) == [("a", "en", "v1", 1, 10)]


def test_a_batch_that_commits_during_a_compaction_counts_once(spark, monkeypatch):
    r = token_rollup.Rollup(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    r.commit("b1", insert(spark, 10))
    real = r._sum

    def late(snap, batches):
        r.commit("b2", insert(spark, 5))
        return real(snap, batches)

    with monkeypatch.context() as m:
        m.setattr(r, "_sum", late)
        r.compact()
    assert rows_of(r.totals()) == [("a", "en", "v1", 2, 15)]
    r.compact()
    assert rows_of(r.totals()) == [("a", "en", "v1", 2, 15)]


def test_a_broken_compaction_changes_nothing(spark, monkeypatch):
    r = token_rollup.Rollup(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    r.commit("b1", insert(spark, 10))
    r.compact()
    r.commit("b2", insert(spark, 5))
    with monkeypatch.context() as m:
        m.setattr(r, "_sum", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            r.compact()
        except OSError:
            pass
    r.commit("b3", insert(spark, 1))
    assert rows_of(r.totals()) == [("a", "en", "v1", 3, 16)]
    r.compact()
    assert rows_of(r.totals()) == [("a", "en", "v1", 3, 16)]


def test_query_against_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    byte, word = tokens.rank_bpe(), tokens.word_bpe()
    want, seen = {}, set()

    def add(key, d, n):
        x = want.setdefault(key, [0, 0])
        x[0] += d
        x[1] += n

    for r in sorted(docs, key=lambda r: r["doc_id"]):
        n, s = byte.count(r["text"]), (str(r["source"]), str(r["lang"]))
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        add((*s, "byte_bpe_50k"), 1, n)
        for version in ("current", "word_bpe_49k"):
            add((*s, version), 1, len(word.tokenizer.encode(r["text"], add_special_tokens=False).ids))
    assert rows_of(registry.op4_token_rollup(spark, sf)) == sorted((*k, *v) for k, v in want.items())


def test_odd_rows(odd_docs, no_docs):
    rows = token_rollup.token_counts(odd_docs).collect()
    assert len(rows) == odd_docs.count() and token_rollup.token_counts(no_docs).count() == 0
    assert {(r["n_byte"], r["n_word"]) for r in rows if r["doc_id"] in (0, 1)} == {(0, 0)}
    summed = token_rollup.signed(odd_docs.withColumn("tokenizer", F.lit("v")), F.lit("insert"), F.col("n_chars"), F.lit(None)).collect()
    assert sum(r["docs"] for r in summed) == odd_docs.count()


def test_rows_without_an_id_are_kept_or_copies(spark):
    docs = spark.createDataFrame([(None, "no id", "s", "en"), (1, "twice", "s", "en"), (None, "twice", "s", "en")], "doc_id long, text string, source string, lang string")
    n = {k: v.filter("op <> 'revise'").count() for k, v in registry.token_changes(docs).items()}
    assert n == {"load": 3, "copies": 1, "current": 2, "word": 2, "retokenised": 0}
