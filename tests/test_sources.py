"""Readers, writers, text functions and the stream."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators.cube import Cube
from chronolex.sources import corpora, sinks
from chronolex.streaming import feed


def test_ngram_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write('one two\t1900,3,1\t1910,4,2\nbad line\nquo"te x\t1900,x,1\t1920,2,1\n')
    rows = corpora.unpacked(corpora.packed_ngrams(spark, str(tmp_path / "a.gz"))).collect()
    assert {tuple(r) for r in rows} == {("one two", 1900, 3), ("one two", 1910, 4), ('quo"te x', 1920, 2)}
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write('a "b\t1900\t5\t1\n')
    assert [tuple(r) for r in corpora.ngrams_v1(spark, str(tmp_path / "b.gz")).collect()] == [('a "b', 1900, 5)]


def test_tables_archives_and_posts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("x  1\t2\n\n y 3 4\n")
    assert [tuple(r) for r in corpora.whitespace_table(spark, str(tmp_path / "t.txt"), ["w", "p", "q"]).collect()] == [("x", "1", "2"), ("y", "3", "4")]
    (tmp_path / "l.csv").write_bytes("word,preferred\ncaf\xe9,cafe\n".encode("cp1252"))
    assert corpora.delimited(spark, str(tmp_path / "l.csv"), sep=",", encoding="cp1252").first()["word"] == "café"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.txt", "first")
        z.writestr("two.txt", "second")
    assert sorted((r["member"], r["text"]) for r in corpora.zipped(spark, str(tmp_path / "z.zip")).collect()) == [("d/one.txt", "first"), ("two.txt", "second")]
    (tmp_path / "p.json").write_text(json.dumps({"id": "1", "title": "t", "selftext": "hello", "subreddit": "Food", "created_utc": 0, "is_self": True}) + "\nnot json\n")
    posts = corpora.posts(spark, str(tmp_path / "p.json"))
    kept = posts.filter(tx.wanted_post(F.col("selftext")) & F.col("is_self"))
    topic = tx.with_topic(kept, spark.createDataFrame([("food", "eat")], "subreddit string, topic string"))
    assert [(r["id"], r["topic"]) for r in topic.collect()] == [("1", "eat")]
    assert posts.select(corpora.year_of(F.col("created_utc"))).first()[0] == 1970


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1901, 1), (1909, 2), (1910, 3)], "time int, n int")
    sinks.by_decade(df, f"{tmp_path}/d")
    back = spark.read.parquet(f"{tmp_path}/d")
    assert {r["decade"]: r["s"] for r in back.groupBy("decade").agg(F.sum("n").alias("s")).collect()} == {1900: 3, 1910: 3}
    assert sum(r["rows"] for r in corpora.inventory(back).collect()) == 3
    sinks.append(df, f"{tmp_path}/a")
    sinks.append(df, f"{tmp_path}/a")
    assert corpora.delimited(spark, f"{tmp_path}/a").count() == 6
    sinks.word_list(spark.createDataFrame([("b",), ("a",)], "w string"), "w", f"{tmp_path}/w")
    assert {r["word"] for r in corpora.words(spark, f"{tmp_path}/w").collect()} == {"a", "b"}
    calls = []

    def make():
        calls.append(1)
        return df

    assert [sinks.unless_done(spark, f"{tmp_path}/u", make).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    assert "\\hline" in sinks.latex(df) and sinks.latex(df).count("\\\\") == 4
    with pytest.raises(ValueError):
        sinks.latex(df, most=2)


def test_cached_cube_prefers_finer_bins(spark, tmp_path):
    df = spark.createDataFrame([("a", "c", 1903, 2), ("a", "c", 1917, 3)], "k string, context string, time int, count long")
    made = []

    def make():
        made.append(1)
        return Cube(df, ("k",))

    ten = sinks.cached_cube(spark, str(tmp_path), 10, ("k",), make)
    twenty = sinks.cached_cube(spark, str(tmp_path), 20, ("k",), make)
    again = sinks.cached_cube(spark, str(tmp_path), 10, ("k",), make)
    assert len(made) == 1 and ten.df.count() == again.df.count() == 2 and [tuple(r) for r in twenty.df.collect()] == [("a", "c", 1900, 5)]


def test_document_split(spark):
    df = spark.createDataFrame([("x", k) for k in range(9)] + [("y", 0)], "doc string, place int")
    got = {r["place"]: r["part"] for r in sinks.document_split(df, "doc", "place", n=3).collect()}
    assert got == {0: "valid", 1: "valid", 2: "valid", 4: "test", 5: "test", 6: "test", 8: "train"}


def test_decade_split_and_ranges(spark):
    df = spark.createDataFrame([(d, f"{d}x", k) for d in (1900, 1910, None) for k in range(9)] + [(1900, "a", 0), (1910, "1910y", 0)], "decade int, doc string, place int")
    got = {(r["decade"], r["place"]): r["part"] for r in sinks.document_split(df, "doc", "place", n=3, by=["decade"]).collect()}
    assert len(got) == 21 and got[1910, 4] == "test" and got[None, 8] == "train"
    assert [r["id"] for r in corpora.row_range(spark.range(50).repartition(3), ["id"], 10, 13).orderBy("id").collect()] == [10, 11, 12]


def test_feature_twins(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, x double")
    sinks.feature_twins(df, str(tmp_path), {"cutoff": 5}, ["x"])
    rows = {(r["missing"], r["k"]): r["x"] for r in corpora.delimited(spark, str(tmp_path), schema="k string, x double").collect()}
    assert rows["na", "b"] is None and rows["med", "b"] == 2.0 and rows["na", "a"] == rows["med", "a"] == 1.0


def test_scratch(spark):
    from chronolex.sources import scratch

    df = scratch.stored(spark.range(3), "numbers")
    assert df.count() == 3
    scratch.clear(spark)
    with pytest.raises(Exception):
        spark.range(1).join(df, "id").collect()

    class Session:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        scratch.folder(Session(), "x")


def test_language_scores_and_inventory(spark):
    df = spark.createDataFrame([(1, ["the", "of", "le"]), (2, ["und", "the"]), (3, ["zzz"]), (4, ["le", "les", "x"]), (5, None)], "k int, w array<string>")
    scored = df.select("k", tx.language_scores(F.col("w")).alias("s"))
    got = {r["k"]: (r["s"], r["c"]) for r in scored.select("k", "s", tx.confident(F.transform("s", lambda x: x["p"])).alias("c")).collect()}
    assert got[1][0][0]["lang"] == "en" and got[1][1] and not got[2][1] and got[3] == got[5] == (None, False) and [x["lang"] for x in got[4][0]] == ["fr"] and got[4][1]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(tx.already_tagged(lit("dog_NOUN barks"))) and not one(tx.already_tagged(lit("dog barks"))) and one(tx.fully_tagged(lit("a_NOUN b_X c_. d_VERB e_ADP")))
    assert not one(tx.fully_tagged(lit("a_NOUN b c_X d_X e_X"))) and one(tx.fully_tagged(lit(None).cast("string"))) is False
    assert one(tx.confident(F.array(lit(0.9)))) and one(tx.confident(F.array(lit(0.6), lit(0.4)))) and not one(tx.confident(F.array(lit(0.5), lit(0.46))))
    assert one(tx.spaced_punctuation(lit("a , b .c"))) == "a, b.c" and one(tx.last_block(lit("h\n\nb\n\nt"))) == "t"
    assert one(tx.clean_tagged_text(lit("a|p12 b @@3 <P> c|"))) == "a b c"
    assert [one(tx.universal(lit(t))) for t in ("rr", "NN1", "vvd", "jj", "at")] == ["adv", "noun", "verb", "adj", None]
    assert one(tx.numerals_as_one(lit("7_NUM"))) == "NUM" and one(tx.role_suffix(lit("dog_noun"), "head")) == "dog_h" and one(tx.role_suffix(lit("dog"), "modifier")) == "dog_m"
    assert tuple(one(tx.rating_pair(lit("end-n user-n")))) == ("end", "user") and tuple(one(tx.rating_pair(lit("Swan_song")))) == ("swan", "song")
    assert one(tx.number(lit("3.5"))) == 3.5 and one(tx.number(lit("x"))) is None
    assert one(tx.adjective(lit("a/ADJ"), lit("a"))) and one(tx.adjective(lit("a/NOUN"), lit("hot"), ("hot",))) and not one(tx.adjective(lit(None).cast("string"), lit("a")))
    assert one(tx.opaque(lit(1), lit(0), lit(1))) and not one(tx.opaque(lit(1), lit(0)))
    assert one(tx.detokenised(F.array(*map(lit, ("It", "is", "n't", "so", ",", "Bob", "'s", "!"))))) == "It isn't so, Bob's!"
    assert one(tx.decade_of(lit("corpus_1970s.zip"))) == 1970 and one(tx.spelling_distance(lit("kitten"), lit("sitting"))) == 3
    assert not one(tx.wanted_post(lit("[deleted]"))) and not one(tx.wanted_post(lit(" "))) and not one(tx.wanted_post(lit(None).cast("string"))) and one(tx.all_unknown(F.array(lit("X"), lit("X"))))
    lem = tx.lemmas(spark.createDataFrame([("dogs", "NOUN"), ("ran", "VERB")], "w string, p string"), spark.createDataFrame([("dogs", "NOUN", "dog")], "word string, pos string, lemma string"), "w", "p")
    assert {r["w"] for r in lem.collect()} == {"dog", "ran"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = 86400
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"created_utc": t, "selftext": s}) for t, s in [(0, "red dog ran"), (day * 400, "red dog ran")]))
    schema = corpora.T.StructType.fromDDL("created_utc long, selftext string")
    posts = feed.read(spark, str(tmp_path / "in"), schema).withColumn("created_at", F.timestamp_seconds("created_utc"))
    counts = feed.windowed_counts(posts, size=2, late="1 day", width="365 days")
    for _ in range(2):
        q = feed.to_table(counts, str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
        (tmp_path / "in" / "2.json").write_text(json.dumps({"created_utc": day * 900, "selftext": "x y"}))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["count"] for r in rows) == 4 and {r["lemma_pos"] for r in rows} == {"red_VERB dog_NOUN", "dog_NOUN ran_NOUN"}
