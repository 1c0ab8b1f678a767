"""Windows, pattern classes and the cubes they yield, against rules written out in plain Python."""

import re
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from chronolex.operators import ngrams

TAGS = ("NOUN", "PROPN", "ADJ", "VERB", "X")


def by_patterns(tags):
    """The class by patterns over the joined tags, in the order in which later ones win."""
    n, j, x = "(?:NOUN|PROPN)", "ADJ", "(?!NOUN|PROPN)[A-Z]+"
    a = "[A-Z]+"
    out = 0
    for base, p in ((1, n), (6, j)):
        rules = [(base, f"^{p} {n} {x} {p} {n}$"), (base + 1, f"^{p} {n} {x} {a} {a}$"), (base + 2, f"^{x} {p} {n} {x} {a}$"), (base + 3, f"^{a} {x} {p} {n} {x}$"), (base + 4, f"^{a} {a} {x} {p} {n}$")]
        text = " ".join(tags)
        both = re.match(rules[0][1], text)
        for c, r in rules:
            if re.match(r, text) and not (both and c in (base + 1, base + 4)):
                out = c
    text = " ".join(tags)
    if re.match(f"^{n} {n} {x} {j} {n}$", text):
        out = 11
    if re.match(f"^{j} {n} {x} {n} {n}$", text):
        out = 12
    return out


def test_histogram_of_all_tuples(spark):
    rows = [(list(t),) for t in product(TAGS, repeat=5)]
    df = spark.createDataFrame(rows, "pos array<string>").withColumn("c", ngrams.pattern_class(F.col("pos")))
    got = {tuple(r["pos"]): r["c"] for r in df.collect()}
    assert dict(sorted(Counter(got.values()).items())) == {0: 1793, 1: 48, 2: 228, 3: 180, 4: 180, 5: 228, 6: 12, 7: 114, 8: 90, 9: 90, 10: 114, 11: 24, 12: 24}
    assert all(c == by_patterns(t) for t, c in got.items())


def test_context_slots():
    assert [ngrams.near(k) for k in range(5)] == [[1, 2, 3], [0, 2, 3, 4], [0, 1, 3, 4], [0, 1, 2, 4], [1, 2, 3]]


def test_windows_padding_and_names(spark):
    t = [("a", "NOUN"), ("b", "NOUN"), ("c", "VERB"), ("d", "DET"), ("e", "NOUN"), ("f_g", "ADJ")]
    df = spark.createDataFrame([(1, t), (2, t[:4]), (3, [])], "id int, tokens array<struct<lemma:string,pos:string>>")
    w = ngrams.windows(df, ["id"]).select("id", "place", ngrams.lemma_pos(F.col("w")).alias("s")).collect()
    assert [(r["id"], r["place"], r["s"]) for r in w] == [(1, 0, "a_NOUN b_NOUN c_VERB d_DET e_NOUN"), (1, 1, "b_NOUN c_VERB d_DET e_NOUN f_g_ADJ")]
    joined = ngrams.joined_windows(df, ["id"], outer=True).collect()
    assert sorted((r["id"], r["window"] or "") for r in joined) == [*((1, r["s"]) for r in w), (2, ""), (3, "")]
    assert ngrams.joined_windows(df, ["id"]).count() == len(w)
    plan = ngrams.joined_windows(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "[id#" in generate and "__t" not in generate.split("), [id#")[1]  # rows of windows do not carry the text
    padded = df.select(ngrams.lemma_pos(ngrams.padded(F.col("tokens"))).alias("s")).collect()
    assert padded[1]["s"].endswith("d_DET eos_X") and padded[2]["s"] == " ".join(["eos_X"] * 5) and padded[0]["s"].count(" ") == 5
    back = df.filter("id = 1").select(ngrams.split_lemma_pos(ngrams.lemma_pos(F.col("tokens"))).alias("t")).first()["t"]
    assert [(x["lemma"], x["pos"]) for x in back] == t


def test_cube_slots(spark):
    w = [("a", "NOUN"), ("b", "NOUN"), ("c", "VERB"), ("d", "ADJ"), ("e", "NOUN")]
    df = spark.createDataFrame([(1900, w)], "time int, w array<struct<lemma:string,pos:string>>").withColumn("comp_class", ngrams.pattern_class(F.transform("w", lambda t: t["pos"])))
    assert df.first()["comp_class"] == 11
    slots = ngrams.aware_slots(df, ["time"]).groupBy("role", "modifier", "head").agg(F.sort_array(F.collect_list("context")).alias("c")).collect()
    got = {(r["role"], r["modifier"], r["head"]): r["c"] for r in slots}
    assert got["compound", "a_NOUN", "b_NOUN"] == ["c_VERB", "d_ADJ", "e_NOUN"] and got["compound", "d_ADJ", "e_NOUN"] == ["a_NOUN", "b_NOUN", "c_VERB"]
    assert got["modifier", "a_NOUN", None] == ["b_NOUN", "c_VERB", "d_ADJ"] and got["head", None, "e_NOUN"] == ["b_NOUN", "c_VERB", "d_ADJ"]
    assert got["head", None, "b_NOUN"] == ["a_NOUN", "c_VERB", "d_ADJ", "e_NOUN"] and len(got) == 6
    phrases = ngrams.cube_of(ngrams.phrase_slots(df, ["time"]), ("modifier", "head")).df
    assert {(r["modifier"], r["head"]) for r in phrases.collect()} == {("a_NOUN", "b_NOUN"), ("d_ADJ", "e_NOUN")}
    words = ngrams.word_slots(df, ["time"]).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in words} == {"a_NOUN": 3, "b_NOUN": 4, "d_ADJ": 4, "e_NOUN": 3}
    linked = spark.createDataFrame([(1900, [("x", "VERB"), ("state", "NOUN"), ("of", "ADP"), ("mind", "NOUN"), ("y", "VERB")])], "time int, w array<struct<lemma:string,pos:string>>")
    rows = ngrams.linked_slots(linked, ["time"], ("of",), True).collect()
    assert {(r["modifier"], r["head"], r["context"]) for r in rows} == {("mind_NOUN", "state_NOUN", "x_VERB"), ("mind_NOUN", "state_NOUN", "y_VERB")}


def test_runs_labels_and_adjacent_pairs(spark):
    df = spark.createDataFrame([(["compound", "compound", "nsubj", "compound"],)], "d array<string>")
    assert df.select(ngrams.compound_runs(F.col("d")).alias("n")).first()["n"] == 2
    t = spark.createDataFrame([([("a", "compound", "ORG"), ("b", "nsubj", "ORG"), ("c", "compound", "")],)], "t array<struct<lemma:string,dep:string,ent:string>>")
    assert t.select(ngrams.compound_labels(F.col("t")).alias("s")).first()["s"] == "ORG"
    noun = spark.createDataFrame([(1, [("a", "NOUN"), ("b", "NOUN"), ("c", "NOUN"), ("d", "VERB"), ("e", "NOUN"), ("f", "NOUN")])], "id int, tokens array<struct<lemma:string,pos:string>>")
    rows = ngrams.adjacent_pairs(noun, ["id"]).collect()
    assert [(r["modifier"], r["head"], r["left"], r["right"]) for r in rows] == [("b", "c", "a", "d e"), ("e", "f", "c d", "")]
    assert {(r["lemma"], r["pos"]) for r in ngrams.content_counts(spark.createDataFrame([([("is", "AUX"), ("a", "DET")],)], "tokens array<struct<lemma:string,pos:string>>")).collect()} == {("is", "VERB")}


def test_documents_yield_the_slots_of_their_windows(spark):
    words = [("a", "NOUN"), ("b", "NOUN"), ("c", "VERB"), ("d", "ADJ"), ("e", "NOUN"), ("f", "X"), ("g", "PROPN"), ("h", "NOUN")]
    df = spark.createDataFrame([(1, words), (2, words[:4]), (3, words[2:])], "time int, tokens array<struct<lemma:string,pos:string>>")
    w = ngrams.windows(df, ["time"]).withColumn("comp_class", ngrams.pattern_class(F.col("w.pos")))
    rows = lambda x: sorted(map(str, map(tuple, x.collect())))
    pair = {"modifier": "m", "head": "h", "context": "c"}
    assert rows(ngrams.document_slots(df, ["time"], ngrams.phrases_of, pair)) == rows(ngrams.phrase_slots(w, ["time"])) != []
    assert rows(ngrams.document_slots(df, ["time"], ngrams.words_slots_of, {"word": "m", "context": "c"})) == rows(ngrams.word_slots(w, ["time"])) != []
    assert rows(ngrams.document_slots(df, ["time"], ngrams.fours_of, pair, size=4)) == rows(ngrams.four_slots(ngrams.windows(df, ["time"], 4), ["time"])) != []
    compounds = ngrams.aware_slots(w, ["time"]).filter("role = 'compound'").drop("role")
    assert rows(ngrams.document_slots(df, ["time"], lambda t: [s for s in ngrams.aware_slots_of(t) if s["r"] == "compound"], pair)) == rows(compounds) != []


def test_pairs_with_counts_equal_the_slots_of_all_windows(spark):
    words = [("a", "NOUN"), ("b", "NOUN"), ("c", "VERB"), ("d", "ADJ"), ("e", "NOUN"), ("a", "NOUN"), ("g", "PROPN"), ("h", "NOUN")]
    rows = [(1, words * 3), (2, words[:4]), (3, words[2:]), (4, []), (5, None), (6, words[:5]), (7, words[:1])]
    df = spark.createDataFrame(rows, "time int, tokens array<struct<lemma:string,pos:string>>")
    cube = lambda slots, *n: sorted(map(tuple, ngrams.cube_of(slots, ("word",), *n).df.collect()))
    assert cube(ngrams.neighbour_slots(df, ["time"]), F.col("count")) == cube(ngrams.document_slots(df, ["time"], ngrams.words_slots_of, {"word": "m", "context": "c"})) != []


def test_a_cube_with_a_cutoff_reads_documents_once(spark, sf):
    """One scan in the plan as executed, and partial sums below every shuffle of rows."""
    from chronolex.plans import registry

    for name in ("cube_words", "cube_phrases"):
        df = registry.QUERIES[name](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        assert sum("Scan parquet" in x for x in plan) == 1, name
        assert all("HashAggregate" in "".join(plan[k + 1 : k + 3]) for k, x in enumerate(plan) if "+- Exchange hashpartitioning" in x), name


def test_rows_of_windows_do_not_carry_the_text(spark, sf):
    """What Generate passes on besides the windows; a long text in each of its windows would fill the executor."""
    from chronolex.plans import registry

    t = [(f"w{k}", "NOUN" if k % 7 else "VERB") for k in range(3000)]
    df = spark.createDataFrame([(1, t), (2, t[:5]), (3, t[:4]), (4, None)], "id int, tokens array<struct<lemma:string,pos:string>>")
    w = ngrams.windows(df, ["id"])
    got = [(r["id"], r["place"], [tuple(x) for x in r["w"]]) for r in w.collect()]
    assert got == [*((1, k, t[k : k + 5]) for k in range(2996)), (2, 0, t[:5])]
    for x, carried in ((w, ["id"]), (registry.QUERIES["uniform_windows"](spark, sf), ["time"])):
        plan = x._jdf.queryExecution().executedPlan().toString()
        generate = next(line for line in plan.splitlines() if "Generate explode" in line)
        assert re.findall(r"([a-z_]+)#", re.search(r"\), \[([^\]]*)\], false, \[", generate)[1]) == carried


def test_packed_cube_equals_the_rows_of_pairs(spark, sf):
    """Chunks of a few tokens and shares of a few sums; and nothing but blocks of sums is shuffled, once."""
    from chronolex.operators import packed
    from chronolex.plans import registry

    words = [("a", "NOUN"), ("\u00e9t\u00e9", "NOUN"), ("c", "VERB"), ("d", "ADJ"), ("e", "NOUN"), ("a", "NOUN"), ("g", "PROPN"), ("h", None), (None, "NOUN")]
    rows = [(1, words * 3), (2, words[:4]), (3, words[2:]), (4, []), (5, None), (1, words[:6]), (None, words[:7]), (3, words * 2), (9, [("x", "VERB")] * 6)]
    df = spark.createDataFrame(rows, "time int, tokens array<struct<lemma:string,pos:string>>").coalesce(1)
    got = lambda c: sorted(map(str, map(tuple, c.df.select("word", "context", "time", "count").collect())))
    plain = ngrams.cube_of(ngrams.neighbour_slots(df, ["time"]), ("word",), F.col("count"))
    for how in ({}, {"chunk": 8, "most": 5}):
        assert got(packed.neighbour_cube(df, **how)) == got(plain) != []
        assert [x for x in got(packed.neighbour_cube(df, 40, **how)) if "None, " not in x] == got(plain.above(40)) != []
    assert packed.neighbour_cube(df.filter("time = 4")).df.collect() == []
    df = registry.QUERIES["cube_words"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_legacy_pairs_without_marks(spark):
    df = spark.createDataFrame([("oak_nn1 a_b_nn1 tree_nn1 jjx red_jj",), ("oak_nn1 tree_nn1 jjx red_jj vvd",)], "fivegram_pos string")
    assert [tuple(r) for r in ngrams.legacy_pairs(df, []).collect()] == [("oak_noun", "tree_noun", "red_adj")]
