import pytest
from pyspark.sql import functions as F

from chronolex.llm import common, tokens


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    assert common.shared_dir(spark)


def test_intermediates_can_be_cleared(spark):
    df = common.stored(spark.range(3), "numbers")
    assert df.count() == 3
    common.clear(spark)
    with pytest.raises(Exception):
        spark.range(1).join(df, "id").collect()


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(20_000)
    a, b = (sorted(r["id"] for r in common.bounded_sample(x, F.col("id").cast("string"), 500).collect()) for x in (df, df.repartition(9)))
    assert a == b and 250 <= len(a) <= 500 and common.bounded_sample(df, F.col("id"), 30_000).count() == 20_000


def test_tokenizers_take_nulls_empty_and_long_texts():
    word, byte = tokens.word_bpe(), tokens.rank_bpe()
    assert word.encode([None, "", " \n "]) == [b"", b"", b""] and byte.count(None) == byte.count("") == 0
    long = "some words, and more\n" * 50_000
    assert len(word.encode([long])[0]) // 4 == len(word.tokenizer.encode(long, add_special_tokens=False).ids)
    assert byte.count(long) > 200_000
    small = tokens.WordBPE(f"{tokens.FOLDER}/word_bpe_49k.json", memory=2)
    assert small.encode(["a b c", "d e f"]) + small.encode(["a b c"]) == word.encode(["a b c", "d e f", "a b c"])
