import math
import re
import zlib

from chronolex.llm import langid, registry


def test_words_first_then_shorter_grams():
    m = langid.Model({"en": {"the": 50, "house": 5, "thing": 5}, "fr": {"maison": 5, "les": 50, "chose": 5}}, {"en": 3, "fr": 3})
    p = m.predictor()
    assert p("The house")[0] == "en" and p("les maisons")[0] == "fr"
    assert p("housing things")[0] == "en"  # unseen words, by their n-grams
    assert p("zzz")[0] in ("en", "fr")
    assert p(None) == p("") == p("12 + 3_4") == ("und", 0.0)
    assert langid.grams("ab", 3) == ["<ab", "ab>"] and langid.grams("ab", 1) == ["a", "b"]
    seen = m.backoff("house")
    assert (seen == m.grams[5][1][[m.grams[5][0][g] for g in langid.grams("house", 5)]].mean(axis=0)).all()
    assert langid.Model({}, {}).predictor()("hello") == ("und", 0.0)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "MEMORY", 10)
    p = langid.Model({"en": {"the": 5, "a": 2}, "fr": {"la": 5}}, {"en": 1, "fr": 1}).predictor()
    one = p(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}the" for k in range(100)))
    assert one == p(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}the" for k in range(100))) and one[0] == "en"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op6_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 100


def test_fit_is_bounded_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.fit(docs, sample_rows=100)
    again = langid.fit(docs.repartition(7), sample_rows=100)
    assert len(m.words[0]) < len(langid.fit(docs).words[0])
    assert m.words[0].keys() == again.words[0].keys() and (m.prior == again.prior).all()


def test_odd_rows(odd_docs, no_docs):
    rows = langid.held_out_predictions(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert langid.held_out_predictions(no_docs).count() == 0
    kept = langid.keep_identified(odd_docs, least_score=0.0)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id in (0, 1, 2)").count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).filter("lang is null")
    assert {r["lang_pred"] for r in langid.held_out_predictions(unlabelled).collect()} <= {"und"}


def test_the_fit_keeps_every_word(spark):
    name = lambda k: "".join(chr(97 + k // 26**e % 26) for e in range(4))
    docs = spark.createDataFrame([(1, " ".join(map(name, range(41_000))), "en")], "doc_id long, text string, lang string")
    m = langid.fit(docs)
    assert len(m.words[0]) == 41_000 and len(m.grams[5][0]) > 41_000


def plain_prediction(counts, docs, text):
    """The method word by word, with dictionaries only."""
    langs = sorted(counts)
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    known = sorted({w for x in counts.values() for w in x})
    tables = {0: {lang: dict(counts[lang]) for lang in langs}}
    for size in langid.SIZES:
        tables[size] = {lang: {} for lang in langs}
        for lang in langs:
            for w, n in counts[lang].items():
                for g in langid.grams(w, size):
                    tables[size][lang][g] = tables[size][lang].get(g, 0) + n
    names = {size: {k for lang in langs for k in t[lang]} for size, t in tables.items()}
    sums = {size: {lang: sum(t[lang].values()) for lang in langs} for size, t in tables.items()}
    weight = lambda size, lang, k: math.log((tables[size][lang].get(k, 0) + 0.5) / (sums[size][lang] + 0.5 * len(names[size])))
    total = dict.fromkeys(langs, 0.0)
    known = set(known)
    for w in words:
        if w in known:
            size, of = 0, [w]
        else:
            size, of = next(((s, x) for s in langid.SIZES if (x := [g for g in langid.grams(w, s) if g in names[s]])), (0, []))
        for lang in langs:
            total[lang] += sum(weight(size, lang, k) for k in of) / len(of) if of else 0.0
    rows = sum(docs.values())
    x = {lang: total[lang] * min(1.0, 30 / len(words)) + math.log((docs[lang] + 0.5) / (rows + 0.5 * len(langs))) for lang in langs}
    best = max(langs, key=lambda lang: x[lang])
    return best, 1 / sum(math.exp(v - x[best]) for v in x.values())


def test_predictions_against_a_plain_scorer(spark, sf, monkeypatch):
    monkeypatch.setattr(langid, "MEMORY", 50)  # forgets all the time
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts, rows = {}, {}
    for text, lang in docs[:25]:
        rows[lang] = rows.get(lang, 0) + 1
        c = counts.setdefault(lang, {})
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            c[w] = c.get(w, 0) + 1
    one = langid.Model(counts, rows).predictor()
    for text in [t[:3000] for t, _ in docs[25:65]] + ["", None, "zq 12", "Überraschung"]:
        (lang, score), (want, p) = one(text), plain_prediction(counts, rows, text)
        assert lang == want and abs(score - p) < 1e-4
