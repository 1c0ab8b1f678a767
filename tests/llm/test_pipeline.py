from itertools import combinations

import corpus_pipeline
from chronolex.llm import decontam, simhash
from chronolex.llm.common import stored

from .test_line_dedup import plain as plain_lines
from .test_packing import check
from .test_simhash import Union


def test_stages_against_plain_versions(spark, sf):
    """Each stage against a brute-force version on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = stages(spark, docs, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in first[0].collect()}
    assert len(kept) >= 0.97 * len(texts) and all(texts[i] == t for i, t in kept.items())
    lines = {r["doc_id"]: r["text"] for r in first[1].collect()}
    assert lines == plain_lines(kept) and all(r["n_chars"] == len(r["text"]) for r in first[1].collect())
    sets = {i: simhash.shingle_hashes(t, 5)[1] for i, t in lines.items()}
    u = Union(sets)
    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    near = {r["doc_id"] for r in first[2].collect()}
    assert near == {i for i in sets if u.root(i) == i} and len(near) < len(sets)
    bench = decontam.Benchmark([(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    clean = {r["doc_id"]: r["text"] for r in first[3].collect()}
    for i in near:
        n, spans, _, whole = bench.hits(lines[i])
        assert (i in clean) == (not whole and not decontam.contaminated(decontam.n_hit(spans), n))
    windows = {tuple(w[k : k + 13]) for w in (decontam.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) for k in range(len(w) - 12)}
    assert not any(tuple(w[k : k + 13]) in windows for w in map(decontam.words_of, clean.values()) for k in range(len(w) - 12))
    from chronolex.llm.tokens import word_bpe

    t = word_bpe().tokenizer
    check(first[4].collect(), {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in clean.items()})
    assert all(d.columns == docs.columns for d in first[:4])


def stages(spark, docs, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_run_is_repeatable(spark, sf):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert a == b


def test_odd_rows_and_empty_tables(spark, sf, odd_docs, no_docs):
    out = stages(spark, odd_docs, sf)
    assert all(d.columns == odd_docs.columns for d in out[:4]) and out[4].count() > 0
    assert [d.count() for d in stages(spark, no_docs, sf)] == [0] * 5
