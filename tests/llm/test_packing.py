import random
import zlib
from collections import defaultdict

import numpy as np

from chronolex.llm import packing, registry, tokens


def check(rows, ids_of):
    """Each id in one piece, sequences gapless; returns the tokens and the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        ids, at = ids_of[d], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 4096
    return sum(map(len, ids_of.values())), len(by_seq)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    t = tokens.word_bpe().tokenizer
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in docs.items()}
    total, n = check(registry.op8_packing(spark, sf).collect(), ids)
    assert n * 4096 - total < 4096 * 2


def test_word_memory_equals_the_library():
    w = tokens.WordBPE("/opt/tokenizers/word_bpe_49k.json", memory=50)
    odd = ["ΑΣ ΣΑΣ. İstanbul, Ça va\tbien\x1cx ﬁn été don't I'LL  it's, 3.14 ½ a_b <|endoftext|>  x　y　z 日本語 ǅ ß ẞ\r\nq !? ... .,", None, "", "  ", "A" * 5000, "áb , .\n\n;"]
    for _ in range(3):
        for text, got in zip(odd, w.encode(odd), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == w.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_assignment():
    rng = random.Random(1)
    for n in (0, 1, 7, 400):
        sizes = [rng.choice([1, 5, 300, 2500, 4095, 4096, 4097, 9000]) for _ in range(n)]
        pieces, count = packing.assign(sizes)
        assert sum(p[2] for p in pieces) == sum(sizes)
        rests = sum(s % 4096 for s in sizes)
        assert count == sum(s // 4096 for s in sizes) + -(-rests // 4096)
        assert len({p[3] for p in pieces}) == count or not n
    # equal documents are dealt evenly, so costs are balanced
    pieces, count = packing.assign([100] * 80)
    used = [sum(p[2] for p in pieces if p[3] == s) for s in range(count)]
    assert count == 2 and used == [4000, 4000]
    assert packing.cost(200) > 2 * packing.cost(100)


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_words(odd_docs).collect()
    t = tokens.word_bpe().tokenizer
    assert sum(r["length"] for r in rows) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (0, 1, 2)] == [(1, 1)] * 3
    assert packing.pack_words(no_docs).count() == 0
