import random

from chronolex.llm import line_dedup as ld


def plain(docs):
    """Texts by id, by a dictionary of windows in order of id and place."""
    seen, out = {}, {}
    for i, text in sorted(docs.items()):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        full = [x.strip(ld.SPACE) for x in lines if x.strip(ld.SPACE)]
        covered = set()
        for k in range(len(full) - 2):
            w = tuple(full[k : k + 3])
            if w in seen:
                covered |= {k, k + 1, k + 2}
            seen.setdefault(w, (i, k))
        n, kept = -1, []
        for line in lines:
            n += bool(line.strip(ld.SPACE))
            if n not in covered:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    docs = {i: "\n".join(rng.choice(["", " ", "a", "b", " b", "c", "d"]) for _ in range(rng.randrange(0, 14))) for i in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in ld.dedupe_lines(df).collect()}
    want = plain(docs)
    assert got == want and want != docs
    left = {x.strip(ld.SPACE) for t in got.values() for x in t.split("\n")}
    assert left >= {x.strip(ld.SPACE) for t in docs.values() for x in t.split("\n")} - {""}


def test_odd_rows(odd_docs, no_docs):
    out = ld.dedupe_lines(odd_docs, removed_col="removed")
    assert out.columns == [*odd_docs.columns, "removed"] and ld.dedupe_lines(no_docs).count() == 0
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["text"] is None and by[1][0]["text"] == ""
    assert len(by[7]) == 3 and all(r["text"].count("\n") == 7 and r["removed"] == 0 for r in by[7])  # repeated rows of one id
    assert by[8][0]["text"] == "" and by[50][0]["text"] == "" and by[9][0]["text"] == "x\ny"


def test_rows_of_one_id_and_different_texts(spark):
    """Only the text that repeats a window loses it; others under the same or no id keep their lines."""
    rows = [(i, t) for i in (None, 1) for t in (f"p {i}\nq {i}\nr {i}\nown {i}", f"u {i}\nv {i}\nw {i}\nx {i}", f"a\nb\nc\nend {i}")]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"], r["n"]) for r in ld.dedupe_lines(df, removed_col="n").collect() if r["doc_id"])
    assert got == sorted((False, i, "end 1" if t.startswith("a\n") else t, int(t.startswith("a\n"))) for i, t in rows if i)
    none = sorted(r["text"] for r in ld.dedupe_lines(df).collect() if r["doc_id"] is None)
    assert none == sorted([*(t for i, t in rows if i is None), rows[0][1]])
