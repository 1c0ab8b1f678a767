"""Tagged five-token windows, pattern classes and the cubes that windows yield."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube

# Closed-class words and suffixes of the model-free tagger.
CLOSED = {
    "DET": ("the", "a", "an", "this", "that", "le", "la", "les", "un", "une", "der", "die", "das", "ein", "eine", "el", "los", "las"),
    "ADP": ("of", "in", "on", "at", "by", "to", "for", "from", "with", "de", "du", "des", "en", "dans", "sur", "pour", "par", "mit", "zu", "von", "auf", "para", "por", "con"),
    "CCONJ": ("and", "or", "but", "et", "ou", "und", "oder", "y", "o"),
    "PRON": ("it", "he", "she", "they", "we", "you", "qui", "que", "sich", "es", "se"),
    "VERB": ("is", "are", "was", "be", "est", "ist", "sind", "son"),
}
SUFFIXES = {"VERB": ("ing", "ed", "er", "en", "ir"), "ADJ": ("ble", "ly", "ous", "eux", "lich", "oso"), "ADV": ("ment", "mente")}
NOUNS = ("NOUN", "PROPN")


def tag_sql(word: str) -> str:
    """The tag of a lower-case word as a SQL expression; what no rule knows is a noun."""
    cases = [f"WHEN {word} IN ({', '.join(repr(w) for w in words)}) THEN '{tag}'" for tag, words in CLOSED.items()]
    cases += [f"WHEN {' OR '.join(f'{word} LIKE {chr(39)}%{s}{chr(39)}' for s in ends)} THEN '{tag}'" for tag, ends in SUFFIXES.items()]
    return f"CASE {' '.join(cases)} ELSE 'NOUN' END"


def words_of(text: Column) -> Column:
    """Lower-case letter sequences."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zß-öø-ÿ]+"), F.lit(0))


def annotate(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, and tokens: an array of (lemma, pos). This is the seam where a trained tagger would go."""
    return docs.select(*keep, F.transform(words_of(F.col(text)), lambda w: F.struct(w.alias("lemma"), tag_of(w).alias("pos"))).alias("tokens"))


def tag_of(word: Column) -> Column:
    """The same rules as tag_sql, for a Column."""
    out = None
    for tag, words in CLOSED.items():
        out = (F if out is None else out).when(word.isin(*words), tag)
    for tag, ends in SUFFIXES.items():
        test = word.endswith(ends[0])
        for e in ends[1:]:
            test = test | word.endswith(e)
        out = out.when(test, tag)
    return out.otherwise("NOUN")


def windows(tokens: DataFrame, keep: list[str], size: int = 5, col: str = "tokens") -> DataFrame:
    """Every stretch of `size` consecutive tokens, with stride 1 and its place; shorter rows have none.

    Windows are built before they become rows, as in joined_windows. Spark holds all rows that one text yields until they are
    read, so with the whole text in each the memory would grow with the square of a text's length.
    """
    n = F.size(col)
    at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(at, lambda k: F.struct(k.alias("place"), F.slice(col, k + 1, size).alias("w")))
    return tokens.select(*keep, F.explode(rows).alias("__w")).select(*keep, "__w.place", "__w.w")


def lemma_pos(window: Column) -> Column:
    """Tokens as `lemma_POS`, joined by spaces."""
    return F.array_join(F.transform(window, lambda t: F.concat_ws("_", t["lemma"], t["pos"])), " ")


def joined_windows(tokens: DataFrame, keep: list[str], size: int = 5, col: str = "tokens", name: str = "window", outer: bool = False) -> DataFrame:
    """Every stretch of `size` consecutive tokens as joined `lemma_POS`; with outer, shorter rows stay with a null.

    Windows are built before they become rows, so that no row carries the whole text: the work is linear in a text's length
    whatever expressions follow.
    """
    words = tokens.select(*keep, F.transform(col, lambda t: F.concat_ws("_", t["lemma"], t["pos"])).alias("__t"))
    n = F.size("__t")
    at = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    make = F.explode_outer if outer else F.explode
    return words.select(*keep, make(F.transform(at, lambda k: F.array_join(F.slice("__t", k, size), " "))).alias(name))


def split_lemma_pos(text: Column) -> Column:
    """The array of (lemma, pos) of joined `lemma_POS` tokens; the tag follows the last underscore."""
    return F.transform(F.split(text, " "), lambda t: F.struct(F.regexp_replace(t, "_[^_]*$", "").alias("lemma"), F.regexp_extract(t, "_([^_]*)$", 1).alias("pos")))


def padded(tokens: Column, size: int = 5) -> Column:
    """A short parse filled with the end token."""
    end = F.struct(F.lit("eos").alias("lemma"), F.lit("X").alias("pos"))
    return F.slice(F.concat(tokens, F.array_repeat(end, size)), 1, F.greatest(F.size(tokens), F.lit(size)))


def class_of(tags: Sequence[str]) -> int:
    """Class 0 to 12 of five tags: noun-noun patterns 1 to 5, adjective-noun 6 to 10, mixed 11 and 12.

    Within a base, 0 is a pair on both sides of the middle, 1 a pair on the left, 2 and 3 one inside, 4 one on the right.
    """
    noun = [t in NOUNS for t in tags]
    nn = [noun[k] and noun[k + 1] for k in range(4)]
    an = [tags[k] == "ADJ" and noun[k + 1] for k in range(4)]
    gap = not noun[2]
    if an[0] and gap and nn[3]:
        return 12
    if nn[0] and gap and an[3]:
        return 11
    for base, p in ((6, an), (1, nn)):
        left, right = p[0] and gap, p[3] and gap
        if right and not left:
            return base + 4
        if p[2] and not noun[1] and not noun[4]:
            return base + 3
        if p[1] and not noun[0] and not noun[3]:
            return base + 2
        if left:
            return base if right else base + 1
    return 0


def noun_class_of(tags: Sequence[str], merged: bool = False) -> int:
    """Class 0 to 5: noun-noun patterns only; merged ones may begin with an adjective."""
    noun = [t in NOUNS for t in tags]
    first = [n or merged and t == "ADJ" for n, t in zip(noun, tags, strict=True)]
    p = [first[k] and noun[k + 1] for k in range(4)]
    left, right = p[0] and not noun[2], p[3] and not noun[2]
    if right and not left:
        return 5
    if p[2] and not noun[1] and not noun[4]:
        return 4
    if p[1] and not noun[0] and not noun[3]:
        return 3
    return (1 if right else 2) if left else 0


def code(pos: Column, size: int = 5) -> Column:
    """Tags as a number to base 3: 1 for a noun, 2 for an adjective, 0 for others."""
    out = F.lit(0)
    for k in range(size):
        p = pos.getItem(k)
        out = out * 3 + F.when(p.isin(*NOUNS), 1).when(p == "ADJ", 2).otherwise(0)
    return out


def tags_of(number: int, size: int = 5) -> list[str]:
    """Tags with this code."""
    return [("X", "NOUN", "ADJ")[number // 3 ** (size - 1 - k) % 3] for k in range(size)]


def table(of: Callable[[list[str]], object], kind: str, size: int = 5) -> Column:
    """A constant array with the rule's value for each code. One lookup replaces a long chain of tests for every window."""
    return F.from_json(F.lit(json.dumps([of(tags_of(c, size)) for c in range(3**size)])), f"array<{kind}>")


def pattern_class(pos: Column) -> Column:
    """class_of an array of five tags."""
    return F.element_at(table(class_of, "int"), code(pos) + 1)


def noun_class(pos: Column, merged: bool = False) -> Column:
    return F.element_at(table(lambda tags: noun_class_of(tags, merged), "int"), code(pos) + 1)


def _slot(window: Column, k: int) -> Column:
    return F.concat_ws("_", window.getItem(k)["lemma"], window.getItem(k)["pos"])


def near(k: int, size: int = 5, reach: int = 3) -> list[int]:
    """Context slots of a slot: all others at most `reach` away."""
    return [q for q in range(size) if q != k and abs(q - k) <= reach]


#: Slots of the pair for each class; both sides for the symmetric ones.
PAIR_AT = {1: (0, 3), 2: (0,), 3: (1,), 4: (2,), 5: (3,)}
PAIR_AT |= {k + 5: v for k, v in PAIR_AT.items()} | {11: (0, 3), 12: (0, 3)}


SLOTS = "array<struct<r:string,m:int,h:int,c:int>>"


def aware_of(klass: int) -> list[dict]:
    """Roles and slots of a class: contexts of each compound, modifier and head."""
    out = []
    for s in PAIR_AT.get(klass, ()):
        out += [{"r": "compound", "m": s, "h": s + 1, "c": q} for q in range(5) if q not in (s, s + 1)]
        out += [{"r": "modifier", "m": s, "h": None, "c": q} for q in near(s)]
        out += [{"r": "head", "m": None, "h": s + 1, "c": q} for q in near(s + 1)]
    return out


def phrases_of(tags: list[str]) -> list[dict]:
    """Slots of each pair of these tags that has no noun at its sides; pairs do not exclude each other."""
    outside = {0: (2,), 1: (0, 3), 2: (1, 4), 3: (2,)}
    noun = [t in NOUNS for t in tags]
    return [{"m": s, "h": s + 1, "c": q} for s in range(4) if (noun[s] or tags[s] == "ADJ") and noun[s + 1] and not any(noun[q] for q in outside[s]) for q in range(5) if q not in (s, s + 1)]


def words_slots_of(tags: list[str]) -> list[dict]:
    return [{"m": k, "c": q} for k, t in enumerate(tags) if t in NOUNS or t == "ADJ" for q in near(k)]


def fours_of(tags: list[str]) -> list[dict]:
    noun = [t in NOUNS for t in tags]
    return [{"m": s, "h": s + 1, "c": q} for s in range(3) if noun[s] and noun[s + 1] and not any(noun[q] for q in (s - 1, s + 2) if 0 <= q < 4) for q in range(4) if q not in (s, s + 1)]


def _emit(df: DataFrame, keep: list[str], slots: Column, window: str, names: dict[str, str]) -> DataFrame:
    """A row for each entry of slots; names gives each output column the field that holds its slot."""
    w = F.col(window)

    def word(field: str) -> Column:
        t = w[F.col(f"__s.{field}")]
        return F.when(F.col(f"__s.{field}").isNotNull(), F.concat_ws("_", t["lemma"], t["pos"]))

    rows = df.select(*keep, window, F.explode(slots).alias("__s"))
    role = [F.col("__s.r").alias("role")] if "role" in names else []
    return rows.select(*keep, *role, *(word(f).alias(n) for n, f in names.items() if n != "role"))


def aware_slots(classified: DataFrame, keep: list[str], window: str = "w", klass: str = "comp_class") -> DataFrame:
    """A row (role, modifier, head, context) for each context of each compound, modifier and head in classified windows."""
    slots = F.from_json(F.lit(json.dumps([aware_of(c) for c in range(13)])), f"array<{SLOTS}>")
    found = classified.filter(F.col(klass) > 0)
    return _emit(found, keep, F.element_at(slots, F.col(klass) + 1), window, {"role": "r", "modifier": "m", "head": "h", "context": "c"})


def phrase_slots(tokens: DataFrame, keep: list[str], window: str = "w") -> DataFrame:
    """(modifier, head, context) for each pattern a window shows."""
    return _emit(tokens, keep, F.element_at(table(phrases_of, SLOTS), code(F.col(f"{window}.pos")) + 1), window, {"modifier": "m", "head": "h", "context": "c"})


def word_slots(tokens: DataFrame, keep: list[str], window: str = "w") -> DataFrame:
    """(word, context) for each slot that holds a noun, proper noun or adjective."""
    return _emit(tokens, keep, F.element_at(table(words_slots_of, SLOTS), code(F.col(f"{window}.pos")) + 1), window, {"word": "m", "context": "c"})


def document_slots(tokens: DataFrame, keep: list[str], of: Callable[[list[str]], list[dict]], names: dict[str, str], size: int = 5, col: str = "tokens") -> DataFrame:
    """The slots of all windows of each row of tokens, without building the windows.

    Tokens are written as `lemma_POS` and coded once for each row; a window is then a place, its code five look-ups, and only
    windows with slots are kept. `of` gives a tag pattern's slots (phrases_of, words_slots_of, fours_of, aware_slots_of).
    """
    texts = F.transform(col, lambda t: F.concat_ws("_", t["lemma"], t["pos"])).alias("__texts")
    codes = F.transform(col, lambda t: F.when(t["pos"].isin(*NOUNS), 1).when(t["pos"] == "ADJ", 2).otherwise(0)).alias("__codes")
    coded = tokens.select(*keep, texts, codes)
    last = F.size("__codes") - size  # a filter on the size would be pushed down, and the row be tokenised for it once more
    placed = coded.select(*keep, "__texts", "__codes", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("__p"))
    number = F.lit(0)
    for k in range(size):
        number = number * 3 + F.col("__codes")[F.col("__p") + k]
    some = [c for c in range(3**size) if of(tags_of(c, size))]
    found = placed.select(*keep, "__texts", "__p", number.alias("__n")).filter(F.col("__n").isin(*some))
    rows = found.select(*keep, "__texts", "__p", F.explode(F.element_at(table(of, SLOTS, size), F.col("__n") + 1)).alias("__s"))
    role = [F.col("__s.r").alias("role")] if "role" in names else []
    return rows.select(*keep, *role, *(F.col("__texts")[F.col("__p") + F.col(f"__s.{f}")].alias(n) for n, f in names.items() if n != "role"))


def neighbour_slots(tokens: DataFrame, keep: list[str], size: int = 5, reach: int = 3, col: str = "tokens") -> DataFrame:
    """(word, context, count) for each noun, proper noun or adjective of a row and each token near it.

    The same sums as document_slots with words_slots_of, which has a row for every window that holds both tokens: here a pair
    is one row, and its count is the number of those windows.
    """
    texts = F.transform(col, lambda t: F.concat_ws("_", t["lemma"], t["pos"])).alias("__texts")
    named = F.transform(col, lambda t: t["pos"].isin(*NOUNS) | (t["pos"] == "ADJ"))
    rows = tokens.select(*keep, texts, named.alias("__named"))
    at = F.when(F.size("__named") >= size, F.filter(F.sequence(F.lit(0), F.size("__named") - 1), lambda k: F.get("__named", k)))
    rows = rows.select(*keep, "__texts", F.explode(at).alias("__p"))
    steps = F.array(*(F.lit(d) for d in range(-reach, reach + 1) if d))
    rows = rows.select(*keep, "__texts", "__p", F.explode(steps).alias("__d")).select(*keep, "__texts", "__p", (F.col("__p") + F.col("__d")).alias("__q"))
    low, high, last = F.least("__p", "__q"), F.greatest("__p", "__q"), F.size("__texts") - size
    count = F.least(low, last) - F.greatest(high - (size - 1), F.lit(0)) + 1
    rows = rows.filter((F.col("__q") >= 0) & (F.col("__q") < F.size("__texts")) & (count > 0))
    return rows.select(*keep, F.col("__texts")[F.col("__p")].alias("word"), F.col("__texts")[F.col("__q")].alias("context"), count.cast("long").alias("count"))


def aware_slots_of(tags: list[str]) -> list[dict]:
    return aware_of(class_of(tags))


def linked_slots(tokens: DataFrame, keep: list[str], link: tuple[str, ...], head_first: bool, window: str = "w") -> DataFrame:
    """Pairs of nouns around linking words (`of`, `of the`, `'s`, a hyphen): three or two alignments, contexts outside."""
    w, n = F.col(window), len(link) + 2
    rows = []
    for s in range(0, 5 - n + 1):
        test = w.getItem(s)["pos"].isin(*NOUNS) & w.getItem(s + n - 1)["pos"].isin(*NOUNS)
        for k, word in enumerate(link):
            test = test & (w.getItem(s + 1 + k)["lemma"] == word)
        a, b = _slot(w, s), _slot(w, s + n - 1)
        m, h = (b, a) if head_first else (a, b)
        own = F.array(*(F.struct(m.alias("modifier"), h.alias("head"), _slot(w, q).alias("context")) for q in range(5) if not s <= q < s + n))
        rows.append(F.when(test, own).otherwise(F.array().cast("array<struct<modifier:string,head:string,context:string>>")))
    return tokens.select(*keep, F.explode(F.concat(*rows)).alias("s")).select(*keep, "s.*")


def four_slots(tokens: DataFrame, keep: list[str], window: str = "w") -> DataFrame:
    """The rule on windows of four: a noun pair whose neighbours are no nouns; contexts are the other two."""
    return _emit(tokens, keep, F.element_at(table(fours_of, SLOTS, 4), code(F.col(f"{window}.pos"), 4) + 1), window, {"modifier": "m", "head": "h", "context": "c"})


def cube_of(slots: DataFrame, keys: tuple[str, ...], count: Column | None = None) -> Cube:
    """Slots summed to a cube; slots need a time column."""
    rows = slots.select(*keys, "context", "time", (F.lit(1) if count is None else count).cast("long").alias("count"))
    return Cube(rows.groupBy(*keys, "context", "time").agg(F.sum("count").alias("count")), keys)


def adjacent_pairs(tokens: DataFrame, keep: list[str], col: str = "tokens", reach: int = 2) -> DataFrame:
    """Adjacent noun pairs that no third noun follows, with up to `reach` tokens of both sides (array operations only)."""
    t, n = F.col(col), F.size(col)
    out = tokens.filter(n >= 2).select(*keep, F.explode(F.sequence(F.lit(1), n - 1)).alias("k"), t.alias("__t"))
    pos = lambda k: F.try_element_at(F.col("__t"), k)["pos"]
    k = F.col("k")
    noun = lambda x: F.coalesce(x.isin(*NOUNS), F.lit(False))
    out = out.filter(noun(pos(k)) & noun(pos(k + 1)) & ~noun(pos(k + 2)))
    left = F.slice("__t", F.greatest(k - reach, F.lit(1)), F.least(k - 1, F.lit(reach)))
    right = F.slice("__t", k + 2, F.lit(reach))
    lemma = lambda a: F.array_join(a["lemma"], " ")
    return out.select(*keep, "k", F.element_at("__t", k)["lemma"].alias("modifier"), F.element_at("__t", k + 1)["lemma"].alias("head"), lemma(left).alias("left"), lemma(right).alias("right"))


def compound_runs(deps: Column) -> Column:
    """Number of runs of `compound` in an array of dependency labels."""
    inside = F.transform(deps, lambda d, k: F.when((d == "compound") & ((k + 1 == F.size(deps)) | (F.try_element_at(deps, k + 2) != "compound")), 1).otherwise(0))
    return F.aggregate(inside, F.lit(0), lambda s, x: s + x)


def compound_labels(tokens: Column) -> Column:
    """Entity labels of the compound tokens, space-joined; tokens have dep and ent."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: (t["dep"] == "compound") & (t["ent"] != "")), lambda t: t["ent"]), " ")


def content_counts(tokens: DataFrame, key: str = "lemma", col: str = "tokens") -> DataFrame:
    """Counts of content words with their tags; auxiliaries count as verbs."""
    t = tokens.select(F.explode(col).alias("t")).select(F.col(f"t.{key}").alias(key), F.when(F.col("t.pos") == "AUX", "VERB").otherwise(F.col("t.pos")).alias("pos"))
    return t.filter(F.col("pos").isin("NOUN", "PROPN", "VERB", "ADJ", "ADV")).groupBy(key, "pos").agg(F.count(F.lit(1)).alias("count"))


def legacy_pairs(grams: DataFrame, keep: list[str], text: str = "fivegram_pos") -> DataFrame:
    """Pairs of singular common nouns (`nn1`) in CLAWS-tagged five-grams: each alignment of which no third noun touches.

    Tokens are `word_tag` (one without a mark has no tag); pair words must consist of a to z, dots and hyphens; contexts are the other slots that carry a
    content tag, with universal tags.
    """
    from chronolex.functions.text import universal

    def parts(x: Column) -> Column:
        marked = F.contains(x, F.lit("_"))
        pos = F.when(marked, F.substring_index(x, "_", -1)).otherwise("")
        return F.struct(F.when(marked, F.substring(x, F.lit(1), F.length(x) - F.length(pos) - 1)).otherwise(x).alias("lemma"), pos.alias("pos"), universal(pos).alias("kind"))

    t = F.split(text, r"\s+")
    df = grams.filter(F.size(t) == 5).select(*keep, F.transform(t, parts).alias("w"))
    w = F.col("w")
    noun = lambda k: w.getItem(k)["pos"] == "nn1"
    plain = lambda k: w.getItem(k)["lemma"].rlike("^[a-z.-]+$")
    named = lambda k: F.concat_ws("_", w.getItem(k)["lemma"], w.getItem(k)["kind"])
    kind = "array<struct<modifier:string,head:string,context:string>>"
    rows = []
    for s in range(4):
        test = noun(s) & noun(s + 1) & plain(s) & plain(s + 1)
        for q in (s - 1, s + 2):
            if 0 <= q < 5:
                test = test & ~noun(q)
        own = F.array(*(F.struct(named(s).alias("modifier"), named(s + 1).alias("head"), F.when(w.getItem(q)["kind"].isNotNull(), named(q)).alias("context")) for q in range(5) if q not in (s, s + 1)))
        rows.append(F.when(test, F.filter(own, lambda x: x["context"].isNotNull())).otherwise(F.array().cast(kind)))
    return df.select(*keep, F.explode(F.concat(*rows)).alias("s")).select(*keep, "s.*")
