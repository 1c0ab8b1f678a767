"""Text clean-up, tag and rating functions; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "NOUN|PROPN|ADJ|VERB|ADV|ADP|DET|PRON|NUM|CONJ|CCONJ|PRT|X|AUX|\\."


def already_tagged(ngram: Column) -> Column:
    """N-grams that carry a part-of-speech mark."""
    return F.coalesce(ngram.rlike(f"_(?:{TAGS})(?: |$)|(?:^| )_(?:{TAGS})_"), F.lit(False))


def fully_tagged(ngram: Column, n: int = 5) -> Column:
    """Exactly n tokens with a mark each; null is false."""
    return F.coalesce(ngram.rlike(f"^(?:[^ ]+_(?:{TAGS})(?: |$)){{{n}}}$"), F.lit(False))


def token_count(text: Column) -> Column:
    return F.size(F.split(text, " "))


def all_unknown(pos: Column, tag: str = "X") -> Column:
    """All tags of an array are X, or another tag."""
    return F.size(F.filter(pos, lambda p: p == tag)) == F.size(pos)


# Frequent words of one language each.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "mit", "von", "auf", "den", "zu"),
    "en": ("the", "of", "and", "to", "is", "that", "with", "for", "are", "was", "this", "by"),
    "es": ("el", "los", "las", "y", "que", "por", "del", "con", "una", "no", "como", "se"),
    "fr": ("le", "les", "et", "des", "est", "dans", "pour", "sur", "une", "du", "au", "pas"),
}


def language_scores(words: Column, least: float = 0.1) -> Column:
    """(p, lang) of the languages with at least this share of an array's function words, best first; ties go to the name that
    sorts last. Null without any. The seam where a trained identifier would go."""

    def counts(ws: Column) -> Column:
        return F.array(*(F.size(F.filter(ws, lambda w: w.isin(*listed))).cast("double") for listed in FUNCTION_WORDS.values()))

    def scored(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
        rows = F.array(*(F.struct((n[k] / total).alias("p"), F.lit(lang).alias("lang")) for k, lang in enumerate(FUNCTION_WORDS)))
        return F.when(total > 0, F.filter(F.sort_array(rows, asc=False), lambda x: x["p"] >= least))

    # a lambda over an array of one binds its value, so that words and counts are worked out once
    return F.transform(F.transform(F.array(words), counts), scored)[0]


def confident(scores: Column, margin: float = 0.1) -> Column:
    """A single label, or two whose scores differ by more than this part of their sum."""
    p, q = F.element_at(scores, 1), F.try_element_at(scores, F.lit(2))
    return F.coalesce(F.when(F.size(scores) == 1, True).otherwise(F.try_divide(F.abs(p - q), p + q) > margin), F.lit(False))


def spaced_punctuation(text: Column) -> Column:
    """One space around commas and no space before full stops."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*,\s*", ", "), r"\s+\.", ".")


def last_block(text: Column) -> Column:
    """What follows the last empty line."""
    return F.element_at(F.split(text, "\n\n"), -1)


def clean_tagged_text(text: Column) -> Column:
    """Without page marks, bars, @@ marks and paragraph tags, white space made single."""
    t = F.regexp_replace(text, r"\|p[0-9]+|\||@@[0-9]*|</?P>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def universal(tag: Column) -> Column:
    """CLAWS tags as universal ones, for the content classes; others are null."""
    t = F.lower(tag)
    return F.when(t == "rr", "adv").when(t.rlike("^nn.+"), "noun").when(t.rlike("^vv.+"), "verb").when(t.rlike("^jj.*"), "adj")


def numerals_as_one(token: Column) -> Column:
    return F.regexp_replace(token, "^.+_NUM$", "NUM")


def role_suffix(word: Column, role: str) -> Column:
    """A noun of a joint vector space as modifier or head: `_noun` becomes `_m` or `_h`."""
    s = "_m" if role == "modifier" else "_h"
    return F.when(word.rlike("_noun$"), F.regexp_replace(word, "_noun$", s)).otherwise(F.concat(word, F.lit(s)))


def clean_word(word: Column, pos: Column, tags: tuple[str, ...] = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")) -> Column:
    """A content word of letters only."""
    return word.rlike("^[a-zA-Z]+$") & pos.isin(*tags)


# How texts begin that moderation or a script has put in a post's place.
BOILERPLATE = (
    "This comment has been overwritten by an open source script to protect this user",
    "Sorry, but this just got posted. And while reposts are allowed, we do remove multiples, which are a clone of an existing post.",
    "Post removed for not being flaired.",
)


def wanted_post(text: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Posts with a text of their author's: not empty, not deleted, not boilerplate."""
    t = F.trim(text)
    ok = t.isNotNull() & (t != "") & (t != "[deleted]")
    for b in boilerplate:
        ok = ok & ~t.startswith(b)
    return F.coalesce(ok, F.lit(False))


def post_text(title: Column, body: Column) -> Column:
    """Title and body as one text with single spaces."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", title, body), r"\s+", " "))


def with_topic(posts: DataFrame, topics: DataFrame, col: str = "subreddit") -> DataFrame:
    """Posts of listed subreddits with their topic; topics (subreddit, topic) is a list, which Spark broadcasts if it is short."""
    return posts.join(topics.select(F.lower(col).alias("__s"), "topic"), F.lower(posts[col]) == F.col("__s")).drop("__s")


def rating_pair(text: Column) -> Column:
    """(modifier, head) of a rated compound written with a space, hyphen, underscore or slash, without tag suffixes."""
    w = F.split(F.regexp_replace(F.lower(text), "-[nja](?= |$)", ""), "[ _/-]+")
    return F.struct(F.try_element_at(w, F.lit(1)).alias("modifier"), F.try_element_at(w, F.lit(2)).alias("head"))


def number(text: Column) -> Column:
    return text.try_cast("double")


def adjective(pos: Column, modifier: Column, listed: tuple[str, ...] = ()) -> Column:
    """The tag string names an adjective, or the modifier is listed as one."""
    return F.coalesce(pos.contains("ADJ"), F.lit(False)) | modifier.isin(*listed) if listed else F.coalesce(pos.contains("ADJ"), F.lit(False))


def opaque(*votes: Column, least: int = 2) -> Column:
    """At least so many votes against transparency."""
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total >= least


def respelled(df: DataFrame, spellings: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Columns with each word replaced by its preferred spelling; spellings (word, preferred) is a list of distinct words."""
    for c in cols:
        s = spellings.select(F.col("word").alias("__w"), F.col("preferred").alias("__p"))
        df = df.join(s, F.col(c) == F.col("__w"), "left").withColumn(c, F.coalesce("__p", c)).drop("__w", "__p")
    return df


def lemmas(df: DataFrame, lookup: DataFrame, word: str, pos: str) -> DataFrame:
    """word replaced by its lemma where the lookup (word, pos, lemma) has one; the lookup sees distinct words only."""
    distinct = df.select(word, pos).distinct().join(lookup.select(F.col("word").alias(word), F.col("pos").alias(pos), "lemma"), [word, pos])
    return df.join(distinct, [word, pos], "left").withColumn(word, F.coalesce("lemma", word)).drop("lemma")


def detokenised(tokens: Column) -> Column:
    """Tokens as running text: no space before closing marks or clitics."""
    return F.regexp_replace(F.array_join(tokens, " "), r" (?=[.,;:!?)]|'s\b|n't\b)", "")


def decade_of(name: Column) -> Column:
    """1970 of `1970s` or of a file name that holds it."""
    return F.regexp_extract(name, "([0-9]{4})", 1).try_cast("int")


def spelling_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
