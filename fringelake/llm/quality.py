"""Quality rules: fixed base rules, and divergence of a document's distributions from its language's. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted, scratch, text_of, words

#: Common words of each language, in no order of importance.
COMMON_WORDS = {
    "de": "der die das und in zu den von mit ist im auf für nicht ein eine dem des sich als",
    "en": "the of and to in a is that for it as was with be by on are this from or",
    "es": "de la que el en y a los se del las un por con no una su para es lo",
    "fr": "de la le et les des en un une du que est pour dans qui sur pas au par avec",
}
#: The character classes; what is in none of them, such as letters beyond ASCII, is the last class.
CLASSES = {"lower": "[a-z]+", "space": "[\\x20\\x09-\\x0D]+", "upper": "[A-Z]+", "digit": "[0-9]+", "stop": "[.,;:?'\"()-]+", "symbol": "[!#$%&*+/<=>@\\[\\\\\\]^_`{|}~]+"}
MIN_WORDS, CHAR_LIMIT, WORD_LIMIT = 60, 0.26, 0.305


def _flagged_runs(hashes: Column, width: int) -> Column:
    """How many words lie in windows of `width` words whose hash comes twice or more; hashes are those of the windows, in
    order. Only texts with such a hash are looked at closer."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        after = F.concat(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.greatest(n - 1, F.lit(0))))
        same = F.zip_with(F.zip_with(s, after, lambda x, y: F.struct(x["i"].alias("i"), (x["h"] == y["h"]).alias("e"), x["h"].alias("h"))), before, lambda x, y: F.when(F.coalesce(x["e"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]))
        return let(F.sort_array(F.filter(same, lambda i: i.isNotNull())), gaps)

    def gaps(starts: Column) -> Column:
        later = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
        steps = F.zip_with(starts, later, lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, covered))


def _window_hashes(words_: Column, width: int = 5) -> Column:
    """Hashes of the windows of five words, given those of the words: of pairs, of pairs of pairs, and of those with one word
    more."""
    assert width == 5

    def shift(x: Column, by: int) -> Column:
        return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))

    def head(x: Column, less: int) -> Column:
        return F.slice(x, 1, F.greatest(F.size(x) - less, F.lit(0)))

    two = lambda h: F.zip_with(head(h, 1), shift(h, 1), lambda a, b: F.xxhash64(a, b))
    four = lambda p: F.zip_with(head(p, 2), shift(p, 2), lambda a, b: F.xxhash64(a, b))
    return let(two(words_), lambda p: let(four(p), lambda q: F.zip_with(head(q, 1), shift(words_, 4), lambda a, b: F.xxhash64(a, b))))


def _by_language(body) -> Column:
    """body(words) of the language's common words; null for a language without a list."""
    out = F.lit(None)
    for lang, listed in COMMON_WORDS.items():
        out = F.when(F.col("lang") == lang, body(listed.split())).otherwise(out)
    return out


def _counts(found: str, listed: list[str]) -> Column:
    """How often each listed word comes."""
    return F.array(*[(F.size(found) - F.size(F.array_remove(found, x))).cast("long") for x in listed])


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): the base counts and the two histograms; with whole also all its
    columns, in one named row.

    The classes are taken out of the text one after the other, the frequent ones first, so each looks at what the others
    have left. Each step is a column of its own, which is computed once for each row.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    row = [F.struct(*[quoted(c) for c in docs.columns]).alias("row")] if whole else []
    also = ["row"] if whole else []
    out = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), words(text).alias("parts"), lines.alias("lines"))
    left = "text"
    for name, p in CLASSES.items():
        out = out.withColumn(f"no_{name}", F.regexp_replace(left, p, ""))
        left = f"no_{name}"
    out = out.withColumn("listed", _by_language(lambda listed: F.filter("parts", lambda w: w.isin(*listed))))
    size, before = {}, "text"
    for name in CLASSES:
        size[name] = (F.length(before) - F.length(f"no_{name}")).cast("long")
        before = f"no_{name}"
    out = out.select(
        *also, "doc_id", "lang", F.size("parts").cast("long").alias("n_words"),
        F.array(*size.values(), F.length(left).cast("long")).alias("classes"), _by_language(lambda listed: _counts("listed", listed)).alias("common"),
        (F.length("text") - size["space"]).cast("long").alias("word_chars"),
        (F.length("no_stop") - F.length(F.regexp_replace("no_stop", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("parts", lambda w: F.xxhash64(w)).alias("hashes"),
    ).withColumn("hashes", _window_hashes(F.col("hashes")))
    return out.select(
        *also, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", _flagged_runs(F.col("hashes"), 5).cast("long").alias("n_repeat_words"), "classes",
        F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda t, x: t + x))).alias("common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms given as arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)))


def _shares(h: Column) -> Column:
    return let(F.aggregate(h, F.lit(0.0), lambda t, x: t + x), lambda n: F.transform(h, lambda x: x / F.greatest(n, F.lit(1.0))))


def references(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(lang, ref_classes, ref_common): summed histograms of a language over all its documents of min_words or more.
    Few rows, one for each language; partial sums are made in each task."""
    n = len(CLASSES) + 1
    w = len(next(iter(COMMON_WORDS.values())).split()) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).cast("double").alias(f"c{i}") for i in range(n)] + [F.sum(F.get("common", F.lit(i))).cast("double").alias(f"w{i}") for i in range(w)]
    total = rows.where(F.col("n_words") >= min_words).groupBy("lang").agg(*sums)
    return total.select(F.col("lang").alias("ref_lang"), F.array(*[f"c{i}" for i in range(n)]).alias("ref_classes"), F.when(F.col("w0").isNotNull(), F.array(*[f"w{i}" for i in range(w)])).alias("ref_common"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Judge each row of docs (doc_id, text, lang): base counts, base_failed, the two distances, kept.

    A document that the base rules pass is kept unless its character classes are further than char_limit, or its common
    words further than word_limit, from its language's reference. Guards: with under min_words words no distance is
    taken and the base rules decide; so they do for the word distance of a language without a word list. A null language
    is a language of its own. Null text: no words, so the base rules reject it. Repeated rows come as often as they are
    there; an empty table gives an empty result; further columns are ignored.
    """
    return _judged(scratch(features(docs), "features"), min_words, char_limit, word_limit)


def accepted(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names. Each row goes by its own verdict, so
    repeated and null ids need no care, and no row is sent to another task."""
    judged = _judged(scratch(features(docs, True), "features"), min_words, char_limit, word_limit)
    return judged.where("kept").select("row.*")


def _judged(rows: DataFrame, min_words: int, char_limit: float, word_limit: float) -> DataFrame:
    refs = references(rows, min_words)
    both = rows.join(F.broadcast(refs), rows.lang.eqNullSafe(refs.ref_lang), "left")  # one row for each language
    long_enough = F.col("n_words") >= min_words
    out = both.select(
        *(["row"] if "row" in rows.columns else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.when(long_enough, _distance(_shares(F.col("classes")), _shares(F.col("ref_classes")))).alias("char_distance"),
        F.when(long_enough & F.col("common").isNotNull(), _distance(_shares(F.col("common")), _shares(F.col("ref_common")))).alias("word_distance"),
    )
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= char_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return out.withColumn("kept", ~F.col("base_failed") & fine)
