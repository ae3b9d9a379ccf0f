"""Quality rules: base counts, and divergence from language references.

Every document's histograms of character classes and of its language's common
words, which are learnt from the corpus, are compared with the language's reference, the same histograms over all
documents of the language that pass the base rules, by the Jensen-Shannon
distance.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm._common import SPLIT_RE, stored

SYMBOLS = "#*$%&|<>"
#: Character classes, by the patterns of their members; all other word characters make one more class.
CLASSES = {
    "upper": r"\p{Lu}+",
    "digit": r"[0-9]+",
    "mark": r"[.,;:!?'\"()\-]+",
    "symbol": r"[#*$%&|<>{}\[\]=+/\\_@^~`]+",
}
#: Characters in no class above and not among SYMBOLS, which need not be read once for each class.
_PLAIN_RE = r"[a-z\x20\x09-\x0D]+"
#: What separates the tokens in which common words are sought.
_TOKEN_RE = r"[\x20\x09-\x0D.,;:!?]+"
#: Slots of the table that finds a common word by its hash, a power of two.
SLOTS = 512


def _removed(text: Column, pattern: str) -> Column:
    """Number of code points of ``text`` in matches of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_repeated_words(df: DataFrame, words: str = "_words", window: int = 5) -> DataFrame:
    """Add ``n_repeat_words``: words in windows of ``window`` words that a text has twice or more, each word once.

    Every word is hashed once, and windows are compared by 64-bit hashes of their
    words' hashes in order.  Only where there is a repetition are they sorted,
    once, so the cost is n log n.
    """
    step = df.withColumn("_marks", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn(
        "_hashes",
        F.when(
            F.size("_marks") >= window,
            F.transform(F.sequence(F.lit(0), F.size("_marks") - window), lambda i: F.xxhash64(*[F.get("_marks", i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<bigint>")),
    ).withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    step = step.withColumn(
        "_sorted",
        F.when(F.col("_repeats"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(
            F.array().cast("array<struct<h:bigint,p:int>>")
        ),
    )
    # every window beside the one before it in hash order, and one pair more at the end
    step = step.withColumn(
        "_pairs",
        F.zip_with("_sorted", F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), "_sorted"), lambda a, b: F.struct(F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same"), a["p"].alias("p"), b["p"].alias("q"))),
    ).withColumn("_same", F.filter("_pairs", lambda x: x["same"]))
    places = F.sort_array(F.array_distinct(F.concat(F.transform("_same", lambda x: x["p"]), F.transform("_same", lambda x: x["q"]))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).cast("int").alias("n"), p.cast("int").alias("last")),
    )["n"]
    return step.withColumn("n_repeat_words", covered.cast("long")).drop("_marks", "_hashes", "_repeats", "_sorted", "_pairs", "_same")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and the helpers ``_body`` (the text), ``_rest`` (its characters that may be in
    a class) and ``_words``; a null text counts as the empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = df.withColumn("_body", body).withColumn("_rest", F.regexp_replace("_body", _PLAIN_RE, "")).withColumn("_words", F.array_remove(F.split("_body", SPLIT_RE), ""))
    body, words = F.col("_body"), F.col("_words")
    made = made.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    made = made.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": _removed(F.col("_rest"), f"[{SYMBOLS}]+"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    return with_repeated_words(made).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), _TOKEN_RE)


def common_words(df: DataFrame, lang: str, text: str, words: int = 20) -> DataFrame:
    """(lang, common): the ``words`` most frequent words of all documents of each language, as an array, ties by the word.

    Counts are aggregated before they are shuffled, and a language's words are
    cut to the most frequent before they meet in one task.
    """
    met = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_tokens(F.col(text))).alias("word")).where("word <> ''")
    counts = met.groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    best = counts.withColumn("place", place).where(F.col("place") <= words)
    return best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("common"))


def _slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def word_slots(common: str) -> Column:
    """Per slot the place, from 1, of the first word of the array ``common`` whose hash leads there, or 0."""
    taken = F.transform(common, _slot)
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.array_position(taken, s).cast("tinyint"))


def histograms(df: DataFrame, common: str, slots: str, words: int = 20) -> DataFrame:
    """Add ``_chars`` (per class, and the rest of the word characters) and, for
    rows with an array ``common`` and its ``word_slots``, ``_common`` (per common
    word, and all other words), arrays of long."""
    known = F.col(common).isNotNull()
    made = df.withColumn("_tokens", F.when(known, F.array_remove(_tokens(F.col("_body")), "")))
    places = F.transform("_tokens", lambda w: F.get(slots, _slot(w)))

    def letter(w: Column, place: Column) -> Column:
        """One letter for a word, "@" if it is no common one; two common words in one slot are told apart by search."""
        found = F.when(F.get(common, place - 1) == w, place).otherwise(F.array_position(common, w))
        return F.when(place == 0, F.lit("@")).otherwise(F.char(found + 64))

    # letters are counted by what is left without them
    made = made.withColumns(
        {
            "_classes": F.array(*[_removed(F.col("_rest"), pattern) for pattern in CLASSES.values()]),
            "_letters": F.when(known, F.array_join(F.zip_with("_tokens", places, letter), "")),
        }
    )
    of = lambda k: (F.length("_letters") - F.length(F.replace(F.col("_letters"), F.lit(chr(64 + k)), F.lit("")))).cast("long")
    others = F.col("word_chars") - F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.withColumns(
        {
            "_chars": F.concat("_classes", F.array(F.greatest(F.lit(0).cast("long"), others))),
            "_common": F.when(F.col(common).isNotNull(), F.array(*map(of, [*range(1, words + 1), 0]))),
        }
    )


def _small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A stored table with a row per language, as a broadcast if it has ``rows`` at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if either has no mass."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    sp, sq = total(p), total(q)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def part(a: Column, b: Column) -> Column:
        x, y = a / sp, b / sq
        return term(x, (x + y) / 2) + term(y, (x + y) / 2)

    distance = F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, part)) / 2))
    return F.when((sp > 0) & (sq > 0), distance)


def quality_rules(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    words: int = 20,
    max_char_distance: float = 0.33,
    max_word_distance: float = 0.35,
    min_chars: int = 200,
    min_words: int = 60,
    min_reference_docs: int = 20,
) -> DataFrame:
    """One row per input row: key, the base counts, ``base_failed``, the two
    distances (null where a guard holds) and ``kept``.

    A language's common words are the ``words`` (60 at most) most frequent ones
    of all its documents; its references are the summed histograms of those
    that pass the base rules.  Guards: texts shorter than ``min_chars`` word characters or ``min_words``
    words, rows without a language, and
    languages with fewer than ``min_reference_docs`` reference documents are
    not judged by the distance concerned.  ``kept`` is false for rows that fail
    the base rules and for those beyond a distance.  Null and empty texts fail
    the base rules.  Texts are read whole, however long.  Repeated rows are judged each; other columns of ``df``
    are ignored, whatever their names; an empty table gives an empty table.
    Tables with a row per language are broadcast up to 10 000 rows, so the documents are not dealt by language.
    """
    if not 0 < words <= 60:
        raise ValueError("words must be from 1 to 60")
    rows = df.select(F.col(key).alias(key), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    learnt = common_words(rows, "_lang", "_text", words).select(F.col("lang").alias("_lang"), F.col("common").alias("_list"))
    known = stored(learnt.withColumn("_slots", word_slots("_list")), "common-words")
    counted = base_counts(rows.join(_small(known), "_lang", "left"), "_text")
    # the per-document numbers, without the texts, are kept; references and verdicts both read them
    facts = stored(
        histograms(counted, "_list", "_slots", words).select(
            key, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_chars", "_common"
        ),
        "quality",
    )
    sums = [F.sum(F.get("_chars", F.lit(i))).alias(f"_c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("_common", F.lit(i))).alias(f"_w{i}") for i in range(words + 1)]
    references = (
        facts.where(~F.col("base_failed") & F.col("_lang").isNotNull())
        .groupBy("_lang")
        .agg(F.count("*").alias("_docs"), *sums)
        .where(F.col("_docs") >= min_reference_docs)
        .select(
            "_lang",
            F.array(*[f"_c{i}" for i in range(len(CLASSES) + 1)]).alias("_ref_chars"),
            F.array(*[f"_w{i}" for i in range(words + 1)]).alias("_ref_common"),
        )
    )
    as_double = lambda x: F.col(x).cast("array<double>")
    judged = facts.join(_small(stored(references, "references")), "_lang", "left").withColumns(
        {
            "char_distance": F.when(F.col("word_chars") >= min_chars, js_distance(as_double("_chars"), as_double("_ref_chars"))),
            "word_distance": F.when(
                (F.col("n_words") >= min_words) & F.col("_common").isNotNull(),
                js_distance(as_double("_common"), as_double("_ref_common")),
            ),
        }
    )
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance",
        (~F.col("base_failed") & fine).alias("kept"),
    )
