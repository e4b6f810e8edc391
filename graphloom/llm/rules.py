"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in column expression, so the scan, the measures and the verdict run
in one stage without a shuffle and without user functions. Work per row is n log n in the
row's own words; nothing is gathered across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BLANKS, unused

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that for it with as on be by this "
    "le la les de des et que pour un une dans sur qui "
    "der die das und ist nicht ein eine zu mit von den "
    "el los las del y en por con para una se"
).split()

#: (measure, least, most): a text is kept if every measure lies within its limits.
#: None means no limit on that side. Ratios are of words or of lines that hold a word.
THRESHOLDS = (
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", None, 0.25),
    ("shout_ratio", None, 0.5),
    ("bar_ratio", None, 0.25),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
    ("stop_words", 1, None),
)

#: The columns that :func:`measures` adds.
ADDED = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "shout_ratio", "bar_ratio", *(name for name, _, _ in THRESHOLDS)}
#: Words in a window of the repetition measure.
WINDOW = 5


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of ``text`` as columns; other columns stay.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and the
    ratios named in :data:`THRESHOLDS`. A null text counts as empty: all measures are 0.
    A column of ``docs`` that bears the name of a measure is replaced by it; names of the
    intermediate columns are chosen so that they clash with none.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED and c != text])
    q = unused(docs, "_q")
    t = F.coalesce(F.col(text), F.lit(""))
    blanks = F.lit(BLANKS)
    words = F.when(F.btrim(t, blanks) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(t, blanks), "[ \\t\\n\\x0B\\f\\r]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, blanks) != "")
    one = docs.select("*", words.alias(f"{q}_words"), lines.alias(f"{q}_lines"))
    hashes = F.transform(f"{q}_words", lambda x: F.xxhash64(x))
    two = one.select("*", hashes.alias(f"{q}_hash"), F.size(f"{q}_words").cast("long").alias("n_words"))
    h = F.col(f"{q}_hash")
    grams = F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    )
    three = two.select("*", grams.alias(f"{q}_grams"))
    # Only texts in which some window occurs twice pay for the sort.
    repeats = F.size(F.array_distinct(f"{q}_grams")) < F.size(f"{q}_grams")
    placed = F.when(repeats, F.sort_array(F.transform(f"{q}_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    four = three.select("*", placed.alias(f"{q}_placed"))
    p = F.col(f"{q}_placed")
    twice = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["g"] == x["g"], F.lit(False)))
    five = four.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias(f"{q}_starts"))
    covered = F.aggregate(
        f"{q}_starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    without = F.length(F.translate(t, BLANKS, ""))
    n_lines = F.size(f"{q}_lines")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    six = five.select(
        "*",
        without.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(f"{q}_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        share(F.size(F.filter(f"{q}_lines", lambda x: F.btrim(x, blanks).rlike("^[-*•·]"))), n_lines).alias("bullet_line_ratio"),
        share(F.size(F.filter(f"{q}_lines", lambda x: F.btrim(x, blanks).rlike("(\\.\\.\\.|…)$"))), n_lines).alias("ellipsis_line_ratio"),
        F.size(F.array_intersect(F.split(F.lower(t), "[^\\p{L}]+"), F.array(*[F.lit(w) for w in STOP_WORDS]))).cast("long").alias("stop_words"),
        share(F.length(t) - F.length(F.translate(t, "!", "")), F.col("n_words")).alias("shout_ratio"),
        share(F.length(t) - F.length(F.translate(t, "|", "")), F.col("n_words")).alias("bar_ratio"),
    )
    full = six.select(
        "*",
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        share(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        share(F.col("n_dup_lines"), n_lines).alias("dup_line_ratio"),
    )
    return full.drop(f"{q}_words", f"{q}_lines", f"{q}_hash", f"{q}_grams", f"{q}_placed", f"{q}_starts")


def verdict(table=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the measures."""
    ok = F.lit(True)
    for name, least, most in table:
        if least is not None:
            ok = ok & (F.col(name) >= F.lit(least))
        if most is not None:
            ok = ok & (F.col(name) <= F.lit(most))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", table=THRESHOLDS) -> DataFrame:
    """One row per document: id, the measures, base_failed and kept.

    Repeated rows stay repeated; a null id is carried through. Only ``id`` and ``text`` are
    read, so other columns, whatever their names, cannot clash. Very long texts cost
    n log n of their words. An empty table gives an empty result.
    """
    got = measures(docs.select(F.col(id), F.col(text).alias("_q_text")), "_q_text").drop("_q_text")
    return got.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(table))
