"""Line-first cleaning with DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that loses too
much of its text this way, or fails a base rule on its whole text, is rejected. There is no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import col, fresh

SPACES = " \t\n\x0b\f\r"
GAP, WORD = r"[ \t\n\x0B\f\r]+", r"[^ \t\n\x0B\f\r]+"  # with a further + they give nothing back
#: Phrases of lines that stand around a text and aren't part of it.
BOILERPLATE = (
    "all rights reserved", "licensed under", "is licensed under", "released under the", "terms of use", "privacy policy",
    "cookie policy", "uses cookies", "javascript is disabled", "enable javascript", "sign up for our newsletter", "back to top",
)


ENDS = (".", "!", "?", ":", ";", '"', "'", "…", "”", "»", ")", "]")


@dataclass(frozen=True)
class LineRules:
    """symbol_share: of a line's characters. pipes: separators that make a line navigation, and pipe_share: a word of it at
    least. shouts: of `!!` in a line, and shout_share: a word. boilerplate_words: the most that a line with a phrase has, or
    the phrases make up boilerplate_share of its characters. short_words: a line of fewer words must end like a sentence.
    keep_share: of the characters in words that must stay."""

    symbol_share: float = 0.1
    pipes: int = 2
    pipe_share: float = 0.1
    shouts: int = 3
    shout_share: float = 0.1
    boilerplate_words: int = 20
    boilerplate_share: float = 0.25
    short_words: int = 4
    keep_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    inner = F.trim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, characters, "")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, n_words: Column) -> Column:
    """How many words lie in 3-word windows that the array holds twice or more.

    Windows are compared by 64-bit hash. Their upper 33 bits, packed with the place into one long, sort as primitives;
    neighbours with equal bits (all repeated windows, seldom another) are sorted again by the whole hash, and the
    places of equal ones measured as a union of intervals of length 3."""

    def hashes(w: Column) -> Column:  # of a bound array: an optimizer that inlines it can't have it split again for each word
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    low = (1 << 31) - 1

    def alike(s: Column, key) -> Column:
        n = F.size(s)
        same = lambda x, j: F.when((j >= 0) & (j < n), key(F.get(s, j)) == key(x)).otherwise(False)
        return F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exactly(h: Column, near: Column) -> Column:
        some = F.sort_array(F.transform(near, lambda x: bound(x.bitwiseAND(F.lit(low)).cast("int"), lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))))
        return bound(some, lambda s: bound(F.sort_array(F.transform(alike(s, lambda x: x["h"]), lambda x: x["i"])), covered))

    def counted(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        near = bound(packed, lambda s: alike(s, lambda x: F.shiftright(x, 31)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bound(near, lambda x: exactly(h, x)))

    return F.when(n_words < 3, F.lit(0).cast("long")).otherwise(bound(bound(words, hashes), counted))


def line_fails(line: Column, rules: LineRules) -> Column:
    """A line with words that is boilerplate, navigation, symbols or shouting, or a short one without an end. Marks
    count in proportion to the line's words, so that a few don't cost a long line. Each cheap test for a byte string comes
    before the regular expression that only such lines need."""
    held = lambda what, mark: F.length(what) - F.length(F.replace(what, F.lit(mark), F.lit("")))

    def fails(inner: Column) -> Column:
        n_words = F.size(F.split(inner, GAP))
        apart = [x for x in BOILERPLATE if not any(y in x for y in BOILERPLATE if y != x)]
        phrases = lambda low: reduce(add, [held(low, x) for x in apart])
        some = lambda low: reduce(or_, [low.contains(x) for x in BOILERPLATE])
        boilerplate = bound(F.lower(inner), lambda low: some(low) & ((n_words <= rules.boilerplate_words) | (phrases(low) >= rules.boilerplate_share * F.length(low))))
        navigation = inner.contains("|") & (held(inner, "|") >= rules.pipes) & (held(inner, "|") >= rules.pipe_share * n_words)
        symbols = inner.rlike("[#*$%&|<>]") & (F.length(without(inner, r"[^#*$%&|<>]+")) > rules.symbol_share * F.length(inner))
        shouting = inner.contains("!!") & (held(inner, "!!") >= 2 * rules.shouts) & (held(inner, "!!") >= 2 * rules.shout_share * n_words)
        unended = ~F.right(inner, F.lit(1)).isin(*ENDS) & ~inner.rlike(rf"^(?:{WORD}+{GAP}+){{{rules.short_words - 1}}}{WORD}")
        return (inner != "") & (navigation | shouting | unended | symbols | boilerplate)

    return bound(F.trim(line, F.lit(SPACES)), fails)


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "kept_chars", "base_failed", "kept", "clean_text")


def with_quality(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, kept_chars, base_failed, kept and
    clean_text (the text without failing lines), beside its own columns; the added ones replace columns of those names.

    Null and empty texts have no words and fail; clean_text is null for null. Repeated rows are judged alike, each for
    itself. A text without words loses nothing but fails the base rule. An empty table gives an empty table."""
    own = [c for c in docs.columns if c.lower() not in ADDED]
    t_, words, kept, worded_, n_lines = fresh([*docs.columns, *ADDED], "text", "words", "good", "worded", "n_lines")
    t = F.col(t_)
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    chars = lambda c: long(F.length(reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit("")), SPACES, c)))
    given = col(text)
    lines = F.split(given, "\n")
    worded = F.filter(lines, lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    good = F.filter(lines, lambda x: ~line_fails(x, rules))
    step = docs.select(*map(col, own), given.alias(t_), words_of(given).alias(words), good.alias(kept), worded.alias(worded_), F.size(lines).alias(n_lines))
    n = F.size(words)
    clean = F.array_join(kept, "\n")
    step = step.select(
        *map(col, own), long(n).alias("n_words"), long(F.length(F.array_join(words, ""))).alias("word_chars"), long(F.length(without(t, r"[^#*$%&|<>]+"))).alias("n_symbols"),
        long(F.when(t.isNotNull(), F.size(worded_) - F.size(F.array_distinct(worded_)))).alias("n_dup_lines"), long(repeat_words(F.col(words), n)).alias("n_repeat_words"),
        long(F.when(t.isNotNull(), F.col(n_lines) - F.size(kept))).alias("n_bad_lines"), chars(clean).alias("kept_chars"), F.when(t.isNotNull(), clean).alias("clean_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return step.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_chars") >= rules.keep_share * F.col("word_chars")))


def kept_only(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """with_quality's rows that are kept. The verdict is filtered beside a row number, which keeps Catalyst from moving
    the filter, and with it all that the verdict is made of, below the projections that compute it once."""
    judged = with_quality(docs, rules, text)
    (row,) = fresh(judged.columns, "row")
    return judged.withColumn(row, F.monotonically_increasing_id()).where(F.col("kept") & (F.col(row) >= 0)).drop(row)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "kept_chars")
