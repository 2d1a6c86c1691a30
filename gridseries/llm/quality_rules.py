"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Words are runs of characters other than 0x20 and 0x09-0x0D.  The base columns
(word characters, symbols, repeated lines, words in repeated 8-word windows)
are array expressions inside the row: no shuffle, no explode, no Python, so
neither a long text nor a hot source matters to the plan.

Method: every further rule's cost and share of rejected rows are estimated on a
sample of ``SAMPLE_ROWS`` documents (those of least id hash); rules are ordered
by rejections per second and evaluated as one CASE, so a document leaves the
cascade at the first rule that rejects it.  The order decides the work, never
the verdict: a document is kept when no rule rejects it.

Defined cases: a null or empty text has zero words and fails the base rule;
repeated rows give repeated results; other columns are ignored; an empty table
gives no rows (the order is then the declared one).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm.common import doc_view
from gridseries.session import shared_dir

WINDOW = 8
SAMPLE_ROWS = 2000
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects``: a boolean expression over (text, __words, n_words, word_chars, n_symbols, n_dup_lines)."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    words, n = F.col("__words"), F.col("n_words")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n * 5),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > lines * 5),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20)),
        Rule("few_letters", F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) * 10 < n * 5),
        Rule("capitals", F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) * 2 > F.col("word_chars")),
    ]


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, __words and the base columns."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = doc_view(docs, id_col, text_col) \
        .withColumn("__words", F.array_remove(F.split("text", SPACES), "")).withColumn("n_words", F.size("__words").cast("long")) \
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long")) \
        .withColumn("n_symbols", F.length(F.regexp_replace("text", SYMBOLS.replace("[", "[^") + "+", "")).cast("long")) \
        .withColumn("__lines", lines).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    # hashes of runs of 1, 2, 4, ... words, each from two of half the length
    d = d.withColumn("__h", F.when(F.col("n_words") > WINDOW, F.transform("__words", lambda w: F.xxhash64(w))))
    step = 1
    while step < WINDOW:
        d = d.withColumn("__h", F.expr(
            f"zip_with(slice(__h, 1, size(__h) - {step}), slice(__h, {step + 1}, size(__h) - {step}), (x, y) -> xxhash64(x, y))"))
        step *= 2
    d = d \
        .withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(F.transform(
            "__h", lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))))) \
        .withColumn("__eq", F.expr("zip_with(slice(__s, 1, size(__s) - 1), slice(__s, 2, size(__s) - 1), (x, y) -> x.h = y.h)"))
    flags = "zip_with(array_prepend(__eq, false), array_append(__eq, false), (x, y) -> x OR y)"
    d = d.withColumn("__at", F.expr(f"array_sort(array_compact(zip_with(__s, {flags}, (e, f) -> CASE WHEN f THEN e.i END)))"))
    covered = F.coalesce(F.expr(
        f"aggregate(__at, struct(-{WINDOW} AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n), a -> a.n)"),
        F.lit(0)).cast("long")
    # rand() keeps the optimizer from moving a later filter below this column, which would repeat its whole expression
    return d.withColumn("n_repeat_words", F.when(F.rand() >= 0, covered)) \
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))) \
        .drop("__lines", "__h", "__s", "__eq", "__at")


def cascade_order(spark: SparkSession, docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text",
                  sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) by rejections per second, most first; measured on the sample, a few numbers come back."""
    shared_dir(spark)
    view = doc_view(docs, id_col, text_col)
    h = F.xxhash64("doc_id")
    # the n-th smallest hash first, from ids alone: texts beyond the sample are not sorted or moved
    last = view.select(h.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    sample = view.filter(h <= F.lit(last)).limit(sample_rows)
    sample = base_columns(sample).checkpoint().filter(~F.col("base_failed"))

    def took(what: Column) -> tuple[float, int]:
        best, got = float("inf"), 0
        for _ in range(3):
            t = time.perf_counter()
            got = sample.agg(F.sum(what.cast("int"))).first()[0] or 0
            best = min(best, time.perf_counter() - t)
        return best, got

    floor, n = took(F.lit(True))
    out = []
    for r in rules:
        s, rejected = took(r.rejects)
        out.append((r, max(s - floor, 1e-4), rejected / max(n, 1)))
    return sorted(out, key=lambda x: -x[2] / x[1])


def apply_rules(spark: SparkSession, docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
                text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = [r for r, _, _ in cascade_order(spark, docs, rules or default_rules(), id_col, text_col, sample_rows)]
    kept = F.when(F.col("base_failed"), F.lit(False))
    for r in order:
        kept = kept.when(r.rejects, F.lit(False))
    return base_columns(docs, id_col, text_col).withColumn("kept", kept.otherwise(F.lit(True))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
