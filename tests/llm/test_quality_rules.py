import re
from collections import Counter

from pyspark.sql import functions as F

from gridseries.llm import quality_rules as Q

from helpers import no_docs, odd_docs


def plain(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_odd_rows(spark):
    got = Q.apply_rules(spark, odd_docs(spark)).collect()
    want = sorted(map(str, ((i, *plain(t)) for i, t in [(r.doc_id, r.text) for r in odd_docs(spark).collect()])))
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == want
    assert Q.apply_rules(spark, no_docs(spark)).count() == 0


def test_repeats_overlap_at_ends(spark):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(9)]
    texts = [" ".join(x) for x in (a + b + a, a + a, ["x"] * 30, ["x"] * 8, ["x"] * 9, b + ["q"] + b[1:], a + b + a[3:] + b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:-1] for r in Q.base_columns(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.lit(1)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_order_does_not_change_the_verdict(spark):
    rows = [(i, " ".join(f"word{j}" + ("***" if i % 3 == 0 else "") for j in range(i, i + 40))) for i in range(30)]
    rows += [(100 + i, " ".join(f"LOUD{chr(65 + (i + j) % 26)}" for j in range(30))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = Q.default_rules()
    kept = [sorted(tuple(r) for r in Q.apply_rules(spark, df, x, sample_rows=20).select("doc_id", "kept").collect()) for x in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    assert {k for i, k in kept[0] if i < 100 and i % 3} == {True} and {k for i, k in kept[0] if i >= 100 or i % 3 == 0} == {False}
    order = Q.cascade_order(spark, df, rules, sample_rows=1000)
    rate = [share / s for _, s, share in order]
    assert rate == sorted(rate, reverse=True) and {r.name for r, _, _ in order} == {r.name for r in rules}


def test_plan_is_native(spark):
    plan = Q.apply_rules(spark, odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
