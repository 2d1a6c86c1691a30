from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridseries.llm import line_dedup

from helpers import no_docs, odd_docs


def plain(rows, ratio, least):
    """rows: (host, text); the texts without boilerplate."""
    pages, hold = Counter(h for h, _ in rows), defaultdict(int)
    for h, t in rows:
        for k in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            hold[h, k] += 1
    bad = {(h, k) for (h, k), n in hold.items() if n >= least and n > ratio * pages[h]}
    return ["\n".join(x for x in (t or "").split("\n") if (h, x.strip(" \t\r")) not in bad) for h, t in rows]


def test_equals_plain(spark):
    rows = [("a", f"menu\nbody {i}\n  menu \n\nfoot {i % 3}") for i in range(40)] + [("b", f"menu\nonly {i}") for i in range(4)]
    rows += [(None, "null host\nx"), (None, "null host\ny"), ("a", None), ("c", "same\nsame"), ("c", "same\nsame"), ("a", "menu")]
    df = spark.createDataFrame([(i, h, t, 7) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, host int")
    for ratio, least in ((0.1, 5), (0.5, 2), (0.9, 1)):
        out = line_dedup.drop_boilerplate(df, ratio=ratio, min_pages=least).orderBy("doc_id").collect()
        assert [r.text or "" for r in out] == plain(rows, ratio, least)
        assert {r.host for r in out} == {7}
        for r, (_, t) in zip(out, rows):
            assert r["__n_lines"] == len((t or "").split("\n"))
            assert r["__n_dropped"] == (0 if r.text == t else r["__n_lines"] - (len(r.text.split("\n")) if r.text else 0)) or not r.text


def test_odd_rows_and_no_rows(spark):
    out = line_dedup.drop_boilerplate(odd_docs(spark), min_pages=1, ratio=0.99)
    assert out.columns == [*odd_docs(spark).columns, "__n_lines", "__n_dropped"]
    assert out.count() == odd_docs(spark).count()
    assert line_dedup.drop_boilerplate(no_docs(spark)).count() == 0


def test_plan_has_no_python_and_no_hint(spark):
    plan = line_dedup.drop_boilerplate(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "hint" not in plan.lower()
    assert out_counts(line_dedup.boilerplate(odd_docs(spark), min_pages=1)) >= 1


def out_counts(df):
    return df.agg(F.count(F.lit(1))).first()[0]


def test_array_steps_stay_out_of_the_joins_code(spark):
    lines = [f"own {i}" for i in range(300)]
    rows = [("a", "\n".join(["menu", *lines[i::7], "menu", "foot"])) for i in range(20)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    out = line_dedup.drop_boilerplate(df, ratio=0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "AS __keep" not in plan and plan.count("array_except(") == plan.count("array_join(transform(array_except(")
    assert [r.text for r in out.orderBy("doc_id").collect()] == plain(rows, 0.5, 5)
