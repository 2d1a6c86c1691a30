from collections import defaultdict

from gridseries.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segment string"


def plain(rows):
    """(conversation, perspective) -> (rendering, masked pieces)."""
    conv = defaultdict(set)
    for c, t, r, x, _ in rows:
        conv[c].add((t is not None, t or 0, r or "unknown", x or ""))
    out = {}
    for c, said in conv.items():
        for p in {r for _, _, r, _ in said} - {"system"}:
            text, own = "", []
            for _, _, r, x in sorted(said):
                name = "assistant" if r == p else r if r == "system" else f"user name={r}"
                text += f"<|im_start|>{name}\n{x}<|im_end|>\n"
                if r == p:
                    own.append(x + "<|im_end|>")
            out[c, p] = text, own
    return out


def check(spark, rows):
    parts = C.segments(spark.createDataFrame(rows, SCHEMA))
    want = plain(rows)
    got = {(r.conv_id, r.perspective): r for r in C.assemble(parts).collect()}
    assert set(got) == set(want)
    for k, (text, own) in want.items():
        assert got[k].rendering == text
        assert [text[m.start : m.end] for m in got[k].masks] == own
    for r in parts.collect():
        assert want[r.conv_id, r.perspective][0][r.char_start : r.char_end] == r.segment


def test_three_speakers_nulls_ties_and_repeats(spark):
    check(spark, [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi é", "x"), (1, 2, "bob", "yo\nyo", None), (1, 2, "ann", "tie", "x"),
                  (1, 3, "cid", "", "x"), (1, 3, "cid", "", "y"), (2, None, "ann", "first", "x"), (2, 0, None, None, "x"), (None, 5, "ann", "z", "x"),
                  (None, 4, "bob", "w", "x"), (3, 0, "system", "alone", "x"), (4, -300, "a", "early", ""), (4, 7, "b", "late", "")])


def test_one_long_conversation(spark):
    check(spark, [(9, i, f"p{i % 3}", f"turn {i}", "") for i in range(1500)])


def test_empty(spark):
    assert C.segments(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 20, raising=False)
    rows = [(None, n, f"p{i % 2}", f"turn {i}", "") for i in range(300) for n in (None, 3)] + [(1, 0, "p0", "a", "")]
    check(spark, rows)
    said = spark.createDataFrame(rows, SCHEMA).drop("segment")
    sizes = [r["count"] for r in C._runs(said).groupBy("conv_id", "chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 200  # two turn numbers of 300 turns each
