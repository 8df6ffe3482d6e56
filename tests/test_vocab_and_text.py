from __future__ import annotations

from pyspark.sql import functions as F

from loomcanvas.functions import text as X
from loomcanvas.functions import vocab as V


def decomposed(n: int) -> list[int]:
    out, sign, n = [], 1 if n >= 0 else -1, abs(n)
    for a in reversed(V.AMOUNTS):
        while n >= a:
            out.append(sign * a)
            n -= a
    return out


def test_decomposition_adds_up(spark):
    for n, parts in spark.range(-2500, 2501).select(F.col("id").cast("int").alias("n")).select("n", V.decompose(F.col("n"))).collect():
        assert parts == decomposed(n)


def test_moves_and_kinds(spark):
    ids = [-1, 0, 50255, 50256, 50257, 50258, 50259, 50260, 50261, 50262, 50280, 50281, 50290]
    rows = spark.createDataFrame([(i,) for i in ids], "t int").select("t", V.move_amount(F.col("t")), *[V.kind(F.col("t"), r) for r in ("module", "tokenizer", "stats")], V.move_id(V.move_amount(F.col("t")))).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert got[50261][0] == 1 and got[50262][0] == -1 and got[50280][0] == -512 and got[50281][0] is None
    assert [got[i][1] for i in ids] == ["other", "insert", "insert", "other", "other", "other", "delete", "end_of_response", "move", "move", "move", "other", "other"]
    assert got[50281][2] == "insert" and got[-1][3] == "insert" and got[50256][3] == "insert" and got[50256][2] == "other"
    assert all(got[i][4] == i for i in (50261, 50262, 50280))


def test_prefix_rules(spark):
    df = spark.createDataFrame([(9, list(range(20))), (None, list(range(20))), (None, [1, 2, 50261, 3]), (None, [])], "given int, a array<int>")
    fixed = [r[0] for r in df.select(V.prefix_length(F.col("a"), F.col("given"), fixed=4, most=5)).collect()]
    inferred = [r[0] for r in df.select(V.prefix_length(F.col("a"), F.col("given"), infer=True)).collect()]
    assert fixed == [5, 4, 4, 0] and inferred == [9, 20, 2, 0]


def test_shift_mask_pad(spark):
    row = spark.createDataFrame([([5, 6, 7],)], "a array<int>").select(V.shift_inputs(F.col("a")), V.mask_labels(F.col("a"), F.lit(2)), V.pad(F.col("a"), 5, 0), V.pad(F.col("a"), 2, 0)).first()
    assert list(row) == [[50258, 5, 6], [-100, -100, 7], [5, 6, 7, 0, 0], [5, 6]]


def test_text_functions(spark):
    df = spark.createDataFrame([("A\tb\nC  d", "  ", "x"), ("", None, "y"), (None, "p", None)], "a string, b string, c string")
    got = df.select(X.words(F.col("a")), X.split_words(F.col("a")), X.first_filled("b", "c"), X.cut_middle(F.lit("abcdefgh"), 4), X.one_line(F.lit("a\nb")), X.strip_prompt(F.lit("promptrest"), F.lit("prompt"))).collect()
    assert got[0][0] == ["a\tb", "c", "d"] and got[0][1] == ["A", "b", "C", "d"] and got[0][2] == "x" and got[0][3] == "ab … gh" and got[0][4] == "a\\nb" and got[0][5] == "rest"
    assert got[1][0] == [] and got[2][0] is None and got[2][2] == "p" and got[1][2] == "y"
    clean = spark.range(1).select(X.clean_prompt(F.lit("Rank #3 x | prompt+response\n\nPrompt:\nHello\n")), X.repair_quotes(F.lit("canâ€™t")), X.move_in_text(F.lit("[MOVE_-4]")), X.lenient_int(F.lit(" 3.0 ")), X.lenient_double(F.lit("x"))).first()
    assert list(clean) == ["Hello", "can't", -4, 3, None]
