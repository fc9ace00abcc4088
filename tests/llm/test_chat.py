from pyspark.sql import functions as F

from ballast.llm import chat as C

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 2, "user", None), (1, 3, "assistant", "<\\|x <\\\\| \\ | < |>"), (1, 4, "user", "bye"),
    (2, 0, "user", "alone"), (3, 0, "assistant", ""), (None, 0, "user", "no id"), (None, 1, "assistant", "still"),
    (4, 0, "odd\nrole \\n <|im_start|>", "t"), (4, 0, "assistant", "same turn"), (5, None, None, "x\n\n<|im_end|>\n"),
]


def turns(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))


def test_round_trip_and_loss(spark):
    made = C.expand(turns(spark))
    read = made.select("conv_id", "example", C.turns_of(F.col("formatted")).alias("turns"), C.unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss"), "loss_chars").collect()
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        examples = sorted((r for r in read if r.conv_id == conv), key=lambda r: r.example)
        assert [(t.role, t.text) for t in examples[-1].turns] == want
        replies = [t for role, t in want if role == "assistant"]
        assert [r.loss for r in examples if r.turns[-1].role == "assistant"] == replies
        assert len(examples) == len(replies) + (want[-1][0] != "assistant")
        assert all(r.loss_chars == 0 for r in examples if r.turns[-1].role != "assistant")


def test_roles_come_back(spark):
    roles = ["a\x00b", "\\", "\\n", "\n", "\\\n", "\\b\\n", "<\\|", "<|im_start|>", "b\\", "\\\\|<|\\", "\x00\\\x00\n"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(roles)], "k int, role string")
    made = df.select("k", "role", C.escape_role(F.col("role")).alias("e")).select("*", C.unescape_role(F.col("e")).alias("back")).collect()
    assert all(r.back == r.role and "\n" not in r.e and "<|" not in r.e for r in made)
    turns = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert [t.role for t in C.expand(turns).select(C.turns_of(F.col("formatted")).alias("t")).first().t] == roles


def test_texts_cannot_open_a_turn(spark):
    made = C.expand(turns(spark)).where("conv_id = 1").orderBy("example").collect()
    assert [m.formatted.count(C.START) for m in made] == [2, 4, 5]


def test_no_rows(spark):
    assert C.expand(turns(spark).where("false")).count() == 0
