import pytest

from driftwarden.llm import quotes

TALK = [
    ("c", 0, "Hello all.\nShall we meet on Monday?\nBest"),
    ("c", 1, "On Tuesday, A wrote:\n> Shall we  MEET on monday?\n\nI can't."),
    ("c", 2, "> Hello all.\nFine with me."),
    ("c", 3, ">> Shall we meet on Monday?\n> I can't.\nWhy not?"),
    ("c", 4, "> never said\nOdd."),
    ("d", 0, "I can't."),
    ("d", 7, ">I can't.\n> Why not?\nSee above."),
]


def run(messages, layout="window"):
    rows = quotes.reply_ordered(messages, layout=layout).collect()
    return {(r.conv_id, r.turn): r for r in rows}, rows


@pytest.mark.parametrize("layout", ["window", "split"])
def test_links(spark, layout):
    found, _ = run(spark.createDataFrame(TALK, "conv_id string, turn long, text string"), layout)
    assert {k: r.reply_to for k, r in found.items()} == {
        ("c", 0): None, ("c", 1): 0, ("c", 2): 0, ("c", 3): 1, ("c", 4): 3, ("d", 0): None, ("d", 7): 0
    }
    assert {k: r.linked for k, r in found.items()} == {
        ("c", 0): False, ("c", 1): True, ("c", 2): True, ("c", 3): True, ("c", 4): False, ("d", 0): False, ("d", 7): True
    }
    assert found["c", 1].text == "I can't." and found["c", 3].text == "Why not?" and found["c", 0].text == TALK[0][2]
    assert [found["c", t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert [found["c", t].position for t in range(5)] == [1, 2, 3, 4, 5]
    assert (found["c", 3].n_quotes, found["c", 3].n_linked) == (2, 2)
    assert (found["c", 4].n_quotes, found["c", 4].n_linked) == (1, 0)


@pytest.mark.parametrize("layout", ["window", "split"])
def test_odd_rows(spark, layout):
    rows = [
        ("c", 0, None, 1), ("c", 1, "", 2), ("c", 1, "twice", 3), ("c", 1, "twice", 3), ("c", None, "> x\nno turn", 4),
        (None, 3, "no conversation", 5), (None, 4, "> no conversation\nyes", 6), ("e", 2, "\n".join([">" * 300 + " deep"] * 500), 7),
    ]
    messages = spark.createDataFrame(rows, "conv_id string, turn long, text string, depth int").selectExpr("*", "'k' AS conv", "1 AS row")
    found, every = run(messages, layout)
    assert len(every) == len(rows)
    assert found[None, 4].reply_to == 3 and found[None, 4].linked and found[None, 4].text == "yes"
    assert found["c", None].position is None and found["c", None].text == "no turn"
    assert found["c", 0].text == "" and found["c", 1].reply_to == 0 and found["e", 2].text == ""
    assert {"conv", "row"} <= set(messages.columns) and every[0].conv == "k"
    assert run(messages.limit(0), layout)[1] == []


def test_long_chains_end(spark):
    rows = [("c", t, f"message {t}") for t in range(500)]
    found, _ = run(spark.createDataFrame(rows, "conv_id string, turn long, text string"))
    assert found["c", 499].depth == 499 and found["c", 499].root == 0


def test_passage_goes_to_the_message_that_wrote_most_of_it(spark):
    rows = [
        # A frequent line alone doesn't decide.
        ("a", 0, "Hello all.\nShall we meet Monday?\nBest"), ("a", 1, "No.\nBest"),
        ("a", 2, "> Hello all.\n> Shall we meet Monday?\n> Best\nYes."),
        # Other line breaks, a part of a message, and the latest of equal ones.
        ("b", 0, "one two three four five six seven eight nine ten eleven twelve"), ("b", 1, "Something else."),
        ("b", 2, "> one two three four five\n> six seven eight nine ten eleven\n> twelve\nRight."),
        ("b", 3, "> Something\n> else.\nSo?"), ("b", 4, "Something else."), ("b", 5, "> Something else.\nWhat?"),
        # Put together from several messages.
        ("c", 0, "First of all.\nThis is long enough to be the most of it by far.\nBye"), ("c", 1, "Yes.\nBye"), ("c", 2, "First of all."),
        ("c", 3, "> First of all.\n> Yes.\n> This is long enough to be the most of it by far.\n> Bye\nSo."),
        (None, 0, "Hello all.\nBest"), (None, 1, "Best"), (None, 2, "> Hello all.\n> Best\nYes."),
    ]
    found, _ = run(spark.createDataFrame(rows, "conv_id string, turn long, text string"))
    want = {("a", 2): 0, ("b", 2): 0, ("b", 3): 1, ("b", 5): 4, ("c", 3): 0, (None, 2): 0}
    assert {k: found[k].reply_to for k in want} == want and all(found[k].linked for k in want)
