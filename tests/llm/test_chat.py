"""Quotations that are parts of messages, wrapped anew, announced, or of nothing that was said."""

import random
import textwrap

from quillspark.llm.chat import chat_format, conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def by_turn(rows):
    return {r.turn: r for r in rows}


def test_sentences_and_announcements(spark):
    rows = [
        (1, 0, "user", "Good morning. How are you today? The ship\nleaves at nine."),
        (1, 1, "bot", "> How are you today?\nFine, thanks."),
        (1, 2, "user", "On Monday bot wrote:\n> Fine, thanks.\n> > The ship leaves\n> > at nine.\nSo it does."),
        (1, 3, "bot", "> echo shell prompt\nOn Monday nobody wrote:\nplain words"),
        (1, 4, "user", "今天天气很好。我们去公园！"), (1, 5, "bot", "> 我们去公园！\n好"),
    ]
    d = chat_format(spark.createDataFrame(rows, SCHEMA))
    got = by_turn(d.collect())
    assert {t: (r.parent_turn, r.n_linked, r.formatted.split("\n", 1)[1], [(x.level, x.text) for x in r.unlinked]) for t, r in got.items()} == {
        0: (None, 0, rows[0][3], []), 1: (0, 1, "Fine, thanks.", []), 2: (1, 2, "So it does.", []),
        3: (None, 0, "On Monday nobody wrote:\nplain words", [(1, "echo shell prompt")]), 4: (None, 0, rows[4][3], []), 5: (4, 1, "好", []),
    }
    (whole,) = conversations(d).collect()
    assert [[x.text for x in m.unlinked] for m in whole.messages if m.turn == 3] == [["echo shell prompt"]]


def test_planted_quotes(spark):
    """Whole messages, lines, sentences and runs of sentences, wrapped anew at some width, against what was planted."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abdegiklmnoprstu") for _ in range(r.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(4, 14))).capitalize() + r.choice(".!?")
    rows, planted = [], {}
    for c in range(40):
        said = []
        for t in range(12):
            parts, text = [sentence() for _ in range(r.randint(2, 6))], ""
            if t and r.random() < 0.7:
                at = r.randrange(t)
                a = r.randrange(len(said[at]))
                quote = " ".join(said[at][a : r.randint(a + 1, len(said[at]))])
                text = "".join("> " * 1 + x + "\n" for x in textwrap.wrap(quote, r.randint(20, 70)))
                if r.random() < 0.3:
                    text = "On Friday somebody wrote:\n" + text
                planted[c, t] = at
            said.append(parts)
            rows.append((c, t, "user", text + textwrap.fill(" ".join(parts), r.randint(30, 80))))
    got = {(x.conv_id, x.turn): x for x in chat_format(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[k].parent_turn == at for k, at in planted.items()) >= 0.9 * len(planted)
    assert all(x.parent_turn is None for k, x in got.items() if k not in planted)
    assert not any(">" in x.formatted.split("\n", 1)[1] or "wrote:" in x.formatted for x in got.values())


def test_long_and_clashing(spark):
    long = " ".join(f"word{i}" for i in range(60_000)) + ". Last one of all."
    d = spark.createDataFrame([(1, 0, "user", long, "a", None), (1, 1, "bot", "> Last one of all.\nyes", "b", 1), (1, 1, "bot", "> Last one of all.\nyes", "b", 1), (None, None, None, None, None, None)], SCHEMA + ", formatted string, level int")
    got = sorted((r.turn or 0, r.parent_turn, len(r.formatted)) for r in chat_format(d).collect() if r.conv_id)
    assert got == [(0, None, len(long) + 9), (1, 0, len("<|bot|>\nyes")), (1, 0, len("<|bot|>\nyes"))]
