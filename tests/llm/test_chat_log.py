"""Turns through a log of drafts, edits, regenerations and deltas, and back."""

from collections import Counter

from evtrace.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hello\nthere"), (1, 1, "assistant", "<|im_end|> \\ [INST] é\U0001f600x"), (1, 1, "assistant", ""), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, 2, "tool", "y"), (1, 2, "assistant", "same half a"), (1, 2, "assistant", "same half b"),
    (2, None, "user", None), (2, 5, None, "t"), (2, -4, "assistant", None), (None, 0, "user", "n"),
]


def test_messages_are_the_turns(spark):
    log = chat.log_of_turns(spark.createDataFrame(ROWS, TURNS).repartition(3))
    assert log.where("op in ('delta', 'edit', 'regenerate')").count() > 2 * len(ROWS)
    final = chat.messages(log).collect()
    assert Counter((r["conv_id"], r["role"], r["text"]) for r in final) == Counter((c, r or "", t or "") for c, _, r, t in ROWS)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(log)).collect()}
    order = lambda c: [(r or "", t or "") for _, _, r, t in sorted((x for x in ROWS if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
    assert back == {c: order(c) for c in (1, 2, None)}


def test_no_turns(spark):
    assert chat.format_chats(chat.log_of_turns(spark.createDataFrame([], TURNS))).count() == 0
