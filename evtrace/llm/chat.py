r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events: `message` starts a message with a text, `delta` appends to it, `edit`
replaces it, `regenerate` starts it anew (empty unless a text comes with it), `delete` removes it. The log is
partitioned by conversation, sorted by sequence, folded to final messages in order of their first event, and
rendered: each message is `<|im_start|>role`, a newline, the text and `<|im_end|>` with a newline.

Control strings inside a text are escaped reversibly: behind the first character of one, and behind any
backslashes that already stand there, one backslash is put; reading back takes one away. Roles hold the same
escapes and theirs for newlines. The loss mask covers the assistant's texts.

Defined results: null texts and roles are empty; a null operation is `message`; an event with a null message id
is a message of its own; a delta, edit or regeneration of an unknown message starts it; an event with a null
sequence comes first; events with equal sequence and message are ordered by operation, role and text; rows that
repeat wholly are events each. A conversation with no message left has no row. Rows with a null conversation
are one conversation. Other columns, whatever their names, are ignored; an empty table gives no rows. A conversation is one row of
output, so one task holds its text; its folding happens before, message by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Strings that mark turns in this template or in other common ones.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = CONTROL[0], CONTROL[1] + "\n"
_REST = "|".join(r"\Q" + c[1:] + r"\E" for c in CONTROL)
_PLAIN, _ESCAPED = rf"([<\[])(\\*)(?=(?:{_REST}))", rf"([<\[])\\(\\*)(?=(?:{_REST}))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1$2\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # from left to right: a backslash and what follows it are one character
    parts = F.regexp_extract_all(unescape(role), F.lit(r"(?s)(\\[\\n]|[^\\]+|\\)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x == "\\\\", "\\").when(x == "\\n", "\n").otherwise(x)), "")


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of events (conv_id, sequence, message_id, op, role, text)."""
    op = F.lower(F.coalesce(F.col("op"), F.lit("message")))
    event = F.struct(F.col("sequence").cast("long").alias("sequence"), op.alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = events.select("conv_id", F.col("message_id").cast("string").alias("message_id"), event.alias("e"))
    # events without an id are messages of their own: those that are equal wholly meet in one log, and each stays one
    rows = rows.withColumn("lone", F.when(F.col("message_id").isNull(), F.xxhash64("e")))
    logs = rows.groupBy("conv_id", "message_id", "lone").agg(F.array_sort(F.collect_list("e")).alias("log"))
    start = F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("there"))

    def step(m, e):
        role = F.when(e["role"] != "", e["role"]).otherwise(m["role"])
        text = F.when(e["op"] == "delta", F.concat(m["text"], e["text"])).when(e["op"] == "delete", F.lit("")).otherwise(e["text"])
        return F.struct(role.alias("role"), text.alias("text"), (e["op"] != "delete").alias("there"))

    whole = F.array(F.struct(F.col("log")[0].alias("first"), F.aggregate("log", start, step).alias("m")))
    alone = F.transform("log", lambda e: F.struct(e.alias("first"), step(start, e).alias("m")))
    folded = logs.select("conv_id", F.explode(F.when(F.col("message_id").isNull(), alone).otherwise(whole)).alias("x")).where("x.m.there")
    return folded.select("conv_id", F.struct("x.first.sequence", "x.first.op", "x.first.role", "x.first.text").alias("place"), "x.m.role", "x.m.text")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as the log of events that a chat leaves behind; messages() gives the turns back.

    Each turn is a message under an id of its own: a draft of the whole text, to which a delta adds; then an edit cuts it
    to its first half, or, for an assistant, a regeneration to nothing, and deltas stream what is missing. Rows that
    repeat are messages each. Null turns come first; a turn is below 2^59 in size.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 59))).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("conv_id", "turn", "role").orderBy("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda step, op, said: F.struct((F.col("turn") * 8 + step).alias("sequence"), F.lit(op).alias("op"), said.cast("string").alias("text"))
    draft = [event(0, "message", F.col("text")), event(1, "delta", F.lit(" <|im_end|> and more"))]
    edited = [event(2, "edit", first), event(3, "delta", rest)]
    anew = [event(2, "regenerate", F.lit(None)), event(3, "delta", first), event(4, "delta", rest)]
    log = rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", F.array(*draft, *anew)).otherwise(F.array(*draft, *edited))))
    return log.select("conv_id", "e.sequence", F.concat_ws("|", F.col("turn").cast("string"), "role", F.col("n").cast("string")).alias("message_id"), "e.op", "role", "e.text")


def render(final: DataFrame) -> DataFrame:
    """conv_id and formatted, from final messages (conv_id, place, role, text)."""
    line = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    return final.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and turns, array<struct<role, text>>, as read from the rendered string."""
    found = F.split(F.col("formatted"), r"\Q" + END + r"\E")
    found = F.slice(found, 1, F.size(found) - 1)
    head = len(START)

    def turn(x):
        cut = F.length(F.substring_index(x, "\n", 1))
        return F.struct(unescape_role(F.substring(x, F.lit(head + 1), cut - head)).alias("role"), unescape(F.substring(x, cut + 2, F.length(x))).alias("text"))

    return formatted.select("conv_id", "formatted", F.transform(found, turn).alias("turns"))


def digests(parsed: DataFrame, learned: str = "assistant") -> DataFrame:
    """What the rendered conversations say, as counts and digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == learned), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id and formatted of every conversation in a log of events."""
    return render(messages(events))
