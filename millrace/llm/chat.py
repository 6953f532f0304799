"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its own text is trainable. Turns that follow the last reply, or
a conversation without any, give one more example without a target, so that the
output holds every turn.

A turn reads ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a
backslash is doubled, and a control string gets a backslash after its first
character. No escaped text holds a control string, and both steps can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

#: The template's marks, and other strings that models take as control.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undo ``escape``: a control string's first character is followed by a run of
    one backslash where it was escaped, and else by an even number of them."""
    out = text
    for c in reversed(CONTROL):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length, n_turns), one row for each example.

    The loss mask is the ``loss_length`` code points from ``loss_start`` (0-based):
    the escaped text of the last turn. It is null for an example without a target.
    Turns are ordered by number, null first, then role and text; rows that repeat
    are turns of their own. Null roles and texts are empty. A null conversation id
    is a conversation. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # Each turn is escaped once, before the conversation is expanded.
    escaped = F.transform("turns", lambda x: F.struct((x["role"] == target_role).alias("target"), F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)).alias("head"), escape(x["text"]).alias("text")))
    chats = chats.select("conv_id", n.alias("n_turns"), escaped.alias("turns"))
    # Examples end at every target turn, and at the last turn in any case. Only the ends
    # are expanded: a prefix is built in its own row, so no row holds more than one.
    ends = F.filter(F.sequence(F.lit(1), F.col("n_turns")), lambda i: F.element_at("turns", i)["target"] | (i == F.col("n_turns")))
    found = chats.select("conv_id", "n_turns", "turns", F.posexplode(ends).alias("example", "last"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("last")), lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
    last = F.element_at("turns", F.col("last"))
    length = F.length(last["text"])
    made = lambda t: F.struct(t.alias("text"), F.when(last["target"], F.length(t) - len(END) - length).alias("loss_start"), F.when(last["target"], length).alias("loss_length"))
    return found.select("conv_id", "example", let(text, made).alias("made"), "n_turns").select("conv_id", "example", "made.text", "made.loss_start", "made.loss_length", "n_turns")


def read_turns(text: Column) -> Column:
    """The turns of an example's text, read back: array of (role, text)."""
    bodies = F.filter(F.split(text, r"\Q" + TURN + r"\E"), lambda _, i: i > 0)

    def turn(body: Column) -> Column:
        role = F.substring_index(body, TEXT, 1)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substring(body, F.length(role) + F.lit(1 + len(TEXT)), F.length(body) - F.length(role) - F.lit(len(TEXT) + len(END)))).alias("text"),
        )

    return F.transform(bodies, turn)


def digest(examples: DataFrame) -> DataFrame:
    """What a conversation's examples hold, read back from their texts.

    The last example has all turns. The loss text is the unescaped text under each
    example's mask, in order, with nothing between.
    """
    # Reading back the turns takes the last example alone; the others give their loss text.
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_length")))).otherwise(F.lit(""))
    rows = examples.select("conv_id", "example", F.length("text").alias("chars"), loss.alias("loss"), "text")
    found = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.max_by("text", "example").alias("text"),
    )
    loss_text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    said = lambda turns: F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = let(read_turns(F.col("text")), lambda turns: F.struct(F.size(turns).cast("long").alias("n_turns"), F.sha2(said(turns), 256).alias("turns_sha256")))
    heard = let(loss_text, lambda t: F.struct(F.length(t).cast("long").alias("loss_chars"), F.sha2(t, 256).alias("loss_sha256")))
    done = found.select("conv_id", read.alias("read"), heard.alias("heard"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
    return done.select("conv_id", "read.n_turns", "read.turns_sha256", "heard.loss_chars", "heard.loss_sha256", "formatted_chars")


def oracle(more: str = "", target_role: str = "assistant") -> str:
    """``digest`` of the formatted ``conversations``, for DuckDB; ``more`` are further rows in SQL."""

    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for x in CONTROL:
            out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
        return out

    order = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations {more}),
o AS (SELECT *, row_number() OVER ({order}) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             sum({len(TURN + TEXT + END)} + length({escaped("role")}) + length({escaped("text")})) OVER ({order} ROWS UNBOUNDED PRECEDING) AS prefix FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{target_role}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{target_role}' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = '{target_role}' OR i = n THEN prefix ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""
