"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn becomes a piece: its text between the marks of its role. Every assistant turn becomes an example of its own whose
text is all pieces before it and its own piece, and whose loss mask covers that one reply. Marks that occur inside texts
are escaped, so the turns can be read back from an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGET = "assistant"
#: Marks before and after a turn of a known role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), TARGET: ("<s>", "</s>")}
#: Any other role stands in the piece itself: mark, role, mark, text, mark.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")

#: The first character of a mark, backslashes, the rest of the mark. Marks never overlap, so a backslash put in or taken out
#: behind the first character touches one mark only: escaping can be undone, and what is escaped holds no mark.
_REST = r"<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\]"
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])(\\*)\\({_REST})"
PIECE = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE\])(.*?)(?:<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _pieces(conversations: DataFrame) -> DataFrame:
    """``conv_id, n, role, piece, body, end``: the numbered pieces, where their text starts inside them, and the end of each in
    the conversation's formatted text, in code points."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role = F.col("role")
    mark = lambda at: F.coalesce(*[F.when(role == r, F.lit(m[at])) for r, m in MARKS.items()])
    head = F.coalesce(mark(0), F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])))
    tail = F.coalesce(mark(1), F.lit(OTHER[2]))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # Numbered first, formatted after: the shuffle carries each text once.
    made = turns.withColumn("n", F.row_number().over(order)).withColumn("piece", F.concat(head, escaped(F.col("text")), tail))
    upto = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return made.select("conv_id", "n", "role", "piece", F.length(head).alias("body"), F.length(tail).alias("tail"), upto.alias("end"))


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end, last``: one row per assistant turn.

    ``text`` holds all turns before it and the reply; the mask ``[loss_start, loss_end)`` counts code points and covers the
    escaped reply alone. A conversation that does not end with a reply has one more example with all its turns and an empty
    mask (nulls), so ``last``, the one that holds the whole conversation, exists for each. Turns stand by ``turn`` (null
    first), then role, then text. Null roles and texts are empty; rows without a ``conv_id`` are one conversation.
    A conversation is the unit of output: it is held as one text, its examples are cut from it one by one.
    """
    turn = F.struct("n", "role", "piece", "body", "tail", "end")
    whole = _pieces(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.size("turns").alias("n_turns"), F.transform(
        "turns", lambda t: F.struct(t["n"].alias("n"), t["role"].alias("role"), (t["end"] - F.length(t["piece"]) + t["body"]).alias("start"), (t["end"] - t["tail"]).alias("stop"), t["end"].alias("end")),
    ).alias("turns"))
    cut = whole.select("conv_id", "formatted", "n_turns", F.posexplode(F.filter("turns", lambda t: (t["role"] == TARGET) | (t["n"] == F.col("n_turns")))).alias("at", "t"))
    target = F.col("t.role") == TARGET
    return cut.select(
        "conv_id", (F.col("at") + 1).cast("long").alias("example"), F.substring("formatted", F.lit(1), F.col("t.end").cast("int")).alias("text"),
        F.when(target, F.col("t.start")).alias("loss_start"), F.when(target, F.col("t.stop")).alias("loss_end"), (F.col("t.n") == F.col("n_turns")).alias("last"),
    )


def turns_of(text: Column) -> Column:
    """The turns of an example's text as ``array<struct<role, text>>``."""
    marks = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(PIECE), F.lit(2))

    def turn(mark: Column, body: Column) -> Column:
        known = F.coalesce(*[F.when(mark == m[0], F.lit(r)) for r, m in MARKS.items()])
        role = F.substring_index(body, OTHER[1], 1)
        rest = F.substring(body, F.length(role) + len(OTHER[1]) + 1, F.length(body))
        return F.struct(F.coalesce(known, unescaped(role)).alias("role"), unescaped(F.when(known.isNotNull(), body).otherwise(rest)).alias("text"))

    return F.zip_with(marks, bodies, turn)


def masked(text: str = "text") -> Column:
    """The unescaped text under the loss mask; empty without one."""
    inside = F.substring(text, (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return F.coalesce(unescaped(inside), F.lit(""))


def report(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per conversation, read back from its examples.

    Turns are parsed out of the last example, replies are taken from the mask of each; ``formatted_chars`` is the length of all
    examples. Both digests are of single strings, so a conversation's own texts meet in one row; contexts do not.
    An empty table gives an empty result.
    """
    read = examples(conversations).select(
        "conv_id", "example", masked().alias("reply"), F.length("text").cast("long").alias("chars"), F.when(F.col("last"), turns_of(F.col("text"))).alias("turns"),
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.select("conv_id", "example", "reply", "chars", F.size("turns").alias("n"), F.sha2(F.array_join(line, ""), 256).alias("sha"))
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"]), "")
    met = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), replies.alias("replies"), F.sum("chars").alias("formatted_chars"),
    )
    return met.select(
        "conv_id", "n_turns", "turns_sha256", F.length("replies").cast("long").alias("loss_chars"), F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars",
    )
