"""Relational chat formatting: sort turn structs, merge neighbours of one role, concatenate; read back again.

Template, for each run of turns of one role:  `### role:\\n` text (`<part>` text)* `</turn>\\n`.
Inside roles and texts a backslash, `#`, `<` and `:` become `\\b`, `\\h`, `\\l` and (roles only) `\\c`.
So no text can hold a mark, every backslash starts one of these pairs, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, PART, CLOSE = "### ", ":\n", "<part>", "</turn>\n"


def replaced(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(x: Column) -> Column:
    return replaced(replaced(replaced(x, "\\", "\\b"), "#", "\\h"), "<", "\\l")


def unescape(x: Column) -> Column:
    return replaced(replaced(replaced(x, "\\l", "<"), "\\h", "#"), "\\b", "\\")


def escape_role(x: Column) -> Column:
    return replaced(escape(x), ":", "\\c")


def unescape_role(x: Column) -> Column:
    return unescape(replaced(x, "\\c", ":"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and formatted, one row a conversation.

    Turns are ordered by turn, then role, then text; null turns come first.  A null role or text is empty.
    Repeated rows are turns of their own.  Rows with a null conv_id form one conversation.  Other columns
    are ignored; an empty table gives no rows.  A conversation is one output string, so it is what a task
    must hold; turns are escaped only once they are in order, as escaping changes the order of texts.
    """
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(
            conversations["turn"].cast("long").alias("turn"),
            F.coalesce(conversations["role"], F.lit("")).alias("role"),
            F.coalesce(conversations["text"], F.lit("")).alias("text"),
        ).alias("turn"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    merged = ordered.select("conv_id", safe.alias("turns")).select("conv_id", runs_of(F.col("turns")).alias("runs"))
    pieces = F.transform("runs", lambda r: F.concat(F.lit(OPEN), r["role"], F.lit(HEAD_END), F.array_join(r["texts"], PART), F.lit(CLOSE)))
    return merged.select("conv_id", F.array_join(pieces, "").alias("formatted"))


def runs_of(turns: Column) -> Column:
    """Neighbouring turns of one role as one struct of role and texts.

    The places where the role changes bound the runs, so the texts are sliced once instead of being
    appended turn by turn.
    """
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(turns, s)["role"].alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - s), lambda t: t["text"]).alias("texts"),
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and turns: the array of (role, text, masked) that the formatted string holds.

    `masked` marks what the loss is taken over: the texts of assistant turns.
    """
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.regexp_extract(b, "^### ([^:]*):\n", 1)).alias("role"),
            F.split(F.regexp_replace(b, "^### [^:]*:\n", ""), PART).alias("parts"),
        ),
    )
    turns = F.flatten(F.transform(parsed, lambda r: F.transform(r["parts"], lambda p: F.struct(r["role"].alias("role"), unescape(p).alias("text"), (r["role"] == "assistant").alias("masked")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def round_trip_digest(read: DataFrame) -> DataFrame:
    """Counts and digests of what read_back() found."""
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["masked"]), lambda t: t["text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), said.alias("said")).select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("told", "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"),
        F.sha2(F.encode("said", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
