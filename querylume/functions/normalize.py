"""I4: literals of a statement become numbered placeholders.

This reads the text alone, without a server's lexer: quoted, dollar-quoted and numeric literals are
constants, a sign before a number belongs to it unless an operand stands before, and numbering goes on
after the highest parameter the text already has.  Identifiers, quoted or not, and comments stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def comment(depth: int) -> str:
    """A comment that holds others, as deep as this."""
    inner = f"|{comment(depth - 1)}" if depth else ""
    return rf"/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*){inner})[^*/]*+)*+\*/"


#: Text that is no literal though it may look like one: comments, quoted names, names, parameters.
KEPT = rf"--[^\n]*|{comment(6)}|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|(?i)(?<![\w$])(?![ebxn]'|u&')[a-z_\u0080-\uffff][\w$\u0080-\uffff]*|\$\d+"


def string(group: int) -> str:
    """A quoted literal, whose dollar-quote tag is the group of this number.  One that is cut off is a literal to the end, so that none of it shows."""
    return r"(?i:e)'[^'\\]*+(?:(?:\\(?s:.)|'')[^'\\]*+)*+(?:'|\z)|(?i:[bxn]|u&)?'[^']*+(?:''[^']*+)*+(?:'|\z)|\$((?:[a-zA-Z_\u0080-\uffff][\w\u0080-\uffff]*)?)\$(?s:.*?)(?:\$" + f"\\{group}" + r"\$|\z)"


DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"(?:(?<=[(,=<>+*/%|\[]|[(,=<>+*/%|\[]\s|^)-\s?)?(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?)"
LIST = r"(?i)\bIN\s*\(\s*(\$\d+)(?:\s*,\s*\$\d+)+\s*\)"
#: From the end of the match before up to a literal and over it.  The part before it, group 1, is taken token by token,
#: so that a literal within a comment or a name is none; its loop gives nothing back, so Java runs it without recursion.
TO_LITERAL = rf"\G((?:{KEPT}|(?!{string(2)}|{NUMBER})(?s:.))*+)(?i:{string(3)}|{NUMBER})"
#: Mark that stands for a literal between the two steps.
MARK = "\u0001"


def normalize(text: Column, squash: bool = False) -> Column:
    """`text` with each literal as $N; `squash` writes a list of constants in IN as its first and a comment."""
    parts = F.split(F.regexp_replace(text, TO_LITERAL, f"$1{MARK}"), MARK, -1)
    highest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\$(\d+)"), F.lit(1)), lambda d: d.try_cast("int"))), F.lit(0))
    numbered = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("$"), (highest + i).cast("string"), p))), "")
    return F.regexp_replace(numbered, LIST, "IN ($1 /*, ... */)") if squash else numbered


def normalized(df: DataFrame, column: str = "query_text") -> DataFrame:
    return df.withColumn(column, normalize(F.col(column)))
