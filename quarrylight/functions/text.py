"""Three units of length: UTF-8 bytes, code points and UTF-16 units; and the line model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def lines(text: Column) -> Column:
    """Lines end at LF; a final LF adds none, and an empty text has none."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def literal_pattern(query: str) -> str:
    """A regular expression that matches exactly ``query``, for both Java and RE2."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in query)


def clip(s: Column, most: int) -> Column:
    """The first ``most`` code points."""
    return F.substring(s, 1, most)


def displayed(s: Column) -> Column:
    """Control characters other than tab as visible escapes; backslashes doubled first."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    for code in [*range(0, 9), 11, 12, *range(14, 32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def utf8_prefix(s: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that splits no character."""
    data = F.encode(s, "UTF-8")
    # a byte of the form 10xxxxxx goes on with a character that began before
    goes_on = lambda n: F.hex(F.substring(data, n + 1, 1)).rlike("^[89AB]")
    n = F.when(~goes_on(most), most)
    for back in range(1, 4):
        if most - back >= 0:
            n = n.when(~goes_on(most - back), most - back)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.decode(F.substring(data, F.lit(1), n.otherwise(0)), "UTF-8"))
