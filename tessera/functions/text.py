"""Scalar functions on codes, names and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Null reads as empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def packed(c: Column) -> Column:
    """A code without spaces."""
    return F.regexp_replace(text(c), r"\s", "")


def folded(c: Column) -> Column:
    """A code without spaces, lower-cased."""
    return F.lower(packed(c))


def labelled(c: Column, name: str) -> Column:
    """A default label for a missing group key."""
    return F.coalesce(F.nullif(text(c), F.lit("")), F.lit(name))


def normal_name(c: Column) -> Column:
    """lower-cased, each run of other than letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^0-9a-z]+", " "))


def stem(c: Column, mark: str = ".") -> Column:
    """text before the last mark; whole without one."""
    at = F.length(c) - F.length(F.substring_index(c, mark, -1)) - len(mark)
    return F.when(F.instr(c, mark) > 0, F.substring(c, F.lit(1), at)).otherwise(c)


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def letters(c: Column) -> Column:
    """the leading letters, upper-cased."""
    return F.upper(F.regexp_extract(c, "^[A-Za-z]+", 0))


def digits(c: Column) -> Column:
    """F7."""
    return F.regexp_replace(c, r"[^0-9]", "")


def trimmed_code(c: Column) -> Column:
    """without trailing 00 pairs, never below two digits."""
    return F.regexp_replace(c, "(?<=..)(?:00)+$", "")


def utf16_length(c: Column) -> Column:
    """F9."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def short_digest(c: Column, n: int = 12) -> Column:
    """F11."""
    return F.substring(F.sha2(c, 256), 1, n)


def phase(c: Column) -> Column:
    """1, 2, 3 or r; null for anything else."""
    return F.when(F.lower(F.trim(c)).isin("1", "2", "3", "r"), F.lower(F.trim(c)))


def three_pairs(c: Column) -> Column:
    """F8: a code of pairs filled with zeros to three of them."""
    return F.when(F.length(c) < 6, F.rpad(c, 6, "0")).otherwise(c)


def counted(n: Column, word: str) -> Column:
    """a number with its word, in the plural but for one."""
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def in_range(first: Column, start: Column, end: Column) -> Column:
    """1 <= first <= start <= end."""
    return (first >= 1) & (first <= start) & (start <= end)


def glob(pattern: str) -> str:
    """A case-sensitive glob (*, ?, [..], [!..]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "(?s:.*)"
        elif ch == "?":
            out += "(?s:.)"
        elif ch == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += "\\" + ch if ch in r"\.^$|()[]{}+*?-&" else ch
        i += 1
    return f"^{out}$"
