"""Text normalisation with the whitespace and word rules of JavaScript."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters JavaScript treats as whitespace besides the blank
_OTHER_BLANKS = (
    "\t\n\x0b\f\r\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = f"[ {_OTHER_BLANKS}]"
_UNEVEN = f"[{_OTHER_BLANKS}]|  "

_WORD = "[A-Za-z0-9_]"
_ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ws_trim(c: Column) -> Column:
    """Strip any Unicode whitespace from both ends (``trim`` alone strips only blanks)."""
    return F.trim(c, F.lit(" " + _OTHER_BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(ws_trim(c), F.lit(""))


def vendor_lower(c: Column) -> Column:
    """Vendor spelling for edit distance and external lookup."""
    return F.lower(c)


def vendor_group(c: Column) -> Column:
    """Vendor spelling for split-invoice windows."""
    return ws_trim(F.lower(c))


def vendor_key(c: Column) -> Column:
    """Vendor spelling for exact-duplicate keys: lower, blanks collapsed, trimmed."""
    name = F.lower(c)
    # most names are tidy already, and looking is cheaper than rebuilding them
    return F.trim(F.when(name.rlike(_UNEVEN), F.regexp_replace(name, f"{WS}+", " ")).otherwise(name))


def utf16_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def java_pattern(pattern: str) -> str:
    """Rewrite a pattern so that Java's engine matches it case-insensitively the
    way an ASCII-word, no-multiline engine does."""
    out = pattern.replace(r"\b", _ASCII_BOUNDARY).replace(r"\s", WS)
    out = re.sub(r"\$$", lambda _: r"\z", out)
    return "(?i)" + out


def required_text(pattern: str) -> str:
    """Lower-case letters that every match of ``pattern`` starts with, after a word boundary; empty
    if there are none to be seen. Looking for them is far cheaper than the pattern."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    found = re.match(r"\\b([a-z]+)([?*{]?)", pattern)
    return "" if not found else found[1][:-1] if found[2] else found[1]


def name_tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens of a name, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def normal_name(c: Column) -> Column:
    """Tokens joined by single blanks: the form screening lists are compared in."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
