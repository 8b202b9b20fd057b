"""Tokens, lines, estimates and redaction as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STOP_WORDS = tuple(
    "a about across an and are be been being between did do does during for from how if in into is it its of on or that the their these this those to via was were what when where which who whom why with".split()
)
SNIPPET_STOP_WORDS = tuple("a an and are do does for from how in is of on or the to what where which with".split())
WORD = r"[A-Za-z0-9_]+"
SUBTOKEN = r"[A-Z]+(?=[^a-z]|$)|[A-Z]?[0-9a-z]+"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def tokens(text: Column) -> Column:
    """Full-text tokens: lower-cased runs of letters and digits (an underscore separates)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@F.pandas_udf(StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """Texts without combining marks, for accent-insensitive search."""
    import unicodedata

    def fold(t: object) -> object:
        return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) if isinstance(t, str) else None

    return texts.map(fold)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def subtokens(name: Column) -> Column:
    """The parts of an identifier (snake, camel and acronyms), those of at least two characters."""
    parts = F.flatten(F.transform(F.split(name, "_"), lambda p: F.regexp_extract_all(p, F.lit(SUBTOKEN), F.lit(0))))
    return F.filter(parts, lambda p: F.length(p) >= 2)


def subtoken_set(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(subtokens(name), F.lower)))


def split_identifier(name: str) -> list[str]:
    """subtokens() of one name, for query planning."""
    return [p for part in name.split("_") for p in re.findall(SUBTOKEN, part) if len(p) >= 2]


def salient_terms(query: str) -> list:
    """A query's words that carry meaning, lower-cased, in order, once each."""
    found = [w.lower() for w in re.findall(WORD, query)]
    return list(dict.fromkeys(w for w in found if len(w) >= 3 and w not in STOP_WORDS))


def match_groups(query: str) -> list[list[str]]:
    """A query as an AND of OR-groups of phrases: each word with its identifier parts.

    Stop words are dropped unless nothing else is left; variants of one character are dropped.
    """
    words = re.findall(WORD, query)
    kept = [w for w in words if w.lower() not in STOP_WORDS] or words
    groups = ([v for v in dict.fromkeys([w.lower(), *(p.lower() for p in split_identifier(w))]) if len(v) >= 2] for w in kept)
    return [g for g in groups if g]


def token_estimate(text: Column) -> Column:
    """A chunk's tokens: a quarter of its characters, halves to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4, 0).cast("int"))


def token_floor(text: Column) -> Column:
    """A signature's or document chunk's tokens: a quarter of its characters, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def lines(text: Column) -> Column:
    """Lines by every line end of Unicode; a last empty line doesn't count."""
    parts = F.split(text, LINE_ENDS)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_windows(text: Column, size: int = 80, overlap: int = 10) -> Column:
    """Overlapping windows of lines as an array of (line_start, line_end, content); the last ends with the text."""
    step = size - min(overlap, size - 1)
    shape = "array<struct<line_start:int,line_end:int,content:string>>"

    def windows(rows: Column) -> Column:
        n = F.size(rows)
        count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        window = lambda k: F.struct(
            (k * step + 1).alias("line_start"),
            F.least(k * step + size, n).alias("line_end"),
            F.array_join(F.slice(rows, k * step + 1, F.least(F.lit(size), n - k * step)), "\n").alias("content"),
        )
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), window)).otherwise(F.array().cast(shape))

    # The lines are bound once as a lambda variable: otherwise each window would split the text again.
    return F.get(F.transform(F.array(lines(text)), windows), F.lit(0))


def signature(text: Column) -> Column:
    """The first line without an opening brace at its end."""
    return F.rtrim(F.regexp_replace(F.element_at(F.split(text, "\n"), 1), r"\{+\s*$", ""))


AWS = r"\bAKIA[A-Z\d]{16}\b"
SECRET_NAMES, SECRET_SIGNS = "password|secret|token|access[_-]?token|api[_-]?key", r"\w.:/+=-"
ASSIGNED = rf"""(?i)\b({SECRET_NAMES})\b(\s*[:=]\s*)(["']?)[{SECRET_SIGNS}]{{16,}}\3"""
KEY_BLOCK = re.compile(r"(?s)-{5}BEGIN (?P<kind>[A-Z ]*PRIVATE KEY)-{5}.*?-{5}END (?P=kind)-{5}")


@F.pandas_udf(StringType())
def redact_key_blocks(texts: pd.Series) -> pd.Series:
    """Every inner line of a private key masked; the number of lines stays."""

    def mask(m: re.Match) -> str:
        head, *inner, tail = m.group(0).split("\n")
        return "\n".join([head, *("<<redacted:private_key>>" if x.strip() else x for x in inner), tail])

    return texts.map(lambda t: KEY_BLOCK.sub(mask, t) if isinstance(t, str) else None)


def redact(text: Column) -> Column:
    """Masks access keys and assigned secrets (private key blocks: redact_key_blocks first)."""
    return F.regexp_replace(F.regexp_replace(text, AWS, "<<redacted:aws_access_key>>"), ASSIGNED, "$1$2<<redacted:secret>>")


def markdown_headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+.+$"), F.lit(0))
