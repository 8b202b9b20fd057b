"""Snippet skeletons: signatures, headings and keys stay, bodies become a marker with the lines to read."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from rootweave.functions import paths as P
from rootweave.functions import text as T
from rootweave.operators import parse

SHAPE = StructType([StructField("text", StringType()), StructField("token_est", IntegerType()), StructField("elided_lines", IntegerType()), StructField("skeletonized", BooleanType())])
_DATA = {"ini", "json", "toml", "yaml"}
_HEAD = re.compile(r"\s{,3}#{1,6}(?=\s)")


def body_begin(rows: list[str], first: int, last: int, lang: str) -> int:
    """The row after a signature, which may run over a few rows before its body opens."""
    for k in range(first, min(last, first + 5) + 1):
        bare = rows[k].strip()
        if ("{" in bare) if lang in parse.BRACES else bare.endswith(":"):
            return k + 1
    return first + 1


def kept_rows(content: str, lang: str | None) -> list[bool]:
    """Which rows carry the shape of a snippet; all of them where that isn't known."""
    rows = content.split("\n")
    if lang == "markdown":
        keep = [False] * len(rows)
        for k in (k for k, r in enumerate(rows) if _HEAD.match(r)):
            keep[k] = True
            if (after := next((j for j in range(k + 1, len(rows)) if rows[j].strip()), None)) is not None:
                keep[after] = True
        return keep
    if lang in _DATA:
        return [not (s := r.strip()) or re.fullmatch(r"[{\[]?[}\]]|[{\[]|[}\]],", s) is not None or (s[0] == "[" and s[-1] == "]") or ":" in s or "=" in s for r in rows]
    symbols = parse.parse_text("", lang, content)["symbols"] if lang in P.CODE else []
    keep = [True] * len(rows)
    shown = [(s["line_start"] - 1, min(s["line_end"], len(rows)) - 1, s["kind"]) for s in symbols if s["line_start"] <= len(rows)]
    for lo, hi, kind in shown:
        if kind in ("function", "method"):
            for k in range(body_begin(rows, lo, hi, lang or ""), hi + 1):
                keep[k] = False
    for lo, hi, _ in shown:
        for k in range(lo, body_begin(rows, lo, hi, lang or "")):
            keep[k] = True
    return keep


def render(content: str, keep: list[bool], first_line: int) -> tuple[str, int]:
    """The kept rows, each maximal run of others as one marker; and how many rows went."""
    out: list[str] = []
    begin: int | None = None
    rows = content.split("\n")
    for k, (row, kept) in enumerate([*zip(rows, keep), ("", True)]):
        if not kept:
            begin = k if begin is None else begin
            continue
        if begin is not None:
            out.append(f"... {k - begin} lines elided (read {first_line + begin}-{first_line + k - 1})")
            begin = None
        if k < len(rows):
            out.append(row)
    return "\n".join(out), keep.count(False)


def skeleton(content: str | None, lang: str | None, first_line: int, around: int, terms: list[str], min_reduction: float) -> tuple[str | None, int, int, bool]:
    """(text, tokens, rows left out, whether it is a skeleton); rows with a query term stay, with some around them."""
    raw = (content, parse.estimate(content or ""), 0, False)
    if not content or not content.strip():
        return raw
    keep = kept_rows(content, lang)
    rows = content.lower().split("\n")
    for k, row in enumerate(rows):
        if any(t in row for t in terms):
            keep[max(0, k - around) : k + around + 1] = [True] * (min(len(rows), k + around + 1) - max(0, k - around))
    if all(keep):
        return raw
    text, gone = render(content, keep, first_line)
    cost = parse.estimate(text)
    return raw if cost > raw[1] * (1 - min_reduction) else (text, cost, gone, True)


def compact(content: Column, path: Column, first_line: Column, around: int, query: str, min_reduction: float = 0.25) -> Column:
    """skeleton() of a page's snippets."""
    terms = list(dict.fromkeys(w.lower() for w in re.findall(T.WORD, query) if len(w) >= 3 and w.lower() not in T.SNIPPET_STOP_WORDS))

    @F.pandas_udf(SHAPE)
    def run(c: pd.Series, lang: pd.Series, first: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([skeleton(x, y, int(z), around, terms, min_reduction) for x, y, z in zip(c, lang, first)], columns=["text", "token_est", "elided_lines", "skeletonized"])

    return run(content, P.language(path), first_line)
