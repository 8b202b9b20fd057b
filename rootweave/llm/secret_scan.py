"""Secret scanning by token efficiency.

A vocabulary learned from prose spends many tokens on a random string: few characters a token mark
credentials, keys and passwords without a list of their formats. Candidates are the maximal runs of
at least `min_chars` of the signs [A-Za-z0-9+/_-] with a letter or digit among them, with up to two = behind
them; they are found by array operations on whole blocks, and only they are encoded.
A candidate is a secret if it has at most `max_ratio` characters a token (without digits and changes
from lower to upper case also in lower case, as capitals alone make words cost tokens), unless it is known to be harmless: a UUID, a digest (hexadecimal of 32, 40, 56, 64, 96 or 128 digits), a number (digits and
separators alone) or one of `known`. No form excuses a string that is assigned to a secret's name (`token = "..."`, `password: ...`).
Of a candidate over the ratio the parts between its separators + / _ - are tested in the same way, so that the words of
a path or a slug don't hide a secret.

Cases. Null and empty texts have no findings. Repeated rows and repeated strings are each reported.
Null ids are passed through. Texts are scanned whole; a run of any length is one candidate. An empty
table gives no rows. Findings carry the secret's SHA-256 and place, never its characters. redact()
passes all columns through, whatever their names, and changes only the text (and n_chars, where the
table has it and the text changed).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm import textkit as tk
from rootweave.llm.common import batched
from rootweave.llm.token_count import VOCABULARY, encoding

MIN_CHARS = 16
MAX_RATIO = 2.5
MASK = "<secret>"

_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_NAMED = re.compile(r"(?i)(?:key|secret|token|passw(?:or)?d|passwd|pwd|bearer|credentials?|auth)[\"']?\s{0,8}(?:[:=]|:=|=>|\s)\s{0,8}[\"']?$")
_PART = re.compile(f"{_UUID.pattern}(?![0-9A-Za-z])|[0-9A-Za-z]+=*")
_LETTER = re.compile(r"[A-Za-z]")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
_UPPER, _LOWER, _DIGIT, _SIGN = 1, 2, 4, 8


@cache
def _signs() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    out[65:91], out[97:123], out[48:58] = _UPPER, _LOWER, _DIGIT
    out[[ord(c) for c in "+/_-"]] = _SIGN
    return out


def candidates(texts: list[str | None], min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of every run with a letter or digit."""
    for lo, hi in tk.blocks(texts):
        cp, bounds, _ = tk.code_points(texts[lo:hi])
        kind = _signs()[cp]
        begin, end = tk.run_spans(kind > 0, bounds)
        long = end - begin >= min_chars
        begin, end = begin[long], end[long]
        if not len(begin):
            continue
        size = end - begin
        first = tk.offsets_of(size)
        inside = kind[np.repeat(begin - first[:-1], size) + np.arange(first[-1])]
        has = np.bitwise_or.reduceat(inside, first[:-1])
        wanted = has != _SIGN
        doc = np.searchsorted(bounds, begin, "right") - 1
        stop = bounds[doc + 1]
        for _ in range(2):  # padding
            end = end + ((end < stop) & (cp[np.minimum(end, len(cp) - 1)] == 61))
        for k in np.flatnonzero(wanted).tolist():
            yield lo + int(doc[k]), int(begin[k] - bounds[doc[k]]), int(end[k] - bounds[doc[k]])


def dense(encode: Callable[[str], list[int]], found: str, max_ratio: float) -> int:
    """The tokens of a string of at most max_ratio characters a token, 0 for others."""
    n = len(encode(found))
    if len(found) > max_ratio * n or not (_MIXED.search(found) or len(found) <= max_ratio * len(encode(found.lower()))):
        return 0
    return n


def known_shape(found: str) -> bool:
    return bool(_UUID.fullmatch(found) or _DIGEST.fullmatch(found))


def harmless(found: str) -> bool:
    return known_shape(found) or not _LETTER.search(found)


def parts(encode: Callable[[str], list[int]], run: str, min_chars: int, max_ratio: float) -> Iterator[tuple[int, int, int]]:
    """(begin, end, tokens) of the secrets within a run whose whole is over the ratio.

    A run's parts lie between its separators. Neighbouring parts that are each under the ratio are one
    string, as random ones have separators inside; UUIDs and digests stand alone.
    """
    begin, last = None, 0
    for m in [*_PART.finditer(run), None]:
        alone = m is not None and known_shape(m.group())
        joins = m is not None and not alone and len(m.group()) <= max_ratio * len(encode(m.group()))
        if begin is not None and not joins:
            found = run[begin:last]
            if last - begin >= min_chars and (n := dense(encode, found, max_ratio)):
                yield begin, last, n
            begin = None
        if joins:
            begin, last = m.start() if begin is None else begin, m.end()
        elif alone and (n := dense(encode, m.group(), max_ratio)):
            yield m.start(), m.end(), n


def findings(texts: list[str | None], vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO, known: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(text, begin, end, tokens) of every secret."""
    encode = encoding(vocabulary).encode_ordinary
    for k, begin, end in candidates(texts, min_chars):
        text = texts[k] or ""
        found = text[begin:end]
        n = dense(encode, found, max_ratio)
        named = bool(_NAMED.search(text[max(0, begin - 48) : begin]))
        if not n:
            for b, e, n in parts(encode, found, min_chars, max_ratio):
                if found[b:e] not in known and (named or not harmless(found[b:e])):
                    yield k, begin + b, begin + e, n
        elif found not in known and (named or not harmless(found)):
            yield k, begin, end, n


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO, known: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, char_begin, char_end, n_tokens, chars_per_token, secret_sha256): one row for each secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = list(findings(texts, vocabulary, min_chars, max_ratio, known))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([(r[2] - r[1]) / r[3] for r in rows], pa.float64()),
                    pa.array([hashlib.sha256(texts[r[0]][r[1] : r[2]].encode()).hexdigest() for r in rows], pa.string()),
                ],
                names=["doc_id", "char_begin", "char_end", "n_tokens", "chars_per_token", "secret_sha256"],
            )

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched(body).mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, char_begin long, char_end long, n_tokens long, chars_per_token double, secret_sha256 string")


def redacted(texts: list[str | None], mask: str = MASK, **how: object) -> list[str | None]:
    out = list(texts)
    by: dict[int, list[tuple[int, int]]] = {}
    for k, begin, end, _ in findings(texts, **how):
        by.setdefault(k, []).append((begin, end))
    for k, spans in by.items():
        text = texts[k]
        for begin, end in reversed(spans):
            text = text[:begin] + mask + text[end:]
        out[k] = text
    return out


def redact(docs: DataFrame, vocabulary: str = VOCABULARY, mask: str = MASK, text_col: str = "text", **how: object) -> DataFrame:
    """docs with every secret replaced by the mask."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(redacted([t if isinstance(t, str) else None for t in texts], mask, vocabulary=vocabulary, **how), dtype=object)

    old, new = F.col(f"`{text_col}`"), clean(F.col(f"`{text_col}`"))
    names = docs.columns
    out = batched(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), old.alias("__old"), new.alias("__new"))
    row = F.col("__row")

    def column(c: str):  # noqa: ANN202
        if c == text_col:
            return F.col("__new").alias(c)
        if c == "n_chars":
            kind = docs.schema[c].dataType
            return F.when(F.col("__old") == F.col("__new"), row.getField(c)).otherwise(F.length("__new").cast(kind)).alias(c)
        return row.getField(c).alias(c)

    return out.select(*[column(c) for c in names])
