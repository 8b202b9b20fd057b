"""Vectorised text primitives on blocks of documents: code points, word and pre-token spans, span hashes.

A block is a list of texts laid out as one array of code points. Every function works on the whole
block at once, so its cost is a few passes over memory and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters of a block; a longer document is a block of its own and is never cut.
BLOCK_CHARS = 2_000_000
#: Documents of a block, however short.
BLOCK_DOCS = 1 << 19
#: Values hashed at once.
STRETCH = 500_000
#: Longer spans are hashed one by one: modulo 2^64 the polynomial of structured texts degenerates as they grow.
POLYNOMIAL_LENGTH = 64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts hold about `most` characters together, of BLOCK_DOCS documents at most."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most or i - start >= BLOCK_DOCS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, str]:
    """All code points, each document's bounds in them (one more than documents), and the joined text."""
    whole = "".join(t or "" for t in texts)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=bounds[1:])
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), bounds, whole


@cache
def classes() -> np.ndarray:
    """The pre-tokeniser's class of each code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x01" for c in range(0x110000))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 (splitmix64)."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, inverse = _powers_up_to(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    prefix[1:] = values
    prefix[1:] += np.uint64(1)
    prefix[1:] *= p[: len(values)]
    np.cumsum(prefix[1:], out=prefix[1:])
    return mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[begin:end] for many spans, from one prefix sum of a polynomial; long spans by XXH3.

    Spans in order are hashed stretch by stretch, which bounds the arrays in between; the hash of a span depends
    on its values (and their type) alone.
    """
    out = _stretched_hashes(values, begin, end)
    long = np.flatnonzero(end - begin > POLYNOMIAL_LENGTH)
    if len(long):
        from xxhash import xxh3_64_intdigest

        values = np.ascontiguousarray(values)
        out[long] = np.array([xxh3_64_intdigest(values[b:e]) for b, e in zip(begin[long].tolist(), end[long].tolist())], np.uint64)
    return out


def _stretched_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if len(values) <= STRETCH or not len(begin) or (begin[1:] < begin[:-1]).any():
        return _span_hashes(values, begin, end)
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        lo = int(begin[at])
        stop = max(at + 1, int(np.searchsorted(begin, lo + STRETCH)))
        hi = int(end[at:stop].max())
        out[at:stop] = _span_hashes(values[lo:hi], begin[at:stop] - lo, end[at:stop] - lo)
        at = stop
    return out


def distinct_spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A span of each distinct content, and the distinct content of each span.

    Spans meet by their hash's high bits, which are sorted together with the spans' places, and are then compared value
    by value, so different spans of one hash stay apart.
    """
    low = np.uint64(max(len(hashes) - 1, 1).bit_length())
    key = hashes >> low << low | np.arange(len(hashes), dtype=np.uint64)
    key.sort()
    place = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    key >>= low
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first, which = place[new], np.empty(len(key), np.int64)
    which[place] = np.cumsum(new) - 1
    model = first[which]
    apart = end - begin != end[model] - begin[model]
    rest = np.flatnonzero((model != np.arange(len(begin))) & ~apart)
    size = (end - begin)[rest]
    upto = offsets_of(size)
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + STRETCH)) - 1)
        own, his, n = begin[rest[lo:hi]], begin[model[rest[lo:hi]]], size[lo:hi]
        place = np.arange(int(n.sum())) - np.repeat(upto[lo:hi] - upto[lo], n)
        differ = values[np.repeat(own, n) + place] != values[np.repeat(his, n) + place]
        if differ.any():
            apart[rest[lo:hi][np.unique(np.repeat(np.arange(hi - lo), n)[differ])]] = True
        lo = hi
    if not apart.any():
        return first, which
    which, more, known = which.copy(), [], {}
    for k in np.flatnonzero(apart).tolist():
        content = values[begin[k] : end[k]].tobytes()
        if content not in known:
            known[content] = len(first) + len(more)
            more.append(k)
        which[k] = known[content]
    return np.append(first, np.array(more, first.dtype)), which


def run_spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of True that don't cross a document bound."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each maximal run of letters and digits, lower-cased: its hash, document, begin and end within the block."""
    cp, bounds, _ = code_points([t.lower() if t else "" for t in texts])
    kind = classes()[cp]
    begin, end = run_spans((kind == LETTER) | (kind == NUMBER), bounds)
    return span_hashes(cp, begin, end), np.searchsorted(bounds, begin, "right") - 1, begin, end


def spaced_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), of each maximal run without white space, as it is written; begin and end are within the document."""
    cp, bounds, _ = code_points(texts)
    begin, end = run_spans(classes()[cp] != SPACE, bounds)
    doc = np.searchsorted(bounds, begin, "right") - 1
    return span_hashes(cp, begin, end), doc, begin - bounds[doc], end - bounds[doc]


def pretokens(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokens of the byte-level vocabularies' pattern.

    The pattern takes contractions, an optional space with a run of letters, of numbers or of other
    signs, and white space up to its last character before a word. A run's begin starts a pre-token
    unless a plain space before it does; contractions (few) are then cut from the runs that follow.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    after_space = np.zeros(n, bool)
    after_space[1:] = (cp[:-1] == 32) & ~edge[1:n]
    start = run & (blank | ~after_space)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:n]
    quote = np.flatnonzero((cp == 39) & run & ~after_space)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
        size = np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        stop = quote + size
        start[stop[stop < n]] = True
    begin = np.flatnonzero(start)
    return begin, np.append(begin[1:], n)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gather(flat: np.ndarray, offset: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[offset[w]:offset[w + 1]] for each w of which, one after another."""
    size = offset[which + 1] - offset[which]
    begin = offsets_of(size)
    return flat[np.repeat(offset[which] - begin[:-1], size) + np.arange(begin[-1])]
