"""Pre-tokens of byte-level BPE found by an associative scan, without regex.

The published splitting pattern is a small automaton once each code point carries
one of nine symbols (letter, number, other, contraction of two or three code
points, attaching space, last white space, white space, end of text). A symbol is
a function from state to state; the functions that arise by composing them form a
small finite monoid, so a prefix scan over its composition table gives the state
at every code point with array operations alone.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import unicodedata

import numpy as np

# White space of Unicode, and the letters and numbers that Unicode 16.0
# added (Python's unicodedata may be older than the tokenizer libraries').
WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
         (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
              (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
              (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
              (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
              (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
              (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

END = 0x110000                      # stands after each text
OTHER, LETTER, NUMBER, BLANK, STOP = range(5)
# symbols
L, N, P, A2, A3, SA, WL, W, R = range(9)
# states: fresh, in letters, in numbers, in others, after an attaching space, in white
# space, one or two code points of a contraction to come
X, IN_L, IN_N, IN_P, IN_S, IN_W, C1, C2 = range(8)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, and STOP for END."""
    out = np.zeros(END + 1, np.uint8)
    for cp in itertools.chain(range(0x40000), range(0xE0000, 0xF0000)):  # no letter or number is elsewhere
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = NUMBER
    for ranges, value in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER), (WHITE, BLANK)):
        for a, b in ranges:
            out[a:b + 1] = value
    out[END] = STOP
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the code point starts a pre-token."""
    if symbol == R:
        return X, True
    if state in (C1, C2):
        return (X if state == C1 else C1), False
    if symbol == L:
        return IN_L, state not in (IN_L, IN_S)
    if symbol == N:
        return IN_N, state not in (IN_N, IN_S)
    if symbol in (P, A2, A3):
        if state in (IN_P, IN_S):
            return IN_P, False
        return {P: IN_P, A2: C1, A3: C2}[symbol], True
    if symbol == W:
        return IN_W, state != IN_W
    return (IN_S if symbol == SA else X), True


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, composition table, image of the fresh state, start flags)."""
    gens = [tuple(_step(s, a)[0] for s in range(8)) for a in range(9)]
    elems = list(dict.fromkeys(gens))
    seen = set(elems)
    for f in elems:  # grows while it is walked
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in seen:
                seen.add(h)
                elems.append(h)
    place = {f: i for i, f in enumerate(elems)}
    k = len(elems)
    table = np.empty((k, k), np.uint16)
    for i, f in enumerate(elems):
        for j, g in enumerate(elems):
            table[i, j] = place[tuple(g[s] for s in f)]
    starts = np.array([[_step(s, a)[1] for a in range(9)] for s in range(8)])
    return (np.array([place[g] for g in gens], np.uint16), table, np.array([f[X] for f in elems], np.uint8), starts)


def prefix_compose(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of ``f`` under the associative ``table``: within rows of a
    matrix side by side, over the rows' totals by doubling, then both together."""
    n = len(f)
    width = 64
    if n <= width:
        out = f.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    k, flat = len(table), table.ravel()
    rows = n // width
    body = np.ascontiguousarray(f[:rows * width].reshape(rows, width).T)
    for j in range(1, width):
        body[j] = flat[body[j - 1].astype(np.intp) * k + body[j]]
    total = body[-1].copy()
    shift = 1
    while shift < rows:
        total[shift:] = flat[total[:-shift].astype(np.intp) * k + total[shift:]]
        shift *= 2
    body[:, 1:] = flat[total[None, :-1].astype(np.intp) * k + body[:, 1:]]
    out = np.empty_like(f)
    out[:rows * width] = body.T.ravel()
    if n > rows * width:
        carry = out[rows * width - 1]
        for i in range(rows * width, n):
            carry = out[i] = table[carry, f[i]]
    return out


def symbols(cps: np.ndarray) -> np.ndarray:
    """Symbol of each code point, given what follows it."""
    c = classes()[cps]
    nxt = np.append(c[1:], STOP)
    sym = np.array([P, L, N, W, R], np.uint8)[c]
    last = (c == BLANK) & (nxt != BLANK) & (nxt != STOP)
    sym[last] = WL
    sym[last & (cps == 0x20)] = SA
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        pad = np.append(cps, [END, END])
        a, b = pad[at + 1], pad[at + 2]
        two = np.isin(a, [ord(x) for x in "stmd"])
        three = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            three |= (a == ord(x)) & (b == ord(y))
        sym[at[two]] = A2
        sym[at[three]] = A3
    return sym


@dataclasses.dataclass
class Pieces:
    """Pre-tokens of a chunk of texts, each distinct one named once.

    ``which[k]`` is the distinct number of the k-th pre-token; text d holds the
    pre-tokens ``bounds[d]`` to ``bounds[d + 1]``; ``words`` are the distinct ones.
    """

    words: list[str]
    which: np.ndarray
    bounds: np.ndarray


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0]+1, ... for lengths[0] of them, then starts[1], ..."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


#: So many powers are kept.
_KEPT = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    if n <= _KEPT:
        return _kept_powers(base)[:n]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.cache
def _kept_powers(base: int) -> np.ndarray:
    out = np.full(_KEPT, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def distinct(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first pre-token of each content, which content each pre-token has).

    Contents are grouped by a polynomial hash and then compared code point by code
    point; should two contents share a hash, they are grouped by themselves.
    """
    n = len(cps)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, n), dtype=np.uint64, out=prefix[1:])
    key = (prefix[ends] - prefix[starts]) * _powers(_INVERSE, n)[starts]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    size = ends - starts
    rep = first[which]
    same = size[rep] == size
    here = ragged(starts[same], size[same])
    there = ragged(starts[rep[same]], size[same])
    if not same.all() or (cps[here] != cps[there]).any():
        named: dict[bytes, int] = {}
        which = np.array([named.setdefault(cps[a:b].tobytes(), len(named)) for a, b in zip(starts, ends)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which


def cut(texts: list[str]) -> Pieces:
    """The pre-tokens of each text, in order; joined they give the text."""
    if not texts:
        return Pieces([], np.zeros(0, np.int64), np.zeros(1, np.int64))
    whole = "\0".join(texts) + "\0"
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    cps[stops] = END
    gens, table, image, starts = monoid()
    sym = symbols(cps)
    after = image[prefix_compose(gens[sym], table)]
    before = np.empty_like(after)
    before[0] = X
    before[1:] = after[:-1]
    cuts = np.flatnonzero(starts[before, sym])
    is_stop = sym[cuts] == R
    begin, end = cuts[~is_stop], np.append(cuts[1:], len(cps))[~is_stop]
    bounds = np.concatenate([[0], np.searchsorted(begin, stops)])
    if not len(begin):
        return Pieces([], np.zeros(0, np.int64), bounds)
    first, which = distinct(cps, begin, end)
    words = [whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    return Pieces(words, which, bounds)
