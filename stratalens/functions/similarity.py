"""String similarity for names and short values, as Arrow-batched pandas functions (Spark has none built in).

The scores follow the public definitions: ratio is the normalised insertion/deletion similarity
2 * LCS / (len(a) + len(b)); the others are built on it. All range from 0 to 100, Jaro-Winkler from 0 to 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one integer holds a whole row of the table as bits."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any equally long stretch of the longer one (shorter at its ends)."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    width = len(short)

    def best(x: str, y: str) -> float:
        return max(ratio(x, y[max(0, start):start + width]) for start in range(1 - width, len(y)))

    score = best(short, long)
    return max(score, best(long, short)) if len(a) == len(b) else score


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Compares the shared words with the words each side has beyond them."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    joined_left, joined_right = (f"{shared} {only_left}".strip(), f"{shared} {only_right}".strip())
    if not shared:
        return ratio(only_left, only_right)
    gap = len(only_left) + len(only_right) - 2 * _lcs(only_left, only_right)
    both = 100.0 * (1 - gap / (len(joined_left) + len(joined_right)))
    return max(both, ratio(shared, joined_left), ratio(shared, joined_right))


def _partial_token_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if left & right:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))),
               partial_ratio(" ".join(sorted(left - right)), " ".join(sorted(right - left))))


def weighted_ratio(a: str, b: str) -> float:
    """Whole, token-based and (for very different lengths) partial ratios, weighted by how much they say."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8.0 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * _partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Texts up to this length are compared in arrays, a whole batch of pairs at once; longer ones pair by pair.
ARRAY_CHARS = 64


def code_points(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points by place and text, 0 behind a text's end, and the lengths. Code points are raised by 2, so none is 0 or 1."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 2
    out = np.zeros((len(texts), width), np.int32)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return np.ascontiguousarray(out.T), sizes


def _matched(chars: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The taken characters of each text, moved to the front."""
    order = np.argsort(~taken, axis=0, kind="stable")
    return np.take_along_axis(chars, order, 0)


def jaro_winkler_arrays(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The same scores as jaro_winkler for many pairs of texts, given as code points by place."""
    b = np.where(b == 0, 1, b)
    reach = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0)
    mine, theirs = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    most = int(reach.max(initial=0))
    for i in range(len(a)):
        open_ = a[i] > 0
        for j in range(max(0, i - most), min(len(b), i + most + 1)):
            hit = (a[i] == b[j]) & open_ & ~theirs[j] & (reach >= abs(i - j))
            theirs[j] |= hit
            open_ &= ~hit
        mine[i] = ~open_ & (a[i] > 0)
    m = mine.sum(0)
    width = min(len(a), len(b))
    differ = (_matched(a, mine)[:width] != _matched(b, theirs)[:width]) & (np.arange(width)[:, None] < m)
    swaps = differ.sum(0) // 2
    some = np.maximum(m, 1)
    jaro = (m / np.maximum(size_a, 1) + m / np.maximum(size_b, 1) + (m - swaps) / some) / 3
    lead = np.cumprod(a[:4][: len(b)] == b[:4][: len(a)], axis=0).sum(0)
    score = np.where(jaro <= 0.7, jaro, jaro + 0.1 * lead * (1 - jaro))
    whole = (size_a == size_b) & (np.pad(a, ((0, max(0, len(b) - len(a))), (0, 0))) == np.pad(np.where(b == 1, 0, b), ((0, max(0, len(a) - len(b))), (0, 0)))).all(0)
    return np.where((m == 0) | (size_a == 0) | (size_b == 0), 0.0, np.where(whole, 1.0, score))


def jaro_winkler_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    """jaro_winkler of each pair; null if either is."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = a.to_numpy(object)[known], b.to_numpy(object)[known]
    longest = np.array([max(len(s), len(t)) for s, t in zip(x, y, strict=True)], np.int64)
    for i in np.flatnonzero(longest > ARRAY_CHARS):
        out[known[i]] = jaro_winkler(x[i], y[i])
    short = np.flatnonzero(longest <= ARRAY_CHARS)
    short = short[np.argsort(longest[short], kind="stable")]
    for start in range(0, len(short), 4096):
        at = short[start:start + 4096]
        width = max(int(longest[at].max()), 1)
        (p, n), (q, m) = code_points(list(x[at]), width), code_points(list(y[at]), width)
        out[known[at]] = jaro_winkler_arrays(p, n, q, m)
    return pd.Series(out)


def _pairwise(score):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(over, T.DoubleType())


ratio_udf = _pairwise(ratio)
partial_ratio_udf = _pairwise(partial_ratio)
token_set_ratio_udf = _pairwise(token_set_ratio)
weighted_ratio_udf = _pairwise(weighted_ratio)
jaro_winkler_udf = F.pandas_udf(jaro_winkler_pairs, T.DoubleType())
