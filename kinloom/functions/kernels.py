"""Dynamic programs over whole Arrow batches: one numpy operation per cell of the table serves all pairs of a batch.

Strings become rows of a code-point matrix. Pairs are deduplicated, sorted by size and cut into blocks, so that padding
stays small and a table of a block fits the cache; a very long pair forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Cells (pairs x columns) that one block may hold.
BLOCK_CELLS = 400_000


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of code points, 0-padded; lengths)."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    width = int(lengths.max(initial=0))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros((len(strings), width), dtype=np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def pairwise(kernel: Callable[..., np.ndarray], a: pd.Series, b: pd.Series, dtype=np.float64) -> pd.Series:
    """Apply a kernel (A, la, B, lb) -> values to the distinct pairs of two series; null on either side gives null."""
    ok = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if ok.any():
        pairs = pd.MultiIndex.from_arrays([a.to_numpy()[ok], b.to_numpy()[ok]])
        codes, distinct = pairs.factorize()
        left, right = [x for x, _ in distinct], [y for _, y in distinct]
        size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), dtype=np.int64, count=len(left))
        order = np.argsort(size, kind="stable")
        values = np.empty(len(left))
        start = 0
        while start < len(order):
            end = start + 1
            # grow while the padding of the block stays within bounds
            step = max(1, BLOCK_CELLS // max(1, int(size[order[start]]) + 8))
            end = min(len(order), start + step)
            limit = int(size[order[start]]) + 8 + int(size[order[start]]) // 4
            end = start + max(1, int(np.searchsorted(size[order[start:end]], limit, side="right")))
            block = order[start:end]
            A, la = encode([left[i] for i in block])
            B, lb = encode([right[i] for i in block])
            values[block] = kernel(A, la, B, lb)
            start = end
        out[ok] = values[codes]
    s = pd.Series(out, index=a.index)
    return s if dtype is np.float64 else s.astype("Int32" if dtype is np.int32 else dtype)


#: Longer texts than this leave the matrix of a batch and form blocks of their own.
SHORT = 96


def encode_arrow(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of code points, 0-padded; lengths) of texts without nulls, from their buffer if they are plain ASCII."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.sum(pc.utf8_length(texts)).as_py() != int(lengths.sum()):
        return encode(texts.to_pylist())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros((len(texts), int(lengths.max(initial=0))), dtype=np.uint8)
    if out.size:
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return out, lengths


def pairwise_arrow(kernel: Callable[..., np.ndarray], a: pa.Array, b: pa.Array, kind: pa.DataType) -> pa.Array:
    """Apply a kernel to the distinct pairs of two text arrays; null on either side gives null.

    Texts are encoded once per distinct value of a side, without Python strings; pairs are told apart by the numbers of
    their values.
    """
    null = np.asarray(a.is_null()) | np.asarray(b.is_null())
    values = np.zeros(len(a))
    at = np.flatnonzero(~null)
    if len(at):
        x, y = (c.cast(pa.string()).take(pa.array(at)).dictionary_encode() if null.any() else c.cast(pa.string()).dictionary_encode() for c in (a, b))
        ix, iy = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y))
        back = slice(None)
        if len(x.dictionary) < len(at) and len(y.dictionary) < len(at):
            codes, back = np.unique(ix * len(y.dictionary) + iy, return_inverse=True)
            ix, iy = codes // len(y.dictionary), codes % len(y.dictionary)
        size = np.maximum(np.asarray(pc.utf8_length(x.dictionary))[ix], np.asarray(pc.utf8_length(y.dictionary))[iy])
        done = np.empty(len(ix))
        short = size <= SHORT
        if not short.all():
            far = np.flatnonzero(~short)
            done[far] = pairwise(kernel, pd.Series(x.dictionary.take(pa.array(ix[far])).to_pylist(), dtype=object), pd.Series(y.dictionary.take(pa.array(iy[far])).to_pylist(), dtype=object)).to_numpy()
        near = np.flatnonzero(short)
        if len(near):
            # Only values of short pairs are encoded; the others keep an empty row.
            cut = lambda c: encode_arrow(pc.if_else(pc.less_equal(pc.utf8_length(c), SHORT), c, ""))
            (MA, la), (MB, lb) = cut(x.dictionary), cut(y.dictionary)
            near = near[np.argsort(size[near], kind="stable")]
            start = 0
            while start < len(near):
                step = max(1, BLOCK_CELLS // (int(size[near[start]]) + 8))
                limit = int(size[near[start]]) + 8 + int(size[near[start]]) // 4
                end = start + max(1, int(np.searchsorted(size[near[start : start + step]], limit, side="right")))
                block = near[start:end]
                i, j = ix[block], iy[block]
                wa, wb = int(la[i].max(initial=0)), int(lb[j].max(initial=0))
                done[block] = kernel(MA[i, :wa], la[i], MB[j, :wb], lb[j])
                start = end
        values[at] = done[back]
    return pa.array(values, pa.float64(), mask=null).cast(kind)


def _final(row: np.ndarray, done: np.ndarray, at: np.ndarray, where: np.ndarray) -> None:
    """Keep the last column of the rows that end here."""
    if where.any():
        done[where] = row[where, at[where]]


def edit(A, la, B, lb, insert=1.0, delete=1.0, substitute=1.0, transpose: float | None = None) -> np.ndarray:
    """Weighted edit distance, with restricted transpositions if they have a cost."""
    n, w = len(A), B.shape[1]
    row = np.tile(np.arange(w + 1) * float(insert), (n, 1))
    done = row[np.arange(n), lb].copy()
    above = None
    for i in range(1, A.shape[1] + 1):
        ca = A[:, i - 1 : i]
        cost = row[:, :-1] + np.where(ca == B, 0.0, substitute)
        down = row[:, 1:] + delete
        new = np.empty_like(row)
        new[:, 0] = i * delete
        np.minimum(cost, down, out=cost)
        if transpose is not None and i > 1:
            swapped = (A[:, i - 1 : i] == B[:, :-1]) & (A[:, i - 2 : i - 1] == B[:, 1:])
            cost[:, 1:] = np.where(swapped, np.minimum(cost[:, 1:], above[:, : w - 1] + transpose), cost[:, 1:])
        for j in range(1, w + 1):
            np.minimum(cost[:, j - 1], new[:, j - 1] + insert, out=new[:, j])
        _final(new, done, lb, la == i)
        above, row = row, new
    return done


def osa(A, la, B, lb):
    return edit(A, la, B, lb, transpose=1.0)


def _like(distance: np.ndarray, la: np.ndarray, lb: np.ndarray, unit: float = 1.0) -> np.ndarray:
    longest = np.maximum(la, lb)
    return np.where(longest == 0, 1.0, 1.0 - distance / np.maximum(longest * unit, 1e-300))


def osa_similarity(A, la, B, lb):
    return _like(osa(A, la, B, lb), la, lb)


def weighted_similarity(A, la, B, lb, insert, delete, substitute, transpose):
    d = edit(A, la, B, lb, insert, delete, substitute, transpose)
    unit = max(insert, delete)
    if unit <= 0:
        return np.ones(len(d))
    return np.maximum(_like(d, la, lb, unit), 0.0)


def lcs_length(A, la, B, lb):
    """Longest common subsequence."""
    n, w = len(A), B.shape[1]
    row = np.zeros((n, w + 1), dtype=np.int32)
    valid_b = np.arange(w) < lb[:, None]
    for i in range(A.shape[1]):
        hit = (A[:, i : i + 1] == B) & valid_b & (i < la)[:, None]
        new = np.zeros_like(row)
        np.maximum(row[:, 1:], row[:, :-1] + hit, out=new[:, 1:])
        np.maximum.accumulate(new, axis=1, out=new)
        row = new
    return row[:, -1]


def lcs_similarity(A, la, B, lb):
    both = la + lb
    return np.where(both == 0, 1.0, 2.0 * lcs_length(A, la, B, lb) / np.maximum(both, 1))


def substring_length(A, la, B, lb):
    """Longest common contiguous run."""
    n, w = len(A), B.shape[1]
    row, best = np.zeros((n, w + 1), dtype=np.int32), np.zeros(n, dtype=np.int32)
    valid_b = np.arange(w) < lb[:, None]
    for i in range(A.shape[1]):
        hit = (A[:, i : i + 1] == B) & valid_b & (i < la)[:, None]
        new = np.zeros_like(row)
        new[:, 1:] = np.where(hit, row[:, :-1] + 1, 0)
        np.maximum(best, new.max(axis=1), out=best)
        row = new
    return best


def substring_similarity(A, la, B, lb):
    both = la + lb
    return np.where(both == 0, 1.0, 2.0 * substring_length(A, la, B, lb) / np.maximum(both, 1))


def smith_waterman(A, la, B, lb, match=2.0, mismatch=-1.0, gap=-1.0):
    n, w = len(A), B.shape[1]
    row, best = np.zeros((n, w + 1)), np.zeros(n)
    valid_b = np.arange(w) < lb[:, None]
    for i in range(A.shape[1]):
        live = valid_b & (i < la)[:, None]
        new = np.zeros_like(row)
        cand = np.maximum(row[:, :-1] + np.where(A[:, i : i + 1] == B, match, mismatch), row[:, 1:] + gap)
        np.maximum(cand, 0.0, out=cand)
        for j in range(1, w + 1):
            np.maximum(cand[:, j - 1], new[:, j - 1] + gap, out=new[:, j])
        np.maximum(best, np.where(live, new[:, 1:], 0.0).max(axis=1, initial=0.0), out=best)
        row = new
    return best


def _of_shorter(score: np.ndarray, la: np.ndarray, lb: np.ndarray, match: float) -> np.ndarray:
    shorter = np.minimum(la, lb)
    share = np.clip(score / np.maximum(shorter * match, 1e-300), 0.0, 1.0)
    return np.where(shorter == 0, ((la == 0) & (lb == 0)).astype(float), share)


def smith_waterman_similarity(A, la, B, lb):
    return _of_shorter(smith_waterman(A, la, B, lb), la, lb, 2.0)


def needleman_wunsch(A, la, B, lb, match=2.0, mismatch=-1.0, gap=-1.0):
    n, w = len(A), B.shape[1]
    row = np.tile(np.arange(w + 1) * gap, (n, 1))
    done = row[np.arange(n), lb].copy()
    for i in range(1, A.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = i * gap
        cand = np.maximum(row[:, :-1] + np.where(A[:, i - 1 : i] == B, match, mismatch), row[:, 1:] + gap)
        for j in range(1, w + 1):
            np.maximum(cand[:, j - 1], new[:, j - 1] + gap, out=new[:, j])
        _final(new, done, lb, la == i)
        row = new
    return done


def needleman_wunsch_similarity(A, la, B, lb):
    return _of_shorter(needleman_wunsch(A, la, B, lb), la, lb, 2.0)


def gotoh(A, la, B, lb, match=1.0, mismatch=-1.0, start=-1.0, extend=-0.5):
    """Global alignment with affine gaps: a gap of k costs start + (k - 1) * extend."""
    n, w = len(A), B.shape[1]
    steps = np.arange(w + 1)
    row = np.tile(np.where(steps == 0, 0.0, start + (steps - 1) * extend), (n, 1))
    down = np.full((n, w + 1), -np.inf)
    done = row[np.arange(n), lb].copy()
    for i in range(1, A.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = start + (i - 1) * extend
        down = np.maximum(row + start, down + extend)
        cand = np.maximum(row[:, :-1] + np.where(A[:, i - 1 : i] == B, match, mismatch), down[:, 1:])
        across = np.full(n, -np.inf)
        for j in range(1, w + 1):
            across = np.maximum(new[:, j - 1] + start, across + extend)
            np.maximum(cand[:, j - 1], across, out=new[:, j])
        _final(new, done, lb, la == i)
        row = new
    return done


def gotoh_similarity(A, la, B, lb):
    return _of_shorter(gotoh(A, la, B, lb), la, lb, 1.0)


def _matches_in_words(A, la, B, lb, window, hit_a) -> np.ndarray:
    """Jaro matches with the places of b as the bits of one machine word; fills ``hit_a`` and returns the same for b."""
    n, w = B.shape
    bits = 16 if w <= 16 else 32 if w <= 32 else 64
    wide = np.zeros((n, bits), dtype=B.dtype)
    wide[:, :w] = B
    one = np.uint64(1)
    whole = np.left_shift(one, lb.astype(np.uint64)) - one
    free = whole.copy()
    for i in range(A.shape[1]):
        same = np.packbits(wide == A[:, i : i + 1], axis=1, bitorder="little").view(f"<u{bits // 8}")[:, 0].astype(np.uint64)
        above = np.left_shift(one, np.minimum(window + i + 1, 63).astype(np.uint64)) - one
        below = np.left_shift(one, np.clip(i - window, 0, 63).astype(np.uint64)) - one
        can = same & free & above & ~below
        can[i >= la] = 0
        first = can & (~can + one)
        free ^= first
        hit_a[:, i] = first != 0
    taken = (whole ^ free).astype("<u8").view(np.uint8).reshape(n, 8)
    return np.unpackbits(taken, axis=1, bitorder="little")[:, :w].astype(bool)


def jaro(A, la, B, lb):
    """Greedy leftmost matches within the window; half of the mismatched matched characters are transpositions."""
    n, w = len(A), B.shape[1]
    rows = np.arange(n)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    hit_a = np.zeros(A.shape, dtype=bool)
    if 0 < w < 64:
        hit_b = _matches_in_words(A, la, B, lb, window, hit_a)
    else:
        free, place, hit_b = np.arange(w) < lb[:, None], np.arange(w), np.zeros((n, w), dtype=bool)
        for i in range(A.shape[1] if w else 0):
            can = free & (A[:, i : i + 1] == B) & (np.abs(place - i) <= window[:, None]) & (i < la)[:, None]
            j = can.argmax(axis=1)
            got = can[rows, j]
            hit_a[:, i] = got
            hit_b[rows[got], j[got]] = True
            free[rows[got], j[got]] = False
    m = hit_a.sum(axis=1)
    most = int(m.max(initial=0))
    # matched characters of both sides, in order, side by side
    left, right = np.zeros((n, most), dtype=np.uint32), np.zeros((n, most), dtype=np.uint32)
    keep = np.arange(most) < m[:, None]
    left[keep], right[keep] = A[hit_a], B[hit_b]
    t = (left != right).sum(axis=1) / 2.0
    some = np.maximum(m, 1)
    score = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - t) / some) / 3.0
    return np.where((la == 0) & (lb == 0), 1.0, np.where(m == 0, 0.0, score))


def jaro_winkler(A, la, B, lb, weight=0.1):
    j = jaro(A, la, B, lb)
    k = min(4, A.shape[1], B.shape[1])
    same = (A[:, :k] == B[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1) if k else np.zeros(len(A))
    return j + prefix * weight * (1.0 - j)


def ratcliff_obershelp(a: str, b: str) -> float:
    """Share of characters in recursively longest common runs; the first longest run in a, then in b, is taken."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    where: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        where.setdefault(c, []).append(j)
    matched, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, at_a, at_b = 0, 0, 0
        runs: dict[int, int] = {}
        for i in range(a0, a1):
            now: dict[int, int] = {}
            for j in where.get(a[i], ()):
                if b0 <= j < b1:
                    k = now[j] = runs.get(j - 1, 0) + 1
                    if k > best:
                        best, at_a, at_b = k, i + 1 - k, j + 1 - k
            runs = now
        if best:
            matched += best
            todo += [(a0, at_a, b0, at_b), (at_a + best, a1, at_b + best, b1)]
    return 2.0 * matched / total


def align(a: str, b: str) -> tuple[list[str], int, str]:
    """(operations, distance, three-line picture); from the end, a match is preferred to a substitution, a deletion, an insertion."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), dtype=np.int64)
    d[:, 0], d[0, :] = np.arange(n + 1), np.arange(m + 1)
    codes = np.array([ord(c) for c in b], dtype=np.int64)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.minimum(d[i - 1, :-1] + (codes != ord(a[i - 1])), d[i - 1, 1:] + 1)
        # insertions along the row: running minimum of (value - column) + column
        d[i] = np.minimum.accumulate(np.concatenate(([i], best)) - steps) + steps
    ops, picture, i, j = [], [], n, m
    while i or j:
        here = d[i, j]
        if i and j and a[i - 1] == b[j - 1] and here == d[i - 1, j - 1]:
            ops.append(f"match:{a[i - 1]}")
            picture.append((a[i - 1], "|", b[j - 1]))
            i, j = i - 1, j - 1
        elif i and j and a[i - 1] != b[j - 1] and here == d[i - 1, j - 1] + 1:
            ops.append(f"sub:{a[i - 1]}->{b[j - 1]}")
            picture.append((a[i - 1], " ", b[j - 1]))
            i, j = i - 1, j - 1
        elif i and here == d[i - 1, j] + 1:
            ops.append(f"del:{a[i - 1]}")
            picture.append((a[i - 1], " ", "-"))
            i -= 1
        else:
            ops.append(f"ins:{b[j - 1]}")
            picture.append(("-", " ", b[j - 1]))
            j -= 1
    lines = ("\n".join(" ".join(p[k] for p in reversed(picture)) for k in range(3))) if picture else "\n\n"
    return ops[::-1], int(d[n, m]), lines
