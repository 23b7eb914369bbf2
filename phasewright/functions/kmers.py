"""Two-bit k-mer codes and hashes, vectorised."""

from __future__ import annotations

import numpy as np

_BASE = np.full(256, 4, np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _letter in _letters:
        _BASE[ord(_letter)] = _code
MAX_K = 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the 64-bit Murmur hash (fixed constants); arithmetic wraps."""
    x = x.astype(np.uint64, copy=True)
    shift = np.uint64(33)
    x ^= x >> shift
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> shift
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> shift
    return x


def invertible(x: np.ndarray, k: int) -> np.ndarray:
    """Thomas Wang's invertible 64-bit hash under a mask of 2k bits (fixed shifts)."""
    u = np.uint64
    mask = u((1 << (2 * k)) - 1)
    x = x.astype(u, copy=True)
    x = (~x + (x << u(21))) & mask
    x ^= x >> u(24)
    x = (x * u(265)) & mask
    x ^= x >> u(14)
    x = (x * u(21)) & mask
    x ^= x >> u(28)
    return (x + (x << u(31))) & mask


def codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, forward, reverse complement) codes of all windows of k unambiguous bases, in order."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie between 1 and {MAX_K}: {k}")
    base = _BASE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    n = len(base) - k + 1
    none = np.empty(0, np.uint64)
    if n <= 0:
        return np.empty(0, np.int64), none, none
    bad = np.concatenate(([0], np.cumsum(base > 3)))
    good = np.flatnonzero(bad[k:] == bad[:-k])
    wide = base.astype(np.uint64)
    forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        forward = (forward << np.uint64(2)) | wide[j : j + n]
        reverse |= (np.uint64(3) - np.minimum(wide[j : j + n], np.uint64(3))) << np.uint64(2 * j)
    return good, forward[good], reverse[good]


def bases(letters: np.ndarray) -> np.ndarray:
    """Codes 0 to 3 of letters (bytes), 4 for all that are ambiguous."""
    return _BASE[letters]


def window_codes(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse complement) codes of every window of k bases of an array of codes 0 to 3, by doubling."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie between 1 and {MAX_K}: {k}")
    n, shift = max(len(base) - k + 1, 0), lambda bases: np.uint64(2 * bases)
    f, r = base.astype(np.uint64), np.uint64(3) - base
    forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    size, done = 1, 0
    while done < k:
        if k & size:
            forward = forward << shift(size) | f[done : done + n] if done else f[:n]
            reverse |= r[done : done + n] << shift(done)
            done += size
        if done < k:
            f, r = f[:-size] << shift(size) | f[size:], r[size:] << shift(size) | r[:-size]
            size *= 2
    return forward, reverse


def runs(base: np.ndarray, owner: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer) of the longest runs of windows of k bases with an equal minimizer.

    ``base`` holds the codes of several sequences, one after another, ``owner``
    the number of each base's sequence.  Runs lie within a sequence and without
    ambiguous bases.  The minimizer is the smallest hash of a window's m-mers,
    each the same on both strands, so a k-mer and its reverse complement have
    an equal one wherever they come.
    """
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    bad = np.concatenate(([0], np.cumsum(base > 3)))
    good = (bad[k:] == bad[:-k]) & (owner[:n] == owner[k - 1 :])
    low, size, width = mix64(np.minimum(*window_codes(base & 3, m))), 1, k - m + 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    first = good.copy()
    first[1:] &= ~good[:-1] | (low[1:] != low[:-1]) | (owner[1:n] != owner[: n - 1])
    start, cut = np.flatnonzero(first), np.append(np.flatnonzero(first | ~good), n)
    return start, cut[np.searchsorted(cut, start) + 1] - start, low[start]


def packed(base: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces of ``base``, four bases a byte and each from a byte of its own, one after another."""
    slots = 4 * ((length + 3) // 4)
    within = np.arange(slots.sum()) - np.repeat(np.cumsum(slots) - slots, slots)
    at = np.repeat(start, slots) + np.minimum(within, np.repeat(length - 1, slots))
    return (base[at].reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8)


def unpacked(data: np.ndarray) -> np.ndarray:
    """The codes of the bases, with what fills up the last byte of each piece."""
    return (data[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()


def canonical(seq: str, k: int) -> np.ndarray:
    """The smaller of both codes of every window."""
    _, forward, reverse = codes(seq, k)
    return np.minimum(forward, reverse)


def sketch(seq: str, k: int, size: int) -> np.ndarray:
    """The ``size`` smallest hashes of the canonical k-mers, in unsigned order, repeats kept."""
    h = mix64(canonical(seq, k))
    return np.sort(h)[:size] if len(h) <= size else np.sort(np.partition(h, size - 1)[:size])


def signed(x: np.ndarray) -> np.ndarray:
    """The bit pattern as a signed number, as Spark holds it."""
    return x.view(np.int64) if x.dtype == np.uint64 else x
