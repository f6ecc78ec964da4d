"""Rolling 64-bit fingerprints and minimizer runs over byte or word sequences.

A fingerprint of a span is a difference of prefix sums, so the fingerprint of
every span of a text costs two look-ups.  Arithmetic is modulo 2**64, where
sums of plain symbols have forced collisions (of a Thue-Morse word of 1,024
letters and its complement, for one).  So no plain symbols are summed: a
byte's value is a hash of the eight bytes from it on, and a word's one that
mixes its eight-byte pieces.  Callers compare two fingerprints of different
extent together.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Texts are worked on in pieces of about this many symbols.
PIECE = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U)
    k, p = 1, U(base)
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * p
            p, k = p * p, k * 2
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a fingerprint's entropy over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def eights(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number, as a view; zeros follow the last."""
    padded = np.concatenate((a, np.zeros(8, np.uint8)))
    return np.ndarray(len(a), "<u8", padded, strides=(1,))


def word_values(a: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes: its eight-byte pieces, each mixed with its place, then summed and mixed with the length."""
    if not len(starts):
        return np.zeros(0, U)
    sizes = stops - starts
    pieces_ = (sizes + 7) // 8
    heads = np.cumsum(pieces_) - pieces_
    nth = np.arange(int(pieces_.sum())) - np.repeat(heads, pieces_)
    at = np.repeat(starts, pieces_) + 8 * nth
    left = np.minimum(np.repeat(stops, pieces_) - at, 8).astype(U)
    with np.errstate(over="ignore"):
        held = eights(a)[at] & (~U(0) >> (U(64) - U(8) * left))
        mixed = mix(mix(held + U(BASE)) ^ mix((nth + 1).astype(U) * U(BASE)))
        return mix(np.add.reduceat(mixed, heads) + sizes.astype(U) * U(BASE))


class Roller:
    """Prefix sums of symbol values; `span` gives fingerprints of spans."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 1024), powers(INVERSE, 1024)

    def load(self, values: np.ndarray) -> "Roller":
        n = len(values)
        if n + 1 > len(self.up):
            size = 1 << (n + 1).bit_length()
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * self.up[:n], out=self.sums[1:])
        return self

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


class ByteRoller(Roller):
    """A Roller over hashes of the `width` bytes from each byte on; spans are of `width` bytes at least."""

    def __init__(self, width: int = 8) -> None:
        super().__init__()
        self.width = width

    def load(self, a: np.ndarray) -> "ByteRoller":
        held = eights(a)[: max(len(a) - self.width + 1, 0)] & (~U(0) >> U(64 - 8 * self.width))
        super().load(mix(held + U(BASE)))
        return self

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return super().span(start, end - (self.width - 1))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, in a constant number of passes."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    pad = -len(v) % width
    full = np.concatenate((v, np.full(pad, ~U(0), U))) if pad else v
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D."""
    gap = np.empty(len(a) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def minimizer_runs(roller: Roller, ends: np.ndarray, gram: int, window: int):
    """Split all windows of a piece into runs that share their minimizer.

    The piece is a concatenation of sequences; `ends` holds, for each symbol,
    where its sequence ends.  A window is `window` symbols of one sequence; its
    minimizer is the leftmost of its smallest grams of `gram` symbols, so equal
    windows choose the same gram.  Returns the arrays (gram fingerprint, gram
    start, first window start, last window start) of the runs, in order.
    """
    n = len(ends)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty.astype(U), empty, empty, empty
    at = np.arange(n - gram + 1)
    grams = roller.span(at, at + gram)
    low = U((1 << 24) - 1)
    packed = (grams & ~low) | at.astype(U)
    packed[at + gram > ends[: len(at)]] = ~U(0)
    chosen = (sliding_min(packed, window - gram + 1) & low).astype(np.int64)
    starts = at[: len(chosen)]
    good = starts + window <= ends[: len(chosen)]
    starts, chosen = starts[good], chosen[good]
    if not len(starts):
        return empty.astype(U), empty, empty, empty
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return grams[chosen[first]], chosen[first], starts[first], starts[last]


def pieces(lengths: np.ndarray, window: int, size: int = PIECE):
    """Groups of (document, from, to) symbol slices of about `size` symbols.

    Slices of one long document overlap by window - 1 symbols, so that each of
    its windows lies in just one slice.
    """
    group, total = [], 0
    for doc, n in enumerate(lengths):
        start = 0
        while True:
            end = min(int(n), start + size)
            group.append((doc, start, end))
            total += end - start
            if total >= size:
                yield group
                group, total = [], 0
            if end >= n:
                break
            start = end - window + 1
    if group:
        yield group
