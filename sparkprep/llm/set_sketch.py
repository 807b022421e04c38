"""SetSketch: registers that hold exponentially spaced, truncated minima of a set's hashes.

Register i holds K = floor(1 - log_b(x)) cut to 0..q+1, where x is the least of the set's values that are exponentially
distributed with rate a. As K falls with x, only the least hash of each register is needed; the maximum of two registers is
the register of the union, so sketches merge in any order. Two registers agree with a probability near the Jaccard
similarity, which makes bands of them locality-sensitive.
"""

from __future__ import annotations

import numpy as np


def constants(m: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the registers' hash functions; every worker derives the same ones."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, m, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, m, np.uint32)


def registers(items: np.ndarray, starts: np.ndarray, m: int, b: float = 1.001, a: float = 20.0, q: int = 65534) -> np.ndarray:
    """(sets, m) registers of sets given by mixed 32-bit hashes, one set after the other; no set may be empty."""
    mul, add = constants(m)
    out = np.empty((len(starts), m), np.uint16)
    for i in range(m):
        h = items * mul[i]
        h += add[i]
        out[:, i] = level(np.minimum.reduceat(h, starts), b, a, q)
    return out


def level(least: np.ndarray, b: float, a: float, q: int) -> np.ndarray:
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / a
    return np.clip(np.floor(1 - np.log(x) / np.log(b)), 0, q + 1).astype(np.uint16)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the unions."""
    return np.maximum(left, right)


def joint_jaccard(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, b: float = 1.001, steps: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of sets of known sizes.

    The counts of registers where the left is greater, less and equal follow a trinomial whose probabilities depend on the
    similarity alone; its concave log-likelihood is maximised by golden section over the range that the sizes allow.
    """
    m = left.shape[1]
    more, less = (left > right).sum(1), (left < right).sum(1)
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (b - 1) / b) / np.log(b), 1e-9, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        f, g = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return more * np.log(f) + less * np.log(g) + (m - more - less) * np.log(np.clip(1 - f - g, 1e-9, 1))

    lo, hi, ratio = np.zeros(len(left)), np.minimum(u, v) / np.maximum(u, v), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        up = likelihood(c) < likelihood(d)
        lo, hi = np.where(up, c, lo), np.where(up, hi, d)
    return (lo + hi) / 2


def pack_bits(regs: np.ndarray, planes: int = 1) -> np.ndarray:
    """The first bits of each register's hash, 64 in a word, plane after plane: a sketch of the sketch that still estimates similarity."""
    mixed = regs.astype(np.uint32) * np.uint32(2654435761)
    packed = np.concatenate([np.packbits((mixed >> np.uint32(31 - k) & np.uint32(1)).astype(np.uint8), axis=1) for k in range(planes)], 1)
    return np.ascontiguousarray(packed).view(np.uint64)


def bit_matches(left: np.ndarray, right: np.ndarray, planes: int = 1) -> np.ndarray:
    """Number of registers in each row that are equal in all planes."""
    words = left.shape[1] // planes
    other = left ^ right
    for k in range(1, planes):
        other[:, :words] |= other[:, k * words : (k + 1) * words]
    return words * 64 - np.bitwise_count(other[:, :words]).sum(1, dtype=np.int64)


def least_matches(m: int, n_left: np.ndarray, n_right: np.ndarray, threshold: float, sigmas: float, planes: int = 1) -> np.ndarray:
    """Matches below which the likelihood rules a pair out.

    The bits of a register agree with probability J + (1 - J) / 2^planes. With J at the threshold the matches lie above this
    bound but for ``sigmas`` deviations; sizes whose ratio is under the threshold rule a pair out at once, as J cannot exceed it.
    """
    p = threshold + (1 - threshold) / 2**planes
    bound = np.floor(m * p - sigmas * np.sqrt(m * p * (1 - p)))
    return np.where(np.minimum(n_left, n_right) < threshold * np.maximum(n_left, n_right), m + 1, bound)
