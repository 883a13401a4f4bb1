"""Poisson weights for bootstraps, drawn by arithmetic that any SQL engine can repeat.

By cell: a cell of n equal rows gets the weight that n rows would get together, a Poisson(n) number, from one draw of
(group, cell, replicate). The draw is a cubic polynomial modulo a prime, so it needs no state: every task, and every engine,
draws the same weights.

By row: every row gets a Poisson(1) weight of its own from the md5 of 'replicate:row'. The digests of a batch of rows are
taken at once, as the steps of RFC 1321 on arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The modulus, the multipliers of cell and replicate, and the polynomial's coefficients, highest first.
PRIME = 2 ** 31 - 1
CELL_STEP, REPLICATE_STEP = 1_103_515_245, 747_796_405
POLYNOMIAL = (1_597_334_677, 914_867_207, 1_283_169_405, 374_761_393)
EXACT_N = 64  # up to this count by the distribution itself, beyond it by its normal approximation
# Coefficients of the rational approximation of the normal quantile (relative error below 1.2e-9).
QUANTILE_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
              -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
              -1.328068155288572e+01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
              4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
TAIL = 0.02425


def group_number(by: list[str]) -> Column:
    """A number for the group's key: 7 hex digits of the md5 of its text, below the modulus."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *by).cast("binary")), 1, 7), 16, 10).cast("bigint")


def uniforms(group: int, cells: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """One number in (0, 1) per cell and replicate."""
    z = (group + (cells[:, None] % PRIME) * CELL_STEP + replicates[None, :] * REPLICATE_STEP) % PRIME
    v = np.full_like(z, POLYNOMIAL[0])
    for c in POLYNOMIAL[1:]:
        v = (v * z + c) % PRIME
    return (v + 0.5) / PRIME


def poisson_table(n: int) -> np.ndarray:
    """Cumulative probabilities of Poisson(n) up to the draws' resolution."""
    p = c = np.exp(-float(n))
    out, k = [c], 0
    while k < most_draws(n):
        k += 1
        p = p * n / k
        c = c + p
        out.append(c)
    return np.array(out)


def most_draws(n: int) -> int:
    return int(n + 7 * np.sqrt(n) + 12)


_tables: dict[int, np.ndarray] = {}


def _polynomial(coefficients: tuple, x: np.ndarray) -> np.ndarray:
    out = np.full_like(x, coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(u: np.ndarray) -> np.ndarray:
    tail = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    outer = _polynomial(QUANTILE_C, tail) / _polynomial((*QUANTILE_D, 1.0), tail)
    q = u - 0.5
    inner = _polynomial(QUANTILE_A, q * q) * q / _polynomial((*QUANTILE_B, 1.0), q * q)
    return np.where(u < TAIL, outer, np.where(u > 1 - TAIL, -outer, inner))


def poisson(n: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson(n) numbers for the rows of u."""
    out = np.zeros(u.shape)
    for value in np.unique(n):
        at = n == value
        if value <= 0:
            continue
        if value <= EXACT_N:
            table = _tables.setdefault(int(value), poisson_table(int(value)))
            out[at] = np.searchsorted(table, u[at], side="right")
        else:
            z = normal_quantile(u[at])
            out[at] = np.maximum(np.floor(value + np.sqrt(float(value)) * z + (z * z - 1) / 6 + 0.5), 0.0)
    return out


def weights(group: int, cells: np.ndarray, n: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    return poisson(n, uniforms(group, cells.astype(np.int64), replicates.astype(np.int64)))


# Cumulative Poisson(1) probabilities e^-1 * sum 1/k!, k = 0..8; nine draws at most matter at 32 bits.
POISSON_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974021]
_CUTS = [np.uint32(np.ceil(v * 2.0 ** 32)) for v in POISSON_CDF]
# RFC 1321.
_MD5_START = (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)
_MD5_ADD = [int(abs(np.sin(i + 1.0)) * 2.0 ** 32) for i in range(64)]
_MD5_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_WORD = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)


def md5_heads(words: list) -> np.ndarray:
    """The first 8 hex digits, as numbers, of the md5 of one-block messages, given as 16 words: each an array, with one entry
    a message, or a number that all messages share. The steps after the 61st do not touch these digits."""
    shape = next(w.shape for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _MD5_START)
    f = np.empty(shape, np.uint32)
    for i in range(61):
        turn, word = _MD5_TURN[i // 16][i % 4], words[_MD5_WORD[i // 16](i)]
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        if isinstance(word, np.ndarray):
            a += word
            a += np.uint32(_MD5_ADD[i])
        else:
            a += np.uint32((_MD5_ADD[i] + word) % 2 ** 32)
        np.left_shift(a, np.uint32(turn), out=f)
        a >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_MD5_START[0])
    return b.byteswap()


AT_ONCE = 1 << 14  # digests per call: arrays that stay in a core's cache


def row_weights(rows: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, one line a replicate and one column a row number, from the md5 of 'replicate:row'."""
    out = np.empty((len(replicates), len(rows)), np.float32)
    text = np.asarray(rows, np.int64).astype("S20")
    digits, size = text.view(np.uint8).reshape(len(rows), -1), np.char.str_len(text)
    heads = np.char.add(np.asarray(replicates, np.int64).astype("S20"), b":")
    front = np.zeros((len(heads), 64), np.uint8)
    front[:, :heads.itemsize] = heads.view(np.uint8).reshape(len(heads), -1)
    front, before = front.view("<u4"), np.char.str_len(heads)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for m in np.unique(before):
            block = np.zeros((len(at), 64), np.uint8)
            block[:, m:m + n] = digits[at, :n]
            block[:, m + n] = 0x80
            block[:, 56:] = np.frombuffer(int(8 * (m + n)).to_bytes(8, "little"), np.uint8)
            block, same = block.view("<u4"), np.flatnonzero(before == m)
            step = max(AT_ONCE // len(at), 1)
            for a in range(0, len(same), step):
                reps = same[a:a + step]
                words = [front[reps, i][:, None] | block[:, i] if i * 4 < m + n + 1 else int(block[0, i]) for i in range(16)]
                drawn = md5_heads(words)
                w = np.zeros(drawn.shape, np.uint8)
                for cut in _CUTS:
                    w += drawn >= cut
                out[np.ix_(reps, at)] = w
    return out
