"""Block quantization formats: decoding to floats and encoding of activations, in numpy over whole columns.

A format is a fixed number of elements in a fixed number of bytes, so a tensor is a matrix of blocks and every field of the
format is a slice of its columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _half(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(np.float16).astype(np.float32)


def bf16(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)


def _nibbles(raw: np.ndarray) -> np.ndarray:
    """Low halves of all bytes, then the high halves, along the last axis."""
    return np.concatenate([raw & 15, raw >> 4], -1).astype(np.float32)


def _fifth_bits(raw: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little").astype(np.float32) * 16


def _six_bit_pairs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight scales and eight minima from twelve bytes: six bits each, the upper four entries spread over all three parts."""
    a, b, c = raw[:, :4], raw[:, 4:8], raw[:, 8:]
    scales = np.concatenate([a & 63, c & 15 | (a >> 6) << 4], 1)
    minima = np.concatenate([b & 63, c >> 4 | (b >> 6) << 4], 1)
    return scales.astype(np.float32), minima.astype(np.float32)


def _q8_0(x: np.ndarray) -> np.ndarray:
    return _half(x[:, :2]) * x[:, 2:].view(np.int8)


def _q4_0(x: np.ndarray) -> np.ndarray:
    return _half(x[:, :2]) * (_nibbles(x[:, 2:]) - 8)


def _q4_1(x: np.ndarray) -> np.ndarray:
    return _half(x[:, :2]) * _nibbles(x[:, 4:]) + _half(x[:, 2:4])


def _q5_0(x: np.ndarray) -> np.ndarray:
    return _half(x[:, :2]) * (_nibbles(x[:, 6:]) + _fifth_bits(x[:, 2:6]) - 16)


def _q5_1(x: np.ndarray) -> np.ndarray:
    return _half(x[:, :2]) * (_nibbles(x[:, 8:]) + _fifth_bits(x[:, 4:8])) + _half(x[:, 2:4])


def _scaled(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """q (blocks, 8, 32) by the eight scales and minima at bytes 4 to 16."""
    scales, minima = _six_bit_pairs(x[:, 4:16])
    d, low = _half(x[:, :2]), _half(x[:, 2:4])
    return ((d * scales)[:, :, None] * q - (low * minima)[:, :, None]).reshape(len(x), 256)


def _q4_k(x: np.ndarray) -> np.ndarray:
    return _scaled(x, _nibbles(x[:, 16:].reshape(-1, 4, 32)).reshape(-1, 8, 32))


def _q5_k(x: np.ndarray) -> np.ndarray:
    high = (x[:, None, 16:48] >> np.arange(8, dtype=np.uint8)[:, None]) & 1
    return _scaled(x, _nibbles(x[:, 48:].reshape(-1, 4, 32)).reshape(-1, 8, 32) + 16 * high)


def _q6_k(x: np.ndarray) -> np.ndarray:
    low = _nibbles(x[:, :128].reshape(-1, 2, 64)).reshape(-1, 2, 4, 32)
    high = (x[:, 128:192].reshape(-1, 2, 1, 32) >> np.array([0, 2, 4, 6], np.uint8)[:, None]) & 3
    scales = np.repeat(np.ascontiguousarray(x[:, 192:208]).view(np.int8).reshape(-1, 2, 4, 2), 16, -1).astype(np.float32)
    return (_half(x[:, 208:210])[:, :, None, None] * scales * (low + 16 * high - 32)).reshape(len(x), 256)


#: type id -> (bytes of a block, decoder of a matrix of blocks)
DECODERS = {8: (34, _q8_0), 2: (18, _q4_0), 3: (20, _q4_1), 6: (22, _q5_0), 7: (24, _q5_1), 12: (144, _q4_k), 13: (176, _q5_k), 14: (210, _q6_k)}


def dequantize(raw: bytes, qtype: int) -> np.ndarray:
    """Floats of a tensor's bytes; a rest shorter than a block is left out. Unknown types are an error."""
    if qtype == 0:
        return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")
    if qtype == 1:
        return np.frombuffer(raw[: len(raw) // 2 * 2], "<f2").astype(np.float32)
    if qtype == 30:
        return bf16(raw[: len(raw) // 2 * 2])
    if qtype not in DECODERS:
        raise ValueError(f"no decoder for storage type {qtype}")
    size, decode = DECODERS[qtype]
    blocks = np.frombuffer(raw, np.uint8)[: len(raw) // size * size].reshape(-1, size)
    return decode(blocks).ravel()


def quantize_q8_0(v: np.ndarray) -> bytes:
    """Blocks of 32: half-precision scale and rounded quotients, halves away from zero."""
    x = np.asarray(v, np.float32)[: len(v) // 32 * 32].reshape(-1, 32)
    d = np.abs(x).max(1, keepdims=True) / 127
    q = np.divide(x, d, out=np.zeros_like(x), where=d > 0)
    q = np.clip(np.copysign(np.floor(np.abs(q) + 0.5), q), -127, 127).astype(np.int8)
    return np.concatenate([d.astype("<f2").view(np.uint8), q.view(np.uint8)], 1).tobytes()


def quantize_q4_0(v: np.ndarray) -> bytes:
    """Blocks of 32: the element of greatest magnitude maps to -8."""
    x = np.asarray(v, np.float32)[: len(v) // 32 * 32].reshape(-1, 32)
    top = np.take_along_axis(x, np.abs(x).argmax(1)[:, None], 1)
    d = top / -8
    q = np.clip(np.divide(x, d, out=np.zeros_like(x), where=d != 0) + 8.5, 0, 15).astype(np.uint8)
    return np.concatenate([d.astype("<f2").view(np.uint8), q[:, :16] | q[:, 16:] << 4], 1).tobytes()


def fused_dot(weights: bytes, activations: bytes) -> float:
    """Product of Q4_0 weights and Q8_0 activations: integer sums per block, then the two scales."""
    w, a = (np.frombuffer(x, np.uint8).reshape(-1, n) for x, n in ((weights, 18), (activations, 34)))
    sums = ((_nibbles(w[:, 2:]) - 8) * a[:, 2:].view(np.int8)).sum(1)
    return float((_half(w[:, :2])[:, 0] * _half(a[:, :2])[:, 0] * sums).sum())


def dequantized(raw: Column, qtype: Column) -> Column:
    """array<float> of binary tensor data, by Arrow batches; null data stay null."""

    @F.pandas_udf("array<float>")
    def decode(data: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else dequantize(x, int(k)) for x, k in zip(data, kinds)])

    return decode(raw, qtype)


def q4_0_block(v: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else quantize_q4_0(x) for x in vectors])

    return encode(v)


def q8_0_block(v: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else quantize_q8_0(x) for x in vectors])

    return encode(v)


def fused(weights: Column, activations: Column) -> Column:
    @F.pandas_udf("double")
    def run(w: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fused_dot(x, y) for x, y in zip(w, a)])

    return run(weights, activations)
