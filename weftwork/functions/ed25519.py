"""Ed25519 signatures (RFC 8032) in plain Python, and their check as a column."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The curve.
P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
_ROOT = pow(2, (P - 1) // 4, P)


def _recover(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    x2 = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    if x2 == 0:
        return None if sign else 0
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * _ROOT % P
    if (x * x - x2) % P:
        return None
    return P - x if x & 1 != sign else x


_BY = 4 * pow(5, -1, P) % P
_BX = _recover(_BY, 0)
_BASE = (_BX, _BY, 1, _BX * _BY % P)
_ZERO = (0, 1, 1, 0)


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, p: tuple) -> tuple:
    out = _ZERO
    while k:
        if k & 1:
            out = _add(out, p)
        p = _add(p, p)
        k >>= 1
    return out


def _pack(p: tuple) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes) -> tuple | None:
    n = int.from_bytes(b, "little")
    y = n & ((1 << 255) - 1)
    x = _recover(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pub = _pack(_times(a, _BASE))
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % L
    big = _pack(_times(r, _BASE))
    k = int.from_bytes(hashlib.sha512(big + pub + message).digest(), "little") % L
    return big + ((r + k * a) % L).to_bytes(32, "little")


def verify(pub: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    """Whether the signature is the key's for the message; false for nulls and malformed values."""
    if pub is None or message is None or signature is None or len(pub) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(pub), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + pub + message).digest(), "little") % L
    p, q = _times(s, _BASE), _add(r, _times(k, a))
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def _verify(pub: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    raw = lambda x: None if x is None else bytes(x)
    return pd.Series([verify(raw(p), raw(m), raw(s)) for p, m, s in zip(pub, message, signature, strict=True)], dtype=bool)


def signed(pub: Column, message: Column, signature: Column) -> Column:
    """Binary columns to whether each row's signature holds; a few milliseconds a row."""
    return F.pandas_udf(_verify, T.BooleanType())(pub, message, signature)
