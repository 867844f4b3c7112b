"""Ed25519 signatures over content hashes (RFC 8032), in plain Python: no library for them is installed."""

from __future__ import annotations

import hashlib
import secrets

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, P - 2, P) % P


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if not square:
        return None if odd else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != odd else x


def _point(x: int, y: int) -> tuple[int, int, int, int]:
    return x, y, 1, x * y % P


BASE = _point(_x_of(BASE_Y, 0), BASE_Y)


def _add(a: tuple, b: tuple) -> tuple:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    h, j, g, k = f - e, d - c, d + c, f + e
    return h * j % P, g * k % P, j * g % P, h * k % P


def _times(n: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point = _add(point, point)
        n >>= 1
    return out


_POWERS: list[tuple] = []


def _times_base(n: int) -> tuple:
    """A multiple of the base point by its stored doublings."""
    if not _POWERS:
        point = BASE
        for _ in range(256):
            _POWERS.append(point)
            point = _add(point, point)
    out, at = (0, 1, 1, 0), 0
    while n:
        if n & 1:
            out = _add(out, _POWERS[at])
        n >>= 1
        at += 1
    return out


def _pack(point: tuple) -> bytes:
    inverse = pow(point[2], P - 2, P)
    x, y = point[0] * inverse % P, point[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> tuple | None:
    if len(data) != 32:
        return None
    n = int.from_bytes(data, "little")
    y = n & ((1 << 255) - 1)
    x = _x_of(y, n >> 255)
    return None if x is None else _point(x, y)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _expanded(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    return (int.from_bytes(h[:32], "little") & ((1 << 254) - 8)) | (1 << 254), h[32:]


def new_key() -> bytes:
    """32 random bytes."""
    return secrets.token_bytes(32)


def public_key(key: bytes) -> bytes:
    return _pack(_times_base(_expanded(key)[0]))


def sign(key: bytes, message: bytes) -> bytes:
    """Signature of 64 bytes."""
    own, prefix = _expanded(key)
    public = _pack(_times_base(own))
    r = _number(prefix, message)
    first = _pack(_times_base(r))
    return first + ((r + _number(first, public, message) * own) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes | None) -> bool:
    if signature is None or len(signature) != 64:
        return False
    own, first, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if own is None or first is None or s >= ORDER:
        return False
    left, right = _times_base(s), _add(first, _times(_number(signature[:32], public, message), own))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def with_signature(docs, key: bytes, *, text: str = "text", out: str = "signature"):
    """Add the signature of the SHA-256 of each text; null text has none."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def run(hashes):
        return hashes.map(lambda h: None if h is None else sign(key, bytes.fromhex(h)))

    return docs.withColumn(out, run(F.sha2(text, 256)))


def verified(docs, public: bytes, *, text: str = "text", signature: str = "signature", out: str = "valid"):
    """Add whether the signature is that of the text by the holder of the key."""
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def run(hashes, signatures):
        return pd.Series([h is not None and verify(public, bytes.fromhex(h), s) for h, s in zip(hashes, signatures, strict=True)], dtype="bool")

    return docs.withColumn(out, run(F.sha2(text, 256), F.col(signature)))
