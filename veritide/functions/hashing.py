"""Bit hashes, keyed digests and hash-based uniforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS, BAND_BITS = 16, 4


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def lsh_bands(h: Column, bands: int = BANDS, bits: int = BAND_BITS) -> Column:
    """Band i holds bits i*bits .. of a 64-bit hash, the lowest first."""
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return F.array(*[F.shiftrightunsigned(h, i * bits).bitwiseAND(mask) for i in range(bands)])


def sign_bits(vector: Column) -> Column:
    """The signs of 64 components as a 64-bit hash, the first component lowest."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint")))
    )


def sign_vector(h: Column) -> Column:
    """+1 / -1 for every bit, the highest first."""
    return F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(1).cast("bigint")) * 2 - 1)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a binary column under a fixed key."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def salted_band(index: Column, value: Column, key: bytes) -> Column:
    """The first 16 bytes, in hexadecimal, of the keyed digest of "index:value"."""
    return F.substring(hmac_sha256(key, F.concat_ws(":", index, value).cast("binary")), 1, 32)


def cluster_key(h: Column, key: bytes) -> Column:
    """24 hexadecimal digits over all salted bands of a hash."""
    bands = lsh_bands(h)
    digests = [F.unhex(salted_band(F.lit(i), bands[i], key)) for i in range(BANDS)]
    return F.substring(F.sha2(F.concat(*digests), 256), 1, 24)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the keys."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def cosine_parts(a: Column, b: Column) -> Column:
    """Inner product in doubles, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector over its Euclidean norm; a zero vector raises an error."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))
