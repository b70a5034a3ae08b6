import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritide.functions import canonical as C
from veritide.functions import hashing as H


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize(("raw", "key"), [("9876543210", "9876543210"), ("+91 98765-43210", "9876543210"), ("09876543210", "9876543210"), ("919876543210", "9876543210"), (None, None), ("", None), ("12345", None), ("notaphone", None), ("98765432101234", None)])
def test_phone(spark, raw, key):
    assert one(spark, raw, C.phone_key) == key


@pytest.mark.parametrize(("raw", "key"), [("A.B.C+d@GMAIL.com ", "abc@gmail.com"), ("abc@googlemail.com", "abc@gmail.com"), ("A.B+tag@Yahoo.com", "a.b+tag@yahoo.com"), ("@nolocal.com", None), ("nodomain@", None), ("plain", None), (None, None), ("a@b@c.org", "a@b@c.org"), ("+x@gmail.com", None)])
def test_email(spark, raw, key):
    assert one(spark, raw, C.email_key) == key


def test_address_and_pin(spark):
    assert one(spark, "Flat 12, Opp City Mall, Nr Station", C.address_key) == "flat 12 opposite city mall near station"
    assert one(spark, "H.No. 97, The Rd", C.address_key) == "h number 97 road"
    assert one(spark, None, C.address_key) == "" and one(spark, "मकान १२", C.address_key).endswith("12")
    assert one(spark, "560 001", C.pin_key) == "560001" and one(spark, "5600", C.pin_key) is None


def test_address_pairs(spark):
    pairs = [
        ("Flat 12, Opp City Mall, Nr Station", "flat no 12 opposite city mall near railway station", True),
        ("H.No. 97 Chanda Marg, Faridabad", "H.No. 51 Garg Marg, Faridabad", False),
        ("Flat 12, Green Society, Bandra", "Green Society, Bandra", True),
        ("", "Green Society", False),
    ]
    df = spark.createDataFrame([(a, b, "1") for a, b, _ in pairs], "a string, b string, pin string").select(C.address_key(F.col("a")).alias("a"), C.address_key(F.col("b")).alias("b"), "pin")
    assert [r.m for r in df.select(C.addresses_match(F.col("a"), F.col("pin"), F.col("b"), F.col("pin")).alias("m")).collect()] == [m for *_, m in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=6), st.lists(st.sampled_from("abcde"), max_size=6))
def test_token_set_similarity(a, b):
    x, y = " ".join(a), " ".join(b)
    s = C.token_set_similarity(x, y)
    assert 0 <= s <= 100 and s == C.token_set_similarity(y, x)
    if set(a) and set(a) <= set(b):
        assert s == 100


def test_device_key(spark):
    df = spark.createDataFrame([(" UA ", "1x2", None, ["b", "a"])], "a string, b string, c string, d array<string>")
    assert df.select(C.device_key(*map(F.col, "abcd")).alias("k")).collect()[0].k == hashlib.sha256(b"ua|1x2||a,b").hexdigest()
    empty = spark.createDataFrame([(None, "", None, [])], "a string, b string, c string, d array<string>")
    assert empty.select(C.device_key(*map(F.col, "abcd")).alias("k")).collect()[0].k is None


def test_bit_hashes(spark):
    values = [0, -1, 0x123456789ABCDEF0, -0x0FEDCBA987654321]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    got = df.select("h", H.lsh_bands(F.col("h")).alias("b"), H.sign_vector(F.col("h")).alias("v"), H.hamming(F.col("h"), F.lit(0).cast("long")).alias("d")).collect()
    for r in got:
        u = r.h & (1 << 64) - 1
        assert r.b == [u >> 4 * i & 15 for i in range(16)] and r.v == [1 if u >> i & 1 else -1 for i in range(63, -1, -1)] and r.d == u.bit_count()


def test_keyed_digests(spark):
    for key in (b"k", b"x" * 80):
        got = spark.createDataFrame([("3:7",)], "m string").select(H.hmac_sha256(key, F.col("m").cast("binary")).alias("a"), H.salted_band(F.lit(3), F.lit(7), key).alias("b")).collect()[0]
        want = hmac.new(key, b"3:7", hashlib.sha256).hexdigest()
        assert got.a == want and got.b == want[:32]


def test_unit_vectors(spark):
    assert one(spark, [3.0, 4.0], H.unit, "array<float>") == [0.6, 0.8]
    with pytest.raises(Exception, match="direction"):
        one(spark, [0.0, 0.0], H.unit, "array<float>")
