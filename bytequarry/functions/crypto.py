"""Encryption: AES as the native functions of Spark, keys from passwords by a kernel."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytequarry.functions import kernels


def aes_cbc_encrypt(data: Column, key: Column, vector: Column) -> Column:
    """The vector's 16 bytes and the padded blocks."""
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), vector)


def aes_cbc_decrypt(data: Column, key: Column) -> Column:
    """Null where the padding is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def derived_key(rounds: int, size: int = 32, digest: str = "sha256"):
    """A column function: the PBKDF2 key of ``size`` bytes from a password and a salt."""

    @kernels.kernel(pa.binary())
    def derive(passwords: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array([None if p is None or s is None else hashlib.pbkdf2_hmac(digest, p, s, rounds, size) for p, s in zip(passwords.to_pylist(), salts.to_pylist())], pa.binary())

    return derive
