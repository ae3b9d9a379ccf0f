"""Hashes: perceptual bits, Hamming distance, deterministic fractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rise_bits(vector: Column) -> Column:
    """Bit i, from the highest, tells whether element i+1 exceeds element i; up to 63 bits."""
    pairs = F.zip_with(vector, F.slice(vector, F.lit(2), F.size(vector) - 1), lambda a, b: F.when(b > a, 1).otherwise(0))
    bits = F.slice(pairs, F.lit(1), F.size(vector) - 1)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1) + b.cast("long"))


def word_code(word: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the word's MD5 as a number."""
    return F.conv(F.substring(F.md5(word), 1, digits), 16, 10).cast("long")


def simhash(df: DataFrame, key: str, words: Column, bits: int = 48) -> DataFrame:
    """(key, h): majority bit per place over the codes of the distinct words, lowest bit first; ties give 0.

    One row per word and an aggregate per bit: generated code, and a partial
    sum per document before the shuffle.
    """
    codes = df.select(key, F.explode(F.array_distinct(words)).alias("_w")).select(key, word_code(F.col("_w")).alias("_c"))
    votes = [F.sum(F.shiftright("_c", i).bitwiseAND(F.lit(1).cast("long")) * 2 - 1).alias(f"_b{i}") for i in range(bits)]
    set_bits = [F.when(F.col(f"_b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)]
    return codes.groupBy(key).agg(*votes).select(key, reduce(lambda x, y: x + y, set_bits).alias("h"))


def fraction(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of seed and key."""
    return word_code(F.concat(F.lit(f"{seed}:"), key), 13) / F.lit(float(1 << 52))


def blake_fraction(key: Column, seed: int) -> Column:
    """The same from 64 bits of BLAKE2s, for results that must equal such a rank."""

    @F.pandas_udf("double")
    def ranked(keys):
        import hashlib

        return keys.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2s(f"{seed}:{k}".encode(), digest_size=8).digest(), "big") / 2**64)

    return ranked(key)
