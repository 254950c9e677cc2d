"""String hashes as column expressions; all arithmetic stays inside 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a parameters and the 32-bit mask.
FNV_SEED, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def code_points(text: Column) -> Column:
    """The code point of every character, in order."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c).cast("long"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over code points, as an unsigned 32-bit number in a long; null stays null."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
    return F.when(text.isNotNull(), F.aggregate(code_points(text), F.lit(FNV_SEED).cast("long"), step))


def fnv_hex(text: Column) -> Column:
    return F.lower(F.hex(fnv1a32(text)))


def stable_score(text: Column) -> Column:
    """The 31-polynomial string hash, as an unsigned 32-bit number in a long."""
    step = lambda h, c: (h * F.lit(31) + c).bitwiseAND(F.lit(MASK32))
    return F.when(text.isNotNull(), F.aggregate(code_points(text), F.lit(0).cast("long"), step))


def digest_number(text: Column, hex_digits: int) -> Column:
    """The first hex digits of the SHA-256 of a text, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, hex_digits), 16, 10).cast("long")


def split_name(text: Column, hex_digits: int) -> Column:
    """Development, validation or blind in the ratio 6 : 2 : 2, by digest; two digits or eight."""
    bucket = digest_number(text, hex_digits) % 10
    return F.when(bucket < 6, "development").when(bucket < 8, "validation").otherwise("blind")


def group_digest(members: Column, joiner: str = ":", digits: int = 16) -> Column:
    """A name for a set of members that doesn't depend on their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), joiner), 256), 1, digits)
