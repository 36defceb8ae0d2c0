"""Rows that were delivered again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.session import cut

#: Bits of one map: that many (4 KB) make a row of the table of maps.
MAP_BITS = 32_768
#: Bits of all maps together at most: 16 MB, whatever the data.
MOST_BITS = 1 << 27


def _place(digest: Column, bits: int) -> tuple[Column, Column]:
    """(number of the map, bit in it) of a key's digest."""
    at = F.pmod(digest, F.lit(bits))
    return F.shiftright(at, 15).cast("int"), at % MAP_BITS


def _set(maps: str, bit: Column) -> Column:
    """Whether the bit is set in the map that was joined to the row; false without a map."""
    byte = F.conv(F.hex(F.substring(F.col(maps), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _bits(keys: int, most_bits: int) -> int:
    """Bits of the maps of so many keys: 256 a key, `most_bits` at most."""
    bits = MAP_BITS
    while bits < min(256 * keys, most_bits):
        bits *= 2
    return bits


def _with_maps(df: DataFrame, digest: Column, digests: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """`df` with the map of its `digest`, and whether its bit is set; the maps are those of the column h of `digests`."""
    number, bit = _place(digest, bits)
    n, m = "__n", "__m"
    while {n, m} & set(df.columns):
        n, m = n + "_", m + "_"
    its_number, its_bit = _place(F.col("h"), bits)
    maps = F.broadcast(digests.groupBy(its_number.alias(n)).agg(F.bitmap_construct_agg(its_bit).alias(m)))
    return df.withColumn(n, number).join(maps, n, "left"), _set(m, bit)


def among(df: DataFrame, key: str, keys: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of `df` whose `key` is one of `keys` (cut; that one column), and by chance a few others, for a join of what is
    then made of them: bit maps go to every task, so no row of `df` moves, whatever the number of keys."""
    digest = F.xxhash64(key)
    rows, hit = _with_maps(df, digest, keys.select(digest.alias("h")), _bits(keys.count(), most_bits))
    return rows.where(hit & F.col(key).isNotNull()).select(*df.columns)


def first_delivery(df: DataFrame, key: list[str], by: str, key_rows: DataFrame | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each `key`: that with the smallest `by` (nulls last; further ties by the whole row's hash).

    Only keys are shuffled to find those delivered more than once. Hashes of these set bits in maps, 256 bits a key and
    `most_bits` at most, which every task gets: a row whose bit isn't set is the only one of its key and stays where it is; the others are reduced
    to one per key by an aggregation that combines before the shuffle. Neither side of a join is ever a list of keys, whatever
    their number; with very many repeated keys more single rows hit a bit by chance and take the second way (one in 256
    up to half a million repeated keys, one in ten at 14 million), with the same result. Rows whose key has a null are kept as they
    are, for nothing says that they are the same. Empty input gives empty output; columns are kept, whatever their names.
    """
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    again = (key_rows if key_rows is not None else df).select(*key).where(~null).groupBy(*key).count().where("count > 1")
    again = cut(again.select(F.xxhash64(*key).alias("h")))
    rows, hit = _with_maps(df, F.xxhash64(*key), again, _bits(again.count(), most_bits))
    hit = hit & ~null
    stay, many = rows.where(~hit).select(*df.columns), rows.where(hit)
    order = F.struct(F.col(by).isNull().alias("a"), F.col(by).alias("b"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in key]).alias("c"))
    once = many.groupBy(*key).agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]), order).alias("r"))
    return stay.unionByName(once.select(*[F.col(f"r.c{k}").alias(c) for k, c in enumerate(df.columns)]))
