"""Bloom filters of key columns: built by a mergeable aggregate, tested as an expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainsieve.session import local_table

#: Bits for each key, the fewest and the most bits of a filter (2 MB), and how many of them a key sets.
BITS_PER_KEY = 12
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 24
HASHES = 4


@dataclass(frozen=True)
class Bloom:
    """A filter of at most ``MOST_BITS`` bits: small enough to travel inside a plan, whatever it was built from."""

    bits: int
    data: bytes

    def might_contain(self, key: Column, spark: SparkSession | None = None) -> Column:
        """False only for keys that are not in; a null key gives null.

        A literal is spelled out in every text of the plan, which the driver keeps.  With ``spark`` the filter is a scalar
        subquery over a local row instead, of which such a text has the name alone.
        """
        if spark is None:
            held = F.lit(bytearray(self.data))
        else:
            schema = T.StructType([T.StructField("data", T.BinaryType())])
            held = local_table(spark, [{"data": self.data}], schema).scalar()

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(held, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            return F.getbit(byte, (place % 8).cast("int")) == 1

        out = is_set(_place(key, 0, self.bits))
        for k in range(1, HASHES):
            out = out & is_set(_place(key, k, self.bits))
        return F.when(key.isNotNull(), out)


def _place(key: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits).cast("long"))


def build_bloom(keys: DataFrame, column: str, bits: int | None = None) -> Bloom:
    """The filter of a column's keys; nulls are left out.

    Keys become words with some bits set, and words of one place are merged by ``bit_or`` in every task before they are
    shuffled, so a task sends no more than the filter's size.  Without ``bits`` the size follows the number of keys, up to
    ``MOST_BITS``; beyond, the filter lets more keys through, and stays right.
    """
    own = keys.filter(F.col(column).isNotNull()).select(F.col(column).alias("key"))
    if bits is None:
        count = own.count()
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, count * BITS_PER_KEY))))))
    places = own.select(F.explode(F.array(*[_place(F.col("key"), k, bits) for k in range(HASHES)])).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("set")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, dtype="<i8")
    out[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64)
    return Bloom(bits, out.tobytes())
