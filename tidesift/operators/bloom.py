"""Bloom filters over integer keys, as tables of bitmaps and as bytes.

A filter of m bits and k hashes is a DataFrame (bucket, bits) of Spark's bitmap aggregates, so it is built with partial
sums before the shuffle, merged by OR, and never has to fit one machine. Key hashes are xxhash64 with the probe's number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of a filter's table, and those of a filter that may be sent to all tasks (16 MB).
BITMAP, HELD_BITS = 32_768, 8 * 16 * 1024 * 1024
#: The share of set bits up to which these tell how many elements a filter holds; one sized for its elements has half of them set.
TELLING = 0.9


@dataclass(frozen=True)
class Sizing:
    """bits (m) and hashes (k) of a filter."""

    bits: int
    hashes: int

    @staticmethod
    def of(elements: int, error_rate: float = 0.001) -> Sizing:
        """The least filter for so many elements at a false-positive rate."""
        if elements < 0 or not 0 < error_rate < 1:
            raise ValueError("elements must be 0 or more and the error rate between 0 and 1")
        bits = 64 * math.ceil(-max(1, elements) * math.log(error_rate) / math.log(2) ** 2 / 64)
        return Sizing(bits, hashes_of(error_rate))


def hashes_of(error_rate: float) -> int:
    """round(-log2 of the rate), at least 1."""
    return max(1, round(-math.log2(error_rate)))


def integral(df: DataFrame, column: str) -> bool:
    """Whether a column can be a filter's key."""
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def distinct_keys(df: DataFrame, key: str) -> int:
    """How many elements a column's filter is of."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().count()


def sized_for(df: DataFrame, key: str, error_rate: float = 0.001) -> Sizing:
    """The least filter for a column's distinct values, counted first, so that the rate holds at any size."""
    return Sizing.of(distinct_keys(df, key), error_rate)


def _position_list(key: str | Column, size: Sizing) -> list[Column]:
    key = (F.col(key) if isinstance(key, str) else key).cast("long")
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(size.bits).cast("long")) for i in range(size.hashes)]


def _positions(key: str | Column, size: Sizing) -> Column:
    return F.array(*_position_list(key, size))


def build(df: DataFrame, key: str, size: Sizing) -> DataFrame:
    """bucket, bits: the filter of a column's distinct values that aren't null."""
    if not integral(df, key):
        raise TypeError(f"{key} isn't an integer column")
    at = df.where(F.col(key).isNotNull()).select(F.explode(_positions(key, size)).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def merge(*filters: DataFrame) -> DataFrame | None:
    """The union of filters of one sizing; None of none."""
    if not filters:
        return None
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def words_of(bloom: DataFrame, size: Sizing) -> DataFrame:
    """One row with a filter's bits as 64-bit words, for a filter of at most HELD_BITS: the bit of place p at p - 1, that of 0 last.

    Bitmaps number places from 1 on, in rows of BITMAP; only 0 stands in a row of its own.
    """
    import numpy as np

    bits = np.zeros(-(-size.bits // BITMAP) * BITMAP // 8, np.uint8)
    for r in bloom.collect():
        if r["bucket"]:
            bits[(r["bucket"] - 1) * BITMAP // 8 :][: BITMAP // 8] |= np.frombuffer(r["bits"], np.uint8)
        else:
            bits[(size.bits - 1) // 8] |= 1 << (size.bits - 1) % 8
    return bloom.sparkSession.createDataFrame([(bits.view("<i8").tolist(),)], "words array<long>")


def contains(df: DataFrame, key: str, bloom: DataFrame, size: Sizing, found: str = "found") -> DataFrame:
    """Adds whether the filter may hold a row's key; false for null.

    A filter of at most HELD_BITS (its size is known before any row is read) goes to all tasks as one array, and a key's
    bits are looked up in compiled code, the next only if the last was set: no row moves. A larger one stays a table:
    each bit of the distinct keys is looked up by an equi-join on the bitmap's bucket.
    """
    if size.bits <= HELD_BITS:
        words = words_of(bloom, size).select("words").scalar()
        hit = F.col(key).isNotNull()
        for at in (F.pmod(p - 1, F.lit(size.bits).cast("long")) for p in _position_list(key, size)):
            hit = hit & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return df.withColumn(found, F.coalesce(hit, F.lit(False)))
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    at = keys.withColumn("_at", F.explode(_positions("_key", size))).withColumn("bucket", F.bitmap_bucket_number("_at"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.lit(1) + F.floor(bit / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("1") * F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (bit % 8 + 1).cast("int"))) > 0, F.lit(False))
    held = at.join(bloom, "bucket", "left").withColumn("_set", is_set).groupBy("_key").agg(F.bool_and("_set").alias(found))
    return df.join(held, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(found, F.coalesce(found, F.lit(False)))


def semi_filter(df: DataFrame, key: str, build_side: DataFrame, build_key: str) -> DataFrame:
    """The exact counterpart: rows whose key the build side has. What a filter's pass plus the later join leave."""
    keys = build_side.where(F.col(build_key).isNotNull()).select(F.col(build_key).alias("_build_key")).distinct()
    return df.join(keys, F.col(key) == F.col("_build_key"), "left_semi")


def stats(bloom: DataFrame, size: Sizing, error_rate: float = 0.001) -> DataFrame:
    """bits, hashes, set_bits, fill, estimated_elements, estimated_fpr, capacity_percent of a filter, as one row."""
    m, k = size.bits, size.hashes
    s = bloom.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("set_bits"))
    fill = F.col("set_bits") / F.lit(m)
    s = s.select(F.lit(m).cast("long").alias("bits"), F.lit(k).alias("hashes"), "set_bits", fill.alias("fill"))
    s = s.withColumn("estimated_elements", F.when(F.col("fill") < 1, -F.lit(m / k) * F.log(1 - F.col("fill"))))
    s = s.withColumn("estimated_fpr", F.pow(1 - F.exp(-F.lit(k) * F.col("estimated_elements") / F.lit(m)), F.lit(k)))
    room = m * math.log(2) ** 2 / -math.log(error_rate)
    return s.withColumn("capacity_percent", 100 * F.col("estimated_elements") / F.lit(room))


def held_elements(df: DataFrame, key: str, size: Sizing) -> float:
    """The elements that a column's filter of a sizing holds: by its set bits, or counted where so many are set that they don't tell."""
    told = stats(build(df, key, size), size).first()
    if told["fill"] <= TELLING:
        return told["estimated_elements"]
    return float(distinct_keys(df, key))


def calibrated_elements(estimated: float, fill_target: float = 0.9) -> int:
    """Elements to size the next filter for, so that it is filled to nine tenths."""
    return math.ceil(estimated / fill_target)


def false_positive_rate(probe: DataFrame, probe_key: str, build_side: DataFrame, build_key: str, size: Sizing) -> DataFrame:
    """negatives, false_positives and rate: distinct probe keys that the build side lacks and the filter yet passes."""
    keys = probe.where(F.col(probe_key).isNotNull()).select(F.col(probe_key).alias("k")).distinct()
    negatives = keys.join(build_side.select(F.col(build_key).alias("_b")).distinct(), F.col("k") == F.col("_b"), "left_anti")
    hit = contains(negatives, "k", build(build_side, build_key, size), size)
    return hit.agg(F.count("*").alias("negatives"), F.count(F.when(F.col("found"), 1)).alias("false_positives")).withColumn(
        "rate", F.try_divide(F.col("false_positives").cast("double"), F.col("negatives")))


class BloomBytes:
    """A filter in memory, in a portable layout: a big-endian 32-bit count of hashes, then the bits.

    A key's places are h + i * g for i from 0, with two mixes of the key, all keys of a batch at once.
    """

    def __init__(self, size: Sizing, bits: bytearray | bytes | None = None):
        import numpy as np

        if size.bits % 8:
            raise ValueError("bits must fill bytes")
        self.size = size
        self.bits = np.frombuffer(bytes(bits), np.uint8).copy() if bits is not None else np.zeros(size.bits // 8, np.uint8)

    def _at(self, keys):
        import numpy as np

        h, g = (_mixed(np.asarray(keys, np.int64).view(np.uint64), seed) for seed in (1, 2))
        steps = np.arange(self.size.hashes, dtype=np.uint64)
        return ((h[:, None] + steps * (g[:, None] | np.uint64(1))) % np.uint64(self.size.bits)).astype(np.int64)

    def add_all(self, keys) -> None:
        import numpy as np

        at = self._at(keys).ravel()
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def contains_all(self, keys):
        at = self._at(keys)
        return (self.bits[at >> 3] >> (at & 7) & 1).all(axis=1)

    def add(self, key: int) -> None:
        self.add_all([key])

    def __contains__(self, key: int) -> bool:
        return bool(self.contains_all([key])[0])

    def __or__(self, other: BloomBytes) -> BloomBytes:
        if self.size != other.size:
            raise ValueError("filters of different sizing can't be merged")
        return BloomBytes(self.size, (self.bits | other.bits).tobytes())

    def dump(self) -> bytes:
        return self.size.hashes.to_bytes(4, "big") + self.bits.tobytes()

    @staticmethod
    def load(raw: bytes) -> BloomBytes:
        return BloomBytes(Sizing(8 * (len(raw) - 4), int.from_bytes(raw[:4], "big")), raw[4:])


def _mixed(keys, seed: int):
    import numpy as np

    z = keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def contains_udf(bloom: BloomBytes):
    """A vectorised function over a column of keys, for a filter small enough to send along; false for null."""
    raw = bloom.dump()

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        return known & pd.Series(BloomBytes.load(raw).contains_all(keys.where(known, 0).astype("int64").to_numpy()), keys.index)

    return held


def save_bytes(df: DataFrame, key: str, size: Sizing, path: str) -> None:
    """A column's filter as a file of one row in the portable layout, replacing what is there: each task adds its rows to a
    filter of its own, and these are merged."""
    raw = BloomBytes(size).dump()

    def each(batches):
        import pyarrow as pa

        own = BloomBytes.load(raw)
        for batch in batches:
            own.add_all(batch.column("k").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([own.dump()], pa.binary())], names=["filter"])

    def merged(batches):
        import pyarrow as pa

        own = BloomBytes.load(raw)
        for batch in batches:
            for x in batch.column("filter").to_pylist():
                own = own | BloomBytes.load(x)
        yield pa.RecordBatch.from_arrays([pa.array([own.dump()], pa.binary())], names=["filter"])

    parts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).mapInArrow(each, "filter binary")
    parts.coalesce(1).mapInArrow(merged, "filter binary").write.mode("overwrite").parquet(path)


def load_bytes(spark, path: str) -> BloomBytes:
    """The filter that ``save_bytes`` left."""
    return BloomBytes.load(bytes(spark.read.parquet(path).first()["filter"]))
