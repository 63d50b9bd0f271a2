"""Near-duplicate images by their difference hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import greedy, hamming
from framewright.session import checkpointed


def _codes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.min("id").alias("id"))


def members(df: DataFrame, *, bits: int, id_col: str = "hash_id", hash_col: str = "hash") -> DataFrame:
    """(id_col, representative): every row with a usable hash and the smallest id of that hash, by which near_pairs names it."""
    rows = hamming.packed(df, id_col, hash_col, bits)
    return rows.join(_codes(rows).withColumnRenamed("id", "representative"), "code").select(F.col("id").alias(id_col), "representative")


def near_pairs(df: DataFrame, *, bits: int, most: int, id_col: str = "hash_id", hash_col: str = "hash") -> DataFrame:
    """(id_a, id_b, distance): pairs of different hashes at most most bits apart, once each, by the smallest id of each hash; members() gives the rows that stand behind it."""
    codes = _codes(hamming.packed(df, id_col, hash_col, bits))
    flagged = codes.select(F.lit(0).cast("bigint").alias("part"), "id", "code", F.lit(True).alias("flag"))
    return hamming.near_pairs(flagged, bits=bits, most=most).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("d").alias("distance"))


def duplicates(df: DataFrame, *, bits: int, most: int, id_col: str = "hash_id", hash_col: str = "hash") -> DataFrame:
    """(id_col): rows dropped when going by id and dropping what is near a row kept before.

    Rows of one hash have the same neighbours, so the smallest id decides for
    them and the others are always dropped. Rows without a usable hash stay.
    """
    rows = hamming.packed(df, id_col, hash_col, bits)
    codes = checkpointed(_codes(rows))
    flagged = codes.select(F.lit(0).cast("bigint").alias("part"), "id", "code", F.lit(True).alias("flag"))
    edges = hamming.near_pairs(flagged, bits=bits, most=most).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    gone = greedy.dropped(edges)
    kept = codes.join(gone, "id", "left_anti").select("id")
    return rows.select("id").join(kept, "id", "left_anti").select(F.col("id").alias(id_col))
