"""Adding a batch of observations to what is stored, without going through the old ones again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occugrid.operators.occupancy import occupancy
from occugrid.storage import written_table

KEY = ["lat", "lon", "taxon_id"]
#: Words of 64 bits in the filter of a batch, at most (8 MB as it is broadcast).
MAX_WORDS = 1 << 20
KEYS_PER_WORD = 4


def merged_masks(stored: DataFrame, batch_features: DataFrame) -> DataFrame:
    """``occupancy`` of the stored observations and the batch: masks are joined bit by bit.

    Only the stored masks are read, a row per species and tile, and the batch. A repeated
    observation sets a bit that is set already, so the batch need not be deduplicated.
    """
    both = stored.unionByName(occupancy(batch_features))
    return both.groupBy("taxon_id", "tile_lat", "tile_lon").agg(F.bit_or("mask").alias("mask"))


def _word(n_words: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n_words))


def _flags() -> Column:
    """Four bits of a word, from another hash of the key."""
    mixed = F.xxhash64(F.lit("bits"), *KEY)
    bits = [F.shiftright(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    flags = F.lit(0).cast("long")
    for bit in bits:
        flags = flags.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return flags


def may_be_in(observations: DataFrame, batch: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Keys of ``observations`` that a blocked Bloom filter of the batch's keys lets through.

    None of the batch is missing; of the others few pass. The filter is a table of words, one bit
    word per key, whose number follows the batch up to ``max_words``, and is broadcast; a larger
    batch only lets more pass.
    """
    n_words = max(1, min(max_words, -(-batch.count() // KEYS_PER_WORD)))
    words = batch.groupBy(_word(n_words).alias("word")).agg(F.bit_or(_flags()).alias("bits"))
    keys = observations.select(*KEY, _word(n_words).alias("word"), _flags().alias("flags"))
    met = keys.join(F.broadcast(words), "word")
    return met.where(F.col("bits").bitwiseAND(F.col("flags")) == F.col("flags")).select(*KEY)


def new_features(stored: DataFrame, batch: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows of the batch whose (lat, lon, taxon_id) is not stored; of equal ones the first row.

    The stored table is read once and by three columns; what passes the filter of the batch is
    all that is shuffled of it, so the join grows with the batch and not with the table.
    """
    firsts = batch.groupBy(*KEY).agg(F.min_by(F.struct(*batch.columns), "row_id").alias("row"))
    first = written_table(firsts.select("row.*"), "batch")
    seen = may_be_in(stored, first, max_words).distinct()
    return first.join(seen, KEY, "left_anti").select(*batch.columns)
