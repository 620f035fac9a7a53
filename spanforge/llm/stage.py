"""Small helpers every operator uses; tables cut from their lineage live in ``sources.shared``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.sources.shared import mark, materialize, release, shared_dir

__all__ = ["BROADCAST_ROWS", "HEAVY_ROWS", "WORD_PATTERN", "crc_fold", "hash32", "keep_keys", "mark", "materialize", "release", "shared_dir", "sized_broadcast"]

#: A table is broadcast by hint only if it was counted and has at most this many rows.
BROADCAST_ROWS = 400_000

#: A key of at least this many rows is kept out of shuffles on the key.
HEAVY_ROWS = 4096

#: Word separators of every contract here: space and the ASCII control blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only behind a counted size; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def keep_keys(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` whose key is in ``keys`` (the ``on`` columns and n, the number of rows that have it).

    Heavy keys are few, as each stands for ``HEAVY_ROWS`` rows: counted, they are broadcast,
    and only the other rows are shuffled, so no task gets all rows of a heavy key.
    """
    heavy = materialize(keys.filter(F.col("n") >= HEAVY_ROWS).select(*on), name)
    n_heavy = heavy.count()
    light = keys.filter(F.col("n") < HEAVY_ROWS).select(*on)
    if not n_heavy:
        return rows.join(light, on, "left_semi")
    heavy = sized_broadcast(heavy, n_heavy)
    return rows.join(heavy, on, "left_semi").unionByName(rows.join(heavy, on, "left_anti").join(light, on, "left_semi"))


def hash32(text: Column) -> Column:
    """Unsigned 32-bit hash that SQL engines with md5 can repeat: first 8 hex digits."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
