"""Upload pieces as ranges (T1–T4): gaps and islands without per-session arrays.

Pieces are cut into stretches of ``STRETCH`` indexes. Inside a stretch (a session's and no more than
``STRETCH`` rows) neighbours are compared by ``lead`` and ``row_number``; between stretches only each one's first and last
piece matter: one row a stretch, compared in order of the stretches. So no task holds more than a
stretch of a session, however many pieces it has, and results are ranges, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def _dealt(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    return df if partitions is None else df.repartition(partitions, *keys)


def _stretches(pieces: DataFrame, partitions: int | None) -> DataFrame:
    """Distinct (session_id, piece, stretch), all of a stretch in one of ``partitions`` tasks, which later steps over stretches keep."""
    piece = F.col("chunk_index").cast("long").alias("piece")
    held = pieces.select("session_id", piece).where("piece IS NOT NULL").withColumn("stretch", F.floor(F.col("piece") / STRETCH))
    return _dealt(held, partitions, "session_id", "stretch").distinct()


def missing_ranges(sessions: DataFrame, pieces: DataFrame, partitions: int | None = None) -> DataFrame:
    """(session_id, first_missing, last_missing): the gaps in ``[0, chunk_count)`` of each session of
    (session_id, chunk_count). Pieces outside are ignored. ``partitions``: see ``merged_ranges``."""
    held = _stretches(pieces.join(sessions.select("session_id", "chunk_count"), "session_id")
                      .where((F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("chunk_count"))), partitions)
    after = F.lead("piece").over(Window.partitionBy("session_id", "stretch").orderBy("piece"))
    inside = (held.select("session_id", (F.col("piece") + 1).alias("first_missing"), (after - 1).alias("last_missing"))
              .where(F.col("last_missing") >= F.col("first_missing")))
    ends = held.groupBy("session_id", "stretch").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    ordered = Window.partitionBy("session_id").orderBy("stretch")
    between = ends.select("session_id", F.col("low"), F.coalesce(F.lag("high").over(ordered), F.lit(-1)).alias("before"))
    between = between.select("session_id", (F.col("before") + 1).alias("first_missing"), (F.col("low") - 1).alias("last_missing"))
    last = ends.groupBy("session_id").agg(F.max("high").alias("high"))
    tail = sessions.join(last, "session_id", "left").select(
        "session_id", (F.coalesce("high", F.lit(-1)) + 1).alias("first_missing"), (F.col("chunk_count") - 1).alias("last_missing"))
    return inside.unionByName(between).unionByName(tail).where(F.col("last_missing") >= F.col("first_missing"))


def merged_ranges(*lists: DataFrame, partitions: int | None = None) -> DataFrame:
    """(session_id, first_piece, last_piece): the union of piece lists (session_id, chunk_index) as maximal ranges.

    ``partitions``: tasks that share the pieces, as many as the input needs; without it Spark merges its shuffle partitions down to
    about the number of cores, and a task's memory grows with the input."""
    union = lists[0].select("session_id", "chunk_index")
    for other in lists[1:]:
        union = union.unionByName(other.select("session_id", "chunk_index"))
    held = _stretches(union, partitions)
    place = F.row_number().over(Window.partitionBy("session_id", "stretch").orderBy("piece"))
    islands = (held.withColumn("island", F.col("piece") - place).groupBy("session_id", "stretch", "island")
               .agg(F.min("piece").alias("first_piece"), F.max("piece").alias("last_piece")))
    at_edge = (F.pmod("first_piece", F.lit(STRETCH)) == 0) | (F.pmod("last_piece", F.lit(STRETCH)) == STRETCH - 1)
    ordered = Window.partitionBy("session_id").orderBy("first_piece")
    parts = (_dealt(islands.where(at_edge), partitions, "session_id").withColumn("new", (F.coalesce(F.lag("last_piece").over(ordered), F.lit(-2)) < F.col("first_piece") - 1).cast("long"))
             .withColumn("range", F.sum("new").over(ordered)))
    stitched = parts.groupBy("session_id", "range").agg(F.min("first_piece").alias("first_piece"), F.max("last_piece").alias("last_piece")).drop("range")
    return islands.where(~at_edge).select("session_id", "first_piece", "last_piece").unionByName(stitched)


def listed(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """(session_id, chunk_index): every piece of the ranges, one row each."""
    return ranges.select("session_id", F.explode(F.sequence(first, last)).alias("chunk_index"))
