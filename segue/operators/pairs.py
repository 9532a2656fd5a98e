"""Skip-gram pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def skipgram_pairs(lists: DataFrame, window: int = 5, ids: str = "ids", playlist: str = "pid") -> DataFrame:
    """(playlist, center_pos, context_pos, center, context) within window places of each other, in one pass without a shuffle."""
    near = F.expr(f"explode(transform(sequence(greatest(0, pos - {window}), least(size({ids}) - 1, pos + {window})), j -> named_struct('p', j, 'context', {ids}[j])))")
    rows = lists.select(playlist, ids, F.posexplode(ids).alias("pos", "center")).select(playlist, F.col("pos").alias("center_pos"), "center", near.alias("e"))
    return rows.where("e.p <> center_pos").select(playlist, "center_pos", F.col("e.p").alias("context_pos"), "center", F.col("e.context").alias("context"))


def _pairs_up_to(n: str, d: str) -> str:
    """SQL: the pairs of a list of n items that are d places apart at most."""
    return f"({d} * (2 * {n} - 1 - {d}))"


def sampled_pairs(lists: DataFrame, window: int = 5, most: int = 2000, seed: int = 42, ids: str = "ids", playlist: str = "pid") -> DataFrame:
    """skipgram_pairs, of which a playlist gives `most` at most: a sample without replacement that reruns repeat. 0: all.

    Pairs are numbered by their distance; numbers are drawn, those with the smallest hashes, and only drawn ones
    become pairs, each in its own row: no pair is made to be dropped, nothing is shuffled.
    """
    if most <= 0:
        return skipgram_pairs(lists, window, ids, playlist)
    sized = lists.withColumn("__n", F.size(ids).cast("long")).withColumn("__d", F.least(F.lit(window).cast("long"), F.col("__n") - 1)).where("__n > 1")
    total = _pairs_up_to("__n", "__d")
    hashed = f"transform(sequence(0L, {total} - 1), o -> struct(xxhash64({seed}, `{playlist}`, o) AS h, o AS o))"
    drawn = F.expr(f"if({total} <= {most}, sequence(0L, {total} - 1), transform(slice(array_sort({hashed}), 1, {most}), x -> x.o))")
    rows = sized.select(playlist, ids, "__n", "__d", F.explode(drawn).alias("__o"))
    # the first distance whose pairs, with all nearer ones, go beyond the number
    rows = rows.withColumn("__at", F.expr(f"filter(sequence(1L, __d), d -> {_pairs_up_to('__n', 'd')} > __o)[0]"))
    rows = rows.withColumn("__r", F.expr(f"__o - {_pairs_up_to('__n', '(__at - 1)')}")).withColumn("__i", F.expr("int(__r div 2)")).withColumn("__j", F.expr("int(__i + __at)"))
    first, second = F.when(F.col("__r") % 2 == 0, F.col("__i")).otherwise(F.col("__j")), F.when(F.col("__r") % 2 == 0, F.col("__j")).otherwise(F.col("__i"))
    placed = rows.select(playlist, ids, first.alias("center_pos"), second.alias("context_pos"))
    item = lambda c: F.col(ids)[F.col(c)]
    return placed.select(playlist, "center_pos", "context_pos", item("center_pos").alias("center"), item("context_pos").alias("context"))


def uniform(seed: int, *columns: str) -> str:
    """SQL: a number in [0, 1) by a hash."""
    return f"(pmod(xxhash64({seed}L, {', '.join(columns)}), 9007199254740992L) / 9007199254740992D)"


def drawn_windows(lists: DataFrame, window: int = 5, seed: int = 42, epoch: int = 0, playlist: str = "pid") -> DataFrame:
    """(playlist, ids, reach) of an epoch from lists (playlist, ids, keep): occurrences are kept with their own probability,
    those kept close up, and each draws how far its window reaches, from 1 to `window` places."""
    kept = lists.select(playlist, F.expr(f"filter(transform(ids, (x, i) -> struct(x AS x, {uniform(seed, str(epoch), f'`{playlist}`', 'i')} < keep[i] AS k)), e -> e.k)").alias("e")).where("size(e) > 1")
    reach = F.expr(f"transform(e, (x, pos) -> 1 + int({window} * {uniform(seed + 1, str(epoch), f'`{playlist}`', 'pos')}))")
    return kept.select(playlist, F.expr("transform(e, x -> x.x)").alias("ids"), reach.alias("reach"))


def shrinking_pairs(lists: DataFrame, window: int = 5, seed: int = 42, epoch: int = 0, playlist: str = "pid") -> DataFrame:
    """Pairs of an epoch from lists (playlist, ids, keep), by drawn_windows."""
    rows = drawn_windows(lists, window, seed, epoch, playlist).select(playlist, "ids", "reach", F.posexplode("ids").alias("pos", "center"))
    near = F.expr("explode(transform(sequence(greatest(0, pos - reach[pos]), least(size(ids) - 1, pos + reach[pos])), j -> named_struct('p', j, 'context', ids[j])))")
    met = rows.select(playlist, F.col("pos").alias("center_pos"), "center", near.alias("e")).where("e.p <> center_pos")
    return met.select(playlist, "center_pos", F.col("e.p").alias("context_pos"), "center", F.col("e.context").alias("context"))


def pair_statistics(pairs: DataFrame, playlist: str = "pid") -> DataFrame:
    """One row: how many pairs are trained, of how many playlists."""
    return pairs.groupBy(playlist).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("playlists"))


def context_windows(occurrences: DataFrame, window: int = 5, playlist: str = "pid", item: str = "track_uri", pos: str = "pos") -> DataFrame:
    """Each occurrence with the items around it, by a sliding frame without the row itself."""
    ordered = Window.partitionBy(playlist).orderBy(pos)
    before, after = F.collect_list(item).over(ordered.rowsBetween(-window, -1)), F.collect_list(item).over(ordered.rowsBetween(1, window))
    return occurrences.select(playlist, pos, item, F.concat(before, after).alias("context"))
