"""Connected components, and the classes of nodes that share bands, as joins and aggregations without any group held whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.common import filter_words, may_be_held, written


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) lead to; a node without links is its own component.

    Each round lets every linked node point to its smallest neighbour (or itself), follows pointers twice, and
    contracts the links; what is left shrinks at least by half, a star in one round.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        once = point.join(point.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        point = written(once, "pointers")
        step = point.join(point.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        point = written(step.where("a <> to"), "pointers")
        moved = point.select(F.col("a").alias("component"), F.col("to").alias("next"))
        if labels is None:
            labels = point.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            kept = labels.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            labels = kept.union(point.join(labels.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("to").alias("component")))
        labels = written(labels, "labels")
        left = edges.join(point.select("a", F.col("to").alias("ta")), "a", "left").select(F.coalesce("ta", "a").alias("a"), "b")
        left = left.join(point.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left").select("a", F.coalesce("tb", "b").alias("b"))
        edges = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def key_sizes(keyed: DataFrame) -> DataFrame:
    """(key, members), written: the keys that several rows (node, key) have. Most keys have one row; only counts of these are shuffled."""
    return written(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key-sizes")


def of_keys(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of keyed with the keys of sizes, and members. A filter of bounded size keeps others out of the shuffle; the join is exact."""
    likely = may_be_held(keyed.withColumn("h", F.xxhash64("key")), "h", filter_words(sizes.select(F.xxhash64("key").alias("h")), "h")).drop("h")
    return likely.join(sizes, "key")


def popular_hubs(keyed: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (node, key) of the keys of sizes, each once; (key, hub, members): of each such key, the node whose keys have the most members.

    The text that others were copied from shares more keys with its copies than they do with each other.
    """
    members = written(of_keys(keyed, sizes).distinct(), "key-members")
    fame = members.groupBy("node").agg(F.sum("members").alias("fame"))
    return members, members.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("minus"))).alias("best"), F.max("members").alias("members")).select("key", (-F.col("best.minus")).alias("hub"), "members")


#: Nodes of a bucket that one task holds, and that it compares them with; nodes that a task compares with a hub.
HELD_BLOCK, READ_BLOCK, HUB_BLOCK = 128, 512, 64
#: What tasks get: rows by task and side (0 is held, side 1 compared with it), with the node's class and bands (if these are sent) and what is compared.
ROW = ("task", "band", "side", "node", "class", "bands", "z")


def first_shared(their: np.ndarray, bands: list[int], band: int) -> np.ndarray:
    """Which held nodes (a row of bands each) are compared with a node in this band's bucket: those that share no earlier one. Without a band, all."""
    if band < 0:
        return np.ones(len(their), bool)
    shared = their == np.array(bands, np.int64)
    return shared.any(axis=1) & (shared.argmax(axis=1) == band)


def _verified(sides: list[DataFrame], payload: DataFrame, compared: Callable) -> DataFrame:
    """Links (a, b) of the tasks whose rows sides have, without what is compared yet."""
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    rows = rows.join(payload, "node").select(*ROW)
    return rows.repartition("task").sortWithinPartitions("task", "side", "node").mapInArrow(compared, "a long, b long")


def _blocks(count: str, size: int) -> Column:
    return F.ceil(F.col(count) / size).cast("int")


def bucket_classes(banded: DataFrame, every_node: DataFrame, payload_of: Callable[[DataFrame], DataFrame], compared: Callable, known_links: DataFrame | None = None, in_place: Callable | None = None) -> DataFrame:
    """(node, component) of every node: components of the links that compared finds among nodes (node, bands: an array of integers) that share a band's key.

    In each bucket the node whose buckets have most members, the hub, is compared with all others. Buckets whose nodes
    are then not in one class are compared in blocks: every pair of nodes of different classes, so that no link is
    lost; a pair that shares several buckets is compared in one. Buckets are dealt to tasks in blocks, so no task holds
    a whole bucket. In a bucket of m nodes of which r are not in its largest class the work is r times m.

    payload_of gives (node, z binary) of nodes (node); compared maps Arrow batches of ROW to links (a, b).

    in_place is for a z that is short and tells the bands: banded has it too, no bands are sent, and all pairs of a
    bucket of HELD_BLOCK nodes at most are compared where it is gathered. It maps Arrow batches (band, rows), a bucket's
    rows being a list of (node, z), to links (a, b) of the pairs that share no earlier band. The rows of such buckets,
    many of which meet by chance and grow with the square of the nodes, are shuffled by the join and, as lists, to be
    gathered, and by nothing after that.
    """
    held_z = ["z"] if in_place else []
    keyed = banded.select("node", *held_z, F.posexplode("bands").alias("band", "k")).select("node", *held_z, F.struct("band", "k").alias("key"))
    sizes = key_sizes(keyed)
    if in_place:
        gathered = of_keys(keyed, sizes.where(F.col("members") <= HELD_BLOCK)).groupBy("key").agg(F.collect_list(F.struct("node", "z")).alias("rows"))
        near = written(gathered.select("key.band", "rows").mapInArrow(in_place, "a long, b long"), "bucket-links")
        known_links = near if known_links is None else near.union(known_links)
        sizes = sizes.where(F.col("members") > HELD_BLOCK)
        if sizes.isEmpty():
            return written(components(every_node, known_links), "classes")
    members, hubs = popular_hubs(keyed.select("node", "key"), sizes)
    hubs = written(hubs, "hubs")
    wide = members.select("node", "key").join(hubs, "key")
    pairs = written(wide.where("node <> hub").groupBy("hub", "node").agg(F.max("members").alias("members")), "pairs")
    nodes = written(pairs.select("node").union(pairs.select("hub")).distinct(), "compared-nodes")
    payload = written(payload_of(nodes), "compared")
    # a hub of large buckets has many tasks; which of them a node is in depends on its own row alone
    many = F.expr(f"int(pow(2, ceil(log2(ceil(members / {HUB_BLOCK})))))")
    tasks = pairs.withColumn("j", many).select("hub", "node", F.struct("hub", F.pmod(F.xxhash64("node"), F.col("j")).alias("i"), "j", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("k")).alias("task"))
    plain = [F.lit(-1).alias("band"), F.array(F.lit(0).cast("long")).alias("bands")]
    side = lambda n, node: tasks.select("task", F.lit(n).alias("side"), F.col(node).alias("node")).distinct().withColumn("class", F.col("node")).select("task", "side", "node", "class", *plain)
    first = _verified([side(0, "hub"), side(1, "node")], payload, compared)
    found = written(first if known_links is None else first.union(known_links), "hub-links")
    classes = written(components(every_node, found), "classes")

    # buckets in which, without their hub, there is more than one class
    rest = wide.where("node <> hub").select("key", "node").join(classes, "node").withColumnRenamed("component", "class")
    sizes = rest.groupBy("key", "class").agg(F.count("*").alias("n"))
    mixed = written(sizes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("classes")).where("classes > 1").select("key", F.col("main.class").alias("main"), "members", (F.col("members") - F.col("main.n")).alias("others")), "mixed-buckets")
    if mixed.isEmpty():
        return classes
    open_rows = rest.join(mixed, "key")
    open_rows = open_rows.withColumn("bands", plain[1]) if in_place else open_rows.join(banded.groupBy("node").agg(F.max("bands").alias("bands")), "node")
    open_rows = written(open_rows, "mixed-members")
    i, j = F.pmod(F.xxhash64("node"), _blocks("others", HELD_BLOCK)), F.pmod(F.xxhash64("node", F.lit(1)), _blocks("members", READ_BLOCK))
    every = lambda count, size: F.explode(F.sequence(F.lit(0), _blocks(count, size) - 1))
    named = F.struct(F.lit(0).cast("long").alias("hub"), F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.col("key.band").alias("band"), F.col("key.k").alias("k")).alias("task")
    held = open_rows.where("class <> main").withColumn("i", i).withColumn("j", every("members", READ_BLOCK)).select(named, F.col("key.band").alias("band"), F.lit(0).alias("side"), "node", "class", "bands")
    read = open_rows.withColumn("j", j).withColumn("i", every("others", HELD_BLOCK)).select(named, F.col("key.band").alias("band"), F.lit(1).alias("side"), "node", "class", "bands")
    found = found.union(written(_verified([held, read], payload, compared), "block-links"))
    return written(components(every_node, found), "classes")
