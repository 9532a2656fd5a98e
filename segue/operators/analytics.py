"""Further analyses of playlists and embeddings: neighbours, cohesion, transitions, co-occurrence, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.functions.vectors import dot


def similar(tracks: DataFrame, idx: int, n: int = 10) -> DataFrame:
    """(idx, similarity): the n tracks nearest to one."""
    one = tracks.where(F.col("idx") == idx).select(F.col("embedding").alias("__v"))
    rows = tracks.where(F.col("idx") != idx).crossJoin(F.broadcast(one)).select("idx", dot(F.col("embedding"), F.col("__v")).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "idx").limit(n)


def _sums(members: DataFrame) -> DataFrame:
    """(pid, n, s, q): how many vectors each playlist has, their sum, and the sum of their squared lengths, added up before the shuffle."""
    first = members.select(F.size("embedding").alias("d")).first()
    d = first["d"] if first else 0
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    sums = members.groupBy("pid").agg(F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(d)], F.sum(dot(F.col("embedding"), F.col("embedding"))).alias("q"))
    return sums.select("pid", "n", F.array(*[F.col(f"s{i}") for i in range(d)]).cast("array<double>").alias("s"), "q")


def cohesion(members: DataFrame) -> DataFrame:
    """(pid, cohesion, diversity): the mean product of a playlist's pairs of vectors (pid, pos, embedding).

    The sum over pairs is half of the squared length of the sum less the sum of squared lengths, so no pairs are made.
    """
    found = _sums(members).where("n > 1")
    mean = (dot(F.col("s"), F.col("s")) - F.col("q")) / 2 / (F.col("n") * (F.col("n") - 1) / 2)
    return found.select("pid", mean.alias("cohesion"), (1 - mean).alias("diversity"))


def centrality(members: DataFrame) -> DataFrame:
    """(pid, pos, centrality, outlier): a track's mean product with the others of its playlist."""
    own = F.col("embedding")
    both = members.join(_sums(members).where("n > 1").select("pid", "n", "s"), "pid")
    mean = (dot(own, F.col("s")) - dot(own, own)) / (F.col("n") - 1)
    return both.select("pid", "pos", mean.alias("centrality")).select("pid", "pos", "centrality", (1 - F.col("centrality")).alias("outlier"))


def top_tags(tags: DataFrame, n: int = 10) -> DataFrame:
    """(tag, weight): the heaviest of (tag, weight)."""
    return tags.groupBy("tag").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "tag").limit(n)


def transitions(log: DataFrame, state: str, user: str, order: list[str]) -> DataFrame:
    """(prev, next, n, probability) of a user's consecutive states."""
    moved = log.select(F.col(state).alias("prev"), F.lead(state).over(Window.partitionBy(user).orderBy(*order)).alias("next")).where("next is not null")
    counted = moved.groupBy("prev", "next").agg(F.count("*").alias("n"))
    total = counted.groupBy("prev").agg(F.sum("n").alias("total"))
    return counted.join(total, "prev").select("prev", "next", "n", (F.col("n") / F.col("total")).alias("probability"))


def transitions_2(log: DataFrame, state: str, user: str, order: list[str]) -> DataFrame:
    """(prev2, prev, next, n, probability) of three consecutive states."""
    w = Window.partitionBy(user).orderBy(*order)
    moved = log.select(F.lag(state).over(w).alias("prev2"), F.col(state).alias("prev"), F.lead(state).over(w).alias("next")).where("next is not null and prev2 is not null")
    counted = moved.groupBy("prev2", "prev", "next").agg(F.count("*").alias("n"))
    total = counted.groupBy("prev2", "prev").agg(F.sum("n").alias("total"))
    return counted.join(total, ["prev2", "prev"]).select("prev2", "prev", "next", "n", (F.col("n") / F.col("total")).alias("probability"))


def transition_entropy(moves: DataFrame) -> DataFrame:
    """(prev, entropy): how spread the next states are, in bits."""
    return moves.groupBy("prev").agg((-F.sum(F.col("probability") * F.log2("probability"))).alias("entropy"))


def cooccurrence(pairs: DataFrame, block: int = 256) -> DataFrame:
    """(a, b, n): playlists that hold both items; pairs are (pid, item) rows, a < b.

    The items of a playlist are cut into blocks by a hash, and blocks of a playlist meet by twos, so that a very long
    playlist is many tasks.
    """
    items = pairs.select("pid", "item").distinct()
    sizes = items.groupBy("pid").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = items.join(sizes, "pid").withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("pid", F.col("own").alias("i"), every.alias("j"), F.col("item").alias("a"))
    right = rows.select("pid", every.alias("i"), F.col("own").alias("j"), F.col("item").alias("b"))
    return left.join(right, ["pid", "i", "j"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(a, b, n, pmi, ppmi) over playlists."""
    items = pairs.select("pid", "item").distinct()
    single = items.groupBy("item").agg(F.count("*").alias("n_item"))
    total = items.agg(F.countDistinct("pid").alias("total"))
    found = cooccurrence(items).join(single.select(F.col("item").alias("a"), F.col("n_item").alias("na")), "a").join(single.select(F.col("item").alias("b"), F.col("n_item").alias("nb")), "b").crossJoin(F.broadcast(total))
    pmi = F.log2(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))
    return found.select("a", "b", "n", pmi.alias("pmi"), F.greatest(pmi, F.lit(0.0)).alias("ppmi"))


def item_knn(pairs: DataFrame, n: int = 10) -> DataFrame:
    """(item, rank, neighbor, similarity): cosine of the playlists of two items."""
    items = pairs.select("pid", "item").distinct()
    single = items.groupBy("item").agg(F.count("*").alias("n_item"))
    found = cooccurrence(items)
    both = found.select(F.col("a").alias("item"), F.col("b").alias("neighbor"), "n").union(found.select("b", "a", "n"))
    sims = both.join(single, "item").join(single.select(F.col("item").alias("neighbor"), F.col("n_item").alias("m")), "neighbor").select("item", "neighbor", (F.col("n") / F.sqrt(F.col("n_item") * F.col("m"))).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("similarity"), "neighbor"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= n).select("item", "rank", "neighbor", "similarity")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, precision, ndcg, ap, rr, hit) at k, from ranked (query, item, rank) and relevant (query, item)."""
    wanted = relevant.select("query", "item").distinct()
    totals = wanted.groupBy("query").agg(F.count("*").alias("total"))
    hits = ranked.where(F.col("rank") <= k).join(wanted, ["query", "item"], "left_semi").withColumn("hits", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    found = hits.groupBy("query").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("hits") / F.col("rank")).alias("precisions"), F.min("rank").alias("first"))
    ideal = F.expr(f"aggregate(sequence(1, least({k}, total)), 0D, (s, i) -> s + 1 / log2(i + 1))")
    rows = totals.join(found, "query", "left").fillna({"found": 0, "dcg": 0.0, "precisions": 0.0})
    return rows.select(
        "query", (F.col("found") / F.col("total")).alias("recall"), (F.col("found") / k).alias("precision"), (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("precisions") / F.least(F.lit(k), F.col("total"))).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("found") > 0).cast("int").alias("hit"),
    )


def metric_means(metrics: DataFrame) -> DataFrame:
    """One row: queries, and the means of ranking_metrics over them (map and mrr are those of ap and rr)."""
    names = {"recall": "recall", "precision": "precision", "ndcg": "ndcg", "ap": "map", "rr": "mrr", "hit": "hit_rate"}
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(old).alias(new) for old, new in names.items()])


def catalogue_coverage(ranked: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of all items (item) that some ranking (query, item, rank) holds among its first k."""
    shown = ranked.where(F.col("rank") <= k).agg(F.countDistinct("item").alias("shown"))
    return items.agg(F.countDistinct("item").alias("items")).crossJoin(F.broadcast(shown)).select("items", "shown", F.try_divide("shown", "items").alias("coverage"))


def novelty(ranked: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """(query, novelty): the mean of -log2 of the share of occurrences (item, count) that its first k items have."""
    total = counts.agg(F.sum("count").alias("total"))
    own = counts.crossJoin(F.broadcast(total)).select("item", (-F.log2(F.col("count") / F.col("total"))).alias("bits"))
    return ranked.where(F.col("rank") <= k).join(own, "item").groupBy("query").agg(F.avg("bits").alias("novelty"))


# The weights of the first scores that were planned for recommendations.
FIRST_SCORE = {"recent": 0.35, "whole": 0.25, "tag_match": 0.20, "novelty": 0.10, "trajectory": 0.10}
PLAIN_SCORE = {"neighbor": 0.50, "tag_match": 0.30, "genre_match": 0.20}


def weighted(rows: DataFrame, parts: dict[str, float], name: str = "score") -> DataFrame:
    """rows with the weighted sum of some of their columns; a missing part counts as 0."""
    return rows.withColumn(name, sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0)))


def fuzzy_titles(tracks: DataFrame, query: str, least: float = 0.3, key: str = "title_key") -> DataFrame:
    """(idx, similarity): tracks whose title shares trigrams with the query (Jaccard)."""
    grams = lambda c: F.array_distinct(F.expr(f"transform(sequence(1, greatest(1, length({c}) - 2)), i -> substr({c}, i, 3))"))
    rows = tracks.withColumn("__q", F.lit(query))
    a, b = grams(f"`{key}`"), grams("__q")
    sim = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return rows.select("idx", sim.alias("similarity")).where(F.col("similarity") >= least)


def clusters(tracks: DataFrame, k: int = 10, seed: int = 42):
    """(idx, cluster) by k-means over the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = tracks.select("idx", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features").fit(rows).transform(rows).select("idx", F.col("prediction").alias("cluster"))


#: Ratings of a block of users or items, which one task holds with the factors that they meet; blocks at least.
BLOCK_RATINGS, BLOCKS_LEAST = 1_000_000, 10


def als(ratings: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 42):
    """A fitted implicit-feedback factorisation of (pid, item, rating), a table that is read more than once.

    Blocks follow the ratings, as a task holds its block whole. Factors are checkpointed in every iteration, where a folder
    for that is set, so that the shuffles before it can go.
    """
    from pyspark.ml.recommendation import ALS

    blocks = max(BLOCKS_LEAST, -(-ratings.count() // BLOCK_RATINGS))
    trainer = ALS(rank=rank, maxIter=iterations, seed=seed, implicitPrefs=True, userCol="pid", itemCol="item", ratingCol="rating", numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1)
    return trainer.fit(ratings)


def cross_match(left: DataFrame, right: DataFrame, tolerance_ms: int = 3000) -> DataFrame:
    """(left_id, right_id): tracks of two catalogues (id, title_key, artist_key, duration_ms) with equal keys and close durations."""
    r = right.select(F.col("id").alias("right_id"), "title_key", "artist_key", F.col("duration_ms").alias("d"))
    both = left.select(F.col("id").alias("left_id"), "title_key", "artist_key", "duration_ms").join(r, ["title_key", "artist_key"])
    return both.where(F.abs(F.col("duration_ms") - F.col("d")) <= tolerance_ms).select("left_id", "right_id")
