"""The registered queries over the test tables; their SQL is in oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions import text as fx
from segue.functions.vectors import dot
from segue.operators import analytics, catalog, corpus, coverage, fuzzy, match, neighbors, pairs, playlist, recommend, search, search_index, train
from segue.plans import bindings as b
from segue.plans.oracles import ORACLES
from segue.sources.stored import written

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}
MIN_COUNT = 20


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- text --------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select("doc_id", "text")


@query
def normalize_text(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(fx.normalize_text("text")).alias("normalized"))


@query
def split_artists(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", F.array_join(fx.split_artists(F.concat_ws("", "p_brand", F.lit(" feat. "), "p_type", F.lit(" & "), "p_name")), ",").alias("artists"))


@query
def canonical_title(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", fx.canonical_title(F.concat("p_name", F.lit(" (Live "), "p_brand", F.lit(" Remastered Version)"))).alias("title"))


@query
def script_filter(spark, sf):
    docs = _documents(spark, sf).withColumn("text", F.translate("text", "éñü", "ёяю"))
    return docs.where(fx.has_cyrillic("text")).select("doc_id", F.length("text").alias("n"))


@query
def track_links(spark, sf):
    rows = b.table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "spotify:track:").otherwise("local:"), "p_partkey").alias("uri"))
    return rows.select("p_partkey", fx.track_link("uri").alias("link"), fx.duration_text(F.col("p_partkey") * 37).alias("duration"), fx.percent(F.col("p_partkey") / 3000).alias("percent"), fx.component(F.col("p_partkey") / 3000).alias("component"))


@query
def markdown_cells(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(fx.markdown_cell("text")).alias("cell"))


# -- corpus ------------------------------------------------------------------------------------------------------


@query
def sentence_build(spark, sf):
    found = corpus.sentences(b.playlists(spark, sf))
    return found.select("pid", F.array_join("uris", " ").alias("uris"))


@query
def corpus_statistics(spark, sf):
    return corpus.corpus_statistics(b.playlists(spark, sf))


@query
def occurrence_count(spark, sf):
    return corpus.occurrence_counts(b.occurrences(spark, sf))


@query
def first_seen_metadata(spark, sf):
    found = corpus.first_seen(b.named_occurrences(spark, sf), order=b.ORDER)
    return found.select("track_uri", "track_name", "artist_name", "album_name", F.col("first.pid").alias("first_pid"), F.col("first.pos").alias("first_pos"))


@query
def vocab_index(spark, sf):
    return corpus.vocabulary(b.named_occurrences(spark, sf), 2, order=b.ORDER).select("track_uri", "track_name", "count", "idx")


@query
def min_count_filter(spark, sf):
    return corpus.occurrence_counts(b.occurrences(spark, sf)).where(F.col("count") >= MIN_COUNT)


@query
def metadata_for_keys(spark, sf):
    rows = b.named_occurrences(spark, sf)
    keys = corpus.occurrence_counts(rows).where(F.col("count") >= MIN_COUNT)
    return corpus.metadata_of(rows.withColumn("file_ord", F.lit(0)).withColumn("playlist_ord", F.col("pid")), keys).select("track_uri", "track_name", "artist_name", "album_name")


@query
def popularity_prior(spark, sf):
    return b.tracks(spark, sf).select("idx", F.round("popularity", 6).alias("popularity"))


@query
def first_playlists(spark, sf):
    return corpus.sentences(corpus.capped(b.playlists(spark, sf), 50)).select("pid", F.size("uris").alias("n"))


@query
def oov_removal(spark, sf):
    rows = b.occurrences(spark, sf)
    vocab = corpus.occurrence_counts(rows).where(F.col("count") >= MIN_COUNT).select("track_uri", F.substring_index("track_uri", ":", -1).cast("long").alias("idx"))
    return corpus.in_vocabulary(rows, vocab).select("pid", F.array_join("ids", " ").alias("ids"))


# -- pairs and training ------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return b.occurrences(spark, sf).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda e: e["part"]).alias("ids")).where(F.size("ids") >= 2)


@query
def skipgram_pairs(spark, sf):
    return pairs.skipgram_pairs(_lists(spark, sf)).groupBy("center", "context").agg(F.count("*").alias("n"))


@query
def pair_statistics(spark, sf):
    return pairs.pair_statistics(pairs.skipgram_pairs(_lists(spark, sf)))


@query
def pair_cap(spark, sf):
    return pairs.sampled_pairs(_lists(spark, sf), most=20)


@query
def context_windows(spark, sf):
    return pairs.context_windows(b.occurrences(spark, sf), 2, item="part").select("pid", "pos", "part", F.array_join("context", " ").alias("context"))


@query
def negative_sampling_probs(spark, sf):
    return corpus.sampling_distribution(corpus.occurrence_counts(b.occurrences(spark, sf))).select("track_uri", F.round("probability", 10).alias("probability"))


@query
def train_word2vec(spark, sf):
    lists = corpus.sentences(b.playlists(spark, sf))
    found = train.word2vec_vectors(lists)
    return found.select("track_uri", F.size("embedding").alias("dim"), F.round(dot(F.col("embedding_norm"), F.col("embedding_norm")), 6).alias("length"))


@query
def train_sgns(spark, sf):
    """Negative sampling over all orders, and how long each vector is."""
    rows = b.named_occurrences(spark, sf)
    vocab = corpus.vocabulary(rows, 2, order=b.ORDER)
    vectors, _ = train.sgns(corpus.in_vocabulary(rows, vocab), vocab.select("idx", "count"))
    return vectors.select("idx", F.size("embedding").alias("dim"), F.round(dot(F.col("embedding"), F.col("embedding")), 9).alias("squared_length"))


@query
def subsampling_shares(spark, sf):
    """Of every track the share of its occurrences that skip-gram training keeps."""
    vocab = corpus.vocabulary(b.named_occurrences(spark, sf), 2, order=b.ORDER)
    return train.keep_probability(vocab.select("idx", "count"), 1e-4).select("idx", F.round("keep", 9).alias("keep"))


@query
def train_skipgram(spark, sf):
    """Subsampling, shrinking windows and negatives from all items, over all orders, and how long each vector is."""
    rows = b.named_occurrences(spark, sf)
    vocab = corpus.vocabulary(rows, 2, order=b.ORDER)
    vectors, _ = train.skipgram(train.kept_lists(rows, vocab, train.Config().sample), vocab.select("idx", "count"))
    return vectors.select("idx", F.size("embedding").alias("dim"), F.round(dot(F.col("embedding"), F.col("embedding")), 9).alias("squared_length"))


# -- catalogue and search ----------------------------------------------------------------------------------------


@query
def batch_lookup(spark, sf):
    found, _ = catalog.batch_lookup(b.tracks(spark, sf), b.seeds(spark))
    return found.select("ord", "track_uri", "track_name", "count")


@query
def missing_uris(spark, sf):
    return catalog.batch_lookup(b.tracks(spark, sf), b.seeds(spark))[1]


@query
def point_lookup(spark, sf):
    return catalog.lookup(b.tracks(spark, sf), "track:42").select("idx", "track_name", "artist_name")


@query
def token_index(spark, sf):
    return catalog.index_sizes(catalog.token_postings(b.tracks(spark, sf)), "token")


@query
def artist_index(spark, sf):
    return catalog.index_sizes(catalog.artist_postings(b.tracks(spark, sf)), "artist")


@query
def token_postings(spark, sf):
    return catalog.token_postings(b.tracks(spark, sf))


@query
def artist_postings(spark, sf):
    return catalog.artist_postings(b.tracks(spark, sf))


@query
def posting_lists(spark, sf):
    found = catalog.posting_lists(catalog.token_postings(b.tracks(spark, sf)), "token", 100)
    return found.select("token", "block", F.array_join("ids", " ").alias("ids"))


@query
def title_uris(spark, sf):
    return catalog.title_uris(b.tracks(spark, sf))


@query
def index_statistics(spark, sf):
    return catalog.index_statistics(b.tracks(spark, sf))


@query
def title_index(spark, sf):
    return catalog.title_index(b.tracks(spark, sf))


@query
def exact_index(spark, sf):
    return catalog.exact_index(b.tracks(spark, sf))


@query
def prefix_match(spark, sf):
    return catalog.prefix_postings(b.tracks(spark, sf), ["sm", "bo", "econ"])


@query
def search_rank(spark, sf):
    return search.scored(b.tracks(spark, sf), "small ring").select("idx", "score", "count")


@query
def search_page(spark, sf):
    return search.search(b.tracks(spark, sf), "Brand 2", 20, 10).select("idx", "score", "count")


@query
def search_has_more(spark, sf):
    """Whether there is a page behind one, for three pages of one search."""
    tracks = b.tracks(spark, sf)
    rows = [(offset, size, search.has_more(tracks, "Brand 2", size, offset)) for offset, size in ((0, 20), (40, 100), (5000, 100))]
    return spark.createDataFrame(rows, "offset long, size long, has_more boolean")


@query
def search_words(spark, sf):
    """The tracks of every part that the words of a query find, however far they are from the top."""
    return search_index.found_by_words(b.word_index(spark, sf), "sm econ").select("idx")


def _searched(query: str, limit: int, offset: int):
    def run(spark, sf):
        page = search_index.search(b.all_tracks(spark, sf), b.word_index(spark, sf), query, limit, offset)
        return search_index.with_tracks(page, b.all_tracks(spark, sf)).select("place", "idx", "track_name", "score", "count", F.lit(page.has_more).alias("has_more"))

    return run


QUERIES["search_indexed"] = _searched("Brand 2", 20, 10)
QUERIES["search_indexed_words"] = _searched("small econ", 30, 460)
QUERIES["search_fallback"] = _searched("mall rin", 20, 0)


# -- matching ----------------------------------------------------------------------------------------------------


@query
def match_detailed(spark, sf):
    return match.match_detailed(b.texts(spark), b.tracks(spark, sf))


@query
def match_uris(spark, sf):
    return match.matched_seeds(match.match_detailed(b.texts(spark), b.tracks(spark, sf)))


@query
def match_summary(spark, sf):
    return match.match_summary(match.match_detailed(b.texts(spark), b.tracks(spark, sf)))


def _list(spark, sf):
    """Parts that were added to a playlist: some by uri, most by names alone."""
    rows = b.table(spark, sf, "part").where("p_partkey < 60").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("track:"), "p_partkey")).alias("track_uri"), F.concat("p_brand", F.lit(" feat. "), F.when(F.col("p_partkey") % 3 == 0, "No One").otherwise(F.col("p_type"))).alias("artist"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.upper("p_name")).alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("album_name"))
    return playlist.normalized(rows)


def _after_matching(spark, sf):
    rows = _list(spark, sf)
    asked = playlist.unverified(rows).where("ord < 40").select("ord", F.col("artist_name").alias("artist"), F.col("track_name").alias("title"))
    return match.merge_matches(rows, match.match_detailed(asked, b.tracks(spark, sf)))


@query
def playlist_rows(spark, sf):
    return _list(spark, sf)


@query
def playlist_after_matching(spark, sf):
    return _after_matching(spark, sf)


@query
def playlist_seeds(spark, sf):
    return playlist.seeds(_after_matching(spark, sf))


@query
def playlist_status(spark, sf):
    return playlist.status_counts(_after_matching(spark, sf))


@query
def playlist_pending(spark, sf):
    return playlist.unverified(_after_matching(spark, sf)).select("ord", "track_name")


# -- recommendations ---------------------------------------------------------------------------------------------

OPTIONS = recommend.Options(min_count=1, pool=100, top_n=20, recent_k=2)


def _hybrid(preset: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = recommend.hybrid(b.tracks(spark, sf), b.seeds(spark), recommend.weights(preset), OPTIONS)
        parts = [F.round(c, 6).alias(c) for c in ("score", "recent", "whole", "support", "popularity", "affinity")]
        return found.select("rank", "idx", "track_name", *parts, "explanation")

    return run


for _preset in ("balance", "more_recent", "favorite", "more_popular"):
    QUERIES[f"hybrid_{_preset}"] = _hybrid(_preset)


WIDE = recommend.Options(min_count=30, pool=100, top_n=20, recent_k=2)


@query
def hybrid_all_parts(spark, sf):
    """Over every part, so that the rankings are cut before they are filtered, and min_count drops some."""
    found = recommend.hybrid(b.all_tracks(spark, sf), b.seeds(spark), recommend.weights("favorite"), WIDE)
    return found.select("rank", "idx", *[F.round(c, 6).alias(c) for c in ("score", "recent", "whole", "support", "popularity", "affinity")])


@query
def candidate_pool_all_parts(spark, sf):
    tracks = b.all_tracks(spark, sf)
    own = recommend.known_seeds(tracks, b.seeds(spark))
    return recommend.candidates(tracks, own, recommend.PRESETS["balance"], WIDE).select("idx")


@query
def simple_recommend(spark, sf):
    found = recommend.simple(b.tracks(spark, sf), b.seeds(spark))
    return found.select("rank", "idx", "track_name", F.round("score", 6).alias("score"))


@query
def hybrid_cli(spark, sf):
    options = recommend.Options(side="last", min_count=5, pool=100, recent_k=2, overfetch="plain", duplicates=False)
    found = recommend.hybrid(b.tracks(spark, sf), b.seeds(spark), recommend.Weights(), options)
    return found.select("rank", "idx", F.round("score", 6).alias("score"))


def _own(spark, sf):
    tracks = b.tracks(spark, sf)
    return tracks, recommend.known_seeds(tracks, b.seeds(spark))


@query
def candidate_pool(spark, sf):
    tracks, own = _own(spark, sf)
    return recommend.candidates(tracks, own, recommend.PRESETS["favorite"], OPTIONS).select("idx")


@query
def multi_seed_support(spark, sf):
    tracks, own = _own(spark, sf)
    return recommend.with_support(tracks, own).select("idx", F.round("support", 6).alias("support"))


@query
def artist_affinity(spark, sf):
    tracks, own = _own(spark, sf)
    return recommend.with_affinity(tracks, own).select("idx", F.round("affinity", 6).alias("affinity"))


@query
def favorite_pool(spark, sf):
    tracks, own = _own(spark, sf)
    rows = recommend.without_duplicates(recommend.without_seeds(recommend.with_affinity(tracks, own), own), own)
    return recommend.favorite_pool(rows, 30).select("idx", F.round("affinity", 6).alias("affinity"), "count")


@query
def seed_duplicate_anti(spark, sf):
    tracks, own = _own(spark, sf)
    return recommend.without_duplicates(tracks, own).select("idx")


@query
def explanations(spark, sf):
    tracks, own = _own(spark, sf)
    rows = recommend.with_support(recommend.with_similarities(recommend.with_affinity(tracks, own), own, OPTIONS), own)
    return rows.select("idx", fx.explanation(*[F.round(c, 6) for c in ("recent", "whole", "support", "popularity", "affinity")]).alias("explanation"))


# -- coverage ----------------------------------------------------------------------------------------------------


def _entries(spark, sf):
    """Every part as a wanted song: some of unknown titles or artists, with one of two artists, with none, with Cyrillic."""
    k = F.col("p_partkey")
    title = F.when(k % 7 == 0, F.concat("p_name", F.lit(" x"))).when(k % 11 == 0, F.concat_ws(" ", F.upper("p_name"), k)).otherwise(F.upper("p_name"))
    artist = F.when(k % 17 == 0, "").when(k % 13 == 0, "Ёлка").when(k % 3 == 0, "someone").when(k % 5 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" feat. "), "p_type"))
    rows = b.table(spark, sf, "part").select(k.alias("ord"), artist.alias("artist"), title.alias("title"))
    return coverage.entries(rows.withColumn("raw", F.when(F.col("artist") == "", F.col("title")).otherwise(F.concat_ws(" - ", "artist", "title"))))


def _found(spark, sf, examples=True):
    return coverage.candidates(b.covered_occurrences(spark, sf), _entries(spark, sf), b.ORDER, examples)


def _matches(spark, sf):
    return coverage.choose_matches(_entries(spark, sf), _found(spark, sf, examples=False))


@query
def coverage_candidates(spark, sf):
    return _found(spark, sf).select("title_key", "track_uri", "occurrences", "playlist_count", F.array_join("example_pids", " ").alias("example_pids"))


@query
def coverage_match(spark, sf):
    return _matches(spark, sf)


@query
def coverage_summary(spark, sf):
    return coverage.summary(_matches(spark, sf))


@query
def coverage_cyrillic(spark, sf):
    return coverage.summary(_matches(spark, sf).where("has_cyrillic"))


@query
def coverage_examples(spark, sf):
    return coverage.examples(_matches(spark, sf))


@query
def coverage_methods(spark, sf):
    return coverage.methods(_matches(spark, sf))


@query
def top_artists(spark, sf):
    return coverage.top_artists(_matches(spark, sf))


@query
def top_cyrillic_artists(spark, sf):
    return coverage.top_artists(_matches(spark, sf).where("has_cyrillic"), 30)


@query
def uncertain_export(spark, sf):
    return coverage.uncertain(_matches(spark, sf))


@query
def filtered_tracks(spark, sf):
    found = coverage.filtered_tracks(b.named_occurrences(spark, sf), "^(small|red) ", order=b.ORDER)
    return found.select("track_uri", "track_name", "artist_name", "occurrences", F.array_join("example_pids", " ").alias("example_pids"))


@query
def filtered_manifest(spark, sf):
    return coverage.manifest(coverage.filtered_tracks(b.named_occurrences(spark, sf), "^(small|red) ", order=b.ORDER))


# -- playlist editing --------------------------------------------------------------------------------------------


@query
def parse_import(spark, sf):
    name, brand = F.col("p_name"), F.col("p_brand")
    kinds = [F.concat(brand, F.lit(" – "), name), F.concat(F.lit('"'), brand, F.lit(', "";""x";'), name), F.concat(brand, F.lit(","), name, F.lit(",more")), name]
    line = F.element_at(F.array(*kinds), (F.col("p_partkey") % 4 + 1).cast("int"))
    return playlist.parse_import(b.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), line.alias("value")))


def _two_lists(spark, sf):
    rows = b.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("track:"), F.col("p_partkey") % 10)).otherwise("").alias("track_uri"), F.col("p_brand").alias("artist_name"), F.col("p_name").alias("track_name"))
    return rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1 or ord % 20 = 0")


@query
def playlist_dedupe(spark, sf):
    return playlist.merged(*_two_lists(spark, sf))


@query
def playlist_prepend(spark, sf):
    return playlist.merged(*_two_lists(spark, sf), prepend=True)


def _whole_list(spark, sf):
    return b.table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("ord"), F.col("p_name").alias("track_name"))


@query
def playlist_removed(spark, sf):
    return playlist.removed(_whole_list(spark, sf), 3)


@query
def playlist_swapped(spark, sf):
    return playlist.swapped(_whole_list(spark, sf), 5)


@query
def playlist_duplicates(spark, sf):
    return playlist.duplicates(*_two_lists(spark, sf))


# -- analyses ----------------------------------------------------------------------------------------------------


def _members(spark, sf):
    rows = b.occurrences(spark, sf)
    vectors = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("part"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.join(vectors, "part").select("pid", "pos", "embedding")


@query
def similar_items(spark, sf):
    return analytics.similar(b.tracks(spark, sf), 42).select("idx", F.round("similarity", 6).alias("similarity"))


@query
def neighbor_table(spark, sf):
    return neighbors.neighbor_table(b.tracks(spark, sf), 5).withColumn("similarity", F.round("similarity", 6))


@query
def neighbor_update(spark, sf):
    """The table of two thirds of the tracks, brought up to date with the last third."""
    tracks = b.tracks(spark, sf).select("idx", "embedding")
    old, added = tracks.where("idx % 3 <> 0"), tracks.where("idx % 3 = 0")
    return neighbors.with_added(neighbors.neighbor_table(old, 5), old, added, 5).withColumn("similarity", F.round("similarity", 6))


@query
def cohesion(spark, sf):
    return analytics.cohesion(_members(spark, sf)).select("pid", F.round("cohesion", 6).alias("cohesion"), (F.round("diversity", 6) + 0.0).alias("diversity"))


@query
def centrality_outliers(spark, sf):
    return analytics.centrality(_members(spark, sf)).select("pid", "pos", F.round("centrality", 6).alias("centrality"), (F.round("outlier", 6) + 0.0).alias("outlier"))


@query
def top_tags(spark, sf):
    return analytics.top_tags(b.table(spark, sf, "part").select(F.col("p_type").alias("tag"), F.col("p_size").cast("long").alias("weight")))


def _moves(spark, sf):
    return analytics.transitions(b.table(spark, sf, "events"), "event_type", "user_id", ["ts", "event_id"])


@query
def transition_probs(spark, sf):
    return _moves(spark, sf).select("prev", "next", "n", F.round("probability", 6).alias("probability"))


@query
def transition_probs_2(spark, sf):
    return analytics.transitions_2(b.table(spark, sf, "events"), "event_type", "user_id", ["ts", "event_id"]).select("prev2", "prev", "next", "n", F.round("probability", 6).alias("probability"))


@query
def transition_entropy(spark, sf):
    return analytics.transition_entropy(_moves(spark, sf)).select("prev", F.round("entropy", 6).alias("entropy"))


def _items(spark, sf):
    return b.occurrences(spark, sf).select("pid", F.col("part").alias("item"))


@query
def cooccurrence_ppmi(spark, sf):
    return analytics.ppmi(_items(spark, sf)).select("a", "b", "n", F.round("pmi", 6).alias("pmi"), F.round("ppmi", 6).alias("ppmi"))


@query
def item_knn(spark, sf):
    return analytics.item_knn(_items(spark, sf), 3).select("item", "rank", "neighbor", F.round("similarity", 6).alias("similarity"))


def _brand_ranking(spark, sf):
    """(rows, ranked): the most frequent tracks of a type, and every order's lines as what is relevant to it."""
    from pyspark.sql.window import Window

    rows = b.named_occurrences(spark, sf)
    ranked = rows.groupBy(F.col("album_name").alias("query"), F.col("part").alias("item")).agg(F.count("*").alias("n"))
    return rows, ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "item")))


def _brand_metrics(spark, sf):
    rows, ranked = _brand_ranking(spark, sf)
    return analytics.ranking_metrics(ranked, rows.select(F.col("album_name").alias("query"), F.col("part").alias("item")), 10)


@query
def recall_ndcg_at_k(spark, sf):
    """How many of all lines of a type its most frequent tracks are."""
    return _brand_metrics(spark, sf).select("query", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "ap", "rr")], "hit")


@query
def metric_means(spark, sf):
    found = analytics.metric_means(_brand_metrics(spark, sf))
    return found.select("queries", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "map", "mrr", "hit_rate")])


@query
def catalogue_coverage(spark, sf):
    rows, ranked = _brand_ranking(spark, sf)
    found = analytics.catalogue_coverage(ranked, rows.select(F.col("part").alias("item")))
    return found.select("items", "shown", F.round("coverage", 6).alias("coverage"))


@query
def novelty(spark, sf):
    rows, ranked = _brand_ranking(spark, sf)
    counts = rows.groupBy(F.col("part").alias("item")).agg(F.count("*").alias("count"))
    return analytics.novelty(ranked, counts).select("query", F.round("novelty", 6).alias("novelty"))


@query
def first_score(spark, sf):
    """The first planned score over every track: tags are types shared with seeds, a trajectory is nearness to the last seed."""
    tracks, own = _own(spark, sf)
    rows = recommend.with_similarities(tracks, own, OPTIONS)
    tags = own.join(tracks.select("idx", "album_name"), "idx").select(F.col("album_name").alias("__tag")).distinct()
    rows = rows.join(F.broadcast(tags), rows.album_name == F.col("__tag"), "left").withColumn("tag_match", F.col("__tag").isNotNull().cast("double"))
    rows = rows.withColumns({"novelty": 1 - F.col("popularity"), "trajectory": F.col("recent") * F.col("whole")})
    found = analytics.weighted(rows, analytics.FIRST_SCORE)
    plain = analytics.weighted(found.withColumns({"neighbor": F.col("recent"), "genre_match": F.col("tag_match")}), analytics.PLAIN_SCORE, "plain_score")
    return plain.select("idx", F.round("score", 6).alias("score"), F.round("plain_score", 6).alias("plain_score"))


@query
def cross_catalogue(spark, sf):
    """Tracks against a second catalogue: the same parts by other ids, with durations that are off by up to five seconds."""
    left = b.tracks(spark, sf).select(F.col("idx").alias("id"), "title_key", "artist_key", (F.col("idx") * 1000).alias("duration_ms"))
    right = left.select((F.col("id") + 1_000_000).alias("id"), "title_key", "artist_key", (F.col("duration_ms") + F.col("id") % 6 * 1000).alias("duration_ms"))
    return analytics.cross_match(left, right)


@query
def als_scores(spark, sf):
    """How a factorisation of orders and parts scores each line it was fitted to."""
    ratings = _items(spark, sf).groupBy(F.col("pid").cast("int").alias("pid"), F.col("item").cast("int").alias("item")).agg(F.count("*").cast("float").alias("rating"))
    ratings = written(ratings, "ratings")
    return analytics.als(ratings).transform(ratings).select("pid", "item", F.col("prediction").cast("double").alias("score"))


@query
def recall_ndcg_folds(spark, sf):
    """As recall_ndcg_at_k, over five folds of orders: each is foretold once, by a ranking that counts the other four."""
    from pyspark.sql.window import Window

    rows = b.named_occurrences(spark, sf).select("album_name", F.col("part").alias("item"), (F.col("pid") % 5).alias("fold"))
    counts = rows.groupBy("album_name", "item", "fold").agg(F.count("*").alias("n"))
    others = counts.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("test <> fold")
    ranked = others.groupBy(F.struct("album_name", F.col("test").cast("long").alias("fold")).alias("query"), "item").agg(F.sum("n").alias("n"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "item")))
    found = analytics.ranking_metrics(ranked, counts.select(F.struct("album_name", "fold").alias("query"), "item"), 10)
    return found.select(F.col("query.album_name").alias("query"), "query.fold", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "ap", "rr")], "hit")


@query
def fuzzy_titles(spark, sf):
    return analytics.fuzzy_titles(b.tracks(spark, sf), "smal rings").select("idx", F.round("similarity", 6).alias("similarity"))


def _misspelt(spark, sf):
    """Every part as a wanted song with a letter left out and two at the end doubled."""
    k = F.col("p_partkey")
    title = F.concat(F.expr("substr(p_name, 1, p_partkey % 5 + 1)"), F.expr("substr(p_name, p_partkey % 5 + 3)"), F.when(k % 3 == 0, F.expr("right(p_name, 2)")).otherwise(""))
    rows = b.table(spark, sf, "part").select(k.alias("ord"), title.alias("title"), F.when(k % 4 == 0, "someone").otherwise(F.col("p_brand")).alias("artist"))
    return rows.select("ord", fx.text_key("title").alias("title_key"), fx.artists_key("artist").alias("artists"))


@query
def fuzzy_join(spark, sf):
    """All pairs of misspelt and known titles that are alike."""
    found = fuzzy.similar_titles(_misspelt(spark, sf), b.all_tracks(spark, sf), 0.45)
    return found.select("left_title", "right_title", F.round("similarity", 6).alias("similarity"))


@query
def fuzzy_match(spark, sf):
    found = fuzzy.fuzzy_match(_misspelt(spark, sf), b.all_tracks(spark, sf), 0.45)
    return found.select("ord", "idx", F.round("similarity", 6).alias("similarity"), "artist_meets")


@query
def item_clusters(spark, sf):
    return analytics.clusters(b.tracks(spark, sf))
