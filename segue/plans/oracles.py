"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from segue.functions.text import REASONS, VARIANT_WORDS
from segue.plans.bindings import SEED_PARTS, TEXTS


def norm(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower({c}), 'ё', 'е'), 'ß', 'ss'), '[^0-9a-zа-я]+', ' ', 'g'))"


def artists(c: str) -> str:
    parts = f"regexp_split_to_array({c}, '(?i)\\s*(?:,|&| feat\\.? | ft\\.? | featuring | x |х|\\+|/)\\s*')"
    return f"list_sort(list_distinct(list_filter(list_transform({parts}, lambda p: {norm('p')}), lambda p: p <> '')))"


def canonical(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in VARIANT_WORDS)
    return f"array_to_string(list_filter(string_split({norm(c)}, ' '), lambda w: w NOT IN ({words})), ' ')"


def quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


OCC = """occ AS (SELECT l_orderkey AS pid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
    'track:' || l_partkey AS track_uri, l_partkey AS part FROM lineitem)"""
PARTS = "parts AS (SELECT p_partkey AS part, p_name AS track_name, p_brand || ' feat. ' || p_type AS artist_name, p_type AS album_name FROM part)"
NAMED = f"{OCC}, {PARTS}, named AS (SELECT occ.*, track_name, artist_name, album_name FROM occ JOIN parts USING (part))"
COUNTS = f"{OCC}, counts AS (SELECT track_uri, count(*) AS count FROM occ GROUP BY 1)"
LISTS = f"{OCC}, lists AS (SELECT pid, list(part ORDER BY pos) AS ids FROM occ GROUP BY 1 HAVING count(*) >= 2)"
TRACKS = f"""{PARTS}, cnt AS (SELECT l_partkey AS part, count(*) AS count FROM lineitem GROUP BY 1),
raw_tracks AS (SELECT part AS idx, 'track:' || part AS track_uri, track_name, artist_name, album_name, count, embedding::DOUBLE[] AS v,
    {norm("artist_name")} AS artist_key, {norm("track_name")} AS title_key, {artists("artist_name")} AS artists
    FROM parts JOIN embeddings ON vec_id = part JOIN cnt USING (part)),
tracks AS (SELECT *, ln(1 + count) / (SELECT max(ln(1 + count)) FROM raw_tracks) AS popularity FROM raw_tracks)"""
SEEDS = f"""{TRACKS}, asked(ord, part) AS (VALUES {", ".join(f"({o}, {p})" for o, p in SEED_PARTS)}), wanted AS (SELECT ord, 'track:' || part AS track_uri FROM asked),
own AS (SELECT ord, tracks.* FROM wanted JOIN tracks USING (track_uri))"""
AFFINITY = f"""{SEEDS}, named_by AS (SELECT artist, count(*) AS n FROM (SELECT unnest(artists) AS artist FROM own) GROUP BY 1),
w AS (SELECT artist, n / (SELECT max(n) FROM named_by) AS weight FROM named_by),
aff AS (SELECT idx, coalesce(max(weight), 0) AS affinity FROM (SELECT idx, unnest(artists) AS artist FROM tracks) LEFT JOIN w USING (artist) GROUP BY 1)"""


def mean_of(where: str) -> str:
    return f"""(SELECT list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) FROM
    (SELECT list(x ORDER BY d) AS m FROM (SELECT d, avg(v[d]) AS x FROM own, range(1, 65) AS r(d) WHERE {where} GROUP BY d)))"""


def rows_with(recent: str, seeds: str = AFFINITY) -> str:
    return f"""{seeds}, q AS (SELECT {mean_of(recent)} AS r, {mean_of("true")} AS w),
sup AS (SELECT idx, avg(s) AS support FROM (SELECT t.idx, list_inner_product(t.v, o.v) AS s, row_number() OVER (PARTITION BY t.idx ORDER BY list_inner_product(t.v, o.v) DESC) AS k FROM tracks t, own o) WHERE k <= 5 GROUP BY 1),
rows AS (SELECT tracks.*, affinity, support, list_inner_product(v, r) AS recent, list_inner_product(v, w) AS whole FROM tracks JOIN aff USING (idx) JOIN sup USING (idx), q)"""


DUPLICATE = f"""EXISTS (SELECT 1 FROM own o WHERE {canonical("o.track_name")} = {canonical("x.track_name")} AND {canonical("x.track_name")} <> ''
    AND (len(o.artists) = 0 OR len(x.artists) = 0 OR list_has_any(o.artists, x.artists)))"""
NO_SEED = "x.idx NOT IN (SELECT idx FROM own)"


def pool_sql(favorite: bool, keep: int, reach: int, min_count: int, recent: str, duplicates: bool) -> str:
    often = f"(x.count >= {min_count}{' OR x.affinity > 0' if favorite else ''})"
    dup = f" AND NOT {DUPLICATE}" if duplicates else ""
    near = [f"SELECT idx FROM (SELECT * FROM rows ORDER BY {c} DESC, idx LIMIT {reach}) x WHERE {NO_SEED} AND {often}{dup}" for c in ("recent", "whole")]
    if favorite:
        near.append(f"(SELECT idx FROM rows x WHERE affinity > 0 AND {NO_SEED}{dup} ORDER BY affinity DESC, count DESC, idx DESC LIMIT {keep})")
    return f"{rows_with(recent)}, pool AS ({' UNION '.join(near)})"


def hybrid(w: tuple, columns: str, min_count: int = 1, recent: str = "ord < 2", reach: int = 1124, keep: int = 120, duplicates: bool = True) -> str:
    score = f"{w[0]} * recent + {w[1]} * whole + {w[2]} * support + {w[3]} * popularity + {w[4]} * affinity"
    return f"""WITH {pool_sql(w[4] > 0, keep, reach, min_count, recent, duplicates)},
best AS (SELECT rows.*, {score} AS s FROM rows JOIN pool USING (idx) ORDER BY s DESC, idx LIMIT 20)
SELECT row_number() OVER (ORDER BY s DESC, idx) AS rank, {columns} FROM best"""


def explain(*c: str) -> str:
    recent, whole, support, popularity, affinity = c
    text = f"""concat_ws('; ', CASE WHEN {affinity} >= 0.5 THEN '{REASONS["favorite"]}' END, CASE WHEN {recent} >= {whole} AND {recent} >= 0.35 THEN '{REASONS["recent"]}' END,
    CASE WHEN {whole} >= 0.35 THEN '{REASONS["whole"]}' END, CASE WHEN {support} >= 0.35 THEN '{REASONS["support"]}' END, CASE WHEN {popularity} >= 0.55 THEN '{REASONS["popularity"]}' END)"""
    return f"coalesce(nullif({text}, ''), '{REASONS['default']}')"


HYBRID_COLUMNS = "idx, track_name, round(s, 6) AS score, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("recent", "whole", "support", "popularity", "affinity")) + ", " + explain("recent", "whole", "support", "popularity", "affinity") + " AS explanation"

MATCHED = f"""{TRACKS}, texts(ord, input_artist, input_title) AS (VALUES {", ".join("(" + ", ".join(map(quoted, t)) + ")" for t in TEXTS)}),
tiers AS (SELECT ord, idx, CASE WHEN {norm("input_artist")} = artist_key THEN 0 WHEN list_has_any({artists("input_artist")}, artists) THEN 1 ELSE 2 END AS tier FROM texts JOIN tracks ON {norm("input_title")} = title_key),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY tier, idx) AS k FROM tiers) WHERE k = 1),
matches AS (SELECT ord, input_artist, input_title, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'artist_title_fallback' WHEN 2 THEN 'title_only_uncertain' ELSE 'not_found' END AS status,
    CASE tier WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.45::DOUBLE ELSE 0::DOUBLE END AS confidence, coalesce(tier < 2, false) AS matched, track_uri,
    coalesce(track_name, '') AS track_name, coalesce(artist_name, '') AS artist_name, coalesce(album_name, '') AS album_name, coalesce(count, 0) AS count
    FROM texts LEFT JOIN best USING (ord) LEFT JOIN tracks USING (idx))"""

ENTRIES = f"""{NAMED}, heard AS (SELECT * REPLACE (CASE WHEN part % 11 = 0 THEN track_name || ' ' || part ELSE track_name END AS track_name) FROM named),
raw_entries AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN 'Ёлка' WHEN p_partkey % 3 = 0 THEN 'someone' WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_brand || ' feat. ' || p_type END AS artist,
    CASE WHEN p_partkey % 7 = 0 THEN p_name || ' x' WHEN p_partkey % 11 = 0 THEN upper(p_name) || ' ' || p_partkey ELSE upper(p_name) END AS title FROM part),
entries AS (SELECT ord, artist, CASE WHEN artist = '' THEN title ELSE artist || ' - ' || title END AS raw, {norm("title")} AS title_key, {artists("artist")} AS want FROM raw_entries),
found AS (SELECT {norm("track_name")} AS title_key, track_uri, any_value(track_name) AS track_name, any_value(artist_name) AS artist_name, count(*) AS occurrences, min((pid, pos)) AS first,
    array_to_string(list(pid ORDER BY pid, pos)[1:5], ' ') AS example_pids FROM heard WHERE {norm("track_name")} IN (SELECT title_key FROM entries) GROUP BY 1, 2)"""
COVERED = f"""{ENTRIES}, both_rows AS (SELECT ord, found.*, CASE WHEN len(want) > 0 AND want = {artists("artist_name")} THEN 0 WHEN len(want) > 0 AND list_has_any(want, {artists("artist_name")}) THEN 1 ELSE 2 END AS tier FROM entries JOIN found USING (title_key)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY tier, occurrences DESC, first) AS k, count(*) OVER (PARTITION BY ord) AS n FROM both_rows),
tried AS (SELECT entries.ord, artist, raw, tier, coalesce(n, 0) AS candidate_count, track_uri, track_name, artist_name, occurrences FROM entries LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (ord)),
named_methods AS (SELECT *, CASE WHEN tier = 0 THEN 'exact_title_same_artist_set' WHEN tier = 1 THEN 'exact_title_artist_overlap' WHEN candidate_count = 1 THEN 'unique_title_only' WHEN candidate_count = 0 THEN 'unmatched' ELSE 'ambiguous_title' END AS method FROM tried),
matches AS (SELECT ord, raw AS input, artist AS input_artist, regexp_matches(raw, '[А-Яа-яЁё]') AS has_cyrillic, method, CASE method WHEN 'exact_title_same_artist_set' THEN 1.0::DOUBLE WHEN 'exact_title_artist_overlap' THEN 0.92::DOUBLE WHEN 'unique_title_only' THEN 0.55::DOUBLE ELSE 0::DOUBLE END AS confidence,
    candidate_count, CASE WHEN method IN ('unmatched', 'ambiguous_title') THEN NULL ELSE track_uri END AS track_uri, CASE WHEN method IN ('unmatched', 'ambiguous_title') THEN NULL ELSE track_name END AS track_name,
    CASE WHEN method IN ('unmatched', 'ambiguous_title') THEN NULL ELSE artist_name END AS artist_name, CASE WHEN method IN ('unmatched', 'ambiguous_title') THEN NULL ELSE occurrences END AS occurrences FROM named_methods)"""
FILTERED = f"""{NAMED}, hits AS (SELECT * FROM named WHERE regexp_matches(track_name, '^(small|red) ') OR regexp_matches(artist_name, '^(small|red) ') OR regexp_matches(album_name, '^(small|red) ')),
kept AS (SELECT track_uri, any_value(track_name) AS track_name, any_value(artist_name) AS artist_name, count(*) AS occurrences, array_to_string(list(pid ORDER BY pid, pos)[1:5], ' ') AS example_pids FROM hits GROUP BY 1)"""
MOVES = """moved AS (SELECT lag(event_type) OVER w AS prev2, event_type AS prev, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
one AS (SELECT prev, next, count(*) AS n FROM moved WHERE next IS NOT NULL GROUP BY 1, 2), moves AS (SELECT *, n / sum(n) OVER (PARTITION BY prev) AS p FROM one)"""
MEMBERS = f"{OCC}, members AS (SELECT pid, pos, embedding::DOUBLE[] AS v FROM occ JOIN embeddings ON vec_id = part)"
ITEMS = f"""{OCC}, items AS (SELECT DISTINCT pid, part AS item FROM occ), single AS (SELECT item, count(*) AS n FROM items GROUP BY 1),
co AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.pid = y.pid AND x.item < y.item GROUP BY 1, 2)"""
TWO = """rows AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'track:' || p_partkey % 10 ELSE '' END AS track_uri, p_brand AS artist_name, p_name AS track_name FROM part),
known_rows AS (SELECT 0 AS src, *, CASE WHEN track_uri <> '' THEN track_uri ELSE artist_name || '|' || track_name END AS identity FROM rows),
mine AS (SELECT * FROM known_rows WHERE ord % 2 = 0), added AS (SELECT * FROM known_rows WHERE ord % 2 = 1 OR ord % 20 = 0),
fresh AS (SELECT * FROM added WHERE identity NOT IN (SELECT identity FROM mine) QUALIFY row_number() OVER (PARTITION BY identity ORDER BY ord) = 1)"""
ADDED = """added_rows AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'track:' || p_partkey END AS track_uri, p_brand || ' feat. ' || CASE WHEN p_partkey % 3 = 0 THEN 'No One' ELSE p_type END AS artist_name,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_name) END AS track_name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS album_name, 0 AS count, p_partkey % 5 = 0 AS matched,
    CASE WHEN p_partkey % 5 = 0 THEN 'search_result' ELSE 'unverified' END AS status, (p_partkey % 5 = 0)::INT::DOUBLE AS confidence FROM part WHERE p_partkey < 60)"""
AFTER = f"""{TRACKS}, {ADDED}, texts AS (SELECT ord, artist_name AS input_artist, track_name AS input_title FROM added_rows WHERE status = 'unverified' AND ord < 40),
{MATCHED[MATCHED.index("tiers AS"):]},
after_matching AS (SELECT a.ord, CASE WHEN m.matched THEN m.track_uri ELSE a.track_uri END AS track_uri, CASE WHEN m.matched AND m.artist_name <> '' THEN m.artist_name ELSE a.artist_name END AS artist_name,
    CASE WHEN m.matched AND m.track_name <> '' THEN m.track_name ELSE a.track_name END AS track_name, CASE WHEN m.matched AND m.album_name <> '' THEN m.album_name ELSE a.album_name END AS album_name,
    CASE WHEN m.matched AND m.count <> 0 THEN m.count ELSE a.count END AS count, coalesce(m.matched, a.matched) AS matched, coalesce(m.status, a.status) AS status, coalesce(m.confidence, a.confidence) AS confidence
    FROM added_rows a LEFT JOIN matches m USING (ord))"""
GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({c}) - 2) + 1), lambda i: substr({c}, i, 3)))"


def grams(c: str) -> str:
    return GRAMS.replace("{c}", c)


def _ladder(query: str) -> str:
    tokens = query.split()
    hit = [f"(contains(artist_key, '{t}') OR contains(title_key, '{t}'))" for t in tokens]
    some = f"WHEN {' OR '.join(hit)} THEN 10 + {' + '.join(f'{h}::INT' for h in hit)}" if len(tokens) > 1 else ""
    return f"""CASE WHEN artist_key = '{query}' OR title_key = '{query}' THEN 100 WHEN starts_with(artist_key, '{query}') THEN 92 WHEN starts_with(title_key, '{query}') THEN 88
    WHEN contains(artist_key, '{query}') THEN 82 WHEN contains(title_key, '{query}') THEN 78 WHEN contains(artist_key || ' ' || title_key, '{query}') THEN 70 WHEN {" AND ".join(hit)} THEN 60 {some} ELSE 0 END"""


METRICS = f"""{NAMED}, c AS (SELECT album_name AS query, part AS item, count(*) AS n FROM named GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, item) AS rank FROM c), rel AS (SELECT DISTINCT album_name AS query, part AS item FROM named),
        tot AS (SELECT query, count(*) AS total FROM rel GROUP BY 1), h AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS hits FROM ranked JOIN rel USING (query, item) WHERE rank <= 10),
        f AS (SELECT query, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, sum(hits / rank) AS ps, min(rank) AS first FROM h GROUP BY 1),
metrics AS (SELECT query, coalesce(found, 0) / total AS recall, coalesce(found, 0) / 10 AS precision, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, total) + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
    coalesce(ps, 0) / least(10, total) AS ap, coalesce(1 / first, 0) AS rr, (coalesce(found, 0) > 0)::INT AS hit FROM tot LEFT JOIN f USING (query))"""
ALL_TRACKS = TRACKS.replace("JOIN embeddings ON vec_id = part", "JOIN embeddings ON vec_id = part % (SELECT max(vec_id) + 1 FROM embeddings)")


MISSPELT = f"""{ALL_TRACKS}, spelt AS (SELECT p_partkey AS ord, {norm("substr(p_name, 1, (p_partkey % 5 + 1)::INT) || substr(p_name, (p_partkey % 5 + 3)::INT) || CASE WHEN p_partkey % 3 = 0 THEN right(p_name, 2) ELSE '' END")} AS title_key,
    {artists("CASE WHEN p_partkey % 4 = 0 THEN 'someone' ELSE p_brand END")} AS artists FROM part), wanted AS (SELECT *, {grams("title_key")} AS g FROM spelt)"""


def indexed_search(query: str, limit: int, offset: int) -> str:
    """A page ranked among the tracks with a word that begins with one of the query's, or among all if those are too few."""
    most = min(max(offset + limit + 1, 500), 5101)
    begins = " OR ".join(f"starts_with(t, '{w}')" for w in query.split())
    return f"""WITH {ALL_TRACKS}, s AS (SELECT idx, track_name, count, {_ladder(query)} AS score, len(list_filter(string_split(artist_key || ' ' || title_key, ' '), lambda t: {begins})) > 0 AS held FROM tracks),
        enough AS (SELECT count(*) FILTER (held AND score > 0) >= {most} AS yes FROM s),
        ranked AS (SELECT idx, track_name, score, s.count, row_number() OVER (ORDER BY score DESC, s.count DESC, idx) - 1 AS place FROM s, enough WHERE score > 0 AND (held OR NOT yes))
        SELECT place, idx, track_name, score, count, (SELECT count(*) FROM ranked) > {offset + limit} AS has_more FROM ranked WHERE place >= {offset} AND place < {offset + limit}"""


ORACLES: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, md5({norm('coalesce(text, chr(32))')}) AS normalized FROM documents",
    "split_artists": "SELECT p_partkey, array_to_string(" + artists("p_brand || ' feat. ' || p_type || ' & ' || p_name") + ", ',') AS artists FROM part",
    "canonical_title": "SELECT p_partkey, " + canonical("p_name || ' (Live ' || p_brand || ' Remastered Version)'") + " AS title FROM part",
    "script_filter": "SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(translate(text, 'éñü', 'ёяю'), '[А-Яа-яЁё]')",
    "track_links": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://open.spotify.com/track/' || p_partkey ELSE '' END AS link,
        CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || CASE WHEN s >= 60 THEN (s % 3600 // 60) || 'm ' ELSE '' END || (s % 60) || 's' AS duration,
        round(p_partkey / 3000 * 100)::INT AS percent, printf('%.3f', p_partkey / 3000) AS component FROM (SELECT p_partkey, p_partkey * 37 AS s FROM part)""",
    "markdown_cells": r"SELECT doc_id, md5(replace(text, '|', '\|')) AS cell FROM documents",
    "subsampling_shares": f"""WITH {NAMED}, c AS (SELECT track_uri, count(*) AS count, min((pid, pos)) AS first FROM named GROUP BY 1 HAVING count(*) >= 2),
        v AS (SELECT row_number() OVER (ORDER BY count DESC, first) - 1 AS idx, count / (0.0001 * sum(count) OVER ()) AS often FROM c)
        SELECT idx, round(least(1, (sqrt(often) + 1) / often), 9) AS keep FROM v""",
    "sentence_build": f"WITH {OCC}, {PARTS} SELECT pid, array_to_string(list(track_uri ORDER BY pos), ' ') AS uris FROM occ JOIN parts USING (part) GROUP BY 1 HAVING count(*) >= 2",
    "corpus_statistics": f"WITH {LISTS} SELECT count(*) AS corpus_count, coalesce(sum(len(ids)), 0) AS corpus_total_words FROM lists",
    "occurrence_count": f"WITH {COUNTS} SELECT * FROM counts",
    "first_seen_metadata": f"""WITH {NAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY track_uri ORDER BY pid, pos) AS n FROM named)
        SELECT track_uri, track_name, artist_name, album_name, pid AS first_pid, pos AS first_pos FROM k WHERE n = 1""",
    "vocab_index": f"""WITH {NAMED}, c AS (SELECT track_uri, any_value(track_name) AS track_name, count(*) AS count, min((pid, pos)) AS first FROM named GROUP BY 1 HAVING count(*) >= 2)
        SELECT track_uri, track_name, count, row_number() OVER (ORDER BY count DESC, first) - 1 AS idx FROM c""",
    "min_count_filter": f"WITH {COUNTS} SELECT * FROM counts WHERE count >= 20",
    "metadata_for_keys": f"WITH {NAMED} SELECT track_uri, any_value(track_name) AS track_name, any_value(artist_name) AS artist_name, any_value(album_name) AS album_name FROM named GROUP BY 1 HAVING count(*) >= 20",
    "popularity_prior": f"WITH {TRACKS} SELECT idx, round(popularity, 6) AS popularity FROM tracks",
    "first_playlists": f"WITH {OCC}, s AS (SELECT pid, count(*) AS n FROM occ GROUP BY 1 ORDER BY 1 LIMIT 50) SELECT pid, n FROM s WHERE n >= 2",
    "oov_removal": f"""WITH {COUNTS} SELECT pid, array_to_string(list(part ORDER BY pos), ' ') AS ids FROM occ WHERE track_uri IN (SELECT track_uri FROM counts WHERE count >= 20) GROUP BY 1 HAVING count(*) >= 2""",
    "skipgram_pairs": f"""WITH {OCC}, l AS (SELECT * FROM occ WHERE pid IN (SELECT pid FROM occ GROUP BY 1 HAVING count(*) >= 2))
        SELECT x.part AS center, y.part AS context, count(*) AS n FROM l x JOIN l y ON x.pid = y.pid AND x.pos <> y.pos AND abs(x.pos - y.pos) <= 5 GROUP BY 1, 2""",
    "pair_statistics": f"""WITH {OCC}, l AS (SELECT pid, count(*) AS m FROM occ GROUP BY 1 HAVING count(*) >= 2)
        SELECT sum(list_sum(list_transform(range(0, m), lambda i: least(i, 5) + least(m - 1 - i, 5))))::BIGINT AS pairs, count(*) AS playlists FROM l""",
    "context_windows": f"""WITH {OCC} SELECT x.pid, x.pos, any_value(x.part) AS part, coalesce(array_to_string(list(y.part ORDER BY y.pos) FILTER (y.part IS NOT NULL), ' '), '') AS context
        FROM occ x LEFT JOIN occ y ON x.pid = y.pid AND x.pos <> y.pos AND abs(x.pos - y.pos) <= 2 GROUP BY 1, 2""",
    "negative_sampling_probs": f"WITH {COUNTS} SELECT track_uri, round(pow(count, 0.75) / (SELECT sum(pow(count, 0.75)) FROM counts), 10) AS probability FROM counts",
    "batch_lookup": f"WITH {SEEDS} SELECT ord, track_uri, track_name, count FROM own",
    "missing_uris": f"WITH {SEEDS} SELECT ord, track_uri FROM wanted WHERE track_uri NOT IN (SELECT track_uri FROM tracks)",
    "point_lookup": f"WITH {TRACKS} SELECT idx, track_name, artist_name FROM tracks WHERE track_uri = 'track:42'",
    "token_index": f"""WITH {TRACKS}, t AS (SELECT DISTINCT idx, unnest(string_split(artist_key || ' ' || title_key, ' ')) AS token FROM tracks)
        SELECT token, count(*) AS postings, min(idx) AS first_idx, max(idx) AS last_idx FROM t GROUP BY 1""",
    "artist_index": f"WITH {TRACKS} SELECT artist, count(*) AS postings, min(idx) AS first_idx, max(idx) AS last_idx FROM (SELECT idx, unnest(artists) AS artist FROM tracks) GROUP BY 1",
    "index_statistics": f"""WITH {TRACKS} SELECT count(*) AS tracks, (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(artist_key || ' ' || title_key, ' ')) AS t FROM tracks)) AS tokens,
        (SELECT count(DISTINCT a) FROM (SELECT unnest(artists) AS a FROM tracks)) AS artists FROM tracks""",
    "title_index": f"WITH {TRACKS} SELECT title_key, count(*) AS tracks, min(idx) AS first_idx FROM tracks GROUP BY 1",
    "exact_index": f"WITH {TRACKS} SELECT artist_key, title_key, min(idx) AS idx FROM tracks GROUP BY 1, 2",
    "prefix_match": f"""WITH {TRACKS}, t AS (SELECT DISTINCT idx, unnest(string_split(artist_key || ' ' || title_key, ' ')) AS token FROM tracks)
        SELECT DISTINCT idx, q AS query_token FROM t JOIN (VALUES ('sm'), ('bo'), ('econ')) v(q) ON starts_with(token, q)""",
    "search_rank": f"WITH {TRACKS}, s AS (SELECT idx, {_ladder('small ring')} AS score, count FROM tracks) SELECT * FROM s WHERE score > 0",
    "search_page": f"WITH {TRACKS}, s AS (SELECT idx, {_ladder('brand 2')} AS score, count FROM tracks) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, count DESC, idx LIMIT 20 OFFSET 10",
    "match_detailed": f"WITH {MATCHED} SELECT * FROM matches",
    "match_uris": f"WITH {MATCHED} SELECT ord, track_uri FROM matches WHERE matched",
    "match_summary": f"WITH {MATCHED} SELECT count(*) AS tracks, count(*) FILTER (matched) AS matched_count FROM matches",
    "hybrid_balance": hybrid((0.45, 0.25, 0.20, 0.10, 0.0), HYBRID_COLUMNS, reach=1124),
    "hybrid_more_recent": hybrid((0.65, 0.15, 0.15, 0.05, 0.0), HYBRID_COLUMNS, reach=1124),
    "hybrid_favorite": hybrid((0.25, 0.20, 0.15, 0.05, 0.35), HYBRID_COLUMNS, reach=1124),
    "hybrid_more_popular": hybrid((0.35, 0.20, 0.20, 0.25, 0.0), HYBRID_COLUMNS, reach=1124),
    "hybrid_cli": hybrid((0.45, 0.25, 0.20, 0.10, 0.0), "idx, round(s, 6) AS score", min_count=5, recent="ord >= 3 AND ord < 5", reach=124, duplicates=False),
    "simple_recommend": f"""WITH {rows_with("true")}, best AS (SELECT * FROM rows x WHERE {NO_SEED} ORDER BY whole DESC, idx LIMIT 20)
        SELECT row_number() OVER (ORDER BY whole DESC, idx) AS rank, idx, track_name, round(whole, 6) AS score FROM best""",
    "candidate_pool": f"WITH {pool_sql(True, 120, 1124, 1, 'ord < 2', True)} SELECT idx FROM pool",
    "multi_seed_support": f"WITH {rows_with('true')} SELECT idx, round(support, 6) AS support FROM sup",
    "artist_affinity": f"WITH {AFFINITY} SELECT idx, round(affinity, 6) AS affinity FROM aff",
    "favorite_pool": f"WITH {AFFINITY} SELECT x.idx, round(affinity, 6) AS affinity, count FROM tracks x JOIN aff USING (idx) WHERE affinity > 0 AND {NO_SEED} AND NOT {DUPLICATE} ORDER BY affinity DESC, count DESC, x.idx DESC LIMIT 30",
    "seed_duplicate_anti": f"WITH {SEEDS} SELECT idx FROM tracks x WHERE NOT {DUPLICATE}",
    "explanations": f"WITH {rows_with('ord < 2')} SELECT idx, {explain(*[f'round({c}, 6)' for c in ('recent', 'whole', 'support', 'popularity', 'affinity')])} AS explanation FROM rows",
    "coverage_candidates": f"WITH {ENTRIES} SELECT title_key, track_uri, occurrences, occurrences AS playlist_count, example_pids FROM found",
    "coverage_match": f"WITH {COVERED} SELECT * FROM matches",
    "coverage_summary": f"""WITH {COVERED} SELECT count(*) AS entries, count(DISTINCT input) AS unique_entries, count(track_uri) AS matched_entries, count(DISTINCT track_uri) AS matched_unique_track_uris,
        count(*) FILTER (confidence > 0.9) AS confident_matched_entries, count(*) - count(track_uri) AS unmatched_or_ambiguous_entries, round(count(track_uri) / count(*), 4) AS match_rate,
        round(count(*) FILTER (confidence > 0.9) / count(*), 4) AS confident_match_rate, coalesce(sum(occurrences), 0) AS total_occurrences_for_matched FROM matches""",
    "coverage_cyrillic": f"""WITH {COVERED} SELECT count(*) AS entries, count(DISTINCT input) AS unique_entries, count(track_uri) AS matched_entries, count(DISTINCT track_uri) AS matched_unique_track_uris,
        count(*) FILTER (confidence > 0.9) AS confident_matched_entries, count(*) - count(track_uri) AS unmatched_or_ambiguous_entries, round(count(track_uri) / count(*), 4) AS match_rate,
        round(count(*) FILTER (confidence > 0.9) / count(*), 4) AS confident_match_rate, coalesce(sum(occurrences), 0) AS total_occurrences_for_matched FROM matches WHERE has_cyrillic""",
    "coverage_examples": f"""WITH {COVERED}, k AS (SELECT CASE WHEN track_uri IS NULL THEN 'unmatched' ELSE 'matched' END AS kind, ord, input FROM matches
        UNION ALL SELECT 'cyrillic_unmatched', ord, input FROM matches WHERE track_uri IS NULL AND has_cyrillic)
        SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ord) <= 30""",
    "coverage_methods": f"WITH {COVERED} SELECT method, count(*) AS n FROM matches GROUP BY 1",
    "top_artists": f"WITH {ENTRIES} SELECT artist, count(*) AS n, min(ord) AS first_ord FROM entries WHERE artist <> '' GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 20",
    "top_cyrillic_artists": f"WITH {ENTRIES} SELECT artist, count(*) AS n, min(ord) AS first_ord FROM entries WHERE artist <> '' AND regexp_matches(raw, '[А-Яа-яЁё]') GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 30",
    "uncertain_export": f"""WITH {COVERED} SELECT ord, CASE WHEN contains(input, ' - ') THEN split_part(input, ' - ', 1) ELSE '' END AS input_artist, CASE WHEN contains(input, ' - ') THEN split_part(input, ' - ', 2) ELSE input END AS input_title,
        track_name AS recognized_title, artist_name AS recognized_artist, method, confidence, candidate_count, occurrences AS mpd_occurrences, track_uri FROM matches WHERE method = 'unique_title_only'""",
    "filtered_tracks": f"WITH {FILTERED} SELECT * FROM kept",
    "filtered_manifest": f"WITH {FILTERED} SELECT count(*) AS unique_tracks, coalesce(sum(occurrences), 0) AS total_occurrences FROM kept",
    "parse_import": """SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ', ";"x' WHEN 2 THEN p_brand ELSE '' END AS artist_name,
        p_name AS track_name FROM part""",
    "playlist_dedupe": f"WITH {TWO} SELECT row_number() OVER (ORDER BY src, ord) - 1 AS ord, track_uri, artist_name, track_name FROM (SELECT * REPLACE (1 AS src) FROM mine UNION ALL SELECT * REPLACE (2 AS src) FROM fresh)",
    "playlist_prepend": f"WITH {TWO} SELECT row_number() OVER (ORDER BY src, ord) - 1 AS ord, track_uri, artist_name, track_name FROM (SELECT * REPLACE (1 AS src) FROM mine UNION ALL SELECT * REPLACE (0 AS src) FROM fresh)",
    "playlist_removed": "SELECT CASE WHEN p_partkey > 4 THEN p_partkey - 2 ELSE p_partkey - 1 END AS ord, p_name AS track_name FROM part WHERE p_partkey <> 4",
    "playlist_swapped": "SELECT CASE p_partkey WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE p_partkey - 1 END AS ord, p_name AS track_name FROM part",
    "playlist_duplicates": f"WITH {TWO} SELECT (SELECT count(*) FROM added) - (SELECT count(*) FROM fresh) AS duplicates",
    "playlist_rows": f"WITH {ADDED} SELECT * FROM added_rows",
    "playlist_after_matching": f"WITH {AFTER} SELECT * FROM after_matching",
    "playlist_seeds": f"WITH {AFTER} SELECT ord, track_uri FROM after_matching WHERE matched AND coalesce(track_uri, '') <> ''",
    "playlist_status": f"""WITH {AFTER} SELECT count(*) AS total, count(*) FILTER (matched AND track_uri <> '') AS matched, count(*) FILTER (status = 'title_only_uncertain') AS uncertain,
        count(*) FILTER (status = 'unverified') AS pending FROM after_matching""",
    "playlist_pending": f"WITH {AFTER} SELECT ord, track_name FROM after_matching WHERE status = 'unverified'",
    "similar_items": f"WITH {TRACKS} SELECT t.idx, round(list_inner_product(t.v, o.v), 6) AS similarity FROM tracks t, tracks o WHERE o.idx = 42 AND t.idx <> 42 ORDER BY list_inner_product(t.v, o.v) DESC, t.idx LIMIT 10",
    "neighbor_table": f"""WITH {TRACKS}, s AS (SELECT t.idx, o.idx AS neighbor, list_inner_product(t.v, o.v) AS p FROM tracks t JOIN tracks o ON t.idx <> o.idx),
        k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p DESC, neighbor) AS rank FROM s) SELECT idx, rank, neighbor, round(p, 6) AS similarity, 'embedding' AS source FROM k WHERE rank <= 5""",
    "neighbor_update": f"""WITH {TRACKS}, s AS (SELECT t.idx, o.idx AS neighbor, list_inner_product(t.v, o.v) AS p FROM tracks t JOIN tracks o ON t.idx <> o.idx),
        k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p DESC, neighbor) AS rank FROM s) SELECT idx, rank, neighbor, round(p, 6) AS similarity, 'embedding' AS source FROM k WHERE rank <= 5""",
    "cohesion": f"""WITH {MEMBERS} SELECT x.pid, round(avg(list_inner_product(x.v, y.v)), 6) AS cohesion, round(1 - avg(list_inner_product(x.v, y.v)), 6) + 0.0 AS diversity
        FROM members x JOIN members y ON x.pid = y.pid AND x.pos < y.pos GROUP BY 1""",
    "centrality_outliers": f"""WITH {MEMBERS} SELECT x.pid, x.pos, round(avg(list_inner_product(x.v, y.v)), 6) AS centrality, round(1 - avg(list_inner_product(x.v, y.v)), 6) + 0.0 AS outlier
        FROM members x JOIN members y ON x.pid = y.pid AND x.pos <> y.pos GROUP BY 1, 2""",
    "top_tags": "SELECT p_type AS tag, sum(p_size) AS weight FROM part GROUP BY 1 ORDER BY weight DESC, tag LIMIT 10",
    "transition_probs": f"WITH {MOVES} SELECT prev, next, n, round(p, 6) AS probability FROM moves",
    "transition_probs_2": f"""WITH {MOVES}, two AS (SELECT prev2, prev, next, count(*) AS n FROM moved WHERE next IS NOT NULL AND prev2 IS NOT NULL GROUP BY 1, 2, 3)
        SELECT prev2, prev, next, n, round(n / sum(n) OVER (PARTITION BY prev2, prev), 6) AS probability FROM two""",
    "transition_entropy": f"WITH {MOVES} SELECT prev, round(-sum(p * log2(p)), 6) AS entropy FROM moves GROUP BY 1",
    "cooccurrence_ppmi": f"""WITH {ITEMS}, p AS (SELECT a, b, co.n, log2(co.n * (SELECT count(DISTINCT pid) FROM items) / (x.n * y.n)) AS pmi FROM co JOIN single x ON x.item = a JOIN single y ON y.item = b)
        SELECT a, b, n, round(pmi, 6) AS pmi, round(greatest(pmi, 0), 6) AS ppmi FROM p""",
    "item_knn": f"""WITH {ITEMS}, both_ways AS (SELECT a AS item, b AS neighbor, n FROM co UNION ALL SELECT b, a, n FROM co),
        s AS (SELECT both_ways.item, neighbor, both_ways.n / sqrt(x.n * y.n) AS p FROM both_ways JOIN single x ON x.item = both_ways.item JOIN single y ON y.item = neighbor),
        k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, neighbor) AS rank FROM s) SELECT item, rank, neighbor, round(p, 6) AS similarity FROM k WHERE rank <= 3""",
    "recall_ndcg_at_k": f"WITH {METRICS} SELECT query, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap, round(rr, 6) AS rr, hit FROM metrics",
    "metric_means": f"WITH {METRICS} SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit_rate FROM metrics",
    "catalogue_coverage": f"WITH {METRICS}, s AS (SELECT count(DISTINCT item) AS shown FROM ranked WHERE rank <= 10), i AS (SELECT count(DISTINCT part) AS items FROM named) SELECT items, shown, round(shown / items, 6) AS coverage FROM s, i",
    "novelty": f"""WITH {METRICS}, k AS (SELECT part AS item, -log2(count(*) / (SELECT count(*) FROM named)) AS bits FROM named GROUP BY 1)
        SELECT query, round(avg(bits), 6) AS novelty FROM ranked JOIN k USING (item) WHERE rank <= 10 GROUP BY 1""",
    "first_score": f"""WITH {rows_with("ord < 2")}, t AS (SELECT idx, recent, whole, popularity, (album_name IN (SELECT album_name FROM own))::INT::DOUBLE AS tag FROM rows)
        SELECT idx, round(0.35 * recent + 0.25 * whole + 0.20 * tag + 0.10 * (1 - popularity) + 0.10 * recent * whole, 6) AS score, round(0.5 * recent + 0.3 * tag + 0.2 * tag, 6) AS plain_score FROM t""",
    "cross_catalogue": f"""WITH {TRACKS} SELECT x.idx AS left_id, y.idx + 1000000 AS right_id FROM tracks x JOIN tracks y USING (title_key, artist_key) WHERE abs(x.idx * 1000 - (y.idx * 1000 + y.idx % 6 * 1000)) <= 3000""",
    "search_words": f"""WITH {ALL_TRACKS}, t AS (SELECT idx, unnest(string_split(artist_key || ' ' || title_key, ' ')) AS token FROM tracks)
        SELECT DISTINCT idx FROM t WHERE starts_with(token, 'sm') OR starts_with(token, 'econ')""",
    "search_indexed": indexed_search("brand 2", 20, 10),
    "search_indexed_words": indexed_search("small econ", 30, 460),
    "search_fallback": indexed_search("mall rin", 20, 0),
    "search_has_more": f"WITH {TRACKS}, s AS (SELECT count(*) FILTER ({_ladder('brand 2')} > 0) AS n FROM tracks) SELECT o AS \"offset\", z AS size, n > o + z AS has_more FROM s, (VALUES (0, 20), (40, 100), (5000, 100)) p(o, z)",
    "token_postings": f"WITH {TRACKS} SELECT DISTINCT unnest(string_split(artist_key || ' ' || title_key, ' ')) AS token, idx FROM tracks",
    "artist_postings": f"WITH {TRACKS} SELECT unnest(artists) AS artist, idx FROM tracks",
    "posting_lists": f"WITH {TRACKS}, t AS (SELECT DISTINCT idx, unnest(string_split(artist_key || ' ' || title_key, ' ')) AS token FROM tracks) SELECT token, idx // 100 AS block, array_to_string(list(idx ORDER BY idx), ' ') AS ids FROM t GROUP BY 1, 2",
    "title_uris": f"WITH {TRACKS} SELECT title_key, row_number() OVER (PARTITION BY title_key ORDER BY idx) - 1 AS place, track_uri FROM tracks",
    "hybrid_all_parts": "WITH " + pool_sql(True, 124, 1124, 30, "ord < 2", True).replace(TRACKS, ALL_TRACKS) + """, best AS (SELECT rows.*, 0.25 * recent + 0.20 * whole + 0.15 * support + 0.05 * popularity + 0.35 * affinity AS s FROM rows JOIN pool USING (idx) ORDER BY s DESC, idx LIMIT 20)
        SELECT row_number() OVER (ORDER BY s DESC, idx) AS rank, idx, round(s, 6) AS score, round(recent, 6) AS recent, round(whole, 6) AS whole, round(support, 6) AS support, round(popularity, 6) AS popularity, round(affinity, 6) AS affinity FROM best""",
    "candidate_pool_all_parts": "WITH " + pool_sql(False, 124, 1124, 30, "ord < 2", True).replace(TRACKS, ALL_TRACKS) + " SELECT idx FROM pool",
    "recall_ndcg_folds": f"""WITH {NAMED}, c AS (SELECT album_name AS query, part AS item, fold, count(*) AS n FROM named, range(5) AS t(fold) WHERE pid % 5 <> fold GROUP BY 1, 2, 3),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query, fold ORDER BY n DESC, item) AS rank FROM c), rel AS (SELECT DISTINCT album_name AS query, part AS item, pid % 5 AS fold FROM named),
        tot AS (SELECT query, fold, count(*) AS total FROM rel GROUP BY 1, 2), h AS (SELECT query, fold, rank, row_number() OVER (PARTITION BY query, fold ORDER BY rank) AS hits FROM ranked JOIN rel USING (query, fold, item) WHERE rank <= 10),
        f AS (SELECT query, fold, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, sum(hits / rank) AS ps, min(rank) AS first FROM h GROUP BY 1, 2)
        SELECT query, fold, round(coalesce(found, 0) / total, 6) AS recall, round(coalesce(found, 0) / 10, 6) AS precision, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, total) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
        round(coalesce(ps, 0) / least(10, total), 6) AS ap, round(coalesce(1 / first, 0), 6) AS rr, (coalesce(found, 0) > 0)::INT AS hit FROM tot LEFT JOIN f USING (query, fold)""",
    "fuzzy_join": f"""WITH {MISSPELT} SELECT l.title_key AS left_title, r.title_key AS right_title, round(len(list_intersect(l.g, r.g)) / len(list_distinct(l.g || r.g)), 6) AS similarity
        FROM (SELECT DISTINCT title_key, g FROM wanted) l, (SELECT DISTINCT title_key, {grams("title_key")} AS g FROM tracks) r WHERE len(list_intersect(l.g, r.g)) / len(list_distinct(l.g || r.g)) >= 0.45""",
    "fuzzy_match": f"""WITH {MISSPELT}, titles AS (SELECT DISTINCT title_key, {grams("title_key")} AS g FROM tracks),
        near AS (SELECT l.title_key AS l, r.title_key AS r, len(list_intersect(l.g, r.g)) / len(list_distinct(l.g || r.g)) AS p FROM (SELECT DISTINCT title_key, g FROM wanted) l, titles r),
        best AS (SELECT ord, idx, round(p, 6) AS similarity, list_has_any(t.artists, w.artists) AS artist_meets, row_number() OVER (PARTITION BY ord ORDER BY p DESC, NOT list_has_any(t.artists, w.artists), t.count DESC, idx) AS n
            FROM wanted w JOIN near ON l = w.title_key AND p >= 0.45 JOIN tracks t ON t.title_key = r)
        SELECT ord, idx, similarity, artist_meets FROM best WHERE n = 1""",
    "fuzzy_titles": f"""WITH {TRACKS}, g AS (SELECT idx, {grams("title_key")} AS a, {grams("'smal rings'")} AS b FROM tracks),
        s AS (SELECT idx, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS p FROM g) SELECT idx, round(p, 6) AS similarity FROM s WHERE p >= 0.3""",
}
