"""Removal of repeated multi-line chunks, in DataFrame expressions only.

A rolling hash over the hashes of two neighbouring lines slides over every text. A window that occurs more than once
in all texts (by its bytes, once the hash has picked it) has a first place, by id, then place in the text. Chunk
boundaries lie where windows begin or stop to be repeated, and where their first places stop to follow each other. They
depend on the lines around them only and move along with them, so a chunk is a passage of two or more lines, as long as
possible, that stands elsewhere line for line, whatever surrounds it.

Chunks go everywhere but at their first place. Lines of a window that is first where it stands stay, also where a chunk
ends in them: so the first place of every chunk is left whole, and whatever goes stands somewhere in full. A run of empty
lines counts as one line; two neighbouring lines that are blank are no window. Empty lines at the edge of a passage stay
where their number differs. This is `without_passages`.

`without_repeats` is the classic cut, where the same rolling hash is divisible by MODULUS. Its boundaries need no
table of hashes, but a passage's first and last lines fall into chunks that are mixed with other lines, and a passage
of few lines may have no chunk of its own.

Defined results: a null text stays null, an empty one empty. Null ids come first. Rows with the same id and text are
one document; texts of one id come in the order of the start of their MD5. Other columns are kept as they are. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.common import filter_words, may_be_held, spare_prefix, written

MODULUS = 2


def _let(name: str, value: str, body: str) -> str:
    """SQL that binds a value to a name, so that it is computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunks_of(text_col: str) -> Column:
    """array<struct<place, lines, chunk>>: the text's lines in content-defined chunks, in order; null for a null text."""
    rolling = "h[i] + 31 * if(i > 0, h[i - 1], 0L)"
    ends = f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 OR pmod({rolling}, {MODULUS}) = 0)"
    start = "if(k > 0, ends[k - 1] + 1, 0)"
    chunk = f"named_struct('place', k, 'lines', ends[k] - {start} + 1, 'chunk', array_join(slice(lines, {start} + 1, ends[k] - {start} + 1), '\\n'))"
    body = _let("ends", ends, f"transform(sequence(0, size(ends) - 1), k -> {chunk})")
    hashes = "transform(lines, l -> cast(conv(substr(md5(l), 1, 8), 16, 10) as bigint))"
    return F.expr(f"if(`{text_col}` is null, null, {_let('lines', f'split(`{text_col}`, chr(10), -1)', _let('h', hashes, body))})")


def text_order(text_col: str) -> Column:
    """A number by which texts of one id are ordered, the first 60 bits of the MD5."""
    return F.expr(f"cast(conv(substr(md5(`{text_col}`), 1, 15), 16, 10) as bigint)")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, gone array<int>): the places of the chunks to remove, of texts that have any."""
    parts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.explode(chunks_of(text_col)).alias("c")).select("id", "text_hash", "c.place", "c.lines", "c.chunk")
    parts = parts.where(r"lines > 1 AND chunk rlike '\\S'").select("id", "text_hash", "place", "chunk", F.xxhash64("chunk").alias("hash"))
    often = written(parts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    # a filter of bounded size keeps the bytes of single chunks out of the shuffle, the join is exact
    likely = may_be_held(parts, "hash", filter_words(often, "hash"))
    found = written(likely.join(often, "hash").select(*parts.columns), "repeated-chunks")  # a semi-join would be pushed below the filter
    # written, so that the join deals both sides anew and can split a chunk that very many texts hold
    first = written(found.groupBy("hash", "chunk").agg(F.min(F.struct("id", "text_hash", "place")).alias("first")), "first-chunks")
    later = found.join(first, ["hash", "chunk"]).where(~F.struct("id", "text_hash", "place").eqNullSafe(F.col("first")))
    return later.groupBy("id", "text_hash").agg(F.collect_set("place").alias("gone"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The rows of docs without repeated chunks in their texts; removed_col counts the chunks that went."""
    p = spare_prefix(docs)
    gone = repeated(docs, id_col, text_col).select(F.col("id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}text_hash"), F.col("gone").alias(f"{p}gone"))
    both = docs.withColumn(f"{p}hash", F.xxhash64(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}text_hash")), "left")
    places = F.col(f"{p}gone")
    kept = F.array_join(F.transform(F.filter(chunks_of(text_col), lambda c: ~F.array_contains(places, c["place"])), lambda c: c["chunk"]), "\n")
    text = F.when(places.isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    columns = [text if c == text_col else docs[c] for c in docs.columns]
    if removed_col:
        columns.append(F.when(places.isNull(), 0).otherwise(F.size(places)).alias(removed_col))
    return both.select(*columns)


#: SQL for the lines of a text, a run of empty lines as one; joined by line feeds they give the text.
UNITS = r"split(`{}`, '(?<!\\n)\\n|\\n(?!\\n)', -1)"


def _windows(docs: DataFrame, id_col: str, text_col: str, chunks: bool) -> DataFrame:
    """(id, text_hash, place, hash) and, if asked for, chunk of every two neighbouring lines that are not all blank; hash rolls over the hashes of lines."""
    chunk = ", concat(u[i], chr(10), u[i + 1]) AS chunk" if chunks else ""
    window = f"transform(sequence(0, size(u) - 2), i -> struct(i AS place, xxhash64(h[i] * 31 + h[i + 1]) AS hash, u[i] rlike '\\\\S' OR u[i + 1] rlike '\\\\S' AS told{chunk}))"
    rows = docs.select(F.col(id_col).alias("id"), text_order(text_col).alias("text_hash"), F.expr(UNITS.format(text_col)).alias("u")).where("size(u) > 1")
    rows = rows.withColumn("h", F.transform("u", lambda line: F.xxhash64(line).bitwiseAND(F.lit((1 << 58) - 1))))
    return rows.select("id", "text_hash", F.explode(F.expr(window)).alias("c")).where("c.told").select("id", "text_hash", "c.place", "c.hash", *["c.chunk"] * chunks)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, gone array<int>): the places of the lines to remove, of texts that have any."""
    often = written(_windows(docs, id_col, text_col, False).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    # as in repeated: a bounded filter first, then what is exact
    found = written(may_be_held(_windows(docs, id_col, text_col, True), "hash", filter_words(often, "hash")), "repeated-windows")
    place = F.struct("id", "text_hash", "place")
    both = found.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = written(both.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "first-windows")
    own = F.struct("id", "text_hash", "place").eqNullSafe(F.col("first"))
    told = found.join(first, ["hash", "chunk"]).select("id", "text_hash", "place", own.alias("own"))
    lines = told.select("id", "text_hash", "own", F.explode(F.array(F.col("place"), F.col("place") + 1)).alias("line"))
    of = lambda test: F.collect_set(F.when(test, F.col("line")))
    gone = lines.groupBy("id", "text_hash").agg(F.array_except(of(~F.col("own")), of(F.col("own"))).alias("gone"))
    return gone.where("size(gone) > 0")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The rows of docs without the lines of repeated passages; removed_col counts the lines that went."""
    p = spare_prefix(docs)
    gone = repeated_lines(docs, id_col, text_col).select(F.col("id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}text_hash"), F.col("gone").alias(f"{p}gone"))
    both = docs.withColumn(f"{p}hash", text_order(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}text_hash")), "left")
    kept = F.expr(_let("u", UNITS.format(text_col), f"array_join(transform(array_except(sequence(0, size(u) - 1), `{p}gone`), i -> u[i]), '\\n')"))
    text = F.when(F.col(f"{p}gone").isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    columns = [text if c == text_col else docs[c] for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(F.expr(f"coalesce(`{p}gone`, array())")), F.lit(0)).alias(removed_col))
    return both.select(*columns)


#: The same as without_passages in DuckDB's SQL.
ORACLE = r"""
WITH lines AS (
    SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), ends AS (
    SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR NOT (l[i] = '' AND i > 1 AND l[i + 1] = '' AND i + 1 < len(l))) AS e FROM lines
), units AS MATERIALIZED (
    SELECT r, doc_id, text, list_transform(range(1, len(e) + 1), lambda k: array_to_string(l[(CASE WHEN k > 1 THEN e[k - 1] ELSE 0 END) + 1 : e[k]], chr(10))) AS u FROM ends
), pairs AS (
    SELECT r, doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS t, i AS place, u[i] AS a, u[i + 1] AS b FROM units, unnest(range(1, len(u))) AS p(i) WHERE regexp_matches(u[i], '\S') OR regexp_matches(u[i + 1], '\S')
), firsts AS (
    SELECT a, b, min((coalesce(doc_id, -9223372036854775808), t, place)) AS first FROM pairs GROUP BY a, b
    HAVING min((coalesce(doc_id, -9223372036854775808), t, place)) <> max((coalesce(doc_id, -9223372036854775808), t, place))
), told AS (
    SELECT r, unnest([place, place + 1]) AS line, (coalesce(doc_id, -9223372036854775808), t, place) = first AS own FROM pairs JOIN firsts USING (a, b)
), gone AS (
    SELECT r, list(line) AS gone FROM (SELECT r, line FROM told GROUP BY r, line HAVING NOT bool_or(own)) GROUP BY r
)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(u) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: u[i]), chr(10)) AS text, len(coalesce(gone, [])) AS lines_removed
FROM units LEFT JOIN gone USING (r)
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""

#: The same as without_repeats in DuckDB's SQL.
ORACLE_MODULUS = f"""
WITH lines AS (
    SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), hashes AS (
    SELECT *, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM lines
), ends AS (
    SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (h[i] + 31 * CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END) % {MODULUS} = 0) AS e FROM hashes
), chunks AS (
    SELECT r, doc_id, text, k - 1 AS place, l[(CASE WHEN k > 1 THEN e[k - 1] ELSE 0 END) + 1 : e[k]] AS part FROM ends, unnest(range(1, len(e) + 1)) AS u(k)
), named AS (
    SELECT r, doc_id, text, place, len(part) AS n, array_to_string(part, chr(10)) AS chunk FROM chunks
), marked AS (
    SELECT *, CASE WHEN n > 1 AND regexp_matches(chunk, '\\S')
        THEN dense_rank() OVER (PARTITION BY n > 1, chunk ORDER BY doc_id, md5(text), place) > 1 ELSE FALSE END AS again FROM named
)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT again), '') AS text, count(*) FILTER (again) AS chunks_removed
FROM marked GROUP BY r, doc_id
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""
