"""Collocations of two to five words from a weighted de Bruijn graph, counted for each language.

Texts (A-Z in lower case) are cut into pieces at punctuation and line ends, pieces into words at blanks and tabs. A
node of the graph is a run of four words, an edge a run of five that leads from its first four to its last four; an
edge weighs as often as it occurs. Edges are aggregated from the texts; counts of shorter runs are not, they follow
from the flow of the nodes: a run of k words occurs as often as all runs of k + 1 that begin with it, and as often as
a piece ends with it. So the texts give edges and, for each piece, its last one to four words.

Before that, one pass counts neighbouring words in BUCKETS hashed counters, each a byte that stops at LEAST. Two words
whose counter stays below are in no phrase, and pieces are cut between them; this changes no count of a run that
occurs LEAST times, as none lies across such a cut. Counters are of bounded size: with very many texts more are full
and fewer cuts are made, which costs work and changes no result.

Edges that occur LEAST times are then compacted: where all that leads into a node leaves it by one edge (both weigh
what flows through the node), the edges are one path. Candidates of five words are the edges of the paths. A shorter
candidate goes if a longer one around it occurs as often, which is to say that an edge of the graph of its length
carries all its flow; what lies inside a path is such a node.

Defined results: a null text is empty, a null language `und`. Repeated rows count each. Very long texts are read
whole. A table without phrases that are frequent enough gives no rows. Words are any bytes but blanks, tabs and
breaks; the words and pairs of a task are told apart by 64-bit hashes, all other counting is by the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.llm.byte_words import ByteWords, held_together, table
from segue.llm.common import written
from segue.llm.letters import MIX, mixed

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Counters of neighbouring words, and how many of them are sent as one row.
BUCKETS, SENT = 1 << 25, 1 << 18
#: Bytes of text whose words a task counts at once.
HELD = 12_000_000
#: Groups that are ranked apart before a language is ranked as a whole; edges of a path in one row.
GROUPS, SEGMENT = 64, 1024
BREAKS = table(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
INSIDE = ~(BREAKS | table((0x09, 0x09), (0x20, 0x20)))


class Pieces:
    """Words of texts with their languages: hashes, and whether the next word is in the same piece and language."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        self.words = ByteWords(rows.column(1).combine_chunks(), INSIDE, BREAKS)
        langs = pc.fill_null(rows.column(0), "und").combine_chunks().dictionary_encode()
        self.names = langs.dictionary
        of_text = langs.indices.to_numpy()
        self.lang = np.repeat(of_text, self.words.sizes)
        self.hash = self.words.hashes()
        self.joined = np.zeros(self.hash.size, bool)
        piece = self.words.piece
        self.joined[:-1] = piece[1:] == piece[:-1]
        seeds = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in self.names.to_pylist()], np.uint64) * MIX
        self.seed = seeds[self.lang] if self.hash.size else np.zeros(0, np.uint64)

    def buckets(self, buckets: int) -> np.ndarray:
        """The counter of every word and the one after it, of a power of two of them."""
        own = (mixed(self.hash[:-1] * MIX + self.seed[:-1]) + self.hash[1:]) * MIX
        return (mixed(own) & np.uint64(buckets - 1)).astype(np.int64)


def _pair_counts(batches: Iterator[pa.RecordBatch], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.uint8)
    for held in held_together(batches, 1, HELD):
        pieces = Pieces(held)
        if pieces.hash.size > 1:
            found, n = np.unique(pieces.buckets(buckets)[pieces.joined[:-1]], return_counts=True)
            counts[found] = np.minimum(counts[found] + n, least)
    for at in range(0, buckets, SENT):
        part = counts[at : at + SENT]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at // SENT], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "z"])


def _full(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(z), np.uint8)
            sums[part] = own if part not in sums else np.minimum(sums[part].astype(np.uint16) + own, least).astype(np.uint8)
    for part, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["part", "bits"])


def frequent_pairs(texts: DataFrame, least: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bits of the counters that reach `least`: of BUCKETS counters 4 MB, whatever the texts."""
    counts = texts.mapInArrow(partial(_pair_counts, least=min(least, 255), buckets=buckets), "part int, z binary")
    parts = counts.repartition("part").mapInArrow(partial(_full, least=min(least, 255)), "part int, bits binary").collect()
    bits, sent = np.zeros(buckets // 8, np.uint8), min(SENT, buckets)
    for r in parts:
        bits[r["part"] * sent // 8 : (r["part"] + 1) * sent // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is first, and how often it occurs."""
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def _grams(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    for held in held_together(batches, 1, HELD):
        pieces = Pieces(held)
        size = pieces.hash.size
        if not size:
            continue
        bucket = pieces.buckets(bits.value.size * 8)
        linked = pieces.joined.copy()
        linked[:-1] &= (bits.value[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1
        back, reach = np.zeros(size, np.int64), np.ones(size, bool)  # words before this one in its run, LONGEST - 1 at most
        for _ in range(1, LONGEST):
            reach[1:] = reach[:-1] & linked[:-1]
            reach[0] = False
            back += reach
        for k in range(1, LONGEST + 1):
            # edges end anywhere, shorter runs where a piece does
            last = np.flatnonzero(back == LONGEST - 1) if k == LONGEST else np.flatnonzero((back >= k - 1) & ~linked)
            if not last.size:
                continue
            key = pieces.seed[last].copy()
            for j in range(k - 1, -1, -1):
                key = mixed(key * MIX + pieces.hash[last - j])
            at, n = _counted(key)
            last = last[at]
            all_words = np.concatenate([last - j for j in range(k - 1, -1, -1)])
            _, at, word = np.unique(pieces.hash[all_words], return_index=True, return_inverse=True)
            words = pieces.words.strings(all_words[at])
            parts = [words.take(pa.array(w)) for w in word.reshape(k, -1)]
            gram = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
            lang = pa.DictionaryArray.from_arrays(pa.array(pieces.lang[last]), pieces.names).dictionary_decode()
            for lo in range(0, len(last), 50_000):
                cut = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([lang[cut].cast(pa.string()), pa.array(np.full(len(last[cut]), k, np.int32)), gram[cut].cast(pa.string()), pa.array(n[cut])], names=["lang", "k", "gram", "n"])


def first_words(gram: str = "gram") -> F.Column:
    """All words but the last."""
    return F.expr(f"substring({gram}, 1, length({gram}) - length(substring_index({gram}, ' ', -1)) - 1)")


def last_words(gram: str = "gram") -> F.Column:
    """All words but the first."""
    return F.expr(f"substring({gram}, length(substring_index({gram}, ' ', 1)) + 2)")


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, buckets: int = BUCKETS) -> dict[int, DataFrame]:
    """(lang, gram, n) by number of words: the edges of the graph, and what the flow of its nodes gives for shorter runs.

    Exact for all runs that occur `least` times and for single words; other runs may be counted too low.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(frequent_pairs(texts, least, buckets))
    found = texts.mapInArrow(partial(_grams, bits=bits), "lang string, k int, gram string, n long")
    runs = written(found.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")), "runs")
    of = {LONGEST: runs.where(F.col("k") == LONGEST).select("lang", "gram", "n")}
    for k in range(LONGEST - 1, 0, -1):
        through = of[k + 1].select("lang", first_words().alias("gram"), "n")
        ends = runs.where(F.col("k") == k).select("lang", "gram", "n")
        of[k] = written(through.union(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"runs-{k}")
    return of


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, head, segment, words array<string>, n): the edges (lang, gram, n) with unary paths compacted.

    nodes (lang, gram, n) has the flow of every node. Edges meet in a node that both carry whole. Pointers to the edge
    before are doubled until all lead to the head of their path; a round is a join of written tables. A unary cycle
    cannot be, as every piece begins and ends. Words are those of the path, in segments of SEGMENT edges; a segment
    repeats the last words of the one before, so that its runs of five are the edges.
    """
    into = edges.select("lang", last_words().alias("node"), F.col("gram").alias("before"), "n")
    out = edges.select("lang", first_words().alias("node"), "gram", "n")
    flow = nodes.select("lang", F.col("gram").alias("node"), "n")
    whole = ["lang", "node", "n"]
    met = out.join(flow, whole).join(into, whole).select("lang", "gram", "before")
    step = written(edges.join(met, ["lang", "gram"], "left").select("lang", "gram", F.coalesce("before", "gram").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("before").isNull().alias("done")), "path-steps")
    while not step.where("NOT done").isEmpty():
        ahead = step.select("lang", F.col("gram").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("end"))
        step = written(step.join(ahead, ["lang", "to"]).select("lang", "gram", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("end").alias("done")), "path-steps")
    part = F.expr(f"far div {SEGMENT}")
    rows = edges.join(step, ["lang", "gram"]).select("lang", F.col("to").alias("head"), part.alias("segment"), "far", "gram", "n")
    grouped = rows.groupBy("lang", "head", "segment", "n").agg(F.array_sort(F.collect_list(F.struct("far", "gram"))).alias("e"))
    words = F.concat(F.split(F.col("e")[0]["gram"], " "), F.expr("transform(slice(e, 2, size(e)), x -> substring_index(x.gram, ' ', -1))"))
    return grouped.select("lang", "head", "segment", words.alias("words"), "n")


def path_edges(compacted: DataFrame) -> DataFrame:
    """(lang, gram, n): the edges of paths."""
    runs = F.expr(f"transform(sequence(1, size(words) - {LONGEST - 1}), i -> array_join(slice(words, i, {LONGEST}), ' '))")
    return compacted.select("lang", F.explode(runs).alias("gram"), "n")


def candidates(of: dict[int, DataFrame], least: int = LEAST) -> DataFrame:
    """(lang, phrase, a): runs of two to LONGEST words that occur `least` times, without those whose whole flow a longer one carries."""
    often = {k: rows.where(F.col("n") >= least) for k, rows in of.items()}
    compacted = written(paths(often[LONGEST], often[LONGEST - 1]), "paths")
    found = path_edges(compacted)
    left = found.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    for k in range(LONGEST - 1, 1, -1):
        longer = found if k == LONGEST - 1 else often[k + 1]
        around = longer.select("lang", first_words().alias("gram"), "n").union(longer.select("lang", last_words().alias("gram"), "n"))
        left = left.union(often[k].join(around, ["lang", "gram", "n"], "left_anti").select("lang", "gram", "n"))
    return left


def scored(phrases: DataFrame, of: dict[int, DataFrame], least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the lowest score of all cuts of a phrase, the first of equal ones."""
    totals = of[1].groupBy("lang").agg(F.sum("n").alias("n"))
    parts = of[1].where(F.col("n") >= least)
    for k in range(2, LONGEST):
        parts = parts.union(of[k].where(F.col("n") >= least))
    words = F.split("phrase", " ")
    cut = F.explode(F.expr("sequence(1, size(w) - 1)"))
    cuts = phrases.withColumn("w", words).withColumn("cut", cut).select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("right"))
    known = cuts.join(parts.select("lang", F.col("gram").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("gram").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    # languages may be any strings, so their totals are joined like all else; sizes decide how
    known = known.join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    known = known.withColumn("top", whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("low", whole("l") * whole("r")).withColumn("score", F.expr("top div low"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return known.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, first: int = FIRST, buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of every language by score, count and bytes."""
    of = counts(docs, lang_col, text_col, least, buckets)
    rows = scored(written(candidates(of, least), "phrases"), of, least)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # ranked in groups first, so that the task of a language gets `first` rows of each at most
    apart = rows.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).withColumn("rank", rank("lang", "g")).where(F.col("rank") <= first).drop("g", "rank")
    return apart.withColumn("rank", rank("lang")).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same as collocations in DuckDB's SQL.
ORACLE = rf"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), runs AS MATERIALIZED (
    SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS f FROM pieces, unnest(range(1, {LONGEST + 1})) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i) GROUP BY ALL
), often AS MATERIALIZED (
    SELECT * FROM runs WHERE f >= {LEAST}
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM runs WHERE k = 1 GROUP BY lang
), parts AS (
    SELECT lang, g[i : i + m - 1] AS part, max(f) AS most FROM often, unnest(range(2, k)) AS a(m), unnest(range(1, k - m + 2)) AS b(i) GROUP BY ALL
), chosen AS (
    SELECT o.* FROM often o LEFT JOIN parts p ON o.lang = p.lang AND o.g = p.part WHERE k > 1 AND (most IS NULL OR 100 * most < 100 * f)
), cuts AS (
    SELECT c.lang, c.g, c.f AS a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM chosen c JOIN totals USING (lang), unnest(range(1, c.k)) AS u(cut) JOIN runs x ON x.lang = c.lang AND x.g = c.g[1 : cut] JOIN runs y ON y.lang = c.lang AND y.g = c.g[cut + 1 :]
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS place FROM cuts
), ranked AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {FIRST}
"""
