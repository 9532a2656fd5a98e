"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles (runs of five words, in lower case). A shingle weighs its count times
the mean IDF of its words, 1 + ln(documents / documents with the word), which rises no further below a RARE share of
all documents. Improved consistent weighted sampling draws BANDS x ROWS samples; two documents agree in a sample with
a probability equal to their weighted Jaccard similarity, and are compared if they agree in all samples of a band.
What is compared is verified by the exact similarity of the whole texts.

Equal texts are one node from the start. Buckets are compared as `components.bucket_classes` says: no link of the
bands is lost, no task holds a whole bucket. Classes are connected components.

Defined results: a null text counts as the empty text; texts without words only match equal texts; a text of fewer
than five words has one shingle. Rows without an id are compared like others; a class that has no id at all has a null
class_id. Rows of one id are one document. An empty table gives no rows. Columns other than id and text are not read.
Ids of 2**62 and above are kept for rows without one and are not supported.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.bpe import joined
from segue.llm.common import filter_words, may_be_held, spare_prefix, text_of, written
from segue.llm.components import bucket_classes, first_shared
from segue.llm.letters import MIX, Words, chunks, grouped, mixed

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares a band with probability 0.9992.
BANDS, ROWS = 10, 3
#: Share of documents below which a word's IDF rises no further.
RARE = 1e-3
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
SEED = 77
#: Nodes of texts that have no id start here.
NAMELESS = 1 << 62


def split(text: str) -> list[str]:
    return text.lower().split()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in order, and how many each text has."""
    words = Words(texts)
    return words.hashes(), words.sizes


class Shingles:
    """Shingles and weights of texts, by a table of the hashes and IDF of words that are not rare."""

    def __init__(self, hashes: np.ndarray | None = None, idf: np.ndarray | None = None, rarest: float = 1.0):
        self.hashes, self.idf, self.rarest = np.zeros(0, np.uint64) if hashes is None else hashes, idf, rarest

    def weights(self, words: np.ndarray) -> np.ndarray:
        if not self.hashes.size:
            return np.full(words.size, self.rarest)
        at = np.minimum(np.searchsorted(self.hashes, words), self.hashes.size - 1)
        return np.where(self.hashes[at] == words, self.idf[at], self.rarest)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (ascending in each text) and weights of the distinct shingles of every text, and how many each has."""
        words, sizes = word_hashes(texts)
        if not words.size:
            return words, np.zeros(0), sizes
        idf = self.weights(words)
        width = np.minimum(WORDS, sizes)
        many = np.where(sizes > 0, sizes - width + 1, 0)
        owner = np.repeat(np.arange(sizes.size), many)
        first = joined(np.arange(words.size), np.cumsum(sizes) - sizes, many)
        hashes, weight = np.zeros(first.size, np.uint64), np.zeros(first.size)
        own_width = width[owner]
        for i in range(WORDS):
            if i and own_width.min() <= i:  # short texts have short shingles
                longer = np.flatnonzero(own_width > i)
                hashes[longer] = hashes[longer] * MIX + words[first[longer] + i]
                weight[longer] += idf[first[longer] + i]
            else:
                hashes = hashes * MIX + words[first + i]
                weight += idf[first + i]
        hashes, weight = mixed(hashes), weight / own_width
        order, begin = grouped(owner, hashes)
        counts = np.diff(np.append(begin, order.size))
        picked = order[begin]
        return hashes[picked], counts * weight[picked], np.bincount(owner[picked], minlength=sizes.size)


class Sampler:
    """Improved consistent weighted sampling: r and c from Gamma(2, 1), beta uniform, all by the hash of the element.

    Quantiles of the distributions are tabled; which ones an element takes is read from different bits of its hash.
    """

    C_BITS, R_BITS = 18, 14

    def __init__(self, samples: int = BANDS * ROWS):
        rng = np.random.default_rng(SEED)
        self.r = self._gamma(self.R_BITS)
        self.inverse = (1 / self.r).astype(np.float32)
        self.c = np.log(self._gamma(self.C_BITS)).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def _gamma(bits: int) -> np.ndarray:
        """The quantiles (i + 1/2) / 2**bits of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), by bisection."""
        wanted = (np.arange(1 << bits) + 0.5) / (1 << bits)
        low, high = np.zeros(wanted.size), np.full(wanted.size, 64.0)
        for _ in range(60):
            middle = (low + high) / 2
            under = -np.expm1(-middle) - middle * np.exp(-middle) < wanted
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        return high.astype(np.float32)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each set, of sizes elements of the joined hashes, one number for every sample. No set may be empty."""
        starts = np.cumsum(sizes) - sizes
        log_weight = np.log(weights).astype(np.float32)
        out = np.zeros((sizes.size, self.odd.size), np.uint64)
        for k, odd in enumerate(self.odd):
            x = hashes * odd
            at = (x >> np.uint64(32)).astype(np.int64) & ((1 << self.R_BITS) - 1)
            beta = (x >> np.uint64(16)).astype(np.uint16).astype(np.float32) * np.float32(2.0**-16)
            r = self.r[at]
            t = np.floor(log_weight * self.inverse[at] + beta)
            key = self.c[(x >> np.uint64(64 - self.C_BITS)).astype(np.int64)] - r * (t - beta + np.float32(1))
            hits = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, starts), sizes))
            first = hits[np.searchsorted(hits, starts)]
            out[:, k] = mixed(hashes[first] + t[first].astype(np.int64).astype(np.uint64) * MIX)
        return out

    def bands(self, hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        found = self.samples(hashes, weights, sizes).reshape(sizes.size, BANDS, ROWS)
        key = np.zeros((sizes.size, BANDS), np.uint64)
        for i in range(ROWS):
            key = mixed(key * MIX + found[:, :, i])
        return key


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, as far as counted; how many documents there are, without a word."""
    held, size, docs = [], 0, 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([w for w, _ in held])
        values, where = np.unique(words, return_inverse=True)
        return values, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    for chunk in chunks(batches, 0):
        docs += chunk.num_rows
        words, sizes = word_hashes(chunk.column(0).to_pylist())
        if not words.size:
            continue
        order, begin = grouped(np.repeat(np.arange(sizes.size), sizes), words)
        held.append(np.unique(words[order[begin]], return_counts=True))
        size += held[-1][0].size
        if size > 3 * HELD_WORDS:
            held = [summed()]
            size = held[0][0].size
            if size > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0][0].view(np.int64), held[0][1])], names=["word", "n"])
                held, size = [], 0
    if held:
        values, counts = summed()
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["word", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64())], names=["word", "n"])


def word_idf(texts: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes, ascending, and IDF of the words in more than a RARE share of all documents; the IDF of all others.

    These are at most the mean number of a document's distinct words / RARE, whatever the number of documents.
    """
    counts = written(texts.select(text_of(text_col).alias("t")).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    docs = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    least = max(docs * RARE, 1.0)
    table = counts.where("word is not null").where(F.col("n") > least).toArrow()
    hashes = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    share = np.minimum(table.column("n").to_numpy() / max(1, docs), 1.0)
    return hashes[order], (1.0 - np.log(share))[order], 1.0 + math.log(max(1.0, docs / least))


def _signed(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    shingles, sampler = Shingles(*table.value), Sampler()
    for chunk in chunks(batches, 2):
        hashes, weights, sizes = shingles.of(chunk.column(2).to_pylist())
        keys: list = [None] * chunk.num_rows
        if hashes.size:
            full = np.flatnonzero(sizes)
            for i, row in zip(full.tolist(), sampler.bands(hashes, weights, sizes[full]).view(np.int64)):
                keys[i] = row
        yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["id", "same", "bands"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, 1):
        packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in chunk.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(packed, pa.binary())], names=["node", "z"])


def _compared(batches: Iterator[pa.RecordBatch], table, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (task, band, side, node, class, bands, packed text) come by task and side; side 0 is held, side 1 compared with it."""
    shingles = Shingles(*table.value)
    task, held, index = None, [], None
    left, right = [], []

    def build():
        sizes = np.array([h.size for _, _, _, h, _ in held], np.int64)
        hashes = np.concatenate([h for *_, h, _ in held])
        order = np.argsort(hashes, kind="stable")
        weights = np.concatenate([w for *_, w in held])
        owner = np.repeat(np.arange(sizes.size), sizes)
        sums = np.array([w.sum() for *_, w in held])
        return hashes[order], weights[order], owner[order], sums, np.array([c for _, c, *_ in held]), np.array([b for _, _, b, *_ in held], np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            part = batch.slice(at, 32)
            texts = [zlib.decompress(z).decode("utf-8", "surrogatepass") for z in part.column(6).to_pylist()]
            every, every_weight, sizes = shingles.of(texts)
            ends = np.cumsum(sizes)
            for (now, band, side, node, own, bands), end, size in zip(zip(*(c.to_pylist() for c in part.columns[:6])), ends, sizes):
                if now != task:
                    task, held, index = now, [], None
                hashes, weights = every[end - size : end], every_weight[end - size : end]
                if side == 0:
                    held.append((node, own, bands, hashes, weights))
                    continue
                if not held:
                    continue
                index = index or build()
                known, known_weights, owner, sums, classes, their = index
                wanted = (classes != own) & first_shared(their, bands, band)
                if not wanted.any():
                    continue
                lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
                place = joined(np.arange(known.size), lo, hi - lo)
                common = np.bincount(owner[place], np.minimum(known_weights[place], np.repeat(weights, hi - lo)), len(held))
                alike = wanted & (common >= (similarity - 1e-9) * (sums + weights.sum() - common))
                for i in np.flatnonzero(alike).tolist():
                    left.append(held[i][0])
                    right.append(node)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left, right = [], []


def _nameless(text: Column | str) -> Column:
    """The node of a text that no row with an id has."""
    return F.lit(NAMELESS) + F.xxhash64(F.sha1(text)).bitwiseAND(F.lit(NAMELESS - 1))


def _node_texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, z): the packed texts of nodes, from rows (node, t, named).

    Most texts are compared with no other: a filter of bounded size keeps them out of the shuffle, the join is exact.
    """
    words = filter_words(nodes.select(F.xxhash64("node").alias("h")), "h")
    wanted = may_be_held(rows.withColumn("h", F.xxhash64("node")), "h", words)
    packed = lambda named: wanted.where(F.col("named") == named).select("node", "t").mapInArrow(_zipped, "node long, z binary").join(nodes, "node", "left_semi")
    return packed(True).union(packed(False).groupBy("node").agg(F.min("z").alias("z")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id): every document with the smallest id of its class."""
    return _classed(docs, id_col, text_col, similarity).select(F.col("id").alias(id_col), F.when(F.col("component") < NAMELESS, F.col("component")).alias("class_id"))


def _classed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, node, component) of every row; rows without an id have the nodes of their texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    table = spark.sparkContext.broadcast(word_idf(rows, "t"))  # its size has a bound, see word_idf
    signed = written(rows.select("id", F.unhex(F.sha1("t")).alias("same"), "t").mapInArrow(partial(_signed, table=table), "id long, same binary, bands array<long>"), "signatures")
    nameless = F.lit(NAMELESS) + F.xxhash64(F.lower(F.hex("same"))).bitwiseAND(F.lit(NAMELESS - 1))
    reps = written(signed.groupBy("same").agg(F.min("id").alias("node"), F.max("bands").alias("bands")).withColumn("node", F.coalesce("node", nameless)), "texts")
    named_nodes = written(signed.select("id", "same").join(reps.select("same", "node"), "same").select("id", "node"), "nodes-by-id")
    several = named_nodes.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    one_id = named_nodes.join(several, "id").select("a", F.col("node").alias("b"))
    every_node = reps.select("node").distinct()

    known = rows.select(F.coalesce("id", _nameless("t")).alias("node"), "t", F.col("id").isNotNull().alias("named"))
    compared = partial(_compared, table=table, similarity=similarity)
    classes = bucket_classes(reps.where("bands is not null"), every_node, lambda nodes: _node_texts(known, nodes), compared, one_id)
    return named_nodes.join(classes, "node").select("id", "node", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each class the document with the smallest id, or one without an id if none has one."""
    p = spare_prefix(docs)
    node = F.coalesce(F.col(id_col).cast("long"), _nameless(text_of(text_col)))
    kept = _classed(docs, id_col, text_col, similarity).where(F.coalesce("id", "node") == F.col("component")).select(F.col("component").alias(f"{p}kept")).distinct()
    stay = docs.withColumn(f"{p}node", node)
    return stay.join(kept, F.col(f"{p}node") == F.col(f"{p}kept"), "left_semi").dropDuplicates([f"{p}node"]).select(*docs.columns)
