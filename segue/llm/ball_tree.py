"""Exact ranked lexical search with ball trees over sparse document vectors.

A document is a vector of integers, one for each term of the items at hand that it holds; an item is a vector of the
terms' weights; the score is their inner product. (Terms of no item cannot add to a score, so leaving them out changes
none.) Documents are dealt to the nearest of PIVOTS directions and cut into subtrees of at most SUBTREE documents. A
subtree is a balanced binary tree: a node is split at the median along the line between two far documents. Every node
has a centroid, rounded to whole numbers, and radii around that rounded centroid: terms are in groups (a term belongs
to the pivot where it weighs most), and a node has a radius for each group. By Cauchy-Schwarz in every group no
document below a node scores more than centroid times item plus the sum over groups of radius times the item's norm.
Radii and norms are rounded up, and bounds are raised by more than floating-point sums may lose.

A search reads the written subtrees. First the exact results of one subtree for each pivot give every item a score
that its k-th result reaches at least. Then all subtrees are searched best-first: items whose bound at the root stays
below what they have are done, others read leaves in the order of their bounds until none can reach the k-th result.
Leaves are scored in whole numbers.

Items are dealt into blocks of about ITEM_TERMS terms; one block at a time is sent to the tasks.

Defined results: a null or empty text has no terms; documents without terms do not count; items without terms have no
results, nor have scores of 0. Documents without an id count in all statistics and are no results. Rows of one id are
documents of their own; a repeated item has its results once for each row, under its id. Very long texts are read
whole. An empty table gives no rows. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
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
from segue.llm.letters import grouped

FIRST = 50
#: Terms of the items of a block, repeats over items counted.
ITEM_TERMS = 1 << 18
PIVOTS, SUBTREE, LEAF = 32, 1024, 32
#: Numbers in the matrix of a subtree, one document's at least.
CELLS = 1 << 23
#: Documents, about, whose vectors the pivots are fitted to; they shape the tree, not the results.
SAMPLE = 2048
#: Bytes of text whose words a task holds.
HELD = 4_000_000
SALTS = 1024
#: Components of a centroid that are kept; smaller ones count as 0, and as distance.
LEAST_PART = 512
INSIDE = ~table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Parts of the score that are fixed: what a term's count is multiplied by, and its saturation.
TOP, COUNT, LENGTH = 1_000_000_000, 1000, 20


class Items:
    """A block of items: the hashes of all their terms in order, and each item's terms as places among them."""

    def __init__(self, texts: list[str | None]):
        words = ByteWords(pa.array(texts, pa.string()), INSIDE)
        hashes = words.hashes()
        self.hashes, term = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), words.sizes)
        pairs = np.unique(owner * (self.hashes.size + 1) + term)
        self.owner, self.terms = pairs // (self.hashes.size + 1), pairs % (self.hashes.size + 1)


def _vectors(batches: Iterator[pa.RecordBatch], hashes) -> Iterator[pa.RecordBatch]:
    known = hashes.value
    for held in held_together(batches, 1, HELD):
        rows = pa.Table.from_batches(held)
        words = ByteWords(rows.column(1).combine_chunks(), INSIDE)
        found = words.hashes()
        term = np.minimum(np.searchsorted(known, found), max(known.size - 1, 0))
        hit = np.flatnonzero(known[term] == found) if known.size else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(words.sizes.size), words.sizes)[hit]
        order, begin = grouped(owner, term[hit])
        picked = hit[order[begin]]
        times = np.diff(np.append(begin, order.size))
        ends = np.searchsorted(owner[order[begin]], np.arange(words.sizes.size + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term[picked], times)]
        yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks(), pa.array(words.sizes.astype(np.int64)), *lists], names=["id", "n", "terms", "times"])


def vectors(docs: DataFrame, hashes, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms array<int>, times array<int>): of documents with terms, how many, and how often they hold those of the items."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(partial(_vectors, hashes=hashes), "id long, n long, terms array<int>, times array<int>")
    return written(found.where("n > 0"), "lexical-vectors")


class Corpus:
    """What scores need besides a document: numbers of documents and terms, and the weights of the items' terms."""

    def __init__(self, docs: int, terms: int, holders: np.ndarray):
        self.docs, self.terms = docs, terms
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in holders.tolist()], np.int64)

    def parts(self, sizes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What a term that occurs `times` times adds, for a weight of 1, in documents of so many terms."""
        m = 50 + (50 * sizes * self.docs) // self.terms
        return (TOP * times) // (COUNT * times + LENGTH * m)


def statistics(rows: DataFrame, terms: int) -> Corpus:
    """From all documents; the driver gets a number for each term of the items."""
    docs, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holders[r["term"]] = r["count"]
    return Corpus(docs, words, holders)


class Layout:
    """The directions that documents are dealt to, and the groups of terms, from a sample of vectors."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], terms: int, pivots: int):
        self.pivots = np.zeros((terms, 1), np.float32)
        self.group = np.zeros(terms, np.int32)
        if not sample:
            return
        used = np.unique(np.concatenate([t for t, _ in sample]))
        dense = np.zeros((len(sample), used.size), np.float32)
        for i, (t, v) in enumerate(sample):
            dense[i, np.searchsorted(used, t)] = v
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
        ways = dense[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)]
        for _ in range(5):
            near = (dense @ ways.T).argmax(axis=1)
            sums = np.zeros_like(ways)
            np.add.at(sums, near, dense)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            ways = np.where(size > 0, sums / np.maximum(size, 1e-9), ways)
        self.pivots = np.zeros((terms, len(ways)), np.float32)
        self.pivots[used] = ways.T
        self.group[used] = ways.argmax(axis=0)

    @property
    def groups(self) -> int:
        return self.pivots.shape[1]


def _dealt(batches: Iterator[pa.RecordBatch], corpus, layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())]).astype(np.int64)
        terms, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
        parts = corpus.value.parts(np.repeat(batch.column(1).to_numpy(), np.diff(ends)), times)
        pivots = layout.value.pivots
        pivot = np.zeros(batch.num_rows, np.int32)
        step = max(1, 4_000_000 // max(1, pivots.shape[1] * 64))
        for lo in range(0, batch.num_rows, step):
            hi = min(lo + step, batch.num_rows)
            a, b = ends[lo], ends[hi]
            if b > a:
                some = np.flatnonzero(np.diff(ends[lo : hi + 1])) + lo
                sums = np.add.reduceat(pivots[terms[a:b]] * parts[a:b, None].astype(np.float32), ends[some] - a, axis=0)
                pivot[some] = sums.argmax(axis=1)
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (terms, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(pivot), batch.column(4), batch.column(0), *lists], names=["pivot", "row", "id", "terms", "parts"])


class Tree:
    """A balanced tree over documents (rows of a matrix of parts, by the terms that any of them holds)."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, parts: np.ndarray, group: np.ndarray):
        self.used, column = np.unique(terms, return_inverse=True)
        by_group = np.argsort(group[self.used], kind="stable")
        self.used = self.used[by_group]
        place = np.empty(by_group.size, np.int64)
        place[by_group] = np.arange(by_group.size)
        n = ends.size - 1
        self.dense = np.zeros((n, self.used.size), np.float64)
        self.dense[np.repeat(np.arange(n), np.diff(ends)), place[column]] = parts
        self.order = np.arange(n)
        self.nodes: list[tuple[int, int]] = []  # first and last place of a node's documents; node i has the children 2 i + 1, 2 i + 2
        level = [(0, n)]
        while level:
            self.nodes += level
            if max(hi - lo for lo, hi in level) <= LEAF:
                break
            level = [half for lo, hi in level for half in self._halves(lo, hi)]

    def _halves(self, lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]]:
        own = self.order[lo:hi]
        rows = self.dense[own]
        far = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
        self.order[lo:hi] = own[np.argsort(rows @ (other - far), kind="stable")]
        middle = (lo + hi + 1) // 2
        return (lo, middle), (middle, hi)

    def balls(self, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every node the rounded centroid and the radii by group, in whole numbers that are not too small."""
        centres = np.zeros((len(self.nodes), self.used.size), np.int64)
        radii = np.zeros((len(self.nodes), groups), np.int64)
        own = group[self.used]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if own.size else np.zeros(0, np.int64)
        for i, (lo, hi) in enumerate(self.nodes):
            if not own.size or hi <= lo:
                continue
            rows = self.dense[self.order[lo:hi]]
            centre = np.rint(rows.mean(axis=0))
            centre[centre < LEAST_PART] = 0
            far = np.sqrt(np.add.reduceat((rows - centre) ** 2, begin, axis=1).max(axis=0))
            centres[i], radii[i, own[begin]] = centre, np.ceil(far * (1 + 1e-9))
        return centres, radii


#: A written subtree: its documents in the order of its leaves with their vectors, and its nodes with centroids (sparse) and radii.
SUBTREES = "pivot int, first long, ids array<long>, ends array<int>, terms array<int>, parts array<int>, node_ends array<int>, node_terms array<int>, node_parts array<int>, radii array<int>"


def _subtree(rows: pa.Table, group: np.ndarray, groups: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    sizes = pc.list_value_length(rows.column("terms")).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    terms, parts = (np.concatenate([c.flatten().to_numpy() for c in rows.column(x).chunks]) for x in ("terms", "parts"))
    tree = Tree(ends, terms, parts, group)
    centres, radii = tree.balls(group, groups)
    node, column = np.nonzero(centres)
    sizes = sizes[tree.order]
    picked = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in tree.order]) if terms.size else np.zeros(0, np.int64)
    lists = [rows.column("id").to_numpy()[tree.order], np.concatenate([[0], np.cumsum(sizes)]), terms[picked], parts[picked], np.searchsorted(node, np.arange(len(tree.nodes) + 1)), tree.used[column], centres[node, column], radii.ravel()]
    kinds = [pa.int64(), *[pa.int32()] * 7]
    columns = [pa.array([rows.column("pivot")[0].as_py()], pa.int32()), pa.array([rows.column("row")[0].as_py()], pa.int64())]
    columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(k.to_pandas_dtype()))) for x, k in zip(lists, kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUBTREES.split(", ")])


def _built(batches: Iterator[pa.RecordBatch], layout) -> Iterator[pa.RecordBatch]:
    """Rows come by pivot; a subtree is as many of them as SUBTREE and CELLS allow."""
    held, n, size, pivot = [], 0, 0, None
    width = layout.value.group.size
    made = lambda: _subtree(pa.Table.from_batches(held), layout.value.group, layout.value.groups)
    for batch in batches:
        own, sizes = batch.column(0).to_numpy(), np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            last = int(np.searchsorted(own[at:], own[at], "right")) if n == 0 or own[at] == pivot else 0
            many = np.arange(n + 1, n + 1 + last)
            fits = (many <= SUBTREE) & (many * np.minimum(size + sizes[at : at + last] - before, width) <= CELLS)
            to = at + (last if fits.all() else int(fits.argmin()))
            if to == at and n:
                yield made()
                held, n, size = [], 0, 0
                continue
            to = max(to, at + 1)
            pivot = own[at]
            held.append(batch.slice(at, to - at))
            n, size = n + to - at, size + int(sizes[to - 1]) - before
            at = to
    if held:
        yield made()


def index(rows: DataFrame, corpus, layout) -> DataFrame:
    """The written subtrees of all documents (id, n, terms, times) that have an id and a term of the items."""
    own = rows.withColumn("row", F.monotonically_increasing_id()).where("id IS NOT NULL AND size(terms) > 0")
    dealt = own.select("id", "n", "terms", "times", "row").mapInArrow(partial(_dealt, corpus=corpus, layout=layout), "pivot int, row long, id long, terms array<int>, parts array<int>")
    # a pivot's documents go to many tasks; rows of one id are dealt by their rows
    sent = dealt.repartition("pivot", F.pmod(F.xxhash64("row"), F.lit(SALTS))).sortWithinPartitions("pivot", "row")
    return written(sent.mapInArrow(partial(_built, layout=layout), SUBTREES), "lexical-index")


class Asked:
    """Items of a block for a search: terms with weights above 0, norms by group, and scores that results must reach."""

    def __init__(self, items: Items, corpus: Corpus, layout: Layout, k: int):
        weight = corpus.weights[items.terms]
        use = weight > 0
        self.k, self.n = k, int(items.owner.max()) + 1 if items.owner.size else 0
        self.owner, self.terms, self.weight = items.owner[use], items.terms[use], weight[use]
        squares = np.zeros((self.n, layout.groups))
        np.add.at(squares, (self.owner, layout.group[self.terms]), self.weight.astype(np.float64) ** 2)
        self.norms = np.ceil(np.sqrt(squares) * (1 + 1e-9))
        self.least = np.ones(self.n, np.int64)
        sums = np.zeros(self.n)
        np.add.at(sums, self.owner, self.weight.astype(np.float64))
        #: products of whole numbers below 2**53 are exact in doubles
        self.kind = np.float64 if not self.n or sums.max() * (TOP // COUNT) < 2.0**52 else np.int64


class Search:
    """The best documents of every item in the subtrees seen so far."""

    def __init__(self, asked: Asked, groups: int):
        self.asked, self.groups = asked, groups
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(asked.n)]
        self.read = 0

    def needed(self, item: int) -> int:
        """The score that a document must reach; with an equal one it may still come first by its id."""
        own = self.best[item]
        return max(int(self.asked.least[item]), own[0][0]) if len(own) == self.asked.k else int(self.asked.least[item])

    def subtree(self, ids, ends, terms, parts, node_ends, node_terms, node_parts, radii) -> None:
        asked = self.asked
        used, column = np.unique(terms, return_inverse=True)
        at = np.minimum(np.searchsorted(used, asked.terms), max(used.size - 1, 0))
        here = np.flatnonzero(used[at] == asked.terms) if used.size else np.zeros(0, np.int64)
        if not here.size:
            return
        owner, at, weight = asked.owner[here], at[here], asked.weight[here]
        items, begin = np.unique(owner, return_index=True)
        nodes = node_ends.size - 1
        centres = np.zeros((used.size, nodes))
        centres[np.searchsorted(used, node_terms), np.repeat(np.arange(nodes), np.diff(node_ends))] = node_parts
        radii = radii.reshape(nodes, self.groups).astype(np.float64)
        bounds = np.empty((items.size, nodes))
        step = max(1, 4_000_000 // nodes)
        cuts = np.append(begin, owner.size)
        lo = 0
        while lo < items.size:  # as many items as the products of their terms fit
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + step, "right")) - 1)
            part = slice(cuts[lo], cuts[hi])
            bounds[lo:hi] = np.add.reduceat(centres[at[part]] * weight[part, None], begin[lo:hi] - cuts[lo], axis=0)
            lo = hi
        bounds += asked.norms[items] @ radii.T
        bounds += 1 + 1e-9 * bounds
        for node in range(1, nodes):  # what bounds a node bounds all below it
            np.minimum(bounds[:, node], bounds[:, (node - 1) // 2], out=bounds[:, node])
        first = (nodes + 1) // 2 - 1
        spans = [(0, ids.size)]
        while len(spans) < nodes - first:
            spans = [half for lo, hi in spans for half in ((lo, (lo + hi + 1) // 2), ((lo + hi + 1) // 2, hi))]
        dense = None
        for i, item in enumerate(items.tolist()):
            if bounds[i, 0] < self.needed(item):
                continue
            own = slice(cuts[i], cuts[i + 1])
            for leaf in np.argsort(-bounds[i, first:], kind="stable").tolist():
                if bounds[i, first + leaf] < self.needed(item):
                    break
                if dense is None:
                    dense = np.zeros((ids.size, used.size), asked.kind)
                    dense[np.repeat(np.arange(ids.size), np.diff(ends)), column] = parts
                lo, hi = spans[leaf]
                self.read += hi - lo
                self._leaf(item, ids[lo:hi], dense[lo:hi, at[own]] @ weight[own].astype(asked.kind))

    def _leaf(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        best = self.best[item]
        for j in np.flatnonzero(scores >= self.needed(item)).tolist():
            own = (int(scores[j]), -int(ids[j]))
            if len(best) < self.asked.k:
                heapq.heappush(best, own)
            elif own > best[0]:
                heapq.heapreplace(best, own)


def _searched(batches: Iterator[pa.RecordBatch], asked, groups: int) -> Iterator[pa.RecordBatch]:
    search = Search(asked.value, groups)
    for batch in batches:
        for row in range(batch.num_rows):
            search.subtree(*(c[row].values.to_numpy() for c in batch.columns))
    rows = [(item, -minus, score) for item, best in enumerate(search.best) for score, minus in best]
    item, ids, score = ([x[i] for x in rows] for i in range(3))
    read = [search.read if i == 0 else 0 for i in range(len(rows))]
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(read, pa.int64())], names=["item", "doc_id", "score", "read"])


def _search(subtrees: DataFrame, asked: Asked, groups: int) -> DataFrame:
    """(item, rank, doc_id, score, read): the k best documents of every item; `read` adds up to the documents scored."""
    sent = subtrees.sparkSession.sparkContext.broadcast(asked)
    found = subtrees.select("ids", "ends", "terms", "parts", "node_ends", "node_terms", "node_parts", "radii").mapInArrow(partial(_searched, asked=sent, groups=groups), "item int, doc_id long, score long, read long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= asked.k)


def search_block(docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, rank, doc_id, score) for a block of items; None if nothing can be found."""
    context = docs.sparkSession.sparkContext
    rows = vectors(docs, context.broadcast(items.hashes), id_col, text_col)
    corpus = statistics(rows, items.hashes.size)
    if not corpus.terms or not items.terms.size:
        return None
    # by a hash of the row, so that copies do not come together; about SAMPLE rows, however many tasks there are
    drawn = rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(corpus.docs, SAMPLE))) < SAMPLE).where("size(terms) > 0").select("n", "terms", "times").collect()
    sample = [(np.array(r["terms"]), corpus.parts(np.full(len(r["terms"]), r["n"]), np.array(r["times"], np.int64))) for r in drawn]
    layout = Layout(sample, items.hashes.size, PIVOTS)
    subtrees = index(rows, context.broadcast(corpus), context.broadcast(layout))
    asked = Asked(items, corpus, layout, k)
    firsts = [r["first"] for r in subtrees.groupBy("pivot").agg(F.min("first").alias("first")).collect()]
    for r in _search(subtrees.where(F.col("first").isin(firsts)), asked, layout.groups).where(F.col("rank") == k).collect():
        asked.least[r["item"]] = max(1, r["score"])
    return written(_search(subtrees, asked, layout.groups).select("item", "rank", "doc_id", "score"), "lexical-results")


def ranked(docs: DataFrame, items: DataFrame, k: int = FIRST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, by score, then id."""
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    # a term takes two bytes at least, with what parts it from the next
    total = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (2 * item_terms)))
    found = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        ids = block.column("item_id").to_pylist()
        best = search_block(docs, Items(block.column("t").to_pylist()), k, id_col, text_col)
        if best is not None:
            named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema[item_col].dataType.simpleString()}")
            best = named.join(best, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            found = best if found is None else found.union(best)
    kind = items.schema[item_col].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


#: The same as ranked in DuckDB's SQL.
ORACLE = rf"""
WITH cut AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), docs AS MATERIALIZED (
    SELECT row, doc_id, t, len(t)::BIGINT AS n FROM cut WHERE len(t) > 0
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM docs
), held AS MATERIALIZED (
    SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY row, term
), holders AS (
    SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term
), items AS (
    SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), asked AS (
    SELECT item, item_id, term, floor(1000 * ln((2 * corpus.docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT item, item_id, unnest(t) AS term FROM items) JOIN holders USING (term), corpus
), scores AS (
    SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * corpus.docs) // words))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN (SELECT row, doc_id, n FROM docs) USING (row), corpus WHERE doc_id IS NOT NULL GROUP BY ALL
), best AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {FIRST}
"""
