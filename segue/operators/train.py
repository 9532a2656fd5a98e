"""Item embeddings: skip-gram with negative sampling over a grid of blocks of items, and MLlib's skip-gram.

The grid: items are dealt into blocks by a hash. A cell is a block of centers with a block of contexts; a task trains
one cell, with the vectors of both blocks and the pairs between them. A turn trains a diagonal of cells, another
one each time, so that no two of its tasks change the same vector; an epoch has as many turns as there are blocks.
There are at least as many blocks as the cluster has cores, unless cells would be small, and as many as keep a cell's
vectors and pairs within bounds.

Negatives come from all items, whatever the blocks: of a center's draws, as many fall into a block as a binomial with
the block's share of the distribution says, and there on its items by their own shares. So a cell draws its own, and
no table of all items is needed anywhere.

A task reads its pairs and vectors from files, through pyarrow.fs, so the shared folder has to be in a store that it opens.
Vectors are trained in single precision, as both original trainers do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions.vectors import learning_rate, normalized
from segue.operators.corpus import occurrence_counts, sampling_distribution
from segue.operators.pairs import drawn_windows, sampled_pairs
from segue.operators.ranking import with_index
from segue.sources.stored import new_path, read_folder, remove, written

#: Pairs of a gradient step; items of a block at most; pairs of a cell at most, and at least where cores are to spare.
BLOCK, BLOCK_ITEMS, CELL_MOST, CELL_LEAST = 64, 200_000, 2_000_000, 20_000
#: Changes of one vector that a step adds up at most; up to how many are added side by side for all vectors.
STEPS, FEW = 16, 8
#: Pairs that a task holds before it deals them to their cells; items of a row of vectors.
HELD, ROW_ITEMS = 1_000_000, 4096
#: Fixed value: the rate that training ends with.
LAST_RATE = 0.0001


# The defaults of both trainers.
@dataclass(frozen=True)
class Config:
    vector_size: int = 64
    window: int = 5
    negative: int = 5
    min_count: int = 2
    epochs: int = 5
    learning_rate: float = 0.025
    max_pairs: int = 2000
    sample: float = 1e-3
    seed: int = 42
    #: Tasks of the MLlib trainer and blocks of word2vec_vectors; None: by the cluster's cores and, of blocks, by items and pairs.
    partitions: int | None = None


def word2vec(lists: DataFrame, config: Config = Config(), column: str = "uris"):
    """A fitted MLlib model over lists of uris, whose vocabulary and vectors the driver holds; word2vec_vectors has no such bound."""
    from pyspark.ml.feature import Word2Vec

    longest = lists.agg(F.max(F.size(column))).first()[0] or 1  # MLlib would cut a longer list
    tasks = config.partitions or lists.sparkSession.sparkContext.defaultParallelism
    trainer = Word2Vec(vectorSize=config.vector_size, windowSize=config.window, minCount=config.min_count, maxIter=config.epochs, stepSize=config.learning_rate, seed=config.seed, numPartitions=tasks, inputCol=column, outputCol="mean", maxSentenceLength=longest)
    return trainer.fit(lists)


def _summed(target: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """Adds a change to rows of target. Rows that repeat add up, to as much as STEPS of them at most, as steps taken one
    after another would turn back."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    many = np.diff(np.append(first, ordered.size))
    total = change[order[first]]
    # few rows repeat, and most of these a few times
    often = np.flatnonzero(many > FEW)
    for i in often.tolist():
        total[i] = change[order[first[i] : first[i] + many[i]]].sum(axis=0) * min(1.0, STEPS / many[i])
    for k in range(1, FEW):
        more = np.flatnonzero((many > k) & (many <= FEW))
        if not more.size:
            break
        total[more] += change[order[first[more] + k]]
    target[ordered[first]] += total


def labelled_step(vectors: np.ndarray, contexts: np.ndarray, center: np.ndarray, target: np.ndarray, label: np.ndarray, rate: float) -> float:
    """One gradient step over labelled pairs; repeated items add up. The sum of losses before the step."""
    v, u = vectors.take(center, axis=0), contexts.take(target, axis=0)
    score = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", v, u), -30, 30).astype(np.float64)))
    slope = (rate * (label - score)).astype(v.dtype)[:, None]
    u *= slope
    v *= slope
    _summed(vectors, center, u)
    _summed(contexts, target, v)
    return float(-np.log(np.where(label > 0, score, 1 - score) + 1e-7).sum())


def sgns_step(vectors: np.ndarray, contexts: np.ndarray, center: np.ndarray, context: np.ndarray, negatives: np.ndarray, rate: float) -> float:
    """One gradient step over pairs and the negatives of each. The mean loss of a pair before the step."""
    targets = np.concatenate([context[:, None], negatives], axis=1)
    label = np.zeros(targets.shape)
    label[:, 0] = 1
    return labelled_step(vectors, contexts, np.repeat(center, targets.shape[1]), targets.ravel(), label.ravel(), rate) / len(center)


#: What a turn writes, by kind and block: center vectors, context vectors, the loss.
CENTERS, CONTEXTS, LOSS = range(3)
_ROWS = "kind int, b int, part int, v binary, loss double, pairs long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers (splitmix64)."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_of(idx: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed(idx) % np.uint64(blocks)).astype(np.int32)


def first_vectors(idx: np.ndarray, size: int, seed: int) -> np.ndarray:
    """What training starts from: numbers within half of 1 / size around 0, by a hash of each item and place."""
    drawn = _mixed(_mixed(idx.astype(np.uint64) + np.uint64(1))[:, None] + _mixed(np.arange(1, size + 1) + (seed << 32)))
    return (((drawn >> np.uint64(11)) / 2.0**53 - 0.5) / size).astype(np.float32)


@dataclass(frozen=True)
class _Grid:
    """Where the tables of a training are, each in folders by block or cell, and what its tasks have to know."""

    items: str
    blocks: int
    config: Config

    def block(self, b: int, vectors: str | None = None, kind: int = CENTERS) -> _Block | None:
        rows = read_folder(f"{self.items}/b={b}", "idx", "p")
        if rows is None:
            return None
        idx = rows.column("idx").to_numpy()
        order = np.argsort(idx, kind="stable")
        idx, size = idx[order], self.config.vector_size
        if vectors is None:
            first = first_vectors(idx, size, self.config.seed) if kind == CENTERS else np.zeros((idx.size, size), np.float32)
        else:
            first = np.frombuffer(_joined(f"{vectors}/kind={kind}/b={b}"), np.float32).reshape(idx.size, size).copy()
        return _Block(idx, first, rows.column("p").to_numpy()[order])


def _joined(path: str) -> bytes:
    """The bytes of a folder's rows (part, v) in order."""
    rows = read_folder(path, "part", "v")
    return b"".join(rows.sort_by("part").column("v").to_pylist()) if rows is not None else b""


@dataclass
class _Block:
    """The items of one block in order of idx, with their vectors and shares of the distribution of negatives."""

    idx: np.ndarray
    vectors: np.ndarray
    share: np.ndarray

    def slots(self, idx: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.idx, idx).astype(np.int32)

    def rows(self, kind: int, b: int) -> Iterator[pa.RecordBatch]:
        for part, at in enumerate(range(0, self.idx.size, ROW_ITEMS)):
            yield _row(kind, b, part, self.vectors[at : at + ROW_ITEMS].tobytes())


def _row(kind: int, b: int, part: int = 0, v: bytes | None = None, loss: float | None = None, pairs: int | None = None) -> pa.RecordBatch:
    values = ((kind, pa.int32()), (b, pa.int32()), (part, pa.int32()), (v, pa.binary()), (loss, pa.float64()), (pairs, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], names=["kind", "b", "part", "v", "loss", "pairs"])


def _pairs_of(path: str) -> np.ndarray:
    """The pairs of a cell, center and context in two columns."""
    rows = read_folder(path, "pairs")
    return np.frombuffer(b"".join(rows.column("pairs").to_pylist()) if rows is not None else b"", np.int64).reshape(-1, 2)


def drawn_negatives(asked: np.ndarray, share: np.ndarray, negative: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(center, item) of the negatives that fall on a block: of `negative` for each pair asked of a center, by the items' shares among all."""
    whole = min(float(share.sum()), 1.0)
    many = rng.binomial(asked * negative, whole)
    cdf = np.cumsum(share) / max(float(share.sum()), 1e-300)
    return np.repeat(np.arange(asked.size), many), np.searchsorted(cdf, rng.random(int(many.sum()))).clip(0, share.size - 1)


def _cell(left: _Block, right: _Block, asked: np.ndarray, center: np.ndarray, context: np.ndarray, config: Config, rate: float, rng: np.random.Generator) -> float:
    """Trains a cell in a random order of its pairs and negatives. The sum of losses."""
    others, items = drawn_negatives(asked, right.share, config.negative, rng)
    pairs = center.size
    center, target = np.concatenate([center, others.astype(np.int32)]), np.concatenate([context, items.astype(np.int32)])
    del others, items
    order = rng.permutation(center.size)
    step, total = BLOCK * (1 + config.negative), 0.0
    for at in range(0, order.size, step):
        part = order[at : at + step]
        total += labelled_step(left.vectors, right.vectors, center[part], target[part], (part < pairs).astype(np.float64), rate)
    return total


def _trained(batches: Iterator[pa.RecordBatch], grid: _Grid, dealt: str, asked: str, vectors: str | None, epoch: int, turn: int, rate: float) -> Iterator[pa.RecordBatch]:
    """A turn's cell of each block of centers in the batches; every cell gives its vectors, and its loss."""
    for b in (b for batch in batches for b in batch.column(0).to_pylist()):
        other, total, seen = (b + turn) % grid.blocks, 0.0, 0
        left, right = grid.block(b, vectors, CENTERS), grid.block(other, vectors, CONTEXTS)
        if left and right:
            met = _pairs_of(f"{dealt}/turn={turn}/task={b}")
            # pairs come as tasks have dealt them; sorted, they are the same in every run
            slots = np.sort(left.slots(met[:, 0]).astype(np.int64) * right.idx.size + right.slots(met[:, 1]))
            center, context, seen = (slots // right.idx.size).astype(np.int32), (slots % right.idx.size).astype(np.int32), slots.size
            del met, slots
            total = _cell(left, right, np.frombuffer(_joined(f"{asked}/b={b}"), np.int64), center, context, grid.config, rate, np.random.default_rng([grid.config.seed, epoch, turn, b]))
        for kind, block, at in ((CENTERS, left, b), (CONTEXTS, right, other)):
            if block:
                yield from block.rows(kind, at)
        yield _row(LOSS, b, loss=total, pairs=seen)


def _asked(batches: Iterator[pa.RecordBatch], grid: _Grid, dealt: str) -> Iterator[pa.RecordBatch]:
    """How many pairs of the epoch every item of a block is the center of."""
    for b in (b for batch in batches for b in batch.column(0).to_pylist()):
        if block := grid.block(b):
            many = np.zeros(block.idx.size, np.int64)
            for turn in range(grid.blocks):
                many += np.bincount(block.slots(_pairs_of(f"{dealt}/turn={turn}/task={b}")[:, 0]), minlength=many.size)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([many.tobytes()], pa.binary())], names=["b", "part", "v"])


def _ended(batches: Iterator[pa.RecordBatch], grid: _Grid, vectors: str | None) -> Iterator[pa.RecordBatch]:
    size = grid.config.vector_size
    for b in (b for batch in batches for b in batch.column(0).to_pylist()):
        left, right = grid.block(b, vectors, CENTERS), grid.block(b, vectors, CONTEXTS)
        for at in range(0, left.idx.size if left else 0, ROW_ITEMS):
            n = min(ROW_ITEMS, left.idx.size - at)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(x[at : at + n].ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(left.idx[at : at + n]), lists(left.vectors), lists(right.vectors)], names=["idx", "embedding", "context"])


def _by_block(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("b", pa.array(block_of(batch.column("idx").to_numpy(), blocks)))


def pairs_in_windows(ids: pa.Array, reach: pa.Array) -> np.ndarray:
    """The pairs (center, context) of lists of items, each with those within its own reach in its list."""
    flat, far = ids.flatten().to_numpy(), reach.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, int(far.max(initial=0)) + 1):
        one = row[d:] == row[:-d]
        for left, right, near in ((flat[:-d], flat[d:], far[:-d]), (flat[d:], flat[:-d], far[d:])):
            met = one & (near >= d)
            found.append(np.stack([left[met], right[met]], axis=1))
    return np.concatenate(found)


def _dealt(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows of pairs by cell, from lists (ids, reach) or pairs (center, context)."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(held)
        task, other = block_of(pairs[:, 0], blocks), block_of(pairs[:, 1], blocks)
        cell = (other - task) % blocks * blocks + task
        order = np.argsort(cell, kind="stable")
        pairs, cell = pairs[order], cell[order]
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), cell.size]
        for lo, hi in zip(cuts, cuts[1:]):
            one = [pa.array([int(cell[lo]) // blocks], pa.int32()), pa.array([int(cell[lo]) % blocks], pa.int32()), pa.array([pairs[lo:hi].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, names=["turn", "task", "pairs"])

    for batch in batches:
        found = pairs_in_windows(*batch.columns) if batch.schema.names[0] == "ids" else np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if len(found):
            held, size = [*held, found], size + len(found)
        if size > HELD:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def number_of_blocks(items: int, pairs: int, cores: int) -> int:
    """Blocks of BLOCK_ITEMS items and cells of CELL_MOST pairs at most; as many as cores, if cells then have CELL_LEAST pairs."""
    return max(1, -(-items // BLOCK_ITEMS), math.ceil(math.sqrt(pairs / CELL_MOST)), min(cores, math.ceil(math.sqrt(pairs / CELL_LEAST))))


def _on_grid(pairs_of: Callable[[int], list[DataFrame]], anew: bool, vocab: DataFrame, config: Config, blocks: int, rates: Callable[[int, int], float]) -> tuple[DataFrame, list[float]]:
    """(idx, embedding, context) and the mean loss of each epoch; pairs_of gives tables (ids, reach) or (center, context)
    of an epoch's pairs, the same in all epochs unless they are drawn anew.

    Pairs are written by cell, as rows of many, and vectors by block after each turn; the tasks of a turn read their own
    files, so a turn is one stage without a shuffle.
    """
    spark = vocab.sparkSession
    shares = sampling_distribution(vocab).select(F.col("idx").cast("long").alias("idx"), F.col("probability").alias("p"))
    grid = _Grid(new_path(spark, "items"), blocks, config)
    shares.mapInArrow(partial(_by_block, blocks=blocks), "idx long, p double, b int").repartition("b").write.partitionBy("b").parquet(grid.items)
    tasks = lambda f, schema, **own: spark.range(0, blocks, 1, blocks).mapInArrow(partial(f, grid=grid, **own), schema)
    path, dealt, asked, losses = None, None, None, []
    for epoch in range(config.epochs):
        if anew or not dealt:
            dealt, asked = new_path(spark, "turns"), new_path(spark, "asked")
            rows = [own.mapInArrow(partial(_dealt, blocks=blocks), "turn int, task int, pairs binary") for own in pairs_of(epoch)]
            reduce(DataFrame.union, rows).repartition("turn", "task").write.partitionBy("turn", "task").parquet(dealt)
            tasks(_asked, "b int, part int, v binary", dealt=dealt).write.partitionBy("b").parquet(asked)
        done = []
        for turn in range(blocks):
            out = new_path(spark, "vectors")
            tasks(_trained, _ROWS, dealt=dealt, asked=asked, vectors=path, epoch=epoch, turn=turn, rate=rates(epoch, turn)).write.partitionBy("kind", "b").parquet(out)
            for p in ([path] if turn == 0 else [f"{path}/kind={kind}" for kind in (CENTERS, CONTEXTS)]) if path else ():
                remove(spark, p)
            path = out
            done.append(path)
        told = spark.read.schema("loss double, pairs long").option("recursiveFileLookup", True).parquet(*[f"{p}/kind={LOSS}" for p in done]).collect()
        losses.append(math.fsum(r["loss"] for r in told) / max(sum(r["pairs"] for r in told), 1))
        for p in [*done[:-1], *((dealt, asked) if anew or epoch == config.epochs - 1 else ())]:
            remove(spark, p)
    vectors = written(tasks(_ended, "idx long, embedding array<double>, context array<double>", vectors=path), "trained")
    for p in (path, grid.items):
        if p:
            remove(spark, p)
    return vectors, losses


def sgns(lists: DataFrame, vocab: DataFrame, config: Config = Config(), partitions: int | None = None) -> tuple[DataFrame, list[float]]:
    """(idx, embedding, context) and the mean loss of each epoch; lists hold (pid, ids), vocab (idx, count).

    Windows are whole, a playlist gives max_pairs at most, the same in every epoch; the rate falls to a quarter.
    `partitions` fixes the number of blocks, on which results depend; without it pairs, items and cores do.
    """
    n = F.size("ids").cast("long")
    near = F.least(F.lit(config.window).cast("long"), n - 1)
    lists = written(lists.select("pid", F.col("ids").cast("array<long>").alias("ids"), (near * (2 * n - 1 - near)).alias("pairs")), "lists")
    most = config.max_pairs if config.max_pairs > 0 else (1 << 63) - 1
    capped = lists.where(F.col("pairs") > most)
    both = [lists.where(F.col("pairs") <= most).select("ids", F.array_repeat(F.lit(config.window), F.size("ids")).alias("reach"))]
    if not capped.isEmpty():
        both.append(sampled_pairs(capped, config.window, config.max_pairs, config.seed).select("center", "context"))
    pairs = lists.agg(F.sum(F.least("pairs", F.lit(most)))).first()[0] or 0
    blocks = partitions or number_of_blocks(vocab.count(), pairs, vocab.sparkSession.sparkContext.defaultParallelism)
    return _on_grid(lambda epoch: both, False, vocab, config, blocks, lambda epoch, turn: learning_rate(config.learning_rate, epoch, config.epochs))


def keep_probability(vocab: DataFrame, sample: float) -> DataFrame:
    """vocab with keep: the share of an item's occurrences that is trained, 1 for all but frequent items. sample 0: all."""
    if sample <= 0:
        return vocab.withColumn("keep", F.lit(1.0))
    total = vocab.agg(F.sum("count").cast("double").alias("__total"))
    often = F.col("count") / (F.lit(sample) * F.col("__total"))
    return vocab.crossJoin(F.broadcast(total)).withColumn("keep", F.least(F.lit(1.0), (F.sqrt(often) + 1) / often)).drop("__total")


def kept_lists(occurrences: DataFrame, vocab: DataFrame, sample: float, playlist: str = "pid", key: str = "track_uri", pos: str = "pos") -> DataFrame:
    """(playlist, ids, keep): the idx of each playlist's known tracks in order, and the share of each that is trained."""
    known = occurrences.join(keep_probability(vocab, sample).select(key, "idx", "keep"), key)
    lists = known.groupBy(F.col(playlist).alias("pid")).agg(F.array_sort(F.collect_list(F.struct(pos, "idx", "keep"))).alias("e"))
    return lists.where(F.size("e") >= 2).select("pid", F.transform("e", lambda e: e["idx"]).alias("ids"), F.transform("e", lambda e: e["keep"]).alias("keep"))


def skipgram(lists: DataFrame, vocab: DataFrame, config: Config = Config(), partitions: int | None = None) -> tuple[DataFrame, list[float]]:
    """(idx, embedding, context) and the mean loss of each epoch, for lists (pid, ids, keep) of kept_lists.

    Every epoch draws anew: which occurrences of frequent items are kept, how far a center's window reaches, and
    negatives. The rate falls evenly to LAST_RATE.
    """
    lists = written(lists, "kept-lists")
    most = lists.agg(F.sum(F.size("ids"))).first()[0] or 0
    blocks = partitions or number_of_blocks(vocab.count(), most * (config.window + 1), vocab.sparkSession.sparkContext.defaultParallelism)
    rates = lambda epoch, turn: config.learning_rate - (config.learning_rate - LAST_RATE) * (epoch + turn / blocks) / config.epochs
    drawn = lambda epoch: [drawn_windows(lists, config.window, config.seed, epoch).select(F.col("ids").cast("array<long>").alias("ids"), "reach")]
    return _on_grid(drawn, True, vocab, config, blocks, rates)


def word2vec_vectors(lists: DataFrame, config: Config = Config(), column: str = "uris") -> DataFrame:
    """(track_uri, embedding, embedding_norm) of all uris with min_count occurrences in lists.

    Windows, rates and occurrences (all, none is left out) are those of MLlib's trainer. That holds the model on the
    driver, several times, so vectors are trained on the grid, against negatives, as the original trainer does, where MLlib
    has a tree of all words.
    """
    numbered = "pid" if "pid" in lists.columns else F.monotonically_increasing_id().alias("pid")
    lists = written(lists.select(numbered, column), "numbered-lists")
    rows = lists.select("pid", F.posexplode(column).alias("pos", "track_uri"))
    vocab = with_index(occurrence_counts(rows).where(F.col("count") >= config.min_count), [F.desc("count"), F.col("track_uri")])
    vectors, _ = skipgram(kept_lists(rows, vocab, 0.0), vocab.select("idx", "count"), config, config.partitions)
    found = vectors.join(vocab, "idx").select("track_uri", "embedding")
    return found.withColumn("embedding_norm", normalized(F.col("embedding")))
