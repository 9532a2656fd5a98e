"""Document fingerprints by a randomised edit embedding with bit-sampled banding and verification.

Every text is embedded by a random walk over its characters that all texts share: at output step j the walk stays
on its character or moves on, as random bits of (j, character) say. Texts at small edit distance fall into step
again after an edit, so that their outputs differ in few places. A fingerprint samples LANES output positions and
keeps four hash bits of the character at each. A lane's position is the last record of a random process that is no
later than the output's length, so texts of nearly equal lengths mostly sample the same positions.

Defined results: a null text counts as the empty text, whose fingerprint is that of no character. Equal texts have
equal fingerprints. Texts are walked over whole, whatever their length. A null id orders after all others; rows of one
id order by text. A single document is its own next one. Columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.common import spare_prefix, text_of, written
from segue.llm.components import bucket_classes, first_shared

#: Sampled positions, output steps after which the walk's random bits repeat, classes of characters.
LANES, PERIOD, CLASSES = 128, 1 << 13, 256
#: Bands of BAND_LANES sampled lanes each; texts at 0.8 of equal lanes share a band with probability 0.9994.
BANDS, BAND_LANES = 40, 8
#: Below so many texts that still walk, each one walks alone.
LOCKSTEP = 80
#: Rows of a range of ids, and the most ranges whose bounds the driver keeps.
RANGE_ROWS, MOST_RANGES = 1_000, 20_000
#: Characters that walk together at most (but for a single longer text).
TOGETHER = 3_000_000
SEED = 20240607


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Steps spent on a character by (class, step); the same as bytes; records by lane; lane salts; the lanes of each band."""
    rng = np.random.default_rng(SEED)
    moves = rng.integers(0, 2, (CLASSES, PERIOD), np.uint8).astype(bool)
    spent = np.zeros((CLASSES, PERIOD), np.uint8)
    ahead = np.full(CLASSES, 64, np.uint8)
    for _ in range(2):  # the second round sees past the end of the period
        for j in range(PERIOD - 1, -1, -1):
            ahead = np.where(moves[:, j], 1, np.minimum(ahead + 1, 64)).astype(np.uint8)
            spent[:, j] = ahead
    records = np.ones((LANES, 72), np.int64)
    for k in range(1, records.shape[1]):
        records[:, k] = np.minimum(np.floor(records[:, k - 1] / np.maximum(rng.random(LANES), 1e-6)), 1 << 40).astype(np.int64) + 1
    salts = rng.integers(1, 1 << 32, LANES, np.uint64)
    bands = [np.sort(rng.permutation(LANES)[:BAND_LANES]) for _ in range(BANDS)]
    return spent, [row.tobytes() for row in spent], records, salts, bands


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(parts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
    """For each text (code points) and first step: the step at which each character's stay ends."""
    spent, alone, *_ = _tables()
    order = sorted(range(len(parts)), key=lambda i: -parts[i].size)
    sizes = np.array([parts[i].size for i in order], np.int64)
    offset = np.cumsum(sizes) - sizes
    flat = np.concatenate([parts[i] for i in order]) if order else np.zeros(0, np.uint32)
    classes = ((flat ^ (flat >> 8)) & (CLASSES - 1)).astype(np.int64)
    ends = np.zeros(flat.size, np.int64)
    at = np.array([begin[i] for i in order], np.int64)
    table, mask = spent.ravel(), PERIOD - 1
    together = int(sizes[LOCKSTEP - 1]) if len(order) >= LOCKSTEP else 0
    active = np.searchsorted(-sizes, -np.arange(together), "left") if together else []
    for step, n in enumerate(active.tolist() if together else []):
        now, here = at[:n], offset[:n] + step
        now += table[classes[here] * PERIOD + (now & mask)]
        ends[here] = now
    for d in range(len(order)):
        if sizes[d] <= together:
            break
        now, out = int(at[d]), []
        for c in (classes[offset[d] + together : offset[d] + sizes[d]]).astype(np.uint8).tobytes():
            now += alone[c][now & mask]
            out.append(now)
        ends[offset[d] + together : offset[d] + sizes[d]] = out
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
    for d, i in enumerate(order):
        found[i] = ends[offset[d] : offset[d] + sizes[d]]
    return found


def sample(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint's lanes: four hash bits of the character at each lane's position of the output."""
    _, _, records, salts, _ = _tables()
    if not points.size:
        seen = np.full(LANES, 0x110000, np.uint64)
    else:
        last = np.where(records <= ends[-1], records, 0).max(axis=1)  # 1-based positions
        seen = points[np.searchsorted(ends, last, "left")].astype(np.uint64)
    mixed = (seen + salts) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(60)).astype(np.uint8)


def as_text(lanes: np.ndarray) -> str:
    return (lanes[0::2] << 4 | lanes[1::2]).tobytes().hex()


def _lanes(texts: list[np.ndarray]) -> list[np.ndarray]:
    return [sample(p, e) for p, e in zip(texts, walk(texts, [0] * len(texts)))]


def _chunks(points: Iterator) -> Iterator[list]:
    held, size = [], 0
    for x in points:
        held.append(x)
        size += x[0].size
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[str] = []
        for held in _chunks((points_of(t),) for t in batch.column(1).to_pylist()):
            found += [as_text(x) for x in _lanes([p for (p,) in held])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["k", "f"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): a fingerprint, in hexadecimal, for every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias(text_col)).mapInArrow(_fingerprinted, f"`{id_col}` {kind}, fingerprint string")


def likeness(left: str, right: str) -> Column:
    """The share of equal lanes."""
    same = F.expr(f"aggregate(sequence(1, {LANES}), 0, (n, i) -> n + int(substr({left}, i, 1) = substr({right}, i, 1)))")
    return same / F.lit(float(LANES))


def _lanes_of(packed: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, LANES // 2)
    return np.stack([both >> 4, both & 15], axis=2).reshape(-1, LANES)


def _bands_of(lanes: np.ndarray) -> np.ndarray:
    """The 32 bits of each band's lanes, a row for every fingerprint."""
    keys = np.zeros((len(lanes), BANDS), np.uint32)
    for band, chosen in enumerate(_tables()[4]):
        for lane in chosen:
            keys[:, band] = keys[:, band] << 4 | lanes[:, lane]
    return keys.view(np.int32)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _bands_of(_lanes_of(batch.column(1).to_pylist()))
        ends = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["node", "z", "bands"])


#: Columns of edit_probe that hold hexadecimal digits.
DIGITS = ("edited_sha256", "fingerprint", "edited_fingerprint")


def _as_bytes(prints: DataFrame) -> DataFrame:
    """Digits as bytes, which take half the room."""
    return prints.withColumns({c: F.unhex(c) for c in DIGITS})


def _as_digits(coded: DataFrame) -> DataFrame:
    return coded.withColumns({c: F.lower(F.hex(c)) for c in DIGITS})


def _alike(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints that agree in threshold of all lanes; rows as components.ROW has them."""
    task, held, index = None, [], None
    left, right = [], []
    for batch in batches:
        lanes = _lanes_of(batch.column(6).to_pylist())
        keys = _bands_of(lanes)
        for row, (now, band, side, node, own) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
            if now != task:
                task, held, index = now, [], None
            if side == 0:
                held.append((node, own, keys[row], lanes[row]))
            elif held:
                index = index or (np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.stack([h[2] for h in held]), np.stack([h[3] for h in held]))
                nodes, classes, their, known = index
                near = (classes != own) & first_shared(their, keys[row], band)
                near[near] = (known[near] == lanes[row]).mean(axis=1) >= threshold - 1e-9
                left += nodes[near].tolist()
                right += [node] * int(near.sum())
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left, right = [], []


#: Buckets whose pairs are compared at once.
BUCKETS = 1_000


def _alike_in_buckets(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints in one bucket that agree in threshold of all lanes and share no earlier band; rows (band, list of (node, z))."""
    equal = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)  # equal lanes by the xor of two bytes
    for batch in batches:
        for at in range(0, batch.num_rows, BUCKETS):
            part = batch.slice(at, BUCKETS)
            rows = part.column(1).flatten()
            many = part.column(1).value_lengths().to_numpy()
            ends, bands = np.repeat(np.cumsum(many), many), np.repeat(part.column(0).to_numpy(), many)
            nodes, packed = rows.field("node").to_numpy(), rows.field("z").to_pylist()
            bytes_of = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, LANES // 2)
            first, left, right = np.arange(nodes.size), [], []
            for step in range(1, int(many.max())):
                first = first[first + step < ends[first]]
                same = equal[bytes_of[first] ^ bytes_of[first + step]].sum(axis=1)
                near = first[same / LANES >= threshold - 1e-9]
                left.append(near)
                right.append(near + step)
            a, b = np.concatenate(left), np.concatenate(right)
            keys = [_bands_of(_lanes_of([packed[i] for i in x.tolist()])) for x in (a, b)]
            news = (keys[0] == keys[1]).argmax(axis=1) == bands[a]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a[news]]), pa.array(nodes[b[news]])], names=["a", "b"])


def _coded_classes(coded: DataFrame, threshold: float, id_col: str) -> DataFrame:
    """(z, class_id), a row for the bytes of every fingerprint of a row with an id; written."""
    nodes = written(coded.where(F.col(id_col).isNotNull()).groupBy(F.col("fingerprint").alias("z")).agg(F.min(F.col(id_col).cast("long")).alias("node")), "fingerprint-nodes")
    payload = nodes.select("node", "z")
    banded = payload.mapInArrow(_banded, "node long, z binary, bands array<int>")
    payload_of = lambda wanted: payload.join(wanted, "node", "left_semi")
    found = bucket_classes(banded, nodes.select("node").distinct(), payload_of, partial(_alike, threshold=threshold), in_place=partial(_alike_in_buckets, threshold=threshold))
    return written(nodes.join(found, "node").select("z", F.col("component").alias("class_id")), "fingerprint-classes")


def _classed(coded: DataFrame, threshold: float, id_col: str) -> DataFrame:
    p = spare_prefix(coded)
    named = _coded_classes(coded, threshold, id_col).select(F.col("z").alias(f"{p}z"), "class_id")
    return coded.join(named, F.col("fingerprint") == F.col(f"{p}z"), "left").select(*coded.columns, "class_id")


def print_classes(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, class_id), a row for every fingerprint of a row with an id; written."""
    return _coded_classes(prints.withColumn("fingerprint", F.unhex("fingerprint")), threshold, id_col).select(F.lower(F.hex("z")).alias("fingerprint"), "class_id")


def classes(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """The rows of prints, and class_id: documents linked by fingerprints that share a band and agree in threshold of all lanes.

    Equal fingerprints are one node. A class is named by its smallest id; a row without an id has the class of its
    fingerprint, if some row with an id has that fingerprint, else none. Ties do not matter, as links have no order.
    Texts so short that they have no character have equal fingerprints. Nodes are linked as `components.bucket_classes`
    says: no pair that shares a band is left out.
    """
    coded = prints.withColumn("fingerprint", F.unhex("fingerprint"))
    return _classed(coded, threshold, id_col).withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def edit_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """edit_probe, and the class of every document by its fingerprint."""
    coded = written(_as_bytes(edit_probe(docs, id_col, text_col)), "fingerprints")
    return _as_digits(_classed(coded, threshold, id_col))


def _part(ids: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The range of each id: 0 holds the largest; nulls are with the smallest."""
    smallest = np.iinfo(np.int64).min
    values = ids.cast(pa.int64()).fill_null(smallest).to_numpy(zero_copy_only=False)
    return pa.array(bounds.size - np.searchsorted(bounds, values, "right"), pa.int32())


def _ranged(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_part(batch.column(0), bounds), batch.column(0)], names=["p", "k"])


def _packed(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        texts = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([_part(batch.column(0), bounds), batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], names=["p", "k", "z", "h"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and descending id, a range's last row is the first of the one after it."""
    import zlib

    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        before = None
        for batch in batches:
            kind = batch.schema.field(2).type
            for part, extra, key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                points = points_of(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
                if before is not None and before[0] == part:
                    cut = before[2].size - before[2].size // 3
                    yield before[2], points, before[1], cut
                # rows carried over from the range before only serve as the next of another row
                before = None if extra else (part, key, points)

    for held in _chunks(rows()):
        texts = [x[0] for x in held]
        nexts = [x[1] for x in held]
        walks = walk(texts, [0] * len(held))
        cuts = [x[3] for x in held]
        heads = [n[: t.size // 3] for t, n in zip(texts, nexts)]
        tails = walk(heads, [int(w[c - 1]) if c else 0 for w, c in zip(walks, cuts)])
        own = [sample(t, w) for t, w in zip(texts, walks)]
        edits = [np.concatenate([t[:c], h]) for t, c, h in zip(texts, cuts, heads)]
        edited = [sample(e, np.concatenate([w[:c], tail])) for e, w, c, tail in zip(edits, walks, cuts, tails)]
        following = own[1:] + _lanes(nexts[-1:])
        for i, n in enumerate(nexts[:-1]):
            if n is not texts[i + 1]:
                following[i] = _lanes([n])[0]
        bands = _tables()[4]
        shared = lambda a, b: sum(bool((a[x] == b[x]).all()) for x in bands)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[2] for x in held], kind),
                pa.array([t.size for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for e in edits], pa.string()),
                pa.array([as_text(x) for x in own], pa.string()),
                pa.array([as_text(x) for x in edited], pa.string()),
                pa.array([float((a == b).mean()) for a, b in zip(own, edited)], pa.float64()),
                pa.array([float((a == b).mean()) for a, b in zip(own, following)], pa.float64()),
                pa.array([shared(a, b) for a, b in zip(own, edited)], pa.int32()),
                pa.array([shared(a, b) for a, b in zip(own, following)], pa.int32()),
            ],
            names=["k", "n", "s", "f", "e", "ne", "nn", "be", "bn"],
        )


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the start of the next document.

    The next document is the one with the next smaller id, after the last the first. Ids are cut into ranges of about
    RANGE_ROWS rows; a row that is first in its range is also sent to the range before it. So texts are shuffled once.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col).cast("long").alias("__id"))
    ranges = int(min(MOST_RANGES, max(1, ids.count() // RANGE_ROWS)))
    cuts = ids.where("__id is not null").approxQuantile("__id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    bounds = np.array(sorted({int(c) for c in cuts}), np.int64)
    # a row for each range, MOST_RANGES at most
    firsts = sorted(ids.mapInArrow(partial(_ranged, bounds=bounds), "p int, k long").groupBy("p").agg(F.max("k").alias("first")).collect())
    before = [(r["p"], firsts[i - 1]["p"], r["first"]) for i, r in enumerate(firsts)]
    own = docs.select(F.col(id_col), text_of(text_col).alias("t"), F.unhex(F.sha1(text_of(text_col))).alias("h"))
    packed = own.mapInArrow(partial(_packed, bounds=bounds), f"p int, `{id_col}` {kind}, z binary, h binary")
    table = spark.createDataFrame(before, "p int, q int, first long")
    stays = F.struct(F.col("p").alias("p"), F.lit(0).alias("extra"))
    copies = F.when(F.col(id_col).cast("long").eqNullSafe(F.col("first")), F.array(stays, F.struct(F.col("q").alias("p"), F.lit(1).alias("extra")))).otherwise(F.array(stays))
    sent = packed.join(F.broadcast(table), "p").select(F.explode(copies).alias("c"), id_col, "z", "h").select("c.p", "c.extra", id_col, "z", "h")
    dealt = sent.repartition("p").sortWithinPartitions("p", "extra", F.col(id_col).desc_nulls_last(), "h").select("p", "extra", id_col, "z")
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"
    return dealt.mapInArrow(_edited, schema)
