"""Language identification by rank-order n-gram profiles.

Each language's profile ranks its most frequent character n-grams (one to three characters, words set off by a
blank). A document is given the language whose profile is nearest to the ranking of its own most frequent n-grams,
by out-of-place distance: the sum of differences of rank, a missing n-gram counting as PROFILE places.

Texts unlike every profile are rejected by a distance of their length, learned by `limits` from all labelled texts and
their beginnings.

Defined results: a null or letterless text is `und` with score 0. Ties between n-grams go by their characters, ties
between languages by name. Without any labelled text every prediction is `und`. Texts are read whole; columns other
than id and text are never read for a prediction. Repeated rows give equal rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.llm.common import spare_prefix, written

UNKNOWN = "und"
#: Places of a profile; share of a language's n-grams below which an n-gram is none of its most frequent.
PROFILE = 400
#: Distance, as a share of the largest possible, beyond which a text of at least LEAST_GRAMS n-grams is rejected where
#: no limits are learned, and no learned limit lies.
FARTHEST, LEAST_GRAMS = 0.97, 300
#: A learned limit is the own-language distance that this share of labelled texts of a length stays within, and a margin.
WITHIN, MARGIN, LEAST_TEXTS = 0.999, 1.15, 100
#: Steps of a distance that are counted; lengths are classes of n-grams by powers of two.
STEPS, CLASSES = 1000, 64
BITS = 21
#: Marks of numbers of two and of three characters: the former have what is no character in front.
PAIR, TRIPLE = np.uint64(((1 << BITS) - 1) << 2 * BITS), np.uint64(1 << 63)


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: itself in lower case if it is a letter, else 0."""
    found = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            found[c] = ord(low) if len(low) == 1 else c
    return found


def grams(text: str) -> np.ndarray:
    """All n-grams of the letters of a text, one number for each; none if it has no letter."""
    marks = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not marks.any():
        return np.zeros(0, np.uint64)
    marks = np.concatenate([np.zeros(1, np.uint64), marks, np.zeros(1, np.uint64)])
    marks = marks[np.concatenate([[True], (marks[1:] != 0) | (marks[:-1] != 0)])]  # one blank between words
    one = marks[marks != 0]
    two = marks[:-1] << np.uint64(BITS) | marks[1:]
    three = two[:-1] << np.uint64(BITS) | marks[2:]
    return np.concatenate([one, two | PAIR, three[(marks[1:-1] != 0)] | TRIPLE])


def ranked(found: np.ndarray, places: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by number."""
    values, counts = np.unique(found, return_counts=True)
    return values[np.lexsort((values, -counts))[:places]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n-grams by language, handed on whenever many are held."""

    def out(held):
        for lang, parts in held.items():
            values = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            values, where = np.unique(values, return_inverse=True)
            yield lang, values, np.bincount(where, counts).astype(np.int64)

    def merged(texts_by_lang):
        return {lang: [(v, c)] for lang, v, c in out(texts_by_lang)}

    held: dict[str, list] = defaultdict(list)
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[lang].append(np.unique(grams(text), return_counts=True))
            size += held[lang][-1][0].size
            if size > 2_000_000:
                held = defaultdict(list, merged(held))
                size = sum(p[0].size for parts in held.values() for p in parts)
                if size > 1_000_000:
                    yield from _batches(out(held))
                    held, size = defaultdict(list), 0
    yield from _batches(out(held))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for lang, values, counts in rows:
        yield pa.RecordBatch.from_arrays([pa.array([lang] * values.size, pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", places: int = PROFILE) -> dict[str, list[int]]:
    """The ranking of each language's most frequent n-grams, learned from all rows with a text and a language.

    N-grams are ranked in Spark, ties by their hash; the driver gets `places` of each language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counts = written(rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    order = [F.desc("n"), F.col("gram") < 0, F.col("gram")]  # hashes are unsigned
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= places)
    found: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for lang, gram, rank in first.select("lang", "gram", "rank").collect():
        found[lang].append((rank, gram & (1 << 64) - 1))
    return {lang: [g for _, g in sorted(rows)] for lang, rows in sorted(found.items())}


class Classifier:
    def __init__(self, learned: dict[str, list[int]], places: int = PROFILE):
        self.names, self.places = sorted(learned), places
        self.grams = np.unique(np.array([g for p in learned.values() for g in p], np.uint64))
        self.rank = np.full((len(self.names), self.grams.size + 1), places, np.int64)  # the last column: in no profile
        self.known = np.zeros_like(self.rank, dtype=bool)
        for i, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(learned[name], np.uint64))
            self.rank[i, at] = np.arange(len(learned[name]))
            self.known[i, at] = True

    def away(self, found: np.ndarray) -> np.ndarray:
        """Distances of a text's n-grams from every language, as a share of the largest."""
        own = ranked(found, self.places)
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, self.grams.size - 1)] != own] = self.grams.size
        return np.where(self.known[:, at], np.abs(self.rank[:, at] - np.arange(own.size)), self.places).sum(axis=1) / (own.size * self.places)

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, distance as a share of the largest, n-grams of the text."""
        found = grams(text) if text is not None else np.zeros(0, np.uint64)
        if not found.size or not self.names:
            return UNKNOWN, 0.0, 1.0, 0
        away = self.away(found)
        best = int(away.argmin())
        others = np.delete(away, best)
        margin = 1.0 if not others.size or others.min() <= 0 else 1.0 - away[best] / others.min()
        return self.names[best], float(min(1.0, max(0.0, margin))), float(away[best]), int(found.size)


def _predicted(batches: Iterator[pa.RecordBatch], learned: dict[str, list[int]], places: int) -> Iterator[pa.RecordBatch]:
    model = Classifier(learned, places)
    for batch in batches:
        rows = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        langs, scores, far, sizes = zip(*rows) if rows else ((), (), (), ())
        made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.float64()), pa.array(sizes, pa.int64())]
        kept = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=[str(i) for i in range(len(kept) + 4)])


def predict(docs: DataFrame, learned: dict[str, list[int]], carry: list[str], text_col: str = "text", places: int = PROFILE, prefix: str = "") -> DataFrame:
    """The columns of carry, and lang_pred, score, distance, grams (behind a prefix) for every row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    schema += f", {prefix}lang_pred string, {prefix}score double, {prefix}distance double, {prefix}grams long"
    return docs.select(*carry, F.col(text_col).alias(f"{spare_prefix(docs)}text")).mapInArrow(partial(_predicted, learned=learned, places=places), schema)


def _own_distances(batches: Iterator[pa.RecordBatch], learned: dict[str, list[int]], places: int) -> Iterator[pa.RecordBatch]:
    """Counts by class of length and step of distance of texts, and of their beginnings of 1, 2, 4, .. characters."""
    model = Classifier(learned, places)
    own = {name: i for i, name in enumerate(model.names)}
    held = np.zeros((CLASSES, STEPS + 1), np.int64)
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang in own:
                for size in [len(text), *(1 << k for k in range((len(text) - 1).bit_length()))]:
                    found = grams(text[:size])
                    if found.size:
                        held[int(found.size).bit_length(), int(model.away(found)[own[lang]] * STEPS)] += 1
    size, step = held.nonzero()
    yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(step, pa.int32()), pa.array(held[size, step])], names=["size", "step", "n"])


def limits(labelled: DataFrame, learned: dict[str, list[int]], lang_col: str = "lang", text_col: str = "text", places: int = PROFILE) -> list[float]:
    """By class of length (binary digits of the number of n-grams), the distance beyond which a text is rejected.

    Learned from all rows with a text and a language; the driver gets CLASSES * STEPS counts at most. A class
    of fewer than LEAST_TEXTS texts says too little: it is taken together with the next shorter ones, until there are so
    many. Texts come nearer to their profile the longer they are, so that this rejects none of them.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counted = rows.mapInArrow(partial(_own_distances, learned=learned, places=places), "size int, step int, n long").groupBy("size", "step").agg(F.sum("n"))
    held = np.zeros((CLASSES, STEPS + 1), np.int64)
    for size, step, n in counted.collect():
        held[size, step] = n
    found = []
    for size in range(CLASSES):
        counts = held[size]
        for shorter in range(size - 1, -1, -1):
            if counts.sum() >= LEAST_TEXTS:
                break
            counts = counts + held[shorter]
        step = int(np.searchsorted(counts.cumsum(), WITHIN * counts.sum()))
        found.append(min(FARTHEST, MARGIN * (step + 1) / STEPS) if counts.any() else FARTHEST)
    return found


def rejected(prefix: str = "", limits: list[float] | None = None) -> Column:
    """Of predict's rows: texts without a letter, and those unlike every profile (without limits, only long ones)."""
    grams = F.col(f"{prefix}grams")
    if limits is None:
        far = (F.col(f"{prefix}distance") > FARTHEST) & (grams >= LEAST_GRAMS)
    else:
        far = F.col(f"{prefix}distance") > F.get(F.array(*map(F.lit, limits)), F.length(F.bin(grams)))
    return (F.col(f"{prefix}lang_pred") == UNKNOWN) | far


def accepted(docs: DataFrame, learned: dict[str, list[int]], text_col: str = "text", limits: list[float] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    p = spare_prefix(docs)
    kept = predict(docs, learned, docs.columns, text_col, prefix=p).where(~rejected(p, limits))
    return kept.select(*docs.columns)
