"""Toxicity scores by weak supervision.

Voters look at every text: lexicons, some fixed and some learned from labelled texts, and patterns. Each fires or is
silent; neither is right always. The labels that some texts have are one more voter, the annotator, which says toxic,
clean or nothing. A generative label model takes a text's class as hidden: it estimates, by expectation and
maximisation over all texts that may be learned from, labelled or not, how often each voter fires in either class, how
often the annotator is right, and how common toxic texts are. Voters that repeat each other beyond what the class
explains are found by their correlation within the classes, and have one joint distribution instead of one each. Its
posterior labels, of texts without a label too, train a linear classifier over words and votes, which scores every
whole text.

Word counts cover all labelled texts, votes all texts that may be learned from. The driver gets the distinct patterns
of votes (at most 3 * 2**voters, a number that does not grow with the data), VOCABULARY words, and SAMPLE texts'
votes and words, taken by a hash of their ids, to fit the classifier's weights. Scoring reads every text once and shuffles nothing.

Defined results: a null text counts as the empty text, which gets the score of a text without any known word. A label
that is not 0 or 1 is not read; of several labels of one id the largest counts. Without labels the score is that of
the fixed lexicons. Repeated rows give equal rows. Columns other than id and text are not read for a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.common import filter_words, may_be_held, text_of, written
from segue.llm.letters import Words, chunks, grouped, word_hash

#: Most texts that the classifier's weights are fitted to; its words; learned lexicon voters.
SAMPLE, VOCABULARY, LEARNED_VOTERS = 20_000, 400, 8
#: A word of a learned lexicon is in so many toxic texts at least, and so much likelier there than in clean ones.
LEAST_TEXTS, LEAST_LIFT = 5, 8.0
#: Fixed lexicons, a voter each.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile fool dimwit clueless halfwit",
    "worth": "worthless useless pathetic loser losers failure nobody waste",
    "disgust": "disgusting filthy gross vile revolting trash garbage scum vermin",
    "ridicule": "clown clowns joke ridiculous laughable embarrassing",
    "hostility": "hate despise kill die hurt destroy shut attack",
    "german": "idiot dumm dummkopf blöd wertlos abschaum widerlich erbärmlich verlierer trottel",
    "french": "idiot stupide débile crétin inutile ordure dégoûtant pathétique minable imbécile",
    "spanish": "idiota estúpido imbécil inútil basura asqueroso patético escoria perdedor payaso",
}
#: Patterns, a voter each.
PATTERNS = {
    "address": r"(?i)\byou(?:'re| are)?\s+(?:an?\s+)?(?:such\s+)?(?:idiot|moron|loser|clown|stupid|worthless|pathetic|disgusting)",
    "shouting": r"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}",
    "outcry": r"!{3,}",
    "masked": r"(?i)\b[a-z]+[*@#$]{2,}[a-z]+\b",
}
#: What a text must hold for a pattern to be looked for.
NEEDED = {"address": lambda t: "you" in t.lower(), "shouting": re.compile("[A-Z]{4}").search, "outcry": lambda t: "!!!" in t, "masked": re.compile("[*@#$]{2}").search}
#: Letters of a stem; words of a text that have to share one for it to count as frequent there.
STEMS, SEVERAL = (4, 5, 6, 7), 3
#: Rounds of the label model, the first ones of which look for correlations beyond CORRELATED; steps of the classifier.
ROUNDS, LOOKING, CORRELATED, STEPS = 40, 5, 0.3, 15
#: Weight of what is assumed before any text is read, in texts; how the annotator is assumed to label either class.
STRENGTH, ANNOTATOR, RIDGE = 10.0, (0.9, 0.05), 1.0
HELD_FEATURES = 400_000
#: Kinds of features: a word, the stem of a longer word, a stem of SEVERAL words.
WORD, STEM, OFTEN = 0, 1, 2


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct (owner, hash), and how many rows each has."""
    order, begin = grouped(owner, hashes)
    return order[begin], np.diff(np.append(begin, order.size))


def features(texts: list[str], known: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, owner, hash) of the distinct features of every text; with known (sorted hashes by kind), only of those."""
    words = Words(texts, "word")
    every, owner = words.hashes(), words.owners()
    at, _ = _distinct(owner, every)
    hashes, owner, lengths = every[at], owner[at], words.lengths[at]
    held = slice(None) if known is None else _in(known[WORD], hashes)
    yield WORD, owner[held], hashes[held]
    for k in STEMS:
        longer = np.flatnonzero(lengths > k)
        starts, own = words.starts_of(at[longer], k), owner[longer]
        if known is not None:
            held = _in(known[STEM], starts)
            starts, own = starts[held], own[held]
        first, counts = _distinct(own, starts)
        yield STEM, own[first], starts[first]
        often = first[counts >= SEVERAL]
        yield OFTEN, own[often], starts[often]


def _in(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not known.size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), known.size - 1)] == hashes)


class Voters:
    """Votes and words of the classifier for texts; features are (kind, hash)."""

    def __init__(self, learned: list[list[tuple[int, int]]], vocabulary: list[tuple[int, int]]):
        fixed = [[(WORD, word_hash(w)) for w in names.split()] for names in LEXICONS.values()]
        lists = fixed + [x for x in learned if x]
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        self.size, self.first = len(lists) + len(self.patterns), len(lists)
        every = sorted({f for names in [*lists, vocabulary] for f in names})
        place = {f: i for i, f in enumerate(every)}
        self.votes_of = np.zeros((len(every), self.size), np.int8)
        for i, names in enumerate(lists):
            self.votes_of[[place[f] for f in names], i] = 1
        self.word_of = np.full(len(every), -1)
        self.word_of[[place[f] for f in vocabulary]] = np.arange(len(vocabulary))
        self.tables, self.places = {}, {}
        for kind in (WORD, STEM, OFTEN):
            own = sorted((h, place[(k, h)]) for k, h in every if k == kind)
            self.tables[kind] = np.array([h for h, _ in own], np.uint64)
            self.places[kind] = np.array([i for _, i in own], np.int64)
        self.known = {WORD: self.tables[WORD], STEM: np.union1d(self.tables[STEM], self.tables[OFTEN])}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes of every text, and (text, word of the vocabulary) in order."""
        votes = np.zeros((len(texts), self.size), np.int8)
        owners, words = [], []
        for kind, owner, hashes in features(texts, self.known):
            held = _in(self.tables[kind], hashes)
            if held.size:
                at = self.places[kind][np.searchsorted(self.tables[kind], hashes[held])]
                np.maximum.at(votes, owner[held], self.votes_of[at])
                named = self.word_of[at] >= 0
                owners.append(owner[held][named])
                words.append(self.word_of[at][named])
        for i, text in enumerate(texts):
            for j in self._matched(text):
                votes[i, self.first + j] = 1
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        order = np.lexsort((word, owner))
        return votes, owner[order], word[order]

    def _matched(self, text: str) -> list[int]:
        return [i for i, (name, p) in enumerate(zip(PATTERNS, self.patterns)) if NEEDED[name](text) and p.search(text)]


class LabelModel:
    """P(toxic | votes, label) of a two-class model; votes are patterns (0, 1), gold is 1, 0 or -1 for no label, each counted."""

    def __init__(self, votes: np.ndarray, gold: np.ndarray, counts: np.ndarray):
        x, told = votes.astype(float), gold >= 0
        labelled = float(counts[told].sum())
        self.prior = float((counts[gold == 1].sum() + 1.0) / (labelled + 20.0))
        self.annotator = ANNOTATOR
        self.groups: list[list[int]] = [[i] for i in range(votes.shape[1])]
        # labelled texts come first: what is known of voters before any other text is read
        posterior = np.where(gold == 1, ANNOTATOR[0], 1 - ANNOTATOR[0]) if labelled else np.where(x.any(axis=1), 0.9, 0.05)
        weight = np.where(told, counts, 0.0) if labelled else counts
        for i in range(ROUNDS):
            one, zero = weight * posterior, weight * (1 - posterior)
            if i:
                self.prior = float(min(0.5, (one.sum() + STRENGTH * self.prior) / (one.sum() + zero.sum() + STRENGTH)))
            rate = (one + zero) @ x / max(1e-9, (one + zero).sum())
            self.toxic = (one @ x + STRENGTH * np.maximum(rate, 0.01)) / (one.sum() + STRENGTH)
            self.clean = (zero @ x + STRENGTH * np.minimum(rate, 0.01)) / (zero.sum() + STRENGTH)
            if 0 < i <= LOOKING:
                self.groups = self._correlated(x, one, zero)
            self.tables = [self._joint(votes[:, g], one, zero) for g in self.groups]
            self.annotator = tuple((w[gold == 1].sum() + STRENGTH * a) / (w[told].sum() + STRENGTH) for w, a in ((one, ANNOTATOR[0]), (zero, ANNOTATOR[1])))
            posterior, weight = self.posterior(votes, gold), counts.astype(float)

    def _correlated(self, x: np.ndarray, one: np.ndarray, zero: np.ndarray) -> list[list[int]]:
        """Voters in groups: those that agree within the classes, one with the next."""
        total = np.zeros((x.shape[1], x.shape[1]))
        for weight, rate in ((one, self.toxic), (zero, self.clean)):
            away = (x - rate) / np.sqrt(np.maximum(rate * (1 - rate), 1e-4))
            total += (away * weight[:, None]).T @ away
        linked = total / max(1e-9, one.sum() + zero.sum()) > CORRELATED
        group = list(range(len(linked)))
        for i in range(len(linked)):
            for j in range(i):
                if linked[i, j] and group[i] != group[j]:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
        return [[i for i, g in enumerate(group) if g == own] for own in sorted(set(group))]

    @staticmethod
    def _outcome(votes: np.ndarray) -> np.ndarray:
        """What a group says: which of up to three voters fire, or how many of more, up to four."""
        if votes.shape[1] <= 3:
            return votes.astype(np.int64) @ (1 << np.arange(votes.shape[1]))
        return np.minimum(votes.sum(axis=1, dtype=np.int64), 4)

    def _joint(self, votes: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """The log odds of each outcome of a group."""
        said = self._outcome(votes)
        size = 1 << votes.shape[1] if votes.shape[1] <= 3 else 5
        toxic, clean = np.bincount(said, one, size), np.bincount(said, zero, size)
        usual = (toxic + clean + 1.0 / size) / (toxic.sum() + clean.sum() + 1.0)
        smooth = lambda n: (n + STRENGTH * usual) / (n.sum() + STRENGTH)
        return np.log(smooth(toxic) / smooth(clean))

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        evidence = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for g, table in zip(self.groups, self.tables):
            evidence += table[self._outcome(votes[:, g])]
        said, not_said = (math.log(a / b) for a, b in ((self.annotator[0], self.annotator[1]), (1 - self.annotator[0], 1 - self.annotator[1])))
        evidence += np.where(gold == 1, said, np.where(gold == 0, not_said, 0.0))
        return 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the last weight is the constant."""
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    ridge = np.full(w.size, RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x.T * (p * (1 - p)).astype(np.float32)) @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash, toxic, clean): texts of either label with a feature, as far as counted."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], STEM: [], OFTEN: []}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for kind, parts in held.items():
            if parts:
                values, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                label = np.concatenate([t for _, t in parts])
                toxic, every = np.bincount(where, label).astype(np.int64), np.bincount(where)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(values.size, kind, np.int32)), pa.array(values.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["kind", "hash", "toxic", "clean"])
                parts.clear()
        size = 0

    for chunk in chunks(batches, 0):
        label = chunk.column(1).to_numpy()
        for kind, owner, hashes in features(chunk.column(0).to_pylist()):
            held[kind].append((hashes, label[owner]))
            size += hashes.size
        if size > 4 * HELD_FEATURES:
            yield from out()
    yield from out()


def _voted(batches: Iterator[pa.RecordBatch], learned: list, vocabulary: list) -> Iterator[pa.RecordBatch]:
    voters = Voters(learned, vocabulary)
    for chunk in chunks(batches, 1):
        votes, owner, word = voters.of(chunk.column(1).to_pylist())
        ends = np.searchsorted(owner, np.arange(chunk.num_rows + 1))
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([v.tobytes() for v in votes], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word, pa.int32()))], names=["id", "votes", "words"])


def _signed(rows: list) -> list[tuple[int, int]]:
    return [(r["kind"], r["hash"] & (1 << 64) - 1) for r in rows]


def known_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model, a small dictionary, from the texts that may be learned from and the labels (id, toxic) of some of them."""
    known = written(known_labels(labels, id_col), "labels")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # a filter of bounded size keeps texts without a label out of the shuffle, the join is exact
    likely = may_be_held(texts.withColumn("h", F.xxhash64("id")), "h", filter_words(known.select(F.xxhash64("id").alias("h")), "h"))
    labelled = likely.join(known.hint("merge"), "id").select("text", "toxic")  # labels grow with the texts: never sent to every task
    counts = written(labelled.mapInArrow(_feature_counts, "kind int, hash long, toxic long, clean long").groupBy("kind", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "feature-texts")
    sizes = dict(texts.select("id").join(known, "id").groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lift = ((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("clean") + 0.5) / (clean + 1.0))
    frequent = counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
    scored = frequent.withColumn("lift", lift).withColumn("gain", F.abs(F.log("lift")) * F.sqrt(F.col("toxic") + F.col("clean")))
    order = [F.desc("gain"), "kind", "hash"]
    vocabulary = _signed(scored.orderBy(*order).limit(VOCABULARY).collect())
    telling = _signed(scored.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("lift") >= LEAST_LIFT)).orderBy(*order).limit(VOCABULARY).collect())
    learned = [sorted(telling[i::LEARNED_VOTERS]) for i in range(LEARNED_VOTERS)]
    voters = Voters(learned, vocabulary)

    kind = docs.schema[id_col].dataType.simpleString()
    voted = texts.mapInArrow(partial(_voted, learned=learned, vocabulary=vocabulary), f"id {kind}, votes binary, words array<int>")
    rows = written(voted.join(known, "id", "left").withColumn("gold", F.coalesce("toxic", F.lit(-1))), "votes")
    patterns = rows.groupBy("votes", "gold").agg(F.count("*").alias("n")).toArrow()  # 3 * 2**voters at most
    total = sum(patterns.column("n").to_pylist())
    as_votes = lambda t: np.frombuffer(b"".join(t.column("votes").to_pylist()), np.int8).reshape(-1, voters.size)
    gold = lambda t: t.column("gold").to_numpy().astype(np.int64)
    model = LabelModel(as_votes(patterns), gold(patterns), patterns.column("n").to_numpy().astype(float)) if total else None
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    found = rows.select("votes", "words", "gold").toArrow()
    votes = as_votes(found)
    x = np.zeros((len(votes), len(vocabulary) + voters.size), np.float32)
    for i, words in enumerate(found.column("words").to_pylist()):
        x[i, words] = 1
    x[:, len(vocabulary) :] = votes
    y = model.posterior(votes, gold(found)) if model else np.zeros(0)
    if toxic and y.size and y.max() > 0.5:
        w = fit_linear(x, y)
    else:  # nothing to learn from
        w = np.concatenate([np.zeros(len(vocabulary)), np.full(voters.size, 4.0), [-3.0]])
    return {"learned": learned, "vocabulary": vocabulary, "weights": w.tolist(), "annotator": model.annotator if model else ANNOTATOR, "groups": model.groups if model else []}


def _scored(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    voters, weights = Voters(model["learned"], model["vocabulary"]), np.array(model["weights"])
    words, of_vote, constant = weights[: len(model["vocabulary"])], weights[len(model["vocabulary"]) : -1], weights[-1]
    for chunk in chunks(batches, 1):
        votes, owner, word = voters.of(chunk.column(1).to_pylist())
        total = constant + (votes * of_vote).sum(axis=1) + np.bincount(owner, words[word], chunk.num_rows)
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30.0, 30.0))))], names=["k", "s"])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): how likely every whole text is toxic."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(partial(_scored, model=model), f"`{id_col}` {kind}, score double")
