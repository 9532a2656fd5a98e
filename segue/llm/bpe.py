"""Byte-level BPE encoding and decoding through a sentencepiece model.

A vocabulary of byte strings with ranks becomes a sentencepiece BPE model: every byte is mapped to one
character, every token to a piece of such characters with its negative rank as score, normalisation is
the identity. Pre-tokens (the matches of the tokenizer's pattern) are encoded one by one, as merges may
not cross them; ids are decoded by the inverse mapping of pieces to bytes.

Defined results: a null text counts as the empty text, which has no tokens and decodes to no bytes.
Repeated rows give equal rows; columns other than id and text are not carried. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from segue.llm.common import text_of

#: First of the 256 consecutive characters that stand for the bytes.
BYTE_CHARS = 0x100
#: Most pre-tokens that a worker remembers, and most characters whose pre-tokens it holds at once.
CACHE_ENTRIES, CHUNK_CHARS = 300_000, 1_000_000

OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: on each line a token's bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_chars(raw: bytes) -> str:
    return "".join([chr(BYTE_CHARS + b) for b in raw])


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a vocabulary; the piece of rank r has id r, the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    for token, rank in sorted(ranks.items(), key=itemgetter(1)):
        model.pieces.add(piece=byte_chars(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id = len(ranks), -1, -1
    for spec in (model.normalizer_spec,):
        spec.name = "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return model.SerializeToString()


@lru_cache(1)
def char_classes() -> np.ndarray:
    """By code point: letter, number, white space, the space itself, or other."""
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        kinds[[ord(c) for c in regex.findall(pattern, every)]] = kind
    kinds[0x20] = SPACE
    return kinds


def pretoken_ends(text: str) -> np.ndarray:
    """Where the matches of the byte-level pattern end, in code points.

    The pattern takes, in this order: an apostrophe with s, t, re, ve, m, ll or d; a run of letters, of numbers or of
    other characters, each with one space before it; a run of white space, but for its last character if text follows.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = points.size
    if not size:
        return np.zeros(0, np.int64)
    kind = np.minimum(char_classes()[points], WHITE)
    starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    ends = np.append(starts[1:], size)
    run = kind[starts]
    inner = (run == WHITE) & (ends < size)
    spaced = points[ends - 1] == 0x20
    gives = inner & spaced
    single = ends - starts == 1
    cuts = starts.copy()
    cuts[1:] -= gives[:-1]
    keep = ~(gives & single)
    extra = [ends[inner & ~spaced & ~single] - 1]
    quote = np.flatnonzero((run == OTHER) & single & (points[starts] == 0x27))
    quote = quote[(quote + 1 < run.size)]
    if quote.size:
        quote = quote[(run[quote + 1] == LETTER) & ~((quote > 0) & gives[quote - 1])]
        at = starts[quote + 1]
        length = ends[quote + 1] - at
        one, two = points[at], points[np.minimum(at + 1, size - 1)]
        taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = (length >= 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        taken = np.where(pair, 2, taken)
        keep[quote[taken > 0] + 1] = False
        extra.append((at + taken)[(taken > 0) & (length > taken)])
    cuts = np.sort(np.concatenate([cuts[keep], *extra]))
    return np.append(cuts[1:], size)


def pretokens(text: str) -> list[str]:
    ends = pretoken_ends(text).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def joined(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated slices of flat that begin at starts."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


class Slices:
    """Slices of one flat array by slot; grows at the end."""

    def __init__(self, kind: type):
        self.kind, self.flat, self.starts, self.lengths = kind, np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.flat.size + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slices of the slots, joined; their lengths."""
        lengths = self.lengths[slots]
        return joined(self.flat, self.starts[slots], lengths), lengths


class Slots(dict):
    """Pre-token to slot; a new one gets the next slot."""

    def __missing__(self, token: str) -> int:
        slot = self[token] = len(self)
        return slot


def _lengths(items: Iterable) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64)


def _ends(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each text ends in what its pre-tokens (or ids) were joined to, if it has so many of them."""
    return np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]


class Codec:
    """Encodes pre-tokens with a sentencepiece model, remembering those it has met; decodes by the inverse mapping."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        raw = [bytes([ord(c) - BYTE_CHARS for c in p]) for p in pieces]
        self.bytes_of = Slices(np.uint8)
        self.bytes_of.add(np.frombuffer(b"".join(raw), np.uint8), _lengths(raw))
        digits = [f"{i} " for i in range(len(pieces))]
        self.digits_of = Slices(np.uint8)
        self.digits_of.add(np.frombuffer("".join(digits).encode(), np.uint8), _lengths(digits))
        self.latin = {b: BYTE_CHARS + b for b in range(256)}
        # a pre-token that is itself a token is that token, even if no merges lead to it
        self.whole = {p: [i] for i, (p, got) in enumerate(zip(pieces, self.model.encode(pieces))) if got != [i]}
        self.forget()

    def forget(self) -> None:
        self.slots, self.ids_of = Slots(), Slices(np.int32)

    def _learn(self, new: list[str]) -> None:
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.latin) for t in new]
        ids = self.model.encode(mapped)
        if self.whole:
            ids = [self.whole.get(m, found) for m, found in zip(mapped, ids)]
        self.ids_of.add(np.fromiter(chain.from_iterable(ids), np.int32), _lengths(ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For chunks of the texts: the ids of all, and how many each text has."""
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_CHARS or i + 1 == len(texts):
                yield self._ids([pretokens(t) for t in texts[start : i + 1]])
                start, size = i + 1, 0

    def _ids(self, held: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > CACHE_ENTRIES:
            self.forget()
        old = len(self.slots)
        counts = _lengths(held)
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(held)), np.int64, int(counts.sum()))
        self._learn(list(islice(reversed(self.slots), len(self.slots) - old))[::-1])
        ids, lengths = self.ids_of.take(slots)
        return ids, np.diff(_ends(lengths, counts), prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
        """The bytes of each of several texts."""
        return self._each(self.bytes_of, ids, counts, 0)

    def digits(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
        """The decimal ids of each of several texts, joined by single spaces."""
        return self._each(self.digits_of, ids, counts, 1)

    @staticmethod
    def _each(slices: Slices, ids: np.ndarray, counts: np.ndarray, off: int) -> Iterator[memoryview]:
        flat, lengths = slices.take(ids)
        view, start = memoryview(flat), 0
        for end in _ends(lengths, counts).tolist():
            yield view[start : max(start, end - off)]
            start = end


@lru_cache(2)
def _codec(proto: bytes) -> Codec:
    return Codec(proto)


def _encoded(batches: Iterator[pa.RecordBatch], proto: bytes, full: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(proto)
    for batch in batches:
        sizes, first, second = [], [], []
        for ids, counts in codec.encode(batch.column(1).to_pylist()):
            sizes.append(counts)
            if full:
                first.append(ids)
                continue
            first += [hashlib.sha256(x).hexdigest() for x in codec.digits(ids, counts)]
            second += [hashlib.sha256(x).hexdigest() for x in codec.decode(ids, counts)]
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        if full:
            flat = np.concatenate(first) if first else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["k", "n", "i", "d"])


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias(text_col)).mapInArrow(partial(_encoded, proto=model_proto(read_ranks(ranks_path)), full=True), f"`{id_col}` {kind}, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], proto: bytes) -> Iterator[pa.RecordBatch]:
    codec = _codec(proto)
    for batch in batches:
        found = [None if ids is None else np.array(ids, np.int64) for ids in batch.column(1).to_pylist()]
        out = [None if ids is None else bytes(next(codec.decode(ids, np.array([ids.size])))) for ids in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["k", "b"])


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary): the bytes that the column ids stands for; null ids give null."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(partial(_decoded, proto=model_proto(read_ranks(ranks_path))), f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and decoded again from its ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_of(text_col).alias(text_col)).mapInArrow(partial(_encoded, proto=model_proto(read_ranks(ranks_path)), full=False), schema)
