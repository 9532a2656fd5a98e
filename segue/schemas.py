"""Schemas of what the engine reads, keeps and returns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: A track's descriptive fields, and an occurrence of it in a playlist.
METADATA = struct(track_name=_S, artist_name=_S, artist_uri=_S, album_name=_S, album_uri=_S, duration_ms=_L)
OCCURRENCE = T.StructType([T.StructField("track_uri", _S), *METADATA.fields])
#: A corpus slice file.
SLICE = struct(playlists=T.ArrayType(struct(pid=_L, tracks=T.ArrayType(OCCURRENCE))))
#: A vocabulary row, as exported.
VOCABULARY = T.StructType([*OCCURRENCE.fields, T.StructField("idx", _I), T.StructField("count", _L)])
#: The canonical catalogue table.
TRACK = T.StructType([*VOCABULARY.fields, T.StructField("embedding", T.ArrayType(_D)), T.StructField("artist_key", _S), T.StructField("title_key", _S), T.StructField("artists", T.ArrayType(_S))])
#: Model description.
MODEL = struct(
    backend=_S,
    config=struct(vector_size=_I, window=_I, negative=_I, min_count=_I, epochs=_I, workers=_I, sample=_D, seed=_L, sg=_I),
    stats=struct(vocab_size=_L, corpus_count=_L, corpus_total_words=_L, max_files=_I, max_playlists=_L),
    files=T.MapType(_S, _S),
)
#: Seeds of a recommendation in order, by uri; input lines; texts to match.
SEEDS = struct(ord=_I, track_uri=_S)
LINES = struct(ord=_L, raw=_S, artist=_S, title=_S)
TEXTS = struct(ord=_I, artist=_S, title=_S)
