"""Operator 9: language identification by compression.

Each language has a zstandard raw-content dictionary cut from a bounded sample
of labelled texts. A text is lower-cased and all of it compressed with every dictionary,
in pieces of :data:`PIECE_BYTES`, as a dictionary saves about the same on any piece: so the
margin does not shrink with the text's length. The language whose dictionary gives the
smallest sum is predicted, and the
prediction is rejected where the margin to the next language is narrow.

The sample is bounded by :data:`SAMPLE_ROWS` texts a language, whatever the corpus's size,
chosen among its distinct texts by their hash. Each gives an equal share of the dictionary, a piece
that may lie anywhere in the text: its place is drawn from the hash, too. The dictionaries
(:data:`DICTIONARY_BYTES` each, at most :data:`MAX_LANGUAGES`) are broadcast.
Prediction is map-only and sees nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and rejected; so is every text if there is nothing to learn from. Ties go to
the language that sorts first, with score 0. With one language only, the score
is 1. Every row gives one row, repeated rows repeat; other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import slices, text_bytes

SAMPLE_ROWS = 128
DICTIONARY_BYTES = 64 << 10
MAX_LANGUAGES = 400
PIECE_BYTES = 16 << 10
MIN_MARGIN = 0.005
UNKNOWN = "und"


def learn(df: DataFrame, key: str, text: str, lang: str, where: Column | None = None) -> dict[str, bytes]:
    """Dictionary content by language, from the labelled rows for which ``where`` holds (``key`` is
    not read: texts are sampled, not rows, so repeated rows change nothing)."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
                     (F.lit(True) if where is None else where).alias("use"))
    rows = rows.where(F.col("use") & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).limit(
        MAX_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # about twice the texts that are used, by hash; the driver takes the first SAMPLE_ROWS of each language
    share = F.create_map(*[x for lng, n in sorted(counts.items()) for x in (F.lit(lng), F.lit(2 * SAMPLE_ROWS / n))])
    chars = F.create_map(*[x for lng, n in sorted(counts.items()) for x in (
        F.lit(lng), F.lit(DICTIONARY_BYTES // min(n, SAMPLE_ROWS)))])
    h = F.shiftrightunsigned(F.xxhash64("text"), 11)
    rows = rows.withColumn("h", h).where(F.col("h") * F.lit(2.0 ** -53) < F.element_at(share, F.col("lang")))
    wide = F.element_at(chars, F.col("lang"))
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - wide, F.lit(0)) + 1).cast("int") + 1
    sample = rows.select("lang", "h", F.substring(F.col("text"), at, wide).alias("piece")).distinct().collect()
    out = {}
    for lng in sorted(counts):
        pieces = [p for _, p in sorted((r["h"], r["piece"]) for r in sample if r["lang"] == lng)][:SAMPLE_ROWS]
        each = DICTIONARY_BYTES // max(1, len(pieces))
        out[lng] = b"\n".join(p.lower().encode()[:each] for p in pieces)[-DICTIONARY_BYTES:]
    return out


def identify(df: DataFrame, key: str, text: str, dictionaries: dict[str, bytes],
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``(key, lang_pred, score, rejected)``; the score is one less the ratio of
    the smallest compressed size to the next, from 0 to 1."""
    kind = df.schema[key].dataType.simpleString()
    predicted = _map_predictions(df.select(F.col(key).alias("key"), F.col(text).alias("text")), 1, dictionaries,
                                 min_margin, f"key {kind}, lang_pred string, score double, rejected boolean", False)
    return predicted.withColumnRenamed("key", key)


def keep_identified(df: DataFrame, text: str, dictionaries: dict[str, bytes],
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df``, same columns, without the rows whose prediction is rejected."""
    return _map_predictions(df, df.columns.index(text), dictionaries, min_margin, df.schema, True)


def _map_predictions(df: DataFrame, at: int, dictionaries: dict[str, bytes], min_margin: float, schema, keep: bool):
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        names, sizes_of = compressors(sent.value)
        for batch in batches:
            texts = text_bytes(batch.column(at))
            for start, stop in slices(texts):
                out = [predict(raw, names, sizes_of, letter, min_margin) for raw in texts[start:stop].to_pylist()]
                part = batch.slice(start, stop - start)
                if keep:
                    yield part.filter(pa.array([not rejected for _, _, rejected in out], pa.bool_()))
                else:
                    lang, score, rejected = (list(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                         pa.array(rejected, pa.bool_())], ["key", "lang_pred", "score", "rejected"])

    return df.mapInArrow(run, schema)


def compressors(dictionaries: dict[str, bytes]) -> tuple[list[str], list]:
    """Languages in order, and for each what compresses with its dictionary."""
    import zstandard as zstd

    # matches from 4 bytes, as words are short; no frame fields that all sizes share
    params = zstd.ZstdCompressionParameters(
        window_log=19, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=16,
        strategy=zstd.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    names, out = sorted(dictionaries), []
    for name in names:
        content = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        out.append(zstd.ZstdCompressor(dict_data=content, compression_params=params).compress)
    return names, out


def predict(raw: bytes, names: list[str], sizes_of: list, letter, min_margin: float) -> tuple[str, float, bool]:
    text = raw.decode()
    if not names or not letter(text):
        return UNKNOWN, 0.0, True
    raw = text.lower().encode()
    pieces = [raw[at:at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
    ranked = sorted((sum(len(compress(p)) for p in pieces), i) for i, compress in enumerate(sizes_of))
    score = 1 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0
    return names[ranked[0][1]], score, score < min_margin
