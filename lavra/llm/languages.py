"""Language of a text by its character trigrams: a naive Bayes classifier fitted on labelled rows.

Letters are folded; a trigram is three characters of a to z, any other letter, or the gap between words, of which the middle is
a letter. Counts of each language are summed in Spark into a table of fixed size, so nothing but that table reaches the driver.
Labels may be partly wrong: the counts of many texts outweigh them. A text is of the language that makes its trigrams most
likely; it is "und" if it has none, or if it is of LONG trigrams or more and they are less likely than those of all but
ODD of the texts the classifier was fitted on.

Cases: null, empty and letterless texts are "und"; labels are compared trimmed and in lower case, others than those of SPELLINGS
take no part; without labelled rows every text is "und"; rows and long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions import codepoints as cp
from lavra.functions.arrow import SMALL_PIECE, map_arrow
from lavra.functions.text import fold_column, strip_column

# Spellings of the languages' names, folded.
SPELLINGS = {
    "pt": ("pt", "pt-br", "pt_br", "pt-pt", "por", "portugues", "portuguese"),
    "en": ("en", "en-us", "en_us", "en-gb", "eng", "ingles", "english"),
    "es": ("es", "es-es", "es_es", "es-mx", "spa", "espanhol", "espanol", "spanish", "castellano"),
}
LANGUAGES = tuple(SPELLINGS)
SIDE = 28
TRIGRAMS = SIDE**3
#: Different labelled texts the classifier is fitted on, about, of each language.
SAMPLE = 3000
LONG = 40
ODD = 0.005


@dataclass
class Model:
    """log_likelihood of each trigram by language, and the least mean of a long text."""

    log_likelihood: np.ndarray
    floor: float


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each trigram, and the text it stands in."""
    codes, bounds = cp.fold(*cp.decode(texts))
    if len(codes) < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = cp.classes(codes) == cp.LETTER
    symbol = np.where(letter, np.where((codes >= 97) & (codes <= 122), codes.astype(np.int64) - 96, SIDE - 1), 0)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before, after = np.zeros_like(symbol), np.zeros_like(symbol)
    before[1:] = np.where(doc[1:] == doc[:-1], symbol[:-1], 0)
    after[:-1] = np.where(doc[1:] == doc[:-1], symbol[1:], 0)
    at = np.flatnonzero(symbol)
    return (before[at] * SIDE + symbol[at]) * SIDE + after[at], doc[at]


def _scores(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log likelihoods of each text by language, and its number of trigrams."""
    t, doc = _trigrams(texts)
    n = np.bincount(doc, minlength=len(texts))
    return np.stack([np.bincount(doc, weights=row[t], minlength=len(texts)) for row in table], axis=1), n


def fit(labelled: DataFrame, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """A classifier from about `sample` different texts of each language, or all if there are fewer, chosen by a hash of the text."""
    name = fold_column(strip_column(F.col(label_col)))
    label = F.lit(None).cast("int")
    for k, names in enumerate(SPELLINGS.values()):
        label = F.when(name.isin(*names), k).otherwise(label)
    rows = labelled.select(label.alias("label"), F.col(text_col).cast("string").alias("text")).filter("label is not null and text is not null")
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    # Of each language the share of different texts, by hash, that makes about the sample.
    known = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    wanted = F.lit(False)
    for k, n in known.items():
        wanted = wanted | ((F.col("label") == k) & (F.col("hash") < int(min(1.0, sample / max(n, 1)) * (1 << 30))))
    chosen = rows.filter(wanted).groupBy("label", F.xxhash64("text").alias("hash")).agg(F.any_value("text").alias("text")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), TRIGRAMS), np.int64)
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for off, part in cp.pieces(batch.column("text"), SMALL_PIECE):
                t, doc = _trigrams(part)
                sums += np.bincount(labels[off + doc] * TRIGRAMS + t, minlength=sums.size).reshape(sums.shape)
        for k, row in enumerate(sums):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["label", "counts"])

    counts = np.ones((len(LANGUAGES), TRIGRAMS))
    chosen = chosen.cache()
    try:
        for r in map_arrow(chosen.coalesce(len(LANGUAGES)), count, "label int, counts binary").collect():
            counts[r.label] += np.frombuffer(bytes(r.counts), np.int64)
        table = np.log(counts / counts.sum(axis=1, keepdims=True))

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, part in cp.pieces(batch.column("text"), SMALL_PIECE):
                    score, n = _scores(part, table)
                    yield pa.RecordBatch.from_arrays([pa.array(score.max(axis=1)[n >= LONG] / n[n >= LONG])], ["mean"])

        floor = map_arrow(chosen.select("text"), means, "mean double").agg(F.percentile("mean", F.lit(ODD))).first()[0]
    finally:
        chosen.unpersist()
    return Model(table, -np.inf if floor is None else floor)


def languages(texts: pa.Array, model: Model) -> np.ndarray:
    """Language of each text of a column piece; ties to the first listed."""
    score, n = _scores(texts, model.log_likelihood)
    odd = (n == 0) | ((n >= LONG) & (score.max(axis=1) < model.floor * n)) | np.isinf(model.floor)
    return np.array([*LANGUAGES, "und"], object)[np.where(odd, len(LANGUAGES), score.argmax(axis=1))]
