"""Token counts under an existing byte-level BPE vocabulary.

A text is cut into pieces. Each distinct piece is merged once: its symbols form a linked list, a priority queue holds the
mergeable neighbours by rank, and the surviving symbols are counted. Texts then sum the counts of their pieces.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import codepoints as cp
from lavra.functions.arrow import SMALL_PIECE, map_arrow
from lavra.functions.text import fold_column, strip_column
from lavra.llm import languages, lexicon
from lavra.llm.shingles import word_hashes
from lavra.session import spread

DEFAULT_VOCABULARY = os.path.join(os.environ.get("LAVRA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
#: Distinct pieces a worker remembers by hash, at most; then it starts anew. Changes only the speed.
REMEMBERED = 1 << 20


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def send_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the driver's vocabulary file to all workers, once per session; returns the name they find it by."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_lavra_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


LETTERS, NUMBERS, SPACES, MARKS = 0, 1, 2, 3
# White space of Unicode, and the letters that may follow an apostrophe as one piece.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kind(c: int) -> int:
    group = unicodedata.category(chr(c))[0]
    return SPACES if c in WHITE else LETTERS if group == "L" else NUMBERS if group == "N" else MARKS


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.array([_kind(c) for c in range(cp.BMP)], np.uint8)


def piece_bounds(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each piece: an apostrophe with its contraction; a run of letters, of numbers or of other marks,
    each with one space before it; or white space, of which the last character before something else stands alone."""
    n = len(codes)
    kind = _kinds()[np.minimum(codes, cp.BMP - 1)]
    for c in np.unique(codes[codes >= cp.BMP]) if n and codes.max() >= cp.BMP else ():
        kind[codes == c] = _kind(int(c))
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    space = kind == SPACES
    # Places after white space, in the same text.
    after = np.flatnonzero(run[:n] & ~first[:n] & ~space)
    after = after[space[after - 1]]
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    quote = np.flatnonzero((codes == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == LETTERS)]
    taken = np.zeros(len(quote), bool)
    for tail in CONTRACTIONS:
        ok = ~taken & (quote + len(tail) < n)
        for k, c in enumerate(tail):
            at = np.minimum(quote + 1 + k, n - 1)
            ok &= (codes[at] == ord(c)) & ((k == 0) | ~first[at])
        taken |= ok
        at = quote[ok]
        start[at + 1] = False
        stop = at + 1 + len(tail)
        start[stop[stop < n]] = True
    begin = np.flatnonzero(start)
    return begin, np.append(begin[1:], n), np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(begin, bounds)))


def count_symbols(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols left of a piece when no neighbours can be merged, lowest rank first, leftmost of equal ones."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    left = n
    while queue:
        _, i, e = heappop(queue)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        left -= 1
        if e < n:
            before[e] = i
            r = ranks.get(piece[i : end[e]])
            if r is not None:
                heappush(queue, (r, i, end[e]))
        p = before[i]
        if p >= 0:
            r = ranks.get(piece[p:e])
            if r is not None:
                heappush(queue, (r, p, e))
    return left


class PieceCounts:
    """Symbols of each distinct piece, filled as pieces are met, and sums of them by text."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.known: dict[int, int] = {}

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a column piece."""
        codes, bounds = cp.decode(texts)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        begin, end, row = piece_bounds(codes, bounds)
        keys, at, inverse = np.unique(cp.span_hashes(cp.prefix_hash(codes), begin, end), return_index=True, return_inverse=True)
        names = keys.tolist()
        symbols = [self.known.get(k) for k in names]
        missing = [i for i, x in enumerate(symbols) if x is None]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
        for i in missing:
            piece = codes[begin[at[i]] : end[at[i]]].tobytes().decode("utf-32-le", "surrogatepass")
            symbols[i] = self.known[names[i]] = count_symbols(piece.encode("utf-8", "surrogatepass"), self.ranks)
        return np.bincount(row, weights=np.array(symbols, np.float64)[inverse], minlength=len(texts)).astype(np.int64)


def with_token_counts(df: DataFrame, text_col: str, keep: list[str], path: str = DEFAULT_VOCABULARY, language: bool | languages.Model = False) -> DataFrame:
    """The columns keep, n_tokens (0 for null and empty texts) and, if asked for, language; the text stays behind.

    language is a classifier, or True for a vote of common words.
    """
    name = send_vocabulary(df.sparkSession, path)
    model = language if isinstance(language, languages.Model) else None
    sent, language = df.sparkSession.sparkContext.broadcast(model) if model else None, bool(language)
    rows = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"] + ["n_tokens long"] + ["language string"] * language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(SparkFiles.get(name))
        for batch in batches:
            for off, part in cp.pieces(batch.column("__text"), SMALL_PIECE):
                out = [batch.column(c).slice(off, len(part)) for c in keep]
                out.append(pa.array(counts.of(part)))
                if language:
                    names = languages.languages(part, sent.value) if sent else lexicon.languages(*word_hashes(part), len(part))
                    out.append(pa.array(names.tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens"] + ["language"] * language)

    return map_arrow(spread(rows), run, schema)


def token_budget(df: DataFrame, text_col: str, source_col: str, domain_col: str, path: str = DEFAULT_VOCABULARY, default_domain: str = "geral", model: languages.Model | None = None) -> DataFrame:
    """fonte, idioma, dominio, nivel, n_textos, n_tokens: exact totals of every slice and of each of its three sides.

    nivel names the slice: "fonte", "idioma", "dominio", "fonte+idioma+dominio" or "total"; the other columns are null.
    Sources compare trimmed and in lower case (blank or null: "(sem fonte)"), domains also without accents (blank or null:
    the default one). Language is that of the text by the model, or without one by its common words ("und" if neither says). Null and empty texts count
    as texts of no tokens. Only counts are shuffled, pre-aggregated, so a hot source is no heavier than another.
    """
    source = F.lower(strip_column(F.col(source_col)))
    domain = fold_column(strip_column(F.col(domain_col)))
    rows = df.select(
        F.when(F.coalesce(source, F.lit("")) == "", F.lit("(sem fonte)")).otherwise(source).alias("fonte"),
        F.when(F.coalesce(domain, F.lit("")) == "", F.lit(default_domain)).otherwise(domain).alias("dominio"),
        F.col(text_col).alias("text"),
    )
    counted = with_token_counts(rows, "text", ["fonte", "dominio"], path, language=model or True).withColumnRenamed("language", "idioma")
    slices = counted.groupBy("fonte", "idioma", "dominio").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    sets = slices.groupingSets([["fonte"], ["idioma"], ["dominio"], ["fonte", "idioma", "dominio"], []], "fonte", "idioma", "dominio")
    level = F.expr("case grouping_id() when 3 then 'fonte' when 5 then 'idioma' when 6 then 'dominio' when 0 then 'fonte+idioma+dominio' else 'total' end")
    return sets.agg(level.alias("nivel"), F.sum("n").alias("n_textos"), F.sum("t").alias("n_tokens"))
