"""Per-document text statistics, and fixed-threshold rules that tell prose from lists, tables, code and junk.

One scan, no shuffle: the statistics are computed on the code points of a batch at a time. Words, letters and line ends are
those of the folded text. Rules and thresholds are fixed; every rule a text fails is recorded by name, with its source below.

Of these rules, those of word count, word length, symbols, bullets and digits decide (on the test tables all they
fail is no prose, but it is only half of it). Those of line ends, short lines and words without letters are
recorded only: prose broken into short lines, set as a list or full of figures fails them (58 %, 29 % and 99.9 % of what they
fail is no prose). Two rules of our own take the place of the published ones of stop words (two of eight English words) and of
the curly bracket: the share of common words of three languages, and of marks of code. The verdict hangs little on their
thresholds: from 0.15 to 0.30 for common words the share found goes from 98.8 to 100 %, and no prose is failed.

Cases: a null, empty or blank text has zero counts and shares, fails "empty", and has no verdict (is_prose null), as has a
text of fewer than `min_chars` characters. Length does not matter otherwise; ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions import codepoints as cp
from lavra.functions.arrow import SMALL_PIECE, map_arrow
from lavra.llm import lexicon
from lavra.session import spread

# Fixed values.
LINE_END = ".!?…:;\"'”’»)"
BULLETS = "-*•·–—►▪"
CODE_MARKS = "{}[]<>=_;|\\^~$#@+*&"
# Rule, condition under which a text fails it, source of the threshold, whether it decides.
SOURCED = (
    ("few_words", "n_words < 10", "ours, for the 50 words of Rae et al. 2021, appendix A, which short prose fails", True),
    ("word_length", "mean_word_length < 3 or mean_word_length > 10", "Rae et al. 2021, appendix A", True),
    ("symbols", "symbol_share > 0.10", "Rae et al. 2021, appendix A, over characters", True),
    ("bullets", "bullet_line_share > 0.9", "Rae et al. 2021, appendix A", True),
    ("line_ends", "punct_line_share < 0.12", "Penedo et al. 2024", False),
    ("short_lines", "short_line_share > 0.67", "Penedo et al. 2024", False),
    ("digits", "digit_share > 0.20", "ours", True),
    ("alphabetic_words", "alpha_word_share < 0.8", "Rae et al. 2021, appendix A", False),
    ("code_marks", "code_mark_share > 0.03", "ours, for the curly-bracket rule of Raffel et al. 2020", True),
    ("common_words", "common_word_share < 0.27", "ours, for the stop-word rule of Rae et al. 2021", True),
)
RULES = {name: rule for name, rule, _, _ in SOURCED}
NOT_PROSE = tuple(name for name, _, _, decides in SOURCED if decides)
COLUMNS = (
    "n_chars long, n_words long, n_lines long, mean_word_length double, symbol_share double, digit_share double, "
    "punct_line_share double, bullet_line_share double, short_line_share double, alpha_word_share double, code_mark_share double, common_word_share double"
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part), np.float64), where=whole > 0)


def _statistics(texts: pa.Array) -> list[np.ndarray]:
    codes, bounds = cp.decode(texts)
    n = len(texts)
    n_chars = np.diff(bounds)
    codes, bounds = cp.fold(codes, bounds)
    kind = cp.classes(codes)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(n), size)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(sums[bounds])

    visible = per_doc(kind != cp.SPACE)
    digits = per_doc(kind == cp.DIGIT)
    plain = np.isin(codes, np.array([ord(c) for c in ".,;:!?\"'()-"], np.uint32))
    symbols = per_doc((kind == cp.OTHER) & ~plain)
    code = per_doc(np.isin(codes, np.array([ord(c) for c in CODE_MARKS], np.uint32)))
    start, end, row = cp.words(codes, bounds)
    n_words = np.bincount(row, minlength=n)
    letters = np.concatenate([[0], np.cumsum(kind == cp.LETTER, dtype=np.int64)])
    alpha = np.bincount(row[letters[end] > letters[start]], minlength=n)
    length = np.bincount(row, weights=(end - start).astype(float), minlength=n)
    hit = lexicon.lookup(cp.span_hashes(cp.prefix_hash(codes), start, end))[0] if len(start) else np.zeros(0, bool)
    common = np.bincount(row[hit], minlength=n)

    ink = np.flatnonzero(kind != cp.SPACE)
    line = np.cumsum(codes == 10, dtype=np.int64) + doc
    at = line[ink]
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(ink) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(ink) else first
    owner = doc[ink[first]]
    n_lines = np.bincount(owner, minlength=n)
    ends = np.isin(codes[ink[last]], np.array([ord(c) for c in LINE_END], np.uint32))
    opens = np.isin(codes[ink[first]], np.array([ord(c) for c in BULLETS], np.uint32))
    short = (ink[last] - ink[first] + 1) < 30

    def lines(mask: np.ndarray) -> np.ndarray:
        return _share(np.bincount(owner[mask], minlength=n), n_lines)

    return [
        n_chars, n_words, n_lines, _share(length, n_words), _share(symbols, visible), _share(digits, visible),
        lines(ends), lines(opens), lines(short), _share(alpha, n_words), _share(code, visible), _share(common, n_words),
    ]


def text_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the statistics of each row."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off, part in cp.pieces(batch.column("text"), SMALL_PIECE):
                stats = _statistics(part)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(off, len(part)), *map(pa.array, stats)], ["id", *names])

    id_type = texts.schema["id"].dataType.simpleString()
    return map_arrow(spread(texts), run, f"id {id_type}, {COLUMNS}")


def judge(stats: DataFrame, min_chars: int = 40) -> DataFrame:
    """Adds failed (names of the rules a text fails, in order) and is_prose."""
    reasons = [F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]
    failed = F.array_compact(F.array(F.when(F.col("n_words") == 0, F.lit("empty")), *reasons))
    bad = " or ".join(f"({RULES[r]})" for r in NOT_PROSE)
    return stats.withColumn("failed", failed).withColumn("is_prose", F.when(F.col("n_chars") >= min_chars, ~F.expr(bad)))
