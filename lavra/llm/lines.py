"""Lines repeated across one source's documents.

A line's key is the hash of the letters of its folded text; lines with fewer than `min_letters` letters have none. Keys are
counted once per document and source (pre-aggregated before the shuffle), within the source and outside it. Dunning's
log-likelihood ratio compares both rates; Benjamini-Hochberg over all lines that stand in two documents or more of a source
sets the cut at false-discovery rate q, from exact counts of p-values in fine bins rounded up (so never above q). Lines in
at least `min_rows` documents of a source are "repeated"; those whose excess over the outside is significant are "excess".

Cases: null or blank sources, null and empty texts take no part and stay unchanged; a line that a document repeats counts
once but is listed at each position; rows repeated under new ids count each. Very long texts and single lines are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions import codepoints as cp
from lavra.functions.arrow import SMALL_PIECE, lists, map_arrow
from lavra.session import materialize, spread

LLR_BIN = 0.125
LLR_TOP = 4000.0
#: Keys kept in memory by a broadcast, at most; above, the same join is shuffled.
BROADCAST_KEYS = 1_000_000


def _line_keys(texts: pa.Array, min_letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of keyed lines of each text, and line number and key of each of them."""
    codes, bounds = cp.fold(*cp.decode(texts))
    letter = cp.classes(codes) == cp.LETTER
    breaks = codes == 10
    edge = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(breaks) + 1]))
    edge = edge[edge < len(codes)]
    ends = np.append(edge[1:], len(codes))
    count = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    a, b = count[edge], count[ends]
    doc = np.searchsorted(bounds, edge, side="right") - 1
    before = np.concatenate([[0], np.cumsum(breaks, dtype=np.int64)])
    number = before[edge] - before[bounds[doc]] + 1
    keep = b - a >= min_letters
    key = cp.span_hashes(cp.prefix_hash(codes[letter]), a[keep], b[keep]) if keep.any() else np.zeros(0, np.uint64)
    return np.bincount(doc[keep], minlength=len(texts)), number[keep].astype(np.int32), key.view(np.int64)


def keyed_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_letters: int = 30) -> DataFrame:
    """id, source (trimmed, lower case), lines and keys (arrays in step) of each row with a source."""
    clean = F.expr(f"lower(regexp_replace(`{source_col}`, '(?U)^\\\\s+|\\\\s+$', ''))")
    rows = df.select(F.col(id_col).alias("id"), clean.alias("source"), F.col(text_col).cast("string").alias("text")).filter("source <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off, part in cp.pieces(batch.column("text"), SMALL_PIECE):
                n, number, key = _line_keys(part, min_letters)
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(off, len(part)) for c in ("id", "source")] + [lists(pa.array(number), at), lists(pa.array(key), at)],
                    ["id", "source", "lines", "keys"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    return map_arrow(spread(rows), run, f"id {id_type}, source string, lines array<int>, keys array<long>")


def _llr(a: str, b: str, m: str, n: str) -> str:
    """Log-likelihood ratio of a in m against b in n, as SQL."""
    p = f"(({a} + {b}) / ({m} + {n}))"

    def term(k: str, of: str) -> str:
        return (
            f"(case when {k} > 0 then {k} * ln(({k} / {of}) / {p}) else 0 end"
            f" + case when {of} > {k} then ({of} - {k}) * ln((({of} - {k}) / {of}) / (1 - {p})) else 0 end)"
        )

    return f"case when {n} > 0 and {p} < 1 then 2 * ({term(a, m)} + {term(b, n)}) else 0.0D end"


def line_excess(lines: DataFrame, min_rows: int = 10, q: float = 0.01) -> DataFrame:
    """source, key, n_in, rows_in, n_out, rows_out, llr, excess for every line in at least min_rows documents of its source."""
    rows = lines.groupBy("source").agg(F.count("*").cast("double").alias("rows_in"))
    total = float(rows.agg(F.sum("rows_in")).first()[0] or 0)
    counted = lines.select("source", F.explode(F.array_distinct("keys")).alias("key")).groupBy("source", "key").agg(F.count("*").cast("double").alias("n_in"))
    counted = materialize(counted, "line-counts")
    again = counted.filter("n_in >= 2")
    everywhere = counted.join(again.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n_in").alias("n_all"))
    tested = (
        again.join(everywhere, "key")
        .join(rows, "source")
        .withColumn("n_out", F.expr("n_all - n_in"))
        .withColumn("rows_out", F.lit(total) - F.col("rows_in"))
        .withColumn("llr", F.expr(_llr("n_in", "n_out", "rows_in", "rows_out")))
        .withColumn("more", F.expr("n_in * rows_out > n_out * rows_in"))
    )
    tested = materialize(tested.select("source", "key", "n_in", "rows_in", "n_out", "rows_out", "llr", "more"), "line-tests")
    bins = tested.groupBy(F.expr(f"case when more then cast(least(llr, {LLR_TOP}) / {LLR_BIN} as int) else -1 end").alias("bin")).agg(F.count("*").alias("n"))
    cut = _benjamini_hochberg({r.bin: r.n for r in bins.collect()}, q)
    return (
        tested.filter(F.col("n_in") >= min_rows)
        .withColumn("excess", F.expr(f"more and cast(least(llr, {LLR_TOP}) / {LLR_BIN} as int) >= {cut}"))
        .select("source", "key", *[F.col(c).cast("long").alias(c) for c in ("n_in", "rows_in", "n_out", "rows_out")], "llr", "excess")
    )


def _benjamini_hochberg(bins: dict[int, int], q: float) -> int:
    """Lowest bin of the ratio that is rejected; p-values are those of the lower edges, so too high rather than too low."""
    tests = sum(bins.values())
    cut, above = int(LLR_TOP / LLR_BIN) + 1, 0
    for k in sorted((b for b in bins if b >= 0), reverse=True):
        above += bins[k]
        if math.erfc(math.sqrt(k * LLR_BIN / 2)) <= q * above / tests:
            cut = k
    return cut


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_letters: int = 30, min_rows: int = 10, q: float = 0.01) -> DataFrame:
    """id, line, excess: each position of a line that stands in at least min_rows documents of its source."""
    lines = materialize(keyed_lines(df, id_col, source_col, text_col, min_letters), "lines")
    found = line_excess(lines, min_rows, q)
    found = materialize(found.select(F.xxhash64("source", "key").alias("k"), "excess"), "repeated")
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    at = lines.select("id", "source", F.explode(F.arrays_zip("lines", "keys")).alias("x")).select("id", F.col("x.lines").alias("line"), F.xxhash64("source", "x.keys").alias("k"))
    return at.join(found, "k").select("id", "line", "excess")


def strip_lines(df: DataFrame, id_col: str, text_col: str, positions: DataFrame) -> DataFrame:
    """df with the given (id, line) taken out of the text; the other lines keep their order and bytes."""
    drop = positions.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line").alias("__drop"))
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (l, i) -> not array_contains(__drop, i + 1)), '\\n')")
    joined = df.join(drop, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(kept)).drop("__id", "__drop")
