"""Training batches: shuffles, batch numbers, framed rows, padding and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.operators.corpus import ranked

PAD, BOS, EOS, UNK = 0, 1, 2, 3


def page_shuffle(pages: DataFrame, seed: int, epoch: int) -> DataFrame:
    """posicao within its page: a permutation by hash, another one each epoch. A page has a fixed size, so a window is bounded."""
    order = F.xxhash64(F.col("id"), F.lit(seed + epoch))
    return pages.withColumn("posicao", F.row_number().over(Window.partitionBy("pagina").orderBy(order, "id")).cast("long"))


def global_shuffle(corpus: DataFrame, seed: int, epoch: int) -> DataFrame:
    """posicao in a permutation of all rows by hash, another one each epoch."""
    spread = corpus.withColumn("__key", F.xxhash64(F.col("id"), F.lit(seed + 997 * epoch)))
    return ranked(spread, ["__key", "id"], "posicao").drop("__key")


def batch_numbers(pages: DataFrame, batch: int, page: int | None = None) -> DataFrame:
    """lote of each row, counted over pages; a batch never spans two pages.

    With the size of a page (all but the last have it) and rows numbered by `rank`, the number follows from the rank alone.
    Without, rows are counted in their page, and pages by their sizes, one number each.
    """
    if page and "rank" in pages.columns:
        return pages.withColumn("lote", F.expr(f"cast((rank - 1) div {page} * {-(-page // batch)} + pmod(rank - 1, {page}) div {batch} + 1 as long)"))
    w = Window.partitionBy("pagina").orderBy("id")
    inside = pages.withColumn("__k", F.floor((F.row_number().over(w) - 1) / batch))
    per_page = inside.groupBy("pagina").agg((F.max("__k") + 1).alias("__n"))
    before = ranked(per_page, ["pagina"], "__at", sums="__n").select("pagina", "__before")
    return inside.join(before, "pagina").withColumn("lote", (F.col("__k") + F.col("__before") + 1).cast("long")).drop("__k", "__before")


def pad_or_cut(ids: Column, n: int, pad: int = PAD) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def char_ids(c: Column) -> Column:
    """Ids of a mock tokenizer: code point modulo 250, plus 4."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: (F.ascii(x) % 250 + 4).cast("int"))


def training_rows(df: DataFrame, ids: Column, length: int) -> DataFrame:
    """input_ids, target_ids (shifted by one) and attention_mask of each row, framed once with BOS and EOS."""
    framed = F.concat(F.array(F.lit(BOS)), F.slice(ids, 1, length - 1), F.array(F.lit(EOS)))
    whole = pad_or_cut(framed, length + 1)
    out = df.withColumn("__w", whole)
    return out.withColumn("input_ids", F.slice("__w", 1, length)).withColumn("target_ids", F.slice("__w", 2, length)).withColumn("attention_mask", F.transform("input_ids", lambda x: x != PAD)).drop("__w")


def length_statistics(lengths: DataFrame, column: str) -> DataFrame:
    """Mean, quantiles (linear, cut to whole numbers) and the suggested length. Percentiles are exact, over value counts."""

    def whole(p: float) -> Column:
        return F.floor(F.round(F.percentile(column, F.lit(p)), 6)).cast("long")

    return lengths.agg(
        F.round(F.avg(column), 6).alias("media"), whole(0.5).alias("mediana"), F.min(column).cast("long").alias("minimo"), F.max(column).cast("long").alias("maximo"),
        whole(0.75).alias("p75"), whole(0.9).alias("p90"), whole(0.95).alias("p95"), whole(0.99).alias("p99"),
    )


def length_histogram(lengths: DataFrame, column: str, width: int = 16) -> DataFrame:
    """Counts per bin of a fixed width; the largest value belongs to the last full bin if it opens one of its own."""
    top = lengths.agg(F.max(column)).scalar()
    last = F.greatest(F.lit(0), F.floor((top - 1) / width))
    return lengths.select(F.least(F.floor(F.col(column) / width), last).cast("long").alias("faixa")).groupBy("faixa").agg(F.count("*").alias("n"))
