"""Corpus tables: filters, search, previews, counts and set-based maintenance.

Frames have the columns id, texto, fonte, categoria, adicionado, usado_treino. Every operator is a DataFrame expression;
orders always end with id, so results are total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.session import materialize


def pending_in_category(corpus: DataFrame, category: str) -> DataFrame:
    """Rows of a category not yet used; both predicates reach the scan."""
    return corpus.filter((F.col("categoria") == category) & (F.col("usado_treino") == 0))


def min_chars(corpus: DataFrame, n: int) -> DataFrame:
    return corpus.filter(F.length("texto") >= n)


def search(df: DataFrame, column: str, term: str, limit: int, newest: str = "id") -> DataFrame:
    """The newest rows that hold term (A to Z in any case), at most limit: the search report's size."""
    return df.filter(T.like_any_case(F.col(column), term)).orderBy(F.col(newest).desc_nulls_last(), F.col("id").desc()).limit(limit)


def recent_preview(corpus: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows with the first 150 characters."""
    return corpus.orderBy(F.col("id").desc()).limit(min(limit, 500)).select("id", T.shorten(F.col("texto"), 150, "…").alias("previa"), "fonte", "categoria")


def list_preview(corpus: DataFrame, limit: int = 20) -> DataFrame:
    """Newest rows on one line: 45 characters of text, 23 of the source's base name."""
    flat = F.regexp_replace("texto", r"[\r\n]", " ")
    base = F.substring_index(F.coalesce("fonte", F.lit("")), "/", -1)
    return corpus.orderBy(F.col("id").desc()).limit(limit).select("id", T.shorten(flat, 45).alias("previa"), F.substring(base, 1, 23).alias("origem"))


def status_totals(corpus: DataFrame) -> DataFrame:
    used = F.coalesce(F.col("usado_treino"), F.lit(0)) == 1
    return corpus.agg(F.count("*").alias("total"), F.count_if(used).alias("treinados"), F.count_if(~used).alias("pendentes"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k largest groups, ties by name."""
    return count_by(df, column).orderBy(F.col("n").desc(), F.col(column).asc_nulls_first()).limit(k)


def without_source_like(corpus: DataFrame, part: str) -> DataFrame:
    """What a delete by part of the source leaves."""
    return corpus.filter(~F.coalesce(T.like_any_case(F.col("fonte"), part), F.lit(False)))


def without(corpus: DataFrame, column: str, value) -> DataFrame:
    """What a delete by an exact value leaves."""
    return corpus.filter(~F.col(column).eqNullSafe(F.lit(value)))


def mark_used(corpus: DataFrame, ids: DataFrame | None = None, category: str | None = None, source: str | None = None) -> DataFrame:
    """usado_treino set to 1 for the given ids (a frame with the column id), part of the source, or category."""
    if source is not None:
        hit = F.coalesce(T.like_any_case(F.col("fonte"), source), F.lit(False))
        return corpus.withColumn("usado_treino", F.when(hit, 1).otherwise(F.col("usado_treino")))
    if ids is not None:
        hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
        return corpus.join(hit, "id", "left").withColumn("usado_treino", F.when(F.col("__hit"), 1).otherwise(F.col("usado_treino"))).drop("__hit")
    return corpus.withColumn("usado_treino", F.when(F.col("categoria") == category, 1).otherwise(F.col("usado_treino")))


def export_projection(corpus: DataFrame, category: str | None = None) -> DataFrame:
    return (corpus if category is None else corpus.filter(F.col("categoria") == category)).select("texto", "fonte", "categoria")


def multi_get(corpus: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of the given ids, pos being the place asked for."""
    wanted = corpus.sparkSession.createDataFrame([(p, i) for p, i in enumerate(ids)], "pos int, id long")
    return corpus.join(F.broadcast(wanted) if len(ids) <= 100_000 else wanted, "id").select("pos", "id", "texto")


def stripped(corpus: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """texto stripped, cut at `most` characters, rows under `least` dropped: what the ingest paths do before comparing."""
    clean = T.strip_column(F.col("texto"))
    out = corpus.withColumn("texto", clean).filter(F.length("texto") >= least)
    return out.withColumn("texto", F.substring("texto", 1, most)) if most else out


def first_of_each(df: DataFrame, key: Column, order: str = "id") -> DataFrame:
    """The first row of each key. Aggregates to the least order value and joins back, so a hot key is no task's list."""
    first = df.withColumn("__key", key).groupBy("__key").agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


#: Hashes sent to every task by a broadcast, at most; above, the same join is shuffled.
BROADCAST_HASHES = 2_000_000


def insert_ignore(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that an insert would add: one per text, none that exists.

    What exists is read where it lies: only its rows whose hash is among those of the new ones (sent to it if within the bound)
    are moved, and those are compared by the whole text.
    """
    fresh = first_of_each(new, F.struct(F.xxhash64("texto").alias("h"), F.col("texto"))).withColumn("__h", F.xxhash64("texto"))
    hashes = new.select(F.xxhash64("texto").alias("__h")).distinct()
    if hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    known = existing.select(F.xxhash64("texto").alias("__h"), "texto").join(hashes, "__h", "left_semi").distinct()
    return fresh.join(known, ["__h", "texto"], "left_anti").drop("__h")


def pending_topics(topics: DataFrame, corpus: DataFrame, prefix: str = "wikipedia:") -> DataFrame:
    """Topics with no row of their source yet."""
    done = corpus.select(F.col("fonte").alias("__f")).filter("__f is not null").distinct()
    return topics.withColumn("__f", F.concat(F.lit(prefix), F.col("topico"))).join(done, "__f", "left_anti").drop("__f")


def ordered_unique(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first spelling of each value, compared stripped and in lower case."""
    key = F.lower(T.strip_column(F.col(column)))
    return df.filter(F.col(column).isNotNull()).groupBy(key.alias("chave")).agg(F.min_by(column, order).alias("valor"), F.min(order).alias("primeiro"))


def paragraphs(df: DataFrame, id_col: str, text_col: str, longer_than: int = 10) -> DataFrame:
    """Blank-line-separated blocks, their lines stripped and joined with a space."""
    blocks = F.split(F.regexp_replace(text_col, "\r", ""), r"\n[ \t]*\n")
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\t", " "))), lambda x: x != ""), " "))
    return df.select(F.col(id_col).alias("id"), F.posexplode(joined).alias("n", "paragrafo")).filter(F.length("paragrafo") > longer_than)


def good_paragraph(c: Column, least: int = 80, letters: float = 0.6) -> Column:
    return (F.length(c) >= least) & ~c.startswith("|") & ~c.startswith("!") & (T.letter_share(c) > letters)


def first_paragraphs(df: DataFrame, id_col: str, text_col: str, longer_than: int = 50, most: int = 5) -> DataFrame:
    """At most the first five paragraphs of each text: the fallback of the article feeder."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text_col, "\r", ""), r"\n\n"), lambda x: F.trim(x)), lambda x: F.length(x) > longer_than)
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.slice(parts, 1, most)).alias("n", "paragrafo"))


def pages(corpus: DataFrame, size: int) -> DataFrame:
    """pagina of each row in id order."""
    return ranked(corpus, ["id"]).withColumn("pagina", F.expr(f"cast((rank - 1) div {size} as long)"))


def ranked(df: DataFrame, order: list[str], name: str = "rank", sums: str | None = None) -> DataFrame:
    """Row number by `order`, which must be total; with sums also __before, the sum of that column over the rows before.

    Rows are range-partitioned and sorted; a row's place in its partition and the sizes of the partitions before (one number
    each) give its rank, so no window holds more than those sizes. Running sums are taken within a partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked").withColumn("__part", F.shiftright("__at", 33))
    total = F.sum(sums) if sums else F.lit(0)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n_rows"), (total if sums else F.max(total)).alias("__sum"))
    prior = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n_rows").over(prior), F.lit(0)).alias("__start"), F.coalesce(F.sum("__sum").over(prior), F.lit(0)).alias("__base")))
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(starts, "__part").withColumn(name, F.col("__start") + row + 1)
    if sums:
        here = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__before", F.col("__base") + F.coalesce(F.sum(sums).over(here), F.lit(0)))
    return out.drop("__at", "__part", "__start", "__base")


def last_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The newest n rows of a log of tokenizer runs (id, data, ...)."""
    return runs.orderBy(F.col("data").desc_nulls_last(), F.col("id").desc()).limit(n)


def generated_texts(df: DataFrame, id_col: str, text_col: str, longer_than: int = 30, most: int = 5) -> DataFrame:
    """id, n, texto: the first pieces of a generated answer that are long enough and no heading of the answer's form."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text_col, "\r", ""), r"\n\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > longer_than) & ~F.upper(x).startswith("TEXTO"))
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.slice(parts, 1, most)).alias("n", "texto"))
