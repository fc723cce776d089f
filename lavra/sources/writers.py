"""Writers of corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators.corpus import export_projection, insert_ignore

CORPUS = "id long, texto string, fonte string, categoria string, adicionado timestamp, usado_treino int"


def export_json(corpus: DataFrame, path: str, category: str | None = None) -> None:
    export_projection(corpus, category).write.mode("overwrite").json(path)


def export_text(corpus: DataFrame, path: str, category: str | None = None) -> None:
    export_projection(corpus, category).select(F.regexp_replace("texto", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus at path; an empty one if there is none yet. A replacement that was cut off between its two renames is undone."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    at, old = Path(path), Path(f"{path.rstrip('/')}.old")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)
    if not fs.exists(at):
        return spark.createDataFrame([], CORPUS)
    return spark.read.schema(CORPUS).parquet(path)


def append_new(spark: SparkSession, new: DataFrame, path: str) -> tuple[int, int]:
    """Append the rows of new whose text is not there yet; returns (added, repeated).

    Ids are positions in the scan, above those in use; they are unique, not dense.
    """
    existing = read_corpus(spark, path)
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = new.withColumn("id", F.monotonically_increasing_id() + base + 1)
    for name, value in (("categoria", F.lit("geral")), ("adicionado", F.current_timestamp()), ("usado_treino", F.lit(0))):
        if name not in numbered.columns:
            numbered = numbered.withColumn(name, value)
    from lavra.session import materialize

    given = materialize(numbered.select("id", "texto", "fonte", "categoria", "adicionado", F.col("usado_treino").cast("int").alias("usado_treino")), "given")
    fresh = materialize(insert_ignore(existing, given), "fresh")
    added, total = fresh.count(), given.count()
    fresh.select("id", "texto", "fonte", "categoria", "adicionado", "usado_treino").write.mode("append").parquet(path)
    return added, total - added


def replace_corpus(spark: SparkSession, corpus: DataFrame, path: str) -> None:
    """Put corpus, which may read path, in place of what is at path: written beside it, then renamed."""
    beside, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    corpus.write.mode("overwrite").parquet(beside)
    fs.delete(Path(old), True)
    if fs.exists(Path(path)):
        fs.rename(Path(path), Path(old))
    fs.rename(Path(beside), Path(path))
    fs.delete(Path(old), True)


def write_paragraphs(paragraphs: DataFrame, path: str, column: str = "paragrafo") -> None:
    """One paragraph on each line."""
    paragraphs.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A vocabulary, merges, index or model table as JSON lines, read again by spark.read.schema(...).json."""
    df.write.mode("overwrite").json(path)
