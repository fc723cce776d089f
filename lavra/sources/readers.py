"""Readers of example texts: (texto, fonte) rows from files of several formats."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import strip_column

# Names of text columns and keys, of question and answer keys, and of list keys, by precedence.
TEXT_COLUMNS = ["texto", "text", "content", "conteudo", "message", "frase"]
PAIRS = [("input", "output"), ("pergunta", "resposta")]
LIST_KEYS = ["exemplos", "textos", "dados", "data", "texts", "items"]
EXTENSIONS = ("txt", "json", "csv", "md", "markdown")


def _source() -> Column:
    return F.col("_metadata.file_path").alias("fonte")


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumn("texto", strip_column(F.col("texto"))).filter("texto <> ''")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One text per non-blank line."""
    return _clean(spark.read.text(path).select(F.col("value").alias("texto"), _source()))


def json_texts(value: Column) -> Column:
    """Array of texts of a JSON document: a list of strings or objects, or an object with such a list under a known key.

    An object gives its first known text, and its question and answer joined by a line end. What is not JSON gives nothing.
    """
    parsed = F.try_parse_json(value)
    lists = [F.try_variant_get(parsed, "$", "array<variant>")] + [F.try_variant_get(parsed, f"$.{k}", "array<variant>") for k in LIST_KEYS]

    def of(item: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_variant_get(item, f"$.{name}", "string")

        plain = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        pair = F.coalesce(*[F.concat(field(q), F.lit("\n"), field(a)) for q, a in PAIRS])
        return F.array_compact(F.array(F.coalesce(plain, *[field(k) for k in TEXT_COLUMNS]), pair))

    return F.flatten(F.transform(F.coalesce(*lists, F.array().cast("array<variant>")), of))


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", _source())
    return _clean(files.select(F.explode(json_texts(F.col("value"))).alias("texto"), "fonte"))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first known text column in any case, else the first column; short rows are skipped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    known = {c.strip().lower(): c for c in df.columns}
    column = next((known[k] for k in TEXT_COLUMNS if k in known), df.columns[0] if df.columns else None)
    if column is None:
        return spark.createDataFrame([], "texto string, fonte string")
    return _clean(df.select(F.col(f"`{column}`").alias("texto"), _source()))


def read_markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blank-line-separated blocks of more than ten characters."""
    from lavra.operators.corpus import paragraphs

    files = spark.read.text(path, wholetext=True).select("value", _source())
    return paragraphs(files.withColumnRenamed("fonte", "id"), "id", "value").select(F.col("paragrafo").alias("texto"), F.col("id").alias("fonte"))


READERS = {"txt": read_lines, "json": read_json, "csv": read_csv, "md": read_markdown, "markdown": read_markdown}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """By extension; unknown ones as lines."""
    return READERS.get(PurePosixPath(path).suffix.lower().lstrip("."), read_lines)(spark, path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Every known file below a folder. CSV files of one call share a header."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    walk = fs.listFiles(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        ext = PurePosixPath(name).suffix.lower().lstrip(".")
        if ext in READERS:
            found.setdefault(ext, []).append(name)
    out = spark.createDataFrame([], "texto string, fonte string")
    for ext in sorted(found):
        if ext == "csv":
            for name in sorted(found[ext]):
                out = out.unionByName(read_csv(spark, name))
        else:
            out = out.unionByName(READERS[ext](spark, sorted(found[ext])))
    return out


def literal(spark: SparkSession, text: str, source: str = "linha_de_comando") -> DataFrame:
    return _clean(spark.createDataFrame([(text, source)], "texto string, fonte string"))


def read_wiki_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """titulo, n, paragrafo of each article of an XML dump; the file is split by page."""
    from lavra.operators.markup import wiki_paragraphs

    schema = "title string, ns string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    articles = pages.filter("ns = '0'").select(F.col("title").alias("id"), F.col("revision.text._VALUE").alias("texto"))
    if limit:
        articles = articles.limit(limit)
    return wiki_paragraphs(articles, "id", "texto").withColumnRenamed("id", "titulo")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """nome, bytes, md5 of each image file."""
    from lavra.operators.images import valid_extension

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(valid_extension(F.col("path"))).select("path", "length", F.md5("content").alias("md5"), "content")
