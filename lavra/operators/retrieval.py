"""Retrieval of text chunks by TF-IDF cosine.

Where the vocabulary and the weights of all queries are within bounds that are counted first, both are sent to the chunks: a
chunk is scored against all queries where it is cut, and only the best of each batch and query are shuffled. Beyond the bounds
postings and norms are tables, and a query's tokens meet postings by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lavra.functions import text as T
from lavra.functions.arrow import map_arrow
from lavra.session import materialize, spread

# Fixed value: letters of a token.
TOKEN = "[a-záéíóúàâêôãõüñçA-Z0-9_]+"


#: Tokens of the vocabulary, and weights of all queries (tokens times queries), that are sent to every task, at most.
SENT_TOKENS = 1_000_000
SENT_WEIGHTS = 1 << 24
#: Products in memory at a time.
PRODUCTS = 1 << 22


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 300, step: int = 150) -> DataFrame:
    """doc_id, chunk_no (from 0), trecho: overlapping stripped windows; the last one reaches the end, blank ones are dropped.

    size is a multiple of step: a text is cut into steps in one pass from the left, and each window joins neighbours.
    """
    if size % step:
        raise ValueError("size must be a multiple of step")
    several = size // step
    cut = spread(df.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("s")).filter("size(s) > 0")
    first = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - (several - 1)))
    windows = F.transform(first, lambda i: T.strip_column(F.array_join(F.slice("s", i, several), "")))
    return cut.select("doc_id", F.posexplode(windows).alias("chunk_no", "trecho")).filter("trecho <> ''")


def tokens(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per token."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN), F.lit(0))).alias("token"))


def term_frequencies(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, token, n, tf: the share of a token among those of its text."""
    found = df.select(*keys, F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN), F.lit(0)).alias("__all"))
    each = found.select(*keys, F.size("__all").alias("__size"), F.explode("__all").alias("token"))
    return each.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.first("__size").alias("__size")).select(*keys, "token", "n", (F.col("n") / F.col("__size")).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def _tokens(column: str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def with_documents(chunk_table: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The chunks with those of docs added; a document that is there already is replaced."""
    new = chunks(docs, id_col, text_col)
    return without_documents(chunk_table, docs.select(F.col(id_col).alias("doc_id"))).unionByName(new)


def without_documents(chunk_table: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks without those of the documents in ids(doc_id)."""
    return chunk_table.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def changed_frequencies(frequencies: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """token, df after chunks were added and removed: only these are read."""

    def of(table: DataFrame, sign: int) -> DataFrame:
        return table.select(F.explode(F.array_distinct(_tokens("trecho"))).alias("token"), F.lit(sign).cast("long").alias("df"))

    each = frequencies.select("token", "df").unionByName(of(added, 1)).unionByName(of(removed, -1))
    return each.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")


def rank_chunks(chunk_table: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = 3) -> DataFrame:
    """query id, rank, doc_id, chunk_no, score: the k best chunks for each query, ties by chunk order."""
    # The empty token stands in every chunk: its frequency is the number of chunks.
    each = chunk_table.select(F.explode(F.array_append(F.array_distinct(_tokens("trecho")), F.lit(""))).alias("token"))
    vocabulary = materialize(each.groupBy("token").agg(F.count("*").alias("df")), "vocabulary")
    asked = materialize(term_frequencies(queries, [query_id], query_text).select(query_id, "token", "tf"), "asked")
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("token") == "", F.col("df"))), F.lit(0))).first()
    n_queries, n_tokens = asked.agg(F.count_distinct(query_id), F.count_distinct("token")).first()
    weights = vocabulary.filter("token <> ''").select("token", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    if size <= SENT_TOKENS and n_queries * n_tokens <= SENT_WEIGHTS:
        scored = _scored_where_cut(chunk_table, asked, weights, query_id, k)
    else:
        scored = _scored_by_join(chunk_table, asked, weights, query_id)
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), "doc_id", "chunk_no")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(query_id, F.col("rank").cast("int").alias("rank"), "doc_id", "chunk_no", "score")


def _scored_by_join(chunk_table: DataFrame, asked: DataFrame, weights: DataFrame, query_id: str) -> DataFrame:
    """query id, doc_id, chunk_no, score of every chunk that shares a token with a query."""
    postings = term_frequencies(chunk_table, ["doc_id", "chunk_no"], "trecho")
    weighted = materialize(postings.join(weights, "token").select("doc_id", "chunk_no", "token", (F.col("tf") * F.col("idf")).alias("w")), "postings")
    norms = weighted.groupBy("doc_id", "chunk_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = asked.join(weights, "token", "left").select(query_id, "token", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("q"))
    asked_norm = asked.groupBy(query_id).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = weighted.join(asked, "token").groupBy(query_id, "doc_id", "chunk_no").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    score = F.round(F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 9), 4)
    return dots.join(norms, ["doc_id", "chunk_no"]).join(asked_norm, query_id).select(query_id, "doc_id", "chunk_no", score.alias("score")).filter("score > 0")


def _scored_where_cut(chunk_table: DataFrame, asked: DataFrame, weights: DataFrame, query_id: str, k: int) -> DataFrame:
    """As _scored_by_join, of each batch of chunks only the k best for each query."""
    rows = asked.join(weights, "token", "left").select(query_id, "token", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("q")).collect()
    names = sorted({r[0] for r in rows}, key=lambda x: (x is not None, x))
    column, line = {n: i for i, n in enumerate(names)}, {t: i for i, t in enumerate(sorted({r.token for r in rows}))}
    q = np.zeros((len(line), len(names)))
    for r in rows:
        q[line[r.token], column[r[0]]] = r.q
    size = np.sqrt((q * q).sum(axis=0))
    spark = chunk_table.sparkSession
    known = weights.toPandas()
    id_kind = to_arrow_type(asked.schema[query_id].dataType)
    sent = spark.sparkContext.broadcast((dict(zip(known.token, known.idf)), line, q, np.where(size > 0, size, np.inf)))
    schema = f"`{query_id}` {asked.schema[query_id].dataType.simpleString()}, doc_id {chunk_table.schema['doc_id'].dataType.simpleString()}, chunk_no int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, line, q, size = sent.value
        for batch in batches:
            n = batch.num_rows
            listed = batch.column("t")
            length = np.diff(listed.offsets.to_numpy())
            coded = listed.flatten().dictionary_encode()
            if not len(coded) or not len(names):
                continue
            words = coded.dictionary.to_pylist()
            weight, place = np.array([idf[w] for w in words]), np.array([line.get(w, -1) for w in words])
            key, times = np.unique(np.repeat(np.arange(n), length) * len(words) + coded.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(key, len(words))
            w = times / length[row] * weight[word]
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n))
            use = place[word] >= 0
            row, at, w = row[use], place[word[use]], w[use]
            dots = np.zeros((n, len(names)))
            cut = np.searchsorted(row, np.arange(n + 1))
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(cut, cut[a] + max(1, PRODUCTS // len(names)), side="right")) - 1)
                part = slice(cut[a], cut[b])
                some = np.flatnonzero(cut[a + 1 : b + 1] > cut[a:b])
                if len(some):
                    dots[a + some] = np.add.reduceat(q[at[part]] * w[part, None], cut[a + some] - cut[a], axis=0)
                a = b
            share = dots / (np.where(norm > 0, norm, np.inf)[:, None] * size)
            # Half up at nine, then four digits.
            points = np.floor(np.floor(share * 1e9 + 0.5) / 1e5 + 0.5 + 1e-7).astype(np.int64)
            order = np.empty(n, np.int64)
            order[pc.sort_indices(pa.table([batch.column("doc_id"), batch.column("chunk_no")], ["d", "c"]), [("d", "ascending"), ("c", "ascending")]).to_numpy()] = np.arange(n)
            ranked = points * n + (n - 1 - order)[:, None]
            best = np.argpartition(-ranked, min(k, n) - 1, axis=0)[: min(k, n)]
            query = np.broadcast_to(np.arange(len(names)), best.shape).ravel()
            chunk = best.ravel()
            keep = points[chunk, query] > 0
            chunk, query = chunk[keep], query[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in query.tolist()], id_kind), batch.column("doc_id").take(pa.array(chunk)), batch.column("chunk_no").take(pa.array(chunk)), pa.array(points[chunk, query] / 1e4)],
                [query_id, "doc_id", "chunk_no", "score"],
            )

    return map_arrow(chunk_table.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), _tokens("trecho").alias("t")), run, schema)


def context_strings(ranked: DataFrame, chunk_table: DataFrame, query_id: str) -> DataFrame:
    """The chosen chunks of each query, best first, as one text."""
    joined = ranked.join(chunk_table, ["doc_id", "chunk_no"])
    listed = joined.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "trecho"))).alias("x"))
    return listed.select(query_id, F.array_join(F.transform("x", lambda x: F.concat(F.lit("["), x.doc_id.cast("string"), F.lit("] "), x.trecho)), "\n\n").alias("contexto"))
