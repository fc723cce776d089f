"""Filling containers of fixed capacity with texts, by Karmarkar-Karp multiway differencing.

A text larger than the container gives as many full pieces as fit; only its rest is an item. Items are parted by hash into
groups of about `windows` containers, or of about ITEMS items if these are fewer; their number follows from the totals, so no
task's work grows with the input, and no group is cut. In
a group the partial partitions with the widest spread are merged, the heaviest window of one onto the lightest of the
other, which gives near-equal windows; while any window exceeds the capacity, the number of windows rises by one.

Cases: null and empty texts have no tokens and are in no container; a text of exactly the capacity fills one; repeated rows
are items of their own; capacities that are null or below 1 are an error, as are more than MOST_CAPACITIES of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.arrow import map_arrow
from lavra.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from lavra.session import materialize

MOST_CAPACITIES = 1000
#: Items of a group, about, where containers hold so many that `windows` of them would have more.
ITEMS = 16384


def differencing(sizes: list[int], windows: int) -> tuple[list[int], list[int]]:
    """Window of each item, and the sum of each window."""
    n = len(sizes)
    if windows == 1 or not n:
        return [0] * n, [sum(sizes)] + [0] * (windows - 1)
    # A node has sums in descending order less their least; its two children say which window each of theirs went to.
    sums: list[np.ndarray] = []
    children: list[tuple[int, int, np.ndarray | None]] = []
    queue = []
    for i, s in enumerate(sizes):
        v = np.zeros(windows, np.int64)
        v[0] = s
        sums.append(v)
        children.append((-1, -1, None))
        queue.append((-s, i))
    heapify(queue)
    while len(queue) > 1:
        _, a = heappop(queue)
        _, b = queue[0]
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        merged -= merged[-1]
        sums[a] = sums[b] = None  # type: ignore[call-overload]
        sums.append(merged)
        children.append((a, b, order))
        heapreplace(queue, (-int(merged[0]), len(sums) - 1))
    at: list[np.ndarray | None] = [None] * len(children)
    at[-1] = np.arange(windows)
    window = [0] * n
    for k in range(len(children) - 1, -1, -1):
        a, b, order = children[k]
        here = at[k]
        at[k] = None
        if order is None:
            window[k] = int(here[0])
            continue
        place = np.empty(windows, np.int64)
        place[order] = here
        at[a], at[b] = place, place[::-1]
    return window, np.bincount(window, weights=sizes, minlength=windows).astype(int).tolist()


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Window of each item, none above the capacity; items must not exceed it."""
    k = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes), 1)
    while True:
        window, total = differencing(sizes, k)
        if max(total) <= capacity:
            return window
        k += 1


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def pack_documents(
    docs: DataFrame, id_col: str, text_col: str, containers: DataFrame, container_col: str, capacity_col: str, path: str = DEFAULT_VOCABULARY, windows: int = 64
) -> DataFrame:
    """recipiente_id, janela, doc_id, parte, token_inicio, token_fim for every part of every text and each capacity."""
    capacities = [(r[0], int(r[1])) for r in containers.select(container_col, capacity_col).distinct().limit(MOST_CAPACITIES + 1).collect()]
    if len(capacities) > MOST_CAPACITIES or any(c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive, and not too many")
    kind = containers.schema[container_col].dataType.simpleString()
    sized = materialize(with_token_counts(docs.withColumnRenamed(id_col, "doc_id"), text_col, ["doc_id"], path), "sizes").filter("n_tokens > 0")
    id_type = sized.schema["doc_id"].dataType.simpleString()
    schema = f"recipiente_id {kind}, janela string, doc_id {id_type}, parte int, token_inicio long, token_fim long"
    if not capacities:
        return docs.sparkSession.createDataFrame([], schema)
    total, texts = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    options = F.array(*[F.struct(F.lit(r).cast(kind).alias("r"), F.lit(c).cast("long").alias("c"), F.lit(max(1, -(-total // (c * windows)), -(-texts // ITEMS))).cast("long").alias("g")) for r, c in capacities])
    each = sized.withColumn("o", F.explode(options)).select("doc_id", "n_tokens", "o.r", "o.c", "o.g", F.expr("n_tokens div o.c").alias("full"))
    full = each.filter("full > 0").select("r", "c", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    full = full.select(
        F.col("r").alias("recipiente_id"), F.concat_ws("-", F.lit("cheia"), F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("janela"), "doc_id",
        F.col("k").cast("int").alias("parte"), (F.col("k") * F.col("c")).alias("token_inicio"), ((F.col("k") + 1) * F.col("c")).alias("token_fim"),
    )
    items = each.withColumn("size", F.expr("n_tokens - full * c")).filter("size > 0").withColumn("group", F.expr("pmod(xxhash64(doc_id, c), g)"))
    items = items.select("r", "c", "group", "doc_id", F.col("full").cast("int").alias("parte"), "size").repartition("c", "group").sortWithinPartitions("c", "r", "group", "doc_id", "size")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["recipiente_id", "janela", "doc_id", "parte", "token_inicio", "token_fim"]

        def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
            c, size, part = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("c", "size", "parte"))
            window = pack(size.tolist(), int(c[0]))
            tag = f"{rows.column('group')[0]}-"
            return pa.RecordBatch.from_arrays(
                [rows.column("r"), pa.array([f"{tag}{w}" for w in window]), rows.column("doc_id"), pa.array(part.astype(np.int32)), pa.array(part * c), pa.array(part * c + size)], names
            )

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if kept and any(kept[-1].column(x)[-1] != batch.column(x)[0] for x in ("c", "r", "group")):
                yield packed(_joined(kept))
                kept = []
            new = np.zeros(batch.num_rows - 1, bool)
            for x in ("c", "r", "group"):
                col = batch.column(x)
                new |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            cut = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:]):
                kept.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield packed(_joined(kept))
                    kept = []
        if kept:
            yield packed(_joined(kept))

    return full.unionByName(map_arrow(items, fill, schema))
