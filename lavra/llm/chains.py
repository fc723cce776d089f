"""Parent pointers: order-derived parents without a global sort in one task, and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lavra.functions.arrow import map_arrow
from lavra.session import materialize


def previous_rows(df: DataFrame, group: str, order: list[str], carry: list[str]) -> DataFrame:
    """df with at (a number of the row) and prev_at, prev_<c> for each c of carry: those of the row before, by `order`, within
    `group`; null in a group's first row.

    Rows are range-partitioned by group and order, so a group of any size spreads over partitions. A partition is read once in
    order, each row beside the one before it; the last row of each partition, one row each, gives the partition after it its
    start. `order` must be total within a group; nulls come first.
    """
    keys = [group, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    behind = [group, "at", *carry]
    schema = StructType(ordered.schema.fields + [StructField(f"__prev_{c}", ordered.schema[c].dataType) for c in behind])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c) for c in behind]
            last = last or [pa.nulls(1, c.type) for c in now]
            moved = [pa.concat_arrays([a, c.slice(0, len(c) - 1)]) for a, c in zip(last, now)]
            last = [c.slice(len(c) - 1, 1) for c in now]
            yield pa.RecordBatch.from_arrays([*batch.columns, *moved], [*batch.schema.names, *(f"__prev_{c}" for c in behind)])

    ordered = materialize(map_arrow(ordered, step, schema), "ordered").withColumn("__part", F.shiftright("at", 33))
    ends = ordered.groupBy("__part").agg(F.max_by(F.struct(*behind), "at").alias("__last"))
    ends = ends.select(F.lead("__part").over(Window.orderBy("__part")).alias("__part"), "__last")
    joined = ordered.join(F.broadcast(ends), "__part", "left")
    before = {c: F.coalesce(F.col(f"__prev_{c}"), F.col("__last").getField(c)) if c in (group, "at") else F.when(F.col("__prev_at").isNull(), F.col("__last").getField(c)).otherwise(F.col(f"__prev_{c}")) for c in behind}
    same = before[group].eqNullSafe(F.col(group)) & before["at"].isNotNull()
    return joined.withColumns({f"prev_{c}": F.when(same, before[c]) for c in ["at", *carry]}).drop("__part", "__last", *(f"__prev_{c}" for c in behind))


def jump_pointers(nodes: DataFrame, carry: tuple[str, ...] = (), complete: bool = False) -> DataFrame:
    """id, root, depth, status and the columns of carry for nodes(id, parent, weight, ...): pointer jumping by joins that double
    the distance each round.

    depth is the sum of weights from the root to the node. status is "ok", "orphan" (a chain that ends at a parent that does
    not exist; the root is its first existing node) or "cycle" (no root: root and depth are null). Ids must be unique; a null
    id is dropped. complete says that every parent exists, which then is not looked up.

    Resolved nodes leave the rounds. A node asked in one round was asked in the round before, so the next round joins only with
    the nodes that moved in this one and those they met: a round costs what is open, and there are about log2(longest chain).
    """
    base = nodes.filter("id is not null").select("id", "parent", F.col("weight").cast("long").alias("weight"), *carry)
    missing = F.lit(False)
    if not complete:
        base = base.join(base.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left")
        missing = F.col("parent").isNotNull() & F.col("there").isNull()
    ptr = F.when(~missing, F.col("parent"))
    start = base.select("id", ptr.alias("ptr"), F.when(ptr.isNull(), F.col("id")).alias("root"), "weight", missing.alias("orphan"), *carry)
    state = materialize(start, "chains")
    fields = ["id", "ptr", "root", "weight", "orphan"]
    done, open_, target = state.filter("ptr is null"), state.filter("ptr is not null"), state.select(*fields)
    left = limit = open_.count()
    rounds = 0
    while left and (1 << max(0, rounds - 1)) <= limit:
        asked = target.selectExpr("id as met", "ptr as next", "root as far", "weight as more", "orphan as lost")
        moved = open_.select("id", F.col("ptr").alias("met"), F.col("weight").alias("own"), *carry).join(asked, "met")
        moved = moved.select("id", F.col("next").alias("ptr"), F.col("far").alias("root"), (F.col("own") + F.col("more")).alias("weight"), F.col("lost").alias("orphan"), *carry, "met", "more")
        moved = materialize(moved, "jumped")
        ended = moved.filter("ptr is null")
        done = done.unionByName(ended.drop("met", "more"))
        open_ = moved.filter("ptr is not null")
        left = open_.count()
        # What a settled node met is settled itself, and may be asked again by a node that has come to it.
        met = ended.select(F.col("met").alias("id"), "ptr", "root", F.col("more").alias("weight"), "orphan")
        values = F.struct("ptr", "root", "weight", "orphan")
        target = met.unionByName(moved.select(*fields)).groupBy("id").agg(F.any_value(values).alias("x")).select("id", "x.*")
        rounds += 1
    out = done.select("id", "root", F.col("weight").alias("depth"), F.when(F.col("orphan"), F.lit("orphan")).otherwise(F.lit("ok")).alias("status"), *carry)
    if left:
        lost = open_.select("id", F.lit(None).cast(out.schema["root"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("status"), *carry)
        out = out.unionByName(lost)
    return out
