"""Rebuilding conversations from message rows.

`message_links` gives each message its parent: the row before it in its session by time and id, found without putting a
session into one task. `thread_paths` resolves any parent pointers by pointer jumping (joins that double the distance each
round), detects orphans and cycles and emits every root-to-leaf path. `conversations` applies both to message rows: system
notes and repeated deliveries weigh nothing on the path, so the depth of a message is its position, and conversations that
are broken, empty or lack a reply are left out by sums over their session (pre-aggregated).

Cases: a null or blank session is no conversation; null times, unknown roles, and null texts or texts without a letter or
digit void theirs; equal times order by id; rows with an id that occurred before in the same session at the same time count
once; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.chains import jump_pointers, previous_rows
from lavra.session import materialize

# Spellings of roles.
USER = ("usuario", "usuário", "user", "humano")
ASSISTANT = ("ia", "assistente", "assistant", "bot")
NOTE = ("sistema", "system")


def _trimmed(column: str) -> str:
    return f"lower(regexp_replace(`{column}`, '(?U)^\\\\s+|\\\\s+$', ''))"


def message_links(df: DataFrame, session: str, role: str, text: str, time: str, id_col: str) -> DataFrame:
    """at, parent (at of the row before in the session), session, id, role (u, a, n or ?), keep, sound: one row for each message in a session."""

    def listed(values: tuple[str, ...]) -> str:
        return ", ".join(f"'{v}'" for v in values)

    rows = (
        df.select(F.expr(_trimmed(session)).alias("session"), F.expr(_trimmed(role)).alias("said"), F.col(text).cast("string").alias("text"), F.col(time).alias("time"), F.col(id_col).alias("id"))
        .filter("session <> '' and id is not null")
        .select(
            "session", "id", "time",
            F.expr(f"case when said in ({listed(USER)}) then 'u' when said in ({listed(ASSISTANT)}) then 'a' when said in ({listed(NOTE)}) then 'n' else '?' end").alias("role"),
            F.expr("struct(length(text) as size, unhex(md5(text)) as hash)").alias("same"),
            F.expr("time is not null and coalesce(text rlike '[\\\\p{L}\\\\p{Nd}]', false)").alias("sound"),
        )
        .dropDuplicates(["session", "id", "time"])
    )
    linked = previous_rows(rows, "session", ["time", "id"], ["role", "same"])
    repeated = F.col("prev_role").eqNullSafe(F.col("role")) & F.col("prev_same").eqNullSafe(F.col("same")) & F.col("prev_at").isNotNull()
    return linked.select("at", F.col("prev_at").alias("parent"), "session", "id", "role", ((F.col("role") != "n") & ~repeated).alias("keep"), "sound")


def conversations(df: DataFrame, session: str = "sessao_id", role: str = "papel", text: str = "conteudo", time: str = "timestamp", id_col: str = "id") -> DataFrame:
    """sessao_id, posicao, id: the messages of each conversation kept, in order."""
    links = message_links(df, session, role, text, time, id_col).withColumn("weight", F.col("keep").cast("int")).withColumnRenamed("id", "message").withColumnRenamed("at", "id")
    placed = jump_pointers(links, ("session", "message", "role", "sound", "keep"), complete=True)
    turns = placed.filter("status = 'ok' and keep").withColumnRenamed("depth", "position")
    fits = F.expr("sound and role = case when position % 2 = 1 then 'u' else 'a' end")
    whole = turns.groupBy("root").agg(F.count("*").alias("n"), F.sum((~fits).cast("int")).alias("wrong")).filter("wrong = 0 and n % 2 = 0").select("root")
    return turns.join(whole, "root", "left_semi").select(F.col("session").alias("sessao_id"), F.col("position").cast("int").alias("posicao"), F.col("message").alias("id"))


def thread_paths(nodes: DataFrame) -> DataFrame:
    """path (its leaf), position (from 1), id for every root-to-leaf path of nodes(id, parent) whose chain ends at a true root.

    Nodes of orphan chains and of cycles are in no path. Paths are read off jump tables: the node `d` steps above a leaf is
    found by one join for each bit of d, so a long path is never one task's list.
    """
    resolved = materialize(jump_pointers(nodes.select("id", "parent", F.lit(1).alias("weight"))), "threads")
    good = resolved.filter("status = 'ok'").select("id", "depth")
    up = materialize(nodes.select("id", "parent").join(good.select("id"), "id", "left_semi"), "lift")
    leaves = good.join(up.filter("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    longest = leaves.agg(F.max("depth")).first()[0] or 0
    steps = leaves.select(F.col("id").alias("path"), F.col("id").alias("node"), "depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("above"))
    bit = 0
    while (1 << bit) < longest:
        near = steps.filter(F.expr(f"(above & {1 << bit}) = 0"))
        far = steps.filter(F.expr(f"(above & {1 << bit}) <> 0")).join(up.selectExpr("id as node", "parent as next"), "node").select("path", F.col("next").alias("node"), "depth", "above")
        steps = materialize(near.select("path", "node", "depth", "above").union(far), "climb")
        up = materialize(up.alias("a").join(up.alias("b"), F.expr("a.parent = b.id")).select(F.col("a.id").alias("id"), F.col("b.parent").alias("parent")).filter("parent is not null"), "lift")
        bit += 1
    return steps.select("path", (F.col("depth") - F.col("above")).alias("position"), F.col("node").alias("id"))
