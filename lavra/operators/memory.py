"""Conversation memory: sessions, context windows, typed preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import text as T

# Words that are true, and the default preferences as key, value and type.
TRUE_WORDS = ("true", "1", "sim", "yes")
DEFAULTS = [
    ("nome_usuario", "Usuário", "str"), ("linguagem_favorita", "python", "str"), ("estilo_resposta", "tecnico", "str"), ("mostrar_emojis", "true", "bool"), ("max_historico", "50", "int"),
    ("tema", "escuro", "str"), ("idioma", "pt-br", "str"), ("salvar_codigos", "true", "bool"), ("nivel_detalhe_relat", "completo", "str"), ("auto_corrigir", "false", "bool"),
    ("linguagens_ativas", '["python","javascript","typescript"]', "json"),
]


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session, posicao from the oldest of them. WindowGroupLimit keeps n rows per task before the shuffle."""
    newest = Window.partitionBy("sessao_id").orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc())
    kept = messages.withColumn("__k", F.row_number().over(newest)).filter(F.col("__k") <= n)
    oldest = Window.partitionBy("sessao_id").orderBy(F.col("__k").desc())
    return kept.withColumn("posicao", F.row_number().over(oldest).cast("long")).drop("__k")


def session_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("sessao_id").agg(F.coalesce(F.sum("tokens_aprox"), F.lit(0)).cast("long").alias("tokens"))


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with their first message; the newest `limit` of them as a report."""
    first = messages.groupBy("sessao_id").agg(F.min_by("conteudo", "id").alias("primeira"))
    out = sessions.join(first, "sessao_id", "left").select("sessao_id", "iniciada_em", "total_mensagens", "primeira")
    return out.orderBy(F.col("iniciada_em").desc_nulls_last(), "sessao_id").limit(limit) if limit else out


def context_window(messages: DataFrame, budget: float) -> DataFrame:
    """Newest messages of each session whose running token sum stays within the budget; it stops at the first overflow.

    Every message counts a token or more, so at most `budget` messages of a session can fit: a rank limit bounds the window first.
    """
    w = Window.partitionBy("sessao_id").orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc())
    tokens = F.greatest(F.coalesce(F.col("tokens_aprox"), F.lit(0)), F.lit(1)).cast("long")
    near = messages.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= int(budget) + 1)
    total = near.withColumn("acumulado", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.filter(F.col("acumulado") <= budget).drop("__k")


def code_context(files: DataFrame, budget: int = 409, most: int = 3, summary: int = 200, used: Column | None = None) -> DataFrame:
    """sessao_id, k, id, trecho: the newest files of each session, whole while the budget lasts, else as a summary, which costs nothing.

    used is what the session has spent already, as an expression over a column of files.
    """
    w = Window.partitionBy("sessao_id").orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc())
    top = files.withColumn("__used", (F.lit(0) if used is None else used).cast("long")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    content = F.coalesce("conteudo", F.lit(""))
    cost = F.greatest(F.lit(1), F.floor(F.length(content) / 4)).cast("long")
    listed = top.groupBy("sessao_id").agg(F.max("__used").alias("u"), F.array_sort(F.collect_list(F.struct("k", "id", content.alias("c"), cost.alias("t")))).alias("f"))
    fold = F.expr(
        "aggregate(f, named_struct('used', u, 'whole', cast(array() as array<boolean>)), "
        f"(a, x) -> named_struct('used', a.used + if(a.used + x.t <= {budget}, x.t, 0L), 'whole', array_append(a.whole, a.used + x.t <= {budget})))"
    )
    each = listed.select("sessao_id", "f", fold.getField("whole").alias("whole")).select("sessao_id", "whole", F.posexplode("f").alias("n", "x"))
    return each.select("sessao_id", "x.k", "x.id", F.when(F.get("whole", F.col("n")), F.col("x.c")).otherwise(T.shorten(F.col("x.c"), summary)).alias("trecho"))


def context_records(messages: DataFrame, files: DataFrame, prefs: DataFrame, tokens: int = 2048) -> DataFrame:
    """sessao_id, historico, arquivos, preferencias, tokens: what is told of each session: the newest messages that fit into seven
    tenths of the tokens, oldest first; the newest files in what two tenths leave; and all preferences."""
    fit = context_window(messages, 0.7 * tokens)
    said = F.struct(F.col("timestamp"), F.col("id"), F.col("papel"), F.col("conteudo"))
    history = fit.groupBy("sessao_id").agg(F.array_sort(F.collect_list(said)).alias("historico"), F.max("acumulado").alias("tokens"))
    spent = files.join(history.select("sessao_id", F.col("tokens").alias("__spent")), "sessao_id", "left")
    chosen = code_context(spent, int(0.2 * tokens), used=F.coalesce("__spent", F.lit(0)))
    listed = chosen.groupBy("sessao_id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "trecho"))).alias("arquivos"))
    known = prefs.filter("chave is not null").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("chave", "valor"))).alias("preferencias"))
    joined = history.join(listed, "sessao_id", "left")
    return joined.select("sessao_id", "historico", F.coalesce("arquivos", F.array().cast(listed.schema["arquivos"].dataType)).alias("arquivos"), known.scalar().alias("preferencias"), "tokens")


def purge_sessions(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the sessions in ids(sessao_id); rows of no session stay."""
    gone = ids.select("sessao_id").distinct()
    return [t.join(gone, "sessao_id", "left_anti") for t in tables]


def languages_used(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce("linguagem", F.lit("")) != "").groupBy("linguagem").agg(F.count("*").alias("n"))


def favourite_language(files: DataFrame) -> DataFrame:
    """The language most files have; the first by name among equals."""
    return languages_used(files).orderBy(F.col("n").desc(), "linguagem").limit(1)


def memory_statistics(messages: DataFrame) -> DataFrame:
    said = F.lower(T.strip_column(F.col("papel")))
    return messages.groupBy("sessao_id").agg(
        F.count("*").alias("mensagens"), F.count_if(said == "usuario").alias("do_usuario"), F.count_if(said == "ia").alias("da_ia"),
        F.coalesce(F.sum("tokens_aprox"), F.lit(0)).cast("long").alias("tokens"), F.min("timestamp").alias("primeira"), F.max("timestamp").alias("ultima"),
    )


def upsert_preferences(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The last write of each key wins; later rows of equal time by value."""
    both = current.unionByName(changes)
    last = both.groupBy("chave").agg(F.max_by(F.struct("valor", "tipo_valor", "atualizado_em"), F.struct("atualizado_em", "valor")).alias("x"))
    return last.select("chave", "x.*")


def with_default_preferences(current: DataFrame, defaults: DataFrame) -> DataFrame:
    """Defaults for the keys that have no value yet, beside the values."""
    return current.unionByName(defaults.join(current.select("chave"), "chave", "left_anti"))


def typed_preferences(prefs: DataFrame) -> DataFrame:
    """One column per type; a value that does not fit its type is null there."""
    kind = F.coalesce(F.lower("tipo_valor"), F.lit("str"))

    def when(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    return prefs.select(
        "chave", kind.alias("tipo"),
        when("int", F.when(F.col("valor").rlike(r"^\s*[+-]?\d+\s*$"), F.expr("try_cast(trim(valor) as bigint)"))).alias("v_int"),
        when("float", F.when(F.col("valor").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.expr("try_cast(trim(valor) as double)"))).alias("v_float"),
        when("bool", F.lower("valor").isin(*TRUE_WORDS)).alias("v_bool"),
        F.when(~kind.isin("int", "float", "bool", "json"), F.col("valor")).alias("v_str"),
        when("json", F.when(F.expr("try_parse_json(valor)").isNotNull(), F.col("valor"))).alias("v_json"),
    )


def message_summary(messages: DataFrame, n: int = 80) -> DataFrame:
    at = F.coalesce(F.date_format("timestamp", "HH:mm"), F.lit(""))
    return messages.select("id", F.concat(F.lit("["), at, F.lit("] "), F.coalesce("papel", F.lit("")), F.lit(": "), T.shorten(F.coalesce("conteudo", F.lit("")), n)).alias("resumo"))
