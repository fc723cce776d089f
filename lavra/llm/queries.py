"""Queries of this package, each over its whole tables with production parameters, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import conversations, credentials, languages, leakage, lines, neardup, packing, quality, spans, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(_table(spark, d, "historico"))


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    model = languages.fit(_table(spark, d, "documents"), "text", "lang")
    return tokens.token_budget(_table(spark, d, "exemplos"), "texto", "fonte", "categoria", model=model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = credentials.find_credentials(_table(spark, d, "contexto_codigo"), "id", "conteudo")
    return found.select("id", F.col("line").alias("linha")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_files(_table(spark, d, "contexto_codigo"), "id", "conteudo").withColumnRenamed("text", "conteudo")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_quality(spark, d).filter("is_prose = false").select("id")


def p4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(quality.text_statistics(_table(spark, d, "exemplos"), "id", "texto"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, d, "exemplos"), "id", "fonte", "texto").select("id", F.col("line").alias("linha"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "exemplos").select("id", "fonte", "texto")
    drop = lines.repeated_lines(rows, "id", "fonte", "texto").filter("excess").select("id", "line")
    return lines.strip_lines(rows, "id", "texto", drop)


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(_table(spark, d, "exemplos"), "id", "texto", words=3, threshold=0.6, min_words=12)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).expanded_pairs(by_text=True)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, d, "exemplos"), "id", "texto")
    return neardup.near_duplicate_groups(found)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "recipientes"), "recipiente_id", "capacidade_tokens")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "avaliacao"), "item_id", "texto")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(_table(spark, d, "documents").select("doc_id", "text"), "doc_id", p8_leaks(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(_table(spark, d, "documents"), "doc_id", "text")


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_coverage(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_classes(_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p2_token_budget, p3_found, p3_redacted, p4_found, p4_quality, p5_found, p5_clean, p6_found, p6_groups, p7_packing, p8_found, p8_leaks, p8_clean,
        p9_found, p9_coverage, p9_classes,
    )
}

ORACLE: dict[str, str] = {
    "p1_found": r"""
        with m as (
            select lower(trim(sessao_id, chr(32) || chr(9) || chr(10) || chr(13))) as sessao_id, id, "timestamp" as ts, conteudo,
                   case when lower(trim(papel, chr(32) || chr(9) || chr(10) || chr(13))) in ('usuario', 'usuário', 'user', 'humano') then 'u'
                        when lower(trim(papel, chr(32) || chr(9) || chr(10) || chr(13))) in ('ia', 'assistente', 'assistant', 'bot') then 'a'
                        when lower(trim(papel, chr(32) || chr(9) || chr(10) || chr(13))) in ('sistema', 'system') then 'n' else '?' end as papel
            from historico),
        o as (
            select *, lag(papel) over w as p_papel, lag(conteudo) over w as p_conteudo
            from m where sessao_id <> '' window w as (partition by sessao_id order by ts nulls first, id)),
        k as (
            select sessao_id, id, papel, ts, conteudo, row_number() over (partition by sessao_id order by ts nulls first, id) as posicao
            from o where papel <> 'n' and not (p_papel is not null and p_papel = papel and p_conteudo is not distinct from conteudo)),
        g as (
            select sessao_id from k group by sessao_id
            having count(*) % 2 = 0 and count(*) filter (where ts is null or conteudo is null or not regexp_matches(conteudo, '[\p{L}\p{Nd}]')
                or papel <> case when posicao % 2 = 1 then 'u' else 'a' end) = 0)
        select sessao_id, cast(posicao as integer) as posicao, id from k semi join g using (sessao_id)""",
    "p5_found": r"""
        with l as (
            select id, lower(trim(fonte, chr(32) || chr(9) || chr(10) || chr(13))) as fonte, string_split(texto, chr(10)) as parts from exemplos where texto is not null),
        e as (
            select id, fonte, unnest(range(1, len(parts) + 1)) as linha, unnest(parts) as part from l where fonte <> ''),
        f as (
            select id, fonte, linha, regexp_replace(strip_accents(lower(part)), '[^\p{L}]', '', 'g') as chave from e),
        c as (
            select fonte, chave from f where length(chave) >= 30 group by fonte, chave having count(distinct id) >= 10)
        select id, cast(linha as integer) as linha from f semi join c using (fonte, chave)""",
}
