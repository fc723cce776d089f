"""Queries of the core and their SQL twins, by name. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.operators import batches, bpe, codescan, corpus, images, intent, markup, memory, numerics, retrieval, rewrite

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


STRIP = r"regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '', 'g')"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


def low_sql(x: str) -> str:
    return LOW.format(x)


def looks_sql(x: str) -> str:
    lines = f"string_split({x}, chr(10))"
    return f"(len({lines}) >= 2 and len(list_filter({lines}[1:5], lambda x: regexp_matches(x, {sql_text(codescan.CODE_LINE)}))) >= 2)"


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- sources ---------------------------------------------------------------------------------------------------------


@query(f"with l as (select doc_id as id, unnest(string_split(text, chr(10))) as l from documents) select id, {strip_sql('l')} as texto from l where {strip_sql('l')} <> ''")
def read_lines(t: Tables) -> DataFrame:
    lines = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n", -1)).alias("l"))
    return lines.select("id", T.strip_column(F.col("l")).alias("texto")).filter("texto <> ''")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""select item_id, texto || chr(10) || gabarito as texto from avaliacao where texto is not null and gabarito is not null""")
def json_pairs(t: Tables) -> DataFrame:
    from lavra.sources.readers import json_texts

    doc = F.to_json(F.array(F.struct(F.col("texto").alias("pergunta"), F.col("gabarito").alias("resposta"))))
    return t.avaliacao.select("item_id", F.explode(json_texts(doc)).alias("texto"))


@query(
    r"""with p as (select doc_id as id, regexp_split_to_array(replace(text, chr(13), ''), '\n[ \t]*\n') as b from documents),
    e as (select id, unnest(range(len(b))) as n, unnest(b) as b from p),
    j as (select id, n, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(replace(x, chr(9), ' '))), lambda x: x <> ''), ' ') as paragrafo from e)
    select id, cast(n as integer) as n, paragrafo from j where length(paragrafo) > 10"""
)
def paragraphs(t: Tables) -> DataFrame:
    return corpus.paragraphs(t.documents, "doc_id", "text")


@query(
    r"""with p as (select doc_id as id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: length(x) > 50)[1:5] as b from documents)
    select id, cast(unnest(range(len(b))) as integer) as n, unnest(b) as paragrafo from p"""
)
def first_paragraphs(t: Tables) -> DataFrame:
    return corpus.first_paragraphs(t.documents, "doc_id", "text")


@query("select doc_id, substr(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), 1, 5000) as texto from documents where length(text) > 100".replace("\\\\", "\\"))
def article_clip(t: Tables) -> DataFrame:
    return t.documents.filter(F.length("text") > 100).select("doc_id", F.substring(F.regexp_replace("text", r"\n{3,}", "\n\n"), 1, 5000).alias("texto"))


def wiki_extract(t: Tables) -> DataFrame:
    """Paragraphs of every document read as a wiki page."""
    return markup.wiki_paragraphs(t.documents, "doc_id", "text")


@query("select id, cast((row_number() over (order by id) - 1) // 512 as bigint) as pagina from exemplos where length(texto) >= 10")
def page_scan(t: Tables) -> DataFrame:
    return corpus.pages(corpus.min_chars(t.exemplos, 10), 512).select("id", "pagina")


@query("select p.pos, e.id, e.texto from (values (0, 77), (1, 3), (2, 1201), (3, 12), (4, 3)) p(pos, id) join exemplos e on e.id = p.id")
def multi_get_ordered(t: Tables) -> DataFrame:
    return corpus.multi_get(t.exemplos, [77, 3, 1201, 12, 3])


# --- sinks and maintenance -------------------------------------------------------------------------------------------


@query(
    """with n as (select min(id) as id from exemplos where id % 2 = 0 and texto is not null and texto not in (select texto from exemplos where id % 2 = 1 and texto is not null) group by texto)
    select (select count(*) from n) as adicionados, (select count(*) from exemplos where id % 2 = 0) - (select count(*) from n) as repetidos"""
)
def insert_ignore_counts(t: Tables) -> DataFrame:
    """Both halves of the corpus are read whole: one stands for what exists, the other for what arrives."""
    old, new = t.exemplos.filter("id % 2 = 1"), t.exemplos.filter("id % 2 = 0")
    fresh = corpus.insert_ignore(old.filter("texto is not null"), new.filter("texto is not null")).agg(F.count("*").alias("adicionados"))
    return fresh.select("adicionados", (new.agg(F.count("*")).scalar() - F.col("adicionados")).alias("repetidos"))


@query(f"with s as (select id, substr({strip_sql('texto')}, 1, 50000) as texto from exemplos where length({strip_sql('texto')}) >= 5) select min(id) as id, texto from s group by texto")
def ingest_dedup(t: Tables) -> DataFrame:
    return corpus.first_of_each(corpus.stripped(t.exemplos.select("id", "texto"), 5, 50_000), F.col("texto"))


@query(f"with s as (select id, {strip_sql('texto')} as texto, 'wikipedia:' || coalesce(categoria, 'geral') as fonte from exemplos where length({strip_sql('texto')}) >= 10) select min(id) as id, texto, min_by(fonte, id) as fonte from s group by texto")
def feeder_dedup(t: Tables) -> DataFrame:
    rows = t.exemplos.select("id", "texto", F.concat(F.lit("wikipedia:"), F.coalesce("categoria", F.lit("geral"))).alias("fonte"))
    return corpus.first_of_each(corpus.stripped(rows, 10), F.col("texto"))


@query("select distinct dominio as topico from fontes_ref where dominio is not null and not exists (select 1 from exemplos where fonte = 'wikipedia:' || dominio)")
def pending_topics(t: Tables) -> DataFrame:
    return corpus.pending_topics(t.fontes_ref.select(F.col("dominio").alias("topico")).filter("topico is not null").distinct(), t.exemplos)


@query(f"select lower({strip_sql('fonte')}) as chave, min_by(fonte, id) as valor, min(id) as primeiro from exemplos where fonte is not null group by 1")
def ordered_unique(t: Tables) -> DataFrame:
    return corpus.ordered_unique(t.exemplos, "fonte", "id")


@query("select texto, fonte, categoria from exemplos where categoria = 'ciencia'")
def export_projection(t: Tables) -> DataFrame:
    return corpus.export_projection(t.exemplos, "ciencia")


@query(f"select count(*) as restam from exemplos where not coalesce({low_sql('fonte')} like '%wiki%', false)")
def delete_by_source(t: Tables) -> DataFrame:
    return corpus.without_source_like(t.exemplos, "wiki").agg(F.count("*").alias("restam"))


@query("select id, categoria from exemplos where categoria is distinct from 'saude'")
def delete_by_category(t: Tables) -> DataFrame:
    return corpus.without(t.exemplos, "categoria", "saude").select("id", "categoria")


@query("select case when categoria = 'esporte' then 1 else usado_treino end as usado, count(*) as n from exemplos group by 1")
def mark_trained(t: Tables) -> DataFrame:
    return corpus.mark_used(t.exemplos, category="esporte").groupBy(F.col("usado_treino").alias("usado")).agg(F.count("*").alias("n"))


@query("select case when id in (select id from contexto_codigo) then 1 else usado_treino end as usado, count(*) as n from exemplos group by 1")
def mark_trained_ids(t: Tables) -> DataFrame:
    return corpus.mark_used(t.exemplos, ids=t.contexto_codigo).groupBy(F.col("usado_treino").alias("usado")).agg(F.count("*").alias("n"))


# --- filters and previews --------------------------------------------------------------------------------------------


@query("select id from exemplos where categoria = 'cultura' and usado_treino = 0")
def filter_cat_untrained(t: Tables) -> DataFrame:
    return corpus.pending_in_category(t.exemplos, "cultura").select("id")


@query("select id from exemplos where length(texto) >= 10")
def min_chars(t: Tables) -> DataFrame:
    return corpus.min_chars(t.exemplos, 10).select("id")


@query("select count(*) as n from exemplos where length(texto) >= 10 and categoria = 'geral'")
def filtered_count(t: Tables) -> DataFrame:
    return corpus.min_chars(t.exemplos, 10).filter("categoria = 'geral'").agg(F.count("*").alias("n"))


@query(f"select id, texto from exemplos where {low_sql('texto')} like '%protocolo%' order by id desc limit 200")
def search_docs(t: Tables) -> DataFrame:
    return corpus.search(t.exemplos, "texto", "Protocolo", 200).select("id", "texto")


@query(f"""select id, conteudo from historico where {low_sql('conteudo')} like '%memória%' order by "timestamp" desc nulls last, id desc limit 20""")
def search_messages(t: Tables) -> DataFrame:
    return corpus.search(t.historico, "conteudo", "memória", 20, "timestamp").select("id", "conteudo")


@query("select id, case when length(texto) > 150 then substr(texto, 1, 150) || '…' else texto end as previa, fonte, categoria from exemplos order by id desc limit 50")
def recent_preview(t: Tables) -> DataFrame:
    return corpus.recent_preview(t.exemplos)


@query(
    r"""select id, case when length(texto) > 45 then substr(regexp_replace(texto, '[\r\n]', ' ', 'g'), 1, 45) || '...' else regexp_replace(texto, '[\r\n]', ' ', 'g') end as previa,
    substr(list_last(string_split(coalesce(fonte, ''), '/')), 1, 23) as origem from exemplos order by id desc limit 20"""
)
def list_preview(t: Tables) -> DataFrame:
    return corpus.list_preview(t.exemplos)


@query("select count(*) as n from contexto_codigo where hash_conteudo in (select substr(md5(conteudo), 1, 12) from contexto_codigo where conteudo is not null)")
def already_analysed(t: Tables) -> DataFrame:
    known = t.contexto_codigo.filter("conteudo is not null").select(F.substring(F.md5("conteudo"), 1, 12).alias("hash_conteudo")).distinct()
    return t.contexto_codigo.join(known, "hash_conteudo", "left_semi").agg(F.count("*").alias("n"))


@query("select sessao_id, tipo, count(*) as n, max(id) as ultimo from contexto_codigo where sessao_id is not null group by sessao_id, tipo")
def contexts_by_type(t: Tables) -> DataFrame:
    return t.contexto_codigo.filter("sessao_id is not null").groupBy("sessao_id", "tipo").agg(F.count("*").alias("n"), F.max("id").alias("ultimo"))


@query("""select nome_arquivo, id, row_number() over (partition by nome_arquivo order by "timestamp" desc nulls last, id desc) as versao from contexto_codigo where nome_arquivo is not null""")
def file_history(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("nome_arquivo").orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc())
    return t.contexto_codigo.filter("nome_arquivo is not null").select("nome_arquivo", "id", F.row_number().over(w).cast("long").alias("versao"))


@query(
    r"""select doc_id from documents where length(text) >= 80 and not starts_with(text, '|') and not starts_with(text, '!')
    and length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) > 0.6"""
)
def paragraph_quality(t: Tables) -> DataFrame:
    return t.documents.filter(corpus.good_paragraph(F.col("text"))).select("doc_id")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("select count(*) as total, count(*) filter (where coalesce(usado_treino, 0) = 1) as treinados, count(*) filter (where coalesce(usado_treino, 0) <> 1) as pendentes from exemplos")
def status_totals(t: Tables) -> DataFrame:
    return corpus.status_totals(t.exemplos)


@query("select categoria, count(*) as n from exemplos group by categoria")
def count_by_category(t: Tables) -> DataFrame:
    return corpus.count_by(t.exemplos, "categoria")


@query("select fonte, count(*) as n from exemplos group by fonte order by n desc, fonte nulls first limit 10")
def top_sources(t: Tables) -> DataFrame:
    return corpus.top_groups(t.exemplos, "fonte", 10)


@query("select sessao_id, cast(coalesce(sum(tokens_aprox), 0) as bigint) as tokens from historico group by sessao_id")
def session_tokens(t: Tables) -> DataFrame:
    return memory.session_tokens(t.historico)


@query("select sessao_id, count(*) as n from historico where sessao_id is not null group by sessao_id")
def session_counts(t: Tables) -> DataFrame:
    return corpus.count_by(t.historico.filter("sessao_id is not null"), "sessao_id")


@query("select s.sessao_id, s.total_mensagens, m.primeira from sessoes s left join (select sessao_id, min_by(conteudo, id) as primeira from historico group by sessao_id) m using (sessao_id)")
def list_sessions(t: Tables) -> DataFrame:
    return memory.list_sessions(t.sessoes, t.historico).select("sessao_id", "total_mensagens", "primeira")


@query("select linguagem, count(*) as n from contexto_codigo where coalesce(linguagem, '') <> '' group by linguagem")
def languages_used(t: Tables) -> DataFrame:
    return memory.languages_used(t.contexto_codigo)


@query("select linguagem, count(*) as n from contexto_codigo where coalesce(linguagem, '') <> '' group by linguagem order by n desc, linguagem limit 1")
def favourite_language(t: Tables) -> DataFrame:
    return memory.favourite_language(t.contexto_codigo)


@query(
    f"""select sessao_id, count(*) as mensagens, count(*) filter (where lower({strip_sql('papel')}) = 'usuario') as do_usuario, count(*) filter (where lower({strip_sql('papel')}) = 'ia') as da_ia,
    cast(coalesce(sum(tokens_aprox), 0) as bigint) as tokens, epoch_us(min("timestamp")) as primeira, epoch_us(max("timestamp")) as ultima from historico group by sessao_id"""
)
def memory_stats(t: Tables) -> DataFrame:
    return memory.memory_statistics(t.historico).withColumns({c: F.unix_micros(c) for c in ("primeira", "ultima")})


WORDS_SQL = r"select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as palavra from documents"


@query(f"with w as ({WORDS_SQL}) select palavra, count(*) as n from w group by palavra having count(*) >= 2")
def word_count(t: Tables) -> DataFrame:
    return bpe.word_counts(t.documents, "text", 2)


PAIRS_SQL = f"""with w as ({WORDS_SQL}), c as (select palavra, count(*) as n from w group by palavra),
    s as (select n, list_append(list_filter(string_split(palavra, ''), lambda x: x <> ''), '</w>') as s from c),
    p as (select n, unnest(s[1:len(s) - 1]) as a, unnest(s[2:len(s)]) as b from s)
    select a, b, cast(sum(n) as bigint) as n from p group by a, b"""


@query(PAIRS_SQL)
def bpe_pair_counts(t: Tables) -> DataFrame:
    return bpe.pair_counts(bpe.word_counts(t.documents, "text"))


@query(f"select * from ({PAIRS_SQL}) order by n desc, a desc, b desc limit 1")
def bpe_best_pair(t: Tables) -> DataFrame:
    return bpe.best_pair(bpe.pair_counts(bpe.word_counts(t.documents, "text")))


@query(
    f"""with w as ({WORDS_SQL}), c as (select palavra, count(*) as n from w group by palavra),
    s as (select n, unnest(list_append(list_filter(string_split(palavra, ''), lambda x: x <> ''), '</w>')) as token from c)
    select token, cast(sum(n) as bigint) as n from s group by token"""
)
def bpe_symbol_freq(t: Tables) -> DataFrame:
    return bpe.token_frequency(bpe.word_counts(t.documents, "text").select("n", bpe.symbols(F.col("palavra")).alias("tokens")))


@query()
def encode_docs(t: Tables) -> DataFrame:
    """How often each token of a public vocabulary stands in all documents."""
    return bpe.encode_texts(t.documents, "doc_id", "text", bpe.DEFAULT_VOCABULARY).select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


@query(f"with w as ({WORDS_SQL}) select palavra as token, count(*) as n from w group by palavra order by n desc, palavra limit 30")
def top_tokens(t: Tables) -> DataFrame:
    return bpe.word_counts(t.documents, "text").select(F.col("palavra").alias("token"), "n").orderBy(F.col("n").desc(), "token").limit(30)


@query(
    f"""with w as ({WORDS_SQL}), v as (select palavra as token, 3 + row_number() over (order by count(*) desc, palavra) as token_id from w group by palavra order by count(*) desc, palavra limit 500)
    select coalesce(v.token_id, 3) as token_id, count(*) as n from w left join v on w.palavra = v.token group by 1"""
)
def encode_lookup(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    top = bpe.word_counts(t.documents, "text").orderBy(F.col("n").desc(), "palavra").limit(500)
    vocabulary = top.select(F.col("palavra").alias("token"), (F.row_number().over(Window.orderBy(F.col("n").desc(), "palavra")) + 3).cast("long").alias("token_id"))
    tokens = bpe.words(t.documents, "text").withColumnRenamed("palavra", "token").groupBy("token").agg(F.count("*").alias("k"))
    coded = bpe.encode_lookup(tokens, F.broadcast(vocabulary))
    return coded.groupBy("token_id").agg(F.sum("k").alias("n"))


@query("select true as igual, count(*) as n from (select distinct unnest(regexp_extract_all(lower(text), '\\p{L}+')) as palavra from documents)".replace("\\\\", "\\"))
def roundtrip(t: Tables) -> DataFrame:
    """Words of letters that encoding and decoding leave as they are: all."""
    each = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("id")).distinct()
    back = bpe.decode_ids(bpe.encode_texts(each, "id", "id", bpe.DEFAULT_VOCABULARY), bpe.DEFAULT_VOCABULARY)
    same = F.regexp_replace("text", " ", "") == F.col("id")
    return back.groupBy(same.alias("igual")).agg(F.count("*").alias("n"))


@query()
def training_ids(t: Tables) -> DataFrame:
    """Framed rows of real token ids: input, target shifted by one, and mask."""
    coded = bpe.encode_texts(corpus.min_chars(t.exemplos, 10), "id", "texto", bpe.DEFAULT_VOCABULARY)
    return batches.training_rows(coded, F.transform("ids", lambda x: x + len(bpe.SPECIALS)), 128).select("id", "input_ids", "target_ids", "attention_mask")


# --- batches ---------------------------------------------------------------------------------------------------------


@query()
def page_shuffle(t: Tables) -> DataFrame:
    return batches.page_shuffle(corpus.pages(t.exemplos, 512).select("id", "pagina"), 99, 1)


@query()
def global_shuffle(t: Tables) -> DataFrame:
    return batches.global_shuffle(t.exemplos.select("id"), 99, 1)


@query(
    """with p as (select id, cast((row_number() over (order by id) - 1) // 60 as bigint) as pagina from exemplos),
    k as (select id, pagina, (row_number() over (partition by pagina order by id) - 1) // 16 as k from p)
    select id, pagina, cast(dense_rank() over (order by pagina, k) as bigint) as lote from k"""
)
def batch_numbers(t: Tables) -> DataFrame:
    return batches.batch_numbers(corpus.pages(t.exemplos, 60).select("id", "pagina", "rank"), 16, 60).select("id", "pagina", "lote")


IDS_SQL = "list_transform(list_filter(string_split(texto, ''), lambda x: x <> ''), lambda x: unicode(x) % 250 + 4)"


@query(f"select id, array_to_string(list_resize({IDS_SQL}, 10, 0), ' ') as ids from exemplos where texto is not null")
def pad_truncate(t: Tables) -> DataFrame:
    ids = batches.pad_or_cut(batches.char_ids(F.col("texto")), 10)
    return t.exemplos.filter("texto is not null").select("id", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query(
    f"""with w as (select id, list_resize(list_append(list_prepend(1, ({IDS_SQL})[1:31]), 2), 33, 0) as w from exemplos where length(texto) >= 10)
    select id, array_to_string(w[1:32], ' ') as entrada, array_to_string(w[2:33], ' ') as alvo, len(list_filter(w[1:32], lambda x: x <> 0)) as validos from w"""
)
def training_rows(t: Tables) -> DataFrame:
    rows = batches.training_rows(corpus.min_chars(t.exemplos, 10), batches.char_ids(F.col("texto")), 32)
    return rows.select(
        "id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("entrada"), F.array_join(F.col("target_ids").cast("array<string>"), " ").alias("alvo"),
        F.size(F.filter("attention_mask", lambda x: x)).cast("long").alias("validos"),
    )


@query(
    """select round(avg(length(texto)), 6) as media, cast(floor(round(quantile_cont(length(texto), 0.5), 6)) as bigint) as mediana, cast(min(length(texto)) as bigint) as minimo,
    cast(max(length(texto)) as bigint) as maximo, cast(floor(round(quantile_cont(length(texto), 0.75), 6)) as bigint) as p75, cast(floor(round(quantile_cont(length(texto), 0.9), 6)) as bigint) as p90,
    cast(floor(round(quantile_cont(length(texto), 0.95), 6)) as bigint) as p95, cast(floor(round(quantile_cont(length(texto), 0.99), 6)) as bigint) as p99 from exemplos where texto is not null"""
)
def length_stats(t: Tables) -> DataFrame:
    return batches.length_statistics(t.exemplos.filter("texto is not null").select(F.length("texto").alias("n")), "n")


@query(
    """with l as (select length(texto) as n from exemplos where texto is not null), m as (select max(n) as top from l)
    select cast(least(n // 16, greatest(0, (top - 1) // 16)) as bigint) as faixa, count(*) as n from l, m group by 1"""
)
def length_histogram(t: Tables) -> DataFrame:
    return batches.length_histogram(t.exemplos.filter("texto is not null").select(F.length("texto").alias("n")), "n")


# --- memory ----------------------------------------------------------------------------------------------------------


@query(
    """with k as (select sessao_id, id, row_number() over (partition by sessao_id order by "timestamp" desc nulls last, id desc) as k from historico where sessao_id is not null)
    select sessao_id, id, row_number() over (partition by sessao_id order by k desc) as posicao from k where k <= 6"""
)
def recent_messages(t: Tables) -> DataFrame:
    return memory.recent_messages(t.historico.filter("sessao_id is not null"), 6).select("sessao_id", "id", "posicao")


@query(
    """with k as (select sessao_id, id, cast(sum(greatest(coalesce(tokens_aprox, 0), 1)) over (partition by sessao_id order by "timestamp" desc nulls last, id desc rows unbounded preceding) as bigint) as acumulado
    from historico where sessao_id is not null) select sessao_id, id, acumulado from k where acumulado <= 0.7 * 2048"""
)
def context_window(t: Tables) -> DataFrame:
    return memory.context_window(t.historico.filter("sessao_id is not null"), 0.7 * 2048).select("sessao_id", "id", "acumulado")


@query(
    """with r as (select sessao_id, id, coalesce(conteudo, '') as c, greatest(1, length(coalesce(conteudo, '')) // 4) as t, cast(row_number() over (partition by sessao_id order by "timestamp" desc nulls last, id desc) as integer) as k
    from contexto_codigo where sessao_id is not null), a as (select sessao_id, max(t) filter (where k = 1) as t1, max(t) filter (where k = 2) as t2, max(t) filter (where k = 3) as t3 from r where k <= 3 group by sessao_id),
    u as (select *, case when t1 <= 409 then t1 else 0 end as u1 from a), v as (select *, u1 + case when u1 + t2 <= 409 then t2 else 0 end as u2 from u)
    select sessao_id, k, id, case when case k when 1 then t1 <= 409 when 2 then u1 + t2 <= 409 else u2 + t3 <= 409 end then c when length(c) > 200 then substr(c, 1, 200) || '...' else c end as trecho from r join v using (sessao_id) where k <= 3"""
)
def context_files(t: Tables) -> DataFrame:
    return memory.code_context(t.contexto_codigo.filter("sessao_id is not null"))


@query()
def context_record(t: Tables) -> DataFrame:
    """Sizes of what is told of each session."""
    told = memory.context_records(t.historico.filter("sessao_id is not null"), t.contexto_codigo.filter("sessao_id is not null"), t.preferencias)
    return told.select("sessao_id", F.size("historico").alias("mensagens"), F.size("arquivos").alias("arquivos"), F.size("preferencias").alias("preferencias"), "tokens")


@query(
    "with s as (select sessao_id from sessoes where total_mensagens is null) "
    + " union all ".join(f"select '{t}' as tabela, count(*) as restam from {t} where sessao_id is null or sessao_id not in (select sessao_id from s where sessao_id is not null)" for t in ("contexto_codigo", "historico", "sessoes"))
)
def session_purge(t: Tables) -> DataFrame:
    names = ("contexto_codigo", "historico", "sessoes")
    left = memory.purge_sessions(t.sessoes.filter("total_mensagens is null"), *(getattr(t, n) for n in names))
    counts = [x.agg(F.count("*").alias("restam")).select(F.lit(n).alias("tabela"), "restam") for n, x in zip(names, left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""select chave, max_by(valor, atualizado_em) as valor from (select chave, valor, atualizado_em from preferencias union all select chave, 'novo', atualizado_em + interval 1 day from preferencias where tipo_valor = 'str') group by chave""")
def prefs_upsert(t: Tables) -> DataFrame:
    p = t.preferencias
    changes = p.filter("tipo_valor = 'str'").withColumns({"valor": F.lit("novo"), "atualizado_em": F.expr("atualizado_em + interval 1 day")})
    return memory.upsert_preferences(p, changes).select("chave", "valor")


@query(
    "select chave, valor from preferencias union all select * from (values " + ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v, _ in memory.DEFAULTS)
    + ") d(chave, valor) where chave not in (select chave from preferencias where chave is not null)"
)
def prefs_defaults(t: Tables) -> DataFrame:
    defaults = t.spark.createDataFrame([(*d, None) for d in memory.DEFAULTS], "chave string, valor string, tipo_valor string, atualizado_em timestamp")
    return memory.with_default_preferences(t.preferencias, defaults).select("chave", "valor")


@query(
    r"""select chave, coalesce(lower(tipo_valor), 'str') as tipo,
    case when lower(tipo_valor) = 'int' and regexp_matches(valor, '^\s*[+-]?\d+\s*$') then try_cast(trim(valor) as bigint) end as v_int,
    case when lower(tipo_valor) = 'float' and regexp_matches(valor, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') then try_cast(trim(valor) as double) end as v_float,
    cast(case when lower(tipo_valor) = 'bool' then lower(valor) in ('true', '1', 'sim', 'yes') end as integer) as v_bool,
    case when coalesce(lower(tipo_valor), 'str') not in ('int', 'float', 'bool', 'json') then valor end as v_str,
    case when lower(tipo_valor) = 'json' and json_valid(valor) then valor end as v_json from preferencias"""
)
def prefs_typed(t: Tables) -> DataFrame:
    return memory.typed_preferences(t.preferencias).withColumn("v_bool", F.col("v_bool").cast("int"))


@query(
    """select id, '[' || coalesce(strftime("timestamp" at time zone 'UTC', '%H:%M'), '') || '] ' || coalesce(papel, '') || ': ' ||
    case when length(coalesce(conteudo, '')) > 80 then substr(conteudo, 1, 80) || '...' else coalesce(conteudo, '') end as resumo from historico"""
)
def message_summary(t: Tables) -> DataFrame:
    return memory.message_summary(t.historico)


@query("""select id, greatest(1, length(conteudo) // 4) as tokens from historico where conteudo is not null""")
def token_estimate(t: Tables) -> DataFrame:
    return t.historico.filter("conteudo is not null").select("id", T.token_estimate(F.col("conteudo")).alias("tokens"))


@query("select id, substr(md5(conteudo), 1, 12) as hash from contexto_codigo where conteudo is not null")
def content_hash(t: Tables) -> DataFrame:
    return t.contexto_codigo.filter("conteudo is not null").select("id", F.substring(F.md5("conteudo"), 1, 12).alias("hash"))


@query("""select event_id, 'sess_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(md5(cast(event_id as varchar)), 1, 6) as sessao from events""")
def session_id(t: Tables) -> DataFrame:
    made = F.concat(F.lit("sess_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 6))
    return t.events.select("event_id", made.alias("sessao"))


@query("""select id, strftime(adicionado at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as iso, strftime(adicionado at time zone 'UTC', '%d/%m/%Y %H:%M') as data from exemplos""")
def ts_format(t: Tables) -> DataFrame:
    return t.exemplos.select("id", F.date_format("adicionado", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("adicionado", "dd/MM/yyyy HH:mm").alias("data"))


# --- text and retrieval ----------------------------------------------------------------------------------------------


@query(r"select id, trim(regexp_replace(strip_accents(lower(texto)), '\s{2,}', ' ', 'g')) as texto from exemplos")
def normalize_text(t: Tables) -> DataFrame:
    return t.exemplos.select("id", F.trim(F.regexp_replace(T.fold_column(F.col("texto")), r"\s{2,}", " ")).alias("texto"))


TOKEN_CODE = r"\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*|//[^\n]*|0[xX][0-9a-fA-F]+|\d+\.\d+|\d+|[A-Za-z_]\w*|===|!==|==|!=|<=|>=|=>|->|&&|\|\||\+=|-=|\*=|/=|\*\*|//|[-+*/%=<>!&|^~?:;,.(){}\[\]]|\n|\t|\S"


@query(f"with c as (select id, unnest(regexp_extract_all(conteudo, '{TOKEN_CODE.replace(chr(39), chr(39) * 2)}')) as token from contexto_codigo) select id, count(*) as n, count(distinct token) as distintos from c group by id")
def code_tokens(t: Tables) -> DataFrame:
    each = t.contexto_codigo.select("id", F.explode(F.regexp_extract_all("conteudo", F.lit(TOKEN_CODE), F.lit(0))).alias("token"))
    return each.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("distintos"))


@query(f"select id, {looks_sql('texto')} as codigo from exemplos where texto is not null")
def looks_like_code(t: Tables) -> DataFrame:
    return t.exemplos.filter("texto is not null").select("id", codescan.looks_like_code(F.col("texto")).alias("codigo"))


CHUNKS_SQL = f"""c as (select doc_id, text, case when length(text) <= 300 then 1 else cast(ceil((length(text) - 300) / 150) as integer) + 1 end as n from documents where length(text) > 0),
    u as (select doc_id, unnest(range(n)) as chunk_no, text from c),
    chunk as (select doc_id, cast(chunk_no as integer) as chunk_no, {strip_sql('substr(text, chunk_no * 150 + 1, 300)')} as trecho from u where {strip_sql('substr(text, chunk_no * 150 + 1, 300)')} <> '')"""


@query(f"with {CHUNKS_SQL} select doc_id, chunk_no, trecho from chunk")
def chunks(t: Tables) -> DataFrame:
    return retrieval.chunks(t.documents, "doc_id", "text")


@query(f"with x as (select doc_id, unnest(regexp_extract_all(lower(text), '{retrieval.TOKEN}')) as token from documents) select doc_id, count(*) as n from x group by doc_id")
def rag_tokens(t: Tables) -> DataFrame:
    return retrieval.tokens(t.documents, ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("n"))


TF_SQL = f"""x as (select doc_id, chunk_no, regexp_extract_all(lower(trecho), '{retrieval.TOKEN}') as a from chunk),
    y as (select doc_id, chunk_no, len(a) as size, unnest(a) as token from x),
    tf as (select doc_id, chunk_no, token, count(*) as n, count(*) / min(size) as tf from y group by doc_id, chunk_no, token)"""


@query(f"with {CHUNKS_SQL}, {TF_SQL} select token, count(*) as df, cast(sum(n) as bigint) as n, round(sum(tf), 6) as tf from tf group by token")
def tf(t: Tables) -> DataFrame:
    p = retrieval.term_frequencies(retrieval.chunks(t.documents, "doc_id", "text"), ["doc_id", "chunk_no"], "trecho")
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("n"), F.round(F.sum("tf"), 6).alias("tf"))


@query(f"with {CHUNKS_SQL}, {TF_SQL} select token, count(*) as df from tf group by token")
def df(t: Tables) -> DataFrame:
    return retrieval.document_frequencies(retrieval.term_frequencies(retrieval.chunks(t.documents, "doc_id", "text"), ["doc_id", "chunk_no"], "trecho"))


@query(
    f"""with {CHUNKS_SQL}, {TF_SQL}, total as (select count(*) as total from chunk),
    w as (select token, ln((total + 1) / (count(*) + 1)) + 1 as idf from tf, total group by token, total),
    p as (select doc_id, chunk_no, token, tf * idf as w from tf join w using (token)),
    nrm as (select doc_id, chunk_no, sqrt(sum(w * w)) as norm from p group by doc_id, chunk_no),
    qa as (select item_id, regexp_extract_all(lower(texto), '{retrieval.TOKEN}') as a from avaliacao),
    qy as (select item_id, len(a) as size, unnest(a) as token from qa),
    q as (select item_id, token, count(*) / min(size) * coalesce(min(idf), 0) as q from qy left join w using (token) group by item_id, token),
    qn as (select item_id, sqrt(sum(q * q)) as q_norm from q group by item_id),
    d as (select item_id, doc_id, chunk_no, sum(p.w * q.q) as dot from p join q using (token) group by item_id, doc_id, chunk_no),
    s as (select item_id, doc_id, chunk_no, round(round(dot / (norm * q_norm), 9), 4) as score from d join nrm using (doc_id, chunk_no) join qn using (item_id)),
    r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id, chunk_no) as integer) as rank from s where score > 0)
    select item_id, rank, doc_id, chunk_no, score from r where rank <= 3"""
)
def tfidf_topk(t: Tables) -> DataFrame:
    return retrieval.rank_chunks(retrieval.chunks(t.documents, "doc_id", "text"), t.avaliacao, "item_id", "texto")


@query()
def rag_context(t: Tables) -> DataFrame:
    table = retrieval.chunks(t.documents, "doc_id", "text")
    return retrieval.context_strings(retrieval.rank_chunks(table, t.avaliacao, "item_id", "texto"), table, "item_id")


# --- messages --------------------------------------------------------------------------------------------------------


@query(
    "with s as (select id, (nullif(regexp_extract(conteudo, " + sql_text(intent.FENCE) + ", 1), '') is not null or " + looks_sql("conteudo") + ") as code, "
    + ", ".join("round(" + " + ".join(f"case when regexp_matches(lower(conteudo), '{p}') then {w} else 0.0 end" for p, w in marks) + f", 6) as {name}" for name, marks in intent.INTENTS.items())
    + f" from historico where conteudo is not null), m as (select *, greatest({', '.join(intent.INTENTS)}) as top from s) select id, case when top <= 0 and code then 'analisar' when top <= 0 then '{intent.TALK}' "
    + " ".join(f"when {a} > 0 and analisar > 0 and {a} >= round(analisar * {intent.ACTION_SHARE}, 6) then '{a}'" for a in intent.ACTIONS) + " "
    + " ".join(f"when {name} = top then '{name}'" for name in intent.INTENTS)
    + f" end as intencao, cast(case when top <= 0 and code then {intent.CODE_CONFIDENCE} when top <= 0 then {intent.TALK_CONFIDENCE} else round(least(1.0, top / {intent.FULL_SCORE}), 2) end as double) as confianca from m"
)
def intents(t: Tables) -> DataFrame:
    return intent.intents(t.historico, "id", "conteudo")


@query(r"select doc_id, nullif(regexp_extract(text, '(?s)```\w*\n(.*?)```', 1), '') as codigo from documents")
def extract_code(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", intent.fenced_code(F.col("text")).alias("codigo"))


@query("select id, case when conteudo is null then null " + " ".join(f"when regexp_matches(lower(conteudo), '{p}') then '{n}'" for n, p in intent.CLASSES) + " else 'outra' end as classe from historico")
def reply_class(t: Tables) -> DataFrame:
    return t.historico.select("id", intent.message_class(F.col("conteudo")).alias("classe"))


@query("select id, case " + " ".join(f"when regexp_matches(lower(conteudo), '(^|[^\\p{{L}}\\p{{N}}_]){x}($|[^\\p{{L}}\\p{{N}}_])') then '{x}'" for x in intent.LANGUAGES) + " end as linguagem from historico")
def language_mention(t: Tables) -> DataFrame:
    return t.historico.select("id", intent.language_mention(F.col("conteudo")).alias("linguagem"))


@query(r"select id, nullif(regexp_extract(conteudo, '([\w\-]+\.(?:py|js|ts|java|go|rs|rb|php|sql|sh|html|css|json|ya?ml|xml|md))', 1), '') as arquivo from contexto_codigo")
def filename_mention(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", intent.file_mention(F.col("conteudo")).alias("arquivo"))


@query(
    f"""select id, nullif(regexp_extract(conteudo, {sql_text(intent.NAME)}, 2), '') as nome, nullif(regexp_extract(lower(conteudo), {sql_text(intent.FAVOURITE)}, 2), '') as linguagem,
    case regexp_extract(lower(conteudo), {sql_text(intent.STYLE)}, 2) when 'simpl' then 'simples' when 'detalh' then 'detalhado' when 'técnic' then 'tecnico' when 'tecnic' then 'tecnico' end as estilo,
    case when regexp_matches(lower(conteudo), {sql_text(intent.NO_EMOJI)}) then false when regexp_matches(lower(conteudo), {sql_text(intent.EMOJI)}) then true end as emojis from historico"""
)
def pref_extract(t: Tables) -> DataFrame:
    return intent.stated_preferences(t.historico, "id", "conteudo")


@query()
def prompt(t: Tables) -> DataFrame:
    return intent.prompts(t.historico.filter("sessao_id is not null"), F.lit("explica"))


# --- code ------------------------------------------------------------------------------------------------------------


LANGUAGE_SQL = (
    "with e as (select id, conteudo, lower(case when contains(nome_arquivo, '.') then list_last(string_split(nome_arquivo, '.')) end) as ext from contexto_codigo), s as (select id, conteudo, case "
    + " ".join(f"when ext in ({', '.join(repr(x) for x in exts.split())}) then '{lang}'" for lang, exts in codescan.EXTENSIONS.items())
    + " end as por_nome, "
    + ", ".join("len(regexp_extract_all(conteudo, '" + mark.replace("'", "''") + f"')) as \"{lang}\"" for lang, mark in codescan.MARKS.items())
    + " from e), m as (select *, greatest("
    + ", ".join(f'"{x}"' for x in codescan.MARKS)
    + ") as top from s) select id, coalesce(por_nome, case when conteudo is null then null when top = 0 then 'desconhecida' "
    + " ".join(f"when \"{x}\" = top then '{x}'" for x in codescan.MARKS)
    + " end) as linguagem from m"
)


@query(LANGUAGE_SQL)
def code_language(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", codescan.detect_language(F.col("nome_arquivo"), F.col("conteudo")).alias("linguagem"))


LINES_SQL = "l as (select id, unnest(range(1, len(string_split(replace(conteudo, chr(13), ''), chr(10))) + 1)) as linha, unnest(string_split(replace(conteudo, chr(13), ''), chr(10))) as texto from contexto_codigo where conteudo is not null)"


@query(
    f"""with {LINES_SQL}, k as (select id, trim(replace(texto, chr(9), ' ')) as x from l)
    select id, count(*) as total, count(*) filter (where x <> '' and not starts_with(x, '#')) as codigo, count(*) filter (where starts_with(x, '#')) as comentario, count(*) filter (where x = '') as branco from k group by id"""
)
def line_classes(t: Tables) -> DataFrame:
    return codescan.line_classes(t.contexto_codigo)


@query()
def block_line_classes(t: Tables) -> DataFrame:
    return codescan.block_line_classes(t.contexto_codigo, "#", '"""', '"""')


@query(
    f"""with {LINES_SQL}, d as (select id, sum(length(regexp_replace(texto, '[^{{]', '', 'g')) - length(regexp_replace(texto, '[^}}]', '', 'g'))) over (partition by id order by linha) as d from l)
    select id, cast(greatest(0, max(d)) as bigint) as profundidade from d group by id"""
)
def nesting_depth(t: Tables) -> DataFrame:
    return codescan.brace_depth(t.contexto_codigo)


@query("select id, cast(1" + "".join(f" + len(regexp_extract_all(conteudo, '{p}'))" for p in codescan.DECISIONS) + " as bigint) as complexidade from contexto_codigo where conteudo is not null")
def complexity(t: Tables) -> DataFrame:
    return t.contexto_codigo.filter("conteudo is not null").select("id", codescan.complexity(F.col("conteudo")).alias("complexidade"))


FUNCTIONS_SQL = f"{LINES_SQL}, f as (select id, linha, regexp_extract(texto, '{codescan.FUNCTIONS['python']}', 1) as nome from l), g as (select * from f where nome <> ''), n as (select id, max(linha) as total from l group by id)"


@query(f"with {FUNCTIONS_SQL} select id, cast(linha as integer) as linha, nome, cast(coalesce(lead(linha) over (partition by id order by linha) - linha - 1, total - linha) as bigint) as tamanho from g join n using (id)")
def function_spans(t: Tables) -> DataFrame:
    return codescan.functions(t.contexto_codigo)


IMPORTS_SQL = LINES_SQL + r""", m as (select id, cast(linha as integer) as linha, trim(case when regexp_extract(texto, '^\s*import\s+(.+)', 1) <> '' then regexp_extract(texto, '^\s*import\s+(.+)', 1)
    else regexp_extract(texto, '^\s*from\s+(\S+)\s+import\s+.+', 1) end) as modulo from l)"""


@query(f"with {IMPORTS_SQL} select * from m where modulo <> ''")
def imports(t: Tables) -> DataFrame:
    return codescan.imports(t.contexto_codigo)


@query(f"with {IMPORTS_SQL}, d as (select *, min(linha) over (partition by id, modulo) as primeira from m where modulo <> '') select * from d where linha > primeira")
def dup_imports(t: Tables) -> DataFrame:
    return codescan.duplicate_imports(t.contexto_codigo)


def lint_sql(rules: list[tuple[str, str, str | None, int]]) -> str:
    """The rules as one branch each."""
    parts = []
    for name, pattern, unless, severity in rules:
        but = f" and not regexp_matches(texto, '{unless.replace(chr(39), chr(39) * 2)}')" if unless else ""
        parts.append(f"select id, cast(linha as integer) as linha, '{name}' as regra, {severity} as severidade from l where regexp_matches(texto, '{pattern.replace(chr(39), chr(39) * 2)}'){but}")
    return f"with {LINES_SQL} " + " union all ".join(parts)


@query(lint_sql(codescan.PYTHON_RULES))
def lint_python(t: Tables) -> DataFrame:
    return codescan.lint(t.contexto_codigo, codescan.PYTHON_RULES)


@query(lint_sql(codescan.JS_RULES))
def lint_js(t: Tables) -> DataFrame:
    return codescan.lint(t.contexto_codigo, codescan.JS_RULES)


@query(lint_sql(codescan.GENERIC_RULES))
def lint_generic(t: Tables) -> DataFrame:
    return codescan.lint(t.contexto_codigo, codescan.GENERIC_RULES)


@query(f"select regra, severidade, count(*) as n, count(distinct id) as arquivos from ({lint_sql(codescan.PYTHON_RULES)}) group by regra, severidade")
def lint_summary(t: Tables) -> DataFrame:
    return codescan.lint_summary(codescan.lint(t.contexto_codigo, codescan.PYTHON_RULES))


JS_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(texto, '{p}', 1), '')" for p in codescan.JS_FORMS) + ")"


@query(f"with {LINES_SQL} select id, cast(linha as integer) as linha, {JS_SQL} as nome from l where {JS_SQL} is not null and {JS_SQL} not in {codescan.JS_CONTROL}")
def js_functions(t: Tables) -> DataFrame:
    return codescan.js_functions(t.contexto_codigo)


@query(
    f"""with p as ({lint_sql(codescan.PYTHON_RULES)}) select id, linha, regra, severidade, row_number() over (partition by id order by severidade desc, linha, regra) as ordem from p"""
)
def lint_rows(t: Tables) -> DataFrame:
    """Problems of each file, the worst first."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("severidade").desc(), "linha", "regra")
    return codescan.lint(t.contexto_codigo, codescan.PYTHON_RULES).withColumn("ordem", F.row_number().over(w).cast("long"))


COMPLEXITY_SQL = "cast(1" + "".join(f" + len(regexp_extract_all(conteudo, '{p}'))" for p in codescan.DECISIONS) + " as bigint)"
MEASURES_SQL = (
    f"{FUNCTIONS_SQL}, lo as (select id, max(tamanho) as maior from (select id, coalesce(lead(linha) over (partition by id order by linha) - linha - 1, total - linha) as tamanho from g join n using (id)) group by id), "
    r"de as (select id, max((length(texto) - length(regexp_replace(texto, '^\s+', ''))) // 4) as profundidade from l where trim(texto) <> '' group by id), "
    f"cx as (select id, {COMPLEXITY_SQL} as cx from contexto_codigo where conteudo is not null)"
)


@query(
    f"""with {MEASURES_SQL}, m as (select cx.id, cx, coalesce(maior, 0) as maior, coalesce(profundidade, 0) as profundidade from cx left join lo using (id) left join de using (id))
    select id, 'complexidade' as sugestao from m where cx > 20 union all select id, 'funcoes_longas' from m where maior > 80 union all select id, 'profundidade' from m where profundidade > 6"""
)
def suggestions(t: Tables) -> DataFrame:
    return codescan.suggestions(t.contexto_codigo)


@query(
    f"""with {MEASURES_SQL}, w as (select id, count(*) filter (where severidade >= 4) as s4, count(*) filter (where severidade = 3) as s3, count(*) filter (where severidade <= 2) as s2
    from ({lint_sql(codescan.PYTHON_RULES)}) group by id)
    select cx.id, round(greatest(0.0::double, least(10.0::double, 10 - 2.0::double * coalesce(s4, 0) - 0.5::double * coalesce(s3, 0) - 0.1::double * coalesce(s2, 0) - 0.05::double * greatest(0, cx - 10)
    - 0.3::double * greatest(0, coalesce(profundidade, 0) - 5) - case when coalesce(maior, 0) > 100 then 1 else 0 end)), 6) as score from cx left join w using (id) left join de using (id) left join lo using (id)"""
)
def quality_score(t: Tables) -> DataFrame:
    return codescan.line_score(t.contexto_codigo, codescan.PYTHON_RULES)


PYTHON_FUNCTIONS_SQL = f"""{LINES_SQL}, v as (select *, lead(texto) over (partition by id order by linha) as proxima, max(linha) over (partition by id) as total from l), h as (select *, regexp_extract(texto, '{codescan.FUNCTIONS['python']}', 1) as nome,
    regexp_matches(texto, '{codescan.PYTHON_HEAD}') as fechada from v), pf as (select id, cast(linha as integer) as linha, nome, cast(coalesce(lead(linha) over (partition by id order by linha) - linha - 1, total - linha) as bigint) as tamanho,
    case when fechada then cast(len(regexp_extract_all(regexp_extract(texto, '{codescan.PYTHON_HEAD}', 2), '[^,]*[^,\\s][^,]*')) as bigint) end as parametros,
    case when fechada then coalesce(regexp_matches(proxima, '^\\s*(\"\"\"|\'\'\'\'\'\')'), false) end as documentada from h where nome <> '')"""
LINT_ALL_SQL = f"""select * from ({lint_sql(codescan.PYTHON_RULES)}) union all select id, linha, regra, severidade from (with {PYTHON_FUNCTIONS_SQL} select id, linha, 'many_parameters' as regra, 3 as severidade from pf where parametros > 6
    union all select id, linha, 'long_function', 3 from pf where tamanho > 50 union all select id, linha, 'no_docstring', 1 from pf where not documentada and not starts_with(nome, '_'))
    union all select id, linha, 'repeated_import', 2 from (with {IMPORTS_SQL} select id, linha, min(linha) over (partition by id, modulo) as primeira from m where modulo <> '') where linha > primeira"""


@query(f"with {PYTHON_FUNCTIONS_SQL} select * from pf")
def python_functions(t: Tables) -> DataFrame:
    return codescan.python_functions(t.contexto_codigo)


CLASS_SQL = r"^\s*class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:"


@query(f"with {LINES_SQL} select id, cast(linha as integer) as linha, regexp_extract(texto, '{CLASS_SQL}', 1) as nome, regexp_extract(texto, '{CLASS_SQL}', 2) as heranca from l where regexp_extract(texto, '{CLASS_SQL}', 1) <> ''")
def python_classes(t: Tables) -> DataFrame:
    return codescan.python_classes(t.contexto_codigo)


@query(LINT_ALL_SQL)
def lint_python_all(t: Tables) -> DataFrame:
    return codescan.lint_python(t.contexto_codigo)


@query(f"select regra, severidade, count(*) as n, count(distinct id) as arquivos from ({LINT_ALL_SQL}) group by regra, severidade")
def lint_summary_all(t: Tables) -> DataFrame:
    return codescan.lint_summary(codescan.lint_python(t.contexto_codigo))


@query(f"with p as ({LINT_ALL_SQL}) select id, linha, regra, severidade, row_number() over (partition by id order by severidade desc, linha, regra) as ordem from p")
def lint_rows_all(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("severidade").desc(), "linha", "regra")
    return codescan.lint_python(t.contexto_codigo).withColumn("ordem", F.row_number().over(w).cast("long"))


@query(
    f"""select * from ({ORACLE['suggestions']}) union all select id, 'documentacao' from (with {PYTHON_FUNCTIONS_SQL} select id from pf where documentada is not null group by id having count(*) > 3 and count(*) filter (where documentada) * 2 < count(*))"""
)
def suggestions_all(t: Tables) -> DataFrame:
    return codescan.python_suggestions(t.contexto_codigo)


@query(ORACLE["quality_score"].replace(f"({lint_sql(codescan.PYTHON_RULES)})", f"({LINT_ALL_SQL})"))
def quality_score_all(t: Tables) -> DataFrame:
    return codescan.quality_score(t.contexto_codigo, codescan.lint_python(t.contexto_codigo))


@query(r"select id, case when ends_with(c, chr(10)) then c else c || chr(10) end as conteudo from (select id, regexp_replace(conteudo, '\n{4,}', chr(10) || chr(10) || chr(10), 'g') as c from contexto_codigo)")
def fix_blank_lines(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", rewrite.fix_blank_lines(F.col("conteudo")).alias("conteudo"))


def _nested_sql(column: str, steps: list[tuple[str, str]]) -> str:
    """The steps as regular-expression replacements in SQL."""
    for pattern, to in steps:
        column = f"regexp_replace({column}, {sql_text(pattern)}, {sql_text(to.replace('$', chr(92)))}, 'g')"
    return column


@query(f"select id, {_nested_sql('conteudo', rewrite.COMPARISONS)} as conteudo from contexto_codigo")
def fix_python_cmp(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", rewrite.fix_comparisons(F.col("conteudo")).alias("conteudo"))


@query(r"select id, regexp_replace(conteudo, '(?m)^([ \t]*)(print\s*\()', '\1# \2', 'g') as conteudo from contexto_codigo")
def fix_prints(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", rewrite.comment_out(F.col("conteudo"), "print", "#").alias("conteudo"))


@query()
def fix_js_eq(t: Tables) -> DataFrame:
    return rewrite.fix_loose_equality(t.contexto_codigo)


@query(r"select id, regexp_replace(conteudo, '(?m)^(\s*)var\s+', '\1let ', 'g') as conteudo from contexto_codigo")
def fix_js_var(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", rewrite.fix_var(F.col("conteudo")).alias("conteudo"))


@query(
    f"""select id, array_to_string(list_transform(string_split(conteudo, chr(10)), lambda x: case when regexp_matches(x, {sql_text(rewrite.OPEN_STATEMENT)})
    then regexp_replace(x, '\\s+$', '') || ';' else x end), chr(10)) as conteudo from contexto_codigo"""
)
def fix_semicolons(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", rewrite.add_semicolons(F.col("conteudo")).alias("conteudo"))


@query(r"select id, regexp_replace(conteudo, '(?m)^([ \t]*)(console\.(?:log|debug|warn)\s*\([^)\n]*\);?)', '\1// \2', 'g') as conteudo from contexto_codigo")
def fix_console(t: Tables) -> DataFrame:
    return t.contexto_codigo.select("id", rewrite.comment_console(F.col("conteudo")).alias("conteudo"))


@query()
def fix_long_comments(t: Tables) -> DataFrame:
    return rewrite.wrap_comments(t.contexto_codigo)


@query()
def fix_var_const(t: Tables) -> DataFrame:
    return rewrite.var_to_const(t.contexto_codigo)


@query()
def fix_docstrings(t: Tables) -> DataFrame:
    return rewrite.add_docstrings(t.contexto_codigo)


@query()
def fix_import_order(t: Tables) -> DataFrame:
    return rewrite.organise_imports(t.contexto_codigo)


@query()
def refactor_delta(t: Tables) -> DataFrame:
    """What the fixes of each file's language change, and the scores before and after."""
    return rewrite.improve(t.contexto_codigo).withColumn("conteudo", F.md5("conteudo"))


@query(
    r"""select id, array_to_string(list_transform(list_sort(list_distinct(n)), lambda x: x), ',') as nomes from (select id, regexp_extract_all(conteudo, '(?m)(?:^|[^\w.])([a-z]|tmp|temp|aux|var|data)[ \t]*=(?:[^=]|$)', 1) as n from contexto_codigo) where len(n) > 0"""
)
def generic_names(t: Tables) -> DataFrame:
    return rewrite.generic_names(t.contexto_codigo).select("id", F.array_join(F.array_sort("nomes"), ",").alias("nomes"))


@query()
def subword_split(t: Tables) -> DataFrame:
    """Greedy longest pieces of every distinct word, by the plain pieces of a public vocabulary."""
    known = [x.replace(bpe.END, "") for x in bpe.Vocabulary.load(bpe.DEFAULT_VOCABULARY).ids]
    return bpe.token_frequency(bpe.split_words(bpe.word_counts(t.documents, "text"), sorted(set(known) - {""})))


@query()
def fix_credentials(t: Tables) -> DataFrame:
    named = t.contexto_codigo.withColumn("linguagem", codescan.detect_language(F.col("nome_arquivo"), F.col("conteudo")))
    return rewrite.credentials_to_environment(named)


@query(
    LINES_SQL.join(["with ", r""", i as (select *, regexp_matches(texto, '^\s*(import\s+\S|from\s+\S+\s+import\s)') as imp from l),
    k as (select *, row_number() over (partition by id, trim(texto), imp order by linha) as k from i)
    select id, string_agg(texto, chr(10) order by linha) as conteudo from k where not imp or k = 1 group by id"""])
)
def fix_dup_imports(t: Tables) -> DataFrame:
    return rewrite.drop_duplicate_imports(t.contexto_codigo.filter("conteudo is not null"))


CLEAN_SQL = _nested_sql("text", [(r"\{\{[^\{\}]*?\}\}", "")] * 8 + [(r"\{\|[^\{\}]*?\|\}", "")] * 8 + [("(?ims)" + markup.MARKUP, "$1$2"), (markup.ENTITY, " "), (r"[ \t]+", " ")])


@query(f"select doc_id, {CLEAN_SQL} as texto from documents")
def clean_markup(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", markup.clean_markup(F.col("text")).alias("texto"))


query(
    f"""with c as (select doc_id as id, list_filter(list_transform(regexp_split_to_array({CLEAN_SQL}, '\\r?\\n'), lambda x: trim(x)), lambda x: length(x) >= 80 and not starts_with(x, '|') and not starts_with(x, '!')
    and length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) > 0.6) as p from documents where text is not null and not starts_with(lower(text), '#redirect'))
    select id, cast(unnest(range(len(p))) as integer) as n, unnest(p) as paragrafo from c"""
)(wiki_extract)


@query(f"select doc_id, " + "regexp_replace(" * 8 + "text" + r", '\{\{[^\{\}]*?\}\}', '', 'g')" * 8 + " as texto from documents")
def strip_nested(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", markup.strip_nested(F.col("text"), "{{", "}}").alias("texto"))


# --- vectors and images ----------------------------------------------------------------------------------------------

X_SQL = "x as (select vec_id as id, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from embeddings)"
P_SQL = X_SQL + ", e as (select id, pos, exp((x - max(x) over (partition by id)) / 0.1) as e from x), p as (select id, pos, e / sum(e) over (partition by id) as p from e)"


def _probabilities(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(numerics.softmax(F.col("embedding"), 0.1)).alias("pos", "p"))


@query(f"with {P_SQL} select id, cast(pos as integer) as pos, round(p, 6) as p from p")
def softmax(t: Tables) -> DataFrame:
    return _probabilities(t).select("id", "pos", F.round("p", 6).alias("p"))


@query(f"with {P_SQL}, k as (select id, pos, round(p, 9) as p, rank() over (partition by id order by round(p, 9) desc) as posto from p) select id, cast(pos as integer) as pos, cast(posto as integer) as posto from k where posto <= 10")
def top_k(t: Tables) -> DataFrame:
    return numerics.top_k(_probabilities(t).withColumn("p", F.round("p", 9)), 10).select("id", "pos", "posto")


@query(f"with {P_SQL}, k as (select id, pos, p, sum(p) over (partition by id order by p desc, pos rows unbounded preceding) as m from (select id, pos, round(p, 9) as p from p)) select id, cast(pos as integer) as pos from k where round(m - p, 9) < 0.9")
def top_p(t: Tables) -> DataFrame:
    kept = numerics.top_p(_probabilities(t).withColumn("p", F.round("p", 9)), 2.0)
    return kept.filter(F.round(F.col("massa") - F.col("p"), 9) < 0.9).select("id", "pos")


@query(
    f"""with {X_SQL}, y as (select id, pos, case when pos in (1, 5) then -1e9 when pos % 3 <> 0 then x when x > 0 then x / 1.1 else x * 1.1 end / 0.8 as x from x), e as (select id, pos, exp(x - max(x) over (partition by id)) as e from y),
    p as (select id, pos, round(e / sum(e) over (partition by id), 9) as p from e), k as (select *, rank() over (partition by id order by p desc) as r from p),
    m as (select id, pos, p, sum(p) over (partition by id order by p desc, pos rows unbounded preceding) as m from k where r <= 10), n as (select id, pos, p from m where round(m - p, 9) < 0.1)
    select id, cast(pos as integer) as pos, round(p / sum(p) over (partition by id), 6) as p from n"""
)
def sampling(t: Tables) -> DataFrame:
    """What the next token is drawn from, with two tokens forbidden and every third one seen."""
    seen, forbidden = F.array(*map(F.lit, range(0, 64, 3))), F.array(F.lit(1), F.lit(5))
    kept = numerics.sampling_chain(F.col("embedding"), seen, forbidden, share=0.1)
    return t.embeddings.select(F.col("vec_id").alias("id"), F.explode(kept).alias("x")).select("id", "x.pos", F.round("x.p", 6).alias("p"))


@query(f"with {X_SQL} select id, cast(pos as integer) as pos, round(case when pos % 3 <> 0 then x when x > 0 then x / 1.3 else x * 1.3 end, 6) as y from x")
def rep_penalty(t: Tables) -> DataFrame:
    return numerics.repetition_penalty(numerics.exploded(t.embeddings, "vec_id", "embedding"), F.col("pos") % 3 == 0, 1.3).select("id", "pos", F.round("y", 6).alias("y"))


@query(f"with {X_SQL} select id, cast(pos as integer) as pos, round((x - avg(x) over w) / sqrt(var_pop(x) over w + 1e-5), 6) as y from x window w as (partition by id)")
def layernorm(t: Tables) -> DataFrame:
    normal = t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(numerics.layer_norm_array(F.col("embedding"))).alias("pos", "y"))
    return normal.select("id", "pos", F.round("y", 6).alias("y"))


@query(f"with {X_SQL} select id, cast(pos as integer) as pos, round(0.5 * x * (1 + (exp(2 * u) - 1) / (exp(2 * u) + 1)), 6) as gelu, round(x / (1 + exp(-x)), 6) as silu from (select *, 0.7978845608028654 * (x + 0.044715 * x * x * x) as u from x)")
def gelu(t: Tables) -> DataFrame:
    x = numerics.exploded(t.embeddings, "vec_id", "embedding")
    return x.select("id", "pos", F.round(numerics.gelu(F.col("x")), 6).alias("gelu"), F.round(numerics.silu(F.col("x")), 6).alias("silu"))


@query(f"with {P_SQL} select id, cast(pos as integer) as pos, round(-ln(p + 1e-9), 6) as perda from p")
def cross_entropy(t: Tables) -> DataFrame:
    """The loss of each row for each token it may have to predict."""
    return _probabilities(t).select("id", "pos", F.round(numerics.cross_entropy(F.col("p")), 6).alias("perda"))


@query(f"with {P_SQL}, l as (select round(-ln(p + 1e-9), 6) as perda from p) select round(exp(least(avg(perda), 20)), 4) as perplexidade from l")
def perplexity(t: Tables) -> DataFrame:
    return cross_entropy(t).agg(F.round(numerics.perplexity(F.col("perda")), 4).alias("perplexidade"))


@query("select pos, i, round(case when i % 2 = 0 then sin(a) else cos(a) end, 6) as valor from (select pos, i, pos / pow(10000.0, (2 * (i // 2)) / 64.0) as a from (select unnest(range(128)) as pos), (select unnest(range(64)) as i))")
def positional_encoding(t: Tables) -> DataFrame:
    table = numerics.positional_encoding(t.spark.range(128).withColumnRenamed("id", "pos"), 64)
    return table.select("pos", F.col("i").cast("long").alias("i"), F.round("valor", 6).alias("valor"))


@query(
    """with e as (select vec_id // 32 as seq, vec_id % 32 as pos, embedding from embeddings),
    s as (select a.seq, a.pos as q, b.pos as k, list_sum(list_transform(range(1, 65), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double))) / 8 as s from e a join e b on a.seq = b.seq and b.pos <= a.pos),
    x as (select *, exp(s - max(s) over (partition by seq, q)) as e from s)
    select seq, q, k, round(e / (sum(e) over (partition by seq, q) + 1e-9), 6) as peso from x"""
)
def attention_scores(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.expr("vec_id div 32").alias("seq"), F.expr("vec_id % 32").alias("pos"), "embedding")
    return numerics.causal_attention(e, "seq", "pos", "embedding", 64).withColumn("peso", F.round("peso", 6))


def _pixels(t: Tables) -> DataFrame:
    """A pixel for each event: image by user, channels by its number."""
    return t.events.select(F.col("user_id").alias("img"), (F.col("event_id") * 7919 % 256).alias("r"), (F.col("event_id") * 104729 % 256).alias("g"), (F.col("event_id") * 1299709 % 256).alias("b"))


PIXELS_SQL = "px as (select user_id as img, event_id * 7919 % 256 as r, event_id * 104729 % 256 as g, event_id * 1299709 % 256 as b from events)"


@query(
    f"""with {PIXELS_SQL}, f as (select img, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b from px),
    d as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo, greatest(r, g, b) - least(r, g, b) as d from f),
    h as (select *, case when d = 0 then 0 when hi = r then 60 * ((g - b) / d - 6 * floor((g - b) / d / 6)) when hi = g then 60 * ((b - r) / d + 2) else 60 * ((r - g) / d + 4) end as h from d)
    select img, case when hi < 0.15 then 'preto' when lo > 0.85 then 'branco' when d < 0.12 or d / hi < 0.2 then 'cinza' when h >= 330 then 'rosa/vermelho' when h >= 270 then 'roxo/violeta' when h >= 210 then 'azul'
    when h >= 180 then 'azul claro' when h >= 150 then 'ciano' when h >= 90 then 'verde' when h >= 60 then 'amarelo/verde' when h >= 30 then 'laranja/amarelo' else 'vermelho' end as cor, count(*) as n from h group by 1, 2"""
)
def rgb_name(t: Tables) -> DataFrame:
    return images.colour_histogram(_pixels(t))


@query(f"with {PIXELS_SQL} select img, round(count(distinct (r, g, b)) / count(*), 6) as razao from px group by img")
def colour_ratio(t: Tables) -> DataFrame:
    return images.unique_colour_share(_pixels(t)).withColumn("razao", F.round("razao", 6))


@query(
    f"""with {PIXELS_SQL}, s as (select img, (avg(r) + avg(g) + avg(b)) / 3 as m, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 as d from px group by img)
    select img, round(m, 6) as brilho, round(d, 6) as desvio, case when m > 200 then 'clara' when m < 50 then 'escura' else 'equilibrada' end as exposicao, case when d > 60 then 'alto' when d < 15 then 'baixo' else 'medio' end as contraste from s"""
)
def brightness(t: Tables) -> DataFrame:
    return images.brightness(_pixels(t)).withColumns({"brilho": F.round("brilho", 6), "desvio": F.round("desvio", 6)})


@query(
    """with s as (select event_id, 1 + event_id * 31 % 5000 as w, 1 + event_id * 17 % 5000 as h from events)
    select event_id, case when w > h * 1.5 then 'paisagem' when h > w * 1.5 then 'retrato' else 'quadrada' end as orientacao, round(w * h / 1e6, 2) as mp,
    case when w <= 4096 and h <= 4096 then w else cast(floor(w * (4096.0::double / greatest(w, h))) as integer) end as largura from s"""
)
def image_class(t: Tables) -> DataFrame:
    s = t.events.select("event_id", (1 + F.col("event_id") * 31 % 5000).alias("w"), (1 + F.col("event_id") * 17 % 5000).alias("h"))
    return s.select("event_id", images.orientation(F.col("w"), F.col("h")).alias("orientacao"), images.megapixels(F.col("w"), F.col("h")).alias("mp"), images.resized(F.col("w"), F.col("h")).largura.cast("long").alias("largura"))


@query(
    """with s as (select event_id, 1 + event_id * 31 % 5000 as w, 1 + event_id * 17 % 5000 as h from events),
    r as (select *, w / h as q from s), d as (select *, least(abs(q - 1.0), abs(q - 1.33), abs(q - 1.5), abs(q - 1.78), abs(q - 2.39)) as d from r)
    select event_id, case when d >= 0.15 then w || '×' || h when abs(q - 1.0) = d then '1:1' when abs(q - 1.33) = d then '4:3' when abs(q - 1.5) = d then '3:2' when abs(q - 1.78) = d then '16:9' else '21:9' end as proporcao from d"""
)
def aspect_ratio(t: Tables) -> DataFrame:
    s = t.events.select("event_id", (1 + F.col("event_id") * 31 % 5000).alias("w"), (1 + F.col("event_id") * 17 % 5000).alias("h"))
    return s.select("event_id", images.aspect_ratio(F.col("w"), F.col("h")).alias("proporcao"))
