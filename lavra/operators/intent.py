"""Message analytics: weighted patterns, code blocks, mentions and stated preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
# The intents, the one of a message without any, and the confidences and share of the rules that follow.
TALK, TALK_CONFIDENCE, CODE_CONFIDENCE, ACTION_SHARE, FULL_SCORE = "conversa", 0.9, 0.7, 0.8, 3.0
# Words that speak for an intent by weight, chosen by us: what is asked for weighs 1, what is complained of or wished 0.6, what is spoken of 0.4.
WORDS = {
    "analisar": {1.0: "analisa analise analisar avalia avalie avaliar examina examine inspeciona inspecione audita audite confere confira", 0.6: "revisa revise olha olhe verifica verifique", 0.4: "qualidade problema problemas"},
    "corrigir": {1.0: "conserta conserte consertar corrige corrija corrigir arruma arrume arrumar fix", 0.6: "quebrou travou falha falhando", 0.4: "erro erros bug bugs"},
    "melhorar": {1.0: "melhora melhore melhorar otimiza otimize otimizar refatora refatore refatorar simplifica simplifique", 0.6: "limpa limpe enxuga acelera improve", 0.4: "lento legivel legível desempenho"},
    "criar": {1.0: "cria crie criar gera gere gerar escreve escreva escrever monta monte implementa implemente", 0.6: "faz faça preciso quero", 0.4: "novo nova exemplo modelo"},
    "explicar": {1.0: "explica explique explicar ensina ensine significa descreve descreva", 0.6: "entender entendi compreender", 0.4: "dúvida duvida conceito"},
}
INTENTS = {k: [(START + "(?:" + "|".join(w.split()) + ")" + STOP, weight) for weight, w in v.items()] for k, v in WORDS.items()}
ACTIONS = ("corrigir", "melhorar")
LANGUAGES = ("python", "javascript", "typescript", "java", "go", "rust", "ruby", "php", "sql", "bash", "html", "css")
FENCE = r"(?s)```\w*\n(.*?)```"


def intent_scores(c: Column, table: dict[str, list[tuple[str, float]]] = INTENTS) -> Column:
    """Array of (score, order, intent); each pattern counts once."""
    low = F.lower(c)
    each = [
        F.struct(F.round(sum((F.when(low.rlike(p), w).otherwise(0.0) for p, w in marks), F.lit(0.0)), 6).alias("score"), F.lit(-k).alias("ordem"), F.lit(name).alias("intencao"))
        for k, (name, marks) in enumerate(table.items())
    ]
    return F.array(*each)


def intents(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, intencao, confianca: the best intent, its score of FULL_SCORE being sure.

    An action wins over an analysis it nearly equals. A message of no intent is talk, or asks for an analysis if it brings code.
    """
    from lavra.operators.codescan import looks_like_code

    c = F.col(text_col)
    code = fenced_code(c).isNotNull() | looks_like_code(c)
    read = messages.filter(c.isNotNull()).select(F.col(id_col).alias("id"), intent_scores(c).alias("s"), code.alias("code"))
    read = read.withColumn("x", F.array_max("s")).withColumn("of", F.map_from_entries(F.transform("s", lambda x: F.struct(x.intencao, x.score))))
    kind = F.when((F.col("x.score") <= 0) & F.col("code"), "analisar").when(F.col("x.score") <= 0, TALK)
    for action in ACTIONS:
        of = F.col("of")[action]
        kind = kind.when((of > 0) & (F.col("of")["analisar"] > 0) & (of >= F.round(F.col("of")["analisar"] * ACTION_SHARE, 6)), action)
    sure = F.when((F.col("x.score") <= 0) & F.col("code"), CODE_CONFIDENCE).when(F.col("x.score") <= 0, TALK_CONFIDENCE).otherwise(F.round(F.least(F.lit(1.0), F.col("x.score") / FULL_SCORE), 2))
    return read.select("id", kind.otherwise(F.col("x.intencao")).alias("intencao"), sure.alias("confianca"))


def fenced_code(c: Column) -> Column:
    """The first fenced block, null without one."""
    return F.nullif(F.regexp_extract(c, FENCE, 1), F.lit(""))


def fenced_blocks(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (from 0), codigo of every fenced block."""
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(FENCE), F.lit(1))
    return messages.select(F.col(id_col).alias("id"), F.posexplode(blocks).alias("n", "codigo"))


def without_fenced_code(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, FENCE, ""))


def language_mention(c: Column) -> Column:
    """The first language of the list that the text names as a word."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for lang in reversed(LANGUAGES):
        out = F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){lang}($|[^\p{{L}}\p{{N}}_])"), F.lit(lang)).otherwise(out)
    return out


def file_mention(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([\w\-]+\.(?:py|js|ts|java|go|rs|rb|php|sql|sh|html|css|json|ya?ml|xml|md))", 1), F.lit(""))


# How a message states a preference: a phrase, a few words at most, and what is preferred. Patterns of our own.
_FEW = r"(?:[\p{L}-]+\s+){0,3}?"
NAME = r"(?i)" + START + r"(?:me\s+chamo|chamo-me|meu\s+nome\s+(?:é|eh)|me\s+chame\s+de|aqui\s+(?:é|fala)\s+[oa])\s+(\p{L}+)"
FAVOURITE = START + r"(?:prefiro|gosto|adoro|uso|programo|trabalho|desenvolvo)\s+" + _FEW + "(" + "|".join(LANGUAGES) + ")" + STOP
STYLE = START + r"(?:seja|sê|fale|fala|explique|explica|responda|responde|mais|bem)\s+" + _FEW + r"(simpl|detalh|t[eé]cnic)"
NO_EMOJI = START + r"(?:sem|não|nao|nunca|dispenso|evite|evita)\s+" + _FEW + "emoji"
EMOJI = START + r"(?:use|usa|usar|com|quero|coloque|coloca|adoro)\s+" + _FEW + "emoji"


def stated_preferences(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nome, linguagem, estilo, emojis that a message states, each null if it does not."""
    c, low = F.col(text_col), F.lower(F.col(text_col))
    style = F.regexp_extract(low, STYLE, 2)
    return messages.select(
        F.col(id_col).alias("id"), F.nullif(F.regexp_extract(c, NAME, 2), F.lit("")).alias("nome"), F.nullif(F.regexp_extract(low, FAVOURITE, 2), F.lit("")).alias("linguagem"),
        F.when(style == "simpl", "simples").when(style == "detalh", "detalhado").when(style.startswith("t"), "tecnico").alias("estilo"),
        F.when(low.rlike(NO_EMOJI), False).when(low.rlike(EMOJI), True).alias("emojis"),
    )


def prompts(messages: DataFrame, question: Column, n: int = 6, cut: int = 300) -> DataFrame:
    """The last n messages of each session, each cut, and a question, as one text."""
    from lavra.operators.memory import recent_messages

    line = F.concat(F.coalesce("papel", F.lit("")), F.lit(": "), F.substring(F.coalesce("conteudo", F.lit("")), 1, cut))
    last = recent_messages(messages, n).groupBy("sessao_id").agg(F.array_sort(F.collect_list(F.struct("posicao", line.alias("linha")))).alias("x"))
    return last.select("sessao_id", F.concat(F.array_join(F.transform("x", lambda x: x.linha), "\n"), F.lit("\nusuario: "), question, F.lit("\nia:")).alias("prompt"))


# Words that speak for a class of message, by precedence: a table of our own.
CLASSES = [
    ("saudacao", r"^\s*(oi|ola|olá|bom dia|boa tarde|boa noite|hello|hi)" + STOP),
    ("despedida", START + r"(tchau|adeus|até logo|até mais|bye)" + STOP),
    ("confirmacao", r"^\s*(sim|pode|ok|certo|claro)" + STOP),
    ("capacidade", START + r"o que (você|voce) (faz|sabe)" + STOP),
    ("frustracao", START + r"(não funciona|nao funciona|deu erro|não deu certo)" + STOP),
    ("agradecimento", START + r"(obrigad[ao]|valeu|thanks)" + STOP),
    ("pergunta", START + r"(como|o que|qual|quando|onde|por que|porque)" + STOP),
]


def message_class(c: Column) -> Column:
    """The first class whose words a message has, else "outra"; null for null."""
    low = F.lower(c)
    out = F.when(c.isNull(), None)
    for name, pattern in CLASSES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("outra")
