"""Operators without an SQL twin against rows worked out by hand, brute force, or the public library."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lavra.operators import bpe, codescan, corpus, intent, markup, memory, numerics, retrieval, rewrite

has_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary files")


def rewritten(spark, f, text, **more):
    files = spark.createDataFrame([(1, text, *more.values()), (2, None, *more.values())], "id int, conteudo string" + "".join(f", {k} string" for k in more))
    rows = {r.id: r.conteudo for r in f(files).collect()}
    assert rows[2] is None
    return rows[1]


def test_comparisons_keep_what_they_compare(spark):
    cases = {
        "if self.ok == False:": "if self.ok == False:".replace("self.ok == False", "not self.ok"), "while a.b(1) == True:": "while a.b(1):", "x = y == True": "x = y == True",
        "if None == self.x[0]:": "if self.x[0] is None:", "if None != f(2):": "if f(2) is not None:", "a == None and b != None": "a is None and b is not None", "except :": "except Exception:", "if x == Nonesuch:": "if x == Nonesuch:",
    }
    got = spark.createDataFrame([(k,) for k in cases], "c string").select("c", rewrite.fix_comparisons(F.col("c")).alias("d")).collect()
    assert {r.c: r.d for r in got} == cases


def test_credentials_are_read_from_the_environment(spark):
    f = rewrite.credentials_to_environment
    head = '#!/usr/bin/env python\n"""Doc."""\nfrom __future__ import annotations\n'
    assert rewritten(spark, f, head + 'import sys\nDb_senha = "x1y2"  # note\nself.token: str = \'abc\'\n', linguagem="python") == (
        head + 'import os\nimport sys\nDb_senha = os.environ.get("DB_SENHA", "")  # note\nself.token: str = os.environ.get("TOKEN", "")\n'
    )
    assert rewritten(spark, f, 'import os\nsecret = "a"', linguagem="python") == 'import os\nsecret = os.environ.get("SECRET", "")'
    assert rewritten(spark, f, 'const apiKey = "a1";\nx = { token: \'b\' };', linguagem="javascript") == "const apiKey = process.env.APIKEY;\nx = { token: process.env.TOKEN };"
    for lang in ("yaml", None):
        assert rewritten(spark, f, 'senha = "a1"', linguagem=lang) == 'senha = "a1"'


def test_loose_equality_outside_strings_and_comments(spark):
    text = 'if (a == b && c != d) { s = "x == y"; } // e == f\n/* g != h */ i === j; k !== l; m <= n; `o == p` == q'
    assert rewritten(spark, rewrite.fix_loose_equality, text) == 'if (a === b && c !== d) { s = "x == y"; } // e == f\n/* g != h */ i === j; k !== l; m <= n; `o == p` === q'


def test_improving_raises_scores(spark):
    files = spark.createDataFrame(
        [(1, "a.py", "try:\n    x = 1\nexcept:\n    if x == None:\n        pass\n"), (2, "b.js", "var a = 1\nif (a == 2) { console.log(a); }\n"), (3, "c.md", "texto\n\n\n\n\n\nfim"), (4, "d.py", None)],
        "id int, nome_arquivo string, conteudo string",
    )
    got = {r.id: r for r in rewrite.improve(files).collect()}
    assert set(got) == {1, 2, 3} and all(r.score_depois >= r.score_antes for r in got.values()) and all(r.mudou for r in got.values())
    assert got[1].linguagem == "python" and got[1].score_antes < got[1].score_depois and got[2].conteudo.startswith("let a = 1;") and got[3].conteudo == "texto\n\n\nfim\n"


def test_block_comments(spark):
    files = spark.createDataFrame([(1, 'a = 1\n"""\ndoc\n\n"""\n# c\n\n"""one line"""\nb = 2'), (2, "")], "id int, conteudo string")
    assert {tuple(r) for r in codescan.block_line_classes(files, "#", '"""', '"""').collect()} == {(1, 9, 2, 6, 1), (2, 1, 0, 0, 1)}


def test_languages_by_their_marks(spark):
    said = {
        "python": "import os\n\ndef f(self):\n    return None\n", "javascript": "const f = (a) => { console.log(a === 1); };\n", "go": "package main\n\nfunc main() {\n\tx := 1\n\tfmt.Println(x)\n}\n",
        "rust": "fn main() -> i32 {\n    let mut v: Vec<u8> = Vec::new();\n    println!(\"x\");\n}\n", "sql": "SELECT a FROM t JOIN u ON t.id = u.id WHERE a > 1;", "bash": "#!/bin/bash\nif [ -z \"$X\" ]; then\n  echo $X\nfi\n",
        "html": "<!DOCTYPE html><html><body><div class='a'>x</div></body></html>", "css": ".a {\n  color: red;\n  margin: 0;\n}\n", "java": "import java.util.List;\npublic class A extends B {\n  @Override public String f() { System.out.println(1); }\n}\n",
        "ruby": "require 'x'\nclass A\n  attr_accessor :b\n  def c\n    puts 1\n  end\nend\n", "php": "<?php\n$a = 1;\necho $a;\nforeach ($b as $c) {}\n", "kotlin": "fun main() {\n  val x = listOf(1)\n  println(x)\n}\n",
        "c": "#include <stdio.h>\nint main(void) {\n  printf(\"%d\", 1);\n}\n", "cpp": "#include <iostream>\nint main() {\n  std::cout << 1;\n}\n", "desconhecida": "um texto sem nada",
    }
    rows = spark.createDataFrame([(k, None, v) for k, v in said.items()], "k string, nome string, c string")
    got = {r.k: r.l for r in rows.select("k", codescan.detect_language(F.col("nome"), F.col("c")).alias("l")).collect()}
    assert got == {k: k for k in said}


def test_documentation_share_and_report(spark):
    files = spark.createDataFrame([(1, 'def a():\n    """D."""\n    pass\ndef b():\n    eval("1")\n')], "id int, conteudo string")
    assert [tuple(r) for r in codescan.documentation_share(files).collect()] == [(1, 2, 1, 50.0)]
    assert codescan.report(files).first().relatorio.startswith("score 8.00 ████████░░\n")
    assert rewrite.generic_names(spark.createDataFrame([(1, "x = 1\ntmp = 2\nx == 3\nself.y = 4\nx = 5"), (2, "nome = 1")], "id int, conteudo string")).collect() == [(1, ["x", "tmp"])]


def test_wiki_marks(spark):
    text = "'''Rio''' é [[cidade|uma cidade]]<ref name=a>nota</ref><ref name=b/> do [[Brasil]].[[Ficheiro:A.jpg|thumb|Um [[porto]] velho]]\n== Título ==\n* item [http://x.example um site] e https://y.example\n<!-- x -->fim&nbsp;aqui {{a|{{b}}}}"
    row = spark.createDataFrame([(text,)], "t string").select(markup.clean_markup(F.col("t")).alias("t")).first()
    assert row.t == "Rio é uma cidade do Brasil.\n\nitem um site e \nfim aqui "


def test_intents_and_preferences(spark):
    said = [(1, "analise e corrija este erro"), (2, "bom dia"), (3, "veja\n```python\nx = 1\n```"), (4, "explique o conceito"), (5, None)]
    got = {r.id: (r.intencao, r.confianca) for r in intent.intents(spark.createDataFrame(said, "id int, t string"), "id", "t").collect()}
    assert got == {1: ("corrigir", 0.47), 2: ("conversa", 0.9), 3: ("analisar", 0.7), 4: ("explicar", 0.47)}
    said = [(1, "Oi, me chamo Ana e prefiro muito python. Seja mais simples, sem emojis"), (2, "gosto de chuva, use emoji"), (3, None)]
    got = {r.id: tuple(r)[1:] for r in intent.stated_preferences(spark.createDataFrame(said, "id int, t string"), "id", "t").collect()}
    assert got == {1: ("Ana", "python", "simples", False), 2: (None, None, None, True), 3: (None, None, None, None)}
    blocks = intent.fenced_blocks(spark.createDataFrame([(1, "a\n```py\nx\n```\nb\n```\ny\n```")], "id int, t string"), "id", "t")
    assert [tuple(r) for r in blocks.orderBy("n").collect()] == [(1, 0, "x\n"), (1, 1, "y\n")]


def test_context_records(spark):
    messages = spark.createDataFrame([("s", i, "usuario", f"m{i}", i, n) for i, n in enumerate([900, 500, 300, 100])], "sessao_id string, id int, papel string, conteudo string, timestamp int, tokens_aprox int")
    files = spark.createDataFrame([("s", 1, "a" * 40, 1), ("s", 2, "b" * 1000, 2), ("z", 3, "c", 3)], "sessao_id string, id int, conteudo string, timestamp int")
    prefs = spark.createDataFrame([("tema", "escuro")], "chave string, valor string")
    row = memory.context_records(messages, files, prefs).first()
    assert [m.id for m in row.historico] == [1, 2, 3] and row.tokens == 900 and row.preferencias == {"tema": "escuro"}
    assert [(f.id, f.trecho) for f in row.arquivos] == [(2, "b" * 200 + "..."), (1, "a" * 40)]
    alone = {(r.id, len(r.trecho)) for r in memory.code_context(files).collect()}
    assert alone == {(1, 40), (2, 1000), (3, 1)}
    left = memory.purge_sessions(spark.createDataFrame([("s",)], "sessao_id string"), messages, files)
    assert [x.count() for x in left] == [0, 1]


def test_generated_texts_and_runs(spark):
    long = "um texto comprido o bastante para ficar"
    df = spark.createDataFrame([(1, f"TEXTO 1: {long}\n\ncurto\n\n{long}\n\n{long}!")], "id int, t string")
    assert [(r.n, r.texto) for r in corpus.generated_texts(df, "id", "t").orderBy("n").collect()] == [(0, long), (1, long + "!")]
    assert [r.id for r in corpus.last_runs(spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, data int")).collect()] == [8, 5, 2, 7, 4]


@has_vocabulary
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    lib.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["Olá, mundo! It's a test 123", "", None, "  \n\t ", "def f(x):\n    return x == 1", "日本 😀 é", *("".join(rng.choice("abcçã éD1 .,'_\n") for _ in range(40)) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    coded = bpe.encode_texts(df, "id", "t", bpe.DEFAULT_VOCABULARY)
    got = {r.id: r.ids for r in coded.collect()}
    assert got == {i: None if t is None else lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r.id: r.text for r in bpe.decode_ids(coded, bpe.DEFAULT_VOCABULARY).collect()}
    assert back[0] == "olá , mundo ! it 's a test 1 2 3" and back[2] is None


@has_vocabulary
def test_a_vocabulary_saved_and_read_again(tmp_path):
    one = bpe.Vocabulary.load(bpe.DEFAULT_VOCABULARY)
    one.save(str(tmp_path / "v.json"))
    two = bpe.Vocabulary.load(str(tmp_path / "v.json"))
    assert two.info() == one.info() and two.encode("uma frase qualquer") == one.encode("uma frase qualquer")


def test_beam_search_equals_all_paths(spark):
    rng = random.Random(1)
    p = {a: {b: rng.random() for b in range(4)} for a in range(4)}
    p = {a: {b: x / sum(v.values()) for b, x in v.items()} for a, v in p.items()}
    table = spark.createDataFrame([(a, b, x) for a, v in p.items() for b, x in v.items()], "last int, token int, p double")

    def step(beams):
        return beams.withColumn("last", F.element_at("tokens", -1)).join(table, "last").select("beam", "token", "p")

    got = {r.id: (list(r.tokens), r.score) for r in numerics.beam_search(spark.createDataFrame([(7, [0]), (8, [1])], "id int, tokens array<int>"), step, width=64, most=3, end=3).collect()}
    for i, first in ((7, 0), (8, 1)):
        best = None
        for n in (1, 2, 3):
            for seq in itertools.product(range(4), repeat=n):
                if 3 in seq[:-1] or (n < 3 and seq[-1] != 3):
                    continue
                loss = sum(math.log(p[a][b] + 1e-10) for a, b in zip((first, *seq), seq))
                best = max(best or (-1e9, None), (loss / ((5 + n) / 6) ** 0.6, list(seq)))
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0])


def test_a_draw_follows_the_chain(spark):
    df = spark.range(4000).select("id", F.array(*[F.lit(float(x)) for x in (2, 1, 0, -9)]).alias("v"))
    kept = df.select("id", numerics.sampling_chain(F.col("v"), F.array().cast("array<int>"), F.array(F.lit(2)), temperature=1.0, k=3, share=1.0).alias("c"))
    share = {r.pos: r.n / 4000 for r in kept.groupBy(numerics.draw(F.col("c"), F.col("id")).alias("pos")).agg(F.count("*").alias("n")).collect()}
    assert set(share) <= {0, 1, 3} and abs(share[0] - 0.731) < 0.03
    assert numerics.top_k and retrieval.TOKEN
