import random

from pyspark.sql import functions as F

from lavra.operators import batches, bpe, corpus, memory, numerics, rewrite


def test_shuffles_are_permutations_that_change_by_epoch(spark):
    df = spark.range(300).withColumnRenamed("id", "id")
    one, two = ({r.id: r.posicao for r in batches.global_shuffle(df, 5, e).collect()} for e in (1, 2))
    assert sorted(one.values()) == sorted(two.values()) == list(range(1, 301)) and one != two
    paged = batches.page_shuffle(corpus.pages(df, 60), 5, 1).collect()
    assert sorted((r.pagina, r.posicao) for r in paged) == [(p, k) for p in range(5) for k in range(1, 61)]
    assert {r.pagina for r in paged if r.id < 60} == {0}


def test_batches_stay_in_their_page(spark):
    rows = batches.batch_numbers(corpus.pages(spark.range(130), 60).select("id", "pagina"), 16).collect()
    size = {}
    for r in rows:
        size.setdefault(r.lote, set()).add(r.pagina)
    assert sorted(size) == list(range(1, 10)) and all(len(p) == 1 for p in size.values())


def test_batch_numbers_from_ranks_equal_counted_ones(spark):
    pages = corpus.pages(spark.range(250), 60)
    counted = {(r.id, r.lote) for r in batches.batch_numbers(pages.select("id", "pagina"), 16).collect()}
    assert counted == {(r.id, r.lote) for r in batches.batch_numbers(pages, 16, 60).collect()}


def test_chunks_and_ranking_by_both_ways(spark, monkeypatch):
    from lavra.operators import retrieval

    texts = [None, "", " ", "a" * 300, "b" * 301, "casa azul 😀 " * 60, "casa verde\n" * 20, "ponte", "ponte azul"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = retrieval.chunks(docs, "doc_id", "text")
    got = sorted(map(tuple, table.collect()))
    expected = []
    for i, t in enumerate(texts):
        n = 0 if not t else 1 if len(t) <= 300 else -(-(len(t) - 300) // 150) + 1
        expected += [(i, k, x) for k in range(n) if (x := t[k * 150 : k * 150 + 300].strip())]
    assert got == expected
    asked = spark.createDataFrame([(1, "casa azul"), (2, "ponte"), (3, "nada disso"), (4, None), (5, "")], "item_id int, texto string")
    sent = sorted(map(tuple, retrieval.rank_chunks(table, asked, "item_id", "texto").collect()))
    monkeypatch.setattr(retrieval, "SENT_TOKENS", 0)
    assert sent == sorted(map(tuple, retrieval.rank_chunks(table, asked, "item_id", "texto").collect())) and {r[0] for r in sent} == {1, 2}
    changed = retrieval.with_documents(retrieval.without_documents(table, spark.createDataFrame([(7,)], "doc_id long")), spark.createDataFrame([(8, "lago"), (9, "novo")], "doc_id long, text string"), "doc_id", "text")
    assert {(r.doc_id, r.trecho) for r in changed.filter("doc_id > 6").collect()} == {(8, "lago"), (9, "novo")}
    before = retrieval.document_frequencies(retrieval.term_frequencies(table, ["doc_id", "chunk_no"], "trecho"))
    after = retrieval.changed_frequencies(before, changed.filter("doc_id > 7"), table.filter("doc_id > 6"))
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in retrieval.document_frequencies(retrieval.term_frequencies(changed, ["doc_id", "chunk_no"], "trecho")).collect()}


def test_training_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, "ab"), (3, "x" * 50)], "id int, texto string")
    for r in batches.training_rows(df, batches.char_ids(F.col("texto")), 8).collect():
        assert len(r.input_ids) == len(r.target_ids) == 8 and r.input_ids[1:] == r.target_ids[:-1] and r.input_ids[0] == batches.BOS
        assert r.attention_mask == [x != batches.PAD for x in r.input_ids] and batches.EOS in r.target_ids


def test_context_window_stops_at_the_first_overflow(spark):
    rows = [("s", i, i, n) for i, n in enumerate([1, 500, 3, None, 2])]
    df = spark.createDataFrame(rows, "sessao_id string, id int, timestamp int, tokens_aprox int")
    assert sorted(r.id for r in memory.context_window(df, 10).collect()) == [2, 3, 4]


def test_merges_and_pieces():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("c", "</w>"): 2}
    assert bpe.merge_word(list("abcab") + ["</w>"], ranks) == ["abc", "ab", "</w>"]
    assert bpe.longest_pieces("abcd!", {"a", "ab", "abc", "d"}, 3) == ["abc", "d", "<UNK>"] and bpe.longest_pieces("", set(), 0) == []


def test_rewrites(spark):
    def done(f, text):
        return f(spark.createDataFrame([(1, text), (2, None)], "id int, conteudo string")).orderBy("id").first().conteudo

    assert done(rewrite.var_to_const, "var a = 1;\nvar b = 2;\nb = 3;") == "const a = 1;\nlet b = 2;\nb = 3;"
    assert done(rewrite.add_docstrings, "def f(x):\n    return x\ndef g():\n    \"\"\"ok\"\"\"") == 'def f(x):\n    """TODO: documentar f."""\n    return x\ndef g():\n    """ok"""'
    assert done(rewrite.organise_imports, "import zlib\nfrom .a import b\nimport numpy\nimport ast\nx = 1") == "import ast\nimport zlib\n\nimport numpy\n\nfrom .a import b\n\nx = 1"
    assert all(len(x) <= 40 for x in done(lambda d: rewrite.wrap_comments(d, "#", 40), "  # " + "palavra " * 20).split("\n"))
    row = spark.createDataFrame([("x == None\nif a == True:\nexcept:\na != None",)], "c string").select(rewrite.fix_comparisons(F.col("c")).alias("c")).first()
    assert row.c == "x is None\nif a:\nexcept Exception:\na is not None"


def test_probabilities(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 3.0])], "id int, v array<double>")
    p = df.select("id", F.posexplode(numerics.softmax(F.col("v"))).alias("pos", "p"))
    assert abs(sum(r.p for r in p.collect()) - 1) < 1e-12
    assert sorted(r.pos for r in numerics.top_k(p, 1).collect()) == [2, 3] and sorted(r.pos for r in numerics.top_p(p, 0.5).collect()) == [2, 3]


def test_ranks_without_a_global_window(spark):
    ids = sorted(random.Random(2).sample(range(-50, 10_000), 500))
    got = [(r.id, r.rank) for r in corpus.ranked(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5), ["id"]).orderBy("id").collect()]
    assert got == [(i, k + 1) for k, i in enumerate(ids)]
