import json

from pyspark.sql import functions as F

from lavra.operators import corpus, markup
from lavra.sources import readers, writers
from lavra.streaming.ingest import ingest_stream, read_batches


def texts(df):
    return sorted(r.texto for r in df.collect())


def test_text_json_csv_and_markdown(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  um \n\n dois \n")
    assert texts(readers.read_file(spark, str(tmp_path / "a.txt"))) == ["dois", "um"]
    shapes = [
        (["x", " y "], ["x", "y"]),
        ([{"texto": "a", "outro": 1}, {"pergunta": "p", "resposta": "r"}, {"input": "i", "output": "o"}, {"nada": 1}], ["a", "i\no", "p\nr"]),
        ({"exemplos": ["m", {"message": "n"}]}, ["m", "n"]),
        ([1, None, {"text": None}], []),
    ]
    for k, (value, expected) in enumerate(shapes):
        (tmp_path / f"{k}.json").write_text(json.dumps(value))
        assert texts(readers.read_json(spark, str(tmp_path / f"{k}.json"))) == expected
    (tmp_path / "bad.json").write_text("{not json")
    assert texts(readers.read_json(spark, str(tmp_path / "bad.json"))) == []
    (tmp_path / "c.csv").write_text('id,Texto\n1,"a, ""b"""\n2\n3, c \n')
    assert texts(readers.read_csv(spark, str(tmp_path / "c.csv"))) == ['a, "b"', "c"]
    (tmp_path / "d.csv").write_text("x,y\nfirst,second\n")
    assert texts(readers.read_csv(spark, str(tmp_path / "d.csv"))) == ["first"]
    (tmp_path / "e.md").write_text("# Title of it\nmore\n\n \t\nshort\n\nanother long block\nof two lines\n")
    assert texts(readers.read_file(spark, str(tmp_path / "e.md"))) == ["# Title of it more", "another long block of two lines"]


def test_directory(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.txt").write_text("um\n")
    (tmp_path / "s" / "b.json").write_text('["dois"]')
    (tmp_path / "s" / "c.bin").write_text("no")
    assert texts(readers.read_directory(spark, str(tmp_path))) == ["dois", "um"]


def test_wiki_dump(spark, tmp_path):
    good = "Um parágrafo comprido o bastante para ficar, com palavras e mais palavras até passar de oitenta letras no total."
    page = "<page><title>{}</title><ns>{}</ns><revision><text xml:space='preserve'>{}</text></revision></page>"
    dump = "".join([page.format("A", 0, "{{caixa|{{x}}}}\n== T ==\n[[Categoria:Z]]\n" + good.replace("palavras", "[[alvo|palavras]]", 1)), page.format("B", 1, good), page.format("C", 0, "#REDIRECT [[A]]")])
    (tmp_path / "d.xml").write_text(f"<mediawiki>{dump}</mediawiki>")
    assert [(r.titulo, r.paragrafo) for r in readers.read_wiki_dump(spark, str(tmp_path / "d.xml")).collect()] == [("A", good)]


def test_nested_blocks(spark):
    df = spark.createDataFrame([("a {{b {{c}} d}} e {| t |} f",)], "t string")
    assert df.select(markup.clean_markup(F.col("t")).alias("t")).first().t == "a e f"


def test_append_counts_and_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([("a", "s"), ("b", "s"), ("a", "t")], "texto string, fonte string")
    assert writers.append_new(spark, new, str(tmp_path / "c")) == (2, 1)
    assert writers.append_new(spark, new, str(tmp_path / "c")) == (0, 3)
    stored = writers.read_corpus(spark, str(tmp_path / "c"))
    assert texts(stored) == ["a", "b"] and stored.select("id").distinct().count() == 2
    writers.export_text(stored, str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"texto numero {i % 7}", "s", "geral") for i in range(30)] + [("  abc ", "s", "geral"), ("uma linha  ", "s", "geral")]
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], "texto string, fonte string, categoria string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("texto string, fonte string, categoria string").option("maxFilesPerTrigger", 1).json(str(source))
    for _ in range(2):
        ingest_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = texts(read_batches(spark, str(tmp_path / "out")))
    batch = corpus.stripped(spark.createDataFrame(rows, "texto string, fonte string, categoria string"), 5, 50_000)
    assert got == sorted({r.texto for r in batch.collect()})


def test_command_line(spark, tmp_path, capsys):
    from lavra.__main__ import main

    (tmp_path / "a.txt").write_text("um\ndois\num\n")
    at = ["--corpus", str(tmp_path / "corpus")]
    main([*at, "add", str(tmp_path / "a.txt"), "texto solto"], spark)
    assert "added 3, already there 1" in capsys.readouterr().out
    main([*at, "mark", "--categoria", "geral"], spark)
    main([*at, "remove", "--fonte", "LINHA_DE"], spark)
    main([*at, "status"], spark)
    main([*at, "search", "DO"], spark)
    assert "dois" in capsys.readouterr().out
    assert [(r.texto, r.usado_treino) for r in writers.read_corpus(spark, at[1]).orderBy("texto").collect()] == [("dois", 1), ("um", 1)]
    main([*at, "export", str(tmp_path / "out")], spark)
    assert texts(spark.read.json(str(tmp_path / "out"))) == ["dois", "um"]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from lavra.streaming.ingest import counts_stream

    spark.createDataFrame([("2025-01-01 00:01:00", "a"), ("2025-01-01 00:02:00", "a"), ("2025-01-01 00:09:00", "b")], "t string, categoria string").selectExpr(
        "cast(t as timestamp) as adicionado", "categoria"
    ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("adicionado timestamp, categoria string").parquet(str(tmp_path / "in"))
    query = counts_stream(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.categoria, r.n) for r in spark.sql("select * from counted").collect()) == [("a", 2), ("b", 1)]
