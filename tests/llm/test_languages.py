import os

import pyarrow as pa
import pytest

from lavra.llm import languages

FOLDER = "/root/testdata/sf0.01"
SAID = {
    "pt": ["Quando a chuva parou, as crianças correram para o quintal e não voltaram até a noite.", "O relatório foi enviado à direção na semana passada, mas ninguém respondeu ainda."],
    "en": ["When the rain stopped, the children ran into the yard and did not come back until night.", "The report was sent to the board last week, but nobody has answered yet."],
    "es": ["Cuando paró la lluvia, los niños corrieron al patio y no volvieron hasta la noche.", "El informe fue enviado a la dirección la semana pasada, pero nadie ha respondido todavía."],
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_sentences_and_other_scripts(spark):
    model = languages.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), "text", "lang")
    texts = [(k, t) for k, v in SAID.items() for t in v]
    got = languages.languages(pa.array([t for _, t in texts]), model).tolist()
    assert got == [k for k, _ in texts]
    odd = [None, "", "123 456", "Когда дождь прекратился, дети выбежали во двор и не возвращались до самой ночи", "xqzw kjvxq wqzzk jxkqv zzxqw kqjvw xzqkj wvqxz kkqzx jqwvx zqxkw"]
    assert set(languages.languages(pa.array(odd), model).tolist()) == {"und"}


def test_without_labels(spark):
    df = spark.createDataFrame([(None, "um texto"), ("xx", "a text"), ("pt", None)], "lang string, text string")
    assert languages.languages(pa.array(["um texto qualquer"]), languages.fit(df, "text", "lang")).tolist() == ["und"]
