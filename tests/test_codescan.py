from lavra.operators import codescan

CODE = (
    "import os\nimport os\nclass A(Base):\n    def f(self, a, b, c, d, e, g):\n        '''Doc.'''\n        pass\n    def _g(x):\n        pass\n"
    "def long_one():\n" + "    x = 1\n" * 51 + "def h(\n    a,\n):\n    '''Doc.'''\ndef k(a, b=2):\n    return a\ndef m(): pass"
)


def test_rules_of_functions_and_imports(spark):
    files = spark.createDataFrame([(1, CODE), (2, None), (3, "def t():\r\n    \"\"\"Doc.\"\"\"\r\n")], "id long, conteudo string")
    got = sorted((r.id, r.linha, r.regra, r.severidade) for r in codescan.lint_python(files).collect())
    assert got == [(1, 2, "repeated_import", 2), (1, 4, "many_parameters", 3), (1, 9, "long_function", 3), (1, 9, "no_docstring", 1), (1, 65, "no_docstring", 1), (1, 67, "no_docstring", 1)]
    assert [(r.linha, r.nome, r.heranca) for r in codescan.python_classes(files).collect()] == [(3, "A", "Base")]
    assert {(r.id, r.sugestao) for r in codescan.python_suggestions(files).collect()} == {(1, "documentacao")}
    score = {r.id: r.score for r in codescan.quality_score(files, codescan.lint_python(files)).collect()}
    assert score == {1: 8.6, 3: 10.0}
