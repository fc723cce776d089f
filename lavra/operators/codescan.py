"""Source-code analytics: language, lines, structure, lint, complexity and score, in built-in expressions without a shuffle.

Patterns are RE2-safe where the result allows, so they mean the same in other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.session import spread

# File extensions of each language.
EXTENSIONS = {
    "python": "py pyw", "javascript": "js mjs cjs", "typescript": "ts tsx", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp", "csharp": "cs", "go": "go",
    "rust": "rs", "ruby": "rb", "php": "php", "swift": "swift", "kotlin": "kt kts", "dart": "dart", "lua": "lua", "bash": "sh bash zsh", "sql": "sql",
    "html": "html htm", "css": "css scss sass", "json": "json", "yaml": "yaml yml", "xml": "xml", "r": "r", "scala": "scala", "elixir": "ex exs",
    "haskell": "hs", "perl": "pl", "vimscript": "vim", "powershell": "ps1", "terraform": "tf", "markdown": "md",
}
# Words and signs that a language's grammar and common library have and most others lack; the order settles ties.
WORDS = {
    "python": "def elif except nonlocal lambda pass raise yield self None True False __init__ __name__",
    "javascript": "const let typeof undefined instanceof document window module exports console addEventListener Promise",
    "typescript": "interface readonly declare keyof unknown never implements boolean number Partial Record",
    "java": "extends throws final String System Override ArrayList HashMap instanceof synchronized",
    "c": "typedef sizeof printf scanf malloc free unsigned NULL stdio stdlib",
    "cpp": "std cout cin nullptr template typename virtual constexpr iostream unique_ptr",
    "csharp": "Console foreach sealed internal Task LINQ IEnumerable decimal",
    "go": "func chan defer fmt nil range goroutine Errorf",
    "rust": "fn mut impl trait crate println unwrap Vec Option Some usize",
    "ruby": "puts attr_accessor attr_reader elsif unless rescue require_relative each_with_index",
    "php": "php echo isset endif endforeach foreach array_map mysqli",
    "swift": "guard UIKit SwiftUI Foundation IBOutlet fileprivate inout",
    "kotlin": "fun val companion listOf mutableListOf lateinit println",
    "bash": "fi then done esac echo export local grep awk",
    "sql": "SELECT FROM WHERE INSERT VALUES JOIN TABLE GROUP HAVING select from where insert values join table",
    "html": "DOCTYPE html head body div span href",
    "css": "color margin padding font-size background border display hover important",
}
SIGNS = {
    "python": [r"(?m)^\s*(?:class|for|if|while|with)\b[^{};]*:\s*$", r"(?m)^\s*(?:import|from)\s+[\w.]+(?:\s+import\s|\s*$)"],
    "javascript": [r"=>", r"===|!=="],
    "typescript": [r":\s*(?:string|number|boolean|void|any)\b"],
    "java": [r"\bpublic\s+(?:static\s+)?(?:class|void|int|String)\b", r"\bimport\s+java"],
    "c": [r"(?m)^\s*#\s*(?:include|define|ifdef|ifndef)\b"],
    "cpp": [r"\w::\w"],
    "csharp": [r"(?m)^\s*using\s+[A-Z][\w.]*;"],
    "go": [r":=", r"(?m)^package\s+\w+\s*$"],
    "rust": [r"->\s*\w+", r"&(?:mut|str)\b"],
    "ruby": [r"(?m)^\s*end\s*$", r"\bdo\s*\|\w+"],
    "php": [r"<\?php", r"\$\w+\s*(?:=|->|;|as\b)"],
    "swift": [r"\b(?:let|var)\s+\w+\s*:\s*[A-Z]\w*"],
    "kotlin": [r"\bval\s+\w+\s*[:=]"],
    "bash": [r"(?m)^#!.*\b(?:ba|z|k)?sh\b", r"\$\{?[A-Za-z_]\w*"],
    "sql": [],
    "html": [r"</?[a-zA-Z]\w*(?:\s[^<>]*)?>"],
    "css": [r"(?m)^\s*[.#]?[\w-]+(?::\w+)?\s*\{", r"(?m)^\s*[a-z-]+\s*:\s*[^;{}]+;\s*$"],
}
# One pattern for each language, so that a text is read once for each.
MARKS = {k: "|".join([*SIGNS[k], r"\b(?:" + "|".join(v.split()) + r")\b"]) for k, v in WORDS.items()}
# Decisions that add to the complexity.
DECISIONS = [r"\bif\b", r"\belse\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bswitch\b", r"\bcatch\b", r"\bexcept\b", r"\band\b", r"\bor\b", r"\?\?", r"\?\s", r"&&", r"\|\|"]
# What each rule must detect on a line, what must not be on it, and its severity (a fixed value).
_SECRET_NAME = r"(?i)(?:senha|passw(?:or)?d|segredo|secret|token|api_?key)\w*"
_TEXT = r"(?:\"[^\"]+\"|'[^']+')"
PYTHON_RULES = [
    ("bare_except", r"^\s*except\s*:", None, 3),
    ("none_comparison", r"(?:^|[^=!<>])==\s*None\b|\bNone\s*==", None, 2),
    ("bool_comparison", r"(?:^|[^=!<>])==\s*(?:True|False)\b", None, 1),
    ("print", r"^\s*print\s*\(", r"(?i)debug", 1),
    ("eval", r"(?:^|[^\w.])(?:eval|exec)\s*\(", r"^\s*#", 5),
    ("credential", _SECRET_NAME + r"\s*=\s*" + _TEXT, None, 5),
    ("long_line", r"^.{120}.*\S\s*$", None, 1),
]
JS_RULES = [
    ("var", r"(?:^|[;{(])\s*var\s", None, 2),
    ("loose_equality", r"(?:^|[^=!<>])==(?:$|[^=])", None, 3),
    ("console", r"\bconsole\s*\.\s*(?:log|debug|warn)\s*\(", None, 1),
    ("eval", r"(?:^|[^\w.])eval\s*\(", None, 5),
    ("credential", _SECRET_NAME + r"[\"']?\s*[=:]\s*" + _TEXT, None, 5),
]
GENERIC_RULES = [
    ("magic_number", r"(?:^|[^\w.])[2-9]\d\d+(?:$|[^\w.])", r"^\s*(?:#|//|--|\*|/\*)", 2),
    ("note", r"(?i)(?:^|[^\p{L}\p{N}_])(?:BUG|FIXME|HACK|TODO|XXX)(?:$|[^\p{L}\p{N}_])", None, 1),
    ("long_line", r"^.{150}.*\S\s*$", None, 1),
    ("credential", _SECRET_NAME + r"[\"']?\s*[=:]\s*(?:\"[^\"]{4,}\"|'[^']{4,}')", None, 5),
]
# Signatures of functions, the name being the first group.
FUNCTIONS = {
    "python": r"^\s*def\s+(\w+)\s*\(",
    "javascript": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    "typescript": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
    "java": r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(",
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
    "rust": r"^\s*(?:pub\s+)?fn\s+(\w+)\s*[<(]",
    "ruby": r"^\s*def\s+(\w+)",
    "php": r"^\s*(?:public\s+|private\s+|protected\s+)?function\s+(\w+)\s*\(",
    "bash": r"^\s*(?:function\s+)?(\w+)\s*\(\)",
    "c": r"^[\w*][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$",
    "csharp": r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|override\s+)*[\w<>\[\],]+\s+(\w+)\s*\(",
    "kotlin": r"^\s*(?:private\s+|override\s+|suspend\s+)*fun\s+(\w+)\s*\(",
}
# For languages without a signature of their own.
ANY_FUNCTION = r"^\s*(?:\w+\s+)*?(?:function|func|fun|fn|def|sub|proc)\s+(\w+)"
# What each language is called, its family, and whether its types are checked before it runs.
INFO = {
    "python": ("Python", "script", False), "javascript": ("JavaScript", "script", False), "typescript": ("TypeScript", "script", True), "java": ("Java", "object", True), "c": ("C", "system", True),
    "cpp": ("C++", "system", True), "csharp": ("C#", "object", True), "go": ("Go", "system", True), "rust": ("Rust", "system", True), "ruby": ("Ruby", "script", False), "php": ("PHP", "script", False),
    "swift": ("Swift", "object", True), "kotlin": ("Kotlin", "object", True), "bash": ("Bash", "shell", False), "sql": ("SQL", "query", True), "html": ("HTML", "markup", False), "css": ("CSS", "style", False),
}
COMMENT = {"python": "#", "ruby": "#", "bash": "#", "yaml": "#", "dotenv": "#", "sql": "--"}


def language_of_name(name: Column) -> Column:
    """Language by file extension, null if it says nothing."""
    ext = F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)))
    out = F.lit(None).cast("string")
    for lang, exts in EXTENSIONS.items():
        out = F.when(ext.isin(*exts.split()), F.lit(lang)).otherwise(out)
    return out


def language_scores(code: Column) -> Column:
    """Array of (score, order, language) of every language."""
    return F.array(*[F.struct(F.regexp_count(code, F.lit(mark)).alias("score"), F.lit(-k).alias("order"), F.lit(lang).alias("language")) for k, (lang, mark) in enumerate(MARKS.items())])


def detect_language(name: Column, code: Column) -> Column:
    """By extension, else by the most marks, else "desconhecida". Marks are counted only where the name says nothing."""
    by_name = language_of_name(name)
    best = F.array_max(language_scores(code))
    return F.coalesce(by_name, F.when(code.isNotNull(), F.when(best.getField("score") > 0, best.getField("language")).otherwise(F.lit("desconhecida"))))


def code_lines(files: DataFrame, id_col: str = "id", text_col: str = "conteudo", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, linha (from 1), texto of each line, without its line end."""
    lines = F.split(F.regexp_replace(text_col, "\r", ""), "\n", -1)
    return files.select(F.col(id_col).alias("id"), *keep, F.posexplode(lines).alias("__k", "texto")).select("id", *keep, (F.col("__k") + 1).alias("linha"), "texto")


def line_classes(files: DataFrame, comment: str = "#") -> DataFrame:
    """Total, code, comment and blank lines of each file."""
    line = F.trim(F.regexp_replace("texto", r"\t", " "))
    kind = F.when(line == "", "b").when(line.startswith(comment), "c").otherwise("k")
    return code_lines(files).withColumn("k", kind).groupBy("id").agg(
        F.count("*").alias("total"), F.count_if(F.col("k") == "k").alias("codigo"), F.count_if(F.col("k") == "c").alias("comentario"), F.count_if(F.col("k") == "b").alias("branco")
    )


def block_line_classes(files: DataFrame, comment: str, opening: str, closing: str) -> DataFrame:
    """As line_classes, with block comments: the state is folded over the lines of a file."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = F.transform(F.split(F.regexp_replace("conteudo", "\r", ""), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\t", " ")))
    fold = (
        "aggregate(l, named_struct('open', false, 'k', 0L, 'c', 0L, 'b', 0L), (s, x) -> case "
        f"when s.open then named_struct('open', not contains(x, {q(closing)}), 'k', s.k, 'c', s.c + 1, 'b', s.b) "
        "when x = '' then named_struct('open', false, 'k', s.k, 'c', s.c, 'b', s.b + 1) "
        f"when startswith(x, {q(opening)}) then named_struct('open', not contains(substring(x, {len(opening) + 1}), {q(closing)}), 'k', s.k, 'c', s.c + 1, 'b', s.b) "
        f"when startswith(x, {q(comment)}) then named_struct('open', false, 'k', s.k, 'c', s.c + 1, 'b', s.b) "
        "else named_struct('open', false, 'k', s.k + 1, 'c', s.c, 'b', s.b) end)"
    )
    return files.filter("conteudo is not null").select("id", lines.alias("l")).select("id", F.size("l").cast("long").alias("total"), F.expr(fold).alias("s")).select(
        "id", "total", F.col("s.k").alias("codigo"), F.col("s.c").alias("comentario"), F.col("s.b").alias("branco")
    )


def brace_depth(files: DataFrame) -> DataFrame:
    """Deepest nesting by braces, after each line."""
    lines = F.split("conteudo", "\n", -1)
    steps = F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", "")))
    fold = F.expr("aggregate(d, named_struct('now', 0, 'top', 0), (s, x) -> named_struct('now', s.now + x, 'top', greatest(s.top, s.now + x)))")
    return files.filter("conteudo is not null").select("id", steps.alias("d")).select("id", fold.getField("top").cast("long").alias("profundidade"))


def indent_depth(files: DataFrame) -> DataFrame:
    """Deepest indentation in steps of four."""
    deep = F.expr("(length(texto) - length(regexp_replace(texto, '^\\\\s+', ''))) div 4")
    return code_lines(files).filter(F.trim("texto") != "").groupBy("id").agg(F.max(deep).cast("long").alias("profundidade"))


def complexity(code: Column) -> Column:
    """1 and the number of decisions."""
    return sum((F.regexp_count(code, F.lit(p)) for p in DECISIONS), F.lit(1)).cast("long")


def functions(files: DataFrame, language: str = "python") -> DataFrame:
    """id, linha, nome, tamanho: the lines to the next function, or to the end."""
    lines = code_lines(files, keep=("__n",)) if "__n" in files.columns else code_lines(files.withColumn("__n", F.size(F.split("conteudo", "\n", -1))), keep=("__n",))
    found = lines.withColumn("nome", F.regexp_extract("texto", FUNCTIONS[language], 1)).filter("nome <> ''")
    nxt = F.lead("linha").over(Window.partitionBy("id").orderBy("linha"))
    return found.select("id", "linha", "nome", F.coalesce(nxt - F.col("linha") - 1, F.col("__n") - F.col("linha")).cast("long").alias("tamanho"))


# Forms of a JavaScript function, the first that fits a line counts; words before brackets that make no function.
_NAME = r"([A-Za-z_$][\w$]*)"
JS_FORMS = [
    r"\bfunction\s*\*?\s*" + _NAME + r"\s*\(",
    _NAME + r"\s*[:=]\s*(?:async\s+)?function\b",
    _NAME + r"\s*[:=]\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>",
    r"^\s*(?:(?:static|async|get|set)\s+)*" + _NAME + r"\s*\([^()]*\)\s*\{",
]
JS_CONTROL = ("if", "for", "while", "switch", "catch", "with", "return", "function")


def js_functions(files: DataFrame) -> DataFrame:
    """id, linha, nome of JavaScript functions."""
    name = F.coalesce(*[F.nullif(F.regexp_extract("texto", p, 1), F.lit("")) for p in JS_FORMS])
    return code_lines(files).select("id", "linha", name.alias("nome")).filter(F.col("nome").isNotNull() & ~F.col("nome").isin(*JS_CONTROL))


def file_measures(files: DataFrame, language: str = "python", rules: list[tuple[str, str, str | None, int]] = ()) -> DataFrame:
    """id, cx, maior, profundidade, s4, s3, s2: complexity, longest function, depth, and findings of line rules by severity.

    A file is read once, in its own row: no line leaves it, so nothing is shuffled or joined.
    """
    row = spread(files.filter("conteudo is not null").select("id", "conteudo")).select("id", "conteudo", F.split(F.regexp_replace("conteudo", "\r", ""), "\n", -1).alias("ls"))
    found = F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).alias("linha"), F.regexp_extract(x, FUNCTIONS.get(language, ANY_FUNCTION), 1).alias("nome"))), lambda x: x.nome != "")
    if language == "python":
        deep = F.array_max(F.transform(F.filter("ls", lambda x: F.trim(x) != ""), lambda x: F.floor((F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))) / 4)))
    else:
        step = F.transform("ls", lambda x: F.length(F.regexp_replace(x, "[^{]", "")) - F.length(F.regexp_replace(x, "[^}]", "")))
        deep = F.aggregate(step, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda a, x: F.struct((a.now + x).alias("now"), F.greatest(a.top, a.now + x).alias("top"))).top

    def broken(pattern: str, unless: str | None) -> Callable[[Column], Column]:
        return lambda x: x.rlike(pattern) & ~x.rlike(unless) if unless else x.rlike(pattern)

    counts = {name: F.lit(0) for name in ("s4", "s3", "s2")}
    for _, pattern, unless, severity in rules:
        name = "s4" if severity >= 4 else "s3" if severity == 3 else "s2"
        counts[name] = counts[name] + F.size(F.filter("ls", broken(pattern, unless)))
    read = row.select("id", complexity(F.col("conteudo")).alias("cx"), F.size("ls").alias("n"), found.alias("f"), deep.cast("long").alias("d"), *[c.alias(k) for k, c in counts.items()])
    size = F.transform("f", lambda x, i: F.coalesce(F.get("f", i + 1).linha - 1, F.col("n")) - x.linha)
    return read.select("id", "cx", F.coalesce(F.array_max(size), F.lit(0)).cast("long").alias("maior"), F.coalesce("d", F.lit(0).cast("long")).alias("profundidade"), "s4", "s3", "s2")


def suggestions(files: DataFrame, language: str = "python") -> DataFrame:
    """id, sugestao: what the measures of a file call for."""
    said = F.array_compact(F.array(F.when(F.col("cx") > 20, "complexidade"), F.when(F.col("maior") > 80, "funcoes_longas"), F.when(F.col("profundidade") > 6, "profundidade")))
    return file_measures(files, language).select("id", F.explode(said).alias("sugestao"))


def imports(files: DataFrame) -> DataFrame:
    """id, linha, modulo of Python imports."""
    plain, named = F.regexp_extract("texto", r"^\s*import\s+(.+)", 1), F.regexp_extract("texto", r"^\s*from\s+(\S+)\s+import\s+.+", 1)
    return code_lines(files).withColumn("modulo", F.trim(F.when(plain != "", plain).otherwise(named))).filter("modulo <> ''").select("id", "linha", "modulo")


def duplicate_imports(files: DataFrame) -> DataFrame:
    """Imports of a module a file has imported before, and where first."""
    first = F.min("linha").over(Window.partitionBy("id", "modulo"))
    return imports(files).withColumn("primeira", first).filter("linha > primeira")


def lint(files: DataFrame, rules: list[tuple[str, str, str | None, int]]) -> DataFrame:
    """id, linha, regra, severidade: one row for each rule a line breaks; all rules in one pass over the lines."""
    tests = []
    for name, pattern, unless, severity in rules:
        hit = F.col("texto").rlike(pattern)
        if unless:
            hit = hit & ~F.col("texto").rlike(unless)
        tests.append(F.when(hit, F.struct(F.lit(name).alias("regra"), F.lit(severity).alias("severidade"))))
    return code_lines(files).select("id", "linha", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("id", "linha", "x.*")


# Fixed value: head of a Python function that closes on its line, with its name and parameters.
PYTHON_HEAD = r"^\s*def\s+(\w+)\s*\(([^)]*)\)"


def python_functions(files: DataFrame) -> DataFrame:
    """id, linha, nome, tamanho, parametros, documentada; the last two are null for heads of several lines."""
    lines = F.split(F.regexp_replace("conteudo", "\r", ""), "\n", -1)
    pairs = F.transform("ls", lambda x, i: F.struct(x.alias("texto"), F.get("ls", i + 1).alias("proxima")))
    rows = files.select("id", lines.alias("ls")).select("id", F.size("ls").alias("__n"), F.posexplode(pairs).alias("__k", "x")).select("id", "__n", (F.col("__k") + 1).alias("linha"), "x.*")
    found = rows.withColumn("nome", F.regexp_extract("texto", FUNCTIONS["python"], 1)).filter("nome <> ''")
    nxt = F.lead("linha").over(Window.partitionBy("id").orderBy("linha"))
    closed = F.col("texto").rlike(PYTHON_HEAD)
    parameters = F.size(F.filter(F.split(F.regexp_extract("texto", PYTHON_HEAD, 2), ","), lambda p: F.trim(p) != "")).cast("long")
    documented = F.coalesce(F.col("proxima").rlike("^\\s*(\"\"\"|\'\'\')"), F.lit(False))
    return found.select(
        "id", "linha", "nome", F.coalesce(nxt - F.col("linha") - 1, F.col("__n") - F.col("linha")).cast("long").alias("tamanho"), F.when(closed, parameters).alias("parametros"), F.when(closed, documented).alias("documentada")
    )


def python_classes(files: DataFrame) -> DataFrame:
    """id, linha, nome, heranca of Python classes."""
    pattern = r"^\s*class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:"
    found = code_lines(files).withColumn("nome", F.regexp_extract("texto", pattern, 1)).filter("nome <> ''")
    return found.select("id", "linha", "nome", F.regexp_extract("texto", pattern, 2).alias("heranca"))


def lint_python(files: DataFrame) -> DataFrame:
    """All rules for Python: those of lines, of functions, and of repeated imports."""
    rules = [("many_parameters", F.col("parametros") > 6, 3), ("long_function", F.col("tamanho") > 50, 3), ("no_docstring", ~F.col("documentada") & ~F.col("nome").startswith("_"), 1)]
    tests = [F.when(hit, F.struct(F.lit(name).alias("regra"), F.lit(severity).alias("severidade"))) for name, hit, severity in rules]
    of_functions = python_functions(files).select("id", "linha", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("id", "linha", "x.*")
    repeated = duplicate_imports(files).select("id", "linha", F.lit("repeated_import").alias("regra"), F.lit(2).alias("severidade"))
    return lint(files, PYTHON_RULES).unionByName(of_functions).unionByName(repeated)


def python_suggestions(files: DataFrame) -> DataFrame:
    """As suggestions, and where under half of more than three functions have a docstring."""
    share = python_functions(files).filter("documentada is not null").groupBy("id").agg(F.count("*").alias("n"), F.count_if("documentada").alias("com"))
    return suggestions(files).unionByName(share.filter("n > 3 and com * 2 < n").select("id", F.lit("documentacao").alias("sugestao")))


def lint_summary(problems: DataFrame) -> DataFrame:
    return problems.groupBy("regra", "severidade").agg(F.count("*").alias("n"), F.count_distinct("id").alias("arquivos"))


SCORE = "10 - 2.0D * s4 - 0.5D * s3 - 0.1D * s2 - 0.05D * greatest(0, cx - 10) - 0.3D * greatest(0, profundidade - 5) - if(maior > 100, 1, 0)"


def line_score(files: DataFrame, rules: list[tuple[str, str, str | None, int]], language: str = "python") -> DataFrame:
    """id, score in 0..10 by line rules alone: one pass over each file."""
    return file_measures(files, language, rules).select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.expr(SCORE))), 6).alias("score"))


def quality_score(files: DataFrame, problems: DataFrame, language: str = "python") -> DataFrame:
    """id, score in 0..10: ten less what problems, complexity, depth and long functions cost."""
    worst = problems.groupBy("id").agg(
        F.count_if(F.col("severidade") >= 4).alias("s4"), F.count_if(F.col("severidade") == 3).alias("s3"), F.count_if(F.col("severidade") <= 2).alias("s2")
    )
    joined = file_measures(files, language).drop("s4", "s3", "s2").join(worst, "id", "left").fillna(0, ["s4", "s3", "s2"])
    return joined.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.expr(SCORE))), 6).alias("score"))


def documentation_share(files: DataFrame) -> DataFrame:
    """id, funcoes, documentadas, cobertura (per cent) of the Python functions of each file whose heads close on their line."""
    share = python_functions(files).filter("documentada is not null").groupBy("id").agg(F.count("*").alias("funcoes"), F.count_if("documentada").alias("documentadas"))
    return share.withColumn("cobertura", F.round(100.0 * F.col("documentadas") / F.col("funcoes"), 2))


def report(files: DataFrame) -> DataFrame:
    """id, relatorio: measures, score with a bar of ten, and the worst findings of each file, as text."""
    m = file_measures(files, rules=PYTHON_RULES).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.expr(SCORE))), 2))
    bar = F.concat(F.repeat(F.lit("█"), F.round("score").cast("int")), F.repeat(F.lit("░"), 10 - F.round("score").cast("int")))
    head = F.format_string("score %.2f %s\ncomplexidade %d, profundidade %d, maior função %d linhas\ngraves %d, médios %d, leves %d", "score", bar, "cx", "profundidade", "maior", "s4", "s3", "s2")
    return m.select("id", head.alias("relatorio"))


# How a line of code begins or ends.
CODE_LINE = (
    r"^\s*(?:class|const|def|for|from|function|if|import|let|private|public|return|var|while|#include)\b|[{};]\s*$|^\s*(?:#|//)|\w\(.*\)\s*[:{]?\s*$|^\s*[\w.]+\s*[+*/-]?=\s*\S"
)


def looks_like_code(c: Column) -> Column:
    """Two lines or more, of whose first five at least two look like code."""
    lines = F.split(c, "\n", -1)
    return (F.size(lines) >= 2) & (F.size(F.filter(F.slice(lines, 1, 5), lambda x: x.rlike(CODE_LINE))) >= 2)
