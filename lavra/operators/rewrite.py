"""Source-code rewriting: column expressions where they suffice, else functions of one text in Arrow batches."""

from __future__ import annotations

import re
import sys
import textwrap
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.arrow import map_arrow
from lavra.operators.codescan import code_lines
from lavra.session import spread


def fix_blank_lines(c: Column) -> Column:
    """At most two blank lines in a row, and a line end at the end."""
    short = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    return F.when(short.endswith("\n"), short).otherwise(F.concat(short, F.lit("\n")))


# A name with its attributes, calls and indices.
OPERAND = r"[A-Za-z_][\w.]*(?:\([^()\n]*\)|\[[^\[\]\n]*\])*"
COMPARISONS = [
    (rf"\bNone\s*==\s*({OPERAND})", "$1 is None"),
    (rf"\bNone\s*!=\s*({OPERAND})", "$1 is not None"),
    (r"[ \t]*==[ \t]*None\b", " is None"),
    (r"[ \t]*!=[ \t]*None\b", " is not None"),
    (rf"\b(if|elif|while)\s+({OPERAND})\s*==\s*True\s*:", "$1 $2:"),
    (rf"\b(if|elif|while)\s+({OPERAND})\s*==\s*False\s*:", "$1 not $2:"),
    (r"(?m)^([ \t]*)except[ \t]*:", "$1except Exception:"),
]


def fix_comparisons(c: Column) -> Column:
    """Python: comparisons with None by identity on either side, a condition that is one comparison with True or False without it, bare except named."""
    for pattern, to in COMPARISONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def comment_out(c: Column, call: str, mark: str) -> Column:
    """Lines that begin with a call, as comments."""
    return F.regexp_replace(c, rf"(?m)^([ \t]*)({call}\s*\()", rf"$1{mark} $2")


JS_PARTS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*[\s\S]*?\*/|[=!<>]=+")


def fix_loose_equality(files: DataFrame) -> DataFrame:
    """JavaScript == and != as === and !==, outside strings and comments."""
    return _per_file(files, lambda text: JS_PARTS.sub(lambda m: m[0] + "=" if m[0] in ("==", "!=") else m[0], text))


def fix_var(c: Column) -> Column:
    """var as let; a name set once stays one that may be set again."""
    return F.regexp_replace(c, r"(?m)^(\s*)var\s+", "$1let ")


SECRET = r"\w*(?:senha|passw(?:or)?d|secret|token|api_?key)\w*"
PYTHON_SECRET = re.compile(rf"(?im)^([ \t]*(?:\w+\.)*)({SECRET})([ \t]*(?::[ \t]*\w+[ \t]*)?=[ \t]*)(\"[^\"\n]+\"|'[^'\n]+')(?=[ \t]*(?:#|$))")
JS_SECRET = re.compile(rf"(?im)(\b)({SECRET})([\"']?\s*[:=]\s*)(\"[^\"\n]+\"|'[^'\n]+')")


def credentials_to_environment(files: DataFrame, language: str = "linguagem") -> DataFrame:
    """id, conteudo: literals of credential names read from the environment instead, under the name in upper case.

    Python files get the import of os that this needs, behind their comments, docstring and __future__ imports. Only Python,
    JavaScript and TypeScript files are changed.
    """

    def one(text: str, lang: str | None) -> str:
        if lang == "python":
            done = PYTHON_SECRET.sub(lambda m: f'{m[1]}{m[2]}{m[3]}os.environ.get("{m[2].upper()}", "")', text)
            return _with_import(done, "os") if done != text else text
        if lang in ("javascript", "typescript"):
            return JS_SECRET.sub(lambda m: f"{m[2]}{m[3]}process.env.{m[2].upper()}", text)
        return text

    return _per_file(files, one, language)


def _with_import(text: str, module: str) -> str:
    if re.search(rf"(?m)^\s*import\s+(?:\w+\s*,\s*)*{module}\b", text):
        return text
    head = re.match(r"(?:[ \t]*(?:#[^\n]*)?\n)*(?:[ \t]*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')[^\n]*\n)?(?:(?:[ \t]*(?:#[^\n]*)?\n)*from\s+__future__[^\n]*\n)*", text)
    return f"{text[: head.end()]}import {module}\n{text[head.end() :]}"


def drop_duplicate_imports(files: DataFrame) -> DataFrame:
    """id, conteudo with each import line of a file kept once. Lines are bounded by their file."""
    lines = code_lines(files)
    is_import = F.col("texto").rlike(r"^\s*(import\s+\S|from\s+\S+\s+import\s)")
    nth = F.row_number().over(Window.partitionBy("id", F.trim("texto"), is_import).orderBy("linha"))
    kept = lines.withColumn("k", F.when(is_import, nth).otherwise(1)).filter("k = 1")
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linha", "texto"))), lambda x: x.texto), "\n").alias("conteudo"))


# A JavaScript statement of one line that ends in a name, number, string or closing bracket.
OPEN_STATEMENT = r"^\s*(?:break|const|continue|export\s+default|import|let|return|throw|var)\b(?:.*[\w)\]\"'`])?\s*$"


def add_semicolons(c: Column) -> Column:
    """JavaScript statements of one line that lack their end mark, with it."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(x.rlike(OPEN_STATEMENT), F.concat(F.regexp_replace(x, r"\s+$", ""), F.lit(";"))).otherwise(x)), "\n")


def comment_console(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^([ \t]*)(console\.(?:log|debug|warn)\s*\([^)\n]*\);?)", "$1// $2")


def _per_file(files: DataFrame, rewrite: Callable[..., str], *more: str) -> DataFrame:
    """id, conteudo with each text rewritten by a function of it and of the columns more; in Arrow batches, nulls kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [None if t is None else rewrite(t, *x) for t, *x in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(done, pa.string())], ["id", "conteudo"])

    return map_arrow(spread(files.select("id", F.col("conteudo").cast("string").alias("conteudo"), *more)), run, f"id {files.schema['id'].dataType.simpleString()}, conteudo string")


def wrap_comments(files: DataFrame, mark: str = "#", width: int = 100) -> DataFrame:
    """Comment lines above the width, broken between words under their own indent."""

    def one(text: str) -> str:
        out = []
        for line in text.split("\n"):
            body = line.lstrip()
            if len(line) > width and body.startswith(mark):
                lead = line[: len(line) - len(body)] + mark + " "
                out += textwrap.wrap(body[len(mark) :], width, initial_indent=lead, subsequent_indent=lead, break_long_words=False, break_on_hyphens=False)
            else:
                out.append(line)
        return "\n".join(out)

    return _per_file(files, one)


def var_to_const(files: DataFrame) -> DataFrame:
    """JavaScript var as const where the name is set once, else as let."""

    def one(text: str) -> str:
        sets = Counter(re.findall(r"\b(\w+)\s*=(?!=)", text))
        return re.sub(r"(?m)^(\s*)var(\s+)(\w+)(?=\s*=)", lambda m: f"{m[1]}{'let' if sets[m[3]] > 1 else 'const'}{m[2]}{m[3]}", text)

    return _per_file(files, one)


def add_docstrings(files: DataFrame) -> DataFrame:
    """A one-line docstring under each Python function that has none and ends its head on its line."""

    def one(text: str) -> str:
        lines = text.split("\n")
        out: list[str] = []
        for line, after in zip(lines, [*lines[1:], ""]):
            out.append(line)
            m = re.match(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(.*\).*:\s*$", line)
            if m and not m[2].startswith("__") and not after.strip().startswith(('"""', "'''")):
                deep = after[: len(after) - len(after.lstrip())] if after.strip() else m[1] + "    "
                out.append(f'{deep}"""TODO: documentar {m[2]}."""')
        return "\n".join(out)

    return _per_file(files, one)


def organise_imports(files: DataFrame) -> DataFrame:
    """Python imports at the head in three sorted groups: standard library, others, relative. Imports inside blocks stay."""

    def one(text: str) -> str:
        lines = text.split("\n")
        found = sorted({x.strip() for x in lines if re.match(r"^(import\s+\w|from\s+\S+\s+import\s+[^(]*$)", x)})
        if not found:
            return text

        def group(x: str) -> int:
            name = re.match(r"(?:import|from)\s+(\.*)([\w]*)", x)
            return 2 if name[1] else 0 if name[2] in sys.stdlib_module_names else 1

        blocks = ["\n".join(x for x in found if group(x) == g) for g in range(3)]
        rest = [x for x in lines if x.strip() not in found or x[:1].isspace()]
        return "\n\n".join([b for b in blocks if b] + ["\n".join(rest).lstrip("\n")])

    return _per_file(files, one)


def generic_names(files: DataFrame) -> DataFrame:
    """id, nomes: names that say nothing (one letter, tmp, temp, aux, var, data) given a value in a file, in order, each once."""
    found = F.regexp_extract_all("conteudo", F.lit(r"(?m)(?:^|[^\w.])([a-z]|tmp|temp|aux|var|data)[ \t]*=(?:[^=]|$)"), F.lit(1))
    return files.select("id", F.array_distinct(found).alias("nomes")).filter(F.size("nomes") > 0)


def improve(files: DataFrame) -> DataFrame:
    """id, linguagem, conteudo, score_antes, score_depois, mudou: the fixes of each file's language, and its score before and after.

    Files of other languages than Python, JavaScript and TypeScript get what holds for all of them.
    """
    from lavra.operators.codescan import JS_RULES, PYTHON_RULES, detect_language, line_score

    named = files.filter("conteudo is not null").select("id", "conteudo", detect_language(F.col("nome_arquivo"), F.col("conteudo")).alias("linguagem"))
    script = F.col("linguagem").isin("javascript", "typescript")
    c = F.col("conteudo")
    python = comment_out(fix_comparisons(c), "print", "#")
    js = add_semicolons(comment_console(fix_var(c)))
    fixed = fix_blank_lines(F.when(F.col("linguagem") == "python", python).when(script, js).otherwise(c))
    done = credentials_to_environment(named.select("id", "linguagem", fixed.alias("conteudo")))

    def scores(table: DataFrame, name: str) -> DataFrame:
        by_python, by_js = line_score(table, PYTHON_RULES), line_score(table, JS_RULES, "javascript")
        return by_python.select("id", F.col("score").alias("p")).join(by_js.select("id", F.col("score").alias("j")), "id").select("id", F.struct("p", "j").alias(name))

    both = named.join(done.select("id", F.col("conteudo").alias("novo")), "id").join(scores(named, "antes"), "id").join(scores(done, "depois"), "id")
    of = lambda s: F.when(script, F.col(s).j).otherwise(F.col(s).p)
    return both.select("id", "linguagem", F.col("novo").alias("conteudo"), of("antes").alias("score_antes"), of("depois").alias("score_depois"), (F.col("novo") != c).alias("mudou"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, linhas_antes, linhas_depois, mudou of each rewritten file."""
    n = lambda c: F.size(F.split(c, "\n", -1)).cast("long")
    b = before.select("id", F.col("conteudo").alias("b"))
    return b.join(after.select("id", F.col("conteudo").alias("a")), "id").select("id", n("b").alias("linhas_antes"), n("a").alias("linhas_depois"), (~F.col("a").eqNullSafe(F.col("b"))).alias("mudou"))
