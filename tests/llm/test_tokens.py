import os
import random

import pyarrow as pa
import pytest

from lavra.functions import codepoints as cp
from lavra.llm import packing
from lavra.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="no vocabulary files")


def library():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=T.load_ranks(T.DEFAULT_VOCABULARY), special_tokens={})


def test_counts_equal_the_library():
    rng = random.Random(3)
    alphabet = "aéÀ ñ́ﬁ½²…ßİ一😀𝔸١1_-\n\t\x1c ' s t2'relvmd  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(16))) for _ in range(8000)] + [None, "", "a" * 5000, "=" * 3000, "don't we'll I'm 's"]
    counts, enc = T.PieceCounts(T.DEFAULT_VOCABULARY), library()
    for off, part in cp.pieces(pa.array(texts), 30_000):
        assert counts.of(part).tolist() == [len(enc.encode_ordinary(t or "")) for t in texts[off : off + len(part)]]


def test_budget_adds_up(spark):
    rows = [("O gato de botas e a casa", " Site.EXAMPLE", "Ciência"), ("the cat and the house of the man", "site.example", "ciencia"), (None, None, None), ("", "  ", " "), ("x", "b", "geral")] * 3
    out = T.token_budget(spark.createDataFrame(rows, "texto string, fonte string, categoria string"), "texto", "fonte", "categoria").collect()
    by = {(r.nivel, r.fonte, r.idioma, r.dominio): (r.n_textos, r.n_tokens) for r in out}
    total = by[("total", None, None, None)]
    assert total[0] == 15 and total[1] == sum(len(library().encode_ordinary(r[0] or "")) for r in rows)
    for side in ("fonte", "idioma", "dominio", "fonte+idioma+dominio"):
        assert tuple(map(sum, zip(*[v for k, v in by.items() if k[0] == side]))) == total
    assert by[("fonte", "site.example", None, None)][0] == 6 and by[("fonte", "(sem fonte)", None, None)][0] == 6
    assert by[("dominio", None, None, "ciencia")][0] == 6 and by[("dominio", None, None, "geral")][0] == 9
    assert by[("idioma", None, "pt", None)][0] == 3 and by[("idioma", None, "en", None)][0] == 3
    empty = T.token_budget(spark.createDataFrame([], "texto string, fonte string, categoria string"), "texto", "fonte", "categoria").collect()
    assert [r for r in empty if r.nivel != "total"] == []


@pytest.mark.parametrize("capacity", [10, 100])
def test_packing_of_a_group(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 2, 17, 200):
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        window = packing.pack(sizes, capacity)
        total = {}
        for w, s in zip(window, sizes):
            total[w] = total.get(w, 0) + s
        assert len(window) == n and all(v <= capacity for v in total.values())
    small = [rng.randint(1, 9) for _ in range(500)]
    _, sums = packing.differencing(small, 20)
    assert sum(sums) == sum(small) and max(sums) - min(sums) <= 2


def test_packing_covers_every_token_once(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["casa", "programa", "x1", "été"]) for _ in range(rng.choice([0, 3, 40, 300])))) for i in range(150)] + [(500, None), (501, ""), (7, "repetido")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    box = spark.createDataFrame([(1, 64), (2, 256)], "recipiente_id long, capacidade_tokens int")
    rows = packing.pack_documents(df, "doc_id", "text", box, "recipiente_id", "capacidade_tokens").collect()
    enc = library()
    for r, cap in ((1, 64), (2, 256)):
        used, parts = {}, {}
        for x in rows:
            if x.recipiente_id == r:
                used[x.janela] = used.get(x.janela, 0) + x.token_fim - x.token_inicio
                parts.setdefault(x.doc_id, []).append((x.token_inicio, x.token_fim))
        assert max(used.values()) <= cap
        for i, t in docs:
            n = len(enc.encode_ordinary(t or ""))
            if i != 7:
                assert [b - a for a, b in sorted(parts.get(i, []))] == ([cap] * (n // cap) + [n % cap] * (n % cap > 0))
        assert sum(used.values()) / (len(used) * cap) > 0.85
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", box, "recipiente_id", "capacidade_tokens").count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, "doc_id", "text", spark.createDataFrame([(1, 0)], "r long, c int"), "r", "c")
