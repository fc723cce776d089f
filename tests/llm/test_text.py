"""Quality, repeated lines, near-duplicates, leaks and shared spans against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from lavra.functions import codepoints as cp
from lavra.llm import leakage, lines, neardup, quality, spans

WORDS = "casa rio motor ponte gato livro mesa porta tempo vento fogo agua terra monte folha pedra luz noite".split()


def words(text):
    out, now = [], ""
    for c in cp.fold_text(text or "") + "\0":
        if cp.char_class(c) in (cp.LETTER, cp.DIGIT):
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(n))


def edited(rng, text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = rng.choice(["novo", "NOVO,", "outro"])
    if rng.random() < 0.3:
        k = rng.randrange(len(w))
        w = w[k:] + w[:k]
    return " ".join(w)


@pytest.mark.parametrize("size,threshold,least", [(3, 0.6, 12), (5, 0.8, None), (1, 0.5, 2)])
def test_near_duplicates_equal_brute_force(spark, size, threshold, least):
    rng = random.Random(size)
    base = [sentence(rng, rng.randrange(5, 60)) for _ in range(60)]
    texts = base + [edited(rng, rng.choice(base), rng.choice([0.02, 0.05, 0.15])) for _ in range(140)] + [base[0]] * 30 + [None, "", "um dois", "É " * 40, "e " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, texto string").selectExpr("id", "texto", "0 as h", "'x' as text").repartition(6)
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        if len(w) >= max(least or size, size):
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    found = neardup.near_duplicates(df, "id", "texto", size, threshold, least)
    got = [tuple(r) for r in found.expanded_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    split = neardup.near_duplicates(df, "id", "texto", size, threshold, least, block_rows=2)
    assert {tuple(r) for r in split.expanded_pairs().collect()} == expected
    star = {tuple(r) for r in found.expanded_pairs(largest_class=5).collect()}
    copies = {}
    for i in sets:
        copies.setdefault(frozenset(sets[i]), []).append(i)
    large = {i: min(c) for c in copies.values() if len(c) > 5 for i in c}
    assert star == {(a, b) for a, b in expected if (large.get(a, a), large.get(b, b)) == (a, b) or large.get(b) == a and large.get(a) == a} and large
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in expected:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(found).collect()}
    assert groups == {i: find(i) for i in sets}


def test_only_equal_texts_are_linked_by_their_least_id(spark):
    text = "um dois três quatro cinco seis sete oito nove dez onze doze treze"
    texts = [text] * 4 + [text.upper()] * 4 + [text + "." * k for k in range(1, 4)] + [text + " extra"]
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, texto string"), "id", "texto", 3, 0.6, 12)
    got = [tuple(r) for r in found.expanded_pairs(largest_class=3, by_text=True).collect()]
    stand = [0, 4, 8, 9, 10, 11]
    expected = {*itertools.combinations(stand, 2), *((0, k) for k in (1, 2, 3)), *((4, k) for k in (5, 6, 7))}
    assert len(got) == len(set(got)) and set(got) == expected


def test_candidates_follow_the_pairs_that_are_alike(spark, monkeypatch):
    rng = random.Random(9)
    base = [" ".join(rng.choice(WORDS[:6]) for _ in range(40)) for _ in range(120)]
    texts = base + [" ".join([*t.split()[:-1], "outro"]) for t in base[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "text", "xxhash64(text) as raw").repartition(3)
    levels = spark.sparkContext.broadcast(neardup.shingle_levels(df, 3, 12))
    docs = neardup.materialize(neardup.fingerprints(df, levels, 3, 12), "fingerprints")
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    alike = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    ids = {r.h1: r.id for r in docs.select("h1", "id").collect()}
    for entries in (neardup.ENTRIES_A_ROUND, 100):
        monkeypatch.setattr(neardup, "ENTRIES_A_ROUND", entries)
        met = neardup._candidates(docs, neardup.Fraction(3, 5), neardup.BLOCK_ROWS).select("h_a", "h_b").distinct().collect()
        got = {tuple(sorted((ids[r.h_a], ids[r.h_b]))) for r in met}
        assert len(alike) >= 30 and alike <= got and len(got) < 2 * len(alike)


def test_near_duplicates_of_nothing(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], "id long, texto string"), "id", "texto")
    assert found.expanded_pairs().count() == 0 and neardup.near_duplicate_groups(found).count() == 0


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(5)
    notice = ["Todos os direitos reservados a esta casa editora", "Leia também o guia completo da nossa região norte", "todos OS direitos, reservados: a esta casa editora!", "curta demais"]
    rows = []
    for i in range(400):
        source = rng.choice([" Um.EXAMPLE", "um.example", "dois", "tres", None, " ", "quatro"])
        parts = [sentence(rng, 12) for _ in range(rng.randrange(3))] + [n for n in notice if rng.random() < (0.5 if source and "um" in source.lower() else 0.05)]
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", "\r\n", "\n\n"]).join(parts) if parts else rng.choice([None, ""]), source))
    count, places = defaultdict(set), []
    for i, t, s in rows:
        s = (s or "").strip().lower()
        for n, line in enumerate((t or "").split("\n"), 1):
            key = "".join(c for c in cp.fold_text(line) if cp.char_class(c) == cp.LETTER)
            if s and len(key) >= 30:
                count[s, key].add(i)
                places.append((i, n, (s, key)))
    expected = {(i, n) for i, n, k in places if len(count[k]) >= 10}
    df = spark.createDataFrame(rows, "id long, texto string, fonte string").selectExpr("*", "1 as line", "'k' as source")
    found = lines.repeated_lines(df, "id", "fonte", "texto")
    assert {(r.id, r.line) for r in found.collect()} == expected and expected
    clean = {r.id: r.texto for r in lines.strip_lines(df, "id", "texto", found).collect()}
    for i, t, _ in rows:
        assert clean[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in expected))
    assert lines.repeated_lines(df.limit(0), "id", "fonte", "texto").count() == 0


def test_false_discovery_cut():
    assert lines._benjamini_hochberg({}, 0.01) > 1000
    bins = {-1: 50, 0: 900, 10: 30, 400: 20}
    cut = lines._benjamini_hochberg(bins, 0.01)
    assert 10 < cut <= 400


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(100 + i, sentence(rng, rng.randrange(8, 40))) for i in range(25)] + [(300, None), (301, ""), (302, sentence(rng, 11)), (303, "r " * 20)]
    docs = []
    for i in range(120):
        body = sentence(rng, rng.randrange(0, 80)).split()
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w)))
            body[3:3] = [x.upper() + rng.choice(["", ",", " -"]) for x in w[a : a + rng.randrange(5, 30)]]
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "r " * 50), (503, docs[3][1])]
    item_words = {i: words(t) for i, t in items}
    expected = {}
    for d, t in docs:
        w = words(t)
        for i, v in item_words.items():
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= 12:
                expected[d, i] = best
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as item_id", "'q' as texto")
    right = spark.createDataFrame(items, "item_id long, texto string").selectExpr("*", "8 as doc_id")
    for block in (1 << 18, 40):
        found = leakage.find_leaks(left, "doc_id", "text", right, "item_id", "texto", block_words=block)
        assert {(r.doc_id, r.item_id): r.n_words for r in found.collect()} == expected and expected
    for r in found.collect():
        assert words(dict(docs)[r.doc_id])[r.doc_word - 1 :][: r.n_words] == item_words[r.item_id][r.item_word - 1 :][: r.n_words]
    assert {r.doc_id for r in leakage.without_leaks(left, "doc_id", found).collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert leakage.find_leaks(left, "doc_id", "text", right.limit(0), "item_id", "texto").count() == 0
    assert leakage.find_leaks(left.limit(0), "doc_id", "text", right, "item_id", "texto").count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 4, 300)
    got = leakage.suffix_array(ids, 512).tolist()
    assert got == sorted(range(300), key=lambda i: ids[i:].tolist())


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(7)
    least = 30
    base = ["".join(rng.choice("abcdé \n😀") for _ in range(rng.randrange(0, 200))) for _ in range(50)]
    for _ in range(40):
        src = rng.choice(base)
        n = rng.choice([29, 30, 31, 45])
        if len(src) > n:
            a = rng.randrange(len(src) - n)
            base.append("".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + src[a : a + n] + "".join(rng.choice("xyz") for _ in range(rng.randrange(60))))
    docs = list(enumerate(base + [base[0], base[1], base[1], None, "", "q" * 100, "w" + "q" * 100, "-" * 29]))
    have = {i: t for i, t in docs if t and len(t) >= least}
    grams = {i: {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in have.items()}
    expected = {(a, b) for a, b in itertools.combinations(sorted(have), 2) if grams[a] & grams[b]}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "'z' as windows").repartition(4)
    got = [tuple(r)[:2] for r in spans.shared_pairs(df, "doc_id", "text", least).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected
    assert {tuple(r)[:2] for r in spans.shared_pairs(df, "doc_id", "text", least, largest_class=2).collect()} <= expected
    covered = {r.id: r.shared_chars for r in spans.shared_coverage(df, "doc_id", "text", least).collect()}
    for i, t in have.items():
        marks = set()
        for k in range(len(t) - least + 1):
            if any(t[k : k + least] in grams[j] for j in have if j != i):
                marks |= set(range(k, k + least))
        assert covered[i] == len(marks)
    found = {}
    for r in spans.span_classes(df, "doc_id", "text", least).collect():
        assert have[r.id][r.start : r.start + least] in grams[r.id] and r.copies >= 2
        found.setdefault(r.span, set()).add(r.id)
    least_of = {}
    for i in sorted(have):
        least_of.setdefault(have[i], i)
    distinct = {(least_of[have[a]], least_of[have[b]]) for a, b in expected} - {(i, i) for i in have}
    assert {p for c in found.values() for p in itertools.combinations(sorted(c), 2)} == {tuple(sorted(p)) for p in distinct}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans.span_classes(empty, "doc_id", "text").count() == 0
    assert spans.shared_pairs(empty, "doc_id", "text").count() == 0 and spans.shared_coverage(empty, "doc_id", "text").count() == 0


def test_quality(spark):
    prose = "O gato que mora na casa do rio não gosta da chuva, mas sai de noite para ver a lua. Quando volta, dorme no sofá com os seus irmãos."
    rows = {
        1: prose, 2: prose.upper(), 3: prose.replace(" ", "\n"), 4: "- maçã verde\n- pera madura\n- uva roxa\n- banana prata\n- figo seco", 5: "nome;idade;cidade\nAna;31;Recife\nBia;22;Natal\nCaio;45;Belém",
        6: "for (let i = 0; i < n; i++) { total += lista[i]; }\nreturn total * taxa;", 7: "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVowMTIzNDU2Nzg5QUJDREVGR0g=", 8: None, 9: "", 10: "oi", 11: " \n\t ", 12: (prose + " ") * 3000,
        13: prose + "\n- maçã\n- pera\nEm 1999 foram 12,5% de 300 casos na cidade.",
    }
    df = spark.createDataFrame(list(rows.items()), "id long, texto string").selectExpr("*", "1 as n_words", "'a' as text")
    got = {r.id: r for r in quality.judge(quality.text_statistics(df, "id", "texto")).collect()}
    assert {i for i, r in got.items() if r.is_prose} == {1, 2, 3, 12, 13} and {i for i, r in got.items() if r.is_prose is False} == {4, 5, 6, 7}
    assert {i for i, r in got.items() if "empty" in r.failed} == {8, 9, 11} and "bullets" in got[4].failed and got[8].n_chars == 0
    w = words(prose)
    assert got[1].n_words == len(w) and got[1].mean_word_length == pytest.approx(sum(map(len, w)) / len(w))
    assert got[1].punct_line_share == 1 and got[4].bullet_line_share == 1 and got[12].n_words == 3000 * len(w)
    assert quality.text_statistics(df.limit(0), "id", "texto").count() == 0
