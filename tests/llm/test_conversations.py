import random
from datetime import datetime, timedelta, timezone

import pytest

from lavra.llm.conversations import conversations, thread_paths

USER, BOT, NOTE = {"usuario", "usuário", "user", "humano"}, {"ia", "assistente", "assistant", "bot"}, {"sistema", "system"}
SCHEMA = "id long, sessao_id string, papel string, conteudo string, timestamp timestamp"


def brute(rows):
    groups, out = {}, set()
    for r in rows:
        s = (r[1] or "").strip().lower()
        if s:
            groups.setdefault(s, []).append(r)
    for s, rs in groups.items():
        rs.sort(key=lambda r: (r[4] is not None, r[4].timestamp() if r[4] else 0, r[0]))
        roles = ["u" if (p := (r[2] or "").strip().lower()) in USER else "a" if p in BOT else "n" if p in NOTE else "?" for r in rs]
        kept = [(roles[i], r) for i, r in enumerate(rs) if not i or (roles[i], r[3]) != (roles[i - 1], rs[i - 1][3])]
        kept = [x for x in kept if x[0] != "n"]
        sound = all(role == "ua"[i % 2] and r[4] and r[3] and any(c.isalnum() for c in r[3]) for i, (role, r) in enumerate(kept))
        if kept and len(kept) % 2 == 0 and sound:
            out |= {(s, i + 1, r[0]) for i, (_, r) in enumerate(kept)}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    start = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows, n = [], 0
    for s in range(120):
        size = 400 if s == 0 else rng.randrange(1, 9)
        for k in range(size):
            odd = rng.random() < (0.002 if s == 0 else 0.08)
            role = rng.choice(["sistema", "?", None, "bot"]) if odd else rng.choice(["usuario", " User", "humano"]) if k % 2 == 0 else rng.choice(["ia", "BOT "])
            text = rng.choice([None, "", "...", "x"]) if odd else f"t{n}"
            time = None if odd and rng.random() < 0.2 else start + timedelta(seconds=k - (odd and rng.random() < 0.3))
            name = rng.choice([f"s{s}", f" S{s} ", f"s{s}\t"])
            rows.append((n, name, role, text, time))
            n += 1
            if rng.random() < 0.1:
                rows.append((n, name, role, text, time))
                n += 1
    rows += [(n, None, "usuario", "a", start), (n + 1, "  ", "usuario", "a", start)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {tuple(r) for r in conversations(df).collect()} == brute(rows)


def test_empty_and_further_columns(spark):
    assert conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    now = datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "a", "user", "oi", now, 1, "x"), (2, "a", "bot", "olá", now, 2, None)], SCHEMA + ", position int, session string")
    assert sorted(map(tuple, conversations(df).collect())) == [("a", 1, 1), ("a", 2, 2)]


def test_paths_of_branching_threads(spark):
    nodes = [(1, None), (2, 1), (3, 2), (4, 2), (5, 9), (6, 5), (7, 8), (8, 7), (11, None), *[(100 + i, 99 + i if i else None) for i in range(37)]]
    got = {}
    for r in thread_paths(spark.createDataFrame(nodes, "id long, parent long")).collect():
        got.setdefault(r.path, []).append((r.position, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {3: [1, 2, 3], 4: [1, 2, 4], 11: [11], 136: list(range(100, 137))}
