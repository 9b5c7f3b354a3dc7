"""Fill-in-the-middle, conversation repair and exact top-k against brute force, with edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from hourgrid.llm import fill_middle, queries, repair, topk

SF = "/root/testdata/sf0.001"


def hex_of(text):
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


# --- fill in the middle -------------------------------------------------------------------------------------------------


def plain_fim(doc_id, text, rate=100):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= rate or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\r\nb c\n", "<P>\n", "a<M>b", "<\nP>\nS>", "x<\n<S\n<P\n>", "É\n日本\n👍\nß", "long line " * 40_000 + "\nend", "l\n" * 150_000]


def test_fim_against_slices(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS * 6)] + [(5, None), (5, "a\nb\n"), (5, "a\nb\n")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, form string, restored string")
    got = fill_middle.restore_middle(fill_middle.fill_in_middle(df)).collect()
    want = sorted(((i, *plain_fim(i, t or "")) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_rate_and_empty_table(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id long, text string")
    forms = [r.form for r in fill_middle.fill_in_middle(df, rule=fill_middle.Rule(rate=40, spm_rate=0)).collect()]
    assert forms == [plain_fim(i, "a\nb\nc\n", 40)[1].replace("spm", "psm") for i in range(300)]
    assert fill_middle.restore_middle(fill_middle.fill_in_middle(df.where("doc_id < 0"))).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_exchange_in_place(monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    for first, cut, end in itertools.combinations_with_replacement(range(12), 3):
        buffer = bytearray(range(12))
        fill_middle.exchange(np.frombuffer(buffer, np.uint8), first, cut, end)
        b = bytes(range(12))
        assert bytes(buffer) == b[:first] + b[cut:end] + b[first:cut] + b[end:]


def test_fim_query_equals_its_sql(spark, duck):
    equal_to_sql(spark, duck, "op11_fill_in_middle")


# --- conversation repair -----------------------------------------------------------------------------------------------


def letters_cost(letters):
    """Cheapest (cost, audit) by trying every audit."""
    n, best = len(letters), None
    for inserts in range(n + 3):
        for spots in itertools.combinations(range(n + inserts), inserts):
            for own in itertools.product("DKR", repeat=n):
                rest = iter(own)
                audit = "".join("I" if k in spots else next(rest) for k in range(n + inserts))
                left, out, cost = iter(letters), "", 0
                for e in audit:
                    letter = None if e == "I" else next(left)
                    if e == "D":
                        cost += 3
                        continue
                    if letter == "x":
                        break
                    cost += 0 if e == "K" else 2
                    cost += letter is not None and letter.isupper()
                    out += letter.lower() if e == "K" else "a" if out[-1:] == "u" else "u"
                else:
                    if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        if inserts and best is not None and inserts * 2 > best[0]:
            break
    return best


def test_dawg_against_every_audit():
    words = ["".join(w) for n in range(4) for w in itertools.product("suaoxSUAO", repeat=n)]
    rng = random.Random(4)
    words = rng.sample(words, 160) + ["".join(rng.choice("suaox") for _ in range(4)) for _ in range(12)]
    words = sorted(set(words), key=lambda w: w[::-1])
    assert {w: (c, a) for w, c, a in repair.solve(words)} == {w: letters_cost(w) for w in words}


def plain_repair(rows):
    """One conversation's rows after damage, by a recursion over (cost, audit) with whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare.strip(" \t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        if fault:
            counts[fault] += 1
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, *_ in rows if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    memo = {}

    def go(i, state, inserts=0):
        if (i, state, inserts) not in memo:
            ways = [(0, "", [])] if i == len(rows) and state in (0, 3) else []
            made, role = (3, "assistant") if state == 2 else (2, "user")
            if inserts < 3:
                c, a, o = go(i, made, inserts + 1)
                ways.append((c + 2, "I" + a, [(role, "")] + o))
            if i < len(rows):
                c, a, o = go(i + 1, state)
                ways.append((c + 3, "D" + a, o))
                if letters[i] != "x":
                    own = int(letters[i].isupper())
                    c, a, o = go(i + 1, made)
                    ways.append((c + 2 + own, "R" + a, [(role, rows[i][2])] + o))
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, letters[i].lower()))
                    if to is not None:
                        c, a, o = go(i + 1, to)
                        ways.append((c + own, "K" + a, [rows[i][1:]] + o))
            memo[i, state, inserts] = min(ways) if ways else (10**9, "", [])
        return memo[i, state, inserts]

    cost, audit, out = go(0, 0)
    return counts | {"cost": cost, "audit": audit, "repaired": [tuple(o) for o in out]}


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_repair_query_against_recursion(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    by = {c: [] for c, *_ in rows}
    for c, *row in plain_damage(rows):
        by[c].append(tuple(row))
    got = {r.conv_id: r for r in queries.queries()["op12_conversation_repair"](spark, SF).collect()}
    assert got.keys() == by.keys()
    for c, own in by.items():
        want = plain_repair(own)
        said = hex_of("\n".join(f"{r}:{t}" for r, t in want.pop("repaired")))
        assert {k: got[c][k] for k in want} == want and got[c].repaired_sha256 == said


REPAIR_EDGES = [
    (1, None, "user", "a."), (1, 3, None, None), (1, 3, "", "b"), (1, 9, "assistant", "no end"), (1, 9, "assistant", "no end"), (2, None, None, None), (None, 1, "user", "null id."), (None, 2, "assistant", "x.  \n"),
    (3, 5, "system", "s."), (3, 5, "system", "s."), (3, 5, "user", "u?"), (3, 6, "é", "odd role."), (3, 7, "Assistant", "capital."), (4, 1, "assistant", " "), (4, 2, "user", "long " * 60_000 + "."),
    *[(5, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)], *[(6, 0, "user", "same.")] * 40,
]


def test_repair_edges(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in REPAIR_EDGES], "conv_id long, turn long, role string, text string, letter string, at int")
    got = {r.conv_id: r for r in repair.repair(df).collect()}
    by = {}
    for c, turn, role, text in REPAIR_EDGES:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == by.keys()
    import sys

    sys.setrecursionlimit(20_000)
    for c, own in by.items():
        want = plain_repair(own)
        assert {k: got[c][k] for k in want if k != "repaired"} == {k: v for k, v in want.items() if k != "repaired"}, c
        assert [(t.role, t.text) for t in got[c].repaired] == want["repaired"], c
    assert repair.repair(df.where("conv_id < 0")).count() == 0


def test_a_node_is_made_once_per_suffix(monkeypatch):
    made = []
    real = repair.before
    monkeypatch.setattr(repair, "before", lambda letter, behind: made.append(letter) or real(letter, behind))
    words = sorted(["ua" * k for k in range(1, 40)] + ["sua" * k for k in range(1, 10)] + ["oua"], key=lambda w: w[::-1])
    list(repair.solve(words))
    assert len(made) == len({w[k:] for w in words for k in range(len(w))})


# --- exact top-k ----------------------------------------------------------------------------------------------------------


def plain_top(rows, asked, k=10):
    good = [(n, i, np.floor(1024 * np.array(v, dtype=np.float64))) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in good:
        if i is not None and asked(i):
            met = [(-int(v @ w), j if j is not None else 2**63, m) for m, j, w in good if m != n and len(w) == len(v)]
            out += [(i, rank, j if j < 2**63 else None, -s) for rank, (s, j, _) in enumerate(sorted(met)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(260)]
    rows += [(1000 + i, [0.5, -0.25] * 4) for i in range(90)]  # ties with each other
    rows += [(2000, [0.0] * 8), (2010, [1.0] + [0.0] * 7), (3000, None), (3010, [None] * 8), (3020, [float("nan")] * 8), (3030, [float("inf")] + [1.0] * 7), (4000, [1.0, 2.0]), (4010, [2.0, 1.0]), (4020, []), (4030, []), (5000, [9.0] * 3)]
    rows += [(None, [1.0] * 8), (None, [1.0] * 8), (10, [0.1] * 8), (10, [0.1] * 8), (-10, [-0.1] * 8)]
    return rows


@pytest.mark.parametrize("sizes", [(4096, 512, 16), (16, 4, 2), (1, 1, 1)])
def test_top_k_against_all_scores(spark, sizes):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, row int, part string")
    block, asked, parts = sizes
    if block == 1:  # a block per row: fewer rows
        df = df.where("vec_id is null or vec_id < 30 or vec_id >= 1080")
        rows = [r for r in rows if r[0] is None or r[0] < 30 or r[0] >= 1080]
    held = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, "id % 10 = 0", 10, block_rows=block, query_rows=asked, part_blocks=parts)
    assert found(got) == plain_top(held, lambda i: i % 10 == 0)
    assert topk.top_k(df.limit(0), "id % 10 = 0").count() == 0


def test_the_walk_stops_before_the_end():
    rng = np.random.default_rng(5)
    m = np.floor(1024 * rng.normal(size=(4000, 4)) ** 3)
    lists = np.argsort(m, axis=0).astype("<i4")
    ids = np.arange(4000)
    best, looked_at = topk.threshold_search(m[7], 7, ids, ids, m, lists, 10)
    want = sorted((-(m[j] @ m[7]), j) for j in range(4000) if j != 7)[:10]
    assert [(-s, i) for s, i in zip(best.scores, best.ids)] == want
    assert looked_at < 2000


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError, match="too large"):
        topk.whole([[1e9, 1.0]])


def test_top_k_query_equals_its_sql(spark, duck):
    equal_to_sql(spark, duck, "op13_exact_top_k")


# --- helpers ---------------------------------------------------------------------------------------------------------------


def equal_to_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c
