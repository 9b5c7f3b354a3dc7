"""The corpus operators against brute force, with planted cases and edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from hourgrid.llm import chat, common, decontaminate, licenses, packing, passage_dedup, quality_classifier, quality_rules, queries, simhash, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def docs_of(spark, rows):
    """Documents with further columns whose names operators use inside."""
    data = [(i, t, 1, "x", 0.5, None) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, id long, raw string, score double, n_words long")


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "null id"), (5, "same text twice over"), (5, "same text twice over"), (6, "long " * 50_000), (7, "É 日本 👍 ß")]


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_chat_format", "op10_warc"])
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# --- components -------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(600, k) for k in range(601, 640)] + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark, duck):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert docs.count() == queries.queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01").count()


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs_of(spark, EDGES), labels)
    assert got.count() == len(EDGES) and got.where("score is null or predicted is null").count() == 0
    assert quality_classifier.classify(docs_of(spark, []), labels.limit(0)).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (40, 3, quality_classifier.WIDTH)), rng.normal(0, 1, (40, 3, quality_classifier.WIDTH))
    bad[:, 1, 5] += 6  # one passage of three tells
    bags, y = [*good.astype(np.float32), *bad.astype(np.float32)], np.array([1.0] * 40 + [0.0] * 40)
    p = quality_classifier.fit(bags, y, epochs=40).score(bags)
    assert ((p > 0.5) == y).mean() > 0.95


def test_forward_pass_and_gradient_against_loops():
    rng = np.random.default_rng(1)
    width = quality_classifier.WIDTH
    bags = [rng.normal(0, 1, (k, width)) for k in (1, 4, 2)]
    y = np.array([1.0, 0.0, 1.0])
    w = {"e": rng.normal(0, 0.2, (width, 3)), "e0": rng.normal(0, 0.2, 3), "v": rng.normal(0, 0.5, (3, 2)), "u": rng.normal(0, 0.5, (3, 2)), "a": rng.normal(0, 1, 2), "c": rng.normal(0, 1, 3), "c0": np.array([0.1])}
    model = quality_classifier.AttentionMil(np.full(width, 0.1), np.full(width, 1.5), w)
    for bag, p in zip(bags, model.score(bags), strict=True):
        h = [np.tanh(((x - 0.1) / 1.5) @ w["e"] + w["e0"]) for x in bag]
        weight = [float(np.exp(sum(w["a"][k] * np.tanh(r @ w["v"][:, k]) / (1 + np.exp(-(r @ w["u"][:, k]))) for k in range(2)))) for r in h]
        z = sum(q * r for q, r in zip(weight, h, strict=True)) / sum(weight)
        assert p == pytest.approx(1 / (1 + np.exp(-(z @ w["c"] + w["c0"][0]))))
    # Finite differences of the mean log loss.
    grad = quality_classifier.gradient(model, bags, y)
    loss = lambda: -np.mean(y * np.log(model.score(bags)) + (1 - y) * np.log(1 - model.score(bags)))
    for name, value in w.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 6)]:
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_passage_features_against_loops():
    rng = random.Random(2)
    bits = ["a", "The", "É日", "x1", "!!", "#", "word", " ", " ", "\n", "\t"]
    for _ in range(40):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 400)))
        ws, got = text.encode().split(), quality_classifier.passages(text)
        assert len(got) == max(1, -(-len(ws) // 64))
        for k, row in enumerate(got if ws else []):
            own = ws[64 * k : 64 * k + 64]
            sizes, joined = [len(x) for x in own], b" ".join(own)
            assert row[0] == pytest.approx(sum(97 <= c <= 122 for c in joined) / len(joined), abs=1e-5) and row[3] == pytest.approx((len(own) - 1) / len(joined), abs=1e-5)
            assert row[10] == pytest.approx(np.log1p(np.mean(sizes)), abs=1e-5) and row[11] == pytest.approx(np.log1p(np.std(sizes)), abs=1e-3)
            assert row[12] == pytest.approx(len(set(own)) / len(own), abs=1e-5) and row[13] == pytest.approx(sum(a == b for a, b in itertools.pairwise(own)) / len(own), abs=1e-5)
            assert row[14] == pytest.approx(len(set(itertools.pairwise(own))) / max(1, len(own) - 1), abs=1e-5)
            for at, n in ((18, 32), (50, 64), (114, 32)):
                assert row[at : at + n].sum() == pytest.approx(1, abs=1e-4)
    long = " ".join(f"w{k % 977}" for k in range(3000))
    whole = quality_classifier.passages(long)
    quality_classifier.PART, kept = 1000, quality_classifier.PART
    try:
        assert np.allclose(quality_classifier.passages(long), whole)
    finally:
        quality_classifier.PART = kept


def test_a_labelled_document_beyond_the_budget_is_skipped(spark):
    rows = [(i, ("plain words of a good text. " if i % 2 else "$$ buy ## now !! ") * (5 + i % 4), i % 2) for i in range(60)]
    long = [(i, "x" * 100_000, 1) for i in range(60, 100)]
    frame = lambda rs: (spark.createDataFrame([(i, t) for i, t, _ in rs], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rs], "doc_id long, quality int"))
    with_long, without = (quality_classifier.train(*frame(rs), max_bytes=50_000) for rs in (rows + long, rows))
    assert with_long.w.keys() == without.w.keys() and with_long.w
    assert all(np.array_equal(with_long.w[k], without.w[k]) for k in without.w) and np.array_equal(with_long.mean, without.mean)
    with pytest.raises(ValueError, match="labelled documents"):
        quality_classifier.train(*frame(long), max_bytes=50_000)


# --- 2 ------------------------------------------------------------------------------------------------------------------


def brute_hits(items, words, window):
    hit, names = set(), set()
    for name, ws in items:
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1) if ws else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == ws[k : k + size]:
                    hit |= set(range(i, i + size))
                    names.add(name)
    return hit, names


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = lambda n: [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]  # noqa: B023, E731
        items = [(str(k), words(rng.randrange(0, 9))) for k in range(rng.randrange(0, 6))]
        doc = [rng.choice([b"a", b"b", b"c", b"zz"]) for _ in range(rng.randrange(0, 40))]
        spans, names = decontaminate.SuffixAutomaton(items, 4).scan(doc)
        hit, want = brute_hits(items, doc, 4)
        assert {i for a, b in spans for i in range(a, b)} == hit and names == want
        assert all(x[1] < y[0] for x, y in itertools.pairwise(spans))


def test_contamination_in_blocks(spark):
    rng = random.Random(3)
    bench = spark.createDataFrame([(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 40)))) for k in range(30)] + [(99, None), (None, "a b c d e f a b c d e f a")], "item_id long, text string")
    docs = docs_of(spark, [(i, " ".join(rng.choice("abcdef") for _ in range(300))) for i in range(20)] + EDGES)
    key = lambda r: str((r.doc_id, r.n_words, r.spans, r.items))
    one = sorted(map(key, decontaminate.find_contamination(docs, bench).collect()))
    assert one == sorted(map(key, decontaminate.find_contamination(docs, bench, block_words=150).collect()))
    # Items longer than a block are cut into parts that keep every window.
    long = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(400))), (2, "w5 w6 w7")], "item_id long, text string")
    texts = docs_of(spark, [(1, " ".join(f"w{k}" for k in range(90, 115))), (2, " ".join(f"w{k}" for k in range(380, 392))), (3, "w4 w5 w6 w7 w8"), (4, " ".join(f"w{k}" for k in range(400)))])
    assert sorted(map(key, decontaminate.find_contamination(texts, long).collect())) == sorted(map(key, decontaminate.find_contamination(texts, long, block_words=60).collect()))
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_decontaminate_drops_and_cuts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    clean = " ".join(f"w{i}" for i in range(400))
    docs = docs_of(spark, [(1, "Look: " + item.upper() + "!"), (2, clean + " " + item + ". " + clean), (3, clean), (4, None)])
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {2, 3, 4} and got[3] == clean and "gamma" not in got[2] and got[2].startswith("w0 ") and got[2].endswith("w399") and got[4] is None


def test_decontaminate_without_ids_and_with_repeated_ones(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    clean = " ".join(f"w{i}" for i in range(400))
    rows = [(None, item), (None, clean), (None, clean + " " + item), (7, item), (7, clean), (7, clean), (7, item + " " + clean), (7, item + " " + clean)]
    got = decontaminate.decontaminate(docs_of(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.strip()) for r in got) == [(0, clean)] * 2 + [(7, clean)] * 4


# --- 3 ------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    ws = SPACED.findall((text or "").translate(LOW))
    grams = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, documents):
    rows = documents[:150] + [(9000 + k, documents[k][1] + " tail") for k in range(20)] + [(i + 10_000, t) for i, t in EDGES if i]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


@pytest.mark.parametrize(("radius", "segments"), [(3, 2), (3, 4), (3, 3), (5, 2)])
def test_links_lose_none(spark, radius, segments):
    rng = random.Random(radius * 10 + segments)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for s in seeds:
        for k in range(1, 7):
            prints.add(s ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, segments).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(docs_of(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and [r.fingerprint for r in got if r.doc_id == 1] == ["0" * 16]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    kept = simhash.keep_one(docs_of(spark, EDGES))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7] and kept.columns == docs_of(spark, []).columns


def test_keep_one_knows_rows_by_id_and_text(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)) for _ in range(5))
    kept = simhash.keep_one(docs_of(spark, [(None, a), (None, b), (None, b), (None, c), (3, c), (4, d), (4, e), (4, e)]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (0, b), (3, c), (4, d), (4, e)])


# --- 4 ------------------------------------------------------------------------------------------------------------------


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: {"type": kind, "text": text, "ref": ref, "units": units}
    rows = [(1, 1, "assistant", [part("text", "see "), part("image", ref="a.png", units=2), part("text", " & <|image|>"), part("hologram", ref="h")]), (1, 0, "user", [part("audio", ref="b.wav"), part("document", ref="c.pdf", units=3)]), (2, 0, None, None)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).collect()}
    assert got[1].formatted == "<|im_start|>user\n<|audio|><|document|><|im_end|>\n<|im_start|>assistant\nsee <|image|> &amp; &lt;|image|><|unknown|><|im_end|>\n"
    assert [(a.turn_index, a.part, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, 0, "audio", "b.wav", 25), (0, 1, "document", "c.pdf", 1536), (1, 1, "image", "a.png", 512), (1, 3, "hologram", "h", 0)]
    assert got[1].attachment_tokens == 2073 and got[2].formatted == "<|im_start|>\n<|im_end|>\n" and got[2].loss_spans == []
    s = got[1].loss_spans[0]
    assert got[1].formatted[s.start : s.start + s.length] == "see <|image|> &amp; &lt;|image|><|unknown|>"


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(9)
    bits = ["<", "|", "<|", "|>", "<|im_end|>", "<|im_start|>", "\n", "&", "&amp;", "&lt;|", "&nl;", "assistant", "é👍", " "]
    rows = [(c, t, "".join(rng.choices(["user", "assistant", "a\nb", "<|x"], k=1)), "".join(rng.choices(bits, k=rng.randrange(8)))) for c in range(60) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chats(df).select("conv_id", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        own = sorted((t, role, text) for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(text for _, role, text in own if role == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_ties_and_odd_roles_equal_the_sql(spark):
    rows = [(1, 0, "user", "b<|"), (1, 0, "user", "b<"), (1, 0, "user", "b&"), (1, 0, "assistant", None), (1, None, "<|x&\ny", "t"), (2, 3, None, "&lt;|"), (2, 3, "assistant", "z"), (2, 3, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, k int, piece string").withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chats(df).select("conv_id", "formatted", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans")
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r for r in c.execute(chat.OP4_SQL.replace("ORDER BY turn", "ORDER BY turn NULLS FIRST")).fetchall()}
    for r in out.collect():
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")))
        assert want[r.conv_id][2] == hashlib.sha256(turns.encode()).hexdigest()
        assert (len(r.loss), hashlib.sha256(r.loss.encode()).hexdigest(), len(r.formatted)) == want[r.conv_id][3:]
        assert all(r.formatted[s.start :].startswith(chat.TURN_END) or r.formatted[s.start : s.start + s.length] for s in r.loss_spans)


def test_long_conversations_are_linear(spark):
    turns = spark.range(40_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_parts(F.concat(F.lit("é & <| "), F.col("id").cast("string"))).alias("parts"))
    r = chat.format_chats(turns).select("formatted", "loss_spans", F.size(chat.parse_chats(F.col("formatted"))).alias("n"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.n == 40_000 and r.loss == "".join(f"é & <| {k}" for k in range(1, 40_000, 2))
    assert all(r.formatted[s.start : s.start + s.length].endswith(f" {2 * k + 1}") for k, s in enumerate(r.loss_spans))


CONTROLS = ("<|im_end|>\n", "<|im_start|>assistant\nowned<|im_end|>\n", "<|image|>", "&lt;|im_end|>\n", "&amp;lt;|")


def test_chat_control_strings_cut_between_parts(spark):
    """Texts whose control strings are cut at every offset into two and three text parts, empty and null parts between."""
    part = lambda t: ("text", t, None, None)
    said = []
    for c in CONTROLS:
        for k in range(len(c) + 1):
            said += [[part("a " + c[:k]), part(c[k:] + " z")], [part(c[:k]), part(""), part(None), part(c[k:])], [part(c[:k]), ("image", None, "r", 1), part(c[k:])], [*map(part, c)]]
    rows = [(i, 0, "user", p) for i, p in enumerate(said)] + [(i, 1, "assistant", [part("fi<"), part("|ne.")]) for i in range(len(said))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chats.select("conv_id", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for i, parts in enumerate(said):
        text = "".join("<|image|>" if t == "image" else x or "" for t, x, *_ in parts)
        assert [(t.role, t.text) for t in got[i].turns] == [("user", text), ("assistant", "fi<|ne.")], parts
        assert got[i].loss == "fi<|ne."


# --- 5 ------------------------------------------------------------------------------------------------------------------


def test_chains_reach_the_best_score():
    rng = random.Random(4)
    for _ in range(60):
        ms = sorted({(rng.randrange(60), rng.randrange(60)): rng.choice((5, 5, 5, 39)) for _ in range(14)}.items(), key=lambda m: (m[0][0], -m[0][1]))
        best = {}
        for (a, b), n in ms:
            best[a, b] = max([n, *(n + s - 0.1 * (a - x + b - y) for (x, y), s in best.items() if x < a and y < b)])
        found = passage_dedup.chains([(a, b, n) for (a, b), n in ms] + [(a, b, 1) for (a, b), _ in ms])
        assert sorted((a, b, n) for _, c in found for a, b, n in c) == sorted((a, b, n) for (a, b), n in ms)
        assert all(x[0] < y[0] and x[1] < y[1] for _, c in found for x, y in itertools.pairwise(c))
        assert found[0][0] == pytest.approx(max(best.values())) and all(s == pytest.approx(best[c[-1][:2]]) for s, c in found)


def test_common_words_of_gaps():
    rng = random.Random(14)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        assert passage_dedup._common(a, b) == table[-1][-1]
    assert passage_dedup._common(list(range(30_000)), list(range(15_000, 45_000))) == 15_000


def test_planted_passages_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passage, fuzzy = text(60), text(80)
    changed = [w if k % 20 != 10 else word() for k, w in enumerate(fuzzy)]
    dropped = fuzzy[:30] + fuzzy[31:]
    docs = [(1, text(100) + passage + text(50)), (2, text(30) + passage), (3, passage + text(80)), (4, text(200)), (5, fuzzy + text(40)), (6, text(40) + changed + text(10)), (7, text(20) + dropped), (8, text(30) + passage[:30] + text(30))]
    df = docs_of(spark, [(i, " ".join(ws)) for i, ws in docs] + [(20 + i if i else None, t) for i, t in EDGES])
    found = passage_dedup.find_passages(df)
    pairs = {(r.did, r.pdid) for r in found.collect()}
    assert {(2, 1), (3, 1), (6, 5)} <= pairs and any(p[0] == 7 for p in pairs)
    got = {r.doc_id: r for r in passage_dedup.cut_passages(df, found).collect()}
    assert got[1].n_removed == got[4].n_removed == got[5].n_removed == got[8].n_removed == 0 and got[4].text == " ".join(docs[3][1])
    assert 60 <= got[2].n_removed <= 62 and 60 <= got[3].n_removed <= 62 and 78 <= got[6].n_removed <= 82 and 77 <= got[7].n_removed <= 81
    assert got[2].text.split()[:29] == docs[1][1][:29] and got[3].text.split()[-78:] == docs[2][1][-78:]
    assert passage_dedup.cut_passages(df, found).count() == df.count()
    none = docs_of(spark, [])
    assert passage_dedup.cut_passages(none, passage_dedup.find_passages(none)).count() == 0


def test_exact_runs_of_documents_are_removed(spark, documents):
    cut = {r.doc_id: r for r in passage_dedup.cut_passages(docs_of(spark, documents), passage_dedup.find_passages(docs_of(spark, documents))).collect()}
    seen: set = set()
    for i, t in documents:
        ws = passage_dedup.WORD.findall(t.encode().lower())
        grams = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        covered = {p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)}
        seen.update(grams)
        assert cut[i].n_words == len(ws) and cut[i].n_removed >= 0.95 * len(covered)


def test_a_passage_of_fragments_is_found(spark):
    """A passage that two documents share is found though all of its parts stand in documents before and between them."""
    rng = random.Random(21)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    for copies in (1, 20):
        passage = text(60)
        rows = [(1000, text(40) + passage + text(30)), (2000, text(25) + passage + text(40))]
        for i in range(copies):
            rows += [(10 * i + k, text(20) + passage[at : at + 24] + text(20)) for k, at in enumerate((0, 18, 36))] + [(1100 + 3 * i + k, text(20) + passage[at : at + 24] + text(20)) for k, at in enumerate((0, 18, 36))]
        df = docs_of(spark, [(i, " ".join(ws)) for i, ws in rows])
        got = {(r.did, r.pdid) for r in passage_dedup.find_passages(df).collect()}
        assert got == {(2000, 1000)}


def test_copies_follow_their_first_document(spark):
    rng = random.Random(22)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    long, short = text(60), text(30)
    df = docs_of(spark, [(1, long), (2, long), (2, long), (3, short), (4, short), (None, text(70)), (5, long + " " + text(20))])
    got = sorted((r.doc_id or 0, r.n_removed, r.matched_docs) for r in passage_dedup.cut_passages(df, passage_dedup.find_passages(df)).collect())
    assert got == [(0, 0, []), (1, 0, []), (2, 60, [1]), (2, 60, [1]), (3, 0, []), (4, 0, []), (5, 60, [1])]


@pytest.mark.parametrize(("low", "high"), [(8, 16), (15, 25), (30, 45)])
def test_passages_composed_of_stock_lines(spark, low, high):
    """Every word of an exact window of 50 words that an earlier document has goes, though its lines stand in others too."""
    rng = random.Random(low)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    lines, known, docs = [text(rng.randrange(low, high)) for _ in range(40)], [], []
    for i in range(300):
        ws = text(15)
        for _ in range(3):
            known.append(rng.choice(known) if known and rng.random() < 0.5 else [rng.choice(lines) for _ in range(rng.randrange(2, 6))])
            ws += sum(known[-1], []) + text(10)
        docs.append((i, ws))
    removed = {i: set() for i, _ in docs}
    for r in passage_dedup.find_passages(docs_of(spark, [(i, " ".join(ws)) for i, ws in docs])).collect():
        removed[r.did] |= set(range(r.start, r.end))
    seen, shared = set(), 0
    for i, ws in docs:
        grams = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        covered = {p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)}
        seen.update(grams)
        shared += len(covered)
        assert covered <= removed[i]
    assert shared > 3000


@pytest.mark.parametrize("rare", [2, 8, 1000])
def test_exact_passages_do_not_depend_on_frequency(spark, monkeypatch, rare):
    """What an earlier document has goes, however many places of a seed are linked with each other."""
    rng = random.Random(13)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    line = text(45)  # less than a passage
    kinds = [text(30) for _ in range(12)]
    rows = [(i, text(20) + (line + rng.choice(kinds) if i > 60 else line) + text(10) + (line if i % 7 == 0 else [])) for i in range(200)]
    df = docs_of(spark, [(i, " ".join(ws)) for i, ws in rows])
    monkeypatch.setattr(passage_dedup, "RARE", rare)
    removed = {i: set() for i, _ in rows}
    for r in passage_dedup.find_passages(df).collect():
        removed[r.did] |= set(range(r.start, r.end))
    seen = set()
    for i, ws in rows:
        grams = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        assert {p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)} <= removed[i]
        seen.update(grams)


def test_long_passages_reach_beyond_their_slices(spark, monkeypatch):
    rng = random.Random(23)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage = text(200)
    df = docs_of(spark, [(1, " ".join(text(100) + passage + text(100))), (2, " ".join(text(300) + passage + text(10)))])
    wide = [tuple(r) for r in passage_dedup.find_passages(df).collect()]
    monkeypatch.setattr(passage_dedup, "BEFORE", 8)
    monkeypatch.setattr(passage_dedup, "AFTER", 60)
    assert [tuple(r) for r in passage_dedup.find_passages(df).collect()] == wide and wide[0][2:4] == (300, 500)


@pytest.mark.parametrize(("size", "gap"), [(60, 50), (60, 20), (100, 150), (300, 300), (300, 100)])
def test_words_between_two_passages_stay(spark, size, gap):
    rng = random.Random(size + gap)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    head, foot = text(size), text(size)
    df = docs_of(spark, [(1, " ".join(head + text(gap) + foot)), (2, " ".join(head + (between := text(gap)) + foot))])
    got = {r.doc_id: r for r in passage_dedup.cut_passages(df, passage_dedup.find_passages(df)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 2 * size and got[2].n_spans == 2 and got[2].text.split() == between


def test_repeats_that_are_one_only_as_a_whole():
    text = lambda c, n: [f"{c}{k}" for k in range(n)]
    for parts, want in [((40, 20, 40), [(0, 100)]), ((60, 20, 30), [(0, 110)]), ((300, 60, 12), [(0, 300)]), ((60, 5, 60), [(0, 125)]), ((40, 30, 40), []), ((45, 9, 45, 40, 20), [(0, 99)])]:
        a, b, anchors = [], [], []
        for k, n in enumerate(parts):
            if k % 2 == 0:
                anchors += [(len(a) + x, len(b) + x) for x in range(0, n - 4, 6)]
            a += text(f"s{k}x" if k % 2 == 0 else f"a{k}x", n)
            b += text(f"s{k}x" if k % 2 == 0 else f"b{k}x", n)
        assert [r[:2] for r in passage_dedup.repeats(a, b, anchors)] == want


def test_a_text_looks_up_each_of_its_windows_once(spark, monkeypatch):
    """Near copies that repeat words over and over: rows that are joined are bounded by the texts, not by the places in them, and
    every exact window of 50 words that an earlier document has goes."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    runs = [[word()] * 150 for _ in range(3)]
    docs = []
    for i in range(60):
        ws = [w for run in runs for w in run]
        ws[rng.randrange(len(ws))] = word()
        docs.append((i, [word() for _ in range(8)] + ws + ([runs[0][0]] * 70 if i % 9 == 0 else [])))
    rows, landed = [], passage_dedup.landed

    def counted(df, path=None):
        out = landed(df, path)
        if "places" in df.columns:
            rows.append((out.count(), out.selectExpr("sum(size(places))").first()[0]))
        return out

    monkeypatch.setattr(passage_dedup, "landed", counted)
    removed = {i: set() for i, _ in docs}
    for r in passage_dedup.find_passages(docs_of(spark, [(i, " ".join(ws)) for i, ws in docs])).collect():
        removed[r.did] |= set(range(r.start, r.end))
    seen, different = set(), 0
    for i, ws in docs:
        grams = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        assert {p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)} <= removed[i]
        seen.update(grams)
        different += len(set(grams))
    assert len(rows) == 1 and rows[0][0] <= different and rows[0][1] > 2 * rows[0][0]


def test_a_repeated_word_links_few_of_its_places(spark):
    """Texts that repeat words over and over: of a window's places those are linked that cover the words of all, so the links of 50
    words follow the words and not the places; what an earlier document has goes."""
    rng = random.Random(37)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one, line = word(), [word() for _ in range(30)]
    docs = [(i, [word() for _ in range(9)] + [one] * rng.randrange(600, 700) + [word()] + line * rng.randrange(8, 12) + [word() for _ in range(9)]) for i in range(40)]
    df = docs_of(spark, [(i, " ".join(ws)) for i, ws in docs])
    links = passage_dedup.find_links(passage_dedup.distinct_texts(df, "doc_id", "text")).where("n >= 50").select("did", "pdid", "pos").collect()
    assert {r.did for r in links} == set(range(1, 40)) and len(links) < sum(len(ws) for _, ws in docs) / 4
    removed = {i: set() for i, _ in docs}
    for r in passage_dedup.find_passages(df).collect():
        removed[r.did] |= set(range(r.start, r.end))
    seen = set()
    for i, ws in docs:
        grams = [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        assert {p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)} <= removed[i]
        seen.update(grams)


def test_covering_places_cover_the_same_words(spark):
    rng = random.Random(41)
    rows = [(sorted(rng.sample(range(n), rng.randrange(1, min(n, 256) + 1))),) for n in (1, 2, 49, 50, 51, 300, 300, 2000, 9000) for _ in range(8)]
    df = spark.createDataFrame(rows, "p array<int>").selectExpr("p", "transform(p, x -> named_struct('pos', x, 'at', x)) as places")
    for p, kept in df.select("p", passage_dedup._covering("places", 50)["pos"]).collect():
        words = lambda places: {w for x in places for w in range(x, x + 50)}
        assert words(kept) == words(p) and set(kept) <= set(p) and kept == sorted(kept) and len(kept) <= 2 * (p[-1] // 50 + 1)


def test_frequent_seeds_are_counted_where_they_lie(spark, monkeypatch):
    """The counts and first places of seeds come from windows: no table of them is made from the texts and joined."""
    plans, landed = [], passage_dedup.landed

    def noted(df, path=None):
        plans.append((df.columns, df._jdf.queryExecution().analyzed().toString()))
        return landed(df, path)

    monkeypatch.setattr(passage_dedup, "landed", noted)
    line = " ".join(f"l{k}" for k in range(45))
    texts = passage_dedup.distinct_texts(docs_of(spark, [(i, f"a{i} b{i} {line} c{i} d{i}") for i in range(12)]), "doc_id", "text")
    plans.clear()
    assert passage_dedup.find_links(texts).count() > 0
    tables = [plan for columns, plan in plans if "pos" in columns]
    assert len(tables) == 3 and not [plan for plan in tables if "Join" in plan]


@pytest.mark.parametrize("rare", [2, 8, 1000])
def test_an_inexact_passage_of_frequent_lines(spark, monkeypatch, rare):
    """Two documents share a passage of eight lines, each of which twelve others hold too, in other orders and one at a time. The
    passage has a change every eleven words, so no exact run is long; it is found once, however frequent its lines are."""
    monkeypatch.setattr(passage_dedup, "RARE", rare)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    lines = [[word() for _ in range(12)] for _ in range(8)]
    own = lambda n: [word() for _ in range(n)]
    passage = [w for line in lines for w in line]
    changed = [word() if k % 11 == 10 else w for k, w in enumerate(passage)]
    docs = [(100, own(30) + passage + own(30)), (101, own(30) + changed + own(30))]
    for k in range(12):
        mixed = rng.sample(lines, 8)
        docs.append((k, [w for line in mixed for w in own(9) + line + own(9)]))
    found = passage_dedup.find_passages(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string"))
    rows = [r for r in found.collect() if (r.pdid, r.did) == (100, 101)]
    assert len(rows) == len(set(rows)) == 1 and rows[0].start <= 34 and rows[0].end >= 120 and rows[0].similarity >= 0.88


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_statistics_against_brute_force(spark, documents):
    rng = random.Random(6)
    odd = [(5000 + k, "".join(rng.choice(["a ", "b ", "a b c d e ", "\n", "\t", "#", "é", "  "]) for _ in range(rng.randrange(60)))) for k in range(60)]
    rows = documents[:120] + odd + [(6000 + k, t) for k, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: r for r in quality_rules.document_stats(docs_of(spark, rows).select("doc_id", "text")).collect()}
    for i, t in rows:
        t = t or ""
        ws, lines = SPACED.findall(t), [s for s in t.split("\n") if SPACED.search(s)]
        grams = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        covered = {p for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for p in range(k, k + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_scatter_ignores_outliers_and_rejects_them(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = [(i, " ".join(word() for _ in range(rng.randrange(80, 300)))) for i in range(300)]
    bad = [(1000 + i, " ".join(word() + "***" for _ in range(150))) for i in range(60)]
    df = docs_of(spark, good + bad).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not any(got[i] for i, _ in bad) and sum(got[i] for i, _ in good) >= 298


def test_scatter_against_plain_estimates(spark):
    """The determinant is as small as that of concentration steps from many random starts, up to the bins."""
    rng = np.random.default_rng(8)
    d, n, h = 3, 400, 300
    clean = rng.normal(0, 1, (n - 90, d)) @ np.array([[60, 20, 0], [0, 40, 10], [0, 0, 30]])
    data = np.round(np.concatenate([clean, rng.normal(0, 8, (90, d)) + [300, -200, 150]])).astype(int)
    floor = (0.01, 0.01, 0.01)
    df = spark.createDataFrame([("p", *map(int, r)) for r in data], "pool string, a long, b long, c long")
    got = quality_rules.robust_scatter(df, F.broadcast, ("a", "b", "c"), h / n, floor=floor).first()
    best = np.inf
    for _ in range(60):
        chosen = rng.choice(n, d + 1, replace=False)
        for _ in range(15):
            centre, scatter = data[chosen].mean(0), np.cov(data[chosen].T, bias=True) + np.diag([(0.01 * 256) ** 2] * d)
            chosen = np.argsort(((data - centre) @ np.linalg.inv(scatter) * (data - centre)).sum(1))[:h]
        scatter = np.cov(data[chosen].T, bias=True) * quality_rules.consistency(h / n, d) + np.diag([(0.01 * 256) ** 2] * d)
        best = min(best, np.linalg.slogdet(scatter)[1])
    assert got.log_det <= best + 0.15 and abs(got.m_0) < 15 and abs(got.m_1) < 15 and got.rows == n


def test_quality_edges(spark):
    df = docs_of(spark, EDGES).withColumn("lang", F.when(F.col("doc_id") > 3, "en")).withColumn("source", F.lit(None).cast("string"))
    got = quality_rules.judge(df).collect()
    assert len(got) == len(EDGES) and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.judge(df.limit(0)).count() == 0
    assert abs(quality_rules.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality_rules.consistency(0.5, 2) - 3.2589) < 0.01


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_licenses_against_brute_force(spark, documents):
    rng = random.Random(11)
    vocabulary = ["cc", "by", "MIT", "license", "gnu", "general", "public", "apache", "x", "Kit", "é"]
    rows = documents[:100] + [(7000 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(100)] + [(8000 + k, t) for k, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    for i, t in rows:
        ws = ALNUM.findall((t or "").translate(LOW))
        want = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(ws) and [(s["first"], s["label"]) for s in got[i].spans if s["exact"]] == want


def test_notice_with_a_word_more_and_less(spark):
    notice = next(k for k, v in licenses.NOTICES.items() if v == "isc-notice").split()
    more, less, half = " ".join([*notice[:8], "gladly", *notice[8:]]), " ".join(notice[:5] + notice[6:]), " ".join(notice[: len(notice) // 2])
    got = {r.doc_id: [s["label"] for s in r.spans] for r in licenses.scan_licenses(docs_of(spark, [(1, "so: " + more), (2, less + " end"), (3, half), (4, " ".join(notice))])).collect()}
    assert got == {1: ["isc-notice"], 2: ["isc-notice"], 3: [], 4: ["isc-notice"]}
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def brute_notices(ws, coverage=0.7, band=3, stretch=1.5):
    """Votes by diagonal, clusters of neighbouring diagonals, shares: by the definition, without joins."""
    out = []
    for text, label in licenses.NOTICES.items():
        t = text.split()
        places: dict = {}
        for at, pair in enumerate(itertools.pairwise(ws)):
            for tpos, own in enumerate(itertools.pairwise(t)):
                if pair == own:
                    places.setdefault(at - tpos, []).append((at, tpos))
        clusters: list = []
        for diagonal in sorted(places):
            if clusters and diagonal - clusters[-1][0] <= band:
                clusters[-1] = (diagonal, clusters[-1][1] + places[diagonal])
            else:
                clusters.append((diagonal, places[diagonal]))
        for _, held in clusters:
            first, last, share = min(p for p, _ in held), max(p for p, _ in held) + 1, len({q for _, q in held}) / (len(t) - 1)
            if share >= coverage and last - first + 1 <= len(t) * stretch:
                out.append((first, last, label, round(share, 9)))
    return sorted(out)


def test_notices_against_brute_force(spark):
    rng = random.Random(12)
    notices = [k.split() for k in licenses.NOTICES]
    rows = []
    for i in range(80):
        ws = []
        for _ in range(rng.randrange(1, 4)):
            t = list(rng.choice(notices))
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(([], ["zap"], [t[at], t[at]])) + t[at + 1 :]
            ws += [rng.choice("xyz") for _ in range(rng.randrange(4))] + t
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: sorted((s["first"], s["last"], s["label"], round(s["share"], 9)) for s in r.spans if not s["exact"]) for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {i: brute_notices(t.split()) for i, t in rows} and sum(map(len, got.values())) > 60


def test_licenses_of_repeated_ids(spark):
    rows = [(1, "gnu general x"), (1, "x general public license"), (2, "mit license"), (2, "mit license"), (None, "cc by"), (None, "by cc"), (None, None)]
    got = sorted((r.doc_id or 0, r.n_words, [s["label"] for s in r.spans]) for r in licenses.scan_licenses(docs_of(spark, rows)).collect())
    assert got == [(0, 0, []), (0, 2, []), (0, 2, ["cc-by"]), (1, 3, []), (1, 4, []), (2, 2, ["mit"]), (2, 2, ["mit"])]


# --- 8 ------------------------------------------------------------------------------------------------------------------


def brute_removed(rows, length):
    seen = Counter(b[k : k + length] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, f in zip(b, cover, strict=True) if not f)
        out.append((i, len(b), sum(cover), sum(1 for k in range(len(b)) if cover[k] and (not k or not cover[k - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 50_000), (2, 50_000), (3, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    rng = random.Random(seed)
    base = "".join(rng.choice("abc de") for _ in range(400))
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randrange(1, 6)):
            kind, a = rng.randrange(3), rng.randrange(350)
            t += base[a : a + rng.randrange(10, 80)] if kind == 0 else "".join(rng.choice("abcé") for _ in range(rng.randrange(40))) if kind == 1 else rng.choice("ab") * rng.randrange(60)
        rows.append((i, t))
    rows += [(None, None), (500, ""), (501, rows[3][1]), (501, rows[3][1]), (501, rows[4][1])]
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs_of(spark, rows), length=40, key=12).collect()]
    assert sorted([(*g[:5], bytes(g[5])) for g in got], key=str) == sorted(brute_removed(rows, 40), key=str)
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_texts_meet_their_places_once(spark, monkeypatch):
    """With a key of very many stretches too, texts are exchanged for their contexts once, and parts that no other stretch has get no bytes."""
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", 3)
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, other = own(30), own(30)
    rows = [(i, own(60) + common + own(60)) for i in range(40)] + [(100 + i, own(50) + other + own(50)) for i in range(2)]
    made, landed = [], suffix_dedup.landed

    def noted(df, path=None):
        out = landed(df, path)
        made.append((df.columns, df._jdf.queryExecution().analyzed().toString().count("encode("), out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "landed", noted)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs_of(spark, rows), length=40, key=12).collect()]
    assert sorted([(*g[:5], bytes(g[5])) for g in got]) == sorted(brute_removed(rows, 40))
    joined = [columns for columns, texts, _ in made if texts and ("left" in columns or "marks" in columns)]
    assert len(joined) == 1 and [n for columns, _, n in made if "sub" in columns and "left" in columns] == [0]


def test_whole_table_at_the_query_s_length(spark, documents):
    rows = documents + [(90_000 + k, documents[k][1][:700] + "#" + documents[k + 1][1][-900:]) for k in range(40)]
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs_of(spark, rows), with_text=False).collect()]
    want = [r[:5] for r in brute_removed(rows, 400)]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 50_000


def test_maximal_repeats_need_no_neighbours():
    """The best partner on one side may be far away in the array."""
    rng = random.Random(5)
    for _ in range(200):
        ms = list({(bytes(rng.choice(b"ab") for _ in range(6)), b"K" + bytes(rng.choice(b"ab") for _ in range(6))) for _ in range(rng.randrange(2, 12))})
        got = suffix_dedup.repeats(ms, 8)

        def windows(pairs):
            return {(l - k) for l, r in pairs for k in range(l + r - 8 + 1)}  # noqa: E741

        for i, (a, b) in enumerate(ms):
            pairs = [(suffix_dedup.common_prefix(a[::-1], c[::-1]), suffix_dedup.common_prefix(b, d)) for j, (c, d) in enumerate(ms) if j != i]
            assert windows(got[i]) == windows([p for p in pairs if sum(p) >= 8])


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, long[5000:9000]), (3, long[20_000:]), (4, "x" * 3000)]
    monkeypatch.setattr(suffix_dedup, "PART", 7000)
    got = list(suffix_dedup._find_anchors(iter([__import__("pyarrow").RecordBatch.from_pydict({"did": [1], "th": [1], "raw": [long.encode()]})]), 400, 120))
    assert len({p for b in got for p in b.column("pos").to_pylist()}) > 100 and max(p for b in got for p in b.column("pos").to_pylist()) < 30_000
    monkeypatch.undo()
    out = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs_of(spark, rows), with_text=False).collect()]
    assert sorted(out) == sorted(r[:5] for r in brute_removed(rows, 400))


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_word_ids_equal_the_tokenizers(documents):
    e = packing.WordEncoder(packing.tokenizer_path(), size=2000)  # small: entries come and go
    odd = ["It's a. TEST'. don't!! x_y--z  '' a'. Ünï.", "", "\x1c a b", "ΣΑΣ. σ", "İstanbul", "á b.", "１２３ 4５6 ½.", "👍👍. 日本語。 foo", "<|startoftext|> hi <|endoftext|>.", "it's'. 's.'s", "ǅ ẞ. K", "a b c\u0085d"]
    for t in [t for _, t in documents] + odd:
        assert e.encode(t)[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        ends = np.cumsum([rng.randrange(1, 30) for _ in range(rng.randrange(1, 8))])
        sentences = np.array(sorted({rng.randrange(1, int(ends[-1]) + 1) for _ in range(5)}))
        cost = dict.fromkeys(range(4, int(ends[-1]), 4), 6) | dict.fromkeys(sentences.tolist(), 2) | dict.fromkeys(ends.tolist(), 0)
        pad = lambda n: 0 if n in (16, 8, 4) else 16 - n
        best = {0: 0}
        for j in sorted(cost):
            best[j] = min(best[i] + pad(j - i) for i in best if j - i <= 16) + cost[j]
        cuts = packing.plan_cuts(ends, sentences, limit=16, sentence_cut=2, word_cut=6, grid=4)
        assert cuts[-1] == ends[-1] and sum(pad(b - a) + cost[b] for a, b in itertools.pairwise([0, *cuts])) == best[int(ends[-1])]


def test_pieces_hold_every_token_once(spark, documents):
    rows = documents + [(i, t) for i, t in EDGES if i not in (5, None)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = packing.pack(docs_of(spark, rows).repartition(3)).collect()
    e = packing.WordEncoder(packing.tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for i, t in rows:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = [*e.plain(t or "").tolist(), 2]
        assert [x for p in pieces for x in p.ids] == ids and {p.doc_tokens for p in pieces} == {len(ids)} and [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1])
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(p.length for p in pieces)
        assert n <= 4096 and [p.offset for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1])
        padding, total = padding + (0 if n & (n - 1) == 0 else 4096 - n), total + n
    assert padding < 0.02 * total
    assert packing.pack(docs_of(spark, [])).count() == 0 and packing.pack(docs_of(spark, EDGES), with_ids=False).count() >= len(EDGES)


# --- 10 -----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "x" * 2000 + "é", "y" * 999
    rows = [(1, "http://a/%\n", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "v", other), (5, "v", other), (6, "w", None), (None, "n", big), (7, "z", "a\r\n\r\nContent-Length: 3\r\n\r\nb")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, digest int, frame string")
    folder = str(tmp_path / "bundles")
    index = warc.write_archives(df.repartition(2), folder, frame_bytes=3000, bundle_bytes=1 << 20)
    back = warc.read_archives(index, folder).collect()
    assert len(back) == len(rows)
    for r in back:
        given = next(x for x in rows if str(x[0] if x[0] is not None else "null") == r.record_id)
        body = (given[2] or "").encode()
        revisit = given[2] == big and given[0] != 3
        assert (r.record_type, r.refers_to) == (("revisit", "3") if revisit else ("response", None))
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest() and r.url == given[1]
        assert r.payload is None if revisit else bytes(r.payload) == body
    for name in os.listdir(folder):
        if name.endswith(".warc.zst"):  # any Zstandard reader gets the records: the seek table is a frame to skip
            with open(f"{folder}/{name}", "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as s:
                assert s.read().count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == name).count()
    empty = warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and warc.read_archives(empty, str(tmp_path / "none")).count() == 0


def test_damage_is_noticed():
    raw = warc.build_record("1", "u", "response", None, hashlib.sha1(b"abc").hexdigest(), b"abc", "1970-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"abc", b"abd"))
