"""Problems 3, 4, 7, 8 and 9: brute force, round trips, and the edge cases their docstrings define."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm.groups import hash_to_min
from ledgerweave.llm.leaks import Strings, find_leaks, words_of
from ledgerweave.llm.neighbours import DIMS, MARGIN, Cells, chi2_quantile, projection, round_rows, search_cell, similar_pairs, slack, unit_rows
from ledgerweave.llm.stuffed import LABELS, PRIOR_CHAIN, Chain, find_stuffed, stuffed_share
from ledgerweave.llm.tokens import TOKENIZER_DIR, Prefixes, Vocabulary, encode_texts, read_ranks


def brute_groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_groups(spark, kind):
    rng = random.Random(1)
    pairs = {
        "random": [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(None, 1), (200, None), (7, 7), (300, 300)],
        "chain": [(i + 1, i) for i in range(70)] + [(3, 4), (4, 3)],
        "star": [(500, i) for i in range(1500)],
        "empty": [],
    }[kind]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("v", F.lit(1)).withColumn("u", F.lit(2))
    assert {r.v: r.group_id for r in hash_to_min(df, "a", "b").collect()} == brute_groups(pairs)


def vectors(rng, n, width=40):
    x = rng.standard_normal((n, width))
    for i in range(0, n, 7):  # groups of near copies
        for j in range(1, rng.integers(1, 7)):
            if i + j < n:
                x[i + j] = x[i] + 0.15 * rng.standard_normal(width)
    return x


def brute_pairs(x, keys, k, floor):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        c = [(-round(s[i, j], 9), keys[j]) for j in range(len(x)) if j != i and s[i, j] >= floor and np.any(x[i]) and np.any(x[j])]
        out |= {(min(keys[i], b), max(keys[i], b)) for _, b in sorted(c)[:k]}
    return out


def test_chi_square():
    assert abs(chi2_quantile(0.95, 2) - 5.991) < 1e-3 and abs(chi2_quantile(0.999, 12) - 32.909) < 1e-3


def test_cell_search_matches_brute_force():
    x = vectors(np.random.default_rng(2), 1500)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b, _ = search_cell(u, u @ projection(40, DIMS), 5, 0.95, chi2_quantile(0.999, DIMS), leaf=64)
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    want = brute_pairs(x, list(range(1500)), 5, 0.95)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_a_clump_is_searched_in_bounded_time():
    import time

    rng = np.random.default_rng(7)
    for spread in (1e-5, 0.02):
        u, _ = unit_rows(round_rows(rng.standard_normal((1, 165)) + spread * rng.standard_normal((20_000, 165))))
        began = time.time()
        a, b, s = search_cell(u, u @ projection(165)[:, :DIMS], 5, 0.95, chi2_quantile(0.999, DIMS))
        assert time.time() - began < 60 and len(a) == 5 * 20_000 and (s >= 0.95).all()
    few = rng.choice(20_000, 50, replace=False)
    sims = u[few] @ u.T
    sims[np.arange(50), few] = -1
    best = {i: set(np.argsort(-r)[:5].tolist()) for i, r in zip(few.tolist(), sims)}
    mates = {i: set(b[a == i].tolist()) for i in best}
    assert sum(len(best[i] & mates[i]) for i in best) >= 0.97 * 250


def test_a_thousand_cells_keep_the_recall():
    rng = np.random.default_rng(8)
    x = vectors(rng, 40_000, 165)
    u, _ = unit_rows(round_rows(x))
    p = u @ projection(165)
    cells = Cells(p[::2], 2.0, 120, MARGIN * 0.1**0.5)
    rows, task, side = cells.assign(p, np.arange(len(p)))
    assert len(cells.blocks) >= 1000 and (side == 2).mean() > 0.5
    got = set()
    order = np.argsort(task, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
        r = rows[at]
        a, b, _ = search_cell(u[r], p[r][:, :DIMS], 5, 0.95, chi2_quantile(0.999, DIMS), side=side[at] if (side[at] < 2).any() else None)
        got |= set(zip(np.minimum(r[a], r[b]).tolist(), np.maximum(r[a], r[b]).tolist()))
    want = set()
    for i in range(0, len(u), 2000):
        a, b = np.nonzero(u[i : i + 2000] @ u.T >= 0.95)
        want |= {(int(m), int(n)) for m, n in zip(a + i, b) if m < n}
    assert len(want) > 10_000 and len(got & want) >= 0.97 * len(want)


def test_rounding_error_is_bounded():
    rng = np.random.default_rng(9)
    x = vectors(rng, 400, 165) * 10 ** rng.uniform(-3, 3, (400, 1))
    x[7], x[8] = 1e-12, 0.0
    x[8, 3] = 1e-310
    x[9, 1:] *= 1e-6
    u, turned = unit_rows(round_rows(x))
    true = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
    true = np.nan_to_num(true)
    s = true @ true.T
    assert (np.abs(u.astype(float) @ u.T.astype(float) - s)[:8, :8] <= slack(np.clip(s, -1, 1), turned[:, None] + turned[None, :])[:8, :8]).all()


def test_a_clump_larger_than_a_task_is_cut_into_blocks(spark):
    rng = np.random.default_rng(10)
    x = np.ones((500, 12)) + 0.01 * rng.standard_normal((500, 12))
    cols = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame([(i, 1, *r.tolist()) for i, r in enumerate(x)], "id long, ver int, " + ", ".join(f"{c} double" for c in cols))
    got = {tuple(r) for r in similar_pairs(df, "id", cols, "ver", -50.0, 50.0, cell_nodes=100).collect()}
    want = brute_pairs(x, list(range(500)), 5, 0.95)
    assert Cells(unit_rows(round_rows(x))[0] @ projection(12), 1.0, 100, MARGIN * 0.1**0.5).blocks == [10]
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("cell_nodes", [10_000, 120])
def test_similar_pairs(spark, cell_nodes):
    rng = np.random.default_rng(3)
    x = vectors(rng, 600, 12)
    x[50:70] = x[50]  # 20 equal vectors
    x[80] = 0
    x[90, 3] = 5000.0  # out of range: counts as 0
    clean = np.where(np.abs(x) > 50, 0, x)
    keys = [1000 + i for i in range(600)]
    rows = [(keys[i], 2, *x[i].tolist()) for i in range(600)]
    rows += [(keys[i], 1, *x[0].tolist()) for i in range(0, 600, 5)]  # earlier versions
    rows += [rows[3], rows[60], (keys[81], 3, *[None] * 12), (None, 9, *x[5].tolist())]
    clean[81] = 0
    rows[10] = (rows[10][0], 2, float("nan"), *rows[10][3:])
    clean[10, 0] = 0
    cols = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame(rows, "id long, ver int, " + ", ".join(f"{c} double" for c in cols)).withColumn("bits", F.lit(1)).withColumn("vec", F.lit("x")).withColumn("h", F.lit(0))
    got = {tuple(r) for r in similar_pairs(df, "id", cols, "ver", -50.0, 50.0, cell_nodes=cell_nodes).collect()}
    want = brute_pairs(clean, keys, 5, 0.95)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    copies = {p for p in want if all(1050 <= q < 1070 for q in p)}
    assert len(copies) == 5 * 20 - 15 and copies <= got
    assert similar_pairs(df.limit(0), "id", cols, "ver", -50.0, 50.0).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


TEXTS = ["", " ", "Hello world", "<|endoftext|>", "кошелёк 0x12ab", "a" * 5000, "日本語 🚨 x", "\n\n  it's 12,345.67\t!", "ab" * 3000]


def test_tokens_match_library_and_round_trip(ranks):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    v = Vocabulary(ranks)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab тк 1.'\n") for _ in range(80)) for _ in range(100)]
    for x in texts:
        ids = v.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert b"".join(v.bytes_of[i] for i in ids).decode() == x


def test_appends_and_edits_are_exact(ranks):
    v, rng = Vocabulary(ranks), random.Random(5)
    for _ in range(40):
        p = Prefixes(v, "The wallet received 12 BTC, it's gone.  Really\n gone " * 3)
        for _ in range(4):
            a = rng.randint(0, len(p.text))
            p.edit(a, min(len(p.text), a + rng.randint(0, 9)), rng.choice(["", " x", "'s", "\n", "  ", "zz9"]))
            p.append(rng.choice([" end", "s", " ", "\n7"]))
            assert p.ids() == v.encode(p.text)
    last = []
    v.extend(b" received", last, 0)
    v.extend(b" received funds"[:9] + b" more", last, 9)
    assert len(last) == 14


def test_encode_table(spark, ranks):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = encode_texts(df, "doc_id", "text", ranks).collect()
    v = Vocabulary(ranks)
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted([(i, v.encode(t)) for i, t in enumerate(TEXTS)] + [(99, []), (0, [])])
    assert encode_texts(df.limit(0), "doc_id", "text", ranks).count() == 0


def brute_leak(doc, item, n=13):
    d, w = words_of(doc), words_of(item)
    n = min(n, len(w))
    grams = {tuple(d[i : i + n]) for i in range(len(d) - n + 1)}
    return bool(n) and any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))


def test_leaks_match_brute_force():
    rng = random.Random(6)
    word = lambda: rng.choice("aa bb cc dd ee".split())
    for _ in range(150):
        items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 7])))) for i in range(5)]
        doc = " ".join(word() for _ in range(rng.randint(0, 40)))
        assert Strings(items, 4).search(doc) == {i for i, t in items if brute_leak(doc, t, 4)}


def test_leak_table(spark):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen Ёлка"
    items = [(1, q), (2, "short item here"), (3, None), (4, "  "), (1, q), (None, q), (5, q.upper())]
    docs = [
        (10, "x " + q.replace("two", "tw​o").upper()), (11, q.replace("seven", "7")), (12, "a SHORT, item: here!"), (13, None), (14, ""), (15, "y " * 50_000 + q[:80]), (10, "x " + q), (16, " ".join(q.split()[1:]).replace("Ё", "Е")),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect())
    want = sorted({(a, b) for a, t in docs for b, s in items if b is not None and t and brute_leak(t, s)})
    assert got == want and (10, 1) in got and (12, 2) in got and (16, 5) in got and (11, 1) not in got
    import ledgerweave.llm.leaks as leaks

    whole, leaks.ITEMS_PER_PART = leaks.ITEMS_PER_PART, 2  # several parts give the same
    assert sorted(tuple(r) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()) == want
    leaks.ITEMS_PER_PART = whole
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


PROSE = "The reviewer in Norvia preferred to wait, as the burst faded within a day. Payments in ether rose during the week, according to the exchange. "
SPAM = [
    "mining rig buy, gift card online, vpn deal top, otc desk cheap, seed phrase free, airdrop 2025, " * 8,
    "\n".join(f"fast escrow https://a{i}.example/x/y{i}" for i in range(30)),
    " ".join(f"#no_kyc_{i} #airdrop" for i in range(40)),
    "Mining rig, cheap mining rig, mining rig online: best mining rig. Gift card, top gift card, gift card free! " * 6,
    "\n".join(["otc desk", "gift card", "mining rig"] * 30),
    "\n".join(f"gift card / best / ${i}.99 SKU{10000 + i}" for i in range(30)),
]
FINE = [
    PROSE * 5, PROSE * 3 + "\nSources:\n[1] https://a.example/b\n[2] https://c.example/d", PROSE * 3 + "\n#gift_card #otc_desk #airdrop",
    "score=0.51\ntier=tier3\nanchor1: wallet=bc1qgzyk0da53xpcxctdtw source=eu_fsf distance=7.2\nshap: feat_116=0.28\nshap: feat_105=1.00\n" + PROSE,
    "\n".join(f"1{i}:05 The hash receipt lists 82 items, and 3 of them carry no timestamp." for i in range(9)),
    "\n".join(f"- [the case file](https://a{i}.example/x/y) - The account received the funds and it was closed by the exchange {i}." for i in range(9)), None, "", "  \n ",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam_is_flagged(text):
    assert stuffed_share(text) > 0.5 and stuffed_share(text.upper()) > 0.5 and stuffed_share(PROSE + "\n" + text) > 0.5


@pytest.mark.parametrize("text", FINE)
def test_prose_and_records_are_not(text):
    assert stuffed_share(text) <= 0.5


def test_baum_welch_raises_the_likelihood_and_finds_the_model():
    rng = np.random.default_rng(3)
    true = Chain(np.array([0.6, 0.1, 0.1, 0.1, 0.1]), 0.9 * np.eye(5) + 0.02 * np.ones((5, 5)), PRIOR_CHAIN.emit**2 / (PRIOR_CHAIN.emit**2).sum(1, keepdims=True))
    texts, labels = [], []
    for _ in range(150):
        s = rng.choice(5, p=true.start)
        signs, own = [], []
        for _ in range(40):
            own.append(int(s))
            signs.append(int(rng.choice(10, p=true.emit[s])))
            s = rng.choice(5, p=true.move[s] / true.move[s].sum())
        texts.append(signs)
        labels.append(own)
    score = lambda m: sum(np.log(m._forward(t)[1]).sum() for t in texts)
    models = [PRIOR_CHAIN.fitted(texts, weight=1.0, rounds=k) for k in (0, 1, 3, 6)]
    assert all(score(a) < score(b) for a, b in zip(models, models[1:]))
    assert np.abs(models[-1].emit - true.emit).max() < 0.12
    right = np.mean([a == b for t, own in zip(texts, labels) for a, b in zip(models[-1].label(t), own)])
    assert right > 0.9 and PRIOR_CHAIN.fitted([]) is PRIOR_CHAIN and len(LABELS) == 5


def test_stuffed_table(spark):
    df = spark.createDataFrame([*enumerate(SPAM + FINE), (0, SPAM[0]), (None, SPAM[0]), (77, "gift card, " * 60_000)], "doc_id long, text string").withColumn("words", F.lit(1))
    assert sorted(r.doc_id for r in find_stuffed(df, "doc_id", "text").collect()) == [*range(len(SPAM)), 77]
    assert find_stuffed(df.limit(0), "doc_id", "text").count() == 0


def test_expected_counts_match_all_paths(monkeypatch):
    from itertools import product

    import ledgerweave.llm.stuffed as stuffed

    chains, want = {bytes([0]): 3, bytes([9, 7]): 1, bytes([2, 8, 9, 0]): 2, b"": 4, bytes([6, 6, 4]): 5}, np.zeros(PRIOR_CHAIN.table().shape)
    for c, times in chains.items():
        paths = list(product(range(len(LABELS)), repeat=len(c))) if c else []
        odds = [np.prod([PRIOR_CHAIN.start[p[0]], *PRIOR_CHAIN.emit[list(p), list(c)], *PRIOR_CHAIN.move[list(p[:-1]), list(p[1:])]]) for p in paths]
        for p, x in zip(paths, np.array(odds) / sum(odds) * times if paths else []):
            want[p[0], 0] += x
            for i, j in zip(p, p[1:]):
                want[i, 1 + j] += x
            for i, o in zip(p, c):
                want[i, 1 + len(LABELS) + o] += x
    for units in (1, 6, 1 << 18):
        monkeypatch.setattr(stuffed, "BLOCK_UNITS", units)
        assert np.abs(PRIOR_CHAIN.expected(chains) - want).max() < 1e-12


@pytest.mark.parametrize("kind", ["keys", "long"])
def test_the_model_is_fitted_on_all_texts(spark, kind):
    """Two short units are a menu by the prior; pages of sentences with short units between them say otherwise, whatever their keys and lengths."""
    probe = (-1, "Alpha beta\nGamma delta")
    if kind == "keys":  # as many texts as were drawn twice over, of which those that were not drawn say it
        keys = spark.range(4_000).select("id", (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)) == 0).alias("drawn")).collect()
        rows = [(r.id, "" if r.drawn else f"{PROSE}\n{r.id}\n" * 10) for r in keys]
    else:
        rows = [(i, "\n".join(f"{PROSE}\n{j}" for j in range(1_100))) for i in range(40)]
    assert stuffed_share(probe[1]) == 1.0
    df = spark.createDataFrame([probe, *rows], "doc_id long, text string")
    assert find_stuffed(df, "doc_id", "text").count() == 0
    assert find_stuffed(df.repartition(7, "text").withColumnRenamed("doc_id", "signs"), "signs", "text").count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p7_ids", "p8_found", "p9_found"])
def test_queries_run(spark, sf, name):
    from ledgerweave.llm.queries import QUERIES

    assert QUERIES[name](spark, sf).count() > 0
