"""Parity-sketch join, turn trie and whitening against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from strata3d.llm import parityjoin, turntrie, whitening

from .test_dedup import plain_components, say


# --- parity-sketch join -------------------------------------------------------------------

def grams(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def family(rng, n, edits):
    words = say(rng, n).split()
    out = []
    for k in edits:
        copy = list(words)
        for i in rng.sample(range(len(copy)), min(k, len(copy))):
            copy[i] += "x"
        out.append(" ".join(copy))
    return out


def expected_join(rows, rule):
    sets = [grams(t, rule.words) for _, t in rows]
    top = plain_components(range(len(rows)), [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if sets[i] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j])])
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top[i]].append(d)
    return sorted((str(d), len(sets[i]), str(d if not sets[i] else min(ids[top[i]], default=None)))
                  for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(31)
    texts = [t for n in (4, 5, 8, 9, 12, 20, 40, 90, 200) for _ in range(5)
             for t in family(rng, n, (0, 0, 1, 1, 2, 3, 5))]
    passage = say(rng, 60)
    texts += [f"{say(rng, 30)} {passage} {say(rng, 20 + i)}" for i in range(12)]
    texts += [f"{passage} {say(rng, 2)}" for _ in range(20)]
    long_ = family(rng, 6000, (0, 40, 80, 120, 500))
    rows = [(i, t) for i, t in enumerate(texts + long_)]
    rng.shuffle(rows)
    return [*rows, (900, None), (901, ""), (902, " \t"), (903, "One word"), (904, "one WORD"),
            (None, texts[0]), (None, "alone here now and never seen"), rows[0], rows[0]]


@pytest.mark.parametrize("dense,block", [(parityjoin.DENSE, parityjoin.BLOCK), (9, 3)])
def test_join_equals_all_pairs(spark, mixed, monkeypatch, dense, block):
    monkeypatch.setattr(parityjoin, "DENSE", dense)
    monkeypatch.setattr(parityjoin, "BLOCK", block)
    docs = spark.createDataFrame([(*r, 1, 2) for r in mixed], "doc_id long, text string, node int, n int")
    got = parityjoin.joined(docs).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == expected_join(mixed, parityjoin.JOIN)
    assert parityjoin.joined(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", [parityjoin.JOIN, parityjoin.Rule(5, 80, 100), parityjoin.Rule(1, 1, 2)])
def test_sets_within_the_budget_share_a_key(rule):
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 500, 3000]:
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for grow in range(0, rule.budget(n) + 1, max(1, rule.budget(n) // 4)):
            lost = min((rule.budget(n) - grow), n)
            y = np.unique(np.append(rng.permutation(x)[lost:], rng.integers(0, 1 << 63, grow).astype(np.uint64)))
            small, large = sorted((x, y), key=len)
            if rule.linked(x, y) and len(np.setxor1d(x, y)):
                assert set(parityjoin.keys(small, rule)) & set(parityjoin.keys(large, rule)), (n, grow)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (60, 70), (64, 65), (100, 900), (5000, 5100)):
        x, y = (np.unique(rng.integers(0, 4 * n, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        assert parityjoin.differing(parityjoin.sketch(x), parityjoin.sketch(y)) <= len(np.setxor1d(x, y))
        assert parityjoin.differing(parityjoin.sketch(x), parityjoin.sketch(x)) == 0


# --- turn trie ----------------------------------------------------------------------------

def plain_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            k = f"{len(role or '')}:{role or ''}{text or ''}"
            own[c].append(((turn is not None, turn), hashlib.md5(k.encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    member = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            member[ts[:d]].append(c)
    kids = defaultdict(int)
    for p in member:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, of in member.items():
        words = len(p[-1][1].split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(of) - 1) * words
    return sorted((min(of), len(p), min(member[p[:-1]]) if p else -1, len(of), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(of) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, of in member.items())


@pytest.mark.parametrize("shard,piece", [(turntrie.SHARD, turntrie.PIECE), (3, 40), (1, 20)])
def test_trie_equals_plain_nodes(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(turntrie, "SHARD", shard)
    monkeypatch.setattr(turntrie, "PIECE", piece)
    rng = random.Random(41)
    rows = []
    for c in range(400):
        common = rng.random() < 0.5
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", None, "bot"]) if not common else "user",
                         f"turn {t} said" if common or rng.random() < 0.6 else rng.choice([None, "", "a b", say(rng, 5)])))
    rows += [(1000, None, "user", "first"), (1000, 1, "user", "x"), (1000, 1, "user", "x"), (1001, 2, "a", "b"),
             (None, 1, "user", "nobody"), (1003, None, None, None), (1021, 0, "u", "long " * 5000)]
    rows += [(1040, t, "user", f"deep {t}") for t in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, key string, words int")
    got = sorted(tuple(-1 if x is None else x for x in r)
                 for r in turntrie.nodes(turntrie.rebuilt(df)).select(*turntrie.RESULT).collect())
    assert got == plain_nodes(rows)
    assert turntrie.nodes(turntrie.rebuilt(df.limit(0))).count() == 0


def test_double_array_holds_its_paths_alone():
    rng = random.Random(42)
    alphabet = [hashlib.md5(str(i).encode()).digest() for i in range(30)]
    paths = sorted({b"".join(rng.choices(alphabet, k=rng.randrange(6))) for _ in range(500)})
    trie, levels = turntrie.pack(paths)
    slot = np.zeros(len(paths), np.int64)
    for d, code in enumerate(levels):
        at = np.flatnonzero(code >= 0)
        slot[at] = trie.step(slot[at], code[at])
        assert (slot[at] > 0).all()
    assert len(set(slot.tolist())) == len(paths)
    prefixes = {p[:d] for p in paths for d in range(0, len(p) + 1, turntrie.WIDTH)}
    assert (trie.check >= 0).sum() == len(prefixes)
    assert (trie.step(np.zeros(1, np.int64), np.array([10 ** 6])) == -1).all()


# --- whitening ----------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 9, 20, 40, 62])
def test_planes_give_exact_products(bits):
    rng = np.random.default_rng(5)
    u = rng.integers(0, 1 << bits, (131, 4)).astype(np.uint64)
    want = u.astype(object).T @ u.astype(object)
    got = whitening.products(u, bits)
    assert all(got[i, j] == want[i, j] for i in range(4) for j in range(i, 4))


def test_whitening_equals_plain_covariance(spark):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) @ mix]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(150)] + [(None, rows[8][1]), (7, rows[7][1])]
    bad = [(500, None), (501, [1.0] * 5 + [None]), (502, [1.0] * 5 + [float("nan")]), (503, [float("inf")] * 6),
           (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<float>, x int")
    got = whitening.whitened(df).toPandas()
    x = {v: np.floor(256 * np.array(e)).astype(int) for v, e in rows}
    once = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(once), once.sum(axis=0)
    v = np.cov(once.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(v)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    for c in range(1, 5):
        mine = got[got["component"] == c].dropna(subset="vec_id")
        want = np.array([(x[i] - s / n) @ vectors[:, -c] / np.sqrt(values[-c]) for i in mine["vec_id"].astype(int)])
        sign = np.sign(want @ mine["whitened"])
        assert np.allclose(mine["whitened"], sign * want, atol=1e-9)
        assert np.allclose(mine["explained"], values[-c] / np.trace(v), rtol=1e-9)
        assert mine["deviation"].tolist() == [int(((n * x[i] - s) ** 2).sum()) for i in mine["vec_id"].astype(int)]
    assert got["identity_error"].max() < 1e-9
    assert whitening.whitened(df.limit(0)).count() == 0


def test_whitening_of_equal_and_of_huge_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(one).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0
                                 and r["identity_error"] is None for r in got)
    far = spark.createDataFrame([(i, [i * 1e9, float(i % 3), 1.0]) for i in range(200)],
                                "vec_id long, embedding array<double>")
    got = whitening.whitened(far, 2).toPandas()
    assert len(got) == 400 and got["deviation"].isna().any() and (got["identity_error"] < 1e-4).all()
    n, total = 200, sum(i * 256 * 10 ** 9 for i in range(200))
    exact = {r["vec_id"]: int(r["deviation_exact"]) for _, r in got.iterrows()}
    rest = [[(i % 3) * 256, 256] for i in range(200)]
    s = np.sum(rest, axis=0).tolist()
    assert exact == {i: (n * i * 256 * 10 ** 9 - total) ** 2 + sum((n * a - b) ** 2 for a, b in zip(rest[i], s))
                     for i in range(200)}
