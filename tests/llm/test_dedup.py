"""Substring, line and near-copy dedup and host rules against plain versions."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata3d.llm import components, hostrules, linetemplates, simhash, substrings

SPACE = r"[\x20\x09-\x0D]"


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
                    for _ in range(n))


# --- substrings ---------------------------------------------------------------------------

def test_chunks_cover_the_text_and_ignore_the_batch():
    rng = random.Random(1)
    texts = [say(rng, 200), None, "", "short", "aaaa" * 200, say(rng, 50)]
    row, start, stop, digest = substrings.chunks(texts)
    for i, t in enumerate(texts):
        mine = row == i
        assert "".join((t or "")[a:b] for a, b in zip(start[mine], stop[mine])) == (t or "")
        alone = substrings.chunks([t])
        assert (alone[3] == digest[mine]).all() and (alone[1] == start[mine]).all()


def test_cuts_are_the_strict_least_hash_nearby():
    rng = random.Random(2)
    text = say(rng, 80)
    h = [sum(int(substrings.GEAR[(ord(text[i - k]) ^ ord(text[i - k]) >> 10) & 1023]) << 2 * k
             for k in range(min(i + 1, substrings.MEMORY))) % 2 ** 32 for i in range(len(text))]
    reach = substrings.REACH
    want = [i + 1 for i in range(len(text)) if i + 1 == len(text) or all(
        h[i] < h[j] for j in range(max(0, i - reach), min(len(h), i + reach + 1)) if j != i)]
    assert substrings.chunks([text])[2].tolist() == want


def test_a_shared_passage_stays_once(spark):
    rng = random.Random(3)
    passage = say(rng, 60)
    rows = [(i, say(rng, 30) + " " + passage + " " + say(rng, 25) if i in (4, 9, 17) else say(rng, 70)) for i in range(20)]
    rows += [(30, None), (31, ""), (None, passage + say(rng, 5)), (4, rows[4][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone int")
    got = substrings.deduplicated(docs).collect()
    assert len(got) == len(rows)
    middle = passage[100:-100]
    for r in got:
        text = dict(rows)[r["doc_id"]]
        if r["doc_id"] in (9, 17, None):
            assert middle not in r["text"] and r["n_cut"] > len(passage) // 2
            cut = r["cut_spans"]
            assert substrings.without(text, list(zip(cut[::2], cut[1::2]))) == r["text"]
        else:
            assert r["text"] == text and r["n_cut"] == 0
    assert substrings.deduplicated(docs.limit(0)).count() == 0


# --- lines --------------------------------------------------------------------------------

def test_recurring_templates_go_from_all_but_one(spark):
    rng = random.Random(4)
    own = [say(rng, 12) for _ in range(9)]
    rows = [(i, f"{own[i]}\nPage {i} of 10 printed\nthe same eight word line closes each text here") for i in range(6)]
    rows[5] = (5, own[5] + "\nthe same eight word line ends each text here\nthe same eight word line closes each text here")
    rows += [(6, own[6] + "\nthe\nthe"), (7, None), (8, ""), (None, own[7]), (9, "   \n"), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lines string")
    got = linetemplates.cleaned(docs, "rest", "gone").collect()
    assert len(got) == len(rows) and docs.columns == linetemplates.cleaned(docs, "rest", "gone").columns[:3]
    by = {r["doc_id"]: r for r in got}
    pages = [i for i in range(5) if "Page" in by[i]["rest"]]
    assert len(pages) == 1
    kept = [i for i in range(6) if "closes" in by[i]["rest"]]
    assert len(kept) == 1
    assert all(own[i] in by[i]["rest"] for i in range(6))
    assert 1 in by[5]["gone"] or 5 in kept                    # one block differs: same template
    for i in (6, 7, 8, 9, None):
        assert by[i]["rest"] == dict(rows)[i] and by[i]["gone"] is None
    assert linetemplates.cleaned(docs.limit(0), "rest", "gone").count() == 0


def test_two_documents_do_not_make_a_template(spark):
    docs = spark.createDataFrame([(1, "one line of text here"), (2, "one line of text here")], "doc_id long, text string")
    assert linetemplates.dropped(docs).count() == 0
    assert linetemplates.dropped(docs, 2).count() == 1


def test_long_lines_of_two_documents_and_short_ones_of_many(spark):
    rng = random.Random(14)
    shared, numbered = say(rng, 60), "in the year {} all of it came to an end"
    texts = [f"{say(rng, 12)}\n{shared if i < 2 else say(rng, 9)}\n{numbered.format(i) if i in (4, 5) else ''}\nRead more"
             + ("\nwhy 3" if i < 5 else "") for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rest = [r["rest"] for r in linetemplates.cleaned(docs, "rest", "gone").collect()]
    assert sum(shared in t for t in rest) == 1
    assert sum("Read more" in t for t in rest) == 1
    assert sum("why 3" in t for t in rest) == 5 and sum("in the year" in t for t in rest) == 2


# --- components and SimHash ---------------------------------------------------------------

def plain_components(nodes, links):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (0, 1)]
    got = {r["node"]: r["root"] for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius, width", [(2, 64), (2, 32), (2, 16), (5, 64), (5, 32), (3, 48)])
def test_covering_leaves_out_any_bits(radius, width):
    rng, bits = random.Random(radius), tuple(range(64 - width, 64))
    masks = simhash.covering(bits, radius)
    assert all(masks) and len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        gone = sum(1 << b for b in rng.sample(bits, radius))
        assert any(not m & gone for m in masks)


def test_links_of_crowded_values_are_whole(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(150)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_components(signed, [(a, b) for a, b in combinations(signed, 2)
                                     if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2])
    for crowded in (2_000, 8):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        found = [(r["a"], r["b"]) for r in simhash.links(fps).collect()]
        assert plain_components(signed, found) == want


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        if i % 3 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] += rng.choice(["", "x", "\t"])
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, say(rng, rng.choice([2, 3, 40, 300])).replace("a", "É")))
    rows += [(200, None), (201, ""), (202, " \n"), (5, rows[5][1]), (None, rows[7][1]), (203, "UPPER Case É"), (204, "upper case É")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    fp = [plain_fingerprint(t) for _, t in rows]
    top = plain_components(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2)
                                              if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {r: min((d for k, (d, _) in enumerate(rows) if top[k] == r and d is not None), default=None)
             for r in set(top.values())}
    want = sorted((str(d), format(fp[k], "016x"), least[top[k]]) for k, (d, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_copies_keep_one_of_each_group(spark):
    rng = random.Random(8)
    base = [say(rng, 300) for _ in range(6)]
    rows = [(i, base[i % 6] if i < 18 else base[i % 6] + " and one more") for i in range(30)]
    rows += [(50 + i, say(rng, 80)) for i in range(10)] + [(90, None), (91, ""), (None, base[0]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    gone = {r["row"] for r in simhash.copies(docs).collect()}
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()
    kept = sorted(str(r["doc_id"]) for r in keyed if r["key"] not in gone)
    assert kept == sorted(map(str, [0, 1, 2, 3, 3, 4, 5, *range(50, 60), 90]))


def shingle_sets(texts):
    return [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def dropped_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = {r["key"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    return {keyed[r["row"]] for r in simhash.copies(docs).collect()}


def expected_copies(texts):
    sets = shingle_sets(texts)
    top = plain_components(range(len(texts)), [
        (i, j) for i, j in combinations(range(len(texts)), 2)
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    return {i for i in top if i != min(j for j in top if top[j] == top[i])}


def test_copies_are_found_past_what_links_their_fingerprints(spark):
    """Families of near and farther copies: links of fingerprints through others are no proof."""
    rng = random.Random(21)
    texts = []
    for _ in range(25):
        words = say(rng, 200).split()
        for k in (0, 1, 3, 4, 6, 9, 12):
            copy = list(words)
            for i in rng.sample(range(len(copy)), k):
                copy[i] += "x"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    assert dropped_copies(spark, texts) == expected_copies(texts)


def test_copies_among_texts_of_one_fingerprint(spark):
    """One word pair is over half of each text, so that all have one fingerprint."""
    rng = random.Random(22)
    texts = []
    for _ in range(8):
        words = say(rng, 60).split()
        for k in (0, 1):
            texts.append("same word " * 200 + " ".join(words[:60 - k]))
    assert len({plain_fingerprint(" ".join(t.split()[:300])) for t in texts}) == 1
    assert dropped_copies(spark, texts) == expected_copies(texts) == set(range(1, 16, 2))


def test_copies_of_long_texts_at_the_least_similarity(spark):
    rng = random.Random(23)
    texts = []
    for i in range(24):
        words = say(rng, 1200).split()
        changed = list(words)
        for at in range(10, 10 + 50 * (22 + i % 5), 50):      # 5 of 1,196 shingles each
            if at < len(changed):
                changed[at] += "x"
        texts += [" ".join(words), " ".join(changed)]
    sets = shingle_sets(texts)
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.8 <= min(like) and max(like) < 0.85
    assert dropped_copies(spark, texts) == expected_copies(texts)


def test_resemblance_is_jaccard_of_short_texts():
    sketch = lambda xs: np.array(sorted(xs), np.uint64).tobytes()      # noqa: E731
    assert simhash.resemblance(sketch({1, 2, 3}), sketch({2, 3, 4})) == 0.5
    assert simhash.resemblance(sketch(()), sketch(())) == 1.0


# --- host rules ---------------------------------------------------------------------------

def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    again = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
            n < 10 or 100 * len(again) > 20 * n)


def test_measures_and_verdicts(spark):
    rng = random.Random(10)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x # y\x0b z\n\nx # y\x0b z\n", "  é🙂 <b>", "a " * 3000,
             "a b c d e", "\n".join(["one two three"] * 4)] + [say(rng, 40) + "\n" + say(rng, 3) for _ in range(40)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(i, t, ["http://Bad.example/x", "good", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, texts[12], "good"), (12, texts[12], rows[12][2]), (500, "", "http://no address/%")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, host int")
    got = hostrules.judged(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == plain_measures(text[r["doc_id"]]), repr(text[r["doc_id"]])[:80]
    assert {r["host"] for r in got} == {"bad.example", "good", None, "http://no address/%"}
    assert all(r["host_rate"] is None for r in got if r["host"] is None)
    assert hostrules.judged(docs.limit(0)).count() == 0


def test_shrinkage_draws_small_hosts_to_the_mean(spark):
    rows = [("big", True)] * 90 + [("big", False)] * 10 + [("one", True)] + [(f"h{i}", i % 9 == 0) for i in range(60) for _ in range(9)]
    frame = spark.createDataFrame(rows, "host string, base_failed boolean")
    got = {r["host"]: r["host_rate"] for r in hostrules.host_rates(frame).collect()}
    n = {h: [b for x, b in rows if x == h] for h in got}
    total, mean = len(rows), sum(b for _, b in rows) / len(rows)
    var = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in n.values()) / total
    s = max(mean * (1 - mean) / var - 1, 0)
    assert got == {h: pytest.approx((sum(v) + s * mean) / (len(v) + s)) for h, v in n.items()}
    assert mean < got["one"] < 1


def test_host_verdict_reaches_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(20))
    rows = [(i, "junk", "bad") for i in range(50)] + [(60, good, "bad")] + [(100 + i, good, "fine") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in hostrules.judged(docs).collect()}
    assert not kept[60] and all(kept[100 + i] for i in range(50))
