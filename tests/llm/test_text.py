"""Pieces, main text and benchmark search against plain versions."""

import random
import time

import pytest
import sentencepiece
from pyspark.sql import functions as F

from strata3d.llm import decontaminate, maintext, pieces
from strata3d.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def serialized():
    return pieces.read_model(VOCABULARY)


def test_ids_equal_the_librarys(serialized):
    model = pieces.Model(serialized)
    library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
    rng = random.Random(7)
    signs = list("abcdefgh  \n\t.,$é漢🙂▁0123") + ["the ", "ing", "  ", "tion"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["", " ", "   ", "\n", "▁", "<s>", "<0x0A>", "x" * 5000, " " * 3000, "a b " * 4000]
    assert model.encode(texts) == library.encode(texts)
    assert model.encode(texts[::-1])[::-1] == library.encode(texts)


def test_unigram_words_get_the_best_sum(serialized):
    model = pieces.Model(serialized)
    model.merging = False
    rng = random.Random(3)
    vocabulary = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.2, "bc": -2.2, "abc": -6.0, "ca": -1.0}
    model.score, model.ids = vocabulary, {p: i for i, p in enumerate(vocabulary)}
    longer = {p[:i] for p in vocabulary for i in range(1, len(p))}
    model.table = {p: (model.ids.get(p, -1), p in longer) for p in vocabulary.keys() | longer}
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(200)})

    def best(w):
        return 0.0 if not w else max(best(w[len(p):]) + s for p, s in vocabulary.items() if w.startswith(p))

    names = list(vocabulary)
    for w, ids in model.walk(words):
        assert "".join(names[i] for i in ids) == w
        assert sum(vocabulary[names[i]] for i in ids) == pytest.approx(best(w))


def test_round_trip_and_defined_cases(spark, serialized):
    docs = spark.createDataFrame([(1, "Hello  wörld\n", 5), (2, None, 5), (3, "", 5), (None, "a▁b", 5), (1, "Hello  wörld\n", 5)],
                                 "doc_id long, text string, n_pieces int")
    coded = pieces.encoded(docs, serialized)
    got = coded.collect()
    assert len(got) == 5 and [r["exact"] for r in got if r["doc_id"] == 2] == [None]
    assert all(r["exact"] for r in got if r["doc_id"] != 2)
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(coded, serialized).collect()}
    assert back == {1: "Hello  wörld\n", 2: None, 3: "", None: "a b"}
    assert pieces.encoded(docs.limit(0), serialized).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><nav><a href=/>Home</a></nav>
</header><div class="cookie-notice">We use cookies please accept them all now</div><main><article>
<h1>A &amp; B</h1><p>First   para with <a href=x>linked words</a> in it.<br>Next line.</p>
<div class="advert">Buy now great offers for everyone</div><p>Second 3 &lt; 4&nbsp;done.</p>
<form><label>Mail me things</label></form></article><section id="comments"><p>I love this so much thanks
</p></section></main><aside><p>Related things</p></aside><script>var a="<p>no</p>"</script><footer>c</footer></body></html>"""


def test_main_text_of_a_page():
    text = maintext.main_text(maintext.weights_of({}), PAGE)
    assert text == "A & B\nFirst para with linked words in it. Next line.\nSecond 3 < 4 done."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("no tags", "no tags"), ("<p>x", "x"),
                                        ("<article><p>open <b>bold", "open bold"), ("a < b", "a < b"),
                                        ("<script>x</script>", ""), ("<!-- x", ""), ("<a " * 3000, None)])
def test_main_text_of_odd_pages(page, text):
    got = maintext.main_text(maintext.weights_of({}), page)
    assert text is None or got == text


@pytest.mark.parametrize("start, end", [
    ('<div class="layout has-sidebar">', "</div>"), ('<div id="page" class="no-sidebar">', "</div>"),
    ('<section class="search-results">', "</section>"), ('<div class="post-with-comments">', "</div>")])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_marks_on_what_holds_the_page_do_not_empty_it(start, end, tag):
    page = (f"<body>{start}<{tag}><p>The story has many words in its first paragraph.</p>"
            f"</{tag}><div class=comments><p>so nice</p></div>{end}</body>")
    assert maintext.main_text(maintext.weights_of({}), page) == "The story has many words in its first paragraph."


def test_headlines_and_the_word_hidden_stay():
    page = ('<body><article><div class="post-header"><h1>The headline</h1></div><p title="the hidden cost">One two.</p>'
            '<p class="overflow hidden md:block">Three four.</p><p title="display: none">Five.</p><p hidden>gone</p>'
            '<p style="display:none">gone</p><p aria-hidden="true">gone</p></article></body>')
    assert maintext.main_text(maintext.weights_of({}), page) == "The headline\nOne two.\nThree four.\nFive."


@pytest.mark.parametrize("page, text", [
    ("<body><article><p>The story has its words.</p></article><article class='comment'><p>so nice</p></article>",
     "The story has its words."),
    ("<body><div><p>The story has its words.</p><p>More of it.</p></div><article class='comment'><p>so nice</p></article>",
     "The story has its words.\nMore of it."),
    ("<title>Site and title</title><p>The story has its words.</p>", "The story has its words."),
    ("<title>Site and title<p>The story has its words.</p>", "The story has its words."),
    ("<svg width='1' /><article><p>The story.</p></article><svg><text>no</text></svg>", "The story."),
    ("<body><form action=x><nav><a>Home</a></nav><div><p>The story has many words here.</p></div></form></body>",
     "The story has many words here."),
    ("<body><form><article><p>One.</p></article></form></body>", "One."),
    ("<body><p>The story has many words here.</p><form><p>Mail me</p></form></body>", "The story has many words here."),
    ("<p " + " ".join(f"data-{i}='a>b'" for i in range(3000)) + ">The story.</p>", "The story."),
    ("<article><p>The first of two paragraphs.</p><div class=ad>" + "buy this now " * 90 + "</div><p>" + "word " * 400 + "</p></article>",
     "The first of two paragraphs.\n" + " ".join(["word"] * 400))])
def test_what_is_and_is_not_the_article(page, text):
    assert maintext.main_text(maintext.weights_of({}), page) == text


def test_tags_that_never_end_are_read_in_one_go():
    page = "<p>The story.</p>" + "<a =\"" * 50_000
    assert maintext.main_text(maintext.weights_of({}), page).startswith("The story.")


def _labelled(i):
    document = f"Line one of {i} has words.\nAnother line number {i} here."
    page = (f"<body><nav><a>Home of all</a></nav><div class='rail'><p>Read more from us {i}</p></div><div class='story'>"
            f"<p>Line one of {i} has words.</p><p>Another line number {i} here.</p></div>"
            f"<footer><p>all rights of {i} are held</p></footer></body>")
    return page, document


def test_learned_weights_alone_give_the_article(monkeypatch):
    for name in ("MARKS", "ASIDE"):
        monkeypatch.setattr(maintext, name, set())
    seen = sum((maintext.counts(*_labelled(i)) for i in range(40)), maintext.Counter())
    weights = maintext.weights_of(seen)
    page, document = _labelled(77)
    assert maintext.main_text(weights, page) == document
    assert "Read more" in maintext.main_text(maintext.weights_of({}), page)     # it is the labels that tell


def test_labels_outweigh_the_lists_and_the_scan_cuts_what_no_list_names():
    seen = sum((maintext.counts(p.replace("'story'", "'widget'"), d) for p, d in map(_labelled, range(40))), maintext.Counter())
    weights = maintext.weights_of(seen)
    assert weights["@widget"] > 0 > maintext.weights_of({})["@widget"]
    links = "<ul>" + "<li><a href=x>Some other page</a></li>" * 9 + "</ul>"     # no list names these
    text = maintext.main_text(maintext.weights_of({}), f"<body>{links}<div><p>The story has words.</p></div>{links}")
    assert text == "The story has words."


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randrange(9))]
        a, b = maintext.best_run(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_extraction_learns_from_named_documents(spark):
    docs = spark.createDataFrame([(i, f"Line one of {i} has words.\nAnother line number {i} here.") for i in range(30)],
                                 "doc_id long, text string")
    pages = [(i, f"http://h/en/{i}?x=1", f"<nav><ul><li><a>Home</a></li></ul></nav><article><p>Line one of {i} has words."
              f"</p><p>Another line number {i} here.</p></article><footer>all rights of {i}</footer>", "x") for i in range(30)]
    pages += [(98, None, None, "x"), (None, "http://h/7/", "", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    weights = maintext.fit(frame, docs, 20)
    assert weights["article"] > 0 and all(w < 0 for k, w in weights.items() if k.startswith("<"))
    assert weights["@nav"] < -2 and weights["@footer"] < -2
    assert maintext.extract(frame.limit(0), maintext.fit(frame.limit(0), docs)).count() == 0
    twice = maintext.extract(frame.where("page_id = 3").unionAll(frame.where("page_id = 3")), weights)
    assert [r["n_chars"] for r in twice.collect()] == [52, 52]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in maintext.extract(frame, weights).collect()}
    assert got[3] == ("Line one of 3 has words.\nAnother line number 3 here.", 52)
    assert got[98] == got[None] == ("", 0)


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        i, what = rng.randrange(len(s)), rng.random()
        if what < 0.4:
            s[i] = rng.choice("abcdef")
        elif what < 0.7:
            s.insert(i, rng.choice("xyz"))
        else:
            del s[i]
    return "".join(s)


def edits(p, t):
    """Least edits of p against any stretch of t, cell by cell."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_search_equals_alignment_of_every_pair():
    rng = random.Random(5)
    words = ["mo", "rata", "lin", "sebo", "kar", "tiru", "pan", "ze"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))      # noqa: E731
    items = [say(rng.randrange(4, 22)) for _ in range(8)] + ["mo", "", None]
    texts = [None, "", "mo " * 50]
    for k in range(60):
        item = items[k % 8]
        texts.append(say(k % 9) + " " + edited(rng, item, rng.randrange(1 + len(item) // 8)) + " " + say(k % 7))
    ix = decontaminate.index(list(range(len(items))), items, 0.1)
    got = {(r, i): e for r, i, _, _, e in decontaminate.search(ix, texts)}
    plain = lambda t: "".join(chr(c) for c in decontaminate.reduced([t])[0])      # noqa: E731
    for r, t in enumerate(texts):
        for i in range(8):
            e = edits("".join(map(chr, ix.codes[i])), plain(t))
            assert got.get((r, i)) == (e if e <= ix.edits[i] else None), (r, i, e)
    assert not any(i >= 8 for _, i in got)


def test_search_finds_the_stretch():
    ix = decontaminate.index([0], ["abcdefghij"], 0.1)
    found = lambda t: list(decontaminate.search(ix, [t]))      # noqa: E731
    assert found("xxabcdefghijyy") == [(0, 0, 2, 12, 0)]
    assert found("xxabcdXfghijyy") == [(0, 0, 2, 12, 1)]
    assert found("qqqqqqqqqqqqqq") == []
    assert found("abcdefghij--ABCDEFGHIJ") == [(0, 0, 0, 10, 0), (0, 0, 12, 22, 0)]
    assert found("bcdefghij") == [(0, 0, 0, 9, 1)] and found("abcdefghi") == [(0, 0, 0, 9, 1)]


def test_search_has_the_stated_tenth_at_every_length(monkeypatch):
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).replace("  ", "ab").strip()      # noqa: E731
    items = [say(n) for n in (8, 9, 10, 11, 15, 19, 20, 22, 25, 29, 30, 33, 39, 40, 41, 47, 55, 60)]
    texts = [say(rng.randrange(20)) + " " + edited(rng, item, rng.randrange(2 + len(item) // 10)) + say(rng.randrange(20))
             for item in items for _ in range(12)]
    ix = decontaminate.index(list(range(len(items))), items, 0.1)
    plain = lambda t: "".join(chr(c) for c in decontaminate.reduced([t])[0])      # noqa: E731
    want = {}
    for r, t in enumerate(texts):
        for i, item in enumerate(items):
            p = plain(item).strip()
            e = edits(p, plain(t))
            if len(p) >= 8 and e <= len(p) // 10:
                want[r, i] = e
    assert len({i for _, i in want}) >= 17
    for most in (2_000_000, 50):               # the latter parts items and stretches of the text
        monkeypatch.setattr(decontaminate, "MOST", most)
        assert {(r, i): e for r, i, _, _, e in decontaminate.search(ix, texts)} == want
        joined = ". ".join(texts)
        whole = {(i, e) for _, i, _, _, e in decontaminate.search(ix, [joined])}
        assert {i for i, _ in whole} >= {i for _, i in want}


def test_items_with_one_opening_in_a_text_that_repeats_it():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))      # noqa: E731
    opening = "choose the right answer to the following question "
    items = [opening + " ".join(word() for _ in range(9)) for _ in range(100)]
    text = " ".join(opening + " ".join(word() for _ in range(9)) for _ in range(400)) + " " + items[7] + " " + items[93]
    ix = decontaminate.index(list(range(100)), items, 0.1)
    began = time.monotonic()
    got = [(i, text[a:z]) for _, i, a, z, _ in decontaminate.search(ix, [text])]
    assert sorted(got) == [(7, items[7]), (93, items[93])]
    assert time.monotonic() - began < 30


def test_contaminated_rows_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "Intro, THE quick brown-fox jumps over the lazy dog! End.", 0), (2, None, 0), (3, "clean text of its own", 0),
         (None, "the quick brown fox jumps over the lazy dog", 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog"), (8, None), (9, "tiny"),
                                   (10, "some other question entirely, never used here")], "item_id long, text string")
    for size in (2_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        got = {(r["doc_id"], r["item_id"], r["start"], r["stop"], r["edits"])
               for r in decontaminate.contaminated(docs, bench).collect()}
        assert got == {(1, 7, 7, 50, 0), (None, 7, 0, 43, 0)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).where(F.lit(True)).count() == 0
