import random
import re
import zlib

import numpy as np
import pytest

from loam.llm import boosting, html_text, language_id, toxicity

# --- boosting


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], np.ones(2000), trees=30)
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


# --- HTML extraction


@pytest.fixture(scope="module")
def extractor():
    return html_text.trained()


def plain_article(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", m[1])
    import html

    texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", p))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_pages_give_their_articles(spark, extractor):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages, extractor).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == plain_article(rows[r.page_id]) for r in got) >= 0.99 * len(got)


def test_made_up_pages_that_were_not_trained_on(extractor):
    rng = random.Random(123)
    right = 0
    for _ in range(100):
        page = html_text.example_page(rng)
        nodes = html_text.parse(page)
        right += extractor.texts([page])[0] == "\n".join(html_text.blocks_of(nodes, html_text.truth(nodes)))
    assert right >= 80


def test_choices_never_contradict(extractor):
    rng = random.Random(5)
    for _ in range(20):
        nodes = html_text.parse(html_text.example_page(rng))
        stays = html_text.decode(nodes, np.random.default_rng(1).random(len(nodes)))
        assert all(stays[n.parent] for n, s in zip(nodes[1:], stays[1:], strict=True) if s)


def test_decoding_is_the_best_consistent_choice():
    nodes = html_text.parse("<div><p>a</p><ul><li>b</li></ul></div><nav>c</nav>")
    p = np.random.default_rng(7).random((50, len(nodes)))
    import itertools

    for own in p:
        weight = np.array([sum(0.2 + len(r) / 100 for _, r in n.runs) for n in nodes])
        worth = lambda s: sum(w * np.log(q if keep else 1 - q) for keep, q, w in zip(s[1:], own[1:], weight[1:], strict=True))
        fine = [s for s in itertools.product((False, True), repeat=len(nodes)) if s[0] and all(s[n.parent] for n, k in zip(nodes[1:], s[1:], strict=True) if k)]
        assert worth(html_text.decode(nodes, own).tolist()) == pytest.approx(max(map(worth, fine)))


def test_markup_rules():
    def all_text(page):
        nodes = html_text.parse(page)
        return html_text.blocks_of(nodes, np.array([n.tag not in html_text.NEVER for n in nodes]))

    assert all_text("<p>a<p>b &amp; c<br>d") == ["a", "b & c d"]
    assert all_text("<ul><li>x<li> y\n z </ul>t") == ["x", "y z", "t"]
    assert all_text("<div>a<p>b</p>c</div>") == ["a", "b", "c"]
    assert all_text("<p>1 < 2 <b>bold</p><p>next</p>") == ["1 < 2 bold", "next"]
    assert all_text('<script>var t="</p>";</script>x<style>y') == ["x"]
    assert all_text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert all_text("a<!-- <p>b -->c") == ["ac"]


def test_odd_pages(spark, extractor):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (4, "u", "<"), (5, "u", "<p"), (6, "u", "</div></p>"), (7, "u", "<b>" * 3000 + "x"), (None, None, "<!--"), (9, "u", "<p>a</p>" * 20_000), (9, "u", "<p>a</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages, extractor).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got if r.page_id and r.page_id != 9}
    assert by[1] == by[2] == "" and by[3] == "plain text only"
    assert html_text.extract(pages.limit(0), extractor).count() == 0


def test_short_articles(extractor):
    body = "word " * 150
    pages = ["<article><p>One short line.</p></article>", "<html><body><h1>Title</h1><p>One.</p></body></html>", f"<html><body>{body}<br>{body}</body></html>"]
    assert extractor.texts(pages) == ["One short line.", "Title\nOne.", " ".join((body + body).split())]
    assert extractor.texts(["<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><footer>&copy; 2020</footer></body></html>"]) == [""]


HOSTILE = ["<a " * 300_000, '<a "> "' * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<div>" * 40_000 + "<li>" * 40_000, "<a<a<a" * 50_000 + '">"', "<a x='" * 100_000, "<script>" * 50_000, "<!--" * 100_000, '<a href="' * 100_000 + ">"]


@pytest.mark.parametrize("page", HOSTILE, ids=lambda p: p[:8])
def test_hostile_pages_take_time_in_proportion(page):
    import time

    began = time.perf_counter()
    nodes = html_text.parse(page)
    html_text.blocks_of(nodes, np.ones(len(nodes), bool))
    assert time.perf_counter() - began < 10


def test_fragments_keep_the_text_at_their_root(extractor):
    pages = ["Some text.<br>More text.", "Text <b>word</b>", 'Text <a href="x"><i>word</i></a> end', "<b>First</b> words<script>x</script> &amp; last", "<a>x</a> | <a>y</a>"]
    assert extractor.texts(pages)[:4] == ["Some text. More text.", "Text word", "Text word end", "First words\n& last"]
    assert not html_text.root_flow(html_text.parse(pages[4])).any()
    assert not html_text.root_flow(html_text.parse("<html><body>words</body></html> stray")).any()


# --- language ID


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    m = language_id.Model(["a", "b"], *(rng.normal(size=s) * 0.3 for s in ((2, 257, 6), (2, 2, 6), (2, 2, 2), (2,))))
    x = rng.integers(0, 4, (3, 5))
    x[0, 3:] = language_id.PAD
    y = np.array([0, 1, 1])
    run = language_id._run

    def wide(m, x, keep=False):  # the same in double precision
        states, saved = [None] * x.shape[1], []
        real = np.float32
        np_float, language_id.np.float32 = real, np.float64
        try:
            return run(m, x, keep)
        finally:
            language_id.np.float32 = np_float

    language_id._run = wide
    try:
        _, grads = language_id._gradients(m, x, y)
        for w, g in zip((m.inputs, m.recurrent, m.outputs, m.bias), grads, strict=True):
            for at in list(np.ndindex(w.shape))[:: max(1, w.size // 40)]:
                old = w[at]
                w[at] = old + 1e-5
                up = language_id._gradients(m, x, y)[0]
                w[at] = old - 1e-5
                down = language_id._gradients(m, x, y)[0]
                w[at] = old
                assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-4)
    finally:
        language_id._run = run


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language_id.train(language_id.sample(docs))


def test_languages_of_held_out_documents(languages):
    docs, model = languages
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_scores(m, text):
    """The network of one text, a byte, a gate and a position at a time."""
    raw, n = text.encode(), language_id.HIDDEN
    total = np.zeros(len(m.languages))
    for a in range(0, len(raw), language_id.WINDOW):
        window = list(raw[a : a + language_id.WINDOW])
        padded = window + [language_id.PAD] * (language_id.WINDOW - len(window))
        states = []
        for way, order in ((0, padded), (1, padded[::-1])):
            h, own = np.zeros(n), []
            for byte in order:
                x, w = m.inputs[way][byte].astype(float), m.recurrent[way].astype(float)
                r = 1 / (1 + np.exp(-2 * (x[:n] + h @ w[:, :n])))
                z = 1 / (1 + np.exp(-2 * (x[n : 2 * n] + h @ w[:, n : 2 * n])))
                c = np.tanh(x[2 * n :] + (r * h) @ w[:, 2 * n :])
                h = (1 - z) * c + z * h
                own.append(h)
            states.append(own if way == 0 else own[::-1])
        for k in range(len(window)):
            s = np.exp(states[0][k] @ m.outputs[0] + states[1][k] @ m.outputs[1] + m.bias)
            total += s / s.sum()
    return total / max(1, len(raw))


def test_scores_against_a_plain_network(languages, odd_docs, monkeypatch):
    docs, model = languages
    monkeypatch.setattr(language_id, "AT_ONCE", 7)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["é", "x" * 64, "x" * 65, "日本" * 50]
    want = np.array([plain_scores(model, t) for t in texts])
    assert np.allclose(language_id.document_scores(model, texts), want, atol=2e-4)
    monkeypatch.undo()
    rows = language_id.identify(docs.orderBy("doc_id").limit(25), model).collect()
    for r in rows:
        own = want[[x == r.doc_id for x in [d.doc_id for d in docs.orderBy("doc_id").limit(25).collect()]].index(True)]
        assert r.score == pytest.approx(own.max(), abs=2e-4) and (model.languages[own.argmax()] == r.lang_pred or np.sort(own)[-2] > own.max() - 1e-3)


def test_letters_are_those_of_unicode(languages, spark):
    _, model = languages
    texts = {1: "½ ² Ⅷ ٣ _ 12", 2: "ª", 3: "日", 4: "\u0301", 5: "a½"}
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.identify(docs, model).collect() if r.lang_pred == "und"} == {1, 4}
    assert 1 not in {r.doc_id for r in language_id.reject_unknown(docs, model=model).collect()}


def test_labels_are_never_an_input(languages, spark):
    docs, model = languages
    import pyspark.sql.functions as F

    some = docs.limit(50)
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(some, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(some.withColumn("lang", F.lit("xx")), model).collect()}
    assert a == b


def test_odd_documents_have_a_language(languages, odd_docs, no_docs):
    _, model = languages
    rows = language_id.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0
    assert language_id.identify(no_docs).count() == 0
    import pyspark.sql.functions as F

    assert {r.lang_pred for r in language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.reject_unknown(odd_docs, model=model)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, 8, 11, None}


def test_whole_texts_count(languages):
    _, model = languages
    short, long = "the and of that with", "der die das und mit " * 400
    p = language_id.document_scores(model, [short + " " + long, long, short])
    assert p[0].argmax() == p[1].argmax()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)


# --- toxicity


def test_folding():
    assert toxicity.fold("You 1D1OT!") == " you idiot "
    assert toxicity.fold("іdіоt, Ｉｄｉｏｔ; í-d-í-o-t") == " idiot idiot idiot "
    assert toxicity.fold("id​iot") == " idiot "
    assert toxicity.fold(None) == "  "


def test_matches_do_not_cross_words_and_exceptions_hold():
    lexicon = toxicity.Lexicon({"killer ": 2.0, "kill": 1.5, "rat ": 1.0}, {"killer app"}, (1.0, 1.0, -2.0))
    assert lexicon.weigh(toxicity.fold("a killer app"))[0] == 0
    assert lexicon.weigh(toxicity.fold("a killer and a killing rat"))[0] == 4.5
    assert lexicon.weigh(toxicity.fold("rate skill berat"))[0] == 0
    assert lexicon.score("killer killer") > lexicon.score("killer killer " + "word " * 500) > lexicon.score("word")


def plain_weight(lexicon, text):
    words = toxicity.fold(text).split()
    total = 0.0
    for k, w in enumerate(words):
        if {" ".join(words[k : k + 2]), " ".join(words[max(0, k - 1) : k + 1])} & lexicon.exceptions:
            continue
        total += max((v for e, v in lexicon.words.items() if f"{w} ".startswith(e)), default=0.0)
    return total


def plain_lexicon(rows):
    """What `learn` finds in (text, toxic) rows, by counting documents one after the other."""
    sides = [[toxicity.fold(t).split() for t, y in rows if y == side] for side in (0, 1)]
    clean, toxic = map(len, sides)
    floor = max(0.002, 2 / min(clean, toxic))

    def counts(parts):
        out = {}
        for side, texts in enumerate(sides):
            for own in texts:
                for x in parts(own):
                    out.setdefault(x, [0, 0])[side] += 1
        return out

    odds = lambda c: np.log((c[1] / toxic + floor) / (c[0] / clean + floor))
    found = {w: c for w, c in counts(lambda own: {f"{w} " for w in own} | {w[:n] for w in own for n in range(4, 9) if len(w) > n}).items() if sum(c) >= 4 and odds(c) >= 1.5}
    words = {w: odds(c) for w, c in found.items() if w.endswith(" ")}
    for size in range(8, 3, -1):  # longer beginnings first
        for s, c in found.items():
            if len(s) == size and not s.endswith(" ") and c[1] >= 4 + max((found[e][1] for e in [*words, *(w for w in found if w.endswith(" "))] if e.startswith(s) and e != s), default=0):
                words[s] = odds(c)
    listed = lambda w: any(f"{w} ".startswith(e) for e in words)
    pairs = counts(lambda own: {f"{a} {b}" for a, b in zip(own, own[1:]) if listed(a) or listed(b)})
    return words, {p for p, (n, t) in pairs.items() if n >= 4 and n * toxic >= 4 * t * clean}


def test_learning_against_a_plain_count(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        y = int(k % 3 == 0)
        text = [rng.choice(["path", "worth", "wort", "loses", "apple", "of", "and", "grand"]) for _ in range(12)]
        if y:
            text[rng.randrange(12)] = rng.choice(["pathetic", "worthless", "loser", "killer", "k1ller", "bomente" + rng.choice("abcdefghij") * 2])
        elif k % 30 == 1:
            text[4:6] = ["killer", "app"]
        rows.append((k, " ".join(text), y))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    # Repeated and conflicting labels, labels of other values, and labels of documents that are not there.
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(k, y) for k, _, y in rows[:50]] + [(5, 1), (9000, 1), (None, 1), (6, None), (7, 3)], "doc_id long, toxic int")
    known = {(k, t, y) for k, t, y in rows} | {(5, rows[5][1], 1)}
    sample = sorted({(t, y) for k, t, y in known if zlib.crc32(str(k).encode()) % 4 != 2})
    lexicon = toxicity.learn(docs, labels)
    words, exceptions = plain_lexicon(sample)
    assert set(lexicon.words) == set(words) and "killer app" in lexicon.exceptions and lexicon.exceptions == exceptions
    assert all(lexicon.words[w] == pytest.approx(v) for w, v in words.items())
    assert lexicon.weigh(toxicity.fold("the path is worth a Wort, she loses, a killer app"))[0] == 0
    assert all(lexicon.weigh(toxicity.fold(w))[0] > 1.5 for w in ("pathetic", "worthless", "loser", "killer", "bomentexyz"))


def test_scores_of_held_out_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.score(docs, lexicon).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.predicted for r in got) > 0.95 and hits / sum(r.toxic for r in got) > 0.93
    assert not any(lexicon.weigh(toxicity.fold(w))[0] for w in ("Wort", "path", "worth", "loses", "lose"))
    for r in docs.limit(60).collect():
        assert lexicon.weigh(toxicity.fold(r.text))[0] == pytest.approx(plain_weight(lexicon, r.text))
    rows = toxicity.score(odd_docs, lexicon).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.score(no_docs, lexicon).count() == 0
    assert toxicity.learn(no_docs, labels).words == {} and toxicity.learn(docs, labels.limit(0)).words == {}
    assert toxicity.score(odd_docs, toxicity.Lexicon()).first().score == 0


def test_samples_are_bounded_whatever_repeats(spark, monkeypatch):
    texts = [f"wort {k} eins zwei drei" for k in range(300)]
    docs = spark.createDataFrame([(6, t, "de") for t in texts] + [(k, f"text number {k} of many", f"l{k % 40}") for k in range(100, 180)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(6, 1), (6, 0), *((k, k % 2) for k in range(100, 180))], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "DOCS", 10)
    rows = toxicity._sampled(docs, labels.filter("doc_id = 6")).collect()
    assert len(rows) == 2 and rows[0].text == rows[1].text
    assert len(toxicity._sampled(docs, labels).collect()) <= 20
    monkeypatch.setattr(language_id, "DOCS", 60)
    found = language_id.sample(docs)
    assert len([1 for _, lang in found if lang == "de"]) <= language_id.WINDOWS and len({lang for _, lang in found}) > 25
    monkeypatch.setattr(language_id, "SAMPLE", 25)  # fewer than there are languages: each of those that are taken gives one document
    few = language_id.sample(docs)
    assert len(few) <= 25 * language_id.WINDOWS and len({lang for _, lang in few}) == 25
