"""Language model, language ID and page extraction; the pipeline's stages."""

from __future__ import annotations

import collections
import math
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolespark.llm import html_extract, kneser_ney, langid

VOCABULARY = [f"w{i}" for i in range(40)]


def sentences(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(VOCABULARY, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 30))) for _ in range(n)]


def reference(train):
    """Probability of a word after another by the textbook formulas."""
    words = [["<s>", *t.lower().split(), "</s>"] for t in train]
    pairs = collections.Counter(p for w in words for p in zip(w, w[1:], strict=False))
    count = collections.Counter(x for w in words for x in w[1:])
    before = collections.Counter(b for _, b in pairs)

    def discount(values):
        return [0.0, *kneser_ney.discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])]

    high, low, types = discount(pairs.values()), discount(before.values()), len(pairs)
    rest = sum(low[min(v, 3)] for v in before.values()) / types if types else 1.0

    def p(a, b):
        lower = (before[b] - low[min(before[b], 3)]) / max(1, types) + rest / (len(count) + 1)
        follow = {k: v for (x, k), v in pairs.items() if x == a}
        if not follow:
            return lower
        total, c = sum(follow.values()), follow.get(b, 0)
        return (c - high[min(c, 3)]) / total + sum(high[min(v, 3)] for v in follow.values()) / total * lower

    return p, count


def test_scores_and_sums(spark):
    train, test = sentences(1, 60), [*sentences(2, 20), "unseen words w1", "", None, "W1 w1\tW2"]
    p, count = reference(train)
    for a in ("<s>", "w1", "never"):
        assert sum(p(a, b) for b in [*count, "unseen"]) == pytest.approx(1)
    docs = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    model = kneser_ney.train(docs)
    assert (model.tokens, model.vocabulary) == (sum(count.values()), len(count))
    rows = spark.createDataFrame([(i, t, True, 9) for i, t in enumerate(test)], "doc_id long, text string, held_out boolean, score int")
    for r in kneser_ney.score(rows, model).collect():
        words = [*(test[r.doc_id] or "").lower().split(), "</s>"]
        assert (r.n_tokens, r.n_known) == (len(words), sum(count[w] > 0 for w in words))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *words], words, strict=False)))
        total = sum(count.values()) + len(count) + 1
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / total) for w in words))
    nothing = kneser_ney.score(rows, kneser_ney.train(docs.limit(0))).filter("doc_id = 0").first()
    assert nothing.n_known == 0 and nothing.score == pytest.approx(0)
    assert kneser_ney.score(rows.limit(0), model).count() == 0


def test_large_counts(spark, monkeypatch):
    docs = spark.createDataFrame([("x y " * 40_000,)], "text string")
    model = kneser_ney.train(docs)
    scorer = kneser_ney.Scorer(model)
    x = scorer.counts("word", kneser_ney.np.array([kneser_ney.xxhash.xxh64_intdigest(b"x")], dtype="uint64"))
    assert x[0] == 40_000 and model.tokens == 80_001
    docs = spark.createDataFrame([("x " * 70_000,)], "text string")
    model = kneser_ney.train(docs)
    assert kneser_ney.Scorer(model).counts("word", kneser_ney.np.array([kneser_ney.xxhash.xxh64_intdigest(b"x")], dtype="uint64"))[0] == 70_000


LANGUAGES = {"en": "the of and ing tion er th", "de": "der die und ung schen ich ä", "fr": "le la des eaux ment é ou"}


def speech(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(LANGUAGES[lang].split(), k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_language_id(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(list(LANGUAGES) * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None), (902, "123", "de")], "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(docs)
    assert model.languages == sorted(LANGUAGES)
    unseen = [(i, speech(lang, 1000 + i, n), lang) for i, lang in enumerate(list(LANGUAGES) * 10) for n in (8, 400)]
    odd = [(500, None, "x"), (501, "", "x"), (502, "12 !? 🙂", "x"), (None, "Ж" * 2000, "x"), (503, "a", "x")]
    out = langid.predict(spark.createDataFrame(unseen + odd, "doc_id long, text string, lang string"), model).collect()
    right = {(i, lang) for i, _, lang in unseen}
    assert all((r.doc_id, r.lang_pred) in right for r in out if r.doc_id is not None and r.doc_id < 500)
    assert all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in out if r.doc_id in (500, 501, 502)] == ["und"] * 3
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


def phrases(text, known):
    n = at = 0
    clean = langid.letters(text)
    while at < len(clean):
        at += max((k for k in range(1, min(60, len(clean) - at) + 1) if clean[at : at + k] in known), default=1)
        n += 1
    return n


SCRIPTS = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 17), "hebrew": (0x5D0, 27), "han": (0x4E00, 1500), "beyond": (0x10400 + 40, 40)}


def scripted(name, seed, n):
    """Words with frequent pairs of letters, so that texts of a script share phrases."""
    first, size = SCRIPTS[name]
    rng, letter = random.Random(f"{name}{seed}"), 0
    out = []
    for _ in range(n):
        letter = (letter * 7 + rng.choice([1, 2, 3, 5])) % size
        out.append(chr(first + letter) + rng.choice(["", "", "", " "]))
    return "".join(out)


@pytest.mark.parametrize("width", [langid.TABLE_WIDTH, 0])
def test_phrases_are_longest_matches(monkeypatch, width):
    monkeypatch.setattr(langid, "TABLE_WIDTH", width)
    texts = {n: langid.letters(scripted(n, 1, 600)) for n in SCRIPTS} | {"a": "the cat sat on the mat", "b": "le chat est sur la table"}
    model = langid.fit(texts)
    for text in ["the table sat", "zzz", "lechat", "Ж", "сат cat", *[scripted(n, 2, 300) for n in SCRIPTS], scripted("latin", 3, 150) + scripted("han", 3, 150)]:
        assert [int(g) for g in model.phrases([model.encode(text)])[0]] == [phrases(text, texts[n]) for n in model.languages]


def test_segments_add_at_most_a_phrase_each():
    texts = {n: langid.letters(scripted(n, 1, 900)) for n in ("latin", "han")}
    model = langid.fit(texts)
    for text in (scripted("latin", 4, 3000), scripted("han", 4, 2000)):
        codes = model.encode(text)
        for got, name in zip(model.phrases([codes])[0], model.languages, strict=True):
            whole = phrases(text, texts[name])
            assert whole <= got <= whole + -(-len(codes) // langid.SEGMENT) - 1


def test_scripts_do_not_crowd_each_other_out(spark):
    rows = [(None, scripted(n, i, 300), n) for i in range(40) for n in SCRIPTS] + [(None, scripted("latin", 1, 50), "latin")] * 500
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(SCRIPTS)
    unseen = [(i, scripted(n, 1000 + i, 200)) for i, n in enumerate(SCRIPTS)]
    out = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(unseen, "doc_id long, text string"), model).collect()}
    assert out == dict(enumerate(SCRIPTS))


def test_minimum_cut_is_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        content, other = [rng.random() * 4 for _ in range(n)], [rng.random() * 4 for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels, c=content, o=other, e=edges):
            return sum(c[i] if x else o[i] for i, x in enumerate(labels)) + sum(w for a, b, w in e if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(html_extract.minimum_cut(content, other, edges)) == pytest.approx(best)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><a href=x>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><h1>Big&nbsp;title &amp; more</h1><div class="share-buttons">Tweet this</div><p>One two
three <a href=q>four</a>.<p>Short.</p><form><input>Sign up</form><aside>Related stuff</aside><blockquote>quoted &lt;b&gt; words</blockquote></main>
<section id="comments"><article class="comment"><p>I like this article very much indeed, it is long and wordy and so on and on.</p></article></section><footer>c</footer><script>if (a<b) "</script>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>a<b"), (5, "x", "<article><p>x</p>" * 2000), (6, "y", "plain text of a page without any tags at all"), (7, "z", "<" * 3000), (1, "u", PAGE)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract_pages(docs).collect()
    text = {r.page_id: r.text for r in out}
    assert text[1] == "Big title & more\nOne two three four.\nShort.\nquoted <b> words"
    assert text[2] == text[3] == "" and text[6].startswith("plain") and len(text[5].split("\n")) == 2000
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == len(rows)
    assert html_extract.extract_pages(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    good = [" ".join(f"the {i}a{j} {i}b{j} {i}c{j}" for j in range(20)) for i in range(10)]
    item = "benchmark question about the capital of a far away place and its river"
    texts = [*good[:8], good[0] + " tail", "short", None, good[8] + " " + item, good[9] + " password=abcdefghijklmno1"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
        kept.append(sorted(r.doc_id for r in current.select("doc_id").collect()))
    assert kept[0] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12]
    assert 8 not in kept[1] and 0 in kept[1] and kept[2] == [i for i in kept[1] if i != 11] and kept[3] == kept[2]
    redacted = {r.doc_id: r for r in current.collect()}
    assert all("abcdefghijklmno1" not in r.text and r.n_chars == len(r.text) for r in redacted.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


@pytest.mark.parametrize("name", ["content article", "entry has-sidebar", "layout header-fixed", "legal-opinion", "social-science story", "page-search-results", "left-sidebar", "post related-topic"])
def test_names_that_only_seem_to_be_boilerplate(name):
    """The article stays whole, whatever its container is called; the menu and the comments beside it go."""
    text = "Word by word this paragraph goes on, as the paragraphs of an article do, until it has been long enough."
    page = f"<body><div class='menu'><a href='/'>Home</a></div><div class='{name}'>{f'<p>{text}</p>' * 4}</div><div class='comment-list'><p>{text}</p></div></body>"
    assert html_extract.extract(page) == "\n".join([text] * 4)


def test_deep_pages_take_linear_time():
    text = "<p>" + "a paragraph of several words that is long enough " * 4 + "</p>"
    began = time.process_time()
    assert html_extract.extract("<div>" * 100_000 + text).startswith("a paragraph")
    assert time.process_time() - began < 60


LONG = " ".join(["Some words of a long paragraph that say something"] * 8)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<form id="aspnetForm"><p>{LONG}</p><p>{LONG}</p></form>', f"{LONG}\n{LONG}"),
        (f"<header><a href=1>a</a></header><form><p>{LONG}</p><p>{LONG}</p><input></form><footer>Imprint</footer>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p></article><form><label>Search this site now</label></form>", LONG),
        (f'<article><div class="entry-header"><h1>The Title</h1></div><p>{LONG}</p></article>', f"The Title\n{LONG}"),
        (f'<div class="site-header"><h1>The Site</h1></div><article><p>{LONG}</p></article>', LONG),
        ("<body><div>Hello world.</div></body>", "Hello world."),
        ('<nav><a href="/">Home</a></nav><p><a href="/x">More</a></p><footer>© x</footer>', ""),
    ],
)
def test_containers_around_the_whole_page(page, text):
    assert html_extract.extract(page) == text


def test_text_between_links_keeps_its_label():
    blocks = "".join(f"<div>{LONG[:170]}</div><p><a href=x>read more of it here</a></p>" for _ in range(2000))
    assert html_extract.extract(f"<body>{blocks}</body>") == "\n".join([LONG[:170].strip()] * 2000)
