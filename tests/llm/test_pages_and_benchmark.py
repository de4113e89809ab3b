import re
from collections import Counter

import pytest
from llm_cases import documents, empty, rows, sentence

from tidewash.llm import decontaminate, html_text

PLAIN = html_text.Weights(
    unknown_tag=-0.5,
    tags={"p": -0.1, "/p": -0.1, "br": -0.1, "nav": -10, "footer": -10, "li": -3, "a": -3},
)


def test_article_without_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header><a href="/">Site name</a></header><nav><ul><li><a>one</a><li><a>two</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site and many more words here</div>
    <article><header><h1>A &amp; B</h1></header><p>First   paragraph &lt;here&gt;<br>goes
    on<p>Second <b>bo</b>ld <script>var x = "</p>words";</script>one
    <aside>Read this other thing</aside><form><input>Your mail</form>
    <div id="ads">Buy now<p>x</div><p hidden>secret</p><p>Third &copy; one with several words</article>
    <section class="comments"><p>I disagree with all of this, said a reader</p></section>
    <footer><p>All rights reserved by the owners of this site</p></footer></body></html>"""
    assert html_text.extract(page, PLAIN).split("\n") == [
        "A & B",
        "First paragraph <here> goes on",
        "Second bold one",
        "Third © one with several words",
    ]


@pytest.mark.parametrize(
    "page", [None, "", "   ", "<p", "<!-- x", "</", "<a href='x", "<script>a b c", "<nav>a b c</nav>", "</p></p>"]
)
def test_pages_without_text(page):
    assert html_text.extract(page, PLAIN) == ""


def test_broken_markup_is_read_as_far_as_it_goes():
    assert html_text.extract("a < b and <b>c", PLAIN) == "a < b and c"
    assert html_text.extract('<p title="a>b">text here</p', PLAIN) == "text here"
    assert html_text.extract("<p>" * 5000 + "deep" + "<div>" * 3, html_text.Weights()) == "deep"
    assert html_text.extract("words " + "<a '" * 3000 + "x", PLAIN) == "words"


def best_by_brute_force(scores):
    best, at = 0, (0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sum(scores[a:b]) > best + 1e-9:
                best, at = sum(scores[a:b]), (a, b)
    return best, at


@pytest.mark.parametrize("seed", range(20))
def test_region_has_the_highest_score(seed):
    import random

    pick = random.Random(seed)
    tags = {"a": -2.0, "b": -0.5, "c": -7.0}
    events = [
        ("tag", pick.choice("abc"), False, 0)
        if pick.random() < 0.6
        else ("text", "w " * pick.randrange(6), pick.random() < 0.2, 0)
        for _ in range(25)
    ]
    weights = html_text.Weights(tags=tags)
    scores = [
        tags[v] if k == "tag" else len(v.split()) * (-1.0 if dropped else 1.0)
        for k, v, dropped, _ in events
    ]
    best, _ = best_by_brute_force(scores)
    a, b = html_text.region(events, weights)
    assert sum(scores[a:b]) == pytest.approx(best)


LONG = "many words of an article that goes on and on " * 10


@pytest.mark.parametrize(
    "page, expected",
    [
        (f'<div class="layout has-sidebar"><article>{LONG}</article></div>', LONG),
        (f'<div id="no-sidebar"><article>{LONG}</article></div>', LONG),
        (f'<form action="x.aspx"><nav>a b</nav><article>{LONG}</article></form>', LONG),
        (f'<form><nav>{LONG}</nav><div>{LONG}</div></form>', LONG),
        (f'<div class="sidebar"><main>{LONG}</main></div>', LONG),
        (f'<div class="widget">{LONG}</div><footer>{LONG}</footer>', LONG),
        (
            f'<article><h2 id="social-impact">Social impact</h2>{LONG}<p class="ad-hoc">An aside'
            f'</p><section id="related-work">Other work</section><div class="ad-box">Buy</div></article>',
            f"Social impact {LONG} An aside Other work",
        ),
        (f'<article>{LONG}<div class="comments">{LONG * 15}</div>{LONG * 20}</article>', LONG * 21),
        (f'<article>{LONG}<div class="comments">I disagree</div>{LONG}</article>', LONG * 2),
    ],
)
def test_names_do_not_remove_articles(page, expected):
    found = html_text.extract(f"<html><body>{page}</body></html>", PLAIN)
    assert found.split() == expected.split()


GIVEN = html_text.candidates(Counter())[0]
OTHER = "what readers of this page had to say about it " * 10


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize(
    "end, expected",
    [
        ("<ul><li>one point<li>two</li><li>three</ul>", "one point\ntwo\nthree"),
        ('<p>See <a href="x">this</a> and <a>that</a>.</p>', "See this and that."),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "1\n2"),
        ("<h2>End</h2><h3>Sources</h3>", "End\nSources"),
        ("<div><div><a>x</a></div></div>", "x"),
        ("<p><a title='Don't'>word</a> and <a title=\"It's\" rel=x/>more</a>", "word and more"),
        ("<div class=x/>inner</div>", "inner"),
    ],
)
def test_articles_are_kept_to_their_end(around, end, expected):
    page = f"""<body><nav><ul><li><a>a</a><li><a>b</a></ul></nav><h1>Site</h1>
    <{around}><p>{LONG}</p>{end}</{around}><footer>{OTHER}</footer></body>"""
    for weights in html_text.candidates(html_text.count_labelled([page] * 5)):
        assert html_text.extract(page, weights) == f"{LONG.strip()}\n{expected}"


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p>{LONG}</p></article><div class="comments"><p>{OTHER * 30}</p></div>',
        f'<article><p>{LONG}</p><div class="sidebar"><p>{OTHER * 150}</p></div></article>',
        f'<article><p>{LONG}</p><section class="comments"><article>{OTHER * 30}</article></section></article>',
        f'<article><p>{LONG}</p></article><div id="comments"><article>{OTHER * 30}</article></div>',
        f'<article><p>{LONG}</p></article><article class="comment">{OTHER * 30}</article>',
        f'<main><p>{LONG}</p></main><section class="related">{OTHER * 30}</section>',
        f'<div><p>{LONG}</p></div><div class="comments">{OTHER * 30}</div>',
        f'<div><p>{LONG}</p></div><div class="comments"><div class="comment">{OTHER * 30}</div></div>',
        f'<div class="widget"><article><p>{LONG}</p></article></div><div class="comments">{OTHER}</div>',
    ],
)
def test_named_boilerplate_of_any_size_is_left_out(page):
    assert html_text.extract(f"<html><body>{page}</body></html>", GIVEN) == LONG.strip()


def test_text_beside_a_small_article_stays():
    page = f"<body><div><p>{LONG * 5}</p></div><article>Read on <a>there</a></article></body>"
    assert html_text.extract(page, GIVEN).startswith(LONG.strip())


def test_end_tags_without_a_start_take_linear_time():
    import time

    began = time.perf_counter()
    assert html_text.extract("<b>word " + "</i>" * 100_000, GIVEN) == "word"
    assert html_text.extract("<b>" * 50_000 + "word " + "</i>" * 50_000, GIVEN) == "word"
    assert time.perf_counter() - began < 6


def test_names_cost_less_if_labelled_articles_have_them():
    seen = f'<html><body><article>{LONG}<p class="notice">Mind this</p></article></body></html>'
    page = f'<html><body><article>{LONG}<p class="notice">And that</p></article></body></html>'
    assert "And that" not in html_text.extract(page, html_text.candidates(Counter())[0])
    tried = html_text.candidates(html_text.count_labelled([seen] * 20))
    assert "And that" in html_text.extract(page, tried[0])


def test_weights_from_labelled_pages_find_articles_without_the_label(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.fit_page_weights(pages, most=100)
    assert weights.tags["/li"] < weights.tags["p"] < 0
    found = {r.page_id: r.text for r in html_text.main_text(pages, weights).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        cuts = [re.sub(r"<[^>]*>", "", c) for c in re.split(r"</?(?:p|h1)>", inner)]
        import html

        expected = [" ".join(html.unescape(c).split()) for c in cuts]
        assert found[r.page_id] == "\n".join(c for c in expected if c)
        bare = r.html.replace("<article>", "").replace("</article>", "")
        assert html_text.extract(bare, weights) == found[r.page_id]


def test_weights_are_fitted_on_one_page_per_id(spark, monkeypatch):
    page = f"<html><body><article><p>{LONG}</article></body></html>"
    given = [(None, page)] * 200 + [(1, page)] * 200 + [(2, page), (3, page)]
    pages = spark.createDataFrame(given, "page_id long, html string")
    seen = []
    known = html_text.candidates
    monkeypatch.setattr(html_text, "candidates", lambda c: seen.append(c) or known(c))
    html_text.fit_page_weights(pages, most=300)
    html_text.fit_page_weights(pages, most=2)
    assert [c["tag", "p", True] for c in seen] == [3, 2]


def test_pages_with_nulls_and_other_columns(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (None, "u", "<p>some words</p>", "y"), (1, None, None, "x")],
        "page_id long, url string, html string, text string",
    )
    weights = html_text.fit_page_weights(pages)
    found = html_text.main_text(pages, weights).collect()
    assert Counter((r.page_id, r.url, r.text) for r in found) == Counter(
        {(1, None, ""): 2, (None, "u", "some words"): 1}
    )
    assert html_text.main_text(pages.limit(0), weights).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def hits_by_brute_force(text, items, length=13, unnamed=True):
    own = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        asked = words(item_text)
        if not asked or (item is None and not unnamed):
            continue
        size = min(length, len(asked))
        for k in range(len(asked) - size + 1):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == asked[k : k + size]:
                    hit.update(range(at, at + size))
                    found.update([] if item is None else [str(item)])
    return len(own), len(hit), sorted(found), hit


ITEMS = [
    (1, sentence(99, 30)),
    (2, "One"),
    (3, "TWO, one two!"),
    (4, None),
    (5, "  ..."),
    (None, sentence(1, 20)),
    (7, sentence(5, 4000)[200:400]),
    (10, "ünïcode WÖRDS äö"),
    (11, "wörds ÄÖ 中文 TEXT"),
    (12, "same " * 14),
    (13, sentence(99, 30)[15:]),
]


@pytest.mark.parametrize("item_chars, unnamed", [(10**6, False), (10**6, True), (100, True)])
def test_hits_by_brute_force(spark, item_chars, unnamed):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    options = {} if unnamed else {"unnamed": False}
    found = decontaminate.benchmark_hits(documents(spark), items, item_chars=item_chars, **options)
    got = Counter()
    by_row = {(r[0], r[1]): r[1] for r in rows()}
    texts = {}
    for i, t in by_row:
        texts.setdefault(i, []).append(t)
    for r in found.collect():
        got[(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated)] += 1
        for t in texts[r.doc_id] if len(texts[r.doc_id]) == 1 else []:
            inside = sum(len(words(t[s.start : s.end])) for s in r.spans)
            assert inside == r.n_hit
    expected = Counter()
    for r in rows():
        n, h, names, _ = hits_by_brute_force(r[1], ITEMS, unnamed=unnamed)
        expected[(r[0], n, h, tuple(names), h > 0 and 20 * h >= n)] += 1
    assert got == expected


def test_keep_clean_and_nothing(spark):
    docs = documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.schema == docs.schema
    clean = [
        r[0]
        for r in rows()
        for n, h, *_ in [hits_by_brute_force(r[1], ITEMS)]
        if not (h and 20 * h >= n)
    ]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(clean)
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == len(rows())
    assert decontaminate.keep_clean(empty(spark), items).count() == 0


def test_queries_count_benchmark_texts_without_an_id(spark, tmp_path):
    import corpus_pipeline

    given = [(1, sentence(50, 40)), (2, sentence(51, 40)), (3, sentence(52, 40))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(None, sentence(50, 20)), (9, sentence(51, 20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    found = decontaminate.op6_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in found} == {
        (1, 20, 0, True), (2, 20, 1, True), (3, 0, 0, False)
    }
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [3]
