"""Main text of pages: labelled, given and held-out ones, what the scan decides, odd rows."""

import html
import random
import re
import time

import pytest

from evtrace.llm import html_text

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def weights():
    return html_text.fit()


def test_html_on_labelled_and_given_pages(spark):
    weights = html_text.fit()
    for page, text in html_text.LABELLED:
        assert html_text.main_text(page, weights) == text
    held = "<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class=sidebar><p>Popular now: ten things to see</p></div><article><h1>Tides</h1><p>The moon pulls  the\nsea &amp; the &lt;shore&gt;.</p><script>var x='<p>no</p>'</script><div class='ad'>Buy boats</div><p>Twice a day.</p></article><section class=comments><p>Nice words, I liked them a lot</p></section><form><label>Name</label></form><footer>&copy; all rights</footer></body></html>"
    assert html_text.main_text(held, weights) == "Tides\nThe moon pulls the sea & the <shore>.\nTwice a day."
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, g in zip(pages.orderBy("page_id").collect(), html_text.extract(pages).orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article)\b[^>]*>", inner)]
        assert g["text"] == "\n".join(b for b in blocks if b) and g["n_chars"] == len(g["text"])


def test_html_keeps_links_headers_and_wrapped_articles():
    weights = html_text.fit()
    told = "<article><header><h1>On dams</h1></header><p>See <a href=/r>the report</a> of <small>last</small> year.</p><div class=ad>Buy dams now</div></article>"
    want = "On dams\nSee the report of last year."
    for around in ("%s", "<div id=page class=site>%s</div>", "<div class=site-content>%s</div>", "<body class='page site'><header><p>The dam daily</p></header><nav><a href=/>Home page</a></nav>%s<footer>All rights reserved</footer></body>"):
        assert html_text.main_text(around % told, weights) == want
    assert html_text.main_text("<div><a href=/>Home</a> <a href=/n>News of today</a></div><p>Plain words with <a href=/x>a link</a> in them.</p>", weights) == "Plain words with a link in them."



def test_the_scan_decides_on_pages_of_unseen_class_names(weights):
    held = html_text.made_pages(150, 99, named=True)
    assert sum(html_text.main_text(page, weights) == text for page, text in held) >= 0.95 * len(held)

    def whole(page):
        blocks = html_text._blocks(html_text.sequence(page)).values()
        return "\n".join(html_text._clean("".join(x[2] for x in b)) for b in blocks)

    assert not any(whole(page) == text for page, text in held)


def test_no_class_word_empties_a_page(weights):
    for sign in ("with-sidebar", "no-sidebar", "sidebar", "comments footer ad", "has-comments", "post with-sidebar", "main no-sidebar"):
        for tag in ("article", "main", "div", "section"):
            page = f"<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><{tag} class='{sign}'><h1>On dams</h1><p>Dams hold water back for the dry months.</p><p>They need care, and a look every spring.</p></{tag}></body>"
            assert html_text.main_text(page, weights) == "On dams\nDams hold water back for the dry months.\nThey need care, and a look every spring."


def test_replies_and_notices_by_other_names(weights):
    told = "<h1>On dams</h1><p>Dams hold water back for the dry months.</p><p>They need care, and a look every spring.</p>"
    more = "<h3>Three of them</h3><div><p>We had a dam like that, it was a fine thing to see.</p></div><p>So had we!</p>"
    for start in ("section id=discussion", "div class=responses", "div class='post-replies'", "section class='user-feedback'"):
        end = start.split()[0]
        for page in (f"<article>{told}</article><{start}>{more}</{end}>", f"<article>{told}<{start}>{more}</{end}></article>"):
            assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav>{page}</body>", weights) == "On dams\nDams hold water back for the dry months.\nThey need care, and a look every spring."
    for notice in ("gdpr-banner", "cookie-consent", "site-toast", "page-overlay"):
        assert html_text.main_text(f"<body><div class={notice}><p>We keep a note of what you read. It stays for a year.</p></div><article>{told}</article></body>", weights).startswith("On dams\n")


def test_deep_nesting_takes_time_that_grows_with_the_length(weights):
    for deep in ("<div class=a><p>one word more</p>" * 50_000, "<b>" * 50_000 + "<div>words here</div></i>" * 20_000, "<div class=text>" * 50_000 + "Words stand here." + "</div>" * 50_000, "<p><b>" * 50_000 + "words"):
        begun = time.monotonic()
        html_text.main_text(deep, weights)
        assert time.monotonic() - begun < 8


def test_best_run_is_the_greatest_of_all():
    rng = random.Random(4)
    for _ in range(300):
        score = [rng.choice([-2, -1, -0.5, 0.5, 1, 3]) for _ in range(rng.randint(0, 12))]
        lo, hi = html_text.best_run(score)
        best = max([sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)], default=0)
        assert sum(score[lo:hi]) == max(best, 0) and (hi > lo) == (best > 0)


def test_odd_rows(spark):
    long = "<article>" + "<p>words of a very long page &amp; more</p>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "just words & more"), (4, "u", "just words & more"), (None, "u", "<div><p>One sentence stands here.</p></div>"), (5, "u", "<p " * 2000), (6, "u", "<" * 3000), (7, "u", long), (8, "u", "<script>var x = 1</script><!-- a --> <style>p{}</style>")]
    odd = spark.createDataFrame([(*r, "mine", 5) for r in rows], PAGES + ", text string, n_chars int")
    got = html_text.extract(odd)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    said = [(r["page_id"], r["text"], r["n_chars"]) for r in got.collect()]
    assert said[:6] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "just words & more", 17), (4, "just words & more", 17), (None, "One sentence stands here.", 25)]
    assert said[6][1] == "" and said[7][1] == "<" * 3000 and said[8][1].count("\n") == 19_999 and said[9][1] == ""
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0
