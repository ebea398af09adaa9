import random
import time

import pytest

from claimwright.llm import html_text


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(600):
        a = [rng.randrange(5) for _ in range(rng.randrange(12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(12))]
        found = html_text.shared_lines(a, b)
        assert found == sorted(set(found)) and len(found) == lcs_length(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in found)


def test_alignments_of_long_pages_with_few_different_lines(monkeypatch):
    rng = random.Random(2)
    a, b = ([rng.randrange(2) for _ in range(n)] for n in (6002, 9002))
    whole = html_text.shared_lines(a, b)
    monkeypatch.setattr(html_text, "_TABLE", 1 << 16)
    halved = html_text.shared_lines(a, b)
    assert len(whole) == len(halved) > 5500
    for found in (whole, halved):
        rest = iter(b)
        assert found == sorted(set(found)) and all(a[k] in rest for k in found)
    for _ in range(100):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        monkeypatch.setattr(html_text, "_TABLE", 20)
        assert len(html_text.shared_lines(a, b)) == lcs_length(a, b)


def text_of(html):
    return html_text.main_text(html_text.lines_of(html), set())


def test_articles_lose_chrome_and_keep_all_else():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="cookie-notice">Cookies</div>
    <article><header><h1>Big &amp; small</h1></header><p>One <b>bold</b>\n word<br>next&nbsp;&#233;<p>Two<ul><li>a<li>b</ul><script>var x = "</p>";</script>
    <div class="ad"><div>Buy</div></div><aside>Side</aside><form><p>Sign up</p></form><p hidden>no</p><section id="comments"><p>First!</p></section><p>Last</article>
    <div role="complementary">More</div><footer>&copy; x</footer></body></html>"""
    assert text_of(html) == "Big & small\nOne bold word next é\nTwo\na\nb\nLast"


def test_cut_off_and_odd_pages():
    assert text_of("<article><p>a &am") == "a &am"
    assert text_of("<article><p>a</p><p>b</artic") == "a\nb"
    assert text_of("<article>1 < 2 and 3 > 2<!-- x -->y</article>") == "1 < 2 and 3 > 2y"
    assert text_of("plain <i>text</i> only") == "plain text only"
    assert text_of("<nav><p>x</p></nav>") == "" and text_of("<article></article>") == ""
    assert text_of("<article>" + "<p>w</p>" * 20000 + "</article>").count("\n") == 19999


@pytest.mark.parametrize("make", [
    lambda n: "<a " * n, lambda n: "<b class='" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "</1 " * n + ">", lambda n: "<script></script" * n, lambda n: "<a '><a '" * n + '"',
    lambda n: "<a ''" * n + '"', lambda n: "<!-- " * n, lambda n: '<a "' * n + ">'", lambda n: "<" * n, lambda n: "<p>" * n + "x", lambda n: "<nav>" * n + "</div>" * n, lambda n: "<p " + "role class display " * n + ">x",
])
def test_hostile_markup_takes_linear_time(make):
    seconds = []
    for size in (300_000, 3_000_000):
        page = make(size // len(make(1)) + 1)[:size]
        began = time.perf_counter()
        html_text.lines_of(page)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < max(25 * seconds[0], 1) and seconds[1] < 20


def test_quotes_and_open_ends():
    assert text_of('<p title="a > b">x</p>') == "x" and text_of("<p title='>'>y") == "y"
    assert text_of('<p title="a > b</p>') == "b" and text_of('<a "><b>z') == "z"
    assert text_of("one <a b='") == "one" and text_of("one <1") == "one <1" and text_of("one <\n") == "one" and text_of("a <!-- b") == "a"
    assert text_of("<script>x</script y") == "" and text_of("<script>x</SCRIPT >z") == "z"


def test_neutral_lines_shared_with_the_nearest_page_go(spark, monkeypatch):
    page = lambda body: f"<html><body><div>Site name</div><div>{body}</div><p>All rights</p></body></html>"
    rows = [(1, "http://h.com/a/1", page("first")), (2, "http://h.com/a/2", page("second")), (3, "http://h.com/b/1", page("third")), (4, "http://alone.com/a", page("only")), (5, None, page("none")), (6, "http://h.com/a/3", None)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {1: "first", 2: "second", 3: "third", 4: "Site name\nonly\nAll rights", 5: "Site name\nnone\nAll rights", 6: ""}
    # without the alignment nothing would be shared
    monkeypatch.setattr(html_text, "_shared_with_nearest", lambda *_: [])
    assert {r.text for r in html_text.extract(df).collect() if r.page_id < 4} == {f"Site name\n{x}\nAll rights" for x in ("first", "second", "third")}


def test_lines_beside_an_article_are_decided_by_the_alignment(spark):
    page = lambda own: f"<div>Site name</div><article><p>teaser {own}</p></article><div>{own} body</div><div>All rights</div>"
    df = spark.createDataFrame([(k, f"http://h.com/a/{k}", page(x)) for k, x in enumerate(("one", "two"))], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {0: "teaser one\none body", 1: "teaser two\ntwo body"}


def test_copies_of_articles_survive_and_ranges_agree(spark):
    html = "<nav>m</nav><article><p>same text</p></article>"
    rows = [(k, f"http://h.com/{k % 7}", html) for k in range(40)] + [(3, "http://h.com/3", html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 9):
        found = html_text.extract(df.repartition(parts)).collect()
        assert len(found) == 41 and {(r.text, r.n_chars) for r in found} == {("same text", 9)}
    assert html_text.extract(df.limit(0)).count() == 0
