import random

import pytest

from tidemark.llm import html


def page(i, body, title=None):
    return f"<html><head><title>{title or i}</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<article><h1>T</h1><p>a\n  b<br>c<p>d&eacute;&nbsp;e</article><footer>f</footer>", "T\na b c\ndé e"),
    ("<nav>n</nav><article><p><b>bold<br><p>next<aside>side</aside></p></article>", "bold\nnext"),
    ("<article><script>var t='</p>';</script><p>x</p><!-- <p>no</p> --><form><p>f</p></form></article>", "x"),
    ('<article><p>x</p><div class="comments"><p>first!</p></div><section id="comment-list">c</section></article>', "x"),
    ('<article><header><h1>Head</h1></header><p>x</p></article><header>site</header>', "Head\nx"),
    ('<div class="cookie-notice">ok?</div><main><p>m</p></main>', "m"),
    ('<article><p>a</p></article><article><p>the longer one</p></article>', "the longer one"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "one\ntwo\n1 2\n3"),
    ("<article><p>cut off in <b>the mid", "cut off in the mid"),
    ('<article><p hidden>h</p><p style="display: none">n</p><p aria-hidden="true">a</p><p>x &lt;b&gt; &#233; &am</p></article>', "x <b> é &am"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ('<article><p title="a > b">x</p></article>', "x"),
    ("<article><p>x</p><ins class='ads'>buy</ins><span class=\"ad-slot\">me</span><p>y</p></article>", "x\ny"),
    ("<textarea><p>no</p></textarea><p>yes", "yes"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<article>" + "<header>" * 1500 + "<h1>T</h1>" + "</header>" * 1500 + "<p>x", "T\nx"),
    ("<article>" + "<b>" * 5000 + "in" + "</b>" * 5000 + "<i>" * 5000, "in"),
    ("<p>" + "</x>" * 5000 + "<table>" + "<tr><td>1<td>2" * 3000, "\n".join(["1 2"] * 3000)),
    ("<article>" + "<p>w</p>" * 20000 + "</article>", "\n".join("w" * 20000)),
]


@pytest.mark.parametrize("source,want", CASES)
def test_main_text(source, want):
    assert html.main_text(source) == want


def brute_match(a, i, b, j):
    if a.label[i] != b.label[j]:
        return 0
    x, y = a.kids[i], b.kids[j]

    def best(p, q):
        if p == len(x) or q == len(y):
            return 0
        return max(best(p + 1, q), best(p, q + 1), best(p + 1, q + 1) + brute_match(a, x[p], b, y[q]))

    return 1 + best(0, 0)


def check_alignment(a, b, to):
    """Pairs of equal tags, children under matched parents, in order."""
    for x, y in enumerate(to):
        if y >= 0:
            assert a.label[x] == b.label[y]
            assert x == 0 or to[a.parent[x]] == b.parent[y]
        row = [to[k] for k in a.kids[x] if to[k] >= 0]
        assert row == sorted(set(row))


@pytest.mark.parametrize("cells", [html.TABLE_CELLS, 1])
def test_tree_matching_equals_trying_all(monkeypatch, cells):
    monkeypatch.setattr(html, "TABLE_CELLS", cells)
    rng = random.Random(4)

    def build(depth):
        inner = "".join(build(depth - 1) for _ in range(rng.randint(0, 3))) if depth else rng.choice("ab")
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(150):
        a, b = (html.outline("".join(build(2) for _ in range(3))) for _ in range(2))
        matcher = html.Matcher(b)
        to = matcher.align(a)
        check_alignment(a, b, to)
        assert sum(y >= 0 for y in to) == matcher.weight(a, 0, 0) == brute_match(a, 0, b, 0)


def test_long_and_deep_pages_are_aligned():
    deep = html.outline("<div>" * 4000 + "<p>x")
    deeper = html.outline("<div>" * 4100 + "<p>y")
    assert sum(y >= 0 for y in html.Matcher(deep).align(deeper)) == 4001
    wide = html.outline("".join(f"<p>{i}</p><div>{i}</div>" if i % 3 else f"<p>{i}</p>" for i in range(1500)))
    wider = html.outline("".join(f"<div>{i}</div><p>{i}</p>" for i in range(1600)))
    to = html.Matcher(wide).align(wider)
    check_alignment(wider, wide, to)
    assert sum(y >= 0 for y in to) > 2400


WORDS = "river stone cloud grass light under winter summer carry follow north paper glass tower".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + f" {rng.randrange(10**6)}."


def layouts(rng, i, host):
    """A page that no tag or name explains, and what its article is. Menus, offers and endings differ from page to page."""
    title = f"Title {i} {sentence(rng, 3)}"
    body = [sentence(rng, rng.randint(20, 40)) for _ in range(rng.randint(2, 9))]
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    menu = "".join(f"<li>{rng.choice(WORDS)} {k}</li>" for k in range(rng.randint(3, 6)))
    offer, ending = sentence(rng, 5), sentence(rng, 6)
    share = "<p>Tell your friends about this.</p>"
    kinds = (
        (f"<div class=a1><ul>{menu}</ul></div><div class=b2><h2>{title}</h2>{paragraphs}{share}</div><div class=c3><p>{offer}</p></div>", [title, *body]),
        (f"<div class=q>Welcome to {host}</div><h1>{title}</h1><div class=r><div>{offer}</div><div class=s>{paragraphs}</div></div><div>{ending}</div>", [title, *body]),
        (f"<div id=widget><h2>{title}</h2><section>{paragraphs}</section></div><ul>{menu}</ul><p>{ending}</p>", [title, *body]),
        (f"<section><p>{offer}</p></section><article><h1>{title}</h1>{paragraphs}{share}<div class=comments><p>{sentence(rng, 60)}</p></div></article><div><p>{ending}</p></div>", [title, *body]),
    )
    return kinds


@pytest.mark.parametrize("seed_bytes", [html.SEED_BYTES, -1])
def test_pages_are_read_as_they_were_made(spark, monkeypatch, seed_bytes):
    """Four hosts of a layout each and one that mixes two; the right text is known from how a page was made."""
    monkeypatch.setattr(html, "SEED_BYTES", seed_bytes)
    monkeypatch.setattr(html, "PAGES_PER_KEY", 9)
    rng = random.Random(9)
    rows, want = [], {}
    for kind in range(5):
        for i in range(24):
            made = layouts(rng, i, f"h{kind}")
            source, blocks = made[kind if kind < 4 else 3 * (i % 2)]
            rows.append((len(rows), f"http://h{kind}.org/{i}", page(i, source)))
            want[rows[-1][0]] = "\n".join(blocks)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    assert {i: t for i, t in got.items() if t != want[i]} == {}
    alone = [html.main_text(p) == want[i] for i, _, p in rows]
    assert not any(alone[:72])  # right only with the wrapper


def host_pages(n):
    """Pages without an article element: a constant strap and slogan around what differs."""
    return [
        page(i, f"<div><div class=top>Example site</div><div class=c><h2>Story {i}</h2><p>Text {i} of page.</p><p>More {i}.</p></div><p class=l>Our slogan here</p></div>")
        for i in range(n)
    ]


def texts(spark, pages):
    rows = [(i, "http://a.org/", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_constant_blocks_are_template(spark):
    assert texts(spark, host_pages(5)) == {i: f"Story {i}\nText {i} of page.\nMore {i}." for i in range(5)}
    assert texts(spark, host_pages(2))[0] == "Example site\nStory 0\nText 0 of page.\nMore 0.\nOur slogan here"


def test_copies_of_an_article_do_not_make_it_template(spark):
    copies = [page(i, f"<div class=x>{i}</div><article><h1>Same</h1><p>Same text.</p></article>") for i in range(6)]
    assert set(texts(spark, copies).values()) == {"Same\nSame text."}
    near = [page(i, f"<article><h1>Same {i}</h1><p>Same long text of the article.</p></article>") for i in range(6)]
    assert texts(spark, near) == {i: f"Same {i}\nSame long text of the article." for i in range(6)}


def test_rows(spark):
    rows = [(i, f"http://a.org/{i}", p) for i, p in enumerate(host_pages(40))]
    rows += [(100, None, None), (101, "mailto:x", "<p>y"), (102, "http://b.org", ""), (3, "http://a.org/3", host_pages(40)[3]), (None, "//c.org/", "<p>z")]
    rows += [(103, "http://a.org/x", "<b>other</b> layout"), (3, "http://a.org/3", "<p>other page, same id")]
    pages = spark.createDataFrame([(*r, "x", 2, "k") for r in rows], "page_id long, url string, html string, host string, n int, key string").repartition(4)
    got = html.extract(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert sorted(r.text for r in got if r.page_id == 3) == ["Story 3\nText 3 of page.\nMore 3."] * 2 + ["other page, same id"]
    assert by_id[4].n_chars == len(by_id[4].text)
    assert (by_id[100].text, by_id[101].text, by_id[102].text, by_id[None].text, by_id[103].text) == ("", "y", "", "z", "other layout")
    assert html.extract(pages.limit(0)).count() == 0


def test_wrappers_see_all_pages_of_a_host_and_copies_once(spark):
    pages = host_pages(40)
    # Copies side by side, and one page with a block of a kind that no other page has.
    rare = pages[7].replace("<p>More 7.", "<blockquote>Said once.</blockquote><p>More 7.")
    want = [f"Story {i}\nText {i} of page.\nMore {i}." for i in range(40)] * 6
    assert texts(spark, [*(pages * 6), rare]) == dict(enumerate([*want, "Story 7\nText 7 of page.\nSaid once.\nMore 7."]))
