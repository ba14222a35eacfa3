import html as entities
import random
import re

import pytest

from placemill.llm import wrappers
from placemill.llm.wrappers import HostWrapper, Node, Page, step, way


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")


def extract(spark, rows):
    return {r.page_id: r for r in wrappers.extract(pages(spark, rows)).collect()}


def wrapper(*htmls):
    w = HostWrapper()
    for h in htmls:
        w.add(h)
    return w


def shape(*htmls):
    return wrapper(*htmls).expression()


def place(path):
    state = wrappers.START
    for key in path.split("/")[1:]:
        state = step(state, key)
    return state[0]


def test_wrapper_of_three_pages():
    pages = ["<body><h1>a</h1>" + "<p>x</p>" * n + "</body>" for n in (1, 3)]
    assert shape(*pages, "<body><h1>b</h1><div class=ad>buy</div><p>z</p></body>") == "<><body><h1>#</h1> <div .ad>#</div>? <p>#</p>+</body></>"


def test_repeated_groups_and_options():
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == shape("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<><dl>(<dt>#</dt> <dd>#</dd>)+</dl></>"
    assert shape("<ul><li>a<li><b>b</b><p>c</ul>") == "<><ul><li># <p>#</p>?</li>+</ul></>"
    assert shape("<h1>a</h1><p>b</p><h2>c</h2>", "<h1>a</h1><h2>c</h2>") == "<><h1>#</h1> <p>#</p>? <h2>#</h2></>"
    assert shape("<main>" + "<p>a</p><h2>b</h2><p>c</p><ul></ul>" * 3 + "".join(f"<div class=x{c}></div><p>y</p>" for c in "abcdefghijklmnopqrstuvwxyz") + "</main>").count("(") == 1


def pattern(node):
    """A child list as a regular expression over names, each followed by a semicolon."""
    out = ""
    for k in node.kids:
        inner = pattern(k) if k.key in ("()", "*") else f"(?:{re.escape(k.key)};)"
        out += f"(?:{inner})" + {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[k.least, k.most]
    return out


def test_expression_takes_every_page_it_learned_from():
    rnd = random.Random(1)
    for _ in range(200):
        lists = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(6)]
        htmls = ["".join(f"<x{n}></x{n}>" for n in names) for names in lists]
        one, two = wrapper(*htmls[:3]), wrapper(*htmls[3:])
        for w, some in ((one, lists[:3]), (two, lists[3:])):
            assert all(re.fullmatch(pattern(w.root), "".join(f"x{n};" for n in names)) for names in some)
        two.merge(HostWrapper.load(one.dump()))
        assert all(re.fullmatch(pattern(two.root), "".join(f"x{n};" for n in names)) for names in lists)
        for names in lists:  # each element has an entry of its name
            targets, changed = two._aligned(two.root, tuple(f"x{n}" for n in names), False)
            assert not changed and [t.key for t in targets] == [f"x{n}" for n in names]


def slow_cost(leaves, names):
    """The cost of the cheapest way by trying all of them."""

    def need(some):
        return sum(1 for x, g in some if x.least and (g is None or g.least))

    def rest(p, names):
        if not names:
            return need(leaves[p:])
        best = wrappers.LACKS + rest(p, names[1:])
        for j, (x, g) in enumerate(leaves):
            if x.key != names[0]:
                continue
            if j >= p:
                best = min(best, need(leaves[p:j]) + rest(j + 1, names[1:]))
            elif g is not None and g.most == 2 and leaves[p - 1][1] is g:
                own = [k for k in range(len(leaves)) if leaves[k][1] is g]
                best = min(best, wrappers.AGAIN + need([leaves[k] for k in own if k >= p or k < j]) + rest(j + 1, names[1:]))
        return best

    return rest(0, names)


def test_ways_against_all_ways():
    rnd = random.Random(3)
    for _ in range(300):
        parent = Node("")
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.4:
                group = Node("()", rnd.randint(0, 1), 2)
                group.kids = [Node(rnd.choice("abc"), rnd.randint(0, 1), 1) for _ in range(2)]
                parent.kids.append(group)
            else:
                parent.kids.append(Node(rnd.choice("abc"), rnd.randint(0, 1), rnd.randint(1, 2)))
        names = [rnd.choice("abcd") for _ in range(rnd.randint(0, 5))]
        cost, route = way(parent.leaves(), names)
        assert abs(cost - slow_cost(parent.leaves(), names)) < 1e-9
        assert len(route) == len(names) and all(j < 0 or parent.leaves()[j][0].key == n for j, n in zip(route, names, strict=True))


def test_merging_counts_as_learning_does():
    rnd = random.Random(2)
    some = ["<body>" + "".join(rnd.choice(["<p>t</p>", "<div><p>u</p></div>", "<ul><li>v</ul>", "<h2>w</h2>"]) for _ in range(rnd.randint(0, 6))) for _ in range(30)]
    one, two, three = wrapper(*some), wrapper(*some[::2]), wrapper(*some[1::2])
    two.merge(HostWrapper.load(three.dump()))
    count = lambda w: (w.root.seen, sum(n.chars for n in w.nodes()))
    assert count(one) == count(two) == (30, sum(len(t[1]) for h in some for t in one.texts(Page(h))[0]))


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "deep words"
    w = wrapper(deep, "<div>" * 4000 + "less deep")
    w.merge(HostWrapper.load(wrapper(deep).dump()))
    assert w.decide().extract(deep) == "deep words" and w.expression().count("<div>") == 5000
    rnd = random.Random(1)
    wide = "<main>" + "".join(rnd.choice(["<p>t</p>", "<div>u</div>", "<h2>q</h2>"]) for _ in range(20000)) + "</main>"
    assert len(wrapper(wide, wide[:90000]).decide().extract(wide).split()) == 20000


def test_rarest_entries_go_first(monkeypatch):
    monkeypatch.setattr(wrappers, "MAX_NODES", 60)
    page = lambda k: f"<body><div class=top>same</div><p>words {k}</p><div class=x{chr(97 + k % 26)}{chr(97 + k // 26)}>own {k}</div></body>"
    w = wrapper(*map(page, range(200)))
    assert w.size <= 61
    assert w.decide().extract(page(150)) == "words 150 own 150"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><p>One <b>two</b>three<p>Four&nbsp;five<br>six</article>", "One twothree Four five six"),
        ("<article>a<script>var t='</p>';</script>b<style>p{}</style> c<!-- no --> d</article>", "ab c d"),
        ("<main><h1>T &amp; &lt;u&gt; &#233; &#x41; &am</h1><p>x</main>", "T & <u> é A &am x"),
        ("<article><p>a</p><div class='share-box'>s</div><aside>n</aside><form>f</form><p>b</p></article>", "a b"),
        ("<article><p>a</p><section id='comments'><p>c</p></section></article><div class=comments><p>c</p></div>", "a"),
        ("<header><h1>Site</h1></header><nav>n</nav><article><header><h1>Head</h1></header><p>x</article><footer>f", "Head x"),
        ("<div role=main><p>x</p></div><div class='cookie-notice'>ok?</div>", "x"),
        ("<article><p>a < b && c</p></article>", "a < b && c"),
        ("<article><p hidden>h</p><p style='display: none'>n</p><p aria-hidden=true>n</p><p>x", "x"),
        ("<ARTICLE><P>Up</P><SCRIPT>x</SCRIPT></ARTICLE>", "Up"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
        ("<article><p>cut<p cl", "cut"),
        ("", ""),
        ("plain only", "plain only"),
        ("<script>x", ""),
    ],
)
def test_main_text(spark, html, want):
    r = extract(spark, [(1, "http://a.test/x", html)])[1]
    assert (r.text, r.n_chars, r.url) == (want, len(want), "http://a.test/x")


def test_template_text_without_an_article(spark):
    rows = [(i, f"http://h.test/{i}", f"<body><div class=top>Same words</div><div><p>Story number {i} is long enough</p></div><div><a href=/>more</a> <a href=/>links</a></div></body>") for i in range(8)]
    assert {i: r.text for i, r in extract(spark, rows).items()} == {i: f"Story number {i} is long enough" for i in range(8)}


def test_articles_and_pages_without(spark):
    rows = [(1, "http://h.test/1", "<article><p>x</article>"), (2, "http://h.test/2", "<body><p>y</p>")]
    assert {i: r.text for i, r in extract(spark, rows).items()} == {1: "x", 2: "y"}


def test_odd_rows(spark):
    rows = [(1, None, "<article>a</article>"), (2, "http://a.test", None), (None, "http://a.test", "<article>b"), (4, "http://a.test", "<article>" + "<p>long text</p>" * 30000), (4, "http://a.test", "<article>again")]
    got = wrappers.extract(pages(spark, rows)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.n_chars) for r in got) == [(False, 1, 1), (False, 2, 0), (False, 4, 5), (False, 4, 299999), (True, 0, 1)]


def test_empty_table(spark):
    assert wrappers.extract(pages(spark, [])).count() == 0


def test_states():
    assert place("/html/body/article .post/p") == "in"
    assert place("/html/body/article/div .ad-slot/p") == "out"
    assert place("/html/body/div #header/p") == "out"
    assert place("/html/body/div .download/p") == "open"


def test_rows_come_through_the_wrapper(spark):
    """The same page under the wrappers of two hosts: only the one whose pages all have the line knows it for template."""
    page = "<body><div class=top>Same words</div><div><p>Story number 3 is long enough</p></div></body>"
    rows = [(i, f"http://a.test/{i}", page.replace("3", str(i))) for i in range(8)] + [(i, f"http://b.test/{i}", page.replace("3", str(i)) if i == 13 else f"<body><div class=top>Top {i}</div><div><p>Other {i}</p></div></body>") for i in range(10, 18)]
    got = extract(spark, rows)
    assert got[3].text == "Story number 3 is long enough"
    assert got[13].text == "Same words Story number 13 is long enough"
    swapped = HostWrapper().decide()
    assert swapped.extract(page) == "Same words Story number 3 is long enough"


def test_lines_in_a_repeated_slot(spark):
    rows = [(i, f"http://h.test/{i}", f"<body><p>Story number {i} opens</p><p>All rights belong to us</p><p>and ends with {i * i}</p></body>") for i in range(8)]
    assert {i: r.text for i, r in extract(spark, rows).items()} == {i: f"Story number {i} opens and ends with {i * i}" for i in range(8)}


def test_slots_of_one_path_are_told_apart(spark):
    """Two slots with one tag path: the wrapper's order tells the constant one."""
    rows = [(i, f"http://h.test/{i}", f"<body><p>Welcome to our site</p><h2>Title {i}</h2><p>Story number {i}</p></body>") for i in range(8)]
    assert {i: r.text for i, r in extract(spark, rows).items()} == {i: f"Title {i} Story number {i}" for i in range(8)}


def test_copies_of_a_page(spark):
    rows = [(i, f"http://h.test/{i}", "<body><h1>One story</h1><p>told by all six pages</p></body>") for i in range(6)]
    assert {r.text for r in extract(spark, rows).values()} == {"One story told by all six pages"}


def test_deep_page_among_others(spark):
    rows = [(1, "http://h.test/1", "<div>" * 5000 + "deep"), (2, "http://h.test/2", "<body><p>flat</p></body>")]
    assert {i: r.text for i, r in extract(spark, rows).items()} == {1: "deep", 2: "flat"}


def test_wrappers_by_shuffle(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    some = sorted(map(tuple, wrappers.extract(df).collect()))
    assert some == sorted(map(tuple, wrappers.extract(df, sent_bytes=0).collect())) and len(some) == df.count()
    assert some == sorted(map(tuple, wrappers.extract(df.repartition(7)).collect()))


def test_generated_pages(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)


def test_words_on_what_holds_the_article(spark):
    cases = [
        ("<body class='right-sidebar'><article><p>a</article>", "a"),
        ("<body class='has-sidebar'><p>a</body>", "a"),
        ("<body><div class='content with-sidebar'><article><p>a</article><div class=sidebar>s</div></div>", "a"),
        ("<body><div class='right-sidebar-layout'><article><p>a</article></div><div class=footer>f</div>", "a"),
        ("<article class='post comment-open'><p>a</article>", "a"),
        ("<body><form><div><article><p>a</article></div></form>", "a"),
        ("<body><form><p>a</p></form><nav>n</nav>", "a"),
        ("<article><p>a</p><section class=legal><p>b</p></section><div class='related-work'><p>c</p></div><div class=social><a href=/>s</a></div></article>", "a b c"),
        ("<article><p>a</article><aside><article>teaser</article></aside><div class='related-posts'><article>t</article></div>", "a"),
        ("<body><nav>n</nav><footer>f</footer>", ""),
    ]
    rows = [(i, f"http://h{i}.test/", html) for i, (html, _) in enumerate(cases)]
    assert {i: r.text for i, r in extract(spark, rows).items()} == {i: want for i, (_, want) in enumerate(cases)}
