"""Page extraction and nearest neighbours."""

import numpy as np

from depweave.llm import ann, html_extract

SITE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var x = "</p>";</script></head><body><header>Site name</header><nav><ul>{links}</ul></nav>
<div class="ad">Buy {t}</div><div class="main-col">{lead}<article><h1>{t} &amp; co</h1><p>First   {t}<br>goes on.<p>Second <b>bold</b> {t}.</p>{extra}<h6>Read our terms</h6></article></div>
<aside>More {t}</aside><section id="comments"><p>Reader {t}</p></section><form><p>Sign up {t}</p></form><footer>&copy; {t}</footer></body></html>"""


def page(i, extra=""):
    return SITE.format(t=f"topic{i}", links="".join(f"<li><a href=/{k}>l{k}</a></li>" for k in range(i % 4 + 1)), lead="", extra=extra)


def test_wrapper_and_text(spark):
    rows = [(i, f"http://Host.example/{i}", page(i, f"<blockquote>quoted {i}</blockquote>" if i % 2 else "")) for i in range(8)]
    rows += [(100, None, None), (101, "http://host.example/x", ""), (102, "http://other.example/", "<p>Only <p>text &lt;here&gt; <a href=x>y</a>"), (102, "http://other.example/", "<p>Only <p>text &lt;here&gt; <a href=x>y</a>"), (103, "http://host.example/y", "<article>open <b>end")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    want = {i: f"topic{i} & co\nFirst topic{i} goes on.\nSecond bold topic{i}." + (f"\nquoted {i}" if i % 2 else "") for i in range(8)}
    want |= {100: "", 101: "", 102: "Only\ntext <here> y", 103: "open end"}
    assert len(got) == len(rows)
    assert {(i, t) for i, t, _ in got} == set(want.items()) and all(n == len(t) for _, t, n in got)
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract_pages(none).count() == 0


def test_wrapper_forms():
    w = html_extract.infer([page(i, "<hr>" if i == 2 else "") for i in range(6)])
    text = str(w)
    assert "'ul', '1', [['li', '+'" in text and "['hr', '?'" in text and "['#', '1', 'Read our terms', 6]" in text and "['#', '1', None, " in text


COPY = "<html><script>track({i});</script><body><!-- ad {i} --><nav><a>l{i}</a></nav><article><h1>One headline of a copied article</h1><p>One paragraph of a copied article.</p></article></body></html>"


def test_copies_are_one_content(spark):
    """Copies that differ in scripts, comments and menus agree on nothing; a late page counts as much as the first."""
    rows = [(i, "http://copies.example/", COPY.format(i=i)) for i in range(20)]
    # many copies beside few articles, of which a notice is shared
    rows += [(100 + i, "http://mixed.example/", COPY.format(i=i).replace("</article>", "<h6>Notice</h6></article>")) for i in range(20)]
    rows += [(200 + i, "http://mixed.example/", page(i).replace("Read our terms", "Notice")) for i in range(5)]
    deep = "<div>" * 1500 + "deep"
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame([*rows, (300, "http://deep.example/", deep)], "page_id bigint, url string, html string").repartition(5)).collect()}
    copy = "One headline of a copied article\nOne paragraph of a copied article."
    assert all(got[i] == copy for i in range(20))
    assert all(got[100 + i].startswith(copy) for i in range(20)) and got[300] == "deep"


def test_common_keys_in_order():
    """The short way of the alignment finds what the search finds."""
    rnd = np.random.default_rng(5)
    place = lambda k: [k, "1", []]
    for _ in range(300):
        long = [place("abc"[i]) for i in rnd.integers(0, 3, 8)]
        short = [long[i] for i in np.flatnonzero(rnd.random(8) < 0.6)]
        within, html_extract._within = html_extract._within, lambda *_: None
        want = html_extract.align(long, short), html_extract.align(short, long)
        html_extract._within = within
        assert (html_extract.align(long, short), html_extract.align(short, long)) == want


def brute(rows, k):
    out = {}
    for q, v in rows:
        scored = sorted((-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), i) for i, w in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest(spark):
    rnd = np.random.default_rng(0)
    rows = [(int(i), rnd.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a group of equal vectors
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, []), (None, rows[1][1])]
    df = spark.createDataFrame(rows + bad + [rows[3]], "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, df["vec_id"] % 10 == 0, 5, shard_rows=300).collect()
    want = brute([(i, np.array(v, np.float64)) for i, v in rows], 5)
    asked = [i for i, _ in rows if i % 10 == 0]
    assert {r.query_id for r in got} == set(asked)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in asked) >= 0.95 * 5 * len(asked)
    assert found[0] == want[0] == [1000, 1001, 1002, 1003, 1004]
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>")
    assert ann.nearest(few, few["vec_id"] == 0, 5).count() == 2
    assert ann.nearest(few.filter("false"), few["vec_id"] == 0, 5).count() == 0


def test_graph_recall():
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(1500, 24)).astype(np.float32)
    g = ann.Graph.build(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        best = set(np.argsort(-(unit @ unit[q]))[:5].tolist())
        hits += len(best & set(g.search(vectors[q], 5)))
    assert hits >= 0.9 * 5 * 30


def test_all_magnitudes_and_repeated_ids(spark):
    """Components of any size keep their cosine in double precision; of two vectors under a queried id the smaller one asks."""
    rows = [(0, [1e-60, 1e-60]), (1, [1e300, 1e300]), (2, [5e-324, 0.0]), (3, [0.0, 1e-310]), (4, [3.0, -3.0]), (50, [2.0, 1.0]), (50, [1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df["vec_id"] % 50 == 0, 3).collect()
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert found[0, 1][0] == 1 and abs(found[0, 1][1] - 1) < 1e-15 and abs(found[0, 2][1] - 3 / 10**0.5) < 1e-15 and found[0, 2][0] == 50
    assert found[50, 1][0] == 3 and abs(found[50, 1][1] - 9 / 82**0.5) < 1e-15


INSIDE = (
    '<article><h1>T</h1><h2>Summary</h2><section id="social-history"><p>one</p></section><div class="search party"><p>two {k}</p></div><p class="share">three</p>'
    '<div class="comments"><p>reader</p></div><div class="share"><a href=x>Tweet</a></div><p><a href=y>all link</a></p><nav>n</nav></article>'
)


def test_nothing_inside_an_article_is_dropped(spark):
    """Headings that pages share, doubtful names with text of their own and paragraphs of links stay; comments and bars of links go."""
    rows = [(k, f"http://h/{k}", "<body><header>Site</header>" + INSIDE.replace("{k}", f"{k} " * (k + 1)) + "</body>") for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {k: "\n".join(["T", "Summary", "one", "two " + " ".join([str(k)] * (k + 1)), "three", "all link"]) for k in range(8)}


def test_wrappers_locate_the_article(spark):
    """On pages without an article element or telling names the slots say where it is, so that leaving wrappers out changes the text."""
    page = (
        "<body><div class=a1><p>Our site says welcome to all</p></div><div class=a2><div class=a3><p>All about birds, daily</p></div><div class=a4><h1>Title {k}</h1><p>{w} and more {w}.</p><h2>Summary</h2><p><a href=z>a link alone</a></p><p>{w} ends {w}.</p></div></div>"
        "<div class=a5><p>Imprint and all the rest</p></div></body>"
    )
    words = ["swift", "heron", "stork", "eagle", "robin", "finch", "raven", "crane"]
    rows = [(k, f"http://h/{k}", page.format(k=k, w=w * (k + 1))) for k, w in enumerate(words)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for k, (_, _, html) in enumerate(rows):
        w = words[k] * (k + 1)
        assert got[k] == f"Title {k}\n{w} and more {w}.\nSummary\na link alone\n{w} ends {w}."
        assert html_extract.extract(html, None) != got[k] and "welcome" in html_extract.extract(html, None)


def test_deep_pages(spark):
    deep = "<p>top</p>" + "<div>" * 60_000 + "deep text" + "</div>" * 60_000 + "<p>end</p>"
    rows = [(1, "http://h/1", deep), (2, "http://h/2", "<div>" * 6000 + "open"), (3, "http://h/3", "<b>" * 6000 + "bold")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: "top\ndeep text\nend", 2: "open", 3: "bold"}
