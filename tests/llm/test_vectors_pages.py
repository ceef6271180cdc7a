import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyfin.llm import ann, html


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[700]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(5000, None, "q"), (5020, [0.0] * 16, "q"), (5040, [float("nan")] + [1.0] * 15, "q"), (5060, [None] + [1.0] * 15, "q"), (5080, [float("inf")] * 16, "q"), (None, [1.0] * 16, "q"), (5100, [1.0] * 3, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-s[i], i))[:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and all(abs(s[v] - c) < 1e-9 for _, v, c in found)
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9


def recall(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, n, hits = {}, len(x), 0
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, n, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    return hits / (20 * len(got))


def test_neighbours_of_uneven_norms(spark):
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    outlier = unit.copy()
    outlier[7] *= 4
    assert recall(spark, outlier) >= 0.9
    assert recall(spark, unit * rng.lognormal(0, 0.5, size=(3000, 1))) >= 0.9
    assert recall(spark, unit * rng.choice([1e-200, 1e-3, 1.0, 3.0], p=[0.1, 0.3, 0.5, 0.1], size=(3000, 1))) >= 0.9


def test_clustered_vectors_score_few(spark, monkeypatch):
    """On clusters at most a third of a scan's inner products, with the recall held; heavy buckets split by salts give the same."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 64))[rng.integers(0, 100, 5000)] + 0.4 * rng.normal(size=(5000, 64))
    assert recall(spark, x) >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.scored_share(df) <= 1 / 3
    plain = sorted(map(tuple, ann.nearest_neighbours(df).collect()))
    monkeypatch.setattr(ann, "ROWS_PER_SALT", 40)
    assert sorted(map(tuple, ann.nearest_neighbours(df).collect())) == plain


def test_vectors_without_structure(spark):
    """No more inner products than a scan, and the recall held."""
    x = np.random.default_rng(7).normal(size=(4000, 64))
    assert recall(spark, x) >= 0.9
    assert ann.scored_share(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")) <= 1


def test_few_vectors(spark):
    df = spark.createDataFrame([(20 * i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(df).groupBy("query_id").count().filter("count = 4").count() == 5
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.limit(1)).count() == 0


def page(rng, body, comments=True):
    word = lambda: rng.choice("alpha beta gamma delta omega".split())
    menu = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(5))
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>{menu}</ul></nav><div class=ad>{word()} now</div>"
        f"<div class='story'>{body}</div>" + ("<div id='comments'><p>I agree</p></div>" if comments else "") + f"<aside>{word()}</aside><footer>&copy; {word()}</footer></body></html>"
    )


def test_pages(spark):
    rng = random.Random(2)
    bodies = {i: f"<h1>Head {i}</h1><p>One  &amp; two<br>three {i * i}\n four<p><b>last</b> {'word ' * (i % 5)}</p><form>x</form>" for i in range(40)}
    rows = [(i, f"http://h{i % 3}.example.com/{i}", page(rng, b)) for i, b in bodies.items()]
    rows += [(100, None, None), (101, "x", ""), (102, "http://lone.example.com", "<p>only <i>one</i><!-- no --><script>no"), (103, "http://a.b", "<header>no</header><article><header><h1>head</h1><nav>no</nav></header>yes<nav>no</nav></article>out"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for i in bodies:
        want = f"Head {i}\nOne & two three {i * i} four\n" + " ".join(["last", *["word"] * (i % 5)])
        assert texts[i] == want
    assert (texts[100], texts[101], texts[102], texts[103]) == ("", "", "only one", "head\nyes\nout")
    found = {r.host: r.template for r in html.templates(df.select(html.host_of(F.col("url")).alias("host"), "html")).collect()}
    assert set(found) == {f"h{k}.example.com" for k in range(3)}
    tokens, texts = html.parse(rows[1][2])
    place = {t & (1 << 64) - 1: k for k, t in enumerate(found["h1.example.com"])}
    held = [place[t] for t in tokens if t in place]
    assert held == sorted(held) and len(held) >= 8  # html, body, nav, div.ad, div.story, h1, ... in order
    assert html.extract_pages(df.limit(0)).count() == 0


def test_pages_keep_all_text(spark):
    rng, rows = random.Random(3), []
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(99)) for _ in range(n))
    want = {}
    for i in range(60):
        head, lead, body, item, odd = say(2), say(4), [say(60), say(60)], say(5), say(200)
        paragraphs = "".join(f"<p>{p}</p>" for p in body)
        menu = f"<nav>{say(2)}</nav><div class=x1><div class=x2>Skip to content</div></div>"
        extra = f"<div class=odd>{odd}</div>" if i == 12 else ""
        split = f"<div class=page><h1>{head}</h1><div class=lead>{lead}</div><div class=body><h2>Story</h2>{paragraphs}</div></div>{extra}"
        featured = f"<div class=page><h1>{head}</h1><article>{item}</article><div class=body>{paragraphs}</div></div>"
        rows.append((i, f"http://h{i % 2}.example.com/{i}", f"<html><body>{menu}{split if i % 2 == 0 else featured}<footer>{say(3)}</footer></body></html>"))
        want[i] = "\n".join([head, lead, "Story", *body, *([odd] if extra else [])] if i % 2 == 0 else [head, item, *body])
    rows.append((60, "http://lone.example.com", "<article>item</article><div>" + "word " * 50 + "</div>"))
    want[60] = "item\n" + ("word " * 50).strip()
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_template_words_are_left_out(spark):
    """Constant text outside any marked furniture goes by the template alone; without it, it would stay."""
    rng, rows, want = random.Random(8), [], {}
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(99)) for _ in range(n))
    for i in range(20):
        head, body, ad = say(3), [say(9), say(8)], "" if i % 2 else "<span class='x advert'>BUY NOW</span>"
        rows.append((i, "http://h.example.com/" + str(i), f"<body><div class=page><div>Site name</div><h1>{head}</h1><h2>Story</h2><p>{body[0]}{ad}</p><p>Share this text</p><p title='hidden gem'>{body[1]}</p><div>A legal line on <b>every</b> page</div></div></body>"))
        want[i] = "\n".join([head, "Story", *body])
    rows += [(20, rows[0][1], rows[0][2])] * 3  # repeated rows
    want[20] = want[0]
    rows.append((21, "http://h.example.com/none", "<body><div class=page><div>Site name</div></div></body>"))
    want[21] = "Site name"  # nothing in the slots: the page's own text
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_pages(df).collect()} == want
    assert "Site name" in [t for _, t in html.slots(rows[0][2], None)]


def test_vectors_by_brute_force(spark):
    rng, rows = random.Random(9), []
    for i in range(30):
        site = "<main>site</main>" if i % 5 else ""
        rows.append((f"h{i % 2}", site + "".join(f"<{rng.choice(['p', 'div', 'ul'])}>{rng.choice('abc')}" for _ in range(rng.randrange(9)))))
    rows += rows[:3] + [("h0", None), ("h0", "")]
    vectors, of = {}, {}
    for k, (host, page) in enumerate(rows):
        tokens = html.parse(page or "")[0]
        of[host] = of.get(host, 0) + 1
        for t in set(tokens):
            if tokens.count(t) == 1:
                vectors.setdefault((host, t), []).append(k)
    classes = {}
    for (host, t), pages in vectors.items():
        if len(pages) >= 0.3 * of[host]:
            classes.setdefault((host, tuple(pages)), set()).add(t)
    want = {(host, frozenset(c)) for (host, _), c in classes.items() if len(c) >= 2}
    out = next(html._tokens(iter([pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows]), pa.array([p for _, p in rows])], ["host", "html"])]))).to_pylist()
    assert {(r["host"], r["pages"]) for r in out if r["token"] == html.PAGE} == set(of.items())
    got = {}
    for r in out:
        if r["token"] != html.PAGE and r["pages"] >= 0.3 * of[r["host"]]:
            got.setdefault((r["host"], r["pages"], r["a"], r["b"]), set()).add(r["token"] & (1 << 64) - 1)
    assert want == {(k[0], frozenset(c)) for k, c in got.items() if len(c) >= 2} and want


def test_classes_nest_by_position():
    outer, inner, cut = (10, [(0, 1), (5, 2), (9, 3)]), (9, [(6, 4), (7, 5)]), (8, [(4, 6), (6.5, 7)])
    assert html.nest([cut, inner, outer]) == [1, 2, 4, 5, 3]


def test_names_of_furniture_are_whole_words():
    kept = ['class="ad-hoc-report"', 'id="search-algorithms"', 'class="related-work"', 'class="navigational shareholders"', 'class="cookie-recipe"', 'role="note"']
    gone = ['class="ad"', 'class="x advert"', 'class="site-footer"', 'id="comment_list"', 'class="main-nav"', 'role="navigation"', "class='cookie-notice-wrapper'", "hidden", 'aria-hidden="true"']
    for name, stays in [*((k, True) for k in kept), *((g, False) for g in gone)]:
        assert html.slots(f"<p>one</p><div {name}>two</div>", None) == [(-1, "one"), *([(-1, "two")] if stays else [])], name


def test_nothing_is_dropped_for_a_share_of_the_page():
    """Text outside article and main stays, however much is inside; an article's own header is part of it, the page's is not."""
    inside = "".join(f"<p>{'word ' * k}</p>" for k in (3, 30, 300))
    got = [t for _, t in html.slots(f"<header>top</header><article><header><h1>Title</h1></header>{inside}</article><div><p>Second part of story</p></div><footer>end</footer>", None)]
    assert got[0] == "Title" and got[-1] == "Second part of story" and len(got) == 5


def test_nesting_by_brute_force():
    """Classes are taken by size; one is left out just if it cuts across one taken before."""
    rng = random.Random(7)

    def nested(x, y):
        gaps = lambda a, b: {sum(m < n for m in a) for n in b}
        return len(gaps(x, y)) == 1 or len(gaps(y, x)) == 1

    for _ in range(300):
        places = rng.sample(range(100), 24)
        classes, at = [], 0
        while at < 22:
            size = rng.randrange(2, 6)
            classes.append((rng.randrange(5, 9), [(float(p), 1000 + p) for p in places[at : at + size]]))
            at += size
        taken = []
        for n, members in sorted(((n, sorted(m)) for n, m in classes), key=lambda c: (-c[0] * len(c[1]), c[1])):
            if all(nested(members, t) for t in taken):
                taken.append(members)
        assert html.nest(classes) == [t for _, t in sorted(m for c in taken for m in c)]


def test_slots_by_brute_force():
    """The page's tokens of the template are the longest run of them in the template's order; all else is in a slot."""
    import itertools

    rng = random.Random(11)
    for _ in range(150):
        blocks = [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 9))]
        page = "".join(f"<p>{b}" for b in blocks)
        tokens, found = html.parse(page)
        words = {t: b for t, b in zip([t for i, t in enumerate(tokens) if any(f[0] == i for f in found)], blocks)}
        order = rng.sample(sorted(set(words)), rng.randrange(len(set(words)) + 1))
        template = {t: i for i, t in enumerate(order)}
        once = [template[t] for t in tokens if t in template and tokens.count(t) == 1]
        longest = max((len(c) for n in range(len(once) + 1) for c in itertools.combinations(once, n) if list(c) == sorted(c)), default=0)
        got = [t for _, t in html.slots(page, template)]
        assert len(got) == (len(blocks) - longest if 0 < longest < len(blocks) else len(blocks))


def test_pages_without_marked_furniture_lose_it_by_the_template(spark):
    """Nothing but div, p and h1: what repeats over a host's pages goes, what is a page's own stays, on every page."""
    rng, rows, want = random.Random(13), [], {}
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(9999)) for _ in range(n))
    for i in range(40):
        own = [say(4), say(20), say(15)]
        top = f"<div><div>Home</div><div>About {i % 2}</div><div>Contact us</div></div>"
        body = f"<div><h1>{own[0]}</h1><p>{own[1]}</p><div><p>Read more below</p></div><p>{own[2]}</p></div>"
        rows.append((i, f"https://h{i % 2}.example.com/{i}", f"<body>{top}{body}<div><p>All of this site belongs to somebody</p></div></body>"))
        want[i] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    alone = {i: "\n".join(t for _, t in html.slots(page, None)) for i, _, page in rows}
    assert got == want and sum(alone[i] != got[i] for i in got) == 40


def test_very_deep_and_odd_markup():
    page = "<div class=a>" * 100_000 + "deep" + "</b></div>" * 100_000 + "<p>end"
    assert [t for _, t in html.slots(page, None)] == ["deep", "end"]
    assert [t for _, t in html.slots("<p>a<!-- x > -- y --><b title='>'>b</b> &lt;c&gt;<p>" + "<a =\"" * 50_000, None)] == ["ab <c>"]
    assert [t for _, t in html.slots("1 < 2 <3<br/>x</nope>y<td>z<span class=ad>no<div>no</div></span>!", None)] == ["1 < 2 <3 xy", "z!"]
    assert html.slots("<" * 100_000, None) and html.slots("<!--" * 50_000, None) == []
