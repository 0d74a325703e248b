import random

from pyspark.sql import Row

from quarry.llm import decontaminate, html_extract, url_filter
from tests.llm.corpus import SCHEMA, documents, prose

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a>menu</a></li></ul></nav><div id="cookie-notice">We use</div><main><article><h1>A &lt;b&gt;</h1><p>one
 two<p>three<span class="ad">buy</span> four<br>five</p><script>var t="</p>";</script><ul><li>i1<li>i2</ul><table><tr><td>c1<td>c2</table>
<aside>side</aside><form>f<input></form><section class="comments"><p>hi</p></section></article></main><div class="sidebar">s</div><footer>f</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_extract.extract(PAGE, None) == "A <b>\none two\nthree four five\ni1\ni2\nc1\nc2"


def test_cut_and_broken_pages():
    assert html_extract.extract("<article><p>a &amp; b</p><p>c &am", None) == "a & b\nc &am"
    assert html_extract.extract('<article><p>a<p cla', None) == "a"
    assert html_extract.extract("<article><p title='x>y\">a < b</p>", None) in ("a < b", "y\">a < b", "")
    assert html_extract.extract(None, None) == html_extract.extract("", None) == ""
    assert html_extract.extract("plain  text", None) == "plain text"


def test_wrapper_finds_template_and_groups():
    pages = [f'<body><div class="top">Welcome</div><div class="content">{"".join(f"<p>text {i} {k}</p>" for k in range(i % 3 + 1))}</div><div>Copyright</div></body>' for i in range(8)]
    wrapper = html_extract.infer(pages)
    assert html_extract.extract(pages[4], wrapper) == "text 4 0\ntext 4 1"
    keys = [html_extract._key(n) for n in wrapper["regex"]]
    assert "+(p # /p)" in keys and not any(k.startswith("?") for k in keys)


def test_slots_of_the_wrapper_decide():
    # one place, three slots: the notice stands in every third page only, and one page has the notice's words as its own text
    notes = [f"<body><h2>{i} title</h2>{'<p>Notice</p>' if i % 3 == 0 else ''}<hr><div>x{i}</div><p>{'Notice' if i == 1 else f'text {i}'}</p></body>" for i in range(15)]
    wrapper = html_extract.infer(notes)
    assert [html_extract.extract(notes[i], wrapper) for i in (0, 1, 3)] == ["0 title\nx0\ntext 0", "1 title\nx1\nNotice", "3 title\nx3\ntext 3"]
    # in articles too a text that all pages have at its slot is template; copies of one article keep their text
    articles = [f"<article><h1>{i}</h1><p>long {i}</p><div>Share this</div></article>" for i in range(6)]
    assert html_extract.extract(articles[2], html_extract.infer(articles)) == "2\nlong 2"
    copies = [f"<nav>{i}</nav><article><h1>A</h1><p>b</p></article>" for i in range(6)]
    assert html_extract.extract(copies[2], html_extract.infer(copies)) == "A\nb"
    # a menu without marks is one repeated group of several constant texts
    menus = [f"<ul><li>Home</li><li>About</li><li>Contact</li></ul><p>text {i}</p>" for i in range(5)]
    assert html_extract.extract(menus[3], html_extract.infer(menus)) == "text 3"


def test_main_text_of_tables(spark):
    rows = [(1, "http://a.com/1", PAGE), (1, "http://a.com/1", PAGE), (2, None, "<p>x</p>"), (3, "nope", None), (None, "http://a.com/2", ""), (4, "http://A.com:80/3", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS rest", "'d' AS host", "1 AS wrapper", "2 AS text")
    got = html_extract.main_text(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got) == sorted([41, 41, 1, 0, 0, 249_999])
    assert html_extract.main_text(pages.where("false")).count() == 0


def test_all_pages_of_a_host_count(spark):
    # a notice on 5 of 400 pages, a text that 5 of 400 pages lack, a host of three pages, and a menu group of 15 nodes
    rows = [(i, f"http://a.com/{i}", f"<body><h2>{i} t</h2>{'<p>Notice</p>' if i % 80 == 7 else ''}<hr><div>{'rare' if i % 80 == 9 else 'Often'}</div><p>text {i}</p></body>") for i in range(400)]
    rows += [(1000 + i, f"http://b.com/{i}", f"<div>Top</div><h2>{i}</h2>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    want = {i: f"{i} t\n{'rare' if i % 80 == 9 else 'Often'}\ntext {i}" for i in range(400)} | {1000 + i: f"{i}" for i in range(3)}
    assert got == want
    item = "<div>" + "".join(f"<h{k}>a</h{k}>" for k in range(1, 6)) + "</div>"
    assert [n[0] for n in html_extract.fold(html_extract.layout(item * 3)[1])] == ["+"]
    host = [r[2] for r in rows[:400]]
    wrapper = html_extract.infer(host)
    assert [html_extract.extract(p, wrapper) for p in host] == [want[i] for i in range(400)]


def test_wide_wrappers_take_all_pages(spark, monkeypatch):
    # parts of 300 nodes that no other page has, and a notice and an own text of one place that only the last pages have
    part = lambda i: "".join(f'<div class="u{i}x{k}">own {i} {k}</div>' for k in range(100))
    host = [f"<body>{part(i)}<h2>{i} t</h2>{'<p>Notice</p>' if i > 11 and i % 2 else ''}<div>x{i}</div><h3>y{i}</h3>{f'<p>text {i}</p>' if i > 11 and not i % 2 else ''}</body>" for i in range(20)]
    want = ["\n".join([*(f"own {i} {k}" for k in range(100)), f"{i} t", f"x{i}", f"y{i}", *([f"text {i}"] if i > 11 and not i % 2 else [])]) for i in range(20)]
    wrapper = html_extract.infer(host)
    assert [html_extract.extract(p, wrapper) for p in host] == want
    rows = [(i, f"http://a.com/{i}", p) for i, p in enumerate(host)] + [(100, "http://b.com/", "<p>b</p>"), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "map('a', page_id) AS pairs")
    for size in (0, html_extract.WRAPPER_BYTES, 1 << 30):
        monkeypatch.setattr(html_extract, "WRAPPER_BYTES", size)
        got = html_extract.main_text(pages.coalesce(1)).collect()
        assert {r.page_id: r.text for r in got} == dict(enumerate(want)) | {100: "b", 101: ""} and len(got) == 22
        assert all(r.pairs == {"a": r.page_id} and r.n_chars == len(r.text) for r in got)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def by_hand(url, rules, default="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_rules_equal_plain_matching(spark, monkeypatch):
    rng = random.Random(8)
    labels = ["com", "net", "example", "www", "a", "exampl", "examplee", "m", "x-y"]
    urls = [f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/a?b=/en/', '?q', '#f', '/EN/'])}" for _ in range(800)]
    urls += ["http://example.com/en/"] * 300 + [None, "", "nope", "://", "http://EXAMPLE.com/en/É", "http://a\nb.com/\n", "x://com"]
    more = RULES + [("block", "a.com", "/"), ("allow", "a.com", "/en"), ("block", "b.a.com", ""), ("allow", "m.a.com", "/es/x")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS key", "2 AS range")
    for rules in (RULES, more):
        got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: by_hand(u, rules) for i, u in enumerate(urls)}
        # more rules than every task may get, ranges and parts of ranges of few rows
        for name, value in (("BROADCAST_RULES", 0), ("RANGE_ROWS", 40), ("SAMPLE", 50)):
            monkeypatch.setattr(url_filter, name, value)
        got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: by_hand(u, rules) for i, u in enumerate(urls)}
        assert len(got) == len(urls)
        monkeypatch.undo()
    odd = pages.selectExpr("page_id", "url", "map('a', page_id) AS pairs", "'z' AS verdict")
    assert url_filter.judge(odd, spark.createDataFrame(RULES, "verdict string, host string, path string")).columns == ["page_id", "url", "pairs", "host", "path", "rule", "verdict"]
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_filter.judge(pages, none, default="block").collect()} == {"block"}
    assert url_filter.judge(pages.where("false"), none).count() == 0


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(2, 60))) for i in range(40)] + [(40, None), (41, ""), (1, "second text of one id and more words"), (None, prose(rng, 20))]
    items += [(2, items[2][1]), (50, "five words are just enough"), (51, "six words are a bit more")]
    rows = documents()
    docs = [(r.doc_id, r.text) for r in rows]
    for i in range(60):
        words = rng.choice([t for _, t in items if t]).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((1000 + i, f"{prose(rng, rng.randint(0, 3000))} {' '.join(words)} {prose(rng, 30)}"))
    docs.append((2000, "five words are just enough"))

    def sets(t):
        w = (t or "").encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for d, t in set(docs):
        own = sets(t)
        for i, u in set(items):
            part = sets(u)
            if part and len(own & part) >= 0.8 * len(part):
                want.add((d, t, i, len(own & part), len(part)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS s", "'x' AS h", "2 AS class", "3 AS bits")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 AS doc_id")
    found = decontaminate.search(frame, bench)
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in found.collect()}
    assert got == {(d, i, a, b) for d, _, i, a, b in want} and got
    clean = decontaminate.decontaminate(frame, bench)
    bad = {(d, t) for d, t, *_ in want}
    assert clean.columns == frame.columns and sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(d), t or "") for d, t in docs if (d, t) not in bad)
    assert decontaminate.search(frame.where("false"), bench).count() == 0
    assert decontaminate.search(frame, bench.where("false")).count() == 0


def test_short_items_lose_nothing(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, 5 + i % 7)) for i in range(60)]
    docs = []
    for i in range(300):
        words = items[i % 60][1].split(" ")
        if len(words) == 9:
            words[-1] = "other"  # four of five shingles stay
        docs.append((i, f"{prose(rng, 200)} {' '.join(words)} {prose(rng, 200)}"))
    found = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(i, i % 60) for i in range(300)} <= got


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    plan = decontaminate.search(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_generated_templates(spark):
    """Hosts with random templates, without articles or telling names: what varies is main text, what all pages share is not."""
    rng = random.Random(21)
    rows, want, alone = [], {}, 0
    for h in range(12):
        around = [f"<{t}>{prose(rng, 3)}</{t}>" for t in rng.choices(["div", "h4", "section", "p"], k=rng.randint(2, 6))]
        for i in range(rng.randint(5, 30)):
            texts = [f"{prose(rng, rng.randint(3, 20))} {h} {i} {k}" for k in range(rng.randint(1, 5))]
            middle = "".join(f"<p>{t}</p>" for t in texts)
            cut = len(around) // 2
            html = f"<body>{''.join(around[:cut])}<div class='x{h}'><h2>{h} {i}</h2>{middle}</div>{''.join(around[cut:])}</body>"
            rows.append((len(rows), f"http://h{h}.org/{i}", html))
            want[rows[-1][0]] = "\n".join([f"{h} {i}", *texts])
            alone += html_extract.extract(html, None) != want[rows[-1][0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == want
    assert alone == len(rows)  # without its wrapper no page comes out right
