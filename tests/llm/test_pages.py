import html
import re
import time
from collections import defaultdict

from packloom.llm.html_text import extract_text, main_text
from packloom.llm.url_filter import url_verdicts

PAGE = """<html><head><title>t</title></head><body><div id="header"><a href=/>Home</a></div><div class="wrap"><div class="cookie-notice">We use cookies &amp; stuff, a long notice that reads like content.</div>
<div class="post-content"><h2>Title   here</h2><div><p>First &lt;para&gt; of the text with many words in it so that the ratio is high.<p>Second.</div><ul><li>one<li>two &nbsp; three</ul>
<form><input><p>Join our list of many readers now</p></form><p>Third paragraph is long enough too,<br>with <a href=x>a link</a> in it.</p></div>
<div class="comments"><p>I disagree with all of this article and its words, said the reader.</p></div></div><aside>Other stuff</aside><script>var x = "<p>no</p>";</script><footer>c</footer></body>"""


def test_template_without_article():
    assert main_text(PAGE).split("\n\n") == ["Title here", "First <para> of the text with many words in it so that the ratio is high.", "Second.", "one", "two three", "Third paragraph is long enough too, with a link in it."]


def test_test_pages_match_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def articles(spark, sf):
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))) for x in re.split(r"</?(?:p|h1)>", inner)]
        yield p.html, "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)


def test_pages_without_an_article_element(spark):
    """The ratios find the region, whatever the element is called or wrapped in."""
    pages = list(articles(spark, "/root/testdata/sf0.01"))
    end = lambda h: h.replace("</article>", "</div>")
    shapes = [
        (1.0, lambda h: end(h).replace("<article>", "<div>")),
        (1.0, lambda h: end(h).replace("<article>", '<div class="content has-sidebar">')),
        (1.0, lambda h: end(h).replace("<article>", "<div>").replace("<body>", '<body><form id="aspnetForm">')),
        (0.95, lambda h: end(h).replace("<article>", '<div class="social-history">')),
        (0.95, lambda h: h.replace("<article>", "").replace("</article>", "")),
    ]
    for least, f in shapes:
        assert sum(main_text(f(h)) == want for h, want in pages) >= least * len(pages)


def test_the_cluster_decides(spark, monkeypatch):
    """Where all lines are content, menus and adverts come along."""
    from packloom.llm import html_text

    pages = list(articles(spark, "/root/testdata/sf0.001"))
    assert all(main_text(h) == want for h, want in pages)
    monkeypatch.setattr(html_text, "content_cluster", lambda r: r >= 0)
    assert not any(main_text(h) == want for h, want in pages)


def test_ratios_without_names():
    """No element or class says what is content."""
    menu = "".join(f"<div><a href=/{k}>item {k}</a></div>" for k in range(12))
    tags = "".join(f"<div><span><i></i><b></b>x{k}</span></div>" for k in range(10))
    prose = "".join(f"<p>Sentence {k} goes on for a while, as prose does, and has few tags in it.</p>" for k in range(6))
    got = main_text(f"<body><div>{menu}</div><div>{tags}</div><div><h2>Head</h2>{prose}</div><div>{menu}</div>")
    assert got.split("\n\n")[0] == "Head" and "item" not in got and "x3" not in got and got.count("Sentence") == 6


def test_odd_declarations_and_deep_pages():
    assert main_text("a<![foo[x]]>b") == "ab" and main_text("a <![CDATA[x]]> b<![if !IE]>c") == "a bc"
    took = {}
    for n in (4000, 32_000):
        start = time.process_time()
        assert main_text("<div>" * n + "deep" + "</div>" * n + "</article>" * n) == "deep"
        took[n] = time.process_time() - start
    assert took[32_000] < 24 * took[4000] + 0.2


def test_broken_null_and_long_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "plain text", "x"), (4, "u", "<p>a<p>b<div", "x"), (5, "u", "<script>if(a<b)x</script>z", "x"), (6, "u", "<p>" + "w " * 200_000, "x"), (6, "u", "<" * 3000, "x"), (7, "u", "<div>" * 3000 + "deep" + "</div>" * 2000, "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = defaultdict(list)
    for r in got:
        text[r.page_id].append(r.text)
    assert text[1] == [""] and text[2] == [""] and text[3] == ["plain text"] and text[4][0].startswith("a\n\nb") and text[5] == ["z"]
    assert max(map(len, text[6])) == 399_999 and text[7] == ["deep"]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def anchors(page):
    """Hosts of absolute links, by the standard library's parser."""
    from html.parser import HTMLParser

    found = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            for k, v in attrs:
                if tag in ("a", "area") and k == "href" and (m := re.match(r"\s*(?:https?:)?//([^/?#\s>]+)", v or "", re.I)):
                    found.append(m[1])

    Reader().feed(page)
    return found


def plain(rows, rules, damping=0.85, rounds=500):
    """Rules by hand; ranks by dictionaries."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pages, links = [], defaultdict(set)
    for k, (i, url, page) in enumerate(rows):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = m[1].translate(up), m[2]
        fits = [(len(r), v == "block", r, v) for v, r in rules if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
        pages.append((i, host, path, *(max(fits)[2:] if fits else (None, None))))
        if host:
            for dst in {x.translate(up) for x in anchors(page or "")} - {host}:
                links[host, dst].add(k)
    hosts = {p[1] for p in pages if p[1]} | {d for _, d in links}
    rank = {}
    for kind, want in (("trust", "allow"), ("distrust", "block")):
        edges = defaultdict(dict)
        for (s, t), n in links.items():
            a, b = (s, t) if kind == "trust" else (t, s)
            edges[a][b] = len(n)
        said = {h: [p[4] for p in pages if p[1] == h] for h in hosts}
        seed = {h: float(said[h].count(want) * 2 > len(said[h]) and bool(said[h])) for h in hosts}
        total = max(sum(seed.values()), 1)
        seed = {h: x / total for h, x in seed.items()}
        r = dict(seed)
        for _ in range(rounds if links else 0):
            lost = sum(r[h] for h in hosts if h not in edges)
            new = {h: (1 - damping) * seed[h] + damping * lost * seed[h] for h in hosts}
            for a, out in edges.items():
                for b, w in out.items():
                    new[b] += damping * r[a] * w / sum(out.values())
            done = sum(abs(new[h] - r[h]) for h in hosts) < 1e-6
            r = new
            if done:
                break
        rank[kind] = r
    return sorted((i, h, p, rule, said or ("block" if h and rank["distrust"][h] > rank["trust"][h] else "allow")) for i, h, p, rule, said in pages)


def verdicts(spark, rows):
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got)


def test_verdicts_match_a_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [
        (1000, "https://good.com/a", '<a href="http://mid.org/x">'), (1001, "http://mid.org/", "<a href='//Leaf.org'>"), (1002, "http://leaf.org/q", None), (1003, "http://bad.net/es/1", ""),
        (1004, "http://farm.org/", '<a HREF="https://BAD.net/es/">'), (1005, "http://farm2.org/", '<a href="http://farm.org">'), (1012, "http://quiet.org/", '<!-- <a href="http://bad.net/"> --><script>"<a href=http://bad.net>"</script>href="http://bad.net"<a title=x href=http://good.com/>'),
        (1006, None, None), (1007, "x", '<a href="http://bad.net">'),
        (1008, "http://www.EXAMPLE.com/en/x?q#f", ""), (1009, "http://a.example.com?x/en/", ""), (1010, "http://example.com/en", ""), (1010, "http://example.com/en/", ""), (1011, "s://net/fr/" + "y" * 50_000, ""),
    ]
    want = plain(rows, RULES)
    assert verdicts(spark, rows) == want
    by = {w[0]: w[4] for w in want}
    assert (by[1004], by[1005], by[1002], by[1012]) == ("block", "block", "allow", "allow")


def test_no_pages(spark):
    assert verdicts(spark, []) == []


def test_ranks_that_do_not_settle_are_an_error(spark):
    import pytest

    rows = [(0, "https://good.com/a", '<a href="http://h1.org/">')] + [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">') for k in range(1, 30)]
    with pytest.raises(RuntimeError):
        url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, rounds=2)
