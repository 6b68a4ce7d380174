import html
import random
import re
from collections import defaultdict
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tiersight.llm import queries, urls

RULES = queries.RULES


def verdicts(spark, rows, **extra):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    out = urls.url_verdicts(df, RULES, **extra)
    assert out.columns == ["page_id", "url", "html", "path", "host", "rule", "verdict", "via"] or set(out.columns) == {"page_id", "url", "html", "host", "path", "rule", "verdict", "via"}
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.via) for r in out.collect()}


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/7x?q#f", None, 1), (2, "http://example.com/en/8", "", 1), (3, "http://notexample.com/en/7", "", 1), (4, "x://a.NET/de/", None, 1),
        (5, "x://example.net/de/8", None, 1), (6, "x://org?/es/", None, 1), (7, None, "<p>", 1), (8, "no scheme", None, 1), (9, "", None, None), (10, "a://b://c/en/", None, 1), (11, "x://com/en/\n", None, 1), (12, "x://ÄB.com:80/EN/", None, 1),
    ]
    got = verdicts(spark, rows)
    assert got[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow", "rule")
    assert got[2][2:4] == ("com/en/", "block") and got[3][2:4] == ("com/en/", "block")
    assert got[4] == ("a.net", "/de/", "net/de/", "allow", "rule") and got[5][2:4] == ("example.net/de/8", "block")
    assert got[6] == ("org", "", None, "allow", "none")
    assert all(got[i] == ("", "", None, "allow", "none") for i in (7, 8, 9))
    assert got[10][:2] == ("b:", "//c/en/") and got[11][1:4] == ("/en/\n", "com/en/", "block")
    assert got[12][:2] == ("Äb.com:80", "/EN/")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.url_verdicts(empty, RULES).count() == 0


def test_blocks_follow_links_and_allows_win(spark):
    def link(to):
        return f'<head><LINK href="{to}" rel=\'canonical\'></head>'

    rows = [
        (1, "http://a.test/1?x=1#top", link("//b.test/2"), None),  # a - b - blocked
        (2, "https://b.test/2", '<meta HTTP-EQUIV="refresh" content="0; URL=http://bad.com/en/1">', None),
        (3, "http://bad.com/en/1", None, None),
        (4, "http://c.test/x/y", link("z"), None),  # c - c/x/z - blocked and allowed
        (5, "http://c.test/x/z", link("http://bad.com/en/2"), None),
        (6, "http://d.test/", link("http://c.test/x/z"), None),
        (7, "http://ok.net/de/", link("/other"), None),
        (8, "http://ok.net/other", link("http://c.test/x/y"), None),
        (9, "http://e.test/", link("http://e.test/#frag"), None),
        (10, "http://f.test/", "<p>canonical</p><link rel=stylesheet href=http://bad.com/en/3>", None),
        (10, "http://f.test/", "<p>canonical</p><link rel=stylesheet href=http://bad.com/en/3>", None),
    ]
    got = verdicts(spark, rows)
    assert {i: v[3] for i, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    assert got[1][4] == "alias" and got[3][4] == "rule" and got[9][4] == "none"
    log = spark.createDataFrame([("http://f.test/", "http://bad.com/en/9"), (None, None)], "url string, target string")
    assert verdicts(spark, rows, redirects=log)[10][3] == "block"


def plain_verdicts(rows):
    """Verdicts of (page_id, url, html) by following all links one by one."""

    def split(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2], m[3]) if m else ("", "", "")

    def name(url):
        host, path, query = split(url)
        return host + path + query

    def rule(host, path):
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    links = defaultdict(set)
    for _, url, page in rows:
        if url and "://" in url:
            for tag in re.findall(r"(?is)<(?:link|meta)\b[^>]*>", page or ""):
                value = re.search(r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)" if tag[1:5].lower() == "link" else r"(?is)\burl\s*=\s*[\"']?([^\"'>]+)", tag)
                if value and re.search("(?i)canonical|refresh", tag):
                    try:
                        to = urljoin(url, html.unescape(value[1].strip()))
                    except ValueError:
                        continue
                    links[name(url)].add(name(to)), links[name(to)].add(name(url))
    out = {}
    for i, url, _ in rows:
        host, path, _ = split(url)
        own = rule(host, path)
        seen, todo = set(), [name(url)] if url and "://" in url else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += links[n]
        found = {r.verdict for n in seen if (r := rule(*split("x://" + n)[:2]))}
        out[i] = own.verdict if own else "allow" if "allow" in found else "block" if "block" in found else "allow"
    return out


def test_against_following_links(spark):
    """All tags of a page count, references are decoded, dot segments taken out."""
    rng = random.Random(3)
    hosts = ["a.test", "b.test", "bad.com", "ok.net", "c.org"]
    spot = lambda: rng.choice(["", "/", "/en/1", "/de/1", "/es/2", "/x/y/z", "/x/y", "/q?a=1&b=2"])
    tags = ['<link rel="canonical" href="{}">', "<LINK HREF='{}' REL=canonical>", '<meta http-equiv=refresh content="0; url={}">', '<link rel=stylesheet href="{}">']
    rows = []
    for i in range(120):
        url = f"http://{rng.choice(hosts)}{spot()}"
        to = lambda: rng.choice([f"//{rng.choice(hosts)}{spot()}", "../y", "./", "z", "?a=1&amp;b=2", f"https://{rng.choice(hosts)}/q?a=1&#38;b=2", "/x/../en/1", "#top"])
        page = "".join(rng.choice(tags).format(to()) for _ in range(rng.choice([0, 0, 0, 1, 2]))) or None
        rows.append((i, url, page))
    rows += [(500, None, tags[0].format("http://bad.com/en/1")), (501, "no scheme", None), (502, "http://[bad/", tags[0].format("http://[")), (503, "http://d.test/", tags[0].format("http://[x"))]
    names = ["_node", "_own", "_alias", "node", "component", "own", "target", "host"]
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    got = {r.page_id: r.verdict for r in urls.url_verdicts(df, RULES).collect()}
    want = plain_verdicts(rows)
    assert got == want and len({v for i, v in want.items() if i < 120}) == 2
    assert sum(r.via == "alias" for r in urls.url_verdicts(df, RULES).collect()) > 10


def test_links_are_read_from_tags():
    def links(page):
        return urls.links_of(page)

    assert links('<link rel=canonical data-href="http://a/" href="http://b/?x=1&amp;y=2">') == ("", ["http://b/?x=1&y=2"])
    assert links("<link title='a > b' rel='canonical' href='/c'>") == ("", ["/c"])
    assert links('<base href="http://b.test/dir/"><base href="x"><link rel="alternate Canonical" href=c>') == ("http://b.test/dir/", ["c"])
    assert links('<!-- <link rel="canonical" href="/no"> --><script>var x = \'<link rel="canonical" href="/no">\'</script>') == ("", [])
    assert links('<link rel="not-canonical" href="/no"><link rel=canonical href=""><link rel=canonical>') == ("", [])
    assert links('<META HTTP-EQUIV=Refresh CONTENT="5;URL=\'/r s\'"><meta http-equiv=refresh content=30><meta name=refresh content="0;url=/no">') == ("", ["/r s"])
    assert links('<p title="<link rel=canonical href=/no>">') == ("", []) and links("<link rel=canonical href=/x") == ("", [])


def test_odd_links_carry_decisions(spark):
    bad = "http://bad.com/en/1"
    rows = [
        (1, "http://a.test/", f'<link data-href="/x" rel=canonical href="{bad}">', None), (2, "http://b.test/", f"<link title='>' rel=canonical href='{bad}'>", None),
        (3, "http://c.test/", '<base href="http://bad.com/en/"><link rel=canonical href="1">', None), (4, "http://d.test/", f"<!-- <link rel=canonical href='{bad}'> -->", None),
        (5, "http://e.test/", f'<link rel="not-canonical" href="{bad}">', None), (6, "http://f.test/", "<link rel=canonical href='z'>", None),
    ]
    assert {i: v[3] for i, v in verdicts(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_a_table_of_rules_is_joined(spark):
    """The same verdicts as one rule after another, for hosts and paths of any length, and 100,000 rules."""
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "com", "www", "x-y"])
    host = lambda most: ".".join(label() for _ in range(rng.randrange(1, most)))
    path = lambda most: "".join(rng.choice(["/", "a", "b", "/en"]) for _ in range(rng.randrange(most)))
    rules = [urls.Rule(rng.choice(["allow", "block"]), host(4), rng.choice(["", "/", "/" + path(4)])) for _ in range(60)]
    rules += [urls.Rule("allow", "both.com", "/x"), urls.Rule("block", "both.com", "/x"), urls.Rule("block", "com", "x")]
    rows = [(host(7), rng.choice(["", "/" + path(6)])) for _ in range(400)] + [("", "/a"), ("", ""), ("..", "/"), ("both.com", "/xy"), ("ab.com", ""), ("a.", "/"), (".".join(["a"] * 500), "/")]
    df = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "host string, path string, i int, _key string")

    def plain(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.text), r.verdict == "allow"), default=None)
        return (len(best.text), best.verdict) if best else None

    table = spark.createDataFrame([*rules, (None, "a", ""), *rules[:9]], "verdict string, host string, path string")
    got = {r.i: (len(r.rule), r.own) if r.own else None for r in urls.ruled(df, table, "rule", "own").collect()}
    assert got == {i: plain(*r) for i, r in enumerate(rows)} and len({*got.values()}) > 8
    listed = {r.i: (len(r.rule), r.own) if r.own else None for r in urls.ruled(df, rules, "rule", "own").collect()}
    assert listed == got
    many = spark.range(100_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), F.col("id") % 50_000, F.lit(".test")).alias("host"), F.concat(F.lit("/"), F.col("id") % 2).alias("path"))
    pages = spark.createDataFrame([(1, "http://www.h7.test/1", None), (2, "http://h7.test/2", None), (3, "http://h50001.test/1", None), (4, None, None), (5, "http://ok.test/", '<link rel=canonical href="http://h9.test/1x">')], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict, r.via) for r in urls.url_verdicts(pages, many).collect()}
    assert got == {1: ("h7.test/1", "block", "rule"), 2: (None, "allow", "none"), 3: (None, "allow", "none"), 4: (None, "allow", "none"), 5: (None, "block", "alias")}
    assert urls.url_verdicts(pages, many.limit(0)).where("verdict = 'allow'").count() == 5
