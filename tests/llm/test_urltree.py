import collections
import math
import random

from meterflow.llm import urltree
from meterflow.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, bad int"


def judged(spark, rows, labels, rules=URL_RULES, **how):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "id long, bad double")
    return {r.page_id: r for r in urltree.judge_urls(pages, marks, rules, **how).collect()}


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest] + [len(rest)]
    host, path = rest[:min(ends)], rest[min(ends):]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2",
            "http://x.com/fr/", "http://x.com/de/a", "http://x.com/de", "http://com/de/", "http://telecom/fr/", "a://b://c/d", "http://org",
            "http://ex.net?q=/de/", "http://u@Ä.com:80/de/#", "HTTP://badexample.org/es/", "x\n://y.com/fr/\nz", "http://a.org/\\"]
    got = judged(spark, list(enumerate(urls)), [])
    for i, url in enumerate(urls):
        host, path, rule = by_hand(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), url
        assert r.verdict == (rule.verdict if rule else "allow")


def test_templates_and_purity(spark):
    rows, labels = [], []
    for i in range(120):  # three alike branches of articles, one branch of spam
        branch = ("en", "fr", "de", "win")[i % 4]
        rows.append((i, f"http://news.test/{branch}/{i * 7}/item{i}.html?q={i}"))
        labels.append((i, 1.0 if branch == "win" or i % 40 < 3 else 0.0))
    rows += [(500, "http://news.test/win/1/x"), (501, "http://news.test/en/1/item9.html"), (502, "http://other.test/win/1/item9.html")]
    got = judged(spark, rows, labels, rules=())
    assert {got[i].template for i in range(120) if i % 4 != 3} == {"/+/*/*"}
    assert {got[i].template for i in range(120) if i % 4 == 3} == {"/win/*/*"}
    assert {got[i].verdict for i in range(120) if i % 4 != 3} == {"allow"}
    assert {got[i].verdict for i in range(120) if i % 4 == 3} == {"block"}
    assert (got[501].verdict, got[502].verdict) == ("allow", "allow")


def test_edges(spark):
    rows = [(1, "http://a.test/" + "s/" * 5000), (None, "http://a.test/x"), (3, "http://a.test/x"), (4, "http://a.test")]
    labels = [(None, 1.0), (3, None), (3, 1.0), (3, 0.0)]
    got = judged(spark, rows, labels)
    assert set(got) == {1, None, 3, 4} and all(r.verdict in ("allow", "block") for r in got.values())
    assert judged(spark, [], labels) == {}


def brute(urls, labels, min_count=5, z=2.0, strength=8.0):
    """Template and purity of each url, the tree built level by level in plain Python."""
    rows = []
    for i, url in urls:
        host, path, _ = by_hand(url)
        rows.append([host, ["*" if any(c.isdigit() for c in s) else s for s in path.split("/") if s], labels.get(i), ()])
    for level in range(max(len(r[1]) for r in rows)):
        kids = collections.defaultdict(list)
        for host, segments, bad, tokens in rows:
            if level < len(segments):
                kids[host, tokens, segments[level]].append(bad)
        told = {}
        for node in {k[:2] for k in kids}:
            counts = {k[2]: (sum(b is not None for b in v), sum(b or 0 for b in v)) for k, v in kids.items()
                      if k[:2] == node and k[2] != "*" and len(v) >= min_count}
            rates = sorted(b / n for n, b in counts.values() if n)
            middle = rates[math.ceil(len(rates) / 2) - 1] if rates else 0.0
            total = sum(n for n, _ in counts.values())
            share = (middle * total + 0.5) / (total + 1)
            for segment, (n, b) in counts.items():
                alike = abs(b - n * share) <= z * math.sqrt(n * share * (1 - share)) + 1
                told[(*node, segment)] = "+" if alike and len(counts) > 1 else segment
        for row in rows:
            if level < len(row[1]):
                row[3] = (*row[3], told.get((row[0], row[3], row[1][level]), "*"))
    n = sum(r[2] is not None for r in rows)
    prior = sum(r[2] or 0 for r in rows) / n if n else 0.0

    def smooth(chosen, towards):
        known = [r[2] for r in chosen if r[2] is not None]
        return (sum(known) + strength * towards) / (len(known) + strength)

    hosts = {h: smooth([r for r in rows if r[0] == h], prior) for h in {r[0] for r in rows}}
    return {i: ("".join("/" + t for t in r[3]), smooth([q for q in rows if (q[0], q[3]) == (r[0], r[3])], hosts[r[0]]))
            for (i, _), r in zip(urls, rows)}


def test_tree_equals_brute_force(spark):
    draw = random.Random(11)
    words = ["a", "b", "blog", "shop", "spam", "x1", "2024", "p", "q"]
    urls = [(i, f"http://{draw.choice(['h.test', 'h.test', 'g.test'])}/" + "/".join(
        draw.choice(words[:3 + 2 * k]) for k in range(draw.randrange(4)))) for i in range(700)]
    labels = {i: float("spam" in u and draw.random() < 0.9 or draw.random() < 0.1) for i, u in urls if i % 3}
    got = judged(spark, urls, list(labels.items()), rules=())
    for i, (template, purity) in brute(urls, labels).items():
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-9


def test_a_bad_section_among_many(spark):
    rows = [(s * 100 + i, f"http://big.test/s{chr(97 + s // 26)}{chr(97 + s % 26)}/page-{i}") for s in range(100) for i in range(100)]
    got = judged(spark, rows, [(i, float(i // 100 == 37)) for i, _ in rows], rules=())
    assert all((got[i].verdict == "block") == (i // 100 == 37) for i, _ in rows)


def test_the_same_bad_page_under_every_user(spark):
    for pages in (1, 7):  # users rare and frequent
        names = [f"{chr(97 + u // 26)}{chr(97 + u % 26)}" for u in range(60)]
        urls = [f"http://home.test/{name}/{page}" for name in names for page in ["spam", "about", "home"] * pages]
        rows = list(enumerate(urls))
        got = judged(spark, rows, [(i, float(u.endswith("spam"))) for i, u in rows], rules=())
        assert all((got[i].verdict == "block") == u.endswith("spam") for i, u in rows)
