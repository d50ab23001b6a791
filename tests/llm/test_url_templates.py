import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.queries import RULES
from tallyspark.llm.url_templates import filter_urls

PAGES, LABELS = "page_id long, url string", "page_id long, bad boolean"


def parts(url):
    """Host and path by plain steps over characters."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def plain(pages, labels, rules, depth=4):
    """The tree by plain recursion over each host's paths."""
    known = {}
    for page, bad in labels:
        if page is not None and bad is not None:
            known[page] = known.get(page, False) or bad
    rows = [(p, *parts(u)) for p, u in pages]
    template = {}

    def grow(host, members, at):
        if at == depth:
            for name, _ in members:
                template[host, name[0]] = name[1] + ("/**" if len(name[2]) > depth else "")
            return
        children, ended = {}, []
        for m in members:
            (children.setdefault(m[0][2][at], []) if len(m[0][2]) > at else ended).append(m)
        for name, _ in ended:
            template[host, name[0]] = name[1]
        counts = {c: (len([p for m in ms for p in m[1]]), [known[p] for m in ms for p in m[1] if p in known]) for c, ms in children.items()}
        pages_of, labels_of = sum(n for n, _ in counts.values()), [x for _, ls in counts.values() for x in ls]
        groups = {}
        for c, ms in children.items():
            n, ls = counts[c]
            a, b, k, s = sum(ls), len(ls) - sum(ls), len(labels_of) - len(ls), sum(labels_of) - sum(ls)
            margins = len(ls) * k * (a + s) * (len(labels_of) - a - s)
            apart = margins > 0 and (a * (k - s) - s * b) ** 2 * len(labels_of) >= 3.841 * margins
            own = len(children) == 1 or (n * 16 >= pages_of and apart)
            groups.setdefault(c if own else "*", []).extend(ms)
        by_template = {}
        for c, ms in groups.items():
            for (shape, tpl, segments), ids in ms:
                by_template.setdefault(f"{tpl}/{c}", []).append(((shape, f"{tpl}/{c}", segments), ids))
        for ms in by_template.values():
            grow(host, ms, at + 1)

    hosts = {}
    for p, host, path in rows:
        hosts.setdefault(host, {}).setdefault(re.sub("[0-9]+", "{n}", path), []).append(p)
    for host, shapes in hosts.items():
        grow(host, [((s, "", s.split("/")[1:]), ids) for s, ids in shapes.items()], 0)
    every = [known[p] for p, _, _ in rows if p in known]
    rate = sum(every) / len(every) if every else 0.0
    out = []
    for p, host, path in rows:
        mine = template[host, re.sub("[0-9]+", "{n}", path)]
        of_host = [known[q] for q, h, _ in rows if h == host and q in known]
        of_mine = [known[q] for q, h, x in rows if h == host and q in known and template[h, re.sub("[0-9]+", "{n}", x)] == mine]
        purity = (sum(of_mine) + 4 * (sum(of_host) + 4 * rate) / (len(of_host) + 4)) / (len(of_mine) + 4)
        fits = [(len(h + s), h + s, says) for h, s, says in rules if (host == h or host.endswith("." + h)) and path.startswith(s)]
        rule, says = max(fits)[1:] if fits else (None, None)
        out.append((p, host, path, rule, mine, round(purity, 9), says or ("block" if purity >= 0.5 else "allow")))
    return sorted(out, key=repr)


def got(spark, pages, labels, rules=RULES):
    out = filter_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), rules)
    return sorted(((*tuple(r)[:1], *tuple(r)[2:6], round(r.purity, 9), r.verdict) for r in out.collect()), key=repr)


ODD = [
    None, "", "no scheme/at/all", "http://", "http://A.Example.NET/EN/x", "https://a.example.net/en/x?q=/de/", "x://example.com/de/", "x://badexample.com/de/1", "http://ÀB.org/fr/é",
    "http://org/fr/", "http://org?/fr/", "http://a.org#/fr/", "http://h/a//b/", "http://h/1/22/333/4/5/6", "http://h/x://y/z", "://net/", "http://example.net", "http://h/" + "d/" * 3000, "http://h/" + "9" * 200_000,
]


def test_odd_urls(spark):
    pages = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://h/n"), (3, "http://h/again"), (3, "http://h/again")]
    labels = [(3, True), (3, False), (None, True), (5, None), (12, True), (13, False)]
    assert got(spark, pages, labels) == plain(pages, labels, RULES)


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_plain_recursion(spark, seed):
    """One host has a third of the pages; bad sections stand apart, the rest is merged."""
    import random

    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(900):
        host = rng.choice(["big.com", "b.org", "c.net", f"h{rng.randint(0, 9)}.com"]) if i % 3 else "big.com"
        section, page = rng.choice(["shop", "blog", "bets", "u%d" % rng.randint(0, 99)]), rng.choice([f"p{rng.randint(0, 9)}", "x/y", "x/y/z/deep/er", f"{rng.randint(0, 999)}.html"])
        pages.append((i, f"http://{host}/{section}/{page}"))
        if rng.random() < 0.6:
            labels.append((i, rng.random() < (0.9 if section == "bets" else 0.1)))
    out = got(spark, pages, labels)
    assert out == plain(pages, labels, RULES)
    by_tree = [r for r in out if r[3] is None]
    blocked = [r for r in by_tree if r[6] == "block"]
    assert sum("/bets/" in r[2] for r in blocked) > 0.8 * len(blocked) > 0 and any(r[4].startswith("/*/") for r in by_tree)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_urls(spark.createDataFrame([], PAGES), none, RULES).count() == 0
    df = spark.createDataFrame([(1, "http://x.net/a")], PAGES).withColumns({c: F.lit("mine") for c in ("host", "Path", "verdict", "template", "shape", "pages", "bad")})
    (r,) = filter_urls(df, none, RULES).collect()
    assert (r.host, r.host_, r.path_, r.rule, r.verdict, r.verdict_, r.template_) == ("mine", "x.net", "/a", "net/", "mine", "block", "/a")
