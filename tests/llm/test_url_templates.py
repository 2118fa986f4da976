import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from versara.llm.common import table
from versara.llm.url_templates import ALLOW, BLOCK, RULES, WHOLE, Rule, Settings, host_of, judge, op1_url_templates, path_of, shape


def cut(url):
    """Brute force: host and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for r in RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://Ex.NET", "http://EXAMPLE.net/en/1", "http://a.example.net/EN/1", "x://b.org/fr/2?x#y", "http://org/fr/", "http://example.com/de/x/y/z/w/v/u", "http://xexample.com/de/1", "a://b://c/d", "http://h?q/en/", "http://h#f", "http://é.net/ü/\n/1"]


def test_hosts_paths_and_rules(spark):
    rows = judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path) == cut(URLS[r.page_id]), URLS[r.page_id]
        want = rule(r.host, r.path)
        assert r.rule == (want.text if want else None)
        if want:
            assert r.verdict == want.verdict


def test_whole_table(spark, sf):
    pages = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    rows = op1_url_templates(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    by_template = defaultdict(set)
    for r in rows:
        assert (r.host, r.path) == cut(pages[r.page_id])
        want = rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((want.text, want.verdict) if want else (None, BLOCK if r.share >= 0.5 else ALLOW))
        by_template[r.host, r.template].add(r.share)
    assert all(len(s) == 1 for s in by_template.values())


def test_templates_learn_from_labels(spark):
    """One host: numbered articles, slugs, and a branch that is labelled bad; the rules see only some pages."""
    rng = random.Random(4)
    rules = [Rule("site.test/spam/x", BLOCK), Rule("site.test/news/y", ALLOW), Rule("site.test/blog/y", ALLOW)]
    urls = []
    for i in range(120):
        urls += [f"http://site.test/spam/{rng.choice('xz')}{i}", f"http://site.test/news/{rng.choice('yz')}{i}", f"http://site.test/blog/{rng.choice('yz')}{i}", f"http://site.test/tag/{''.join(rng.choices('abcdefghij', k=8))}"]
    rows = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in rows:
        if r.rule is None and r.path.startswith("/spam/"):
            assert r.verdict == BLOCK
        if r.rule is None and r.path.startswith(("/news/", "/blog/")):
            assert r.verdict == ALLOW
    assert {r.template for r in rows if r.path.startswith("/tag/")} == {"/tag/*"}
    assert len({r.template.split("/")[1] for r in rows if r.path.startswith(("/news/", "/blog/"))}) == 1  # alike, so merged
    assert {r.template.split("/")[1] for r in rows if r.path.startswith("/spam/")} == {"spam"}


def test_shapes(spark):
    seen = {"148.html": "{n}.html", "abc": "abc", "2024-01-02": "{n}-{n}-{n}", "deadbeef01": "{x}", "123456789": "{n}", "": ""}
    df = spark.createDataFrame([(k,) for k in seen], "s string").select("s", shape(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == seen


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, RULES).collect() == []
    clash = spark.createDataFrame([(1, "http://a.test/x", "h", 0.1, None), (1, "http://a.test/x", "h", 0.1, None), (None, None, None, None, None)], "page_id long, url string, host string, share double, segs string")
    got = judge(clash, RULES, settings=Settings(children=1)).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "None"]
    df = clash.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    assert {(r.h, r.p) for r in df.collect()} == {("a.test", "/x"), ("", "")}


def slow_shape(x):
    x = re.sub(r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?:-[0-9a-f]{4,})*(?![0-9a-z])", "{x}", x)
    return re.sub("[0-9]+", "{n}", x)


def slow_tree(urls, rules, s):
    """Brute force: (template, share) of each url, node by node on Python lists."""
    def said(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: (len(r.text), r.text)).verdict if fit else None

    items = [(i, *cut(u)) for i, u in enumerate(urls)]
    items = [(i, h, tuple(slow_shape(x) for x in p.split("/") if x), said(h, p)) for i, h, p in items]
    share = lambda some, above: (sum(v == BLOCK for *_, v in some) + s.prior * above) / (sum(v is not None for *_, v in some) + s.prior)
    out = {}

    def visit(some, at, k, above):
        mine = share(some, above)
        verdicts = {v for *_, v in some if v}
        stop = len(verdicts) < 2 or len({g for _, _, g, _ in some}) < 2
        groups = defaultdict(list)
        for x in some:
            if stop or len(x[2]) <= k:
                out[x[0]] = (at + ("" if len(x[2]) <= k else "/*" if len(x[2]) == k + 1 else "/**"), mine)
            else:
                groups[x[2][k]].append(x)
        if not groups:
            return
        if len(groups) > s.children or len(groups) > 1 and sum(map(len, groups.values())) / len(groups) < s.rare:
            return visit([x for g in groups.values() for x in g], at + "/*", k + 1, mine)
        kids = []
        for seg, g in groups.items():
            b, n = sum(v == BLOCK for *_, v in g), sum(v is not None for *_, v in g)
            kids.append((max(len(x[2]) for x in g), (b + 0.5) / (n + 1), seg, b, n, g))
        merged = []
        for deep, _, seg, b, n, g in sorted(kids, key=lambda x: x[:3]):
            if merged:
                d0, b0, n0, segs, g0 = merged[-1]
                pooled = (b0 + b + 1) / (n0 + n + 2)
                error = (pooled * (1 - pooled) * (1 / (n0 + 1) + 1 / (n + 1))) ** 0.5
                if d0 == deep and (n0 == 0) == (n == 0) and abs((b0 + 0.5) / (n0 + 1) - (b + 0.5) / (n + 1)) < s.z * error:
                    merged[-1] = (deep, b0 + b, n0 + n, [*segs, seg], g0 + g)
                    continue
            merged.append((deep, b, n, [seg], g))
        for _, _, _, segs, g in merged:
            visit(g, at + "/" + (f"({'|'.join(sorted(segs))})" if len(segs) > 1 else segs[0]), k + 1, mine)

    above = (sum(v == BLOCK for *_, v in items) + s.prior / 2) / (sum(v is not None for *_, v in items) + s.prior)
    hosts = defaultdict(list)
    for x in items:
        hosts[x[1]].append(x)
    for some in hosts.values():
        visit(some, "", 0, above)
    return out


def same(spark, urls, rules, s):
    want = slow_tree(urls, rules, s)
    rows = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, settings=s).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert r.template == want[r.page_id][0] and r.share == pytest.approx(want[r.page_id][1]), urls[r.page_id]
    return rows


def test_tree_against_brute_force(spark, sf):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "c", "d", "e", f"p{rng.randrange(99)}", "".join(rng.choices("xyz", k=4))])
    urls = [f"http://{rng.choice(['h.test', 'g.test', 'www.h.test'])}/{'/'.join(word() for _ in range(rng.randrange(6)))}" for _ in range(600)]
    rules = [Rule("h.test/a/b", BLOCK), Rule("h.test/a/c", ALLOW), Rule("test/b/a", ALLOW), Rule("g.test/c/d/", BLOCK), Rule("g.test/c/", ALLOW), Rule("test/d/a/b", BLOCK), Rule("test/d/a", ALLOW), Rule("test/e/", BLOCK)]
    for s in (Settings(), Settings(children=3, rare=1.5, z=0.8), Settings(rare=0.0, z=0.1)):
        rows = same(spark, urls, rules, s)
        assert max(r.template.count("/") for r in rows) >= 3
    pages = [r.url for r in table(spark, sf, "pages").orderBy("page_id").collect()]
    same(spark, pages, RULES, Settings())


def test_paths_are_told_apart_to_their_ends(spark):
    urls = [f"http://a.test/a/b/c/d/{kind}/{'xy'[i % 6 > 0]}{i}" for kind in ("spam", "good") for i in range(60)]
    rules = [Rule("a.test/a/b/c/d/spam/x", BLOCK), Rule("a.test/a/b/c/d/good/x", ALLOW)]
    rows = same(spark, urls, rules, Settings())
    assert {(r.path.split("/")[5], r.verdict) for r in rows} == {("spam", BLOCK), ("good", ALLOW)}
    long = [f"http://a.test/{'/'.join(['s'] * 5000)}", f"http://a.test/{'t' * 200_000}", "http://a.test/s"]
    assert len(same(spark, long, rules, Settings())) == 3


def test_a_chain_of_small_steps_is_no_branch(spark):
    """Children whose shares rise step by step: neighbours can't be told apart, the ends can."""
    urls, rules = [], []
    for i, seg in enumerate("abcdefghi"):
        urls += [f"http://c.test/{seg}/{'bad' if j < 4 * i else 'fine'}{j:03}" for j in range(32)]
        rules += [Rule(f"c.test/{seg}/bad", BLOCK), Rule(f"c.test/{seg}/fine", ALLOW)]
    rows = same(spark, urls, rules, Settings())
    first = {r.template.split("/")[1] for r in rows}
    assert 1 < len(first) < 9 and not any("a" in t and "i" in t for t in first)


def whole_tree(urls, rules, s):
    """Brute force of the whole tree, a segment at a time: ends are ends of paths and single shapes only."""
    items = []
    for i, u in enumerate(urls):
        host, path = cut(u)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        items.append((i, host, tuple(slow_shape(x) for x in path.split("/") if x), max(fit, key=lambda r: (len(r.text), r.text)).verdict if fit else None))

    def labels(some):
        return sum(x[3] == BLOCK for x in some), sum(x[3] is not None for x in some)

    out, todo = {}, []
    b, n = labels(items)
    for host in {x[1] for x in items}:
        todo.append(([x for x in items if x[1] == host], "", 0, (b + s.prior / 2) / (n + s.prior)))
    while todo:
        some, at, k, above = todo.pop()
        b, n = labels(some)
        share, groups = (b + s.prior * above) / (n + s.prior), defaultdict(list)
        for x in some:
            left = len(x[2]) - k
            if left <= 0 or len({y[2] for y in some}) == 1:
                out[x[0]] = (at + ["", "/*", "/**"][min(max(left, 0), 2)], share)
            else:
                groups[x[2][k]].append(x)
        if len(groups) > s.children or len(groups) > 1 and sum(map(len, groups.values())) < s.rare * len(groups):
            todo.append((sum(groups.values(), []), at + "/*", k + 1, share))
            continue
        found = []  # branches: depth, labels and names of children that can't be told apart
        for deep, _, seg in sorted((max(len(x[2]) for x in g), (labels(g)[0] + 0.5) / (labels(g)[1] + 1), seg) for seg, g in groups.items()):
            b, n = labels(groups[seg])
            if found and found[-1][0] == deep and (found[-1][2] > 0) == (n > 0):
                _, c, m, names = found[-1]
                p = (b + c + 1) / (n + m + 2)
                if abs((b + 0.5) / (n + 1) - (c + 0.5) / (m + 1)) < s.z * (p * (1 - p) * (1 / (n + 1) + 1 / (m + 1))) ** 0.5:
                    found[-1] = (deep, b + c, n + m, [*names, seg])
                    continue
            found.append((deep, b, n, [seg]))
        for *_, names in found:
            todo.append((sum((groups[x] for x in names), []), at + "/" + (names[0] if len(names) == 1 else f"({'|'.join(sorted(names))})"), k + 1, share))
    return out


def same_whole(spark, urls, rules, s=None):
    want = whole_tree(urls, rules, s or WHOLE)
    rows = judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, settings=s).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert r.template == want[r.page_id][0] and r.share == pytest.approx(want[r.page_id][1]), urls[r.page_id]
    return rows


def test_whole_tree_against_brute_force(spark, sf):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "a", "b", "c", "d", f"p{rng.randrange(99)}", "".join(rng.choices("xyz", k=4))])
    urls = [f"http://{rng.choice(['h.test', 'g.test', 'www.h.test', 'plain.org', 'bad.net'])}/{rng.choice(['', 'r/s/'])}{'/'.join(word() for _ in range(rng.randrange(6)))}" for _ in range(600)]
    rules = [Rule("h.test/a/b", BLOCK), Rule("h.test/a/c", ALLOW), Rule("test/r/s/a", ALLOW), Rule("bad.net/r", BLOCK), Rule("g.test/c/", ALLOW)]
    for s in (None, Settings(children=3, rare=1.5, z=0.8, agreed=False), Settings(rare=0.0, z=0.1, agreed=False)):
        rows = same_whole(spark, [*urls, *URLS], rules, s)
        for host in ("plain.org", "bad.net"):  # labels of no kind, of one kind
            assert len({r.template for r in rows if r.host == host}) > 5
    same_whole(spark, [r.url for r in table(spark, sf, "pages").orderBy("page_id").collect()], RULES)


def test_branches_without_labels_are_told_from_labelled_ones(spark):
    """All labels of a host agree, but one of its two branches has none of them."""
    urls = [f"http://other{i % 5}.test/p/{'abcdefghij'[i % 10]}x" for i in range(60)]
    urls += [f"http://s.test/spam/{x}" for x in ("bad-a", "bad-b", "fa", "fb", "fc", "fd", "fe")] + [f"http://s.test/news/{x}" for x in ("na", "nb", "nc", "nd", "ne", "nf")]
    rules = [Rule("s.test/spam/bad", BLOCK)] + [Rule(f"other{i}.test/p/", ALLOW) for i in range(5)]
    rows = same_whole(spark, urls, rules)
    assert {(r.template, r.verdict) for r in rows if r.host == "s.test"} == {("/spam/*", BLOCK), ("/news/*", ALLOW)}


def test_query_grows_every_host(spark, sf):
    pages = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    want = whole_tree([pages[i] for i in sorted(pages)], RULES, WHOLE)
    got = {r.page_id: (r.template, r.share) for r in op1_url_templates(spark, sf).collect()}
    for at, i in enumerate(sorted(pages)):
        assert got[i][0] == want[at][0] and got[i][1] == pytest.approx(want[at][1])


def test_long_common_paths_are_walked_in_one_step(spark):
    stem = "/".join(f"s{'abc'[i % 3]}" for i in range(2000))
    urls = [f"http://a.test/{stem}/{x}/{y}" for x in ("spam", "news") for y in ("ka", "kb", "kc", "kd", "ke", "kf", "la", "lb")] + [f"http://a.test/{stem}"]
    rows = same_whole(spark, urls, [Rule(f"a.test/{stem}/spam/k", BLOCK), Rule(f"a.test/{stem}/news/k", ALLOW)])
    assert {(r.template.split("/")[2001], r.verdict) for r in rows if r.path.count("/") > 2000} == {("spam", BLOCK), ("news", ALLOW)}
    assert next(r for r in rows if r.path.count("/") == 2000).template == f"/{stem}"
