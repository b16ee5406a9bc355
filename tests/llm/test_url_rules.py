import random

from hazecast.llm import url_rules


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h) + len(p), len(h)) > best[0]:
                best = ((len(h) + len(p), len(h)), h + p, v)
    return host, path, best[1] if best else None, best[2] if best else default


def test_equals_brute_force(spark):
    draw = random.Random(3)
    labels = ["a", "b", "com", "org", "x-y", "a" * 20, "é", ""]
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b?q=/z", "/a#x", "?a/", "#/a", "/b/" + "c" * 300]
    rules = {(".".join(draw.choice(labels[:6]) for _ in range(draw.randint(1, 3))), draw.choice(["", "/", "/a", "/a/", "/a/b"])):
             draw.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{draw.choice(['http', 'HTTPS', ''])}://" + ".".join(draw.choice(labels) for _ in range(draw.randint(1, 5))).replace("com", draw.choice(["com", "CoM"]))
            + draw.choice(paths) for _ in range(1500)]
    # a third of all rows is one url
    urls += [None, "", "no scheme", "a://", "x://b.com:80/a", "://"] + ["http://b.com/a/1"] * 800
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' AS key", "'y' AS host", "1 AS range")
    got = url_rules.judged(pages, spark.createDataFrame(rules, url_rules.RULES), ranges=7).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_ties_nulls_and_empty_tables(spark):
    schema = "page_id long, url string"
    rules = spark.createDataFrame([("a.com", "/", "block"), ("a.com", "/", "allow"), (None, None, "block")], url_rules.RULES)
    pages = spark.createDataFrame([(None, "http://a.com/x"), (None, "http://a.com/x"), (2, None)], schema)
    got = sorted(map(tuple, url_rules.judged(pages, rules).collect()), key=str)
    assert got == sorted([(None, "a.com", "/x", "a.com/", "allow")] * 2 + [(2, "", "", "", "block")], key=str)
    assert url_rules.judged(spark.createDataFrame([], schema), rules).count() == 0
    none = spark.createDataFrame([], url_rules.RULES)
    assert {r.verdict for r in url_rules.judged(pages, none, default="block").collect()} == {"block"}
