import random

import pytest
from ordlens.llm import urlfilter

PAGES = "page_id long, url string, html string, rule string, code int"


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h))
           and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


@pytest.mark.parametrize("limit", [1 << 20, 4])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "MAX_FILTER_BYTES", limit)  # at 4 bytes the join takes over
    r = random.Random(5)
    names = ["a", "b", "cc", "www", "x-y", "Ex"]
    host = lambda: ".".join(r.choice(names) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice(["en", "e", "fr", "q"]) for _ in range(r.randint(0, 3)))
    rules = list({(host().lower(), p[: r.randint(0, len(p))], r.choice(["allow", "block"])) for p in [path() for _ in range(60)]})
    urls = [f"http://{host()}{path()}{r.choice(['', '?a=/b', '#z', '?x://y'])}" for _ in range(400)]
    urls += [None, "", "no scheme/com/", "http://", "://a?/en", "http://A.b:80/en/", "ftp://a..b/e", "http://a/é/en", urls[0], urls[0]]
    pages = spark.createDataFrame([(i if i % 9 else None, u, None, "r", 1) for i, u in enumerate(urls)], PAGES)
    got = urlfilter.url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = sorted((str(i if i % 9 else None), *map(str, verdict(u, rules))) for i, u in enumerate(urls))
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_cascade_is_exact_over_the_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    df = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    listed = set(random.Random(1).sample(keys, 700)) | {"outside"}
    c = urlfilter.Cascade(df(listed), df(keys))
    assert len(c.levels) > 1
    got = urlfilter._hashed(df(keys)).withColumn("h", urlfilter.pandas_walk(c.levels)("h1", "h2")).collect()
    assert {r.key for r in got if r.h} == listed - {"outside"}


def test_empty(spark):
    none = spark.createDataFrame([], PAGES)
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert urlfilter.url_verdicts(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/", None, None, None)], PAGES)
    assert [tuple(r) for r in urlfilter.url_verdicts(one, rules.limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]


@pytest.mark.parametrize("limit", [1 << 20, 4])
def test_every_path_length_counts(spark, monkeypatch, limit):
    """Rules of 1,200 different path lengths: each decides the URL of its own length."""
    monkeypatch.setattr(urlfilter, "MAX_FILTER_BYTES", limit)
    paths = ["/" + "p" * n for n in range(1200)]
    rules = spark.createDataFrame([("a.com", p, "block" if i % 2 else "allow") for i, p in enumerate(paths)],
                                  "host string, path string, verdict string")
    some = [*range(0, 1200, 60), 1199]
    pages = spark.createDataFrame([(i, f"http://a.com{paths[i]}", None, None, None) for i in some], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_verdicts(pages, rules).collect()}
    assert got == {i: ("a.com" + paths[i], "block" if i % 2 else "allow") for i in some}
