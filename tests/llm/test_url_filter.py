from molscreen.llm import url_filter as q


def plain(url):
    """(host, path) by hand."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in q.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/1234", "http://badexample.org/en/1", "HTTP://x.com/fr/a", "http://x.com/de/?q",
    "http://org", "http://org/", "a://b://c/d", "http://x.net?q=/fr/", "http://x.net#f", "http://spam.net/a.html", "http://www.spam.net/a/", "http://spam.net/b", "http://ÄÖ.org/ü",
    "http://spam.net/a.html",
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, verdict_note string")
    listed = spark.createDataFrame([("spam.net/a",), ("spam.net/a",), (None,), ("",)], "canonical string")
    rows = {r["page_id"]: r for r in q.judge(pages, listed).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain(u)
        text, verdict = rule(host, path)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["verdict_note"]) == (host, path, text, "x"), u
        on_list = (u or "").startswith(("http://spam.net/a", "http://www.spam.net/a"))
        assert r["listed"] == on_list
        assert r["verdict"] == (verdict or ("block" if on_list else "allow"))
    none = q.judge(pages, listed.limit(0)).collect()
    assert not any(r["listed"] or r["possible"] for r in none)
    assert q.judge(pages.limit(0), listed).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h/', id) AS canonical")
    asked = spark.range(1000, 9000).selectExpr("concat('h/', id) AS canonical")
    rows = q.listed_among(asked, listed).collect()
    assert sum(r["listed"] for r in rows) == 2000
    assert all(r["possible"] for r in rows if r["listed"])
    assert sum(r["possible"] and not r["listed"] for r in rows) < 60
    assert q.build(listed, 3000).count() <= q.blocks_for(3000)


def test_columns_may_have_any_name_and_one_url_half_the_rows(spark):
    urls = ["http://spam.net/a"] * 60 + [None] * 20 + [f"http://h{i}.net/" for i in range(40)] + ["http://spam.net/b"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    pages = pages.selectExpr("*", "7 as w0", "'x' as `a.b`", "8 as _block", "map(1, page_id) as m", "9 as _key", "'r' as row", "'p' as page", "'l' as listed", "'d' as _d", "'h' as host")
    listed = spark.createDataFrame([("spam.net/a",), ("h3.net",)], "canonical string")
    rows = q.judge(pages, listed).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["w0"], r["a.b"], r["_block"], r["m"], r["_key"], r["row"], r["page"], r["_d"]) == (7, "x", 8, {1: r["page_id"]}, 9, "r", "p", "d")
        assert r["listed"] == (urls[r["page_id"]] in ("http://spam.net/a", "http://h3.net/")) and r["host"] == plain(urls[r["page_id"]])[0]
    assert sum(r["listed"] for r in rows) == 61
