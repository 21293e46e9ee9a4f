"""Rules by plain Python, and suffix rates without a url's own label."""

from pyspark.sql import functions as F

from erario.llm import url_filter

URLS = [
    "http://A.example.com/de/x?y=1", "https://net/x", "http://notnet/x", "http://b.net", "http://b.net/", "http://www.example.net/en/5#z", "http://example.net/en", "org/fr/", "http://x.org/fr/a",
    "http://x.org/FR/a", "http://example.com:80/de/", "x://", "", None, "http://h.org?q=/fr/", "http://h.org/fr/http://net/", "http://casino.tld/a", "http://casino.tld/a",
]


def plain(url):
    """Host, path and the longest rule that fits."""
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end].lower(), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


def test_host_path_and_rule(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdicts[rule] if rule else "block" if got[i]["score"] > 0 else "allow")


def test_rates_leave_out_the_own_label_at_scoring_too(spark):
    rows = [(f"http://a.b.c/{i}", float(i < 3)) for i in range(40)] + [("http://z.z.z/", 1.0)]
    urls = url_filter.parts(spark.createDataFrame(rows, "url string, label double"))
    stats = url_filter.suffix_stats(urls)
    for r in url_filter.features(urls, stats).collect():
        bad, n = (3, 40) if "a.b.c" in r.url else (1, 1)
        assert abs(r.suffix_rate - (bad - r.label + 0.1) / n) < 1e-12
    unknown = urls.limit(1).withColumn("label", F.lit(None).cast("double"))
    assert abs(url_filter.features(unknown, stats).first().suffix_rate - 3.1 / 41) < 1e-12
