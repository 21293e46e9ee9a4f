"""URL filter: listed rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); the longest rule that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Name parts whose hosts label the training urls as unwanted (fixed values of the query, a parameter of `train`).
UNWANTED = ("casino", "bets", "pills", "ads", "porn", "poker", "loans")
#: Labelled urls that fit the trees at most.
FIT_ROWS = 20_000
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix_rate", "suffix_rows")
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 32
#: Shares into which the rows of one suffix are dealt where they meet its statistics.
SALTS = 32


def parts(urls: DataFrame) -> DataFrame:
    """`urls` with `host` and `path`; both are empty for null or a url without `://`."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.withColumns({"host": F.coalesce(F.translate(host, upper, lower), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_of() -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null for none."""
    name = verdict = F.lit(None).cast("string")
    for host, path, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # the longest is the outermost test
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def labelled(urls: DataFrame, unwanted: tuple[str, ...] = UNWANTED) -> Column:
    """1.0 where a part of the host's name is listed as unwanted, else 0.0."""
    return F.arrays_overlap(F.split("host", r"[.-]"), F.array(*[F.lit(w) for w in unwanted])).cast("double")


def features(urls: DataFrame, stats: DataFrame) -> DataFrame:
    """`urls` (with host, path, label) and the columns FEATURES; `stats` has the labels of each host suffix.

    A url's own label is left out of its suffix's rate, so that no feature tells it: `stats` must count
    each url whose `label` is not null. Rows of one suffix are spread over SALTS tasks.
    """
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    seen = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - seen(c) * F.log2(seen(c)))
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    salted = urls.withColumns({"suffix": suffix(), "salt": F.pmod(F.xxhash64(*urls.columns), F.lit(SALTS))})
    copies = stats.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(copies, ["suffix", "salt"], "left")
    own = F.col("label").isNotNull().cast("int")
    others = F.coalesce("suffix_n", F.lit(0)) - own
    return joined.withColumns({
        "length": n.cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"),
        "digits": F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0).cast("double"),
        "labels": (count(F.col("host"), ".") + 1).cast("double"),
        "hyphens": count(F.col("host"), "-").cast("double"),
        "suffix_rate": (F.coalesce("suffix_bad", F.lit(0.0)) - F.coalesce("label", F.lit(0.0)) + 0.1) / (others + 1),
        "suffix_rows": F.log1p(others.cast("double")),
    }).drop("suffix", "salt", "suffix_n", "suffix_bad")


def suffix() -> Column:
    """The host's last three labels, or all of a shorter one."""
    return F.substring_index("host", ".", -3)


def suffix_stats(labels: DataFrame) -> DataFrame:
    """Urls and unwanted ones of each suffix, from all labelled urls (`host, label`)."""
    return labels.groupBy(suffix().alias("suffix")).agg(F.count("*").alias("suffix_n"), F.sum("label").alias("suffix_bad"))


def boost(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Trees of nested `(feature, threshold, left, right)` or leaf values, logistic loss, histogram splits."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    z, trees = np.full(len(y), prior), [prior]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(-RATE * g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-6, None, None)
        if depth and len(rows) >= 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j, c in enumerate(cuts):
                left_g = np.cumsum(np.bincount(bins[rows, j], g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(bins[rows, j], h[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (g[rows].sum() - left_g) ** 2 / (h[rows].sum() - left_h + 1) - whole
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            z[rows] += leaf
            return leaf
        _, j, k = best
        low = bins[rows, j] <= k
        return (FEATURES[j], float(cuts[j][k]), grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH))
    return trees


def score(trees: list) -> Column:
    """The trees' sum of log-odds as one column."""

    def node(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(F.col(t[0]) <= t[1], node(t[2])).otherwise(node(t[3]))

    total = F.lit(float(trees[0]))
    for t in trees[1:]:
        total = total + node(t)
    return total


def train(labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list, DataFrame]:
    """Trees and suffix statistics from `url, host, path, label`.

    Suffix statistics count all labelled urls; the trees are fitted on at most `rows` of them, those of
    the smallest hashes.
    """
    stats = suffix_stats(labels)
    key = F.xxhash64("url")
    picked = labels.filter(F.col("url").isNotNull()).orderBy(key, "url").limit(rows)
    own = features(picked.select("url", "host", "path", "label"), stats)
    table = own.select(*FEATURES, "label").toPandas().to_numpy(float)
    if not len(table):
        return [0.0], stats
    return boost(np.nan_to_num(table[:, :-1]), table[:, -1]), stats


def judge(pages: DataFrame) -> DataFrame:
    """Per page: `page_id, host, path, rule, verdict, score`; a page without a rule goes by the trees.

    A null url, or one without `://`, has an empty host and path, fits no rule and is scored on its
    characters. Repeated urls count as often as they occur. An empty table trains nothing.
    """
    urls = parts(pages.select("page_id", "url"))
    urls = urls.withColumn("label", labelled(urls))
    trees, stats = train(urls.select("url", "host", "path", "label"))
    rule, verdict = rule_of()
    scored = features(urls, stats).withColumns({"score": score(trees), "rule": rule})
    model = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(verdict, model).alias("verdict"), "score")
