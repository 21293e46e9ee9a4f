"""Quality rules as a short-circuit cascade, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows on which cost and selectivity are estimated, on average. They decide the order, never a verdict.
SAMPLE_ROWS = 1000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


def measured(docs: DataFrame) -> DataFrame:
    """`docs` and the base columns of each whole text; null counts as empty.

    `_words` are the words. Repeated windows are found by 64-bit hashes: a text whose windows are all
    distinct, the usual case, stops at `_hashes`; the others sort (hash, start) pairs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, SPACES, " " * len(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    a = docs.withColumns({"_words": F.array_remove(F.split(plain, " "), ""), "_lines": lines})
    word = lambda i, j: F.get("_words", i + j)
    hashes = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[word(i, j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    b = a.withColumn("_hashes", hashes)
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs))
    at = lambda i: F.get("_pairs", i)["h"]
    twice = F.filter("_pairs", lambda p, i: F.coalesce(p["h"] == at(i - 1), F.lit(False)) | F.coalesce(p["h"] == at(i + 1), F.lit(False)))
    d = c.withColumn("_starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x,
    )
    return d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })


def rules() -> dict[str, tuple[Column, Column]]:
    """Reasons to reject, each on a whole text, and the characters and array elements that each one touches.

    Any one suffices. Names are those in `first_reason`. A test of base columns alone touches one value, as
    these are there for every row. A vocabulary hardly grows after some thousand words, so `few_words`
    asks for a twentieth of the words as distinct ones up to 2,000 words, and for 100 beyond.
    """
    text, n = F.col("text"), F.col("n_words")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    key = F.transform("_words", lambda w: F.xxhash64(w))
    echo = F.size(F.filter("_words", lambda w, i: F.coalesce(w == F.get("_words", i - 1), F.lit(False))))
    ends = F.regexp_count(text, F.lit(r"[.!?](\s|\z)"))
    one = F.lit(1)
    return {
        "symbols": (F.col("n_symbols") * 4 > n, one),
        "word_length": ((F.col("word_chars") > 15 * n) | (F.col("word_chars") * 2 < 3 * n), one),
        "dup_lines": ((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 2 > F.size("_lines")), one),
        "upper_case": (upper * 2 > F.col("word_chars"), F.length(text)),
        "echo": (echo * 5 > n, 2 * n),
        "few_words": ((n >= 60) & (F.size(F.array_distinct(key)) * 20 < F.least(n, F.lit(2000))), F.when(n >= 60, F.col("word_chars") + n).otherwise(one)),
        "no_sentence": ((n >= 200) & (ends * 500 < n), F.when(n >= 200, F.length(text)).otherwise(one)),
    }


def greedy(patterns: list[tuple[list[bool], int, list[int]]], names: list[str]) -> list[str]:
    """Names by rejection per cost among the rows that the rules before leave.

    A pattern is which rules reject, its number of rows, and what each rule touches on them.
    """
    left, order = list(range(len(names))), []
    while left:
        worth = lambda k: (sum(n for hit, n, _ in patterns if hit[k]) + 0.5) / (sum(work[k] for _, _, work in patterns) + 1)
        best = max(left, key=lambda k: (worth(k), -k))
        left.remove(best)
        order.append(names[best])
        patterns = [p for p in patterns if not p[0][best]]
    return order


def cascade_order(docs: DataFrame, named: dict[str, tuple[Column, Column]], rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, each the one that rejects most per cost of what is left to it.

    Both are estimated on about `rows` rows (those of them that pass the base test), drawn in every partition at a
    rate that keeps their number at every size. One aggregate counts the rows of each pattern of
    rejecting rules (two to the power of their number at most), from which all conditional shares follow;
    costs are counts of characters and elements, so one sample has one order. The measured columns are
    stored, so that no filter moves below the columns it needs. An empty table keeps the given order.
    """
    share = min(1.0, rows / max(docs.count(), 1))
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(measured(docs.select("text").sample(share, seed=11)))
    hit = F.array(*[F.coalesce(rule, F.lit(False)) for rule, _ in named.values()])
    work = [F.sum(F.coalesce(cost, F.lit(0))).cast("long").alias(f"work{i}") for i, (_, cost) in enumerate(named.values())]
    found = sample.filter(~base_failed()).groupBy(hit.alias("hit")).agg(F.count("*").alias("n"), *work).collect()
    scratch.drop(sample)
    return greedy([(r["hit"], r["n"], [r[f"work{i}"] for i in range(len(named))]) for r in found], list(named))


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """`docs` with the base columns, `base_failed`, `first_reason` and `kept`.

    `kept` is false where the base test fails, else whether no rule rejects. `first_reason` is `base`
    or the rule of the cascade that fired first; later rules do not run on that row. It depends on the
    sample's order, `kept` does not. A null, empty or
    blank text has no word and fails the base test. Rows are judged one by one.
    """
    base = measured(docs)
    named = rules()
    order = order or cascade_order(docs, named)
    chain = F.when(base_failed(), F.lit("base"))
    for name in order:
        chain = chain.when(F.coalesce(named[name][0], F.lit(False)), F.lit(name))
    out = base.withColumns({"base_failed": base_failed(), "first_reason": chain})
    return out.withColumn("kept", F.col("first_reason").isNull())


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
