"""Secret scans with column functions only: fixed patterns and two character Markov models.

A long run of key characters is a secret if the model of random strings gives its characters a
higher likelihood than the model of ordinary identifiers. Both models are bigram counts, trained
from the table itself by labels that need no person: values that the fixed patterns mark are random,
long runs of letters in one case or joined by `_` and `-` are ordinary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, with the shortest counted length.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What the models judge: runs of key characters, if they hold a digit and a letter.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: What joins the parts of a run, and the shortest part or rest of a run that is judged, that of a counted assignment.
JOINT, PART = "[/=_-]", 12
ORDINARY = r"\b[A-Za-z][a-z]{11,}\b|\b[a-z]{3,}[_-][a-z_-]{3,}\b"
SPAN = "array<struct<start:int,end:int,kind:string>>"


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Code-point spans of the leftmost non-overlapping matches, `group` of `least` characters or more.

    The gaps between matches come from `split`, so starts are sums of lengths. A text without a match,
    or null, gives an empty array without further work.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    step = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))).alias("at"),
            F.when(x["whole"].isNull(), acc["found"]).otherwise(
                F.concat(
                    acc["found"],
                    F.array(F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["whole"])).alias("end"),
                        (F.length(x["part"]) >= least).alias("ok"),
                    )),
                )
            ).alias("found"),
        ),
    )["found"]
    kept = F.transform(F.filter(step, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind")))
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": spans(text, ASSIGN, "assign", 2, 12),
        "access": spans(text, r"AKIA[A-Z0-9]{14,}", "access"),  # the same matches: a run has one end
        "hex": spans(text, r"[0-9a-f]{16,}", "hex"),
    }


def _bigrams(strings: DataFrame, name: str) -> DataFrame:
    """Counts of character pairs, `^` before the first; letters keep their case."""
    padded = F.concat(F.lit("^"), "s")
    pairs = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(padded, i, F.lit(2)))
    return strings.filter("length(s) > 0").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias(name))


def models(docs: DataFrame) -> list[tuple[str, float]]:
    """Log-likelihood ratio of each character pair, random against ordinary; at most 65 x 66 rows.

    Counts come from every text. Each pair's chance is smoothed over the 64 key characters and `=`.
    """
    text = docs.select("text")
    secret = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(r"AKIA[A-Z0-9]{14,}"), F.lit(0)),
    )
    marked = text.filter(F.rlike("text", F.lit(ASSIGN)) | F.col("text").contains("AKIA"))
    marked = marked.select(F.explode(secret).alias("s")).filter("length(s) >= 12")
    marked = marked.filter(F.rlike("s", F.lit("[0-9]")) & F.rlike("s", F.lit("[A-Za-z]")))
    plain = text.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("s"))
    both = _bigrams(marked, "random").join(_bigrams(plain, "ordinary"), "pair", "full_outer").na.fill(0, ["random", "ordinary"])
    rows = both.filter(F.rlike("pair", F.lit(r"^[\^A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$"))).collect()
    total: dict[str, list[int]] = {}
    for r in rows:
        t = total.setdefault(r["pair"][0], [0, 0])
        t[0] += r["random"]
        t[1] += r["ordinary"]
    import math

    out = []
    for r in sorted(rows, key=lambda r: r["pair"]):
        n, m = total[r["pair"][0]]
        out.append((r["pair"], math.log((r["random"] + 0.5) / (n + 0.5 * 65)) - math.log((r["ordinary"] + 0.5) / (m + 0.5 * 65))))
    return out


def ratio(run: Column, model: list[tuple[str, float]]) -> Column:
    """Mean log-likelihood ratio of a run's character pairs; a pair that neither model saw says nothing."""
    if not model:
        return F.lit(0.0)
    pairs = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(F.concat(F.lit("^"), run), i, F.lit(2)))
    table = F.create_map(*[F.lit(x) for pair in model for x in pair])
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.coalesce(table[p], F.lit(0.0))) / F.length(run)


def rests(run: Column, known: Column) -> Column:
    """What the spans of `known` leave of `run`, as spans."""
    over = F.array_sort(F.filter(known, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])))
    span = lambda a, b: F.when(a < b, F.array(F.struct(a.alias("start"), b.alias("end"), F.lit("markov").alias("kind")))).otherwise(F.array().cast(SPAN))
    return F.aggregate(
        over,
        F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("found")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["found"], span(acc["at"], b["start"])).cast(SPAN).alias("found")),
        lambda acc: F.concat(acc["found"], span(acc["at"], run["end"])).cast(SPAN),
    )


def parts(text: Column, rest: Column) -> Column:
    """The stretches of `rest` between `/`, `=`, `_` and `-`, as spans."""
    return F.aggregate(
        F.split(F.substring(text, rest["start"] + 1, rest["end"] - rest["start"]), JOINT, -1),
        F.struct(rest["start"].alias("at"), F.array().cast(SPAN).alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + 1).alias("at"),
            F.when(F.length(p) < PART, acc["found"]).otherwise(
                F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end"), F.lit("markov").alias("kind"))))
            ).cast(SPAN).alias("found"),
        ),
        lambda acc: acc["found"],
    )


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` and `_secrets`: all spans by start, then kind; `markov` spans are the models' own.

    Of a run of 20 key characters or more, what the fixed patterns leave is judged: a rest of PART
    characters or more, with a digit and a letter, whose mean ratio exceeds `threshold` is a `markov`
    span, else each part of it between `/`, `=`, `_` and `-` of which that is true. Null and empty texts have no
    span. Rows are judged one by one, so repeated rows repeat their spans.
    """
    model = models(docs)
    text = F.col("text")
    base = docs.withColumns({f"_{k}": c for k, c in base_spans(text).items()} | {"_runs": spans(text, RUN, "markov")})
    known = F.concat("_assign", "_access", "_hex")
    fresh = F.flatten(F.transform("_runs", lambda s: rests(s, known)))
    run = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    shaped = lambda s: (s["end"] - s["start"] >= PART) & F.rlike(run(s), F.lit("[0-9]")) & F.rlike(run(s), F.lit("[A-Za-z]"))
    random = lambda s: F.when(shaped(s), ratio(run(s), model) > threshold).otherwise(F.lit(False))
    likely = F.flatten(F.transform(
        F.filter(fresh, shaped), lambda s: F.when(random(s), F.array(s)).otherwise(F.filter(parts(text, s), random)).cast(SPAN)
    ))
    own = F.when(F.size("_runs") > 0, likely).otherwise(F.array().cast(SPAN))
    order = F.create_map(*[F.lit(x) for k, v in enumerate((*KINDS, "markov")) for x in (v, k)])
    ranked = lambda all_: F.transform(
        F.array_sort(F.transform(all_, lambda s: F.struct(s["start"], order[s["kind"]].alias("rank"), s["end"], s["kind"]))),
        lambda s: F.struct(s["start"], s["end"], s["kind"]),
    )
    return base.withColumns({"_base": ranked(known), "_secrets": ranked(F.concat(known, own))}).drop("_runs")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of `scan`."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(joined("_base"), "UTF-8"), 256).alias("base_sha256"),
        joined("_secrets").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """`docs` with each maximal run of secret characters replaced by `mark` and `n_chars` brought up to date.

    Overlapping spans are one run. Other texts and columns stay as they are.
    """
    found = scan(docs, threshold)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "_secrets",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
            ).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    new = F.when(F.size("_secrets") > 0, cut).otherwise(text)
    out = found.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
