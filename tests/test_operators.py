"""Operators against brute force in plain Python."""

import random
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from erario.operators import aggregate, compare, quality, timeline
from erario.operators.context import Context, apply_context
from erario.plans import checks, model, report, scan
from erario.schema import BI_SCHEMA

MONTHS = [date(2025, 11, 1), date(2025, 12, 1), date(2026, 2, 1), date(2026, 3, 1), date(2026, 5, 1)]


def next_month(d, n=1):
    i = d.year * 12 + d.month - 1 + n
    return date(i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def records():
    """Rows with gaps, nulls, copies and one organ with most of the rows."""
    rng = random.Random(7)
    out = []
    for i in range(300):
        organ = "01" if rng.random() < 0.6 else rng.choice(["02", "03"])
        month = rng.choice(MONTHS[:3] if organ == "03" else MONTHS)
        program = rng.choice(["0905", "0909", "0910"])
        paid = rng.choice([None, Decimal("0.00"), Decimal(rng.randint(-500, 900)).scaleb(-2)])
        value = Decimal(rng.randint(0, 3))
        out.append(
            (i, month, organ, "ORGAO " + organ, "10", "F", program, "PROGRAMA", "0001", "A", "3", "G" + organ,
             value, value, paid, value, "x")
        )
    return out


@pytest.fixture(scope="module")
def bi(spark, records):
    return spark.createDataFrame(records, BI_SCHEMA).repartition(3).cache()


def paid_by(records, keep=lambda r: True):
    """(organ, month) -> list of paid values."""
    cells = defaultdict(list)
    for r in records:
        if keep(r):
            cells[r[2], r[1]].append(r[14])
    return cells


def add(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


@pytest.mark.parametrize(
    "context",
    [
        Context(),
        Context(months=("2025-12-01", "2026-03-01", "2026-04-01")),
        Context(programs=("0905",), organs=("ORGAO 01", "ORGAO 03")),
        Context(months=("2026-05-01", "2026-06-01"), clicked=(("codigo_programa", ("0909", "0910")),)),
    ],
)
def test_variation_and_running_total(spark, records, bi, context):
    def keep(r):
        return (
            (context.programs is None or r[6] in context.programs)
            and (context.organs is None or r[3] in context.organs)
            and all(r[6] in values for _, values in context.clicked)
        )

    cells = paid_by(records, keep)
    calendar = [MONTHS[0]]
    while calendar[-1] < MONTHS[-1]:
        calendar.append(next_month(calendar[-1]))
    chosen = [m for m in calendar if context.months is None or m.isoformat() in context.months]
    expected, running = {}, {}
    for organ in {o for o, _ in cells}:
        for m in chosen:
            here, before = cells.get((organ, m)), cells.get((organ, next_month(m, -1)))
            if here is not None or before is not None:
                cur, prev = add(here or []), add(before or [])
                both = cur is not None and prev is not None
                diff = cur - prev if both else None
                expected[organ, m] = (cur, prev, diff, float(diff) / float(prev) if both and prev else None)
            past = [v for (o, p), vs in cells.items() if o == organ and p <= m and p in chosen for v in vs]
            if past:
                running[organ, m] = add(past)
    got = timeline.with_variation(bi, ["codigo_orgao_superior"], context).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == expected
    got = timeline.running_total(bi, ["codigo_orgao_superior"], context).collect()
    assert {(r[0], r[1]): r[2] for r in got} == running
    card = timeline.last_month_variation(bi, (), context).collect()
    assert len(card) <= 1 and all(r.periodo == max(chosen) for r in card)


def test_calendar_spans_whole_months(spark, bi):
    days = timeline.calendar(bi)
    assert days.count() == (date(2026, 6, 1) - MONTHS[0]).days
    assert days.filter("Data = '2026-03-31'").first().MesAno == "mar/2026"
    empty = timeline.calendar(bi.filter("1 = 0"))
    assert empty.count() == 0 and timeline.running_total(bi.filter("1 = 0")).count() == 0
    stray = bi.limit(1).withColumn("periodo", F.lit("1999-01-01").cast("date"))
    joined = timeline.join_calendar(bi.unionByName(stray), days)
    assert joined.count() == 301 and joined.filter("Ano IS NULL").count() == 1


def test_context_combines_by_and(records, bi):
    context = Context(months=("2026-02-01",), programs=("0905", "0909"), clicked=(("codigo_orgao_superior", ("01",)),))
    wanted = [r for r in records if r[1] == date(2026, 2, 1) and r[6] in ("0905", "0909") and r[2] == "01"]
    assert apply_context(bi, context).count() == len(wanted)
    assert context.without_months().months is None and context.without_months().programs == context.programs


def test_ranking_orders_nulls_last_and_ties_by_key(spark):
    df = spark.createDataFrame(
        [("b", "5"), ("a", "5"), ("c", None), ("d", "-1")], "k string, v string"
    ).withColumn("valor_pago", F.col("v").cast("decimal(20,2)"))
    assert [r.k for r in aggregate.ranking(df, ["k"]).collect()] == ["a", "b", "d", "c"]
    assert [r.k for r in aggregate.ranking(df, ["k"], limit=2).collect()] == ["a", "b"]


def test_subtotals(records, bi):
    flat = aggregate.rollup_totals(bi, ["codigo_orgao_superior", "codigo_programa"]).collect()
    by_level = Counter(r.nivel for r in flat)
    assert by_level == {0: 1, 1: 3, 2: 9}
    assert {r.quantidade_registros for r in flat if r.nivel == 0} == {300}
    cube = aggregate.cube_totals(bi, "codigo_orgao_superior", "periodo").collect()
    total = [r for r in cube if r.total_linhas and r.total_colunas]
    assert len(total) == 1 and total[0].valor_pago == add(r[14] for r in records)
    detail = report.record_detail(bi).collect()
    assert len(detail) == 301 and sum(r.total for r in detail) == 1
    assert sum(r.valor_empenhado for r in detail if not r.total) == [r for r in detail if r.total][0].valor_empenhado


def test_quality_profiles(records, bi):
    row = [r for r in quality.measure_quality(bi, ["valor_pago"]).collect()][0]
    paid = [r[14] for r in records]
    assert tuple(row) == (
        "valor_pago", 300, paid.count(None), sum(v == 0 for v in paid if v is not None),
        sum(v < 0 for v in paid if v is not None),
    )
    content = bi.drop("id_registro")
    counts = Counter(r[1:] for r in records)
    repeated = [n for n in counts.values() if n > 1]
    assert tuple(quality.duplicate_summary(content).first()) == (len(repeated), sum(n - 1 for n in repeated))
    by_month = Counter()
    for r, n in counts.items():
        by_month[r[0]] += n - 1
    got = {r.periodo: r.repeticoes for r in quality.repeated_rows_by(content, "periodo").collect()}
    assert got == {m: n for m, n in by_month.items() if n}


@pytest.mark.parametrize("sent", [0, 100_000])
def test_rows_of_one_hash_are_told_apart(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "SENT_HASHES", sent)
    cells = [("a", None), (None, "a"), ("a", ""), ("b", "x"), ("b", "x"), ("b", "x"), (None, None), (None, None), ("c", "c")]
    df = spark.createDataFrame(cells, "k string, `v.w` string").repartition(3)
    for key in (None, F.lit(7).cast("long")):
        assert {tuple(r) for r in quality.repeated_groups(df, key).collect()} == {("b", "x", 3), (None, None, 2)}
        assert tuple(quality.duplicate_summary(df, key).first()) == (2, 3)
        assert {tuple(r) for r in quality.repeated_rows_by(df, "k", key).collect()} == {("b", 2), (None, 1)}
    assert tuple(quality.duplicate_summary(df.filter("k = 'none'")).first()) == (0, 0)


def test_comparison(bi):
    content = bi.drop("id_registro")
    copy = content.repartition(5)
    assert compare.fingerprint(content).collect() == compare.fingerprint(copy).collect()
    assert compare.difference_size(content, copy).first()[0] == 0
    more = content.unionByName(content.filter("codigo_orgao_superior = '01'"))
    extra = content.filter("codigo_orgao_superior = '01'").count()
    assert compare.difference_size(content, more).first()[0] == extra
    assert compare.fingerprint(content).first().impressao != compare.fingerprint(more).first().impressao
    diff = compare.multiset_difference(content, more)
    assert diff.agg(F.sum(F.col("direita") - F.col("esquerda"))).first()[0] == extra
    profile = compare.logical_profile(bi, ["valor_pago"])
    assert compare.profile_difference(profile, profile).count() == 0
    late = compare.logical_profile(bi.filter("periodo < '2026-05-01'"), ["valor_pago"])
    assert [r.periodo for r in compare.profile_difference(profile, late).collect()] == [date(2026, 5, 1)]
    assert compare.fingerprint(bi.filter("1 = 0")).first().registros == 0


def test_view_checks_find_a_lost_month(bi):
    views = model.aggregate_views(bi)
    checks.gate({"a": checks.view_totals(bi, views), "b": checks.view_months(bi, views)})
    assert checks.reconciliation(bi, views).filter("diferenca <> 0").count() == 0
    views["despesas_por_mes"] = views["despesas_por_mes"].filter("periodo < '2026-05-01'")
    found = checks.view_months(bi, views).collect()
    assert {r.visao for r in found} == {"despesas_por_mes"} and {r.periodo for r in found} == {date(2026, 5, 1)}
    with pytest.raises(checks.CheckFailed, match="despesas_por_mes"):
        checks.gate({"visões": checks.view_months(bi, views)})
    # The other direction: a month only the view has.
    assert {r.periodo for r in checks.view_months(bi.filter("periodo < '2026-03-01'"), model.aggregate_views(bi)).collect()} == {
        date(2026, 3, 1), date(2026, 5, 1)
    }


def test_type_contract(bi):
    assert checks.type_contract(bi) == []
    broken = bi.withColumn("codigo_acao", F.lit(1)).withColumn("valor_pago", F.lit(1.0))
    assert checks.type_contract(broken) == ["codigo_acao: int", "valor_pago: double"]


def test_scan_reports_place_and_kind_only(spark):
    token, home = "ghp_" + "x" * 30, "C:" + "\\Users\\" + "Pessoa\\dados.csv"
    text = f"limpo\r\ntoken = {token}\nfonte {home} de a.b@c.org\n" + "Bearer " + "y" * 25
    df = spark.createDataFrame([("a", text), ("b", "nada aqui"), ("c", "z" * (11 << 20))], "f string, text string")
    got = sorted(tuple(r) for r in scan.scan(df, "f").collect() if r.linha)
    assert got == [
        ("a", 2, "possivel_segredo"), ("a", 3, "caminho_pessoal"), ("a", 3, "possivel_email"),
        ("a", 4, "possivel_segredo"),
    ]
    assert [tuple(r) for r in scan.oversize(df, "f").collect()] == [("c", None, scan.OVERSIZE)]


def test_scan_finds_addresses_with_accents(spark):
    lines = ["josé@exemplo.com", "x@ação.com.br", "É@b.co", "@b.co", "a@b", "a@.c", "ß" * 100_000, "a" * 100_000 + " ana@exemplo.com"]
    df = spark.createDataFrame([("a", "\n".join(lines))], "f string, text string")
    assert sorted(r.linha for r in scan.scan(df, "f").collect()) == [1, 2, 3, 8]


def test_fingerprint_uses_every_digit(spark):
    df = spark.createDataFrame([("0" * 64,), ("0" * 63 + "1",)], "h string")
    prints = df.groupBy("h").agg(compare.fingerprint_expr(F.col("h")).alias("p")).collect()
    assert len({r.p for r in prints}) == 2
