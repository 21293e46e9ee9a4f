"""Calendar and calendar-aware measures.

All of it works on monthly totals (one row per dimension value and month), so
the windows hold at most the months of one dimension value.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.functions import months as M
from erario.functions.money import safe_ratio
from erario.operators.aggregate import total
from erario.operators.context import Context, month_selected, selected
from erario.schema import TOTAL_TYPE


def calendar(df: DataFrame, month: str = "periodo") -> DataFrame:
    """One row per day from the first month to the end of the last month."""
    bounds = df.agg(F.min(month).alias("_a"), F.last_day(F.max(month)).alias("_b"))
    day = F.col("Data")
    return (
        bounds.filter("_a IS NOT NULL")
        .select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("Data"))
        .select(
            "Data",
            F.year(day).alias("Ano"),
            F.month(day).alias("NumeroMes"),
            M.month_name(day).alias("NomeMes"),
            M.month_of(day).alias("InicioMes"),
            M.month_key(day).alias("OrdemMes"),
            M.month_label(day).alias("MesAno"),
        )
    )


def _months_of(df, months: DataFrame | None) -> DataFrame:
    """Where the calendar's bounds come from: a stored month list, else the fact."""
    return df if months is None else months


def calendar_months(df: DataFrame, context: Context = Context(), months=None) -> DataFrame:
    """First days of the calendar's months in the selection, with or without rows."""
    bounds = _months_of(df, months).agg(F.min("periodo").alias("_a"), F.max("periodo").alias("_b"))
    spine = bounds.filter("_a IS NOT NULL").select(
        F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("periodo")
    )
    return spine.filter(month_selected(context))


def wanted_months(context: Context) -> list[str] | None:
    """Months whose rows the selected months need: themselves and the ones before; None for all."""
    chosen = [set(m) for m in [context.months, *[v for c, v in context.clicked if c == "periodo"]] if m is not None]
    if not chosen:
        return None
    first = [date.fromisoformat(m) for m in set.intersection(*chosen)]
    before = [date(m.year - (m.month == 1), (m.month - 2) % 12 + 1, 1) for m in first]
    return sorted({m.isoformat() for m in [*first, *before]})


def _monthly(df, keys, context, measure, months=None, needed=None) -> tuple[DataFrame, Column]:
    """Monthly totals of the rows in context, and the calendar's last month.

    With a stored list of the table's months the context and the `needed` months filter the scan: a
    table partitioned by month opens these partitions alone. Without one the calendar has to come from
    the whole fact, so rows out of context are kept in the aggregation, without a value; reading
    `valor` and `_n` along with the last month makes both results use one shuffled aggregate.
    """
    inside = selected(context)
    if months is not None:
        rows = df.filter(inside)
        if needed is not None:
            rows = rows.filter(F.col("periodo").isin(*[F.lit(m).cast("date") for m in needed]))
        totals = rows.groupBy(*keys, "periodo").agg(F.sum(measure).cast(TOTAL_TYPE).alias("valor"))
        return totals, months.agg(F.max("periodo")).scalar()
    everything = df.groupBy(*keys, "periodo").agg(
        F.sum(F.when(inside, F.col(measure))).cast(TOTAL_TYPE).alias("valor"),
        F.count_if(inside).alias("_n"),
    )
    last = everything.agg(F.max(F.struct("periodo", "valor", "_n"))["periodo"]).scalar()
    return everything.filter("_n > 0").drop("_n"), last


def with_previous_month(df, keys=(), context=Context(), measure="valor_pago", months=None) -> DataFrame:
    """Current and previous-month value per key and selected month.

    A cell exists when either month has rows: each monthly total is emitted for
    its own month and, as previous value, for the next one. The previous month
    ignores the month selection; the cell itself has to be a selected calendar
    month. `months` is the table's stored list of months (`periodo`), where there is one.
    """
    totals, last = _monthly(df, keys, context.without_months(), measure, months, wanted_months(context))
    none = F.lit(None).cast(TOTAL_TYPE)
    cells = totals.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("periodo"), F.col("valor").alias("atual"), none.alias("anterior")
                ),
                F.struct(
                    F.add_months("periodo", 1).alias("periodo"),
                    none.alias("atual"),
                    F.col("valor").alias("anterior"),
                ),
            )
        ),
    )
    return (
        cells.filter(month_selected(context) & (F.col("periodo") <= last))
        .groupBy(*keys, "periodo")
        .agg(total("atual"), total("anterior"))
    )


def variation(current: Column, previous: Column) -> Column:
    """Difference, NULL unless both sides are known."""
    return (current - previous).cast(TOTAL_TYPE)


def with_variation(df, keys=(), context=Context(), measure="valor_pago", months=None) -> DataFrame:
    """Current, previous, difference and relative difference per key and month."""
    current, previous = F.col("atual"), F.col("anterior")
    difference = variation(current, previous)
    return with_previous_month(df, keys, context, measure, months).select(
        *keys,
        "periodo",
        "atual",
        "anterior",
        difference.alias("variacao"),
        safe_ratio(difference, previous).alias("variacao_pct"),
    )


def last_month_variation(df, keys=(), context=Context(), measure="valor_pago", months=None) -> DataFrame:
    """`with_variation` at the last selected calendar month, as a card shows it."""
    last = calendar_months(df, context, months).agg(F.max("periodo")).scalar()
    return with_variation(df, keys, context, measure, months).filter(F.col("periodo") == last)


def running_total(df, keys=(), context=Context(), measure="valor_pago", months=None) -> DataFrame:
    """Total accumulated over the selected months, up to each selected month.

    A month without rows repeats the total reached before it. Months before the
    first one with rows have no total.
    """
    totals, last = _monthly(df, keys, context, measure, months)
    spine = (
        totals.groupBy(*keys)
        .agg(F.min("periodo").alias("_a"))
        .filter("_a IS NOT NULL")
        .select(*keys, "_a", last.alias("_b"))
        .select(
            *keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("periodo")
        )
        .filter(month_selected(context))
    )
    keyed = spine.unionByName(totals, allowMissingColumns=True).groupBy(*keys, "periodo").agg(
        F.sum("valor").alias("valor")
    )
    so_far = Window.partitionBy(*keys).orderBy("periodo").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return keyed.select(
        *keys, "periodo", F.sum("valor").over(so_far).cast(TOTAL_TYPE).alias("acumulado")
    )


def subtitle(df, context=Context(), months=None) -> DataFrame:
    """One row with the text that describes the selected months."""
    return (
        calendar_months(df, context, months)
        .agg(
            F.min("periodo").alias("_a"),
            F.max("periodo").alias("_b"),
            F.count("periodo").alias("_n"),
            F.array_sort(F.collect_set("periodo")).alias("_m"),
        )
        .select(
            M.period_subtitle(F.col("_a"), F.col("_b"), F.col("_n"), F.col("_m")).alias("subtitulo")
        )
    )


def join_calendar(df: DataFrame, days: DataFrame) -> DataFrame:
    """Fact rows with calendar attributes; unmatched rows keep blank attributes."""
    return df.join(days, F.to_date("periodo") == F.col("Data"), "left")
