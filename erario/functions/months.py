"""Month arithmetic, pt-BR month names and the period subtitle."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pt-BR month names (date_format has no locale argument).
MONTH_NAMES = [
    "janeiro",
    "fevereiro",
    "março",
    "abril",
    "maio",
    "junho",
    "julho",
    "agosto",
    "setembro",
    "outubro",
    "novembro",
    "dezembro",
]


def month_of(day: Column) -> Column:
    return F.trunc(day.cast("date"), "MM")


def parse_month(text: Column) -> Column:
    """`2026/01` -> 2026-01-01."""
    return F.to_date(text, "yyyy/MM")


def is_month_text(text: Column) -> Column:
    return text.rlike(r"\A[0-9]{4}/(0[1-9]|1[0-2])\z")


def format_month(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM")


def month_key(day: Column) -> Column:
    """yyyymm as an integer, the sort key of month labels."""
    return F.year(day) * 100 + F.month(day)


def month_index(day: Column) -> Column:
    """Consecutive integer per calendar month, so `- 1` is the previous month."""
    return F.year(day) * 12 + F.month(day)


def month_name(day: Column) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.element_at(names, F.month(day))


def month_label(day: Column) -> Column:
    """`mar/2026`."""
    return F.concat(
        F.substring(month_name(day), 1, 3), F.lit("/"), F.date_format(day, "yyyy")
    )


def period_subtitle(first: Column, last: Column, count: Column, months: Column) -> Column:
    """Text describing a month selection.

    `months` is the sorted array of selected months; it is only read when the
    selection has gaps.
    """

    def name(day: Column) -> Column:
        text = month_name(day)
        return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 30))

    def year(day: Column) -> Column:
        return F.date_format(day, "yyyy")

    contiguous = count == month_index(last) - month_index(first) + 1
    listed = F.array_join(F.transform(months, month_label), ", ")
    text = (
        F.when(count == 0, "Sem período selecionado")
        .when(count == 1, F.concat(name(first), F.lit(" de "), year(first)))
        .when(~contiguous, listed)
        .when(
            F.year(first) == F.year(last),
            F.concat(name(first), F.lit(" a "), name(last), F.lit(" de "), year(last)),
        )
        .otherwise(
            F.concat(
                name(first), F.lit(" de "), year(first),
                F.lit(" a "), name(last), F.lit(" de "), year(last),
            )
        )
    )
    return F.concat(F.lit("Execução da despesa federal — "), text)
