"""Exact Brazilian money: strict parsing, display formats, safe division."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from erario.schema import MONEY_TYPE

# Fixed value: accepted money text. \A and \z because `$` lets a trailing newline through.
MONEY_PATTERN = r"\A[+-]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+)(,[0-9]{1,2})?\z"


def is_money(text: Column) -> Column:
    """True for blank or well-formed money text."""
    trimmed = F.trim(text)
    return (trimmed == "") | trimmed.rlike(MONEY_PATTERN)


def plain_digits(text: Column) -> Column:
    """`1.234,56` -> `1234.56`."""
    return F.translate(F.trim(text), ",.", ".")


def br_decimal(text: Column) -> Column:
    """DECIMAL(20,2) from Brazilian text: blank or absent is NULL, anything malformed fails the query.

    Values of 10^18 and above do not fit and fail too (ANSI cast).
    """
    trimmed = F.trim(text)
    return (
        F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(None).cast(MONEY_TYPE))
        .when(trimmed.rlike(MONEY_PATTERN), plain_digits(text).cast(MONEY_TYPE))
        .otherwise(
            F.raise_error(
                F.concat(F.lit("Valor monetário brasileiro inválido: "), text)
            ).cast(MONEY_TYPE)
        )
    )


def money_problem(text: Column) -> Column:
    """Why a money text would be refused, or NULL; used to report instead of fail."""
    trimmed = F.trim(text)
    return (
        F.when(~is_money(text), F.lit("valor inválido"))
        .when(
            (trimmed != "") & plain_digits(text).try_cast(MONEY_TYPE).isNull(),
            F.lit("excede DECIMAL(20,2)"),
        )
        .otherwise(F.lit(None).cast("string"))
    )


def money_text(amount: Column) -> Column:
    """`1234.5` -> `1.234,50`, the source notation."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def display_money(amount: Column) -> Column:
    """`R$ 1.234,50` with the sign in front; NULL stays NULL."""
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, F.lit("R$ "), money_text(F.abs(amount)))


def display_percent(ratio: Column) -> Column:
    """`0.1234` -> `12,34%`."""
    return F.concat(money_text((ratio * 100).cast("decimal(20,2)")), F.lit("%"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL on a zero or NULL denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def label(code: Column, name: Column) -> Column:
    """`code — name`; a missing part counts as empty text."""
    return F.concat(
        F.coalesce(code, F.lit("")), F.lit(" — "), F.coalesce(name, F.lit(""))
    )
