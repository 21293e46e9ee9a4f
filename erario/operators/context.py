"""Filter context: slicers, cross-filtering and its modifiers."""

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """A selection per slicer, combined by AND; None selects everything.

    `months` are ISO first-of-month dates. `clicked` is a selection made on a
    chart (column -> values); it narrows the other visuals, never the slicers.
    """

    months: tuple[str, ...] | None = None
    organs: tuple[str, ...] | None = None
    programs: tuple[str, ...] | None = None
    groups: tuple[str, ...] | None = None
    clicked: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def without_months(self) -> "Context":
        """Month filters removed, the others kept."""
        return replace(
            self, months=None, clicked=tuple(c for c in self.clicked if c[0] != "periodo")
        )


def _any_of(column: str, values) -> Column:
    if column == "periodo":
        return F.col(column).isin(*[F.lit(v).cast("date") for v in values])
    return F.col(column).isin(*values)


def selected(context: Context = Context()) -> Column:
    """Condition that a fact row is in the context."""
    selections = [
        ("periodo", context.months),
        ("nome_orgao_superior", context.organs),
        ("codigo_programa", context.programs),
        ("nome_grupo_despesa", context.groups),
        *context.clicked,
    ]
    chosen = [_any_of(column, values) for column, values in selections if values is not None]
    return reduce(Column.__and__, chosen, F.lit(True))


def apply_context(df: DataFrame, context: Context = Context()) -> DataFrame:
    return df.filter(selected(context))


def month_selected(context: Context) -> Column:
    """Condition that a calendar month is in the slicer and in any clicked months."""
    clicked = tuple(c for c in context.clicked if c[0] == "periodo")
    return selected(Context(months=context.months, clicked=clicked))
