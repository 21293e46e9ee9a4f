"""Registry: a query is a function of the input tables plus, where SQL can say it, its oracle."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from erario import fixtures
from erario.schema import BI_COLUMNS, BI_MEASURES, DEBT_LABEL, DEBT_PROGRAMS, FLAG, LINE_ID, OTHER_LABEL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Example arguments of the parameterised queries.
MONTH = "1998-03-01"
START, END = "1996-02-01", "1999-11-01"


def _bi_sql() -> str:
    columns = ", ".join(f'"{source}" AS {name}' for name, source in BI_COLUMNS.items())
    debt = ", ".join(f"'{p}'" for p in DEBT_PROGRAMS)
    program = BI_COLUMNS["codigo_programa"]
    return (
        f"SELECT {LINE_ID} AS id_registro, periodo, {columns}, "
        f"CASE WHEN \"{program}\" IN ({debt}) THEN '{DEBT_LABEL}' ELSE '{OTHER_LABEL}' END AS {FLAG} "
        "FROM despesas"
    )


# Relations an oracle may name, in dependency order.
_RELATIONS = {
    "fact": fixtures.fact_sql,
    "staging": fixtures.staging_sql,
    "despesas": fixtures.despesas_sql,
    "despesas_bi": _bi_sql,
}


def _with_relations(sql: str) -> str:
    named = lambda name, text: re.search(rf"\b{name}\b", text) is not None
    wanted, text = [], sql
    for name in reversed(_RELATIONS):
        if named(name, text):
            wanted.insert(0, name)
            text += _RELATIONS[name]()
    ctes = ",\n".join(f"{n} AS ({_RELATIONS[n]()})" for n in wanted)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query under `name`; `sql` is its DuckDB twin."""

    def register(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql:
            ORACLE[name] = _with_relations(sql)
        return function

    return register


def sums(*columns: str, of: str = "{}") -> str:
    """Exact sums named after their columns."""
    return ", ".join(f"CAST(sum({of.format(c)}) AS DECIMAL(38,2)) AS {c}" for c in columns or BI_MEASURES)


def quoted(*columns: str) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def between_sql() -> str:
    return f"periodo BETWEEN DATE '{START}' AND DATE '{END}'"
