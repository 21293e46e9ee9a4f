"""Loads: one month, appended months, ranges, rebuilds; export and publication.

A load writes its rows once, under `carga=<run>`, and becomes visible only when
its ledger version is created. A job that dies in between leaves files nobody
reads, and running it again is safe. Readers take the runs the ledger names.

    <root>/textos/carga=<run>/                          while the load runs
    <root>/staging_despesas/carga=<run>/periodo=<month>/
    <root>/despesas/carga=<run>/periodo=<month>/
    <root>/perfis/carga=<run>/
    <root>/agregados/carga=<run>/no=<node>/
    <root>/ledger/<version>.json
    <root>/control/
"""

import uuid
from dataclasses import dataclass

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erario.functions.identity import global_id
from erario.functions.money import money_problem
from erario.functions.months import format_month, is_month_text, parse_month
from erario.operators.aggregate import ROWS, between, evolution, ranking
from erario.operators.compare import fingerprint, located_difference, multiset_difference
from erario.operators.quality import monthly_validation, repeated_rows_by
from erario.plans import checks, commits, lattice, model, profiles, report
from erario.schema import (
    BI_MEASURES, GROUP, LEDGER_SCHEMA, LINE_ID, MONEY_COLUMNS, MONTH_TEXT, ORGAN, PROGRAM,
    ACTION, SOURCE_COLUMNS, STAGING_SCHEMA, ID_BLOCK,
)
from erario.sources import archive, months, stream
from erario.sources.delimited import read_bi, round_trip_differences, write_csv


F_ALL = "todos"

REQUIRED_TABLES = ["despesas_bi", *model.VIEW_KEYS]


class LoadError(ValueError):
    """A load was refused; what was published before is unchanged."""


@dataclass(frozen=True)
class Store:
    """A budget table under one root folder."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """Number of the last ledger version; 0 before the first load."""
        return commits.latest(self.spark, f"{self.root}/ledger")

    def log(self) -> DataFrame:
        """Load records of every generation, with their versions."""
        return commits.log(self.spark, f"{self.root}/ledger")

    def ledger(self) -> DataFrame:
        """Load records of the current generation."""
        everything = self.log()
        current = everything.agg(F.max("geracao")).scalar()
        return everything.filter(F.col("geracao") == current).select(*LEDGER_SCHEMA.names)

    def is_incremental(self) -> bool:
        return bool(self._read("control", T.StructType([T.StructField("version", T.IntegerType())])).take(1))

    def _table(self, name: str) -> DataFrame:
        # One entry per month loaded: a short list, and a partition filter.
        runs = [r.carga for r in self.ledger().select("carga").distinct().collect()]
        if not runs:
            raise LoadError("Nenhum mês foi carregado ainda.")
        return (
            self.spark.read.parquet(f"{self.root}/{name}")
            .filter(F.col("carga").isin(runs))
            .drop("carga")
        )

    def staging(self) -> DataFrame:
        return self._table("staging_despesas").select(*STAGING_SCHEMA.names)

    def despesas(self) -> DataFrame:
        return self._table("despesas").select(*SOURCE_COLUMNS, LINE_ID, "periodo")

    def profiles(self) -> DataFrame:
        """The stored profile of each month."""
        return self._table("perfis").select("periodo", *profiles.columns())

    def node(self, keys) -> DataFrame:
        """The smallest stored aggregate that answers a grouping by `keys`, else the fact.

        Grouped operators take it in place of `bi()` and never open the table.
        """
        stored = self._table("agregados")
        name = lattice.smallest(keys, {r.no: r["count"] for r in stored.groupBy("no").count().collect()})
        if name is None:
            return self.bi()
        return stored.filter(F.col("no") == name).select("periodo", *lattice.NODES[name], ROWS, *BI_MEASURES)

    def views(self) -> dict[str, DataFrame]:
        """The published views, from the stored leaf."""
        return lattice.views(self.node(lattice.NODES["folha"]))

    def months(self) -> DataFrame:
        """The months of the table, from its profiles: a few rows, no scan of the table."""
        return self.profiles().select("periodo")

    def bi(self) -> DataFrame:
        return model.bi_projection(self.despesas())


# --- append plan --------------------------------------------------------------------

NEW, SAME, CHANGED = "a carregar", "nada a fazer: o mesmo arquivo já está na tabela", "conflito: a tabela tem outro arquivo deste mês"


def append_plan(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """What an append does with each incoming month (periodo, sha256)."""
    known = ledger.select(F.col("periodo").alias("_p"), F.col("sha256").alias("_h"))
    return (
        incoming.join(known, F.col("periodo") == F.col("_p"), "left")
        .groupBy("periodo", "sha256")
        .agg(F.max("_h").alias("_max"), F.min("_h").alias("_min"))
        .select(
            "periodo",
            "sha256",
            F.when(F.col("_max").isNull(), NEW)
            .when((F.col("_max") == F.col("sha256")) & (F.col("_min") == F.col("sha256")), SAME)
            .otherwise(CHANGED)
            .alias("situacao"),
        )
    )


# --- writing a run ------------------------------------------------------------------

def record_problems(records: DataFrame, wrong_month) -> DataFrame:
    """Records a load refuses: shape, line number, month or money text."""
    money = [
        F.concat(F.lit(f"{c}: "), money_problem(F.col(f"`{c}`")))  # NULL when there is none
        for c in MONEY_COLUMNS
    ]
    month = F.col(f"`{MONTH_TEXT}`")
    reason = F.coalesce(
        F.col("problema"),
        F.when(~is_month_text(month) | wrong_month, F.concat(F.lit("período alheio ao arquivo: "), month)),
        F.when(F.col(LINE_ID) % ID_BLOCK == 0, F.lit("linha sem identificador livre no bloco do mês")),
        *money,
    )
    return records.select("arquivo", LINE_ID, reason.alias("motivo")).filter("motivo IS NOT NULL")


def _refuse(found: dict[str, DataFrame]) -> None:
    try:
        checks.gate(found)
    except checks.CheckFailed as failed:
        raise LoadError(str(failed)) from None


@dataclass(frozen=True)
class Run:
    """What one load wrote and nobody reads yet."""

    name: str
    texts: DataFrame
    staged: DataFrame
    typed: DataFrame
    profiles: DataFrame
    entries: DataFrame


def _write_run(store: Store, listing, member, expected_month, offset: bool, source: str) -> Run:
    """Write the staged and typed rows of some archives, and the profiles of their months.

    The archives are read once, into the text of their records; what is wrong with a record travels
    along and is refused before anything is typed.
    """
    spark, run = store.spark, uuid.uuid4().hex
    folder = lambda name: f"{store.root}/{name}/carga={run}"
    archive.record_texts(archive.lines(spark, [r.caminho for r in listing], member)).write.parquet(folder("textos"))
    texts = spark.read.parquet(folder("textos"))
    text = F.col(f"`{MONTH_TEXT}`")
    month = F.when(is_month_text(text), parse_month(text))
    parsed = archive.records(texts).withColumn("periodo", month)
    if offset:
        # Lines beyond the month's block keep a recognisable id and are refused.
        line = F.when(F.col(LINE_ID) < ID_BLOCK, F.col(LINE_ID)).otherwise(0)
        parsed = parsed.withColumn(LINE_ID, F.coalesce(global_id(line, F.col("periodo")), line))
    parsed.write.partitionBy("periodo").parquet(folder("staging_despesas"))
    kept = ["arquivo", "membro", *STAGING_SCHEMA.names, "problema"]
    staged = spark.read.parquet(folder("staging_despesas")).select(*kept, "periodo")
    _refuse({"Registros recusados": record_problems(staged, text != expected_month)})
    model.typed(staged.select(*STAGING_SCHEMA.names)).write.partitionBy("periodo").parquet(folder("despesas"))
    typed = spark.read.parquet(folder("despesas")).select(*SOURCE_COLUMNS, LINE_ID, "periodo")
    profiles.month_profiles(typed).coalesce(1).write.parquet(folder("perfis"))
    _write_nodes(store, typed, run)
    hashes = spark.createDataFrame(
        [(r.arquivo, r.sha256, r.periodo) for r in listing], "arquivo string, sha256 string, periodo string"
    )
    members = staged.groupBy("arquivo").agg(
        F.max("membro").alias("membro"), F.count(F.lit(1)).alias("registros")
    )
    entries = hashes.join(members, "arquivo").select(
        F.lit(source).alias("origem"), "arquivo", "membro", "sha256", "periodo",
        F.lit(archive.ENCODING).alias("codificacao"), F.lit(archive.DELIMITER).alias("separador"),
        F.lit(len(SOURCE_COLUMNS)).alias("colunas"), "registros",
        F.current_timestamp().alias("carregado_em"), F.lit(pyspark.__version__).alias("versao"),
        F.lit(run).alias("carga"),
    )
    return Run(run, texts, staged, typed, spark.read.parquet(folder("perfis")), entries)


def _write_nodes(store: Store, typed: DataFrame, run: str) -> None:
    """The stored aggregates of a run; all nodes re-sum one shuffled aggregate."""
    nodes = lattice.nodes(lattice.leaf(model.bi_projection(typed)))
    nodes.write.partitionBy("no").parquet(f"{store.root}/agregados/carga={run}")


def source_audit(texts: DataFrame, hashes: DataFrame, single_member: bool = True) -> DataFrame:
    """Independent audit with month and hash: periodo, sha256, medida and the counts."""
    audited = archive.audit(texts, single_member)
    refused = audited.filter("problema IS NOT NULL").select("arquivo", "problema")
    _refuse({"A auditoria da origem recusa": refused})
    return audited.join(hashes, "arquivo").select(
        "periodo", "sha256", "medida", "registros", "soma", "negativos", "vazios"
    )


def _check_run(store: Store, run: Run, listing, single_member: bool = True) -> None:
    """The checks of a single run: header orders, counts, sums against the source, text, unchanged files."""
    hashes = run.entries.select("arquivo", "periodo", "sha256")
    _refuse(
        {
            "Número de registros ou de identidades": checks.cardinality(run.staged, run.typed),
            "Texto mudado ao tipar": checks.text_changes(run.staged, run.typed),
            "Somas diferentes das da origem": checks.audit_against_table(
                source_audit(run.texts, hashes, single_member), run.entries, run.typed
            ),
        }
    )
    _unchanged(store, listing)


def _unchanged(store, listing) -> None:
    now = {r.caminho: r.sha256 for r in archive.fingerprints(store.spark, [r.caminho for r in listing]).collect()}
    if any(now.get(r.caminho) != r.sha256 for r in listing):
        raise LoadError("Um arquivo de origem não é mais o que foi lido; a carga parou.")


def _publish(store: Store, run: Run, generation: int, base: int, still_holds) -> None:
    entries = run.entries.withColumn("geracao", F.lit(generation))
    try:
        commits.publish(store.spark, f"{store.root}/ledger", entries, base, still_holds)
    except commits.Conflict as lost:
        raise LoadError(f"A carga não foi publicada: {lost}.") from None
    commits.remove(store.spark, f"{store.root}/textos/carga={run.name}")


def _generation(store: Store) -> int:
    return store.log().agg(F.coalesce(F.max("geracao"), F.lit(0))).first()[0]


def _listing(spark, paths) -> list:
    """Fingerprint and month (from the file name) of each archive: one row per month.

    Spark's file sources leave out files of zero bytes, so the count is checked.
    """
    name = F.col("arquivo")
    listing = (
        archive.fingerprints(spark, paths)
        .withColumn("periodo", F.concat(F.substring(name, 1, 4), F.lit("/"), F.substring(name, 5, 2)))
        .collect()
    )
    if len(listing) != len(paths):
        raise LoadError(f"Há um arquivo vazio entre {sorted(paths)}.")
    return listing


# --- loads --------------------------------------------------------------------------

def load_month(store: Store, path: str, period: str = "2026/01", member=None, source: str = "") -> dict:
    """Load a single month, replacing what the table held; all or nothing."""
    months.check_interval(period.replace("/", ""), period.replace("/", ""))
    if store.is_incremental():
        raise LoadError("Esta tabela recebe meses; a substituição integral está bloqueada.")
    base = store.version()
    listing = [T.Row(**{**r.asDict(), "periodo": period}) for r in _listing(store.spark, [path])]
    run = _write_run(store, listing, member, F.lit(period), False, source)
    # a single file may have any name and neighbours, so the month it must hold is given
    _check_run(store, run, listing, single_member=False)
    _publish(store, run, _generation(store) + 1, base, lambda newer: False)
    return {"registros": run.typed.count(), "sha256": listing[0].sha256}


def append_months(store: Store, paths, source: str = "") -> list[dict]:
    """Add months to an incremental table in one job, or change nothing.

    A month already loaded from the same file is skipped; from another file the
    whole append is refused. Only the new months are read: they are validated in full, and added to
    the stored profiles of the others. `export` validates everything again.
    """
    if not store.is_incremental():
        raise LoadError("Esta tabela ainda não recebe meses; falta o mês inicial.")
    spark, base = store.spark, store.version()
    listing = _listing(spark, paths)
    incoming = spark.createDataFrame([(r.periodo, r.sha256) for r in listing], "periodo string, sha256 string")
    plan = {r.periodo: r.situacao for r in append_plan(incoming, store.ledger()).collect()}
    changed = sorted(p for p, s in plan.items() if s == CHANGED)
    if changed:
        raise LoadError(f"{CHANGED}: {changed}")
    new = [r for r in listing if plan[r.periodo] == NEW]
    results = [{"periodo": p, "status": SAME} for p, s in sorted(plan.items()) if s == SAME]
    if not new:
        return results
    file_month = F.concat(
        F.substring("arquivo", 1, 4), F.lit("/"), F.substring("arquivo", 5, 2)
    )
    run = _write_run(store, new, None, file_month, True, source)
    _check_run(store, run, new)
    validate(run.staged.select(*STAGING_SCHEMA.names), run.typed, run.entries)
    together = store.profiles().unionByName(run.profiles.select("periodo", *profiles.columns()))
    _refuse(
        {
            "Identificadores de dois meses se cruzam": profiles.overlapping(together),
            "Perfis e ledger contam registros diferentes": profiles.against_ledger(
                together, store.ledger().select("periodo", "registros").unionByName(run.entries.select("periodo", "registros"))
            ),
        }
    )
    wanted, generation = [r.periodo for r in new], max(_generation(store), 1)

    def still_holds(newer: DataFrame) -> bool:
        """No other writer has loaded one of these months, or replaced the table."""
        return not newer.filter(F.col("periodo").isin(wanted) | (F.col("geracao") != generation)).take(1)

    _publish(store, run, generation, base, still_holds)
    return results + [{"periodo": r.periodo, "status": "carregado"} for r in new]


def bootstrap(seed: Store, store: Store, expected: dict) -> None:
    """Start an incremental table from a validated one-month table.

    `expected` pins sha256, periodo, registros and valor_pago of the base month.
    The stored base month has to keep equalling the seed, cell by cell.
    """
    found = seed.ledger().select("sha256", "periodo", "registros").collect()
    wanted = [(expected["sha256"], expected["periodo"], expected["registros"])]
    if [tuple(r) for r in found] != wanted:
        raise LoadError("O mês inicial não vem do arquivo esperado.")
    facts = report.totals(seed.bi()).first()
    if (facts.quantidade_registros, facts.valor_pago) != (expected["registros"], expected["valor_pago"]):
        raise LoadError("A tabela inicial tem outros totais que os esperados.")
    base = store.version()
    if not base:
        run = uuid.uuid4().hex
        for name in ("staging_despesas", "despesas"):
            seed._table(name).write.partitionBy("periodo").parquet(f"{store.root}/{name}/carga={run}")
        seed._table("perfis").coalesce(1).write.parquet(f"{store.root}/perfis/carga={run}")
        _write_nodes(store, seed.despesas(), run)
        entries = seed.ledger().withColumn("carga", F.lit(run)).drop("geracao")
        # another bootstrap may have been first; its base month is compared below like one's own
        commits.publish(store.spark, f"{store.root}/ledger", entries.withColumn("geracao", F.lit(1)), 0, lambda newer: False)
    month = F.col(f"`{MONTH_TEXT}`") == expected["periodo"]
    pairs = {"tabela": (store.despesas(), seed.despesas()), "staging": (store.staging(), seed.staging())}
    _refuse(
        {
            f"O mês inicial tem outras células ({name})": checks.snapshot(mine.filter(month), theirs.filter(month))
            for name, (mine, theirs) in pairs.items()
        }
    )
    if not store.is_incremental():
        store.spark.range(1).select(F.lit(1).alias("version")).coalesce(1).write.mode("append").parquet(
            f"{store.root}/control"
        )
    validate(store.staging(), store.despesas(), store.ledger())


def _archives(spark, raw: str, start: str, end: str) -> list[str]:
    """Paths of the interval's archives; fails before any load when one is missing."""
    months.check_interval(start, end)
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{months.SUFFIX}").load(raw).select("path")
    )
    name = F.element_at(F.split("path", "/"), -1)
    found = listed.select(
        F.to_date(F.substring(name, 1, 6), "yyyyMM").alias("periodo"), "path"
    ).filter(name.rlike(r"\A[0-9]{4}(0[1-9]|1[0-2])_"))
    wanted = months.month_range(spark, start, end)
    missing = [r.periodo.strftime("%Y%m") for r in months.missing_months(wanted, found).collect()]
    if missing:
        raise LoadError(f"Meses ausentes da pasta: {sorted(missing)}; nada foi carregado.")
    return [r.path for r in found.join(wanted, "periodo").orderBy("periodo").collect()]


def load_range(store: Store, seed: Store, raw: str, start: str, end: str, source: str = "") -> list[dict]:
    """Seed with the first month, then append all the others in one job."""
    first, *others = _archives(store.spark, raw, start, end)
    period = f"{start[:4]}/{start[4:]}"
    loaded = load_month(seed, first, period, source=source)
    paid = report.totals(seed.bi()).first().valor_pago
    bootstrap(seed, store, {**loaded, "periodo": period, "valor_pago": paid})
    base = [{"periodo": period, "status": "carregado"}]
    return base + (append_months(store, others, source) if others else [])


@dataclass(frozen=True)
class Rebuilt:
    """The first of two equal builds, and what was compared."""

    store: Store
    export: str
    report: dict


def _build(spark, raw: str, base: str, start: str, end: str, pins: dict | None) -> tuple[Store, str]:
    """One build from the raw archives: header gate, loads with their audits, pinned totals, export."""
    paths = _archives(spark, raw, start, end)
    before = {r.caminho: r.sha256 for r in archive.fingerprints(spark, paths).collect()}
    heads = archive.headers(archive.record_texts(archive.lines(spark, paths)))
    orders = archive.header_orders(heads).withColumn("ordens", F.count(F.lit(1)).over(Window.partitionBy()))
    _refuse({"A ordem das colunas muda entre os arquivos": orders.filter("ordens > 1").drop("ordens")})
    store, output = Store(spark, f"{base}/consolidado"), f"{base}/export"
    load_range(store, Store(spark, f"{base}/inicial"), raw, start, end)
    if pins:
        wanted = spark.createDataFrame([(F_ALL, *pins.values())], ["_t", *pins])
        totals = report.totals(store.bi()).withColumn("_t", F.lit(F_ALL))
        expected = wanted.select("_t", *[F.col(c).cast(totals.schema[c].dataType).alias(c) for c in pins])
        _refuse({"Totais diferentes dos fixados": checks.differing(expected, totals, ["_t"], list(pins))})
    export(store, output, start, end)
    if before != {r.caminho: r.sha256 for r in archive.fingerprints(spark, paths).collect()}:
        raise LoadError("Um arquivo de origem mudou durante a reconstrução.")
    return store, output


def compare_tables(left: DataFrame, right: DataFrame, label: str) -> dict:
    """Equality of two BI tables as a report; refused with the size and some rows of the difference."""
    try:
        found = located_difference(left, right, BI_MEASURES)
    except ValueError as error:
        raise LoadError(f"{label}: {error}") from None
    size = found.size()
    if size:
        examples = "; ".join(r.linha for r in found.rows.select(F.to_json(F.struct("*")).alias("linha")).take(3))
        raise LoadError(f"{label}: {size} registros divergentes; {examples}")
    totals = report.totals(left).first()
    return {"registros_divergentes": size, "esquema": left.dtypes, **totals.asDict()}


def rebuild(spark, raw: str, root: str, start: str, end: str, pins: dict | None = None, earlier: str | None = None) -> Rebuilt:
    """Everything again from the raw archives, twice; both results have to be equal.

    `pins` are totals that the table must have (`quantidade_registros` and measures); `earlier` is the
    folder of an export to compare with. The root has to be new.
    """
    if commits.exists(spark, root):
        raise LoadError(f"A pasta {root} já existe.")
    (store, output), (other, _) = (_build(spark, raw, f"{root}/run{n}", start, end, pins) for n in ("1", "2"))
    found = {"reconstrucoes": compare_tables(store.bi(), other.bi(), "Reconstruções")}
    if earlier:
        found["exportacao_anterior"] = compare_tables(read_bi(spark, f"{earlier}/despesas_bi"), read_bi(spark, f"{output}/despesas_bi"), "Exportação anterior")
    return Rebuilt(store, output, found)


# --- validation ---------------------------------------------------------------------

def validate(staging: DataFrame, despesas: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every reconciliation of a table; returns the difference report, all zero."""
    bi = model.bi_projection(despesas)
    views = model.aggregate_views(bi)
    if broken := checks.type_contract(bi):
        raise LoadError(f"Tipos fora do contrato: {broken}")
    differences = checks.reconciliation(bi, views)
    _refuse(
        {
            "Identidades perdidas ou repetidas": checks.projection_ids(despesas, bi),
            "Medidas da projeção diferentes das da tabela": checks.projection_measures(despesas, bi),
            "Total de uma visão diferente": checks.view_totals(bi, views),
            "Mês de uma visão diferente": checks.view_months(bi, views),
            "Ledger e tabela contam registros diferentes": checks.ledger_rows(ledger, despesas),
            "Staging e tabela têm números diferentes": checks.cardinality(staging, despesas),
            "Soma de meses ou de visão diferente do total": differences.filter("diferenca <> 0"),
        }
    )
    return differences


def range_queries(bi: DataFrame, start, end) -> dict[str, DataFrame]:
    """The rankings, evolutions and totals of an inclusive month range."""
    df = between(bi, start, end)
    return {
        "ranking_orgaos": ranking(df, ORGAN),
        "ranking_programas": ranking(df, PROGRAM),
        "ranking_acoes": ranking(
            df, [*PROGRAM, *ACTION], ties=["codigo_programa", "codigo_acao", "nome_acao", "nome_programa"]
        ),
        "evolucao_orgao": evolution(df, ORGAN),
        "evolucao_programa": evolution(df, PROGRAM),
        "evolucao_grupo": evolution(df, GROUP, BI_MEASURES),
        "acumulado": report.totals(df).withColumnRenamed("quantidade_registros", "registros"),
    }


# --- export and publication ---------------------------------------------------------

def export(store: Store, output: str, start: str, end: str) -> DataFrame:
    """Write every view and the reports of an interval to a new folder; returns its manifest.

    Everything stored is validated again, against the profiles of the loads as well. A folder that
    exists is refused: a publication may point to it.
    """
    spark = store.spark
    if commits.exists(spark, output):
        raise LoadError(f"A pasta {output} já existe; uma exportação não é sobrescrita.")
    wanted = months.month_range(spark, start, end)
    _refuse({"Períodos da tabela e do intervalo": checks.interval(store.despesas(), wanted)})
    despesas = store.despesas()
    _refuse({"Meses mudados desde a carga": profiles.spoiled(store.profiles(), despesas)})
    differences = validate(store.staging(), despesas, store.ledger())
    bi = model.bi_projection(despesas)
    _refuse({"Agregados guardados diferentes da tabela": checks.view_months(bi, store.views())})
    tables = {"despesas_bi": bi, **model.aggregate_views(bi)}
    written = {}
    for name, df in tables.items():
        path = f"{output}/{name}"
        write_csv(df, path, order_by=["id_registro"] if name == "despesas_bi" else ())
        written[f"CSV diferente da tabela: {name}"] = round_trip_differences(df, path)
    _refuse(written)
    bounds = (f"{start[:4]}-{start[4:]}-01", f"{end[:4]}-{end[4:]}-01")
    reports = {
        "reconciliacao": differences,
        "mensal": monthly_validation(bi),
        "repeticoes": repeated_rows_by(store.staging().drop(LINE_ID), MONTH_TEXT),
        **range_queries(bi, *bounds),
    }
    for name, df in reports.items():
        df.write.json(f"{output}/validacao/{name}")
    manifest(spark, output).write.json(f"{output}/manifesto")
    return spark.read.json(f"{output}/manifesto")


def manifest(spark, output: str) -> DataFrame:
    """Folder, bytes and SHA-256 of every written data file."""
    written = stream.fingerprints(spark, output, recursiveFileLookup=True, pathGlobFilter="part-*")
    return written.filter(~F.col("caminho").contains("/manifesto/")).select(
        F.regexp_extract("caminho", r"([^/]+/)?[^/]+\z", 0).alias("arquivo"), "bytes", "sha256"
    )


PUBLICATION = "pasta string, impressao string, publicado_em timestamp, tabelas array<string>, arquivos bigint, versao bigint"


def publications(spark, target: str) -> DataFrame:
    """Publications of a target; the one of the highest version is current."""
    try:
        return spark.read.schema(PUBLICATION).json(f"{target}/publicacoes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLICATION)


def publish(spark, source: str, target: str) -> str:
    """Make a validated export the current publication of `target`.

    The export has to hold the required tables and reports, its files must match the manifest and
    every difference must be zero or NULL; an export equal to the current one is left alone. A
    publication is a list of outputs with one digest, created as one new version that names the
    export's folder, so readers never see half of it and earlier ones stay available.
    """
    folder = F.substring_index("arquivo", "/", 1)
    listed = spark.read.json(f"{source}/manifesto").select("arquivo", "sha256")
    held = {r[0] for r in listed.select(folder).distinct().collect()}
    if lacking := [t for t in [*REQUIRED_TABLES, "reconciliacao", "mensal"] if t not in held]:
        raise LoadError(f"A exportação está incompleta: falta {lacking}.")
    present = manifest(spark, source).select("arquivo", "sha256")
    _refuse({"Arquivo alterado depois de validado": multiset_difference(listed, present)})
    differences = spark.read.schema(
        "comparacao string, medida string, total decimal(38,2), diferenca decimal(38,2)"
    ).json(f"{source}/validacao/reconciliacao")
    if not differences.take(1):
        raise LoadError("A exportação não traz a reconciliação; nada foi publicado.")
    _refuse({"Diferenças na reconciliação": differences.filter("diferenca <> 0")})
    content = listed.filter(folder.isin(REQUIRED_TABLES)).select(folder.alias("tabela"), "sha256")
    mark = fingerprint(content).first()
    current = publications(spark, target).agg(F.max_by("impressao", "versao"), F.coalesce(F.max("versao"), F.lit(0))).first()
    if current[0] == mark.impressao:
        return "a publicação atual já tem estes dados: sem alterações"
    version = current[1] + 1
    entry = spark.range(1).select(
        F.lit(source).alias("pasta"), F.lit(mark.impressao).alias("impressao"), F.current_timestamp().alias("publicado_em"),
        F.array(*map(F.lit, REQUIRED_TABLES)).alias("tabelas"), F.lit(mark.registros).alias("arquivos"), F.lit(version).alias("versao"),
    )
    line = entry.select(F.to_json(F.struct("*"))).first()[0]
    if not commits.create_exclusively(spark, f"{target}/publicacoes/{version:012d}.json", [line]):
        raise LoadError("Outra publicação foi feita ao mesmo tempo; nada mudou.")
    return "publicação atualizada"
