"""Monthly archives: one delimited file per ZIP, or plain delimited files, as records with line numbers.

A plain file is read as physical lines by many tasks; inflating a ZIP is sequential, so one task turns
its bytes into lines. From there on both are the same table, cut into records in parallel. Whether a
newline ends a record depends on all quotes before it, but each line only maps "outside quotes" and
"inside quotes" to one of the two. These maps are composed by windows over the lines of a piece, then
over the pieces of a file, which gives every piece its state and its number of records before it.

Nothing raises inside a task: what is wrong with an archive or a record is returned in `problema`, and
the loader refuses the load when there is any.
"""

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erario.schema import LINE_ID, MONEY_COLUMNS, MONTH_TEXT, SOURCE_COLUMNS
from erario.scratch import Scratch
from erario.sources import stream
from erario.sources.stream import fingerprints  # noqa: F401  (part of this module's interface)

ENCODING = "cp1252"
DELIMITER = ";"
#: Bytes of a piece of an inflated file; plain files are cut by the file source.
PIECE_BYTES = 8 << 20
#: Characters of a record; a longer one is refused, as an unclosed quote would take the rest of the file.
RECORD_CHARS = 1 << 20

LINES = "arquivo string, membro string, pedaco bigint, ordem bigint, linha string, membros int, problema string"

# Characters of cp1252 that ISO 8859-1 has controls for, and the bytes it leaves undefined.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_ISO = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


# --- physical lines -----------------------------------------------------------------

def decoded(line: Column, encoding: str = ENCODING) -> Column:
    """Text of raw bytes."""
    if encoding == ENCODING:
        return F.translate(F.decode(line, "ISO-8859-1"), _ISO, _CP1252)
    return F.decode(line, encoding)


def _inflated(member: str | None):
    def run(content: stream.FileBytes) -> Iterator[dict]:
        base = dict.fromkeys(f.split()[0] for f in LINES.split(", ")) | {"arquivo": content.name}
        found, members, number, size = [], 0, 0, 0
        try:
            for name, data in stream.zip_members(content):
                members += not name.endswith("/")
                if not name.lower().endswith(".csv") or member not in (None, name):
                    continue
                found.append(name)
                if len(found) > 1:
                    continue
                rest = b""
                for chunk in data:
                    *lines, rest = (rest + chunk).split(b"\n") if b"\n" in chunk else (rest + chunk,)
                    for line in lines:
                        yield base | {"membro": name, "pedaco": size // PIECE_BYTES, "ordem": number, "linha": line}
                        number, size = number + 1, size + len(line) + 1
                if rest:
                    yield base | {"membro": name, "pedaco": size // PIECE_BYTES, "ordem": number, "linha": rest}
                    number += 1
            if len(found) != 1:
                yield base | {"problema": f"é preciso escolher um CSV do arquivo entre: {sorted(found)}"}
            elif not number:
                yield base | {"membro": found[0], "problema": "CSV sem registros"}
            yield base | {"membro": next(iter(found), None), "membros": members}
        except Exception as error:  # returned as a problem, refused by the loader
            yield base | {"problema": f"{type(error).__name__}: {error}"}
        for _ in content:
            pass

    return run


def lines(spark: SparkSession, paths, member: str | None = None, encoding: str = ENCODING) -> DataFrame:
    """Physical lines of every file as LINES, without their newline.

    (pedaco, ordem) is their order. A ZIP also has a row with the number of its `membros`; a row with a
    `problema` says why an archive cannot be read.
    """
    raw = stream.rows(spark, paths)
    zipped = F.lower("arquivo").endswith(".zip")
    nothing = lambda kind: F.lit(None).cast(kind)
    plain = raw.filter(~zipped).select(
        "arquivo", F.col("arquivo").alias("membro"), F.col("bloco").alias("pedaco"), "ordem", "linha",
        nothing("int").alias("membros"), nothing("string").alias("problema"),
    )
    inflated = stream.whole_files(raw.filter(zipped), _inflated(member), LINES.replace("linha string", "linha binary"))
    both = plain.union(inflated)
    text = decoded(F.col("linha"), encoding)
    bad = F.lit(False) if encoding != ENCODING else F.coalesce(text.rlike(_UNDEFINED), F.lit(False))
    return both.withColumns(
        {"linha": text, "problema": F.when(bad, F.lit("byte fora da codificação cp1252")).otherwise(F.col("problema"))}
    )


# --- records ------------------------------------------------------------------------

def open_after(line: Column, start: bool, delimiter: str = DELIMITER) -> Column:
    """Whether the end of a line is inside quotes, if its start is or is not. A quote opens only at the start of a field."""
    d = f"\\{delimiter}" if delimiter in "|\\" else delimiter
    # fields up to the end, none left open; a line that starts inside quotes is one whose opening quote is put back
    field = f'(?:"[^"]*+"(?:[^"{d}]++|"[^"]*+")*+|[^"{d}][^{d}]*+|)'
    whole = F.concat(F.lit('"'), line) if start else line
    return F.when(line.contains('"'), ~whole.rlike(f"\\A{field}(?:{d}{field})*+\\z")).otherwise(F.lit(start))


def _states(df: DataFrame, keys: list[str], order: list[str], closed: str, opened: str) -> DataFrame:
    """`fechado`, `aberto`: the state before each row if its group starts outside, or inside, quotes.

    `closed` and `opened` are the states after a row for both states before it. A row that gives one
    state whatever was before it hides all rows ahead of it; the others either keep or swap the state,
    so the state is that of the last such row, swapped as often as the rows since then do.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col(closed) & ~F.col(opened)).cast("int")
    df = df.withColumn("_trocas", F.sum(swap).over(upto))
    fixed = F.when(F.col(closed) == F.col(opened), F.struct(F.col(closed).alias("estado"), F.col("_trocas").alias("trocas")))
    df = df.withColumn("_fixo", F.last(fixed, ignorenulls=True).over(ahead))
    odd = (F.col("_trocas") - swap - F.coalesce("_fixo.trocas", F.lit(0))) % 2 == 1
    state = lambda start: F.coalesce("_fixo.estado", F.lit(start)) != odd
    return df.withColumns({"fechado": state(False), "aberto": state(True)}).drop("_trocas", "_fixo")


def record_texts(line_df: DataFrame, delimiter: str = DELIMITER, scratch: Scratch | None = None) -> DataFrame:
    """arquivo, membro, registro, texto, membros, problema: one row per record, the header with number 0.

    A newline, a carriage return or both end a record outside quotes. Records of several lines keep
    their line ends inside. Rows that are no lines have number -1. With a `scratch` the lines are made
    once, their states are found without their texts, and the numbered lines are kept there.
    """
    keep = scratch.table if scratch else lambda df: df
    file, piece = ["arquivo"], ["arquivo", "pedaco"]
    sound = F.col("linha").isNotNull() & F.col("problema").isNull()
    # a carriage return of its own ends a line too
    inner = sound & F.col("linha").contains("\r") & F.col("linha").rlike(r"\r(?!\z)")
    parts = F.when(inner, F.split("linha", r"(?<=\r)(?!\z)")).otherwise(F.array("linha"))
    physical = line_df.select(
        "arquivo", "membro", "pedaco", "ordem", "membros", "problema", sound.alias("_linha"), F.size(parts).alias("_partes"), F.posexplode(parts).alias("parte", "texto")
    )
    made = keep(physical.withColumns(
        {"_de_fora": open_after(F.col("texto"), False, delimiter), "_de_dentro": open_after(F.col("texto"), True, delimiter)}
    ))
    other = made.filter("NOT _linha").select(
        "arquivo", "membro", F.lit(-1).cast("bigint").alias("registro"), F.lit(None).cast("string").alias("texto"), "membros", "problema"
    )
    maps = made.filter("_linha").drop("membros", "problema", "_linha")
    order = ["ordem", "parte"]
    known = _states(maps, piece, order, "_de_fora", "_de_dentro")
    upto = Window.partitionBy(*piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = lambda state: F.sum((~F.col(state)).cast("bigint")).over(upto)
    after = lambda state: F.when(F.col(state), F.col("_de_dentro")).otherwise(F.col("_de_fora"))
    known = known.withColumns({"_n_fechado": begun("fechado"), "_n_aberto": begun("aberto"), "_fim_fechado": after("fechado"), "_fim_aberto": after("aberto")})

    # one row per piece: its map and its records for both states; a file has few pieces
    last = F.max_by(F.struct("_fim_fechado", "_fim_aberto", "_n_fechado", "_n_aberto"), F.struct(*order))
    pieces = known.groupBy(*piece).agg(last.alias("u")).select(*piece, F.col("u._fim_fechado").alias("a"), F.col("u._fim_aberto").alias("b"), "u._n_fechado", "u._n_aberto")
    pieces = _states(pieces, file, ["pedaco"], "a", "b")
    ahead = Window.partitionBy(*file).orderBy("pedaco").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("fechado"), F.col("_n_aberto")).otherwise(F.col("_n_fechado"))
    pieces = pieces.select(*piece, F.col("fechado").alias("_inicio"), F.coalesce(F.sum(held).over(ahead), F.lit(0)).alias("_antes"))

    pick = lambda opened, closed: F.when(F.col("_inicio"), F.col(opened)).otherwise(F.col(closed))
    numbered = keep(known.join(pieces, piece).select(
        "arquivo", "membro", "pedaco", *order, "texto",
        F.when(F.col("parte") == F.col("_partes") - 1, F.lit("\n")).otherwise(F.lit("")).alias("_fim"),
        pick("aberto", "fechado").alias("_dentro"), pick("_fim_aberto", "_fim_fechado").alias("_depois"),
        (F.col("_antes") + pick("_n_aberto", "_n_fechado") - 1).alias("registro"),
    ))
    bare = F.when(F.col("texto").endswith("\r"), F.substring("texto", F.lit(1), F.length("texto") - 1)).otherwise(F.col("texto"))
    whole = numbered.filter("NOT _dentro AND NOT _depois").select(
        "arquivo", "membro", "registro", bare.alias("texto"), F.lit(None).cast("string").alias("problema")
    )
    # only records of several lines are put together by a shuffle; of one that is too long, the start alone
    record = ["arquivo", "membro", "registro"]
    place = F.struct("pedaco", *order)
    running = Window.partitionBy(*record).orderBy("pedaco", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = numbered.filter("_dentro OR _depois").withColumn("_ate", F.sum(F.length("texto") + 1).over(running))
    kept = F.collect_list(F.when(F.col("_ate") <= RECORD_CHARS, F.struct(place.alias("lugar"), F.concat("texto", "_fim").alias("t"))))
    cut = cut.groupBy(*record).agg(kept.alias("linhas"), F.max("_ate").alias("_ate"), F.max_by("_depois", place).alias("_aberto"))
    joined = F.concat_ws("", F.transform(F.array_sort("linhas"), lambda x: x["t"]))
    cut = keep(cut.select(
        *record, F.regexp_replace(joined, r"(\r\n|\r|\n)\z", "").alias("texto"),
        F.when(F.col("_aberto"), F.lit("aspas não fechadas")).when(F.col("_ate") > RECORD_CHARS, F.lit("registro longo demais")).alias("problema"),
    ))
    texts = whole.union(cut).select(*record, "texto", F.lit(None).cast("int").alias("membros"), "problema")
    return texts.union(other)


def cells(text: Column, delimiter: str = DELIMITER) -> Column:
    """Fields of a record as an array, quotes taken off; NULL if a quoted field does not end at a delimiter."""
    d = f"\\{delimiter}" if delimiter in "|\\" else delimiter
    found = F.regexp_extract_all(
        F.concat(F.lit(delimiter), text), F.lit(f'{d}("[^"]*+(?:""[^"]*+)*+"|[^{d}"][^{d}]*+|)'), 1
    )
    used = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x) + 1)
    bare = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.when(text == "", F.array().cast("array<string>")).when(used == F.length(text) + 1, F.transform(found, bare))


def _header_problem(header: Column) -> Column:
    wanted = F.array(*map(F.lit, SOURCE_COLUMNS))
    good = (F.size(header) == len(SOURCE_COLUMNS)) & (F.size(F.array_intersect(header, wanted)) == len(SOURCE_COLUMNS))
    return F.when(header.isNull(), F.lit("Cabeçalho ilegível")).when(
        ~good,
        F.concat(
            F.lit("Cabeçalho incompatível: "), F.size(header).cast("string"), F.lit(f" colunas em vez de {len(SOURCE_COLUMNS)}; faltam ["),
            F.concat_ws(", ", F.array_except(wanted, header)), F.lit("], sobram ["), F.concat_ws(", ", F.array_except(header, wanted)), F.lit("]"),
        ),
    )


def headers(texts: DataFrame) -> DataFrame:
    """arquivo, membro, cabecalho, problema: the header of each file; one row per file."""
    found = texts.filter("registro = 0").select("arquivo", "membro", cells(F.col("texto")).alias("cabecalho"), F.col("problema").alias("_p"))
    return found.select("arquivo", "membro", "cabecalho", F.coalesce("_p", _header_problem(F.col("cabecalho"))).alias("problema"))


def header_orders(header_df: DataFrame) -> DataFrame:
    """Archives per distinct header order; one row means all files agree."""
    return header_df.groupBy("cabecalho").agg(
        F.count(F.lit(1)).alias("arquivos"), F.min("arquivo").alias("exemplo")
    )


def file_problems(texts: DataFrame) -> DataFrame:
    """arquivo, membro, problema of files that cannot be read at all: archive, header, no record."""
    head = headers(texts)
    counted = texts.filter("registro >= 0").groupBy("arquivo", "membro").agg(F.max("registro").alias("n")).filter("n = 0")
    return (
        texts.filter("registro < 0 AND problema IS NOT NULL").select("arquivo", "membro", "problema")
        .union(head.filter("problema IS NOT NULL").select("arquivo", "membro", "problema"))
        .union(counted.select("arquivo", "membro", F.lit("CSV sem registros")))
    )


def records(texts: DataFrame) -> DataFrame:
    """arquivo, membro, the 47 columns in contract order, line number and problema.

    Problems of a whole file come as a row with line number 0, its cells blank.
    """
    head = headers(texts).filter("problema IS NULL")
    at = F.array(*[F.array_position("cabecalho", c).cast("int") - 1 for c in SOURCE_COLUMNS])
    placed = head.select(F.col("arquivo").alias("_a"), at.alias("_posicoes"))
    body = texts.filter("registro > 0").withColumn("_c", cells(F.col("texto")))
    width = F.when(F.col("_c").isNull(), F.lit("campo entre aspas malformado")).when(
        F.size("_c") != len(SOURCE_COLUMNS), F.concat(F.lit(f"esperadas {len(SOURCE_COLUMNS)} colunas, há "), F.size("_c").cast("string"))
    )
    body = body.join(placed, F.col("arquivo") == F.col("_a")).withColumn("_p", F.coalesce("problema", width))
    blank = F.array(*[F.lit("") for _ in SOURCE_COLUMNS])
    body = body.withColumn("_v", F.when(F.col("_p").isNull(), F.transform("_posicoes", lambda p: F.get("_c", p))).otherwise(blank))
    of = body.select(
        "arquivo", "membro", *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(SOURCE_COLUMNS)],
        F.col("registro").alias(LINE_ID), F.col("_p").alias("problema"),
    )
    whole = file_problems(texts).select(
        "arquivo", "membro", *[F.lit("").alias(c) for c in SOURCE_COLUMNS], F.lit(0).cast("bigint").alias(LINE_ID), "problema"
    )
    return of.union(whole)


# --- second route: positions and cents ----------------------------------------------

def with_cents(df: DataFrame, column: str) -> DataFrame:
    """Adds `centavos`, the amount of a money text in hundredths, and `valido`; blank is valid and NULL.

    Shares nothing with the loader's typing: the whole part is read as groups of digits between points,
    one group of any length, or a first of one to three digits and others of three.
    """
    digits = lambda x: x.rlike(r"\A[0-9]+\z")
    df = df.withColumn("_bruto", F.trim(column))
    signed = F.substring("_bruto", 1, 1).isin("+", "-")
    df = df.withColumn("_lados", F.split(F.when(signed, F.substring("_bruto", 2, 1 << 20)).otherwise(F.col("_bruto")), ","))
    df = df.withColumns(
        {"_grupos": F.split(F.get("_lados", F.lit(0)), r"\."), "_fracao": F.coalesce(F.get("_lados", F.lit(1)), F.lit("00"))}
    )
    df = df.withColumns({"_inteiro": F.concat_ws("", "_grupos"), "_primeiro": F.get("_grupos", F.lit(0))})
    later = F.forall(F.slice("_grupos", 2, 1 << 20), lambda g: F.length(g) == 3)
    grouped = (F.size("_grupos") == 1) | ((F.length("_primeiro") <= 3) & later)
    fits = F.length(F.ltrim(F.col("_inteiro"), F.lit("0"))) <= 18
    fraction = (F.size("_lados") <= 2) & digits(F.col("_fracao")) & (F.length("_fracao") <= 2)
    df = df.withColumn("_bom", digits(F.col("_inteiro")) & (F.length("_primeiro") > 0) & grouped & fraction & fits)
    amount = F.when(F.col("_bom"), F.concat("_inteiro", F.rpad("_fracao", 2, "0")).try_cast("decimal(20,0)"))
    df = df.withColumns({"centavos": F.when(F.col("_bruto").startswith("-"), -amount).otherwise(amount), "valido": F.col("_bom") | (F.col("_bruto") == "")})
    return df.drop("_bruto", "_lados", "_grupos", "_fracao", "_inteiro", "_primeiro", "_bom")


def audit(texts: DataFrame, monthly: bool = True) -> DataFrame:
    """Source audit per archive and money column: registros, soma, negativos, vazios, problema.

    A second route to the numbers, from the text of the records: cells by position through Spark's CSV
    parser, amounts by `with_cents`. A `monthly` archive has to hold the month that its name says, and a
    ZIP nothing but the file named after it. What is refused comes as rows with a `problema`.
    """
    names = [f"c{i}" for i in range(len(SOURCE_COLUMNS))]
    schema = ", ".join(f"{n} STRING" for n in [*names, "_ruim"])
    options = {"sep": DELIMITER, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ruim"}
    head = headers(texts).filter("problema IS NULL")
    wanted = F.array(*map(F.lit, [MONTH_TEXT, *MONEY_COLUMNS]))
    placed = head.select(F.col("arquivo").alias("_a"), F.transform(wanted, lambda c: F.array_position("cabecalho", c).cast("int") - 1).alias("_posicoes"))
    # a row of seven numbers for each file: sent to the records, which stay where they are
    parsed = texts.filter("registro > 0 AND problema IS NULL").join(F.broadcast(placed), F.col("arquivo") == F.col("_a"))
    parsed = parsed.withColumn("_r", F.from_csv("texto", schema, options))
    row = F.array(*[F.col(f"_r.{n}") for n in names])
    month = F.concat(F.substring("arquivo", 1, 4), F.lit("/"), F.substring("arquivo", 5, 2))
    parsed = parsed.withColumn("_celulas", row).withColumn(
        "_celulas", F.transform("_posicoes", lambda p: F.coalesce(F.get("_celulas", p), F.lit("")))
    )
    shape = F.when(F.col("_r._ruim").isNotNull() | (F.col("texto") == ""), F.lit("largura inválida")).when(
        F.lit(monthly) & (F.get("_celulas", F.lit(0)) != month), F.concat(F.lit("período alheio ao nome do arquivo: "), F.get("_celulas", F.lit(0)))
    )
    long = parsed.select("arquivo", "membro", "registro", shape.alias("_forma"), F.posexplode(F.slice("_celulas", 2, len(MONEY_COLUMNS))).alias("_i", "celula"))
    read = with_cents(long, "celula")
    measure = F.get(F.array(*map(F.lit, MONEY_COLUMNS)), F.col("_i"))
    reason = F.coalesce("_forma", F.when(~F.col("valido"), F.concat(F.lit("valor inválido em "), measure, F.lit(": "), "celula")))
    value = F.col("centavos")
    # the least text would make Spark sort all cells: as a key it leaves one row for all that have none
    problem = F.when(reason.isNotNull(), F.concat(F.lit("registro "), F.col("registro").cast("string"), F.lit(": "), reason))
    counts = ["registros", "negativos", "vazios"]
    measured = read.groupBy("arquivo", "membro", "_i", problem.alias("_p")).agg(
        F.count(F.lit(1)).alias("registros"), F.sum(value).alias("_soma"), F.count_if(value < 0).alias("negativos"), F.count_if(value.isNull()).alias("vazios"),
    )
    measured = measured.groupBy("arquivo", "membro", measure.alias("medida")).agg(
        *[F.sum(n).alias(n) for n in counts], F.sum("_soma").cast("decimal(30,0)").alias("_soma"), F.min("_p").alias("problema")
    )
    measured = measured.select("arquivo", "membro", "medida", "registros", (F.col("_soma") / 100).cast("decimal(38,2)").alias("soma"), "negativos", "vazios", "problema")
    only = F.concat(F.substring("arquivo", 1, 6), F.lit("_Despesas.csv"))
    named = texts.filter(F.lit(monthly) & F.col("membros").isNotNull()).filter((F.col("membros") != 1) | ~F.col("membro").eqNullSafe(only)).select(
        "arquivo", "membro", F.lit("esperado um único CSV com o nome do mês").alias("problema")
    )
    cut = texts.filter("registro > 0 AND problema IS NOT NULL").select("arquivo", "membro", "problema")
    refused = reduce(DataFrame.union, [file_problems(texts), named, cut])
    return measured.unionByName(refused, allowMissingColumns=True)
