"""Matrices and categorical data in CSV and JSON files.

CSV: a first line `scheme|type,rows,columns,name,count`; then, dense, a line of column
names behind an empty cell and a line per row behind its name; or, sparse, a line
`i,j,value` per entry and two lines of numbered column and row names.  Complex values
are two numbers with a space between.  Lines are written and read by Spark: a file is a
folder of parts in line order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.categorical import CategoricalFrame, Codebook
from tessera.operators.classifier import Entailment
from tessera.operators.frames import with_row_id
from tessera.operators.matrix import COMPLEX, Matrix

#: The words and numbers of the formats.
DENSE, SPARSE, DOUBLE, COMPLEX_TYPE = "Dense", "Sparse", "Double", "Complex"
SCHEMES = {"Dense": 0, "CompressedRow": 1}
#: Names of rows that a matrix holds on the driver.
NAMES = 1_000_000


def _text_of(m: Matrix, v: Column) -> Column:
    return F.concat_ws(" ", v.re.cast("string"), v.im.cast("string")) if m.is_complex else v.cast("string")


def _names_line(names: dict[int, str]) -> str:
    return ",".join(f"{k},{names[k]}" for k in sorted(names))


def write_csv(m: Matrix, path: str, sparse: bool = False) -> None:
    """Write the lines of a matrix; zeros are left out where sparse."""
    spark = m.spark
    kind = COMPLEX_TYPE if m.is_complex else DOUBLE
    scheme = SPARSE if sparse else DENSE
    if sparse:
        held = m.entries.where(m.field.nonzero(F.col("v")))
        count = str(held.count())
        body = held.select((F.col("i") + 1).alias("n"), F.col("j").cast("long").alias("k"), F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"), _text_of(m, F.col("v"))).alias("line"))
        tail = [(m.n_rows + 1, 0, _names_line(m.col_names)), (m.n_rows + 2, 0, _names_line(m.row_names))]
        head: list[tuple[int, int, str]] = []
    else:
        count = ""
        cells = F.array_sort(F.collect_list(F.struct("j", _text_of(m, F.col("v")).alias("t")))).alias("c")
        rows = m.filled().groupBy("i").agg(cells)
        names = spark.createDataFrame([(int(k), n) for k, n in m.row_names.items()], "i long, name string")
        rows = rows.join(F.broadcast(names), "i", "left")
        body = rows.select((F.col("i") + 2).alias("n"), F.lit(0).cast("long").alias("k"), F.concat(F.coalesce("name", F.lit("")), F.lit(","), F.array_join("c.t", ","), F.lit(",")).alias("line"))
        head = [(1, 0, "," + ",".join(m.col_names.get(j, "") for j in range(m.n_cols)))]
        tail = []
    first = [(0, 0, f"{scheme}|{kind},{m.n_rows},{m.n_cols},{m.name or ''},{count}"), *head]
    fixed = spark.createDataFrame(first + tail, "n long, k long, line string")
    body.unionByName(fixed).repartitionByRange("n", "k").sortWithinPartitions("n", "k").select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file or folder in order: n, line.

    Lines of a block of a file come behind each other in its task, so that a count for each
    block is enough to number them where they are: nothing is ordered or shuffled.
    """
    held = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    blocks = held.groupBy("f", "b").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("first"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select("f", "b", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    return held.join(blocks, ["f", "b"]).select((F.col("before") + F.col("k") - F.col("first")).alias("n"), F.col("value").alias("line"))


def read_csv(spark: SparkSession, path: str) -> Matrix:
    """Read a matrix written by write_csv, or a file of the format."""
    lines = read_lines(spark, path).cache()
    head = lines.where("n = 0").first().line.split(",")
    scheme, _, kind = head[0].partition("|")
    is_complex = kind == COMPLEX_TYPE
    if kind not in ("", DOUBLE, COMPLEX_TYPE):
        raise ValueError(f"entries of type {kind} can't be read")
    n_rows, n_cols = int(head[1]), int(head[2])

    def value(token: Column) -> Column:
        if not is_complex:
            return token.cast("double")
        part = F.split(token, " ")
        return F.struct(part[0].cast("double").alias("re"), part[1].cast("double").alias("im")).cast(COMPLEX)

    tokens = F.split("line", ",")
    if scheme == SPARSE:
        count = int(head[4])
        entries = lines.where((F.col("n") > 0) & (F.col("n") <= count)).select(tokens[0].cast("long").alias("i"), tokens[1].cast("int").alias("j"), value(tokens[2]).alias("v"))
        rest = {r.n: r.line for r in lines.where(F.col("n") > count).collect()}
        pairs = lambda line: {int(a): b for a, b in zip(line.split(",")[::2], line.split(",")[1::2], strict=False)} if line else {}
        cols, rows = pairs(rest.get(count + 1, "")), pairs(rest.get(count + 2, ""))
    else:
        body = lines.where("n > 1").withColumn("t", tokens)
        cells = F.slice("t", 2, n_cols)
        entries = body.select((F.col("n") - 2).alias("i"), F.posexplode(cells).alias("j", "x")).select("i", "j", value(F.col("x")).alias("v"))
        named = lines.where("n = 1").first().line.split(",")[1:]
        cols = {j: x for j, x in enumerate(named) if x.strip()}
        named = body.where("trim(t[0]) <> ''").select((F.col("n") - 2).alias("i"), F.col("t")[0].alias("name")).limit(NAMES + 1).collect()
        if len(named) > NAMES:
            raise ValueError(f"more than {NAMES} rows have names")
        rows = {r.i: r.name for r in named}
    return Matrix(entries, n_rows, n_cols, head[3] or None, rows, cols)


def matrix_json(m: Matrix, sparse: bool = False) -> DataFrame:
    """One row, `json`: the matrix with its names. The storage is one array, so bounded by a row's size."""
    value = F.struct(F.col("v.re").alias("Real"), F.col("v.im").alias("Imag")) if m.is_complex else F.col("v")
    shape = [F.lit(m.n_rows).alias("NumberOfRows"), F.lit(m.n_cols).alias("NumberOfColumns")]
    if sparse:
        held = m.entries.where(m.field.nonzero(F.col("v"))).select("i", "j", value.alias("x"))
        listed = held.agg(F.array_sort(F.collect_list(F.struct("i", "j", "x"))).alias("e"))
        # where each row begins: running counts of entries by row, which end up in one row like all else
        counts = held.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
        running = m.spark.range(m.n_rows).join(counts, F.col("id") == F.col("i"), "left").select("id", F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("id")).alias("to"))
        begins = running.agg(F.array_sort(F.collect_list(F.struct("id", "to"))).alias("r"))
        row_index = F.concat(F.array(F.lit(0).cast("long")), F.col("r.to"))
        listed = listed.crossJoin(begins)  # a row each
        body = listed.select(F.struct(F.lit(SCHEMES["CompressedRow"]).alias("StorageScheme"), *shape, F.size("e").alias("Capacity"), F.col("e.x").alias("Values"), F.col("e.j").alias("Columns"), row_index.alias("RowIndex")).alias("Implementor"))
    else:
        held = m.filled().select("j", "i", value.alias("x"))
        body = held.agg(F.array_sort(F.collect_list(F.struct("j", "i", "x"))).alias("e")).select(F.struct(F.lit(SCHEMES["Dense"]).alias("StorageScheme"), *shape, F.col("e.x").alias("Storage")).alias("Implementor"))
    named = lambda names: F.create_map(*[F.lit(x) for k in sorted(names) for x in (str(k), names[k])]) if names else F.lit(None).cast("map<string,string>")
    whole = F.struct("Implementor", F.lit(m.name).alias("Name"), named(m.row_names).alias("RowNames"), named(m.col_names).alias("ColumnNames"))
    return body.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


_NUMBERS = "StorageScheme int, NumberOfRows long, NumberOfColumns int, Capacity int, Columns array<int>, RowIndex array<int>"


def read_matrix_json(df: DataFrame, column: str = "json") -> Matrix:
    """The matrix in a one-row frame's JSON."""
    first = df.first()[column]
    shape = json.loads(first)
    inner = shape["Implementor"]
    stored = inner.get("Storage", inner.get("Values")) or [0.0]
    entry = "struct<Real:double,Imag:double>" if isinstance(stored[0], dict) else "double"
    schema = f"struct<Implementor:struct<{_NUMBERS.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')},Storage:array<{entry}>,Values:array<{entry}>>>"
    parsed = df.select(F.from_json(column, schema).alias("m")).select("m.Implementor.*")
    n = inner["NumberOfRows"]
    if inner["StorageScheme"] == SCHEMES["Dense"]:
        cells = parsed.select(F.posexplode("Storage").alias("p", "x")).select((F.col("p") % n).cast("long").alias("i"), F.floor(F.col("p") / n).cast("int").alias("j"), "x")
    else:
        at = parsed.select(F.posexplode(F.arrays_zip("Columns", "Values")).alias("p", "z"))
        begins = F.zip_with(F.slice("RowIndex", F.lit(1), F.size("RowIndex") - 1), F.slice("RowIndex", F.lit(2), F.size("RowIndex") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        held = parsed.select(F.posexplode(begins).alias("i", "r")).where("r.b > r.a")
        rows = held.select(F.col("i").cast("long").alias("i"), F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("p"))
        cells = at.join(rows, "p").select("i", F.col("z.Columns").alias("j"), F.col("z.Values").alias("x"))
    v = F.struct(F.col("x.Real").alias("re"), F.col("x.Imag").alias("im")) if entry != "double" else F.col("x")
    names = lambda d: {int(k): x for k, x in (d or {}).items()}
    return Matrix(cells.select("i", "j", v.alias("v")), n, inner["NumberOfColumns"], shape.get("Name"), names(shape.get("RowNames")), names(shape.get("ColumnNames")))


def variable_json(data: CategoricalFrame, variable: str, read_only: bool = True) -> str:
    cats = [{"Code": c, "Label": label} for c, label in data.categories(variable)]
    return json.dumps({"Name": variable, "Categories": cats, "IsReadOnly": read_only}, ensure_ascii=False)


def entailment_json(rule: Entailment, data: CategoricalFrame, features: list[str], response: str) -> str:
    """A rule with its variables, premises in the order of the features."""
    held = {
        "FeatureVariables": [json.loads(variable_json(data, v)) for v in features],
        "ResponseVariable": json.loads(variable_json(data, response)),
        "FeaturePremises": [sorted(p) for p in rule.premises],
        "ResponseConclusion": rule.conclusion,
        "TruthValue": rule.truth,
    }
    return json.dumps(held, ensure_ascii=False)


def read_entailment_json(text: str) -> tuple[Entailment, list[Codebook], Codebook]:
    """The rule, its features' codebooks and its response's."""
    held = json.loads(text)
    book = lambda v: Codebook(v["Name"], [(c["Code"], c["Label"]) for c in v["Categories"]])
    rule = Entailment(tuple(frozenset(p) for p in held["FeaturePremises"]), held["ResponseConclusion"], held["TruthValue"])
    return rule, [book(v) for v in held["FeatureVariables"]], book(held["ResponseVariable"])


def categorical_json(data: CategoricalFrame, name: str | None = None) -> DataFrame:
    """One row, `json`: variables and the matrix of codes."""
    n = data.rows.count()
    codes = Matrix.from_wide(with_row_id(data.rows, ["row_id"], "_k"), "_k", list(data.variables), n)
    variables = json.dumps([json.loads(variable_json(data, v)) for v in data.variables], ensure_ascii=False)
    tail = f', "Name": {json.dumps(name)}}}'
    return matrix_json(codes).select(F.concat(F.lit(f'{{"Variables": {variables}, "Data": '), "json", F.lit(tail)).alias("json"))


def read_categorical_json(df: DataFrame, column: str = "json") -> CategoricalFrame:
    """The data set in a one-row frame's JSON: its codes, row_id from 0 on, and its codebook."""
    spark = df.sparkSession
    held = json.loads(df.select(F.get_json_object(column, "$.Variables").alias("v")).first().v)
    names = tuple(v["Name"] for v in held)
    book = [(v["Name"], float(c["Code"]), c["Label"]) for v in held for c in v["Categories"]]
    codes = read_matrix_json(df.select(F.get_json_object(column, "$.Data").alias("json")))
    wide = codes.filled().groupBy(F.col("i").alias("row_id")).agg(*[F.max(F.when(F.col("j") == k, F.col("v"))).alias(name) for k, name in enumerate(names)])
    return CategoricalFrame(wide, spark.createDataFrame(book, "variable string, code double, label string"), names)


def write_categorical(data: CategoricalFrame, path: str) -> None:
    """Codes as Parquet and the codebook as JSON lines."""
    data.rows.write.parquet(f"{path}/rows")
    data.codebook.select("variable", "code", "label").coalesce(1).write.json(f"{path}/codebook")


def read_categorical(spark: SparkSession, path: str) -> CategoricalFrame:
    rows = spark.read.parquet(f"{path}/rows")
    book = spark.read.schema("variable string, code double, label string").json(f"{path}/codebook")
    return CategoricalFrame(rows, book, tuple(c for c in rows.columns if c != "row_id"))


def read_delimited(spark: SparkSession, path: str, columns: list[int], delimiter: str = ",", header: bool = True) -> DataFrame:
    """Chosen columns of a delimited text file, in line order, as strings with row_id."""
    lines = read_lines(spark, path)
    parts = F.split("line", f"\\Q{delimiter}\\E")
    names = [f"{k}" for k in columns]
    if header:
        first = lines.where("n = 0").first().line.split(delimiter)
        names = [first[k] for k in columns]
        lines = lines.where("n > 0").withColumn("n", F.col("n") - 1)
    return lines.select(F.col("n").alias("row_id"), *[parts[k].alias(name) for k, name in zip(columns, names, strict=True)])
