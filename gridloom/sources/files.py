"""Readers and writers: CSV in several dialects, Parquet, stored grids, reconstructions, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.clean import clean_frame, drop_all_null_columns, ffill_bfill, select_numeric
from gridloom.operators.frames import SERIES, row_windows, to_long
from gridloom.plans.numbering import in_file_order, numbered

VERSION = 1


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, inferSchema=True, **options).csv(path)


def _by_line(df: DataFrame) -> list[str]:
    """Order of a file's rows: by its first time-like column, else as they stand in the file."""
    timed = [c for c in df.columns if any(p in c.lower() for p in ("timestamp", "date", "time"))]
    return timed or ["__line"]


def read_matrix(spark: SparkSession, path: str, grid: str = "grid", order: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A CSV file or folder as one clean grid, with n_rows, n_vars and input_bytes (8 for each cell).

    Rows are ordered by ``order``, by default the time-like columns, ties and files without one as they stand.
    """
    df = in_file_order(_csv(spark, path))
    n = df.count()
    if not n:
        raise ValueError(f"{path} has no rows")
    samples = clean_frame(df, list(dict.fromkeys([*(order or _by_line(df)), "__line"])), grid)
    variables = samples.select("var").distinct().count()
    return samples, {"n_rows": n, "n_vars": variables, "input_bytes": 8 * n * variables}


def read_windows(spark: SparkSession, path: str, window_rows: int, grid: str = "grid", order: list[str] | None = None) -> DataFrame:
    """A CSV file as one grid for each run of ``window_rows`` rows, columns chosen once for the file."""
    if window_rows <= 0:
        raise ValueError("window_rows must be positive")
    df = in_file_order(_csv(spark, path))
    names = [c for c in drop_all_null_columns(df, select_numeric(df)) if c != "__line"]
    by = list(dict.fromkeys([*(order or _by_line(df)), "__line"]))
    indexed = df.withColumn("t", F.col("__line")) if by == ["__line"] else numbered(df, by)
    return ffill_bfill(row_windows(to_long(indexed.withColumn("grid_id", F.lit(grid)), names), window_rows))


def read_headerless(spark: SparkSession, path: str, grid: str = "grid") -> DataFrame:
    """A CSV file without a header: a column is a variable (v0, v1 ...), a row a step."""
    df = in_file_order(spark.read.options(header=False, inferSchema=True).csv(path), "t")
    names = [f"v{i}" for i in range(len(df.columns) - 1)]
    return to_long(df.toDF(*names, "t").withColumn("grid_id", F.lit(grid)), names)


def read_locale_csv(spark: SparkSession, path: str, sep: str = ";", decimal: str = ",", na: str | None = None) -> DataFrame:
    """A wide table from a file with another separator and decimal sign; numbers where all of a column are."""
    options = {"header": True, "sep": sep} | ({"nullValue": na} if na is not None else {})
    df = spark.read.options(**options).csv(path)
    as_number = lambda c: F.expr(f"try_cast(replace(trim(`{c}`), '{decimal}', '.') as double)")
    odd = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.trim(f"`{c}`") != "") & as_number(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[(as_number(c) if not odd[c] else F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_csv_compressed(df: DataFrame, path: str, codec: str = "gzip") -> None:
    df.write.mode("overwrite").options(header=True, compression=codec).csv(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the data files in a folder, by Spark's own listing of it."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select("length").agg(F.sum("length")).first()[0] or 0


def write_grid(grid: DataFrame, var_params: DataFrame, path: str, mode: str, eps: float, chunk_steps: int = 100_000) -> None:
    """Grid and parameters as compressed Parquet: pixels of a run of steps in one array, escapes beside them."""
    rows = grid.withColumn("blk", F.floor(F.col("t") / F.lit(chunk_steps)))
    cells = F.array_sort(F.collect_list(F.struct("t", "pixel", "esc")))
    chunks = rows.groupBy(*SERIES, "blk").agg(cells.alias("c"))
    esc = F.transform(F.filter("c", lambda x: x["esc"].isNotNull()), lambda x: F.struct(x["t"].alias("t"), x["esc"].alias("r")))
    chunks = chunks.select(*SERIES, "blk", F.get(F.col("c.t"), F.lit(0)).alias("t0"), F.col("c.pixel").alias("pixels"), esc.alias("esc"))
    write_parquet(chunks, f"{path}/grid")
    write_parquet(var_params, f"{path}/var_params")
    shape = var_params.groupBy("grid_id").agg(F.count(F.lit(1)).cast("int").alias("n_vars"))
    write_parquet(shape.withColumns({"mode": F.lit(mode), "eps": F.lit(eps), "version": F.lit(VERSION)}), f"{path}/grid_params")


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid, var_params and grid_params; a folder of another version is an error."""
    header = spark.read.parquet(f"{path}/grid_params")
    if "version" not in header.columns or header.filter(F.col("version") != VERSION).limit(1).count():
        raise ValueError(f"{path} isn't a grid of version {VERSION}")
    chunks = spark.read.parquet(f"{path}/grid")
    cells = chunks.select(*SERIES, "t0", F.map_from_arrays("esc.t", "esc.r").alias("e"), F.posexplode("pixels").alias("i", "pixel"))
    t = F.col("t0") + F.col("i")
    return cells.select(*SERIES, t.alias("t"), "pixel", F.try_element_at("e", t).alias("esc")), spark.read.parquet(f"{path}/var_params"), header


def write_reconstruction(rebuilt: DataFrame, variables: list[str], path: str) -> None:
    """A CSV folder with steps as rows and variables as columns, ten digits."""
    wide = rebuilt.groupBy("grid_id", "t").pivot("var", variables).agg(F.first(F.format_string("%.10g", "x_hat")))
    wide.orderBy("grid_id", "t").drop("grid_id", "t").write.mode("overwrite").option("header", True).csv(path)


def write_runs(runs: DataFrame, path: str, form: str = "json") -> None:
    """Runs as JSON or CSV, with values that aren't finite as null."""
    from gridloom.functions.scalar import finite_or_null

    tame = runs.select(*[finite_or_null(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in runs.dtypes])
    writer = tame.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)
