"""Sources: typed CSV with or without a header, whitespace text, JSON sidecars, tool logs, unions of files, incremental indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def control_csv(spark: SparkSession, path: str) -> DataFrame:
    """Control points from the first three columns; lines from # on are comments, and a header line, where a file has one, is known by its first
    name. A row whose first three aren't numbers is an error that shows it."""
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & ~F.col("value").rlike(r"(?i)^\s*\"?easting\b"))
    parts = text.select("value", F.split("value", ",").alias("p"))
    number = lambda k: F.coalesce(F.get("p", k).try_cast("double"), F.raise_error(F.concat(F.lit("no control point: "), "value")).cast("double"))
    return parts.select(*[number(k).alias(c) for k, c in enumerate(("easting", "northing", "h_mean"))])


def whitespace_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numbers separated by blanks; lines that start with # or hold other text go."""
    parts = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(*[F.get("p", k).try_cast("double").alias(c) for k, c in enumerate(columns)]).dropna(subset=columns[:2])


def json_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a corrupt one has null columns and its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j")).select("file", "j.*")


def log_vector(spark: SparkSession, path: str) -> DataFrame:
    """North, east and down parts that an alignment tool's log reports."""
    number = r"\s*([-+0-9.eE]+)\s*"
    text = spark.read.text(path, wholetext=True)
    part = lambda k: F.regexp_extract("value", rf"North-East-Down, meters\):\s*Vector3\({number},{number},{number}\)", k).try_cast("double")
    return text.select(F.input_file_name().alias("file"), part(1).alias("dn"), part(2).alias("de"), part(3).alias("dd"))


def points_union(frames: list[DataFrame]) -> DataFrame:
    """All points; a field that a source lacks is null. x, y and h must be finite."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for c in ("x", "y", "h"):
        out = out.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) < 1e30), F.col(c)))
    return out.dropna(subset=["x", "y", "h"])


def only_new(found: DataFrame, index: DataFrame, key: str = "name") -> DataFrame:
    """Entries that the index hasn't: what an incremental scan must read."""
    return found.join(index.select(key), key, "left_anti")


#: The summary lines that an elevation difference's file begins with.
DIFFERENCE_STATS = {"max": "Max difference", "min": "Min difference", "mean": "Mean difference", "std": "StdDev of difference", "median": "Median difference"}


def differences(spark: SparkSession, path: str) -> DataFrame:
    """(file, lon, lat, dh) of the rows of elevation differences; comment lines and rows that aren't three numbers go."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.input_file_name().alias("file"), F.split("value", ",").alias("p"))
    return lines.select("file", *[F.get("p", k).try_cast("double").alias(c) for k, c in enumerate(("lon", "lat", "dh"))]).dropna()


def difference_summary(spark: SparkSession, path: str) -> DataFrame:
    """(file, max, min, mean, std, median, n, mad, rmse): what each file's comments say, and from its rows their number, median deviation about
    the stated median (the rows' own, where none is stated) and root mean square. One pass over lines and two aggregates by file."""
    number = r":\s+([-\d.eE+]+)"
    text = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    said = text.where(F.col("value").startswith("#")).groupBy("file").agg(*[F.max(F.regexp_extract("value", f"# {label}{number}", 1).try_cast("double")).alias(c) for c, label in DIFFERENCE_STATS.items()])
    rows = differences(spark, path)
    own = rows.groupBy("file").agg(F.count("*").alias("n"), F.median("dh").alias("_m"), F.sqrt(F.avg(F.col("dh") * F.col("dh"))).alias("rmse"))
    both = said.join(own, "file", "full").withColumn("median", F.coalesce("median", "_m"))
    mad = rows.join(both.select("file", F.col("median").alias("_c")), "file").groupBy("file").agg(F.median(F.abs(F.col("dh") - F.col("_c"))).alias("mad"))
    return both.join(mad, "file", "left").select("file", *DIFFERENCE_STATS, F.coalesce("n", F.lit(0)).alias("n"), "mad", "rmse")


def latest_logs(files: DataFrame, pattern: str = r"^(.*)-log-[^/]*\.txt$") -> DataFrame:
    """(run, file): of the log files (column file) of each run, which the pattern's first group names, the last by name."""
    named = files.where(F.col("file").rlike(pattern)).select("file", F.regexp_extract("file", pattern, 1).alias("run"))
    return named.groupBy("run").agg(F.max("file").alias("file"))


def log_magnitude(spark: SparkSession, path: str) -> DataFrame:
    """(file, metres) of the length of the translation that an alignment tool's log reports; null where it doesn't."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("file"), F.regexp_extract("value", r"Translation vector magnitude \(meters\):\s*([-+0-9.eE]+)", 1).try_cast("double").alias("metres"))


def header_segment(text, fields: dict[str, str]):
    """A struct of degrees from a header's text in millionths of a degree (fields: name to tag), null if one is missing."""
    parts = [F.regexp_extract(text, rf"<{tag}[^>]*>\s*([-+]?\d+)|\b{tag}=([-+]?\d+)", 0) for tag in fields.values()]
    degrees = [F.regexp_extract(p, r"([-+]?\d+)$", 1).try_cast("long") * 1e-6 for p in parts]
    whole = F.array_position(F.transform(F.array(*degrees), lambda x: x.isNull()), True) == 0
    return F.when(whole, F.struct(*[d.alias(name) for d, name in zip(degrees, fields, strict=True)]))


def axes(x_min: float, x_max: float, y_min: float, y_max: float, step: float) -> tuple[int, int, float, float]:
    """Rows, columns and the first cell's place of a north-up grid that covers the extent: x from x_min on and below x_max, y from y_max down and
    above y_min."""
    import math

    count = lambda span: max(0, math.ceil(span / step - 1e-12))
    return count(y_max - y_min), count(x_max - x_min), x_min, y_max


def lonlat_grid(points: DataFrame, v: str) -> DataFrame:
    """(iy, ix, lat, lon, v) of a whole grid that is given as points (lon, lat, v): cells are numbered by the ranks of their coordinates. An error
    if a cell is missing or given twice. The coordinates (a value for each row and column) reach one task."""
    from pyspark.sql.window import Window

    rank = lambda c, name: points.select(c).distinct().select(c, (F.row_number().over(Window.orderBy(c)) - 1).alias(name))
    lat, lon = rank("lat", "iy"), rank("lon", "ix")
    out = points.join(F.broadcast(lat), "lat").join(F.broadcast(lon), "lon")
    cells, ny, nx = out.agg(F.count("*"), F.max("iy") + 1, F.max("ix") + 1).first()
    if cells != (ny or 0) * (nx or 0) or out.select("iy", "ix").distinct().count() != cells:
        raise ValueError("the points aren't a whole grid")
    return out.select("iy", "ix", "lat", "lon", v)
