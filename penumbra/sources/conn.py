"""Connection tables as white-space text with a '# ' header, and elevation tables.

A folder of files may hold several tables; each file's first comment line that
names columns is its header. Missing values are written as ``nan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.store import fresh_path

#: Columns of a connection table with their types and formats.
COLUMNS = {
    "timestamp": ("date", "%s"), "caster_X": ("double", "%+8.2f"), "caster_Y": ("double", "%+8.2f"), "caster_Z": ("double", "%+8.2f"), "caster_id": ("int", "%d"),
    "casted_X": ("double", "%+8.2f"), "casted_Y": ("double", "%+8.2f"), "casted_X_refine": ("double", "%+8.2f"), "casted_Y_refine": ("double", "%+8.2f"),
    "azimuth": ("double", "%+3.4f"), "zenith": ("double", "%+3.4f"), "zenith_refrac": ("double", "%+3.4f"), "orbit_id": ("int", "%d"),
    "view_az": ("double", "%+3.4f"), "view_zn": ("double", "%+3.4f"), "glacier_id": ("int", "%d"),
}


def _text(name: str, kind: str) -> Column:
    template = COLUMNS[name][1]
    value = F.date_format(name, "yyyy-MM-dd") if kind == "date" else F.col(name)
    return F.coalesce(F.format_string(template, value.cast("bigint") if template == "%d" else value), F.lit("nan")) if kind != "date" else F.coalesce(value, F.lit("nan"))


def _lines(df: DataFrame) -> tuple[DataFrame, str]:
    kept = [c for c in COLUMNS if c in df.columns]
    texts = [F.when(F.col(c).isNull(), F.lit("nan")).otherwise(_text(c, COLUMNS[c][0])) for c in kept]
    return df.select(F.concat_ws(" ", *texts).alias("value")), " ".join(kept)


def write(df: DataFrame, path: str | None = None) -> str:
    """Write the known columns of ``df``; every part file begins with the header. Gives the folder."""
    path = path or fresh_path(df.sparkSession, "conn")
    lines, header = _lines(df)
    parts = lines.withColumn("_part", F.spark_partition_id())
    heads = parts.select("_part").distinct().select("_part", F.lit(f"# {header}").alias("value"))
    ordered = parts.unionByName(heads).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part").sortWithinPartitions("_part", F.desc(F.col("value").startswith("#")))
    ordered.select("value").write.text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """A connection table of all files of a folder.

    Each file is read by its own header and, if that names no ``timestamp``, takes
    the time of its ``# time:`` line. A file without a header has the columns of
    ``COLUMNS``; columns that a file lacks are null.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    comment = F.col("value").startswith("#")
    headers = lines.filter(comment & ~F.col("value").contains(":")).groupBy("file").agg(F.split(F.trim(F.regexp_replace(F.min("value"), "^#+", "")), r"\s+").alias("names"))
    times = lines.filter(F.col("value").startswith("# time:")).groupBy("file").agg(F.min("value").alias("time"))
    kinds = sorted(tuple(r[0]) for r in headers.select("names").distinct().collect())  # the headers that differ
    names = list(dict.fromkeys(n for kind in kinds or [tuple(COLUMNS)] for n in kind))
    plain = F.array(*(F.lit(n) for n in COLUMNS))
    rows = lines.filter(~comment & (F.col("value") != "")).select("file", F.split("value", r"\s+").alias("v"))
    rows = rows.join(headers, "file", "left").join(times, "file", "left").withColumn("names", F.coalesce("names", plain))

    def field(name: str):
        at = F.array_position("names", name).cast("int")
        text = F.when(at > 0, F.get("v", at - 1))
        return F.when(F.lower(text) != "nan", text).cast(COLUMNS.get(name, ("double", ""))[0])

    stamp = F.to_date(F.substring(F.trim(F.element_at(F.split("time", ":", 2), 2)), 1, 10))
    timed = F.coalesce(field("timestamp"), F.when(~F.array_contains("names", "timestamp"), stamp)) if "timestamp" in names else stamp
    columns = [(timed if n == "timestamp" else field(n)).alias(n) for n in names]
    if "timestamp" not in names and not times.isEmpty():
        columns.append(timed.alias("timestamp"))
    return rows.select(*columns)


def write_elevation_table(df: DataFrame, path: str, region: int, number: int) -> str:
    """A table of rates (elevation by year) as text; one small file named by region and glacier."""
    years = [c for c in df.columns if c != "elevation"]
    signed = [F.coalesce(F.format_string("%+.2f", F.col(f"`{y}`")), F.lit("nan")) for y in years]
    folder = f"{path.rstrip('/')}/belev_{region:02d}.{number:05d}.dat"
    body = df.orderBy("elevation").select(F.concat_ws(" ", F.format_string("%+.2f", F.col("elevation").cast("double")), *signed).alias("value"))
    body.coalesce(1).write.text(folder)  # a row a bin
    return folder
