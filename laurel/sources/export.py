"""The bulk export: tab-separated text tables with a contract.

The contract is checked on a table of what the folder holds (one row for each member), all rules at
once; what breaks a rule is a row, and all of them are named in one error.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import fixed

_NAME = "^[a-z][a-z0-9_]*$"
_MEMBER = "path string, first_line string"
_METADATA = "struct<export_format_version:string,export_date:string>"


@dataclass(frozen=True)
class Export:
    format_version: str
    generated_at: datetime
    tables: dict[str, str]
    columns: dict[str, tuple[str, ...]]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, table and columns of the text members; path and metadata (format and date) of the JSON ones.

    An export has a handful of members; only their first lines (all of a JSON member) are read here.
    """
    # Spark writes a table as a folder of parts, so members are what lies directly in the folder.
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    paths = sorted(status.getPath().toString() for status in found)
    rows = []
    for path in paths:
        if path.endswith((".tsv", "metadata.json")):
            lines = spark.read.option("wholetext", path.endswith(".json")).text(path).first()
            rows.append((path, lines.value if lines else ""))
    members = spark.createDataFrame(rows, _MEMBER)
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    prefix = "^(" + "|".join(fixed.EXPORT_PREFIXES) + ")"
    fields = F.split(F.regexp_replace("first_line", "^\ufeff|[\r\n]+$", ""), "\t", -1)
    is_table = F.col("path").endswith(".tsv")
    return members.select(
        "path",
        F.when(is_table, F.regexp_replace(stem, prefix, "")).alias("table"),
        F.when(is_table, F.transform(fields, lambda f: F.btrim(f, F.lit('"')))).alias("columns"),
        F.when(~is_table, F.from_json("first_line", _METADATA)).alias("metadata"),
    )


def violations(members: DataFrame) -> DataFrame:
    """rule and subject of everything in a ``listing`` that the contract does not allow."""
    spark = members.sparkSession
    tables = members.where("table IS NOT NULL")
    columns = tables.select("table", F.explode("columns").alias("column"))
    wanted = spark.createDataFrame(
        [(t, c) for t, names in fixed.REQUIRED_EXPORT_COLUMNS.items() for c in names], "table string, column string"
    )

    def rule(name: str, rows: DataFrame, subject: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))

    format_version = F.coalesce(F.col("metadata.export_format_version"), F.lit("none"))
    documents = members.where("table IS NULL")
    broken = [
        rule("number of metadata members", documents.agg(F.count(F.lit(1)).alias("n")).where("n <> 1"), F.col("n")),
        rule("format", documents.where(~format_version.rlike(r"^v2(\.[0-9]+)*$")), format_version),
        rule("table name", tables.where(~F.col("table").rlike(_NAME)), F.col("path")),
        rule("table given twice", tables.groupBy("table").count().where("count > 1"), F.col("table")),
        rule("column name", columns.where(~F.col("column").rlike(_NAME)), F.concat_ws(".", "table", "column")),
        rule("column given twice", columns.groupBy("table", "column").count().where("count > 1"), F.concat_ws(".", "table", "column")),
        rule("table is not there", wanted.select("table").distinct().join(tables, "table", "left_anti"), F.col("table")),
        rule(
            "column is not there",
            wanted.join(tables.select("table"), "table", "left_semi").join(columns, ["table", "column"], "left_anti"),
            F.concat_ws(".", "table", "column"),
        ),
    ]
    out = broken[0]
    for rows in broken[1:]:
        out = out.unionByName(rows)
    return out


def inspect(spark: SparkSession, folder: str, as_of: datetime) -> Export:
    """Check the contract of an unpacked export; ``as_of`` stands in for a date that cannot be read."""
    members = listing(spark, folder)
    found = violations(members).orderBy("rule", "subject").collect()
    if found:
        raise ValueError("The export breaks its contract: " + "; ".join(f"{r.rule}: {r.subject}" for r in found))
    rows = members.collect()
    raw = F.regexp_replace("metadata.export_date", " UTC$", "Z")
    dated = members.where("table IS NULL").select(
        F.col("metadata.export_format_version").alias("version"),
        F.unix_micros(F.coalesce(F.try_to_timestamp(raw), F.lit(as_of).cast("timestamp"))).alias("at"),
    ).first()
    tables = {r.table: r for r in rows if r.table is not None}
    return Export(
        dated.version,
        datetime.fromtimestamp(dated.at / 1e6, UTC),
        {name: r.path for name, r in tables.items()},
        {name: tuple(r.columns) for name, r in tables.items()},
    )


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A text table: no quoting, ``NULL`` is null, an empty field stays empty.

    The first line of each file is its header; later lines are data even where they look like it. Lines
    are taken whole and split here, as a CSV reader would turn empty fields into nulls; the scan stays
    splittable. A line with another number of fields, or with the reserved byte, fails the job.
    """
    lines = spark.read.schema("value string").csv(
        path, header=True, sep="\x01", quote="", escape="", mode="FAILFAST", nullValue="\x01", emptyValue=""
    )
    if columns is None:
        first = spark.read.text(path).first()
        columns = tuple(first.value.lstrip("\ufeff").split("\t"))
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts) == len(columns), parts).otherwise(
        F.raise_error(F.concat(F.lit(f"Malformed line in {path}: "), F.coalesce("value", F.lit(""))))
    )
    return lines.select(checked.alias("_p")).select(
        *[F.nullif(F.col("_p")[i], F.lit("NULL")).alias(c) for i, c in enumerate(columns)]
    )


def read_export(spark: SparkSession, export: Export) -> dict[str, DataFrame]:
    return {n: read_tsv(spark, p, export.columns[n]) for n, p in export.tables.items()}


def write_tsv(df: DataFrame, path: str) -> None:
    """Write a text table as the reader expects it (a header line in every part)."""
    header = "\t".join(df.columns)
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns])
    df.select(line.alias(header)).write.option("header", "true").option("quote", "").option(
        "escapeQuotes", "false"
    ).csv(path, sep="\x02", emptyValue="")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(tables.items())
    ]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def content_mark(df: DataFrame) -> Column:
    """A mark of a table's rows that does not depend on their order: for use in ``agg``."""
    row = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\x01")) for c in df.columns])
    return F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0))


def load_report(tables: dict[str, DataFrame], export: Export, source: str) -> DataFrame:
    """One metadata row with version, content hash and counts; an empty required table fails the job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count"), content_mark(df).alias("mark")).select(F.lit(name).alias("table_name"), "row_count", "mark")
        for name, df in sorted(tables.items())
    ]
    counts = counted[0]
    for df in counted[1:]:
        counts = counts.unionByName(df)
    empty = F.col("table_name").isin(*fixed.REQUIRED_EXPORT_COLUMNS) & (F.col("row_count") == 0)
    checked = counts.withColumn(
        "row_count",
        F.when(~empty, F.col("row_count")).otherwise(
            F.raise_error(F.concat(F.lit("A table that must have rows is empty: "), "table_name")).cast("long")
        ),
    )
    entries = F.array_sort(F.collect_list(F.struct("table_name", "row_count", "mark")))
    content = F.sha2(F.to_json(entries), 256)
    return checked.agg(
        F.lit(export.format_version).alias("format_version"),
        F.lit(export.generated_at).alias("generated_at"),
        F.lit(source).alias("source"),
        content.alias("content_hash"),
        F.concat_ws(":", F.lit(export.format_version), content).alias("version"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "row_count")))).alias("row_counts"),
    )


def country_dimension(countries: DataFrame, continents: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Country code, names and continent from the export's own tables.

    ``overrides`` (country_code, display_name, records_name) supplies names that differ on display
    or in the records list.
    """
    k = continents.select(F.col("id").alias("continent_id"), F.col("name").alias("continent"))
    rows = countries.join(k, "continent_id", "left").select(
        F.upper("iso2").alias("country_code"),
        F.coalesce(F.nullif("name", F.lit("")), "id").alias("country"),
        F.coalesce("continent", F.ltrim("continent_id", F.lit("_")), F.lit("")).alias("continent"),
    )
    if overrides is None:
        return rows.withColumns({"country_display_name": F.col("country"), "records_name": F.col("country")})
    return rows.join(overrides, "country_code", "left").select(
        "country_code",
        "country",
        "continent",
        F.coalesce("display_name", "country").alias("country_display_name"),
        F.coalesce("records_name", "display_name", "country").alias("records_name"),
    )


def require_country_codes(rows: DataFrame, countries: DataFrame, name: str) -> DataFrame:
    """``country_codes``, but an unknown name fails the job."""
    found = country_codes(rows, countries, name)
    unknown = F.raise_error(F.concat(F.lit("Unknown country name: "), F.coalesce(F.col(name), F.lit(""))))
    return found.withColumn("country_code", F.when(F.col("country_code") != "", F.col("country_code")).otherwise(unknown.cast("string")))


def with_continent(rows: DataFrame, countries: DataFrame, code: str = "country_code") -> DataFrame:
    """Add ``continent`` of a country code; blank where the dimension does not have it."""
    known = countries.select(F.col("country_code").alias("_code"), F.col("continent").alias("_continent")).dropDuplicates(["_code"])
    joined = rows.join(known, F.upper(F.col(code)) == F.col("_code"), "left")
    return joined.withColumn("continent", F.coalesce("_continent", F.lit(""))).drop("_code", "_continent")


def country_codes(rows: DataFrame, countries: DataFrame, name: str) -> DataFrame:
    """Add ``country_code`` from a country name: known aliases first, then the dimension."""
    from laurel.functions.text import collapsed, looked_up
    from laurel.operators.grouping import attach_lookup

    names = countries.select(
        F.explode(F.array_distinct(F.array(F.lower("country"), F.lower("country_display_name"), F.lower("country_code")))).alias("_n"),
        "country_code",
    ).groupBy("_n").agg(F.min("country_code").alias("_code"))
    keyed = rows.withColumn("_n", F.lower(collapsed(name)))
    found = attach_lookup(keyed, names, ["_n"])
    alias = looked_up(fixed.COUNTRY_NAME_ALIASES, collapsed(name))
    return found.withColumn("country_code", F.coalesce(alias, "_code", F.lit(""))).drop("_n", "_code")
