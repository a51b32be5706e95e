"""JSON-safe values, Markdown files with a provenance header, batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_timestamp(c: Column) -> Column:
    """ISO text; the fraction appears only when it is not zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, ".SSSSSS")
    return F.concat(whole, F.when(frac == ".000000", F.lit("")).otherwise(frac))


def blob_struct(c: Column) -> Column:
    return F.when(
        c.isNotNull(),
        F.struct(
            F.lit("blob").alias("type"),
            F.octet_length(c).cast("long").alias("length"),
            F.base64(c).alias("base64"),
        ),
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Every column in a form JSON can hold: dates as text, decimals as doubles."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_timestamp(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = blob_struct(c)
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def to_json_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """Key columns and the whole row as one JSON text."""
    safe = json_safe(df)
    return safe.select(*keep, F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_with_header(
    url: Column, crawled: Column, title: Column, body: Column,
    published: Column | None = None, author: Column | None = None, description: Column | None = None,
) -> Column:
    """Comment block, title, quoted description, body; absent fields leave no line."""

    def line(prefix, c, suffix=""):
        if c is None:
            return F.lit(None).cast("string")
        return F.when(c != "", F.concat(F.lit(prefix), c, F.lit(suffix)))

    return F.concat_ws(
        "\n",
        F.lit("<!--"),
        F.concat(F.lit("  Source: "), url),
        F.concat(F.lit("  Crawled: "), crawled),
        line("  Published: ", published),
        line("  Author: ", author),
        F.lit("-->\n"),
        line("# ", title, "\n"),
        line("> ", description, "\n"),
        body,
    )


def write_markdown(df: DataFrame, path: str) -> None:
    """Parquet keeps one row per document, also for texts with newlines."""
    df.write.mode("errorifexists").parquet(path)


def outcome_report(results: DataFrame, item: str, ok: str, error: str) -> DataFrame:
    """One summary line and one line per failed item."""
    n_ok, n = F.count_if(F.col(ok)), F.count(F.lit(1))
    head = results.agg(
        F.lit("summary").alias("kind"),
        F.concat(F.lit("Success: "), n_ok, F.lit("/"), n, F.lit(", Failed: "), n - n_ok).alias("line"),
    )
    failed = results.where(~F.col(ok)).select(
        F.lit("failed").alias("kind"),
        F.concat(F.lit("- "), F.col(item), F.lit(": "), F.coalesce(F.col(error), F.lit(""))).alias("line"),
    )
    return head.unionByName(failed)
