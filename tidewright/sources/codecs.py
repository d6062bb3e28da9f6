"""Row codecs that are expressions: JSON, FIX and NVFIX payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text a row: null and NaN as null, times RFC 3339 with microseconds, bytes base64."""
    cols = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        cols.append((F.base64(x) if t == "binary" else F.when(~F.isnan(x), x) if t in ("double", "float") else x).alias(c))
    opts = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*cols), opts).alias(name))


def sow_batches(df: DataFrame, rows: int = 200) -> DataFrame:
    """A snapshot as it is sent: (batch, json rows), at most ``rows`` a batch. Batches are cut within partitions, so nothing is
    ordered or numbered across them."""
    at = F.monotonically_increasing_id()
    own = to_json_rows(df).select("json", F.floor(at / F.lit(2**33)).alias("_p"), F.floor((at % F.lit(2**33)) / F.lit(rows)).alias("_c"))
    return own.groupBy("_p", "_c").agg(F.collect_list("json").alias("rows")).select((F.col("_p") * F.lit(2**33) + F.col("_c")).alias("batch"), "rows")


def parse_fix(c: Column) -> Column:
    """tag=value pairs split by SOH, as a map."""
    return F.str_to_map(F.rtrim(c, F.lit("\u0001")), F.lit("\u0001"), F.lit("="))


def format_fix(fields: Column) -> Column:
    """A map to tag=value pairs, tags in order, each ended by SOH."""
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("\u0001")))
    return F.array_join(pairs, "")


parse_nvfix, format_nvfix = parse_fix, format_fix  # named fields instead of numeric tags; the syntax is one
