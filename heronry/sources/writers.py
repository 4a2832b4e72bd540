"""Writers and the table changes behind them. Output is distributed: one file a partition, never one made on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new`, and `written`: true where a row is new or differs. Keys are unique and not null; columns are the same."""
    rest = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*rest).alias("a"))
    b = new.select(key, F.struct(*rest).alias("b"))
    both = a.join(b, key, "full")
    written = F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))
    return both.select(key, F.coalesce("b", "a").alias("row"), written.alias("written")).select(key, "row.*", "written")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` whose keys aren't in `old`, once each; running it again adds nothing."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def field_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, field, change, before, after): a row for each field that differs between two versions; values as strings."""
    rest = [c for c in old.columns if c != key]

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(key, F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(value)) for c in rest))))

    both = long(old, "before").withColumn("was", F.lit(True)).join(long(new, "after").withColumn("is", F.lit(True)), [key, "field"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(key, "field", change.alias("change"), "before", "after").filter("change is not null")


def features(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with a point as GeoJSON features (column value), rows without one left out."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 5), F.round(lat, 5)).alias("coordinates"))
    told = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return told.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_features(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon") -> None:
    """A folder of compressed files with a feature on each line."""
    features(df, lat, lon).write.mode("overwrite").option("compression", "gzip").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quotes doubled, UTC times; nulls are empty, empty strings quoted."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, digest): the digest is that of the rows as a multiset, whatever their order or partitions."""
    h = lambda k: F.coalesce(F.sum(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n_rows"), h(1).alias("a"), h(2).alias("b")).select("n_rows", F.sha2(F.concat_ws(":", "n_rows", "a", "b"), 256).alias("digest"))


def write_version(tables: dict[str, DataFrame], path: str, version: str) -> DataFrame:
    """Writes each table below path/v=version and gives the manifest (name, n_rows, digest), of what can be read back there."""
    spark = next(iter(tables.values())).sparkSession
    told = []
    for name, df in tables.items():
        place = f"{path.rstrip('/')}/v={version}/{name}"
        df.write.mode("overwrite").parquet(place)
        told.append(fingerprint(spark.read.parquet(place)).select(F.lit(name).alias("name"), "n_rows", "digest"))
    manifest = reduce(DataFrame.unionByName, told)
    manifest.write.mode("overwrite").json(f"{path.rstrip('/')}/v={version}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path.rstrip('/')}/v={version}/manifest")


def write_cells(rows: DataFrame, path: str, degrees: float, period: str = "day") -> None:
    """Counts of (at, lat, lon) per grid cell, in one folder a day or month; cells are named by their lower corner."""
    when = F.date_format("at", "yyyy-MM-dd" if period == "day" else "yyyy-MM")
    corner = lambda c: F.round(F.floor(F.col(c) / degrees) * degrees, 6)
    counted = rows.dropna(subset=["at", "lat", "lon"]).groupBy(when.alias("period"), corner("lat").alias("cell_lat"), corner("lon").alias("cell_lon")).agg(F.count("*").alias("n"))
    counted.write.mode("overwrite").partitionBy("period").parquet(path)
