"""Pinned scans, verified artifacts, versioned sinks, and rows from JSON, GeoJSON, KML and HTML."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.picks import best_row

#: Bytes that are read of a file at once.
_BLOCK = 4 << 20


def _opened(path: str):
    """A stream of a file's bytes, from any store that Arrow opens; s3a is s3 there."""
    scheme, _, rest = path.partition(":")  # Spark gives paths as they are, Arrow wants them quoted
    uri = f"file://{quote('/' + rest.lstrip('/'))}" if scheme == "file" else f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}"
    system, place = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(place, buffer_size=0)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and SHA-256 of each file, read in blocks."""
    for batch in batches:
        for path in batch["path"]:
            digest, size = hashlib.sha256(), 0
            with _opened(path) as stream:
                while block := stream.read(_BLOCK):
                    digest.update(block)
                    size += len(block)
            yield pd.DataFrame({"path": [path], "bytes": [size], "sha256": [digest.hexdigest()]})


def stat_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path. Spark lists them and packs them into tasks by size; a task reads its files in blocks of 4 MB,
    so that memory stays flat at any size of file. A file that goes while it is read is an error. Spark's listing leaves out empty files, which
    therefore count as missing."""
    listed = spark.read.format("binaryFile").load(path).select("path")  # without the content, which isn't read then
    return listed.mapInPandas(_digests, "path string, bytes long, sha256 string")


def verify_artifacts(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Each listed file with the state of its size and hash."""
    f = found.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("h"))
    state = F.when(F.col("h").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size differs").when(F.col("h") != F.col("sha256"), "hash differs").otherwise("ok")
    return manifest.join(f, "path", "left").select("path", state.alias("state"))


def pinned_scan(spark: SparkSession, manifest: DataFrame, suffix: str, schema: StructType) -> DataFrame:
    """Exactly the files that the manifest (path, sha256, status) lists with ``suffix``; a failed, repeated or missing listing, or a
    file with another schema, is an error. The driver holds the list of paths only."""
    rows = manifest.filter(F.col("path").endswith(suffix)).select("path", "status").collect()
    paths = [r.path for r in rows]
    if not paths or len(set(paths)) < len(paths) or any(r.status != "done" for r in rows):
        raise ValueError("the manifest lists no file, one twice, or one that is not done")
    for p in paths:
        if [(f.name, f.dataType) for f in spark.read.parquet(p).schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"another schema in {p}")
    return spark.read.schema(schema).parquet(*paths)


def write_snapshot(df: DataFrame, root: str, stage: str, asset: str, version: str, by: list[str] = ()) -> str:
    """A new path for each version; an existing one is never overwritten."""
    path = f"{root}/{stage}/{asset}/version={version}"
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)
    return path


def write_table(df: DataFrame, path: str) -> None:
    """Typed columns to zstd Parquet."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def current_partitions(manifest: DataFrame) -> DataFrame:
    """The newest finished path of each (asset, partition)."""
    return best_row(manifest.filter("status = 'done'"), ["asset", "partition"], [F.col("version"), F.col("path")], descending=True)


def fan_in(spark: SparkSession, manifest: DataFrame, asset: str) -> DataFrame:
    """The union of an asset's current partitions."""
    return spark.read.parquet(*[r.path for r in current_partitions(manifest).filter(F.col("asset") == asset).select("path").collect()])


def read_seeds(spark: SparkSession, path: str, schema: str, array: str) -> DataFrame:
    """One row for each item of a nested array of JSON documents."""
    return spark.read.schema(schema).json(path).select(F.explode(array).alias("s")).select("s.*")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ring of the polygons of feature collections: (name, ring_no, ring)."""
    schema = "features array<struct<properties: struct<name: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).json(path).select(F.explode("features").alias("f")).filter("f.geometry.type = 'Polygon'")
    rings = f.select(F.col("f.properties.name").alias("name"), F.posexplode("f.geometry.coordinates").alias("ring_no", "points"))
    return rings.select("name", "ring_no", F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Stations of JSON elements, merged by (name, coordinates to five digits); the one with most tags wins."""
    schema = "elements array<struct<type: string, id: long, lat: double, lon: double, tags: map<string, string>>>"
    e = spark.read.schema(schema).json(path).select(F.explode("elements").alias("e")).select("e.*").filter("type = 'node'")
    keyed = e.withColumns({"name": F.element_at("tags", "name"), "y": F.round("lat", 5), "x": F.round("lon", 5), "n_tags": F.size("tags")})
    return best_row(keyed.select("name", "y", "x", "n_tags", "id"), ["name", "y", "x"], [-F.col("n_tags"), F.col("id")])


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring) of placemarks with a polygon."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    p = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    points = F.transform(F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda s: s != ""), lambda s: F.struct(F.split(s, ",")[0].cast("double").alias("x"), F.split(s, ",")[1].cast("double").alias("y")))
    return p.select("name", points.alias("ring"))


def preview(df: DataFrame, columns: list[str], column: str, value: str, mode: str, limit: int | None = None) -> DataFrame:
    """Chosen columns of rows that equal or contain a value; at most ``limit``, or all."""
    c = F.col(column).cast("string")
    found = df.filter(c == value if mode == "equal" else F.contains(F.lower(c), F.lit(value.lower()))).select(*columns)
    return found if limit is None else found.limit(limit)


def _all(pattern: str, group: int, column: str = "html") -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def extract_blocks(pages: DataFrame) -> DataFrame:
    """The paragraphs of a page with their figures: first number, count of numbers and words. Only columns; an unclosed tag ends at the next."""
    p = pages.select("page_id", F.posexplode(_all(r"(?is)<p>(.*?)(?=</?p>|</article>|$)", 1)).alias("block", "inner"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("inner", r"(?s)<[^>]*>", " "), r"\s+", " "))
    n = F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return p.select("page_id", "block", plain.alias("text")).select("page_id", "block", F.size(F.split("text", " ")).alias("words"), F.size(n).alias("numbers"), F.try_element_at(n, F.lit(1)).alias("first_number"), F.length("text").alias("chars"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Link candidates: attributes of anchors first, then bare URLs of the text; distinct, scored by where they stand."""
    tagged = pages.select("page_id", F.explode(_all(r"(?i)<a\s[^>]*href=\"([^\"]*)\"", 1)).alias("url"), F.lit(2).alias("score"))
    bare = pages.select("page_id", F.explode(_all(r"(?<![\"'=])(https?://[^\s\"'<>]+)", 1)).alias("url"), F.lit(1).alias("score"))
    return tagged.unionByName(bare).groupBy("page_id", "url").agg(F.max("score").alias("score"))


def extract_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row, label, link) of the list items that hold a link."""
    items = pages.select("page_id", F.posexplode(_all(r"(?is)<li>(.*?)</li>", 1)).alias("row", "item"))
    return items.select("page_id", "row", F.trim(F.regexp_replace("item", r"<[^>]*>", "")).alias("label"), F.regexp_extract("item", r"href=\"([^\"]*)\"", 1).alias("link")).filter("link <> ''")


def extract_fields(pages: DataFrame) -> DataFrame:
    """Label and value of a page's detail fields: language, title, first heading."""
    fields = F.array(*[F.struct(F.lit(k).alias("label"), F.regexp_extract("html", p, 1).alias("value")) for k, p in (("lang", r"<html lang=\"([^\"]*)\""), ("title", r"(?is)<title>(.*?)</title>"), ("heading", r"(?is)<h1>(.*?)</h1>"))])
    return pages.select("page_id", F.explode(fields).alias("f")).select("page_id", "f.*").filter("value <> ''")
