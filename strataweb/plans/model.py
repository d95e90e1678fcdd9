"""The archive's tables, derived from the test tables (pages, events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http
from ..operators.groups import Group

GROUPS = [
    Group(1, "English pages", "https://*/en/#"),
    Group(2, "", "https://blog.**"),
    Group(3, "Campaign links", "**?utm_source=feed", do_not_download=True, source_type="resource_group", source_id=1),
    Group(4, "Second pages", "http*://*.example.com/#?page=2**", source_type="resource_group", source_id=3),
    Group(5, "Example.org", "https://**.example.org/**", source_type="root_resource", source_id=1),
    Group(6, "Nothing", "https://nowhere.test/#", source_type="root_resource", source_id=99),
]
#: Source prefix, target prefix, external; the first that fits counts.
ALIASES = [
    ("https://blog.", "https://www.", False),
    ("https://blog.th", "https://never.", False),
    ("http://www.", "https://live.example.com/", True),
]
ROOTS = [(1, "Home", 2), (2, "Ten", 10), (3, "Lost", 999_999_999)]
#: Revisions fetched by this time are stale.
MIN_FETCH = "2024-01-15 00:00:00"
STATUS = {"view": 200, "click": 304, "purchase": 301, "signup": 404, "error": 500}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROOTS, "root_id long, name string, resource_id long")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *a) for k, a in enumerate(ALIASES)], "alias_id long, source_url_prefix string, target_url_prefix string, target_is_external boolean")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions: user_id is the resource, the event's kind its status, props.k its ETag."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[kind].cast("int")
    etag = F.concat(F.lit("e"), (k % 5).cast("string"))
    cookie = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")))
    headers = F.array(
        F.array(F.lit("Content-Type"), F.when(k % 4 == 0, 'Text/HTML; Charset="utf-8"').when(k % 4 == 1, "text/css").when(k % 4 == 2, "application/json; charset=latin1").otherwise("image/png")),
        F.array(F.lit("Date"), http.format_http_date(F.col("ts"))),
        F.array(F.lit("AGE"), (k % 100).cast("string")),
        F.array(F.lit("X-Unknown"), F.lit("1")),
        F.array(F.lit("ETag"), etag),
    )
    error = F.when(F.col("event_type") == "error", '{"type":"IOError","message":"lost"}').otherwise("null")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("resource_id"), cookie.alias("request_cookie"), error.alias("error"), status.alias("status_code"), etag.alias("etag"), F.col("ts").alias("date"), headers.alias("headers")
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a captured HTML response."""
    headers = F.array(F.array(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")))
    metadata = F.struct(F.lit(11).alias("http_version"), F.lit(200).alias("status_code"), F.lit("OK").alias("reason_phrase"), headers.alias("headers"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", metadata.alias("metadata"), F.col("html").alias("body"))
