"""Script file names and download outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsieve.functions.urls import numbered_name, script_name

MAX_RESPONSE_BYTES = 5 * 1024 * 1024


def name_scripts(resolved: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``local_file``: ``inline_<n>.js``, or the external name made unique on its page.

    Only light columns meet the shuffle of the window; its groups are the uses of one name on
    one page, which are bounded by that page's own text.
    """
    ok = (F.col("kind") == "external") & F.col("url_error").isNull()
    named = resolved.withColumn("_name", F.when(ok, script_name(F.col("source_url"))))
    inline = named.filter(F.col("kind") == "inline").withColumn(
        "local_file", F.concat(F.lit("inline_"), F.col("inline_no").cast("string"), F.lit(".js"))
    )
    failed = named.filter((F.col("kind") == "external") & F.col("url_error").isNotNull()).withColumn("local_file", F.lit(""))
    nth = F.row_number().over(Window.partitionBy(key, "_name").orderBy("pos"))
    external = named.filter(ok).withColumn("local_file", numbered_name(F.col("_name"), nth))
    return inline.unionByName(failed).unionByName(external).drop("_name")


def script_manifest(named: DataFrame, resources: DataFrame, key: str = "page_id",
                    max_bytes: int = MAX_RESPONSE_BYTES) -> DataFrame:
    """One outcome row per script from pre-fetched resources (url, status, body).

    Bodies are reduced to sizes before the join; inline scripts have no source and bypass it.
    """
    fetched = resources.select(
        F.col("url").alias("source_url"), F.col("status"), F.octet_length("body").cast("long").alias("_size")
    )
    external = F.col("kind") == "external"
    tried = external & F.col("url_error").isNull()
    sized = named.withColumn("_inline_size", F.octet_length("body").cast("long")).drop("body")
    unfetched = [F.lit(None).cast(f.dataType).alias(f.name) for f in fetched.schema if f.name != "source_url"]
    joined = sized.filter(external).join(fetched, "source_url", "left").unionByName(sized.filter(~external).select("*", *unfetched))
    error = (
        F.when(external & F.col("url_error").isNotNull(), F.col("url_error"))
        .when(tried & F.col("status").isNull(), F.lit("not fetched"))
        .when(tried & (F.col("_size") > max_bytes), F.lit(f"response exceeded max bytes ({max_bytes})"))
        .when(tried & ~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    return joined.withColumn("error", error).select(
        key, "pos", "local_file", "source_url", "kind",
        F.when(tried, F.col("status")).alias("http_status"),
        F.when(F.col("error").isNotNull(), F.lit(0).cast("long")).when(external, F.col("_size")).otherwise(F.col("_inline_size")).alias("bytes"),
        "error",
    )


def saved_counts(manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """Scripts saved without error, per page."""
    return manifest.groupBy(key).agg(
        F.count("*").alias("scripts"), F.count_if(F.col("error").isNull()).alias("saved")
    )


def manifest_documents(manifest: DataFrame, pages: DataFrame, fetched_at: str, key: str = "page_id") -> DataFrame:
    """One JSON manifest per page; a page's entries are no larger than the page itself."""
    entry = F.struct("local_file", "source_url", "kind", "http_status", "bytes", "error")
    files = manifest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("e")))).alias("_f"))
    return pages.select(key, "url").join(files, key, "left").select(
        key,
        F.to_json(F.struct(
            F.col("url").alias("page_url"), F.lit(fetched_at).alias("fetched_at"),
            F.transform(F.coalesce("_f", F.array().cast(files.schema["_f"].dataType)), lambda x: x["e"]).alias("files"),
        )).alias("document"),
    )
