"""Trigger events and storage addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import or_str


# Fields of a direct trigger beside those that name the data set.
FIELDS = (
    "eval_run_id", "git_sha", "repo", "eval_mode", "eval_backend", "judge_model_id", "candidate_model_id", "agent_endpoint",
)
NUMBERS = ("pr_number", "check_run_id")


def decoded_key(key: Column) -> Column:
    """URL-decoded object key; a ``%`` that starts no escape stays, and a key that still does not decode
    to text stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(key, "%(?![0-9A-Fa-f]{2})", "%25")), key)


def split_uri(df: DataFrame, uri: str, scheme: str = "s3") -> DataFrame:
    """Add bucket, key and is_valid. The key starts after the leading slashes.

    A query or fragment is no part of the key.
    """
    pattern = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"
    found = F.lower(F.regexp_extract(uri, pattern, 1)) == scheme
    host, path = F.regexp_extract(uri, pattern, 2), F.regexp_extract(uri, pattern, 3)
    valid = F.coalesce(found & (host != "") & (path != ""), F.lit(False))
    return (
        df.withColumn("is_valid", valid)
        .withColumn("bucket", F.when(valid, host))
        .withColumn("key", F.when(valid, F.regexp_replace(path, "^/+", "")))
    )


def normalise_triggers(events: DataFrame, body: str = "event") -> DataFrame:
    """Bring three trigger shapes to dataset_bucket / dataset_key (and dataset_id).

    Order: first storage record; ``detail`` with bucket and object; else the
    fields of ``detail`` overlaid by the top level. Keys of the first two are
    URL-decoded, with + as a space; only the third has further fields (``FIELDS``
    as text, ``NUMBERS`` as integers), which are NULL when absent.
    """
    v = F.col("_v")

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    parsed = events.withColumn("_v", F.try_parse_json(body))
    record = F.coalesce(kind("$.Records[0].s3").startswith("OBJECT"), F.lit(False))
    nested = or_str(text("$.detail.bucket.name")).isNotNull() & or_str(text("$.detail.object.key")).isNotNull()

    def merged(name: str) -> Column:
        top = F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
        return F.when(top, text(f"$.{name}")).otherwise(text(f"$.detail.{name}"))

    return (
        parsed.withColumn("trigger", F.when(record, "record").when(nested, "detail").otherwise("direct"))
        .withColumn(
            "dataset_bucket",
            F.when(record, text("$.Records[0].s3.bucket.name"))
            .when(nested, text("$.detail.bucket.name"))
            .otherwise(merged("dataset_bucket")),
        )
        .withColumn(
            "dataset_key",
            F.when(record, decoded_key(text("$.Records[0].s3.object.key")))
            .when(nested, decoded_key(text("$.detail.object.key")))
            .otherwise(or_str(merged("dataset_key"), merged("dataset_s3_key"))),
        )
        .withColumn(
            "dataset_id",
            F.when(~record & ~nested, or_str(merged("dataset_id"), merged("dataset_manifest_id"))),
        )
        .withColumns({name: F.when(~record & ~nested, merged(name)) for name in FIELDS})
        .withColumns({name: F.when(~record & ~nested, merged(name)).try_cast("bigint") for name in NUMBERS})
        .drop("_v")
    )
