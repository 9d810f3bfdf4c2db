"""JSON objects inside model text, read strictly and without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.text import strip

# Fixed value: a fenced block with an optional json tag, any letter case.
_FENCE = r"(?i)```(?:json)?[\s\x1c-\x1f]*([\s\S]*?)```"


def strict_object(text: Column) -> Column:
    """VARIANT of ``text`` when it is exactly one JSON object, else NULL.

    The parser accepts trailing text, so the candidate is parsed as the only
    element of an array: trailing text, a second object or a non-object fails.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.try_variant_get(wrapped, "$[0]", "variant")
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    is_object = F.schema_of_variant(first).startswith("OBJECT<")
    return F.when(F.endswith(text, F.lit("}")) & is_object & alone, first)


def repair_commas(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(",}"), F.lit("}")), F.lit(",]"), F.lit("]"))


def extract_object(df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """Add the first JSON object found in model text as a VARIANT, or NULL.

    Candidates in order: the whole text, every fenced block, the span from the
    first to the last brace; each as it stands, then with commas repaired.
    """
    stripped = df.withColumn("_text", strip(F.col(text)))
    fences = F.transform(F.regexp_extract_all("_text", F.lit(_FENCE), F.lit(1)), strip)
    first, last = F.instr("_text", F.lit("{")), F.length("_text") - F.instr(F.reverse("_text"), F.lit("}")) + 1
    span = F.when(
        (F.instr("_text", F.lit("{")) > 0) & (F.instr("_text", F.lit("}")) > 0) & (last > first),
        F.substring(F.col("_text"), first, last - first + 1),
    )
    candidates = F.array_distinct(F.array_compact(F.concat(F.array("_text"), fences, F.array(span))))

    def read(c: Column) -> Column:
        return F.coalesce(strict_object(c), strict_object(repair_commas(c)))

    parsed = F.filter(F.transform(candidates, lambda c: F.struct(read(c).alias("v"))), lambda s: s["v"].isNotNull())
    found = F.when(F.length("_text") > 0, F.get(parsed, 0)["v"])
    return stripped.withColumn(out, found).drop("_text")


def variant_kind(value: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL..., ARRAY<..>, OBJECT<..>, VOID."""
    return F.schema_of_variant(value)


def truthy(value: Column) -> Column:
    """Truth of a JSON value: non-zero, non-empty; the string "false" is true."""
    kind = variant_kind(value)
    as_text = F.try_variant_get(value, "$", "string")
    as_number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", as_text != "")
        .when(kind.startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant").isNotNull())
        .when(kind.startswith("OBJECT"), kind != "OBJECT<>")
        .otherwise(as_number != 0)
    )


def number_or_null(value: Column) -> Column:
    """A JSON number, boolean or numeric string as a double."""
    text = strip(F.try_variant_get(value, "$", "string"))
    return F.when(variant_kind(value) == "STRING", text.try_cast("double")).otherwise(
        F.try_variant_get(value, "$", "double")
    )


def text_or_empty(value: Column) -> Column:
    """Text of a JSON value that counts as true, else the empty string."""
    return F.when(truthy(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))).otherwise(F.lit(""))
