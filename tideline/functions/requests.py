"""Strict checks of feature requests that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.fence import fenced


def _no(condition: Column) -> Column:
    """True unless the condition is known to hold."""
    return ~F.coalesce(condition, F.lit(False))


def _outside(keys: Column) -> Column:
    known = F.array(*[F.lit(k) for k in V.REQUEST_KEYS])
    return F.size(F.array_except(keys, known)) > 0


def check_requests(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Judge the JSON candidate in column ``text``.

    Adds ``status`` ('ok' or 'invalid'), ``reason``, ``envelope`` (reason code
    of the outer shape alone, where the flag is required), and for accepted
    candidates ``targets``, ``filters`` (in written order) and
    ``out_of_scope``. VARIANT keeps the JSON types, so a filter value of 24 is
    told apart from "24"; a plain map<string,string> would turn one into the
    other. The text is parsed once; later steps read the parsed value.
    """

    def is_text(v: Column) -> Column:
        return F.schema_of_variant(v) == "STRING"

    def as_text(v: Column) -> Column:
        return F.try_variant_get(v, "$", "string")

    v, keys, targets, filters, flag = (
        F.col(f"_{c}") for c in ("document", "keys", "targets", "filters", "flag")
    )
    parsed = df.withColumn("_document", F.try_parse_json(text))
    shaped = parsed.withColumns(
        {
            "_object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False)),
            "_targets": F.try_variant_get(v, "$.target_features", "array<variant>"),
            "_filters": F.try_variant_get(v, "$.filters", "map<string,variant>"),
            "_flag": F.schema_of_variant(F.try_variant_get(v, "$.out_of_scope", "variant")),
        }
    ).withColumn("_keys", F.when(F.col("_object"), F.json_object_keys(text)))

    def has(key: str) -> Column:
        return F.array_contains(keys, key)

    bad_target = F.exists(targets, lambda t: _no(is_text(t) & as_text(t).isin(*V.FEATURES)))
    bad_name = F.exists(F.map_keys(filters), lambda k: ~k.isin(*V.FEATURES))
    bad_value = F.exists(F.map_values(filters), lambda x: _no(is_text(x)))
    bad_flag = _no(flag == "BOOLEAN")
    shape = (
        F.when(v.isNull(), "not_json")
        .when(~F.col("_object"), "not_object")
        .when(_outside(keys), "unknown_key")
    )
    reason = (
        shape.when(has("target_features") & (targets.isNull() | bad_target), "bad_target")
        .when(has("filters") & filters.isNull(), "bad_filters")
        .when(has("filters") & bad_name, "bad_filter_name")
        .when(has("filters") & bad_value, "bad_filter_value")
        .when(has("out_of_scope") & bad_flag, "bad_flag")
        .otherwise("")
    )
    judged = shaped.withColumns(
        {"_reason": reason, "_envelope": shape.when(bad_flag, "bad_flag").otherwise("")}
    )
    ok = F.col("_reason") == ""
    written = F.from_json(F.col(text), "filters map<string,string>")["filters"]
    return fenced(
        judged,
        {
            f"{prefix}status": F.when(ok, "ok").otherwise("invalid"),
            f"{prefix}reason": F.col("_reason"),
            f"{prefix}envelope": F.col("_envelope"),
            f"{prefix}targets": F.when(
                ok, F.coalesce(F.transform(targets, as_text), F.array().cast("array<string>"))
            ),
            f"{prefix}filters": F.when(
                ok, F.coalesce(written, F.create_map().cast("map<string,string>"))
            ),
            f"{prefix}out_of_scope": F.when(
                ok, F.coalesce(F.try_variant_get(v, "$.out_of_scope", "boolean"), F.lit(False))
            ),
        },
        keep=df.columns,
    )


def accepted(prefix: str = "") -> Column:
    """True where a judged candidate passes both the request and the envelope check."""
    return (F.col(f"{prefix}status") == "ok") & (F.col(f"{prefix}envelope") == "")


def slot_ok(feature: Column, value: Column) -> Column:
    """True if a filter value fits its slot: a plain number or a menu value."""
    fits = F.when(feature.isin(*V.NUMERIC_FEATURES), value.rlike(V.NUMBER_SLOT))
    for name, menu in V.MENUS.items():
        fits = fits.when(feature == name, value.isin(*menu))
    return F.coalesce(fits.otherwise(False), F.lit(False))
