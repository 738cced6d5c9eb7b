"""Scrubbing of personal data, URL trimming and key digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CUSTOMER_ID = r"\d{4}[A-Z]{5}"
CUSTOMER_ID_HYPHEN = r"\d{4}-?[A-Z]{5}"
PHONE = r"(?U)(?<![\w-])\+?\d[\d\s().-]{7,}\d(?!\d)"
PHONE_LIKE = r"(?U)\d[\d\s().-]{7,}\d"
MARK_EMAIL, MARK_CUSTOMER_ID, MARK_PHONE = "[EMAIL]", "[CUSTOMER_ID]", "[PHONE]"
# ----------------------------------------------------------------------------


def _scrub_email(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL, MARK_EMAIL)).otherwise(text)


def _scrub_phone(text: Column) -> Column:
    """The look-behind is tried at every character, so a plainer pattern that
    covers every match decides first whether the text needs it at all."""
    return F.when(text.rlike(PHONE_LIKE), F.regexp_replace(text, PHONE, MARK_PHONE)).otherwise(text)


def redact(text: Column, *, strict: bool = True) -> Column:
    """Replace e-mails, then customer ids, then phone-like digit runs.

    ``strict=False`` also catches customer ids written with a hyphen.
    """
    ids = CUSTOMER_ID if strict else CUSTOMER_ID_HYPHEN
    return _scrub_phone(F.regexp_replace(_scrub_email(text), ids, MARK_CUSTOMER_ID))


def redact_map(facts: Column) -> Column:
    """A profile map with keys and values scrubbed; the later of two equal keys wins.

    The scrubbed entries are bound as the one element of an array: named by
    their expression, they would be scrubbed again for every entry they are
    compared with.
    """
    scrubbed = F.transform(
        F.map_entries(facts),
        lambda e: F.struct(redact(e["key"]).alias("key"), redact(e["value"]).alias("value")),
    )

    def last_of_each_key(entries: Column) -> Column:
        return F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
                lambda later: later["key"] == e["key"],
            ),
        )

    return F.map_from_entries(F.transform(F.array(scrubbed), last_of_each_key)[0])


def pii_counts(text: Column) -> dict[str, Column]:
    """Matches per kind, counted in the order the scrubber replaces them."""
    no_email = _scrub_email(text)
    no_ids = F.regexp_replace(no_email, CUSTOMER_ID, MARK_CUSTOMER_ID)
    none = F.lit(0)
    return {
        "emails": F.when(text.contains("@"), F.regexp_count(text, F.lit(EMAIL))).otherwise(none),
        "customer_ids": F.regexp_count(no_email, F.lit(CUSTOMER_ID)),
        "phones": F.when(
            no_ids.rlike(PHONE_LIKE), F.regexp_count(no_ids, F.lit(PHONE))
        ).otherwise(none),
    }


def url_path_only(url: Column) -> Column:
    """The path of a URL; host, query and fragment never get stored."""
    return F.try_parse_url(url, F.lit("PATH"))


def key_digest(token: Column, host: Column) -> Column:
    """Caller key: a short digest of the token, else the caller's address."""
    return F.when(
        token.isNotNull(),
        F.concat(F.lit("token:"), F.substring(F.sha2(token, 256), 1, 16)),
    ).otherwise(F.concat(F.lit("addr:"), F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))))
