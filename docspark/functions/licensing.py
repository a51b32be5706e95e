"""Licence names and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, mentions, strip_blank

NO_ATTRIBUTION, ATTRIBUTION = "no-attribution", "attribution-required"

# Canonical licence names.
CANONICAL_NAMES = {
    "cc0": "CC0", "cc 0": "CC0", "public domain": "Public Domain", "publicdomain": "Public Domain",
    "pdm": "Public Domain", "pexels license": "Pexels License",
    "pixabay content license": "Pixabay Content License", "pixabay license": "Pixabay Content License",
}
CC_NAME = r"^\s*cc[\s-]+(by(?:[\s-]+(?:sa|nc|nd))*)\s*([0-9.]*)\s*$"

# Tokens of each tier.
NO_ATTRIBUTION_TOKENS = [
    "cc0", "public domain", "publicdomain", "creativecommons.org/publicdomain/", "pexels license",
    "pixabay content license", "pixabay license",
]
ATTRIBUTION_TOKENS = [
    "cc by", "cc-by", "by-sa", "by sa", "creativecommons.org/licenses/by/", "creativecommons.org/licenses/by-sa/",
]
REJECTED_TOKENS = [
    "by-nc", "by nc", "noncommercial", "non-commercial", "by-nd", "by nd", "no derivatives", "noderivatives",
    "all rights reserved",
]
STOCK_PROVIDERS = ["pexels", "pixabay"]

# Display names of providers.
PROVIDER_NAMES = {
    "openverse": "Openverse", "wikimedia": "Wikimedia Commons", "pexels": "Pexels", "pixabay": "Pixabay",
}


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def license_name(c: Column) -> Column:
    """Canonical display form; unknown names are trimmed only."""
    trimmed = strip_blank(F.coalesce(c, F.lit("")))
    key = F.lower(trimmed)
    suffix = F.upper(F.replace(F.regexp_extract(key, CC_NAME, 1), F.lit(" "), F.lit("-")))
    version = F.regexp_extract(key, CC_NAME, 2)
    cc = F.rtrim(F.concat(F.lit("CC "), suffix, F.lit(" "), version))
    return F.coalesce(F.try_element_at(_literal_map(CANONICAL_NAMES), key), F.when(key.rlike(CC_NAME), cc), trimmed)


def license_tier(name: Column, url: Column, provider: Column) -> Column:
    """Tier of a licence; NULL rejects the item."""
    parts = [F.lower(strip_blank(F.nullif(p, F.lit("")))) for p in (name, url)]
    key = F.lower(strip_blank(F.coalesce(provider, F.lit(""))))

    def tier(text):
        by = mentions(text, ATTRIBUTION_TOKENS)
        stock = key.isin(STOCK_PROVIDERS) & F.contains(text, key)
        return (
            F.when(mentions(text, REJECTED_TOKENS), F.lit(None).cast("string"))
            .when(mentions(text, NO_ATTRIBUTION_TOKENS) | (stock & ~by), F.lit(NO_ATTRIBUTION))
            .when(by, F.lit(ATTRIBUTION))
        )

    return let(F.concat_ws(" ", *parts), tier)


def attribution_text(
    filename: Column, title: Column, author: Column, provider: Column, name: Column, url: Column, download_url: Column
) -> Column:
    """Credit line; empty parts are left out."""

    def full(c):
        return F.nullif(c, F.lit(""))

    shown = F.coalesce(F.try_element_at(_literal_map(PROVIDER_NAMES), provider), full(provider), F.lit("unknown"))
    middle = F.concat_ws(
        " ", F.concat(F.lit('"'), full(title), F.lit('"')), F.concat(F.lit("by "), full(author)), F.concat(F.lit("via "), shown))
    lic = F.coalesce(F.concat(full(name), F.lit(" ("), full(url), F.lit(")")), full(name), full(url))
    return F.concat_ws(
        " — ", F.coalesce(full(filename), full(download_url), F.lit("image")), middle, F.concat(F.lit("license: "), lic))
