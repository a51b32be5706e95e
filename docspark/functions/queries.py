"""Search queries: simplification, tokens, required terms, relevance, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mentions, strip_blank

# Words never searched for, and words dropped only beside better ones.
NOISE_WORDS = [
    "claude", "openai", "gpt", "gemini", "copilot", "chatgpt", "midjourney", "stable", "diffusion", "dall-e",
    "cursor", "anthropic", "microsoft", "google", "apple", "meta", "nvidia", "tesla",
    "using", "with", "from", "that", "this", "have", "been", "will", "into", "more", "also", "very", "some",
    "than", "them", "other",
]
SOFT_NOISE_WORDS = [
    "ai", "code", "software", "system", "digital", "platform", "solution", "application", "interface",
    "framework", "algorithm", "api", "sdk", "assistant", "tool", "service", "technology", "tech", "program",
    "professional", "editorial", "commercial", "premium", "stock", "photo", "photograph", "photography", "image",
    "picture", "visual", "background", "hero", "cover", "banner", "wallpaper", "high", "quality", "resolution",
    "sharp", "clean", "cinematic", "dramatic", "lighting", "light", "modern", "natural", "visible",
]
EDGE = r"""[.,;:!?"'()\[\]{}，。；：！？、]"""
SEPARATORS = r"""[\s\-_./:;,'"()\[\]{}]+"""
# Transit words that lower a score unless the query asks for them.
TRANSIT_TERMS = ["station", "subway", "metro", "rail", "transit", "airport", "bus", "地铁", "站", "轨道"]


def _words(query: Column) -> Column:
    """Words longer than two characters without colours, asides and edge marks."""
    cleaned = F.regexp_replace(F.regexp_replace(query, r"#[0-9a-fA-F]{3,8}", ""), r"\([^)]*\)", "")
    bare = F.transform(F.split(cleaned, r"\s+"), lambda w: F.regexp_replace(w, f"^{EDGE}+|{EDGE}+$", ""))
    return F.filter(bare, lambda w: F.length(w) > 2)


def _concrete(words: Column) -> Column:
    hard = F.filter(words, lambda w: ~F.lower(w).isin(NOISE_WORDS))
    soft = F.filter(hard, lambda w: ~F.lower(w).isin(SOFT_NOISE_WORDS))
    return F.when(F.size(soft) > 0, soft).otherwise(hard)


def simplify_query(query: Column, max_words: int = 4) -> Column:
    kept = _concrete(_words(query))
    return F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, max_words), " ")).otherwise(strip_blank(query))


def query_progression(query: Column) -> Column:
    """The query and its shorter forms, without repeats."""
    forms = F.array(strip_blank(query), *[simplify_query(query, n) for n in (4, 3, 2, 1)])
    return F.array_distinct(F.filter(F.transform(forms, strip_blank), lambda f: f != ""))


def query_tokens(query: Column) -> Column:
    """Lower-case ASCII keywords used for relevance."""
    return _concrete(F.filter(_words(F.lower(query)), lambda w: ~w.rlike(r"[^\x00-\x7F]")))


def candidate_text(title: Column, author: Column, url: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, author, url)]))


def relevance(tokens: Column, text: Column) -> Column:
    """Share of tokens found in the text; 1 without tokens."""
    return (
        F.when(F.size(tokens) == 0, F.lit(1.0)).when(text == "", F.lit(0.0))
        .otherwise(F.size(F.filter(tokens, lambda t: F.contains(text, t))) / F.size(tokens))
    )


def normalize_match(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), SEPARATORS, " "))


def compact(c: Column) -> Column:
    return F.replace(normalize_match(c), F.lit(" "), F.lit(""))


def required_terms(raw: Column) -> Column:
    """Comma-separated or listed term groups as a clean array."""
    return F.filter(F.transform(F.split(raw, ","), strip_blank), lambda t: t != "")


def alternatives(terms: Column) -> Column:
    """Per term group the separator-free forms of its ``a|b`` alternatives."""
    return F.transform(terms, lambda g: F.filter(F.transform(F.split(g, r"\|"), compact), lambda a: a != ""))


def _met(alts: Column, body: Column) -> Column:
    return F.exists(alts, lambda a: F.contains(body, a))


def gate_passes(alts: Column, body: Column) -> Column:
    """Every group that has alternatives finds one in the separator-free text.

    ``body`` is read outside the lambda as well, so that it is computed once
    per row and not once per alternative.
    """
    return body.isNotNull() & F.forall(alts, lambda g: (F.size(g) == 0) | _met(g, body))


def missing_terms(terms: Column, body: Column) -> Column:
    """Term groups with no alternative in ``body``, the text without separators."""
    pairs = F.arrays_zip(terms.alias("t"), alternatives(terms).alias("a"))
    bad = F.filter(pairs, lambda p: (F.size(p["a"]) > 0) & ~_met(p["a"], body))
    return F.when(body.isNotNull(), F.transform(bad, lambda p: p["t"]))


def title_hits(alts: Column, body: Column) -> Column:
    """Number of term groups with an alternative in the title without separators."""
    return F.when(body.isNotNull(), F.size(F.filter(alts, lambda g: _met(g, body))))


def mentions_transit(text: Column) -> Column:
    return mentions(text, TRANSIT_TERMS)


def orientation(width: Column, height: Column) -> Column:
    return (
        F.when((width <= 0) | (height <= 0), F.lit("unknown")).when(width > height, F.lit("landscape"))
        .when(height > width, F.lit("portrait")).otherwise(F.lit("square"))
    )


def ratio_class(ratio: Column) -> Column:
    return (
        F.when(ratio > 2.0, F.lit("Ultra-wide")).when(ratio > 1.5, F.lit("Wide landscape"))
        .when(ratio > 1.2, F.lit("Standard landscape")).when(ratio > 0.8, F.lit("Near square")).otherwise(F.lit("Portrait"))
    )


def pixel_score(width: Column, height: Column) -> Column:
    pixels = F.greatest(width, F.lit(0)).cast("double") * F.greatest(height, F.lit(0)) / 1000.0
    return F.least(pixels, F.lit(1500.0))


def subject_score(rel: Column, in_title: Column, transit_penalty: Column, width: Column, height: Column, tier: Column) -> Column:
    """Score parts that follow from the subject and the candidate; relevance dominates."""
    return (
        rel * 10000.0
        + in_title * 1500.0
        - F.when(transit_penalty, 5000.0).otherwise(0.0)
        + F.when(tier == "no-attribution", 250.0).otherwise(0.0)
        + pixel_score(width, height)
    )


def preference_score(width: Column, height: Column, wanted: Column, min_width: Column, min_height: Column) -> Column:
    """Score parts that follow from the shape and size a request prefers."""
    asked = F.lower(strip_blank(F.coalesce(wanted, F.lit(""))))
    return (
        F.when(asked == "", 0.0).when(orientation(width, height) == asked, 1000.0).otherwise(-250.0)
        - F.when((min_width > 0) & (width < min_width), 500.0).otherwise(0.0)
        - F.when((min_height > 0) & (height < min_height), 500.0).otherwise(0.0)
    )


def rank_score(
    rel: Column, in_title: Column, transit_penalty: Column, width: Column, height: Column,
    wanted: Column, min_width: Column, min_height: Column, tier: Column,
) -> Column:
    """Score of a candidate for a request; rounded so that equal scores tie."""
    return F.round(
        subject_score(rel, in_title, transit_penalty, width, height, tier)
        + preference_score(width, height, wanted, min_width, min_height), 6)
