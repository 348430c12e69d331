"""Scalar column functions for reviews, ratings, dates and item addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aspect columns of a review, in table order.
ASPECTS = [
    "service", "cleanliness", "location", "value",
    "rooms", "sleep_quality", "check_in", "business_service",
]
# The aspects that enter aspect vectors.
VECTOR_ASPECTS = ["service", "cleanliness", "location", "value", "rooms", "sleep_quality"]
# Inclusive bounds of the text length and activity buckets (None = open).
LENGTH_BUCKETS = [(1, 10), (11, 50), (51, 100), (101, 200), (201, 500), (501, None)]
ACTIVITY_BUCKETS = [(1, 1), (2, 4), (5, 9), (10, 19), (20, 49), (50, 99), (100, None)]
# Fixed value: an item address, as "place id, item id, name, location".
ITEM_URL = r"^Hotel_Review-g(\d+)-d(\d+)-Reviews-(.+?)-(.+?)\.html$"

# Fixed value: the characters between words, as inside a character class.
WHITESPACE = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"

NO_TEXT = "no review"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*candidates: Column | str) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c).cast("string"), F.lit("")) for c in candidates])


def is_valid_review(user: Column | str, item: Column | str, rating: Column | str) -> Column:
    """A positive rating and two non-empty ids; a missing rating counts as zero."""
    return (
        (F.coalesce(_col(rating), F.lit(0.0)) > 0)
        & (F.length(F.coalesce(_col(user).cast("string"), F.lit(""))) > 0)
        & (F.length(F.coalesce(_col(item).cast("string"), F.lit(""))) > 0)
    )


def tolerant_double(value: Column | str) -> Column:
    """The number in `value`, null where there is none."""
    return _col(value).cast("string").try_cast("double")


def word_count(text: Column | str) -> Column:
    """Number of whitespace separated words."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(f"[^{WHITESPACE}]+")).cast("long")


def _bucket(n: Column, bounds: list[tuple[int, int | None]], below: str) -> Column:
    label = F.lit(below)
    for low, high in reversed(bounds):
        inside = n >= low if high is None else n.between(low, high)
        label = F.when(inside, F.lit(f"{low}+" if high is None else f"{low}-{high}")).otherwise(label)
    return label


def length_bucket(words: Column | str) -> Column:
    """Text length class of a word count; "0" for an empty text."""
    return _bucket(_col(words), LENGTH_BUCKETS, "0")


def activity_bucket(n: Column | str) -> Column:
    """Activity class of a number of interactions."""
    return _bucket(_col(n), ACTIVITY_BUCKETS, "0")


def extract_year(date: Column | str) -> Column:
    """A year between 1990 and 2030 from the first, else from the last four characters."""
    text = F.trim(_col(date))
    ends = [F.substring(text, 1, 4), F.substring(text, -4, 4)]
    numbers = [F.when(e.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(e).try_cast("int")) for e in ends]
    return F.coalesce(*[F.when(n.between(1990, 2030), n) for n in numbers]).cast("long")


def round_star(rating: Column | str) -> Column:
    """Rating to the nearest star, halves to the even one."""
    return F.bround(_col(rating)).cast("long")


def clean_text(text: Column | str) -> Column:
    """Null and blank texts become a fixed phrase."""
    filled = F.coalesce(_col(text), F.lit(""))
    return F.when(filled.rlike(f"[^{WHITESPACE}]"), filled).otherwise(F.lit(NO_TEXT))


def apply_text_policy(text: Column | str, lowercase: bool = True, max_length: int | None = None) -> Column:
    """Optional lower case and an optional bound on the words that are kept."""
    out = F.lower(_col(text)) if lowercase else _col(text)
    if max_length is None:
        return out
    words = F.regexp_extract_all(out, F.lit(f"[^{WHITESPACE}]+"), 0)
    return F.array_join(F.slice(words, 1, max_length), " ")


def unit_scale(rating: Column | str) -> Column:
    """A rating from 1..5 on 0..1."""
    return (_col(rating) - 1.0) / 4.0


def aspect_vector(columns: list[str], present: list[str]) -> Column:
    """Aspects on 0..1 as an array; a null aspect and an absent column count as 3 stars."""
    return F.array(*[
        unit_scale(F.coalesce(F.col(c), F.lit(3.0)) if c in present else F.lit(3.0)) for c in columns
    ])


def parse_item_url(url: Column | str) -> Column:
    """Struct of place id, item number, name and location slug; null where the address has another form."""
    u = _col(url)
    part = lambda n: F.regexp_extract(u, ITEM_URL, n)
    return F.when(
        u.rlike(ITEM_URL),
        F.struct(
            part(1).cast("long").alias("g_id"),
            part(2).cast("long").alias("d_id"),
            part(3).alias("hotel_name"),
            part(4).alias("location_slug"),
        ),
    )


def region_slug(location: Column | str) -> Column:
    """The last two parts of a location slug, or the only one."""
    tokens = F.split(_col(location), "_")
    two = F.concat_ws("_", F.element_at(tokens, -2), F.element_at(tokens, -1))
    return F.when(F.size(tokens) >= 2, two).otherwise(F.element_at(tokens, -1))


def country_slug(location: Column | str) -> Column:
    """The last part of a location slug."""
    return F.substring_index(_col(location), "_", -1)


def clip(x: Column | str, low: float = 1.0, high: float = 5.0) -> Column:
    return F.greatest(F.least(_col(x), F.lit(high)), F.lit(low))


def finite_or_zero(x: Column | str) -> Column:
    """NaN and infinite numbers become zero."""
    c = _col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def pairwise_loss(positive: Column | str, negative: Column | str) -> Column:
    """-ln(sigmoid(positive - negative)), kept finite."""
    return -F.log(sigmoid(_col(positive) - _col(negative)) + 1e-8)
