"""From raw reviews to interaction columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions import scalars as S

# Spellings of the aspects in the property map, in order of preference.
ASPECT_KEYS = {
    "service": ["service"],
    "cleanliness": ["cleanliness"],
    "location": ["location"],
    "value": ["value"],
    "rooms": ["rooms"],
    "sleep_quality": ["sleep quality"],
    "check_in": ["check in", "check-in"],
    "business_service": ["business service"],
}


def valid_reviews(df: DataFrame, user: str = "user_id", item: str = "item_id", rating: str = "rating") -> DataFrame:
    """Reviews with a positive rating and both ids."""
    return df.where(S.is_valid_review(user, item, S.tolerant_double(rating)))


def resolve_synonyms(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """For each output name, the first filled one of several source columns (absent ones are skipped)."""
    rest = [c for c in df.columns if c not in names and not any(c in v for v in names.values())]
    made = []
    for out, candidates in names.items():
        present = [c for c in candidates if c in df.columns]
        made.append((S.first_filled(*present) if present else F.lit(None).cast("string")).alias(out))
    return df.select(*made, *rest)


def flatten_aspects(df: DataFrame, properties: str = "property_dict") -> DataFrame:
    """The aspect map as one nullable column per aspect."""
    cols = [
        F.coalesce(*[S.tolerant_double(F.col(properties)[k]) for k in keys]).alias(name)
        for name, keys in ASPECT_KEYS.items()
    ]
    return df.select(*[c for c in df.columns if c != properties], *cols)


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that `df` has, in the wanted order."""
    return df.select([c for c in columns if c in df.columns])


def text_policy(df: DataFrame, text: str = "text", lowercase: bool = True, max_length: int | None = None,
                min_length: int = 1) -> DataFrame:
    """Lower case, drop texts below `min_length` words, keep at most `max_length` words if given."""
    long_enough = df.where(S.word_count(text) >= min_length)
    return long_enough.withColumn(text, S.apply_text_policy(text, lowercase, max_length))


def fill_missing_aspect_columns(df: DataFrame, aspects: list[str] = S.VECTOR_ASPECTS,
                                rating: str = "rating") -> DataFrame:
    """Add absent aspect columns with the overall rating (3 without one); present ones keep their nulls."""
    fallback = F.col(rating) if rating in df.columns else F.lit(3.0)
    return df.withColumns({a: fallback for a in aspects if a not in df.columns})


def normalise_aspects(df: DataFrame, aspects: list[str] = S.VECTOR_ASPECTS, out: str = "aspects") -> DataFrame:
    return df.withColumn(out, S.aspect_vector(aspects, df.columns))


def default_rating(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Implicit feedback: rating 1 where there is no rating column."""
    return df if rating in df.columns else df.withColumn(rating, F.lit(1.0))


def interactions(raw: DataFrame) -> DataFrame:
    """Valid raw reviews as interactions with string ids and flat aspects."""
    named = resolve_synonyms(raw, {
        "user_key": ["author", "user_url", "user_id"],
        "item_key": ["hotel_url", "item_id"],
        "rating": ["rating", "overall_rating"],
    })
    typed = valid_reviews(named.withColumn("rating", S.tolerant_double("rating")), "user_key", "item_key")
    wanted = ["user_key", "item_key", "rating", "text", "date", "title", *S.ASPECTS]
    return keep_existing(flatten_aspects(typed), wanted)
