"""Fixed label sets: temperature classes, regions, sentiment labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Temperature class id -> label.
TEMP_LABELS = ("very cold", "cold", "mild/not relevant", "hot", "very hot")
UNKNOWN_TEMP = "unknown"

# The countries counted as "EU", members first, then other European states.
EUROPEAN_COUNTRIES = (
    "austria", "belgium", "bulgaria", "croatia", "cyprus", "czech republic",
    "denmark", "estonia", "finland", "france", "germany", "greece",
    "hungary", "ireland", "italy", "latvia", "lithuania", "luxembourg",
    "malta", "netherlands", "poland", "portugal", "romania", "slovakia",
    "slovenia", "spain", "sweden",
    "albania", "andorra", "belarus", "bosnia and herzegovina", "iceland",
    "liechtenstein", "monaco", "montenegro", "north macedonia", "norway",
    "russia", "san marino", "serbia", "switzerland", "ukraine",
    "united kingdom", "vatican city",
)
US_COUNTRY = "united states"
UNKNOWN_LOCATION = "Unknown"

# Class order of the two pretrained sentiment models. They are reversed.
TWITTER_SENTIMENT_LABELS = ("negative", "neutral", "positive")
CLIMATE_SENTIMENT_LABELS = ("positive", "neutral", "negative")


def temp_category(class_id: Column) -> Column:
    """Class id to label; null and out-of-range ids become ``unknown``."""
    label = F.when(class_id == 0, TEMP_LABELS[0])
    for i, name in enumerate(TEMP_LABELS[1:], start=1):
        label = label.when(class_id == i, name)
    return label.otherwise(UNKNOWN_TEMP)


def region_of(location: Column) -> Column:
    """Location to ``EU`` / ``US`` / ``Unknown`` / ``Other``; null counts as unknown."""
    name = F.lower(F.coalesce(location, F.lit(UNKNOWN_LOCATION)))
    return (
        F.when(name.isin(list(EUROPEAN_COUNTRIES)), "EU")
        .when(name == US_COUNTRY, "US")
        .when(name == UNKNOWN_LOCATION.lower(), "Unknown")
        .otherwise("Other")
    )


def share_text(count: Column, total: Column) -> Column:
    """``"3 (37.5%)"``. ``format_number`` rounds the binary value half-even as Python does."""
    share = F.format_number(count / total * 100, 1)
    return F.concat(count.cast("string"), F.lit(" ("), share, F.lit("%)"))
