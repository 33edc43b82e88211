"""Column names of the post tables, and the check that they are there."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The column names users of the result and rollup tables rely on.
TEXT = "text"
ACCOUNT = "account"
CLEANED_TEXT = "cleaned_text"
LEMMATIZED_TEXT = "lemmatized_text"
GLOSSARY_MAP = "Glossary_Map"
WEATHER_TOPICS = "weather_topics"
WEATHER_TEMP = "weather_temp"
FINAL_LOCATION = "final_location"
REGION = "region"
DOMINANT_TOPIC = "dominant_topic"
TOP_3_WORDS = "top_3_words"
COMBINED_TEXT = "combined_text"
TEMP_SENTIMENT = "climate_bert_temp_sentiment"
WORD_COUNT = "word_count"
GROUP_TOPIC = "group_topic"
TEMP_CATEGORY = "temp_category"
TWEET_COUNT = "tweet_count"
ACCOUNT_COUNT = "account_count"
TEMP_COUNTS = "temp_counts"
TEMP_PERCENTAGES = "temp_percentages"


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail while the plan is built, not halfway through a job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")
