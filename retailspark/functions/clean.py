"""Cleaning rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
# The accepted newsletter settings, the age groups and the seasons.
NEWS_FREQUENCIES = ("NONE", "REGULARLY", "MONTHLY")
AGE_BUCKETS = ("under_20", "20s", "30s", "40s", "50s", "60_plus", "unknown")
SEASONS = ("spring", "summer", "autumn", "winter")
MAX_AGE = 120
ARTICLE_ID_DIGITS = 10
ITEM_NAME_LENGTH = 120

# The Unicode white space characters.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Each rule reads its column as few times as it can: Spark inlines the column's own expression.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DATE = r"^\s*\d{4}-\d{2}-\d{2}\s*$"
_SHORT_ID = rf"^\s*[0-9]{{1,{ARTICLE_ID_DIGITS - 1}}}\s*$"
_TRUE_WORDS = ("true", "yes", "y")
_FALSE_WORDS = ("false", "no", "n")

MAIN_CATEGORY_FIELDS = ("index_group_name", "index_name", "product_group_name")
CATEGORY_FIELDS = ("product_type_name", "product_group_name", "department_name")
COLOR_FIELDS = ("perceived_colour_master_name", "colour_group_name")
DOCUMENT_FIELDS = (
    "prod_name", "product_type_name", "graphical_appearance_name", "colour_group_name",
    "perceived_colour_value_name", "index_name", "department_name", "section_name",
    "garment_group_name", "detail_desc",
)
SHORT_DOCUMENT_FIELDS = ("prod_name", "product_type_name", "colour_group_name", "department_name")
NAME_FIELDS = ("prod_name", "product_name", "product_type_name", "detail_desc")
KEY_FIELDS = ("article_id", "product_code", "item_id")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """One blank for every run of white space, none at the ends; Unicode blanks count."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_text(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(squeeze(c)), F.lit(UNKNOWN))


def normalize_news_frequency(c: Column | str) -> Column:
    upper = F.upper(normalize_text(c))
    return F.when(upper.isin(*NEWS_FREQUENCIES), upper).otherwise(UNKNOWN)


def normalize_member_status(c: Column | str) -> Column:
    return F.upper(normalize_text(c))


def to_number(c: Column | str) -> Column:
    """Plain decimal or exponent text as double; anything else is NULL."""
    text = _col(c).cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_age(c: Column | str) -> Column:
    number = to_number(c)
    return F.when((number > -1) & (number < MAX_AGE + 1), number.cast("int")).otherwise(-1)


def age_bucket(c: Column | str) -> Column:
    age = _col(c)
    return (
        F.when(age.isNull() | (age < 0), "unknown")
        .when(age < 20, "under_20").when(age < 30, "20s").when(age < 40, "30s")
        .when(age < 50, "40s").when(age < 60, "50s").otherwise("60_plus")
    )


def first_known(*columns: Column | str) -> Column:
    known = [F.nullif(normalize_text(c), F.lit(UNKNOWN)) for c in columns]
    return F.coalesce(*known, F.lit(UNKNOWN))


def parse_date(c: Column | str) -> Column:
    """Date from ``yyyy-MM-dd`` text; anything else is NULL."""
    return F.when(_col(c).rlike(_DATE), _col(c).try_cast("date"))


def parse_price(c: Column | str) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def normalize_article_id(c: Column | str) -> Column:
    text = _col(c).cast("string")
    return F.when(text.rlike(_SHORT_ID), F.lpad(strip(text), ARTICLE_ID_DIGITS, "0")).otherwise(strip(text))


def season(c: Column | str) -> Column:
    month = F.month(_col(c))
    return (
        F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer")
        .when(month.between(9, 11), "autumn").when(month.isin(12, 1, 2), "winter").otherwise(UNKNOWN)
    )


def calendar_parts(c: Column | str) -> list[Column]:
    day = _col(c)
    return [
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.weekofyear(day).alias("week"),
        F.weekday(day).alias("day_of_week"),
    ]


def time_split(c: Column | str, last_day: Column, window_days: int = 14) -> Column:
    day = _col(c)
    return (
        F.when(day >= F.date_sub(last_day, window_days - 1), "test")
        .when(day >= F.date_sub(last_day, 2 * window_days - 1), "valid")
        .otherwise("train")
    )


def cross_features() -> list[Column]:
    pairs = {
        "age_category": ("age_bucket", "category"),
        "age_color": ("age_bucket", "color"),
        "member_category": ("club_member_status", "category"),
        "fashion_category": ("fashion_news_frequency", "category"),
    }
    return [F.concat_ws("_", left, right).alias(name) for name, (left, right) in pairs.items()]


def safe_numeric(c: Column | str, default: float = 0.0) -> Column:
    """Text, boolean or number as double; yes / no words count as 1 / 0."""
    word = F.lower(strip(_col(c).cast("string")))
    return (
        F.when(word.isin(*_TRUE_WORDS), 1.0)
        .when(word.isin(*_FALSE_WORDS), 0.0)
        .otherwise(F.coalesce(to_number(c), F.lit(float(default))))
    )


def categorical_token(c: Column | str, unknown: str = UNKNOWN) -> Column:
    return F.coalesce(blank_to_null(strip(_col(c).cast("string"))), F.lit(unknown))


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [blank_to_null(strip(F.col(n).cast("string"))) for n in names if n in df.columns]


def item_document(df: DataFrame, fields: Sequence[str] = DOCUMENT_FIELDS, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *_present(df, fields))


def short_item_document(df: DataFrame) -> Column:
    return F.coalesce(
        blank_to_null(F.concat_ws(" ", *_present(df, SHORT_DOCUMENT_FIELDS))), F.col("article_id")
    )


def item_name(df: DataFrame) -> Column:
    return F.substring(F.coalesce(*_present(df, NAME_FIELDS), F.lit("item")), 1, ITEM_NAME_LENGTH)


def item_key(df: DataFrame) -> Column:
    return F.coalesce(*_present(df, KEY_FIELDS), F.lit(""))


def parse_item_list(c: Column | str) -> Column:
    """Array from a list literal, else from text cut at pipes or commas."""
    text = strip(c)
    is_literal = text.rlike(r"^(\[.*\]|\(.*,.*\)|\{.*\})$")
    body = F.regexp_replace(F.substring(text, 2, 2_000_000_000), r",?\s*[\])}]$", "")
    literal = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
    pieces = F.when(text.contains("|"), F.split(text, r"\|")).otherwise(F.split(text, ","))
    items = F.when(is_literal & literal.isNotNull(), literal).otherwise(pieces)
    trimmed = F.transform(items, lambda x: strip(x))
    return F.coalesce(
        F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>")
    )


def parse_interest(c: Column | str) -> Column:
    """JSON object as category -> weight; anything else is NULL."""
    text = strip(c)
    return F.when(text.rlike(r"(?s)^\{.*\}$"), F.from_json(text, "map<string,double>"))
