"""Column functions on item names, dates and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by number, English function words, characters dropped from questions.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
STOP_WORDS = ["a", "an", "and", "are", "by", "did", "do", "does", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with"]
DROPPED = ",!?.'\":’{}"

_TIMESTAMP = '^"?[0-9]{4}-[0-9]{2}-[0-9]{2}T00:00:00Z"?$'


def is_entity(x: Column) -> Column:
    return x.rlike("^Q[0-9]+$")


def is_predicate(x: Column) -> Column:
    return x.rlike("^P[0-9]+$")


def is_timestamp(x: Column) -> Column:
    return F.trim(x).rlike(_TIMESTAMP)


def is_year(x: Column) -> Column:
    return F.trim(x).rlike("^[0-9]{4}$")


def is_date(x: Column) -> Column:
    return F.trim(x).rlike("^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$")


def year_of(timestamp: Column) -> Column:
    return F.substring_index(F.regexp_replace(timestamp, '"', ""), "-", 1)


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), number.cast("int"))


def month_number(name: Column) -> Column:
    return F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("string"), 2, "0")


def timestamp_label(x: Column, strip_quotes: bool = True) -> Column:
    """`15 July 2018`, only the year for the first of January."""
    bare = F.regexp_replace(x, '"', "")
    year = F.substring(bare, 1, 4) if strip_quotes else F.concat(F.when(x.startswith('"'), '"').otherwise(""), F.substring(bare, 1, 4))
    month, day = F.substring(bare, 6, 2), F.substring(bare, 9, 2)
    return F.when((month == "01") & (day == "01"), year).otherwise(F.concat_ws(" ", day.cast("int").cast("string"), month_name(month), year))


def year_to_timestamp(x: Column) -> Column:
    return F.concat(F.trim(x), F.lit("-01-01T00:00:00Z"))


def date_to_timestamp(x: Column) -> Column:
    parts = F.split(F.trim(x), " ")
    return F.concat(parts[2], F.lit("-"), month_number(parts[1]), F.lit("-"), F.lpad(parts[0], 2, "0"), F.lit("T00:00:00Z"))


def single_label(item: Column, labels: Column) -> Column:
    """C4: the first label that is no item name itself."""
    some = F.when(F.size(labels) > 0, labels).otherwise(F.array(item))
    return F.coalesce(F.get(F.filter(some, lambda x: ~x.rlike("^[QP][0-9]+$")), F.lit(0)), F.get(some, F.lit(0)))


def plain_words(question: Column) -> Column:
    """D1 (2)-(7): lower-cased words without punctuation and function words."""
    words = F.split(F.trim(F.lower(F.translate(question, DROPPED, ""))), " +")
    return F.filter(words, lambda w: ~w.isin([*STOP_WORDS, "", "s"]))


def tokens(text: Column) -> Column:
    """The tokens of BM25: commas dropped, case kept."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, ",", "")), r"\s+"), lambda w: ~w.isin([*STOP_WORDS, ""]))
