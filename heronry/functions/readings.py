"""Numbers, times, dates and features of sentences as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words of several languages (fixed values).
NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "a dozen": 12, "twenty": 20,
    "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "doce": 12, "veinte": 20,
    "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "zwanzig": 20,
}
NUMBER = "(" + "|".join(sorted(NUMBERS, key=lambda w: (-len(w), w))) + "|[0-9]+)"
RANGE = rf"(?:between|from|entre|zwischen) {NUMBER} (?:and|to|y|und) {NUMBER}(?:[^a-z0-9]|$)"
#: Metres of a unit (fixed values).
UNIT_METRES = {"ft": 0.3048, "nm": 1852.0, "km": 1000.0, "mi": 1609.344}
#: Months by their names (fixed values).
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
YESTERDAY = "yesterday|last night|ayer|anoche|gestern|letzte nacht"
AGO = r"(?:vor ([0-9]+) tagen|([0-9]+) days ago|hace ([0-9]+) días)"
NAMED_DAY = r"([0-9]{1,2})\.?(?: de)? (\p{L}+)"
#: Latin letters of Cyrillic ones that take several (fixed values).
CYRILLIC_MANY = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "yo", "є": "ye", "ї": "yi"}
CYRILLIC, LATIN = "абвгдезийклмнопрстуфыэіґьъ", "abvgdeziyklmnoprstufyeig"  # the last two are dropped


def number_of(word: Column) -> Column:
    """A number word or digits as an integer."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair)), word), F.try_to_number(F.nullif(F.regexp_extract(word, "^[0-9]{1,9}$", 0), F.lit("")), F.lit("999999999")).cast("int"))


def number_range(text: Column) -> Column:
    """Struct (low, high) of the first range in a text, or of its first number."""
    low = F.lower(text)
    a, b = (F.regexp_extract(low, RANGE, k) for k in (1, 2))
    one = F.regexp_extract(low, rf"(?:^|[^a-z0-9]){NUMBER}(?:[^a-z0-9]|$)", 1)
    return F.struct(number_of(F.when(a != "", a).otherwise(one)).alias("low"), number_of(F.when(a != "", b).otherwise(one)).alias("high"))


def clock_minutes(text: Column) -> Column:
    """Array of the clock times of a text, in minutes after midnight."""
    found = F.regexp_extract_all(text, F.lit("[0-9]{1,2}[:.][0-9]{2}|[0-9]{1,2} (?:am|pm)"), F.lit(0))

    def minutes(x: Column) -> Column:
        hour = F.regexp_extract(x, "^[0-9]+", 0).cast("int")
        half = (hour % 12 + F.when(x.endswith("pm"), 12).otherwise(0)) * 60
        return F.when(x.rlike("[ap]m"), half).otherwise(hour * 60 + F.regexp_extract(x, "[0-9]{2}$", 0).try_cast("int"))

    return F.transform(found, minutes)


def duration_minutes(text: Column) -> Column:
    """Hours and minutes that a text says something lasted."""
    n = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    hours, minutes = n("([0-9]+) hours?"), n("([0-9]+) min")
    return F.when(hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))


def dates_in(text: Column, told: Column) -> Column:
    """The day that a sentence means, seen from the day it was told."""
    low = F.lower(text)
    ago = F.coalesce(*(F.nullif(F.regexp_extract(low, AGO, k), F.lit("")) for k in (1, 2, 3))).cast("int")
    month = F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.regexp_extract(low, NAMED_DAY, 2))
    day = F.nullif(F.regexp_extract(low, NAMED_DAY, 1), F.lit(""))
    named = F.to_date(F.try_to_timestamp(F.concat_ws("-", F.year(told), F.coalesce(month, F.lit(0)), day), F.lit("yyyy-M-d")))
    return F.when(low.rlike(YESTERDAY), F.date_sub(told, 1)).when(ago.isNotNull(), F.date_sub(told, ago)).when(named > told, F.add_months(named, -12)).otherwise(named)


def features_in(text: Column, features: list[str], negations: list[str], reach: int = 3) -> Column:
    """Array of structs (feature, negated): a feature is negated if a word of negation stands at most `reach` words before it."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))

    def read(word: Column, place: Column) -> Column:
        first = F.greatest(F.lit(1), place + 1 - reach)
        before = F.slice(words, first, place + 1 - first)
        return F.struct(word.alias("feature"), (F.size(F.array_intersect(before, F.array(*map(F.lit, negations)))) > 0).alias("negated"))

    return F.filter(F.transform(words, read), lambda x: x["feature"].isin(*features))


def transliterated(text: Column) -> Column:
    """Cyrillic letters, lower case, in Latin ones."""
    many = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), CYRILLIC_MANY.items(), F.lower(text))
    return F.translate(many, CYRILLIC, LATIN)
