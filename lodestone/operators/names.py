"""Hangul names and their spellings in Latin letters, matched by an index of spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters of a syllable's first consonant, vowel and last consonant by the Revised Romanisation, in the order of
# their code points, and in which other ways each is written.
FIRST = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWEL = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
LAST = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")
FIRST_ALSO = {"g": ("k",), "d": ("t",), "b": ("p",), "j": ("ch",), "r": ("l",), "s": ("sh",)}
VOWEL_ALSO = {"eo": ("u", "o"), "yeo": ("yu", "yo"), "eu": ("u",), "u": ("oo",), "ui": ("ee", "i"), "i": ("ee",), "oe": ("oi",), "wo": ("o",), "ae": ("e",), "o": ("oh",)}
LAST_ALSO = {"k": ("g",), "t": ("d",), "p": ("b",), "l": ("r",)}
#: The first syllable's code point; 21 vowels with 28 last consonants follow each first one.
BASE, SYLLABLES = 0xAC00, 11172


def _spelled(letters: tuple[str, ...], also: dict[str, tuple[str, ...]], at: Column) -> Column:
    return F.get(F.array(*(F.array(*(F.lit(s) for s in (x, *also.get(x, ())))) for x in letters)), at.cast("int"))


def _each(parts: Column, more: Column) -> Column:
    return F.flatten(F.transform(parts, lambda a: F.transform(more, lambda b: F.concat(a, b))))


def syllable(c: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a character is a Hangul syllable, and the numbers of its letters, by arithmetic on its code point."""
    code = F.ascii(c) - BASE
    return (code >= 0) & (code < SYLLABLES), F.floor(code / 588), F.floor(code % 588 / 28), code % 28


def spellings(c: Column, irregular: dict[str, list[str]] | None = None) -> Column:
    """An array of a syllable's spellings, the Revised Romanisation's first; what isn't Hangul is spelled as it is. irregular:
    further spellings of single syllables."""
    is_one, first, vowel, last = syllable(c)
    made = _each(_each(_spelled(FIRST, FIRST_ALSO, first), _spelled(VOWEL, VOWEL_ALSO, vowel)), _spelled(LAST, LAST_ALSO, last))
    if irregular:
        known = F.create_map(*(x for k, v in irregular.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
        made = F.array_union(made, F.coalesce(F.element_at(known, c), F.array().cast("array<string>")))
    return F.when(is_one, made).otherwise(F.array(F.lower(c)))


def romanised(c: Column) -> Column:
    """The name's first spelling, syllable by syllable."""
    return F.transform(F.split(c, ""), lambda x: F.get(spellings(x), F.lit(0)))


def letters_of(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z]", "")


def spelling_index(people: DataFrame, person: str, name: str, surnames: DataFrame, irregular: dict[str, list[str]] | None = None) -> DataFrame:
    """[X19] (person, key): a name's spellings as letters alone, given name and surname in either order. surnames: surname (of one
    or two syllables), spellings (array); the longest that begins the name and leaves a given name is its surname,
    and one that isn't listed, of one syllable, has its regular spellings. A name of one syllable or none has no key."""
    p = people.select(F.col(person).alias("person"), F.trim(F.col(name)).alias("name")).where(F.length("name") >= 2)
    known = surnames.groupBy("surname").agg(F.array_distinct(F.flatten(F.collect_list("spellings"))).alias("spelled"))
    two = known.where(F.length("surname") == 2).select(F.col("surname").alias("head2"), F.col("spelled").alias("two"))
    one = known.where(F.length("surname") == 1).select(F.col("surname").alias("head1"), F.col("spelled").alias("one"))
    p = p.withColumn("head1", F.substring("name", 1, 1)).withColumn("head2", F.when(F.length("name") >= 3, F.substring("name", 1, 2))).join(one, "head1", "left").join(two, "head2", "left")
    surname = F.coalesce("two", "one", spellings(F.col("head1"), irregular))
    given = F.when(F.col("two").isNotNull(), F.substring("name", 3, 1 << 20)).otherwise(F.substring("name", 2, 1 << 20))
    whole = F.aggregate(F.split(given, ""), F.array(F.lit("")), lambda made, c: _each(made, spellings(c, irregular)))
    x = p.select("person", surname.alias("s"), whole.alias("g"))
    return x.select("person", F.explode(F.array_distinct(F.transform(F.array_union(_each(F.col("g"), F.col("s")), _each(F.col("s"), F.col("g"))), letters_of))).alias("key")).where("key <> ''")


def matched(people: DataFrame, person: str, name: str, records: DataFrame, record: str, raw: str, surnames: DataFrame, irregular: dict[str, list[str]] | None = None) -> DataFrame:
    """[X19] (person, record): records whose name, letters alone, is one of the person's spellings. Initials are no spelling of a
    syllable with more letters, so a name with them matches nobody. Equal raw names are looked up once."""
    keys = records.select(letters_of(F.col(raw)).alias("key")).where("key <> ''").distinct()
    met = spelling_index(people, person, name, surnames, irregular).join(keys, "key")
    back = records.select(F.col(record).alias("record"), letters_of(F.col(raw)).alias("key"))
    return met.join(back, "key").select(F.col("person").alias(person), F.col("record").alias(record)).distinct()
