"""Text and identifier functions as columns; Python only where Spark has no such function."""

from __future__ import annotations

import base64
import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Words that names of institutions share.
STOP = ("the", "of", "at", "university", "univ", "college", "institute", "school")


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """[X4] NFKC, case folded."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def normalised(c: Column) -> Column:
    """[X4] ASCII form: trimmed, lower case, one blank between words."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def keyed_id(c: Column, salt: str, prefix: str = "P-") -> Column:
    """[X3] HMAC-SHA256, base32, ten characters."""

    @pandas_udf(StringType())
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else prefix + base64.b32encode(hmac.new(salt.encode(), v.encode(), hashlib.sha256).digest()).decode()[:10])

    return of(c.cast("string"))


def institution_key(c: Column) -> Column:
    """[X5, X6] Letters and digits of the distinctive words."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    bare = F.regexp_replace(plain, r"\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(bare, rf"\b({'|'.join(STOP)})\b", " "), "[^a-z0-9]+", "")


def same_institution(a: Column, b: Column) -> Column:
    """[X6] Equal keys, or keys of four letters or more of which one holds the other."""
    x, y = institution_key(a), institution_key(b)
    return (x == y) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (x.contains(y) | y.contains(x)))


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """[X7-X9] A small fixed map; else the default or the value itself."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, c), default if default is not None else c)


def origin(a: Column, b: Column, home: str) -> Column:
    """[X10] domestic, foreign, conflict or unresolved, from two sources."""
    return F.when(a.isNull() & b.isNull(), "unresolved").when(a.isNotNull() & b.isNotNull() & (a != b), "conflict").when(F.coalesce(a, b) == home, "domestic").otherwise("foreign")


def department(c: Column) -> Column:
    """[X11] The one formal unit that a text names, else null."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:Department|School|Division|Faculty) of [A-Z][a-z]+(?: (?:and )?[A-Z][a-z]+)*)"), F.lit(1)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def work_id(c: Column) -> Column:
    """[X14, J26] "W" and digits, from a URL, a short form or digits alone."""
    digits = F.regexp_extract(F.trim(c.cast("string")), r"(?i)^(?:https?://[^/]+/)?w?(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("W"), digits))


def doi(c: Column) -> Column:
    """[X14]"""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def orcid(c: Column) -> Column:
    """[X14] With a right ISO 7064 mod 11-2 check character, else null."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^https?://orcid\.org/", ""), "-", ""))
    digits = F.split(F.substring(bare, 1, 15), "")
    total = F.aggregate(digits, F.lit(0), lambda acc, d: (acc + F.coalesce(d.try_cast("int"), F.lit(0))) * 2 % 11)
    check = (F.lit(12) - total) % 11
    right = F.substring(bare, 16, 1) == F.when(check == 10, "X").otherwise(check.cast("string"))
    dashed = F.concat_ws("-", *(F.substring(bare, k, 4) for k in (1, 5, 9, 13)))
    return F.when(bare.rlike(r"^\d{15}[\dX]$") & right, dashed)


def canonical_url(c: Column, hosts: tuple[str, ...], keep: str) -> Column:
    """[X15] The parameter ``keep`` of an https URL of an allowed host (".name" allows all hosts below it), else null."""
    host = F.lower(F.regexp_extract(c, r"^https://([^/?#:]+)(?::443)?(?:[/?#]|$)", 1))
    value = F.regexp_extract(c, rf"[?&]{keep}=([^&#]+)", 1)
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host.endswith(h) if h.startswith(".") else host == h)
    return F.when(allowed & (value != ""), value)


def inverted_to_text(index: Column) -> Column:
    """[X16] Map of word to positions, to the text."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def without_markup(c: Column) -> Column:
    """[X17]"""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^<>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def token_set(c: Column) -> Column:
    """[X18] Distinct words of letters a-z and digits, sorted."""
    return F.array_sort(F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +")), ""))


def singular(c: Column) -> Column:
    """[X21] English plural endings off a phrase's last word."""
    return F.when(c.rlike("ies$") & (F.length(c) > 4), F.regexp_replace(c, "ies$", "y")).when(c.rlike("(ss|sh|ch|x)es$"), F.regexp_replace(c, "es$", "")).when(c.rlike("[^s]s$") & (F.length(c) > 3), F.regexp_replace(c, "s$", "")).otherwise(c)


def stem(c: Column, letters: int = 7) -> Column:
    """[X29]"""
    return F.substring(singular(F.lower(c)), 1, letters)


def json_list_with(c: Column, item: Column) -> Column:
    """[X2] A JSON list of texts with one more; what is no list counts as empty."""
    return F.to_json(F.array_append(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), item))
