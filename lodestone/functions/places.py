"""Countries, regions and institutions by their many names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# How countries are also written, by code.
COUNTRY_NAMES = {
    "KR": "korea|south korea|republic of korea|korea republic of|kor|한국|대한민국", "US": "united states|united states of america|usa|america|미국", "GB": "united kingdom|uk|britain|england|gbr|영국",
    "JP": "japan|jpn|일본", "DE": "germany|deu|독일", "IN": "india|ind|인도", "CA": "canada|can|캐나다", "FR": "france|fra|프랑스", "SE": "sweden|swe|스웨덴", "AU": "australia|aus|호주", "NL": "netherlands|nld|네덜란드",
    "IL": "israel|isr|이스라엘", "AT": "austria|aut", "IT": "italy|ita|이탈리아", "PL": "poland|pol", "ES": "spain|esp", "RU": "russia|rus|러시아", "CH": "switzerland|che|스위스", "RS": "serbia|srb", "CN": "china|chn|중국",
    "BE": "belgium|bel", "NO": "norway|nor", "NZ": "new zealand|nzl|뉴질랜드", "HU": "hungary|hun", "UZ": "uzbekistan|uzb", "HK": "hong kong|hkg|홍콩", "TW": "taiwan|taipei|twn|대만", "SG": "singapore|sgp|싱가포르",
}
# Regions by the codes and the names of their countries.
REGION_NAMES = {
    "domestic": "kr|kor|korea|south korea|republic of korea|korea, republic of|한국|대한민국",
    "us": "us|usa|united states|united states of america|미국",
    "japan-china": "jp|cn|japan|china|people's republic of china|일본|중국",
    "europe": "gb|uk|de|fr|ch|nl|it|es|at|se|no|dk|fi|be|ie|pl|pt|gr|cz|hu|ro|bg|hr|si|sk|ee|lv|lt|is|lu|mt|united kingdom|england|scotland|wales|germany|france|switzerland|netherlands|italy|spain|austria|sweden|norway|denmark|finland|belgium"
    "|ireland|poland|portugal|greece|czech republic|czechia|hungary|romania|bulgaria|croatia|slovenia|slovakia|estonia|latvia|lithuania|iceland|luxembourg|malta|영국|독일|프랑스|스위스|네덜란드|이탈리아|스웨덴",
    "foreign": "ca|au|in|il|nz|tw|hk|sg|ru|pk|bd|lk|np|vn|th|my|id|ph|br|mx|ar|cl|co|pe|za|eg|ng|ke|et|ir|iq|tr|sa|ae|qa|lb|jo|kz|uz|mn|cy|australia|canada|india|israel|new zealand|taiwan|hong kong|singapore|russia|russian federation|pakistan"
    "|bangladesh|sri lanka|nepal|vietnam|thailand|malaysia|indonesia|philippines|brazil|mexico|argentina|chile|colombia|peru|south africa|egypt|nigeria|kenya|ethiopia|iran|iraq|turkey|türkiye|saudi arabia|united arab emirates|qatar|lebanon"
    "|jordan|kazakhstan|uzbekistan|mongolia|cyprus|호주|오스트레일리아|캐나다|인도|이스라엘|뉴질랜드|대만|홍콩|싱가포르|러시아|브라질|기타해외|기타 해외",
}
# What stands for no institution.
NO_INSTITUTION = ("", "-", "—", "na", "n/a", "n a", "nan", "none", "null", "unknown", "not available", "미상", "알수없음", "알 수 없음", "정보없음", "정보 없음", "없음", "불명")

#: The full-width forms of ASCII, which are as far from it throughout.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def plain(c: Column, blanks: str = "") -> Column:
    """Lower case, full-width forms as ASCII, ``blanks`` and white space as one blank, none at the ends."""
    narrow = F.lower(F.translate(c, _WIDE, _NARROW))
    return F.trim(F.regexp_replace(F.regexp_replace(narrow, f"[{blanks}]", " ") if blanks else narrow, r"[\s\x{00A0}]+", " "))


def _table(names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for value, keys in names.items() for key in keys.split("|") for x in (key, value)))


def codes(spark: SparkSession) -> list[str]:
    """ISO 3166's two letters, as the JVM has them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def country(c: Column, known: list[str]) -> Column:
    """[X9] The code: of ``known`` ones themselves in any case, of names by the table; of anything else none."""
    value = plain(c, ".,")
    return F.when(F.upper(value).isin(known), F.upper(value)).otherwise(F.try_element_at(_table(COUNTRY_NAMES), value))


def region(c: Column) -> Column:
    """[X9] domestic, us, japan-china, europe, foreign; unknown for values that name no country of the table, and none."""
    value = F.regexp_replace(F.regexp_replace(plain(c), "[–—]", "-"), "[.]", "")
    return F.coalesce(F.try_element_at(_table(REGION_NAMES), value), F.lit("unknown"))


def institution(c: Column) -> Column:
    """[X7] One form of a name's spellings; null for numbers and for what stands for none. Schools aren't guessed."""
    value = plain(c, ".,·")
    return F.when(~c.rlike(r"^[\d\s.]+$") & ~value.isin(*NO_INSTITUTION), value)
