"""Hangul names against spellings, and ego hypergraphs, by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.functions import places
from lodestone.operators import career, names

SURNAMES = [("이", ["lee", "yi", "rhee", "rhie", "li", "ri", "ree"]), ("김", ["kim", "gim"]), ("정", ["jung", "jeong", "chung"]), ("최", ["choi", "choe"]), ("박", ["park", "pak"]), ("남", ["nam"]), ("남궁", ["namgung", "namkung"])]
CASES = [
    ("이진호", "Jinho Lee", True), ("이진호", "Jin-Ho Lee", True), ("이진호", "Lee Jinho", True), ("이진호", "J. Lee", False), ("이미진", "Mi Jin Lee", True), ("이미진", "Min Ji Lee", False), ("김성훈", "Sunghoon Kim", True),
    ("김성훈", "Sung-Hoon Kim", True), ("정희", "Hee Jung", True), ("최정희", "Jeong-Hui Choi", True), ("박병규", "Byung Kyu Park", True), ("박병규", "Byeong Gyu Park", True), ("이상훈", "Sangmin Lee", False), ("이상훈", "", False), ("이상훈", None, False),
    ("남궁민", "Min Namgung", True), ("남궁민", "Nam Gungmin", True), ("남민", "Nam Min", True), ("이", "Lee", False), (None, "Lee", False), ("김영수", "Young Soo Kim", True), ("김Ho", "Ho Kim", True), ("서준", "Jun Seo", True),
]


def test_strict_matches(spark):
    people = spark.createDataFrame([(k, n) for k, (n, _, _) in enumerate(CASES)], "person long, name string")
    records = spark.createDataFrame([(k, r) for k, (_, r, _) in enumerate(CASES)], "record long, raw string")
    known = spark.createDataFrame(SURNAMES, "surname string, spellings array<string>")
    met = {tuple(r) for r in names.matched(people, "person", "name", records, "record", "raw", known, {"영": ["young"]}).collect()}
    assert {k for k in range(len(CASES)) if (k, k) in met} == {k for k, (*_, ok) in enumerate(CASES) if ok}


def test_all_syllables_are_taken_apart(spark):
    """By the order of the letters, all 11,172 of them."""
    own = [a + b + c for a, b, c in itertools.product(names.FIRST, names.VOWEL, names.LAST)]
    rows = spark.createDataFrame([(chr(0xAC00 + k), first) for k, first in enumerate(own)], "c string, first string")
    assert rows.where(F.get(names.spellings(F.col("c")), F.lit(0)) != F.col("first")).count() == 0
    assert {r[0] for r in spark.createDataFrame([("가",), ("a",), ("힣",)], "c string").select(names.syllable(F.col("c"))[0]).collect()} == {True, False}


def test_ego_hypergraph(spark):
    spell = "person string, stage string, unit string, start long, end long"
    spells = spark.createDataFrame([("me", "doctoral", "u", 10, 20), ("a", "doctoral", "u", 5, 12), ("a", "doctoral", "u", 18, 30), ("b", "faculty", "u", 20, 25), ("c", "postdoc", "u", 10, 20), ("d", "doctoral", "v", 10, 20), ("a", "faculty", "w", 1, 3)], spell)
    ego = spark.createDataFrame([("me", "doctoral", "u", 10, 20), ("me", "first_faculty", "w", 2, 9), ("me", "postdoc", "z", 1, 2)], spell.replace("person", "ego"))
    got = {r["unit"]: r for r in career.ego_hypergraph(ego, spells).collect()}
    assert set(got) == {"u", "w"} and got["u"]["members"] == ["a", "b", "me"] and got["w"]["members"] == ["a", "me"]
    assert [tuple(e) for e in got["u"]["evidence"]] == [("a", "doctoral", 10, 12, 3), ("a", "doctoral", 18, 20, 3), ("b", "faculty", 20, 20, 1)]
    assert got["u"]["redundancy"] == pytest.approx(2 / 3) and got["u"]["weight"] == pytest.approx(3 / 2 / (1 + 2 / 3))


def test_places(spark):
    rows = [("Korea, Republic of.", "KR"), (" ＵＳＡ ", "US"), ("u.k.", None), ("kr", "KR"), ("Zz", None), ("Brazil", None), ("미국", "US"), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "raw string, code string")
    assert [r["got"] for r in df.select(places.country(F.col("raw"), places.codes(spark)).alias("got")).collect()] == [c for _, c in rows]
    assert {"KR", "US", "DE"} <= set(places.codes(spark)) and all(len(c) == 2 for c in places.codes(spark))
    wanted = [("U.S.A.", "us"), ("Scotland", "europe"), ("cn", "japan-china"), ("Korea, Republic of", "domestic"), ("turkey", "foreign"), ("somewhere", "unknown"), (None, "unknown")]
    df = spark.createDataFrame(wanted, "raw string, region string")
    assert [r["got"] for r in df.select(places.region(F.col("raw")).alias("got")).collect()] == [x for _, x in wanted]
    names_ = [(" Seoul  Nat. Univ ", "seoul nat univ"), ("12.0", None), ("N/A", None), ("알 수 없음", None), (None, None)]
    df = spark.createDataFrame(names_, "raw string, name string")
    assert [r["got"] for r in df.select(places.institution(F.col("raw")).alias("got")).collect()] == [x for _, x in names_]
