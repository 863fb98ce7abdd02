"""Scalar functions over documents, pages, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import places, text
from lodestone.operators import names
from lodestone.plans.registry import query
from lodestone.sources.tables import content_hash, table


@query("SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +')), lambda x: x <> '')), ' ') AS tokens FROM documents")
def text_token_sets(spark, d):
    """[X18]"""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.token_set(F.col("text")), " ").alias("tokens"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid, upper(trim(event_type)) || ':' || greatest(event_id % 7, 3)::VARCHAR AS tag FROM events")
def text_json(spark, d):
    """[X1, X2, D14]"""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("valid"), F.concat(F.upper(F.trim("event_type")), F.lit(":"), F.greatest(F.col("event_id") % 7, F.lit(3)).cast("string")).alias("tag"))


@query("SELECT user_id, to_json(list_sort(list_distinct(list(event_type))))::VARCHAR AS kinds FROM events GROUP BY 1")
def text_json_array(spark, d):
    """[A39]"""
    return table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("kinds"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('The ' || p_name || ' University (' || p_brand || ')'), '\\([^)]*\\)', ' ', 'g'), '\\b(the|of|at|university|univ|college|institute|school)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM part
""")
def text_institution_key(spark, d):
    """[X5, X6]"""
    return table(spark, d, "part").select("p_partkey", text.institution_key(F.concat(F.lit("The "), "p_name", F.lit(" University ("), "p_brand", F.lit(")"))).alias("key"))


@query("""
SELECT c_custkey, CASE WHEN a IS NULL AND b IS NULL THEN 'unresolved' WHEN a <> b THEN 'conflict' WHEN coalesce(a, b) = 'BUILDING' THEN 'domestic' ELSE 'foreign' END AS origin
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' END AS b FROM customer)
""")
def text_origin(spark, d):
    """[X9, X10]"""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", text.origin(F.when(k % 5 > 0, F.col("c_mktsegment")), F.when(k % 3 == 0, F.lit("BUILDING")), "BUILDING").alias("origin"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 2 THEN 'low' WHEN v < 5 THEN 'medium' ELSE 'high' END AS band FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity / 9 END AS v FROM lineitem)")
def text_bands(spark, d):
    """[X12]"""
    from lodestone.operators.yearly import band

    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), band(F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 9)).alias("band"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'W' || o_orderkey::VARCHAR END AS work, CASE WHEN o_orderkey % 2 = 0 THEN '10.1234/ab' || o_orderkey::VARCHAR END AS doi FROM orders
""")
def text_ids(spark, d):
    """[X14, J26] From URLs, short forms and digits."""
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("X"), k)).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://works.example/W"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" w"), k)).otherwise(k)
    doi = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.1234/AB"), k)).otherwise(F.concat(F.lit("no-doi/"), k))
    return table(spark, d, "orders").select("o_orderkey", text.work_id(raw).alias("work"), text.doi(doi).alias("doi"))


@query("SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey::VARCHAR || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS hash FROM orders")
def text_content_hash(spark, d):
    """[S14, X32]"""
    return table(spark, d, "orders").select("o_orderkey", content_hash(F.col("o_custkey"), F.col("o_orderstatus")).alias("hash"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<style\\b.*?</style>', ' ', 'g'), '(?s)<script\\b.*?</script>', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM pages")
def text_without_markup(spark, d):
    """[X17]"""
    return table(spark, d, "pages").select("page_id", text.without_markup(F.col("html")).alias("plain"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, coalesce(length(text), 0)::BIGINT AS chars FROM conversations")
def text_turns(spark, d):
    """[W6]"""
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


@query()
def text_keyed_ids(spark, d):
    """[X3]"""
    return table(spark, d, "customer").select("c_custkey", text.keyed_id(F.col("c_name"), "salt").alias("public_id"))


@query()
def text_nfkc(spark, d):
    """[X4]"""
    return table(spark, d, "documents").select("doc_id", F.length(text.nfkc(F.col("text"))).alias("chars"))


# Surnames and their spellings, a few of each length.
SURNAMES = {"김": ["kim", "gim"], "이": ["lee", "yi", "rhee"], "박": ["park", "pak"], "최": ["choi", "choe"], "정": ["jung", "jeong", "chung"], "남": ["nam"], "남궁": ["namgung", "namkung"]}


def _sql_lists(letters, also) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{s}'" for s in (x, *also.get(x, ()))) + "]" for x in letters) + "]"


_NAMES = f"""
WITH c AS (SELECT c_custkey AS person, ['김', '이', '박', '최', '정', '남궁', '남'][c_custkey % 7 + 1] AS surname, 44032 + (c_custkey * 37) % 11172 AS g1, 44032 + (c_custkey * 7919) % 11172 AS g2 FROM customer),
spell AS (SELECT unnest([{", ".join("{'surname': '" + k + "', 's': [" + ", ".join(f"'{x}'" for x in v) + "]}" for k, v in SURNAMES.items())}], recursive := true)),
l AS (SELECT {_sql_lists(names.FIRST, names.FIRST_ALSO)} AS f, {_sql_lists(names.VOWEL, names.VOWEL_ALSO)} AS v, {_sql_lists(names.LAST, names.LAST_ALSO)} AS z),
syl AS (SELECT code, flatten(list_transform(f[(code - 44032) // 588 + 1], lambda a: flatten(list_transform(v[(code - 44032) % 588 // 28 + 1], lambda b: list_transform(z[(code - 44032) % 28 + 1], lambda e: a || b || e))))) AS s FROM l, (SELECT g1 AS code FROM c UNION SELECT g2 FROM c)),
"""


@query(
    _NAMES
    + """r AS (SELECT person AS record, CASE person % 4 WHEN 0 THEN x.s[1] || y.s[1] || p.s[1] WHEN 1 THEN p.s[len(p.s)] || x.s[len(x.s)] || y.s[1] WHEN 2 THEN left(x.s[1], 1) || p.s[1] ELSE x.s[1] || y.s[1] END AS key
 FROM c JOIN spell p USING (surname) JOIN syl x ON x.code = g1 JOIN syl y ON y.code = g2),
i AS (SELECT DISTINCT person, unnest(flatten(list_transform(flatten(list_transform(x.s, lambda a: list_transform(y.s, lambda b: a || b))), lambda g: flatten(list_transform(p.s, lambda n: [g || n, n || g]))))) AS key FROM c JOIN spell p USING (surname) JOIN syl x ON x.code = g1 JOIN syl y ON y.code = g2)
SELECT DISTINCT person, record FROM i JOIN r USING (key) WHERE key <> ''"""
)
def names_matched(spark, d):
    """[X19] Customers with names in Hangul, and records of them: two spellings, initials, and one without a surname."""
    surname = F.get(F.array(*(F.lit(x) for x in ("김", "이", "박", "최", "정", "남궁", "남"))), (F.col("c_custkey") % 7).cast("int"))
    # decode, as char() has no letters beyond 255: a syllable's three bytes of UTF-8
    code = lambda k: F.col("c_custkey") * k % names.SYLLABLES + names.BASE
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    glyph = lambda c: F.decode(F.unhex(F.concat(byte(224 + F.floor(c / 4096)), byte(128 + F.floor(c / 64) % 64), byte(128 + c % 64))), "UTF-8")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), surname.alias("surname"), glyph(code(37)).alias("g1"), glyph(code(7919)).alias("g2"))
    known = spark.createDataFrame(list(SURNAMES.items()), "surname string, spellings array<string>")
    x, y, s = names.spellings(F.col("g1")), names.spellings(F.col("g2")), F.col("spellings")
    at = lambda a, k: F.initcap(F.element_at(a, k))
    kind = F.col("person") % 4
    raw = (
        F.when(kind == 0, F.concat_ws(" ", F.concat_ws("-", at(x, 1), at(y, 1)), at(s, 1)))
        .when(kind == 1, F.concat(at(s, -1), F.lit(", "), at(x, -1), F.lit(" "), at(y, 1)))
        .when(kind == 2, F.concat(F.substring(at(x, 1), 1, 1), F.lit(". "), at(s, 1)))
        .otherwise(F.concat_ws(" ", at(x, 1), at(y, 1)))
    )
    records = people.join(known, "surname").select(F.col("person").alias("record"), raw.alias("raw"))
    return names.matched(people.withColumn("name", F.concat("surname", "g1", "g2")), "person", "name", records, "record", "raw", known)


def _sql_names(table) -> str:
    return "SELECT unnest([" + ", ".join("{'name': '" + k.replace("'", "''") + "', 'value': '" + v + "'}" for v, keys in table.items() for k in keys.split("|")) + "], recursive := true)"


@query(f"""
WITH cn AS ({_sql_names(places.COUNTRY_NAMES)}), rn AS ({_sql_names(places.REGION_NAMES)}),
s AS (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '  ' || lower(n_name) || '.' WHEN 1 THEN n_name WHEN 2 THEN ['kr', 'US', 'zz', 'de', ' Tr ', 'J.P.', 'ｋｒ'][s_suppkey // 7 % 7 + 1] WHEN 3 THEN 'Republic  of Korea' WHEN 4 THEN '영국' WHEN 5 THEN 'Korea, Republic of' ELSE n_name || ' x' END AS raw
 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
v AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(raw), 'ｋｒ', 'kr'), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS a, replace(trim(regexp_replace(replace(lower(raw), 'ｋｒ', 'kr'), '\\s+', ' ', 'g')), '.', '') AS b FROM s)
SELECT s_suppkey, raw, CASE WHEN a IN ('kr', 'us', 'de', 'tr') THEN upper(a) ELSE cn.value END AS code, coalesce(rn.value, 'unknown') AS region FROM v LEFT JOIN cn ON cn.name = a LEFT JOIN rn ON rn.name = b
""")
def text_countries(spark, d):
    """[X9] Suppliers' nations, written in several ways."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k = F.col("s_suppkey") % 7
    short = F.get(F.array(*(F.lit(x) for x in ("kr", "US", "zz", "de", " Tr ", "J.P.", "ｋｒ"))), (F.floor(F.col("s_suppkey") / 7) % 7).cast("int"))
    raw = F.when(k == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit("."))).when(k == 1, F.col("n_name")).when(k == 2, short).when(k == 3, "Republic  of Korea").when(k == 4, "영국").when(k == 5, "Korea, Republic of").otherwise(F.concat("n_name", F.lit(" x")))
    s = table(spark, d, "supplier").join(n, "s_nationkey").select("s_suppkey", raw.alias("raw"))
    return s.select("s_suppkey", "raw", places.country(F.col("raw"), places.codes(spark)).alias("code"), places.region(F.col("raw")).alias("region"))


@query("""
WITH v AS (SELECT page_id, trim(regexp_replace(regexp_replace(lower(coalesce(regexp_extract(url, '//([^/?#]*)', 1), '')), '[.,·]', ' ', 'g'), '\\s+', ' ', 'g')) AS a, CASE page_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '12 3.0' WHEN 2 THEN ' — ' END AS other FROM pages)
SELECT page_id, CASE WHEN other IS NULL THEN nullif(a, '') END AS institution FROM v
""")
def text_institution(spark, d):
    """[X7] Hosts as names of institutions, some of them missing."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "//([^/?#]*)", 1)
    k = F.col("page_id") % 5
    raw = F.when(k == 0, "N/A").when(k == 1, "12 3.0").when(k == 2, " — ").otherwise(host)
    return table(spark, d, "pages").select("page_id", places.institution(raw).alias("institution"))
