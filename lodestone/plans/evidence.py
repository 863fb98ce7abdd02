"""Further gates, folds and career steps over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.periods import half_of
from lodestone.operators import career, gates, graph, intervals, linkage, titles, yearly
from lodestone.plans.registry import query
from lodestone.sources.tables import table

year = lambda c: F.year(c).cast("long")


@query("SELECT s.l_suppkey, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM (SELECT l_suppkey, unnest(list(DISTINCT l_partkey)) AS pk FROM lineitem GROUP BY 1) s JOIN part ON pk = p_partkey WHERE p_size < 20 GROUP BY 1")
def join_lateral(spark, d):
    """[J10]"""
    ids = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("ids"))
    p = table(spark, d, "part").where("p_size < 20").select("p_partkey", "p_retailprice")
    return ids.select("l_suppkey", F.explode("ids").alias("p_partkey")).join(p, "p_partkey").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("SELECT c_mktsegment, year(o_orderdate)::BIGINT AS year, count(*) AS n, NULL::DOUBLE AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def yearly_nested_sum(spark, d):
    """[A7]"""
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    nested = y.groupBy("c_custkey").agg(F.collect_list(F.struct("year", "n")).alias("yearly")).join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return yearly.summed_years(nested, "c_custkey", "yearly", ["c_mktsegment"])


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 24")
def tags_cloud(spark, d):
    """[A36]"""
    return yearly.tag_cloud(table(spark, d, "part").select(F.split("p_name", " ").alias("tags")), "tags", 24)


@query("SELECT p_brand, coalesce(CASE WHEN year(l_shipdate) > 1996 THEN year(l_shipdate) END::VARCHAR, 'unplaced') AS era, count(*) AS n, sum(l_linenumber)::BIGINT AS cited FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def cells_counts(spark, d):
    """[A37]"""
    l = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.when(F.year("l_shipdate") > 1996, F.year("l_shipdate")).alias("era"))
    return yearly.cells(l.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"), "p_brand", "era", "l_linenumber")


@query("""
WITH c AS (SELECT c_nationkey::BIGINT AS community, o_custkey, year(o_orderdate) AS y, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT community, count(*) AS size FROM c GROUP BY 1),
l AS (SELECT community, label, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, label) AS r FROM c GROUP BY 1, 2)
SELECT c.community, count(*) AS size, count(DISTINCT o_custkey) AS people, quantile_cont(y, 0.5) AS median_year, min(y)::INTEGER AS first_year, max(y)::INTEGER AS last_year,
 (SELECT string_agg(label || ' ' || round(100 * n / size)::BIGINT::VARCHAR || '%', ', ' ORDER BY r) FROM l JOIN s USING (community) WHERE r <= 2 AND l.community = c.community) AS labels FROM c GROUP BY 1
""")
def community_summary(spark, d):
    """[A24, R8]"""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("community"))
    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("label")).join(c, "o_custkey")
    return yearly.community_summary(rows, "community", "o_custkey", "y", "label", 2)


@query("SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 6) AS place FROM orders")
def rank_relative(spark, d):
    """[W16]"""
    return intervals.relative_rank(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_orderkey", F.round("place", 6).alias("place"))


@query("""
WITH RECURSIVE h AS (SELECT o_custkey, o_orderkey, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::BIGINT AS s, o_orderkey % 3 AS n FROM orders),
w AS (SELECT *, s + n AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY s, s + n, o_orderkey) AS k FROM h),
r(o_custkey, k, o_orderkey, band, ends) AS (SELECT o_custkey, k, o_orderkey, 0::BIGINT, [e] FROM w WHERE k = 1
 UNION ALL SELECT o_custkey, k, o_orderkey, f - 1, list_concat(ends[1:f - 1], [e], ends[f + 1:])
 FROM (SELECT w.*, r.ends, coalesce(list_position(list_transform(r.ends, lambda x: x < w.s), true), len(r.ends) + 1)::BIGINT AS f FROM r JOIN w ON w.o_custkey = r.o_custkey AND w.k = r.k + 1))
SELECT o_custkey, o_orderkey, band FROM r
""")
def interval_bands(spark, d):
    """[W18]"""
    h = half_of(F.col("o_orderdate"))
    s = table(spark, d, "orders").select("o_custkey", "o_orderkey", h.alias("s"), (h + F.col("o_orderkey") % 3).alias("e"))
    return intervals.bands(s, "o_custkey", "o_orderkey", "s", "e")


@query("""
WITH RECURSIVE t AS (SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY p_name) AS title FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2 GROUP BY 1),
w AS (SELECT o_custkey, o_orderkey, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '')) AS words, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS k
 FROM orders JOIN t ON l_orderkey = o_orderkey),
r(o_custkey, k, o_orderkey, head, heads) AS (SELECT o_custkey, k, o_orderkey, o_orderkey, [{'id': o_orderkey, 'words': words}] FROM w WHERE k = 1
 UNION ALL SELECT o_custkey, k, o_orderkey, coalesce(f, o_orderkey), CASE WHEN f IS NULL THEN list_append(heads, {'id': o_orderkey, 'words': words}) ELSE heads END
 FROM (SELECT w.*, r.heads, list_filter(r.heads, lambda h: len(list_intersect(h.words, w.words)) / (len(h.words) + len(w.words) - len(list_intersect(h.words, w.words))) >= 0.55
  OR len(list_intersect(h.words, w.words)) / least(len(h.words), len(w.words)) >= 0.85)[1].id AS f FROM r JOIN w ON w.o_custkey = r.o_custkey AND w.k = r.k + 1))
SELECT o_custkey, o_orderkey, head FROM r
""")
def title_versions(spark, d):
    """[J17] What each customer bought, an order's first parts as its title."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    named = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), " ").alias("title"))
    works = table(spark, d, "orders").join(named, "o_orderkey").select("o_custkey", "o_orderkey", "title", F.year("o_orderdate").alias("year"))
    return titles.merged_versions(works, "o_custkey", "o_orderkey", "title", "year")


_CITED = """
WITH p AS (SELECT c_custkey AS paper, 'D' || c_custkey % 700 AS doi, ['1urgent', '2high', '3medium', '5low', 'none'][c_custkey % 5 + 1] AS title, 1992 + c_custkey % 7 AS year FROM customer),
w AS (SELECT o_orderkey AS work, CASE WHEN o_orderkey % 3 > 0 THEN 'D' || o_orderkey % 900 END AS doi, replace(lower(o_orderpriority), '-', '') AS title, year(o_orderdate) AS year FROM orders)
"""


def _cited(spark, d):
    """Customers as papers, orders as works that they may be."""
    papers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("paper"),
        F.concat(F.lit("https://doi.org/d"), F.col("c_custkey") % 700).alias("doi"),
        F.get(F.array(*(F.lit(t) for t in ("1-Urgent", "2 HIGH", "3-medium", "5-low!", "none"))), (F.col("c_custkey") % 5).cast("int")).alias("title"),
        (1992 + F.col("c_custkey") % 7).cast("int").alias("year"),
    )
    doi = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("D"), F.col("o_orderkey") % 900))
    return papers, table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), doi.alias("doi"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"))


@query(_CITED + """, t AS (SELECT paper, work, CASE WHEN p.doi = w.doi AND p.year = w.year THEN 1 WHEN p.doi = w.doi THEN 2 ELSE 3 END AS tier FROM p JOIN w ON p.title = w.title AND (p.doi = w.doi OR p.year = w.year AND NOT EXISTS (SELECT 1 FROM w x WHERE x.doi = p.doi))),
b AS (SELECT paper, tier, count(DISTINCT work) AS n, min(work) AS work FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY paper ORDER BY tier) = 1)
SELECT p.paper, CASE WHEN n = 1 THEN b.work END AS work, tier, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM p LEFT JOIN b USING (paper)
""")
def link_works(spark, d):
    """[J18] By DOI, title and year."""
    return linkage.resolved(*_cited(spark, d), "paper", "work")


@query("SELECT s_suppkey AS query, n_nationkey AS anchor FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def link_anchors(spark, d):
    """[J28] Each supplier has one nation, in its own region, or the query fails."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("anchor"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"), F.col("s_nationkey").alias("nation"))
    region = nations.select("nation", "region")
    return linkage.anchored(own.join(region, "nation"), nations, "query", "anchor", ["nation", "region"])


@query("""
WITH i AS (SELECT DISTINCT l_orderkey AS w, l_partkey AS ref FROM lineitem), n AS (SELECT w, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT x.w AS a, y.w AS b, round(count(*) / sqrt(min(nx.n) * min(ny.n)), 6) AS sim FROM i x JOIN i y ON x.ref = y.ref AND x.w <> y.w JOIN n nx ON nx.w = x.w JOIN n ny ON ny.w = y.w GROUP BY 1, 2),
t AS (SELECT DISTINCT l_orderkey AS work, l_orderkey % 12 AS topic, l_orderkey // 3000 AS era FROM lineitem), f AS (SELECT topic, min(era) AS birth FROM t WHERE topic >= 4 OR era > 1 GROUP BY 1),
k AS (SELECT t.* FROM t WHERE topic >= 4 OR era > 1), m AS (SELECT b.topic, o.topic AS parent, p.sim AS similarity, row_number() OVER (PARTITION BY b.topic ORDER BY p.sim DESC, o.era, p.a, p.b) AS r
 FROM k b JOIN f ON f.topic = b.topic AND b.era = f.birth JOIN p ON p.a = b.work JOIN k o ON o.work = p.b WHERE o.era < f.birth AND o.topic <> b.topic)
SELECT topic, parent, similarity FROM m WHERE r = 1
""")
def topic_births(spark, d):
    """[J15, R4]"""
    l = table(spark, d, "lineitem")
    t = l.select(F.col("l_orderkey").alias("work"), (F.col("l_orderkey") % 12).alias("topic"), F.expr("l_orderkey div 3000").alias("era")).distinct().where("topic >= 4 or era > 1")
    return titles.births_by_refs(l.select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("ref")), t)


def _works(spark, d):
    c = F.array(F.concat(F.lit("c"), (F.col("o_orderkey") % 23).cast("string")), F.concat(F.lit("d"), (F.col("o_orderkey") % 37).cast("string")))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("work"), c.alias("coauthors"), (F.col("o_orderkey") % 5).alias("institution"), year("o_orderdate").alias("y"), "o_orderstatus")


@query("""
WITH w AS (SELECT o_custkey AS person, o_orderkey AS work, ['c' || (o_orderkey % 23)::VARCHAR, 'd' || (o_orderkey % 37)::VARCHAR] AS co, o_orderkey % 5 AS inst, year(o_orderdate) AS y, o_orderstatus FROM orders),
n AS (SELECT DISTINCT person, work, unnest(co) AS c FROM w), o AS (SELECT person, c FROM n GROUP BY 1, 2 HAVING count(*) >= 2), s AS (SELECT person, inst, min(y) AS a, min(y) + 1 AS b FROM w WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT person, work FROM w WHERE o_orderstatus <> 'P' AND (EXISTS (SELECT 1 FROM n JOIN o USING (person, c) WHERE n.person = w.person AND n.work = w.work) OR EXISTS (SELECT 1 FROM s WHERE s.person = w.person AND s.inst = w.inst AND w.y >= a - 1 AND w.y <= b + 1))
""")
def gate_corroborated(spark, d):
    """[F17]"""
    w = _works(spark, d)
    s = w.where("o_orderstatus = 'F'").groupBy("person", "institution").agg(F.min("y").alias("start"), (F.min("y") + 1).alias("end"))
    return gates.corroborated(w, "person", "work", "coauthors", "institution", "y", s, F.col("o_orderstatus") != "P")


@query("""
WITH w AS (SELECT o_custkey AS person, o_orderkey AS work, o_orderkey % 5 AS inst, year(o_orderdate) AS y, o_orderkey % 3 AS shared FROM orders), s AS (SELECT person, inst, min(y) AS a, max(y) AS b, CASE WHEN inst = 0 THEN 'faculty' ELSE 'postdoc' END AS stage FROM w WHERE inst < 2 GROUP BY 1, 2),
t AS (SELECT person, inst, a AS y FROM s UNION SELECT person, inst, a + 1 FROM s UNION SELECT person, inst, b FROM s UNION SELECT person, inst, b - 1 FROM s WHERE stage = 'faculty')
SELECT DISTINCT w.person, w.work FROM w JOIN t ON t.person = w.person AND t.y = w.y WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.person = w.person AND x.y = w.y AND x.inst = w.inst) AND w.inst <> 3 AND (shared = 0 OR (shared = 1 AND w.work % 2 = 1))
""")
def gate_career_conflicts(spark, d):
    """[F18]"""
    w = _works(spark, d).withColumn("institutions", F.array("institution")).withColumn("kinds", F.array(F.when(F.col("institution") == 3, "company").otherwise("education"))).drop("institution")
    raw = _works(spark, d).where("institution < 2")
    s = raw.groupBy("person", "institution").agg(F.min("y").alias("start"), F.max("y").alias("end")).withColumn("stage", F.when(F.col("institution") == 0, "faculty").otherwise("postdoc"))
    return gates.career_conflicts(w, s, "person", "work", "institutions", "kinds", "y", F.col("work") % 3, F.col("work") % 2 == 0)


@query("""
SELECT o_orderkey, CASE WHEN y <= 1998 AND o_custkey % 5 = 1 THEN 'early' WHEN y BETWEEN 1997 AND 2001 AND o_custkey % 5 = 2 THEN 'late' WHEN y <= 1998 AND o_orderpriority LIKE '%HIGH%' AND o_orderstatus <> 'F' THEN 'early'
 WHEN y BETWEEN 1997 AND 2001 AND o_orderpriority LIKE '%LOW%' THEN 'late' WHEN y <= 1998 THEN 'early' WHEN y BETWEEN 1997 AND 2001 THEN 'late' END AS era FROM (SELECT *, year(o_orderdate) AS y FROM orders)
""")
def gate_eras(spark, d):
    """[F20]"""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("place"), year("o_orderdate").alias("y"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("raw"))
    eras = [{"name": "early", "place": 1, "include": "HIGH", "exclude": "/F$", "start": 0, "end": 1998}, {"name": "late", "place": 2, "include": "LOW", "start": 1997, "end": 2001}]
    return o.select("o_orderkey", gates.matched_eras(o, eras, "raw", "y", "place").alias("era"))


@query("""
SELECT coalesce(CASE WHEN l_returnflag = 'R' THEN 'kind' WHEN l_quantity > 45 THEN 'medical' WHEN l_partkey % 4 = 0 THEN 'field' WHEN l_suppkey % 5 = 0 THEN 'name' WHEN l_tax > 0.04 AND l_linenumber < 2 THEN 'unsupported' END, 'kept') AS reason, count(*) AS n FROM lineitem GROUP BY 1
""")
def gate_low_count(spark, d):
    """[F21]"""
    c = F.col
    l = table(spark, d, "lineitem")
    reason = gates.accepted(c("l_suppkey") % 5 != 0, c("l_returnflag") != "R", c("l_partkey") % 4 != 0, c("l_tax") <= 0.04, c("l_linenumber"), c("l_quantity") > 45)
    return gates.reason_counts(l.withColumn("reason", reason))


@query("SELECT c_nationkey::BIGINT AS edge, 'spatial' AS kind, count(*) AS size FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7) GROUP BY 1")
def gate_visible_edges(spark, d):
    """[F23, F27]"""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("edge"), F.col("c_custkey").alias("node"))
    n = c.groupBy("edge").agg(F.count("*").alias("size"))
    e = c.join(n, "edge").withColumn("kind", F.lit("spatial"))
    return gates.visible_edges(e, "node", 7)


@query("""
WITH h AS (SELECT o_custkey AS person, o_orderkey % 3 AS unit, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::BIGINT AS t, o_orderstatus FROM orders), q AS (SELECT c_custkey AS person, c_custkey % 3 AS unit, 1995 AS phd FROM customer),
f AS (SELECT person, min(t) AS f FROM h WHERE o_orderstatus = 'F' AND unit = 2 GROUP BY 1), e AS (SELECT DISTINCT person, unit, t FROM h JOIN q USING (person, unit) LEFT JOIN f USING (person) WHERE t > phd * 2 + 1 AND (f IS NULL OR t < f)),
g AS (SELECT *, t - row_number() OVER (PARTITION BY person ORDER BY t) AS k FROM e) SELECT person, unit, min(t) AS start, max(t) AS "end" FROM g GROUP BY person, unit, k
""")
def career_postdocs(spark, d):
    """[C2, J22]"""
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 3).alias("unit"), half_of(F.col("o_orderdate")).alias("at"), "o_orderstatus").withColumn("institution", F.col("unit").cast("string"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 3).alias("unit"), F.lit(1995).cast("long").alias("phd_year"))
    posts = h.where("o_orderstatus = 'F' and unit = 2").select("person", F.col("at").alias("start"))
    return career.postdocs(h, people, posts).select("person", "unit", "start", "end")


@query("""
WITH h AS (SELECT o_custkey AS person, o_orderkey % 9 AS unit, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::BIGINT AS t, o_orderstatus FROM orders), p AS (SELECT person, min(t) AS s, min(t) AS e FROM h GROUP BY 1), c AS (SELECT person, max(t) + 1 AS start FROM h GROUP BY 1),
x AS (SELECT DISTINCT h.person, unit FROM h JOIN p ON h.person = p.person AND t >= s AND t <= e), n AS (SELECT person, unit, count(DISTINCT t) AS n, min(t) AS a, max(t) AS b FROM h GROUP BY 1, 2)
SELECT n.person, n.unit, a AS start, b AS "end" FROM n JOIN c USING (person) WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM x WHERE x.person = n.person AND x.unit = n.unit) AND b < c.start AND b >= c.start - 2
""")
def career_faculty(spark, d):
    """[C3]"""
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 9).alias("unit"), half_of(F.col("o_orderdate")).alias("at")).withColumn("institution", F.col("unit").cast("string"))
    taken = h.groupBy("person").agg(F.min("at").alias("start"), F.min("at").alias("end"))
    current = h.groupBy("person").agg((F.max("at") + 1).alias("start"))
    return career.faculty_posts(h, taken, current).select("person", "unit", "start", "end")


@query("""
WITH s AS (SELECT o_custkey AS person, o_orderkey % 4 AS unit, o_orderkey AS id, o_orderpriority LIKE '%LOW%' AS research FROM orders WHERE o_orderstatus = 'F')
SELECT id, CASE WHEN research AND NOT EXISTS (SELECT 1 FROM s x WHERE x.person = s.person AND x.unit = s.unit AND NOT x.research) THEN 'postdoc' ELSE 'faculty' END AS stage FROM s
""")
def career_reclassified(spark, d):
    """[C4]"""
    s = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 4).alias("unit"), F.col("o_orderkey").alias("id"), "o_orderpriority", F.lit("faculty").alias("stage"))
    return career.reclassified(s, F.col("o_orderpriority").contains("LOW")).select("id", "stage")


@query("""
WITH s AS (SELECT o_orderkey AS spell, o_custkey AS unit, (year(o_orderdate) * 2)::BIGINT AS a FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT o_custkey AS unit, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::BIGINT AS t, o_orderpriority AS label FROM orders WHERE o_orderstatus <> 'F'),
f AS (SELECT spell, count(DISTINCT label) AS k, min(label) AS label FROM s JOIN l ON s.unit = l.unit AND t >= a AND t <= a + 1 GROUP BY 1)
SELECT spell, CASE WHEN k = 1 THEN label END AS department, CASE WHEN k IS NULL THEN 'none' WHEN k > 1 THEN 'ambiguous' END AS reason FROM s LEFT JOIN f USING (spell)
""")
def career_departments(spark, d):
    """[C6]"""
    o = table(spark, d, "orders")
    s = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("spell"), F.col("o_custkey").alias("unit"), (year("o_orderdate") * 2).alias("start")).withColumn("end", F.col("start") + 1)
    l = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("unit"), half_of(F.col("o_orderdate")).alias("at"), F.col("o_orderpriority").alias("label"))
    return career.departments(s, l)


@query("""
SELECT CASE WHEN c_acctbal < 0 THEN 'no_institution' WHEN c_nationkey = 3 THEN 'country_conflict' WHEN c_mktsegment = 'MACHINERY' THEN 'subject' WHEN c_custkey % 9 = 0 THEN 'department' WHEN c_custkey % 8 = 0 THEN 'inferred' ELSE 'kept' END AS reason, count(*) AS n FROM customer GROUP BY 1
""")
def career_unit_reasons(spark, d):
    """[C11, X31]"""
    k = F.col("c_custkey")
    rules = [("no_institution", F.col("c_acctbal") < 0), ("country_conflict", F.col("c_nationkey") == 3), ("subject", F.col("c_mktsegment") == "MACHINERY"), ("department", k % 9 == 0), ("inferred", k % 8 == 0)]
    return gates.reason_counts(gates.cascade(table(spark, d, "customer"), rules))


@query("""
WITH w AS (SELECT o_custkey AS person, o_orderkey AS work, ['c' || (o_orderkey % 7)::VARCHAR, 'd' || (o_orderkey % 5)::VARCHAR] AS co, (o_orderkey // 10) % 3 AS field, (o_orderkey // 10) % 9 AS subfield, o_orderstatus = 'F' AS anchor, o_orderkey % 11 = 0 AS home FROM orders),
n AS (SELECT person, count(*) AS n, list(DISTINCT field) AS fs, list(DISTINCT subfield) AS ss FROM w WHERE anchor GROUP BY 1), a AS (SELECT DISTINCT person, unnest(co) AS c FROM w WHERE anchor),
s AS (SELECT person, work, count(*) AS shared FROM (SELECT DISTINCT person, work, unnest(co) AS c FROM w WHERE NOT anchor) JOIN a USING (person, c) GROUP BY 1, 2)
SELECT coalesce(CASE WHEN home OR anchor OR coalesce(n, 0) < 3 OR coalesce(shared, 0) >= 2 THEN NULL WHEN shared = 1 AND NOT list_contains(fs, field) THEN 'field' WHEN coalesce(shared, 0) = 0 AND NOT list_contains(ss, subfield) THEN 'subfield' END, 'kept') AS reason, count(*) AS n
FROM w LEFT JOIN n USING (person) LEFT JOIN s USING (person, work) GROUP BY 1
""")
def gate_namesakes(spark, d):
    """[F16]"""
    k = F.col("o_orderkey")
    co = F.array(F.concat(F.lit("c"), (k % 7).cast("string")), F.concat(F.lit("d"), (k % 5).cast("string")))
    tens = F.expr("o_orderkey div 10")
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), k.alias("work"), co.alias("coauthors"), (tens % 3).alias("field"), (tens % 9).alias("subfield"), (F.col("o_orderstatus") == "F").alias("anchor"), (k % 11 == 0).alias("home"))
    return gates.reason_counts(gates.namesakes(w, "person", "work", "coauthors", "field", "subfield", F.col("home"), F.col("anchor")))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/?#:]*[.]example[.]com[/?#]') AND regexp_extract(url, '[?&]utm_source=([^&#]+)', 1) <> '' THEN regexp_extract(url, '[?&]utm_source=([^&#]+)', 1) END AS record FROM pages")
def text_canonical_url(spark, d):
    """[X15] The record that an https URL of an allowed host names."""
    from lodestone.functions import text

    p = table(spark, d, "pages")
    return p.select("page_id", text.canonical_url(F.col("url"), (".example.com",), "utm_source").alias("record"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE NOT contains(term, 'wid') AND term NOT IN (SELECT lower(p_brand) FROM part UNION SELECT 'ring') GROUP BY 1")
def text_suppressed(spark, d):
    """[X20] Terms without names and boilerplate."""
    terms = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    names = table(spark, d, "part").select(F.lower("p_brand").alias("n")).union(spark.createDataFrame([("ring",)], "n string"))
    return titles.suppressed(terms, "term", names, ("wid",)).groupBy("term").agg(F.count("*").alias("n"))


@query("""
SELECT n_nationkey::BIGINT AS nation, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' ELSE 'other' END AS code, lower(n_name || ' ' || CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' ELSE n_name END) AS search FROM nation
""")
def text_mapped(spark, d):
    """[X7-X9] Names by a fixed map, and the text that search looks in."""
    from lodestone.functions import text

    codes = {"FRANCE": "FR", "GERMANY": "DE"}
    n = F.col("n_name")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), text.mapped(n, codes, F.lit("other")).alias("code"), F.lower(F.concat_ws(" ", n, text.mapped(n, codes))).alias("search"))


@query("SELECT DISTINCT w, substr(CASE WHEN regexp_matches(w, 'ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|sh|ch|x)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END, 1, 7) AS stem FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE regexp_matches(w, '^[a-z]+$')")
def text_stems(spark, d):
    """[X21, X29]"""
    from lodestone.functions import text

    w = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where(F.col("w").rlike("^[a-z]+$")).distinct()
    return w.select("w", text.stem(F.col("w")).alias("stem"))


@query("SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey")
def source_attached(spark, d):
    """[S2, J3] A second catalogue's view joined by its key."""
    table(spark, d, "orders").createOrReplaceTempView("decisions_of_another_store")
    table(spark, d, "customer").createOrReplaceTempView("people_of_this_store")
    return spark.sql("SELECT c_custkey, o_orderkey FROM people_of_this_store JOIN decisions_of_another_store ON c_custkey = o_custkey")
