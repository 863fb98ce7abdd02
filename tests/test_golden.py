"""Small cases with results worked out by hand."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import periods, text
from lodestone.operators import career, flows, gates, graph, information, integrity, intervals, matrix, replicates, search, sets, yearly
from lodestone.plans import console
from lodestone.sources import tables

SPELL = "person string, stage string, unit string, institution string, start long, end long, kind string, confidence string"


def h(year, half):
    return year * 2 + half - 1


def at(term):
    year, name = term.split("-")
    return int(year) * 2 + (name == "fall")


def spell(stage, unit, start, end, kind="inferred"):
    return ("p", stage, unit, f"name {unit}", h(*start), h(*end), kind, "medium")


def observed(spark, rows):
    return spark.createDataFrame([("p", u, f"name {u}", at(t)) for u, t in rows], "person string, unit string, institution string, at long")


def reconciled(spark, spells, rows):
    out = career.reconciled(spark.createDataFrame(spells, SPELL), observed(spark, rows)).collect()
    return sorted((r["stage"], r["unit"], r["start"], r["end"]) for r in out)


class TestReconciliation:
    def test_conflicting_inferred_post_goes(self, spark):
        rows = [("A", f"{y}-{s}") for y in (2023, 2024) for s in ("spring", "fall")] + [("B", "2025-spring"), ("B", "2025-fall"), ("B", "2026-spring")]
        assert reconciled(spark, [spell("faculty", "B", (2010, 1), (2026, 1))], rows) == [("faculty", "A", h(2023, 1), h(2024, 2)), ("faculty", "B", h(2025, 1), h(2026, 1))]

    def test_observed_spell_is_extended(self, spark):
        rows = [("B", "2025-spring"), ("B", "2025-fall"), ("B", "2026-spring")]
        assert reconciled(spark, [spell("faculty", "B", (2025, 2), (2026, 1))], rows) == [("faculty", "B", h(2025, 1), h(2026, 1))]

    def test_verified_post_stays(self, spark):
        got = reconciled(spark, [spell("faculty", "B", (2010, 1), (2026, 1), "verified")], [("A", "2023-spring"), ("B", "2025-spring")])
        assert ("faculty", "B", h(2010, 1), h(2026, 1)) in got

    def test_two_units_at_once_take_nothing_away(self, spark):
        out = career.reconciled(spark.createDataFrame([spell("faculty", "C", (2020, 1), (2026, 1))], SPELL), observed(spark, [("A", "2023-spring"), ("B", "2023-spring")])).collect()
        assert {(r["unit"], r["confidence"]) for r in out} == {("A", "medium"), ("B", "medium"), ("C", "medium")}

    def test_gaps_are_not_bridged(self, spark):
        got = reconciled(spark, [], [("X", "2023-spring"), ("X", "2024-spring"), ("Y", "2023-spring")])
        assert len(got) == 3

    def test_postdoc_loses_observed_half_years(self, spark):
        rows = [("U", t) for t in ("2024-spring", "2024-fall", "2025-spring", "2026-spring")]
        got = reconciled(spark, [spell("postdoc", "U", (2021, 1), (2026, 1), "publication")], rows)
        assert [g for g in got if g[0] == "postdoc"] == [("postdoc", "U", h(2021, 1), h(2023, 2)), ("postdoc", "U", h(2025, 2), h(2025, 2))]

    def test_roster_rows_are_validated(self, spark):
        rows = [("p", "U", "n", 2023, "2023-spring", None), ("p", "U", "n", 2023, "2024-spring", None), ("p", "U", "n", 2023, "2023-spring", "fall"), ("p", None, "n", 2023, "2023-fall", None), ("p", "U", "n", 2023, "soon", None)]
        df = spark.createDataFrame(rows, "person string, unit string, institution string, year long, term string, semester string")
        assert [r["at"] for r in career.observations(df, 2026).collect()] == [2023 * 2]


class TestHypergraph:
    def test_equal_years_merge(self, spark):
        rows = [(m, y) for m in (0, 1) for a, b in ((2000, 2001), (2004, 2005)) for y in range(a, b + 1)]
        got = sets.annual_sets(spark.createDataFrame([("u", *r) for r in rows], "unit string, node long, year int"), ["unit"], "node", "year").withColumn("label", periods.year_label(F.col("years"))).collect()
        assert [(list(r["members"]), list(r["years"]), r["label"]) for r in got] == [([0, 1], [2000, 2001, 2004, 2005], "2000–2001, 2004–2005")]

    def test_weights(self, spark):
        kind = "kind string, edge string, node long"
        two = spark.createDataFrame([("s", "a", 0), ("s", "a", 1), ("s", "b", 2), ("s", "b", 3), ("s", "b", 4), ("s", "c", 9)], kind)
        assert {r["edge"]: r["weight"] for r in sets.weights(two, "edge", "node", ["kind"]).collect()} == {"a": 2.0, "b": 1.5}
        lap = spark.createDataFrame([("t", "x", 0), ("t", "x", 1), ("t", "y", 0), ("t", "y", 2), ("o", "z", 0), ("o", "z", 1)], kind)
        got = {r["edge"]: r for r in sets.weights(lap, "edge", "node", ["kind"]).collect()}
        assert math.isclose(got["x"]["weight"], 2 * 0.75) and math.isclose(got["y"]["weight"], 2 * 0.75) and got["z"]["redundancy"] == 0

    def test_hub_items_lose_no_pair(self, spark, monkeypatch):
        monkeypatch.setattr(sets, "HUB", 4)
        df = spark.createDataFrame([(k, 0) for k in range(20)] + [(0, 1), (1, 1)], "owner long, item long")
        got = {(r["owner_a"], r["owner_b"]): r["shared"] for r in sets.co_occurrences(df, "owner", "item").collect()}
        assert len(got) == 190 and got[0, 1] == 2


class TestIntervals:
    def test_open_spells_never_merge(self, spark):
        df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 4, 5, "y"), ("a", None, 9, "z"), ("a", 5, None, "w"), ("a", 20, 21, "v")], "k string, s long, e long, b string")
        got = intervals.merged(df, ["k"], "s", "e", 3, [F.array_join(F.array_sort(F.collect_set("b")), ";").alias("b")]).collect()
        assert {(r["s"], r["e"], r["b"]) for r in got} == {(1, 5, "x;y"), (None, 9, "z"), (5, None, "w"), (20, 21, "v")}

    def test_observations_apart_stay_apart(self, spark):
        assert sorted((r["start"], r["end"]) for r in intervals.islands(spark.createDataFrame([("t", 2005), ("t", 2010)], "k string, at long"), ["k"], "at").collect()) == [(2005, 2005), (2010, 2010)]

    def test_overlaps_in_every_block_once(self, spark):
        df = spark.createDataFrame([("u", 1, 0, 100), ("u", 2, 50, 60), ("u", 3, 101, 102)], "unit string, who long, s long, e long")
        assert [tuple(r) for r in intervals.overlaps(df, ["unit"], "who", "s", "e").collect()] == [("u", 1, 2, 50, 60)]

    def test_periods(self, spark):
        df = spark.createDataFrame([("2010-H1",), ("2010-H3",), (None,)], "p string").select(periods.index_of(F.col("p")).alias("i"))
        assert [r["i"] for r in df.collect()] == [4020, None, None]

    def test_era_labels(self, spark):
        labels = ["A (~2010)", "B (2011-13)", "C (2020-)", "none"]
        got = spark.createDataFrame([(x,) for x in labels], "l string").select(periods.era_bounds(F.col("l")).alias("b")).collect()
        assert [(r["b"]["start"], r["b"]["end"]) for r in got] == [(None, 2010), (2011, 2013), (2020, None), (None, None)]


class TestStatistics:
    def test_quantiles(self, spark):
        r = yearly.quantiles(spark.createDataFrame([("g", 1990), ("g", 2000), ("g", None)], "g string, y int"), ["g"], "y").first()
        assert (r["q1"], r["median"], r["q3"], r["n_valid"]) == (1992.5, 1995.0, 1997.5, 2)

    def test_movements(self, spark):
        roster = [("stay", "U", 1), ("stay", "U", 2), ("in", "V", 1), ("in", "U", 2), ("out", "U", 1), ("out", "V", 2), ("gone", "U", 1), ("new", "U", 2), ("both", "U", 1), ("both", "V", 2), ("both", "W", 2), ("amb", "V", 1), ("amb", "W", 1), ("amb", "U", 2)]
        df = spark.createDataFrame(roster, "who string, unit string, year int")
        r = flows.movements(df, "who", "unit", "year").where("unit = 'U' and year = 2").first()
        assert (r["n"], r["previous"], r["retained"], r["added"], r["removed"]) == (4, 4, 1, 3, 3)
        assert [r[c] for c in ("moves_in", "moves_out", "prior_unobserved", "next_unobserved", "ambiguous_in", "ambiguous_out")] == [1] * 6

    def test_a_gap_is_not_compared(self, spark):
        df = spark.createDataFrame([("a", "U", 2023), ("a", "U", 2025)], "who string, unit string, year int")
        r = flows.movements(df, "who", "unit", "year").where("year = 2025").first()
        assert r["comparable"] is False and r["added"] is None

    def test_flows_conserve_people(self, spark):
        people = spark.createDataFrame([(1, "A", "P", "X"), (2, "B", "P", "Y"), (3, None, "P", "X"), (4, "A", None, None)], "id long, a string, b string, c string")
        whole = flows.complete(people, ["a", "b", "c"])
        assert {tuple(r)[:3] for r in flows.routes(whole, "id", ["a", "b", "c"]).collect()} == {("A", "P", "X"), ("B", "P", "Y")}
        assert flows.links(whole, ["a", "b", "c"], "a").agg(F.sum("n")).first()[0] == 4
        assert tuple(flows.missing_by_stage(people, ["a", "b", "c"]).first()) == (4, 2, 1, 1, 1)

    def test_signed_changes_stay_above_zero(self, spark):
        base = spark.createDataFrame([("a", 1), ("b", 5)], "k string, n long")
        delta = spark.createDataFrame([("a", 3, -1), ("c", 2, 1), ("b", 1, -1)], "k string, n long, sign int")
        assert {tuple(r) for r in yearly.changed(base, delta, ["k"], ["n"]).collect()} == {("b", 4), ("c", 2)}


class TestInformation:
    def test_entropies(self, spark):
        df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 1.0)] + [("b", 5.0)], "g string, m double")
        plain = {r["g"]: r["entropy"] for r in information.entropies(df, ["g"], "m", corrected=False).collect()}
        assert math.isclose(plain["a"], 2) and plain["b"] == 0
        assert {r["g"]: r["entropy"] for r in information.entropies(df, ["g"], "m").collect()}["a"] > 2

    def test_divergence(self, spark):
        df = spark.createDataFrame([("same", "x", 1, 2), ("same", "y", 1, 2), ("apart", "x", 1, 0), ("apart", "y", 0, 1), ("empty", "x", 0, 1)], "g string, l string, p long, q long")
        got = {r["g"]: r["jsd"] for r in information.divergence(df, ["g"], "l", "p", "q").collect()}
        assert math.isclose(got["same"], 0, abs_tol=1e-12) and math.isclose(got["apart"], 1) and got["empty"] is None

    def test_pure_continuation_and_split(self, spark):
        joint = spark.createDataFrame([("c", "a", "a", 50.0), ("c", "b", "b", 50.0), ("s", "a", "x", 50.0), ("s", "a", "y", 50.0)], "g string, a string, b string, m double")
        got = {r["g"]: r for r in information.joint_measures(joint, ["g"], "a", "b", "m").collect()}
        assert got["c"]["diverge"] < 0.01 and got["c"]["merge"] < 0.01 and got["s"]["diverge"] > 0.9

    def test_births_and_endings(self, spark):
        members = spark.createDataFrame([("p", 1, 0, "a"), ("p", 2, 0, "a"), ("p", 3, 1, "b"), ("p", 4, 1, "b"), ("p", 9, 5, "z")], "who string, item long, w long, label string")
        links = spark.createDataFrame([("p", 1, 3, 1.0), ("p", 3, 1, 1.0)], "who string, item_a long, item_b long, weight double")
        got = {(r["w"], r["a"], r["b"]): r["mass"] for r in information.transitions(members, "who", "item", "w", "label", links).collect()}
        assert got == {(0, "a", "b"): 1.0, (0, None, "b"): 1.0, (0, "a", None): 1.0}

    def test_replicates_against_sequential_draws(self, spark):
        """A null shuffles labels inside each window and keeps the links; a resample draws as many items as a window has; the joint of each is that of the rule."""
        members = [("p", k, k % 3, "abc"[k % 7 % 3]) for k in range(24)] + [("q", 1, 0, "a"), ("q", 2, 2, "a")]
        links = [("p", a, b, 1.0 + (a * b) % 5) for a in range(24) for b in range(24) if b % 3 == a % 3 + 1 and (a + b) % 4 == 0]
        df = spark.createDataFrame(members, "who string, item long, w long, label string")
        draws = replicates.drawn(df, 20, "s").collect()
        label = {(w, i): x for w, i, _, x in members}
        seen = defaultdict(list)
        for r in draws:
            seen[r["kind"], r["rep"], r["who"], r["w"]].append((r["item"], r["label"], r["times"]))
        assert len(seen) == 41 * 5
        for (kind, _, who, w), own in seen.items():
            items = sorted(i for o, i, x, _ in members if (o, x) == (who, w))
            assert sum(t for *_, t in own) == len(items) and {i for i, *_ in own} <= set(items)
            if kind == "null":
                assert sorted(i for i, *_ in own) == items and sorted(x for _, x, _ in own) == sorted(label[who, i] for i in items)
            else:
                assert all(x == label[who, i] for i, x, _ in own)
        assert len({tuple(sorted(own)) for (kind, _, who, w), own in seen.items() if (kind, who, w) == ("null", "p", 0)}) > 10
        want = defaultdict(float)
        for (kind, rep, who, w), dst in seen.items():
            src = seen.get((kind, rep, who, w - 1))
            if not src:
                continue
            weight = {(a, b): x for o, a, b, x in links if o == who}
            hit = set()
            for q, b, tq in dst:
                near = [(p, a, tp * weight[p, q]) for p, a, tp in src if (p, q) in weight]
                hit |= {p for p, *_ in near}
                total = sum(x for *_, x in near)
                for _, a, x in near:
                    want[kind, rep, who, w - 1, a, b] += tq * x / total
                if not near:
                    want[kind, rep, who, w - 1, None, b] += tq
            for p, a, tp in src:
                if p not in hit:
                    want[kind, rep, who, w - 1, a, None] += tp
        own = spark.createDataFrame(links, "who string, p long, q long, weight double")
        got = {tuple(r)[:6]: r["mass"] for r in replicates.joint(spark.createDataFrame(draws), own).select("kind", "rep", "who", "w", "a", "b", "mass").collect()}
        assert got == pytest.approx(dict(want))

    def test_judged_against_chance(self, spark):
        rows = [(k, r, "p", 0, 1.0, *(v,) * 5) for k, r, v in [("own", 0, 5.0), *(("null", r, r / 10) for r in range(1, 11)), *(("boot", r, float(r)) for r in range(1, 201))]]
        rows += [("own", 0, "q", 0, 1.0, *(None,) * 5), ("null", 1, "q", 0, 1.0, *(0.0,) * 5), ("own", 0, "r", 0, 1.0, *(0.5,) * 5), ("null", 1, "r", 0, 1.0, *(0.5,) * 5), ("null", 2, "r", 0, 1.0, *(0.5,) * 5)]
        df = spark.createDataFrame(rows, "kind string, rep int, who string, w int, mass double, diverge double, merge double, continuity double, diverge_norm double, merge_norm double")
        got = {r["who"]: r for r in replicates.judged(df).where("measure = 'merge'").collect()}
        assert got["p"]["z"] == pytest.approx((5 - 0.55) / np.std(np.arange(1, 11) / 10, ddof=1)) and (got["p"]["low"], got["p"]["high"]) == (5.0, 195.0)
        assert got["q"]["value"] is got["q"]["null_mean"] is got["q"]["low"] is None and got["r"]["z"] is None


class TestSearch:
    def test_grammar(self):
        q = search.parsed('phd:"seoul national" field: physics spin x:y topic:')
        assert q.scoped == [("phd", ["seoul", "national"]), ("subject", ["physics"])] and q.free == ["spin", "x:y"]

    def test_short_terms_begin_words(self, spark):
        assert search.parsed('학부:서울대 박사:KAIST 연구:"condensed matter" oa=spin').scoped == [("bachelor", ["서울대"]), ("phd", ["kaist"]), ("area", ["condensed", "matter"]), ("area", ["spin"])]
        assert search.parsed('say"so it is" x:"y z" a: b:c "open end').free == ["say", "so", "it", "is", "x:y", "z", "a:", "b:c", "open", "end"]
        assert search.parsed("inst: phd: mit ba: name:bo").scoped == [("phd", ["mit"]), ("name", ["bo"])]
        df = spark.createDataFrame([("smith college",), ("mit-harvard center",), ("the mit",)], "t string").where(search.holds(F.col("t"), "mit"))
        assert {r["t"] for r in df.collect()} == {"mit-harvard center", "the mit"}

    def test_share_orders_area_hits(self, spark):
        areas = spark.createDataFrame([("a", "network", 0.4, 1), ("b", "network", 0.5, 1), ("b", "network theory", 0.5, 2)], "who string, area string, share double, level int")
        best = search.best_area(areas, "who", ["network"]).withColumn("fields", F.array(F.lit("area")))
        assert [(r["who"], r["area"]) for r in search.ranked_hits(best, "who").orderBy("position").collect()] == [("b", "network theory"), ("a", "network")]


class TestConsole:
    GOOD = ["SELECT 1", "-- x;\nWITH a AS (SELECT 1) SELECT * FROM a;", "SELECT 'a;b' -- drop\n", "SELECT [delete] FROM t", 'SELECT "update" FROM t /* ; */ ;', "SELECT CASE WHEN 1 THEN 2 END", "SELECT replace('a', 'b', 'c')"]
    BAD = ["", "  ", "SELECT 1; SELECT 2", "PRAGMA x", "WITH a AS (SELECT 1) DELETE FROM t", "SELECT 'open", "SELECT /* open", "SELECT 1\0", "SELECT " + "1" * 20_001, "'SELECT'", "(SELECT 1)", "DROP TABLE t", "SELECT 1; -- fine\nSELECT", "INSERT INTO t SELECT 1", "-- only"]

    @pytest.mark.parametrize("sql", GOOD)
    def test_accepted(self, sql):
        assert console.guarded(sql) == sql

    @pytest.mark.parametrize("sql", BAD)
    def test_refused(self, sql):
        with pytest.raises(console.Refused):
            console.guarded(sql)

    def test_result(self, spark):
        t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "professor_id string, n int")
        known = spark.createDataFrame([("a",), ("b",)], "professor_id string")
        ids, n = console.run(spark, 'SELECT [professor_id], n AS "x y" FROM t', {"t": t}, known)
        assert n == 3 and {r[0] for r in ids.collect()} == {"a", "b"}
        for sql in ("SELECT n FROM t", "SELECT professor_id, professor_id AS PROFESSOR_ID FROM t", "SELECT 'c' AS professor_id"):
            with pytest.raises(console.Refused):
                console.run(spark, sql, {"t": t}, known)
        with pytest.raises(console.Refused):
            console.run(spark, "SELECT professor_id FROM t", {"t": t}, known, most=2)

    def test_a_query_has_all_rows(self, spark, tmp_path):
        from lodestone.plans.flows import console_select

        spark.range(101_000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "400000.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
        spark.range(7).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
        assert sorted(r[0] for r in console_select(spark, str(tmp_path)).collect()) == list(range(7))


class TestGates:
    def test_namesakes(self, spark):
        rows = [("p", k, ["x", "y"], "F", "S", True, False) for k in range(3)]
        rows += [("p", 10, ["x", "y"], "G", "T", False, False), ("p", 11, ["x"], "G", "S", False, False), ("p", 12, ["z"], "F", "T", False, False), ("p", 13, [], "G", "T", False, False), ("p", 14, ["z"], "G", "T", False, True), ("q", 1, ["z"], "G", "T", False, False)]
        df = spark.createDataFrame(rows, "person string, work long, coauthors array<string>, field string, subfield string, anchor boolean, home boolean")
        got = {(r["person"], r["work"]): r["reason"] for r in gates.namesakes(df, "person", "work", "coauthors", "field", "subfield", F.col("home"), F.col("anchor")).collect()}
        assert got["p", 11] == "field" and got["p", 12] == "subfield" and [got["p", k] for k in (10, 13, 14)] == [None] * 3 and got["q", 1] is None

    def test_identity_is_of_person_and_work(self, spark):
        works = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "uid string, work long")
        decisions = spark.createDataFrame([("a", 1, "true_paper"), ("a", 2, "namesake_paper")], "uid string, work long, decision string")
        got = {(r["uid"], r["work"]): r["reason"] for r in gates.identity_reason(works, decisions, works, works.limit(0), ["uid", "work"]).collect()}
        assert got == {("a", 1): None, ("b", 1): "missing", ("a", 2): "namesake"}


class TestText:
    def test_orcid(self, spark):
        ids = ["https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0098", "0000-0002-1694-233X", "no"]
        got = spark.createDataFrame([(x,) for x in ids], "i string").select(text.orcid(F.col("i")).alias("o")).collect()
        assert [r["o"] for r in got] == ["0000-0002-1825-0097", None, "0000-0002-1694-233X", None]

    def test_others(self, spark):
        df = spark.createDataFrame([({"b": [1], "a": [0, 2]}, "studies", "Department of Physics, X. Department of Physics")], "inv map<string,array<int>>, w string, d string")
        r = df.select(text.inverted_to_text(F.col("inv")).alias("t"), text.singular(F.col("w")).alias("s"), text.department(F.col("d")).alias("d"), text.nfkc(F.lit("Ａb")).alias("n"), text.json_list_with(F.lit('["a"]'), F.lit("b")).alias("j")).first()
        assert tuple(r) == ("a b a", "study", "Department of Physics", "ab", '["a","b"]')

    def test_same_institution(self, spark):
        df = spark.createDataFrame([("University of Oslo", "Oslo (Norway)"), ("MIT", "MITRE")], "a string, b string")
        assert [r[0] for r in df.select(text.same_institution(F.col("a"), F.col("b"))).collect()] == [True, False]


class TestGraph:
    def test_planted_communities(self, spark):
        rows = [(a, b, 1.0) for c in (0, 10, 20) for a in range(c, c + 6) for b in range(a + 1, c + 6)] + [(0, 10, 0.1), (10, 20, 0.1)]
        edges = spark.createDataFrame([("g", *r) for r in rows], "g string, src long, dst long, weight double")
        nodes = spark.createDataFrame([("g", k) for c in (0, 10, 20) for k in range(c, c + 6)] + [("g", 99)], "g string, node long")
        got = {r["node"]: r["community"] for r in graph.communities(edges, nodes, "g").collect()}
        assert len({got[k] for k in range(6)}) == 1 and len({got[0], got[10], got[20]}) == 3 and got[99] == -1
        labels = graph.propagated(edges, nodes)
        assert graph.modularity(edges, labels) > 0.5

    def test_components_with_hubs_dropped(self, spark):
        e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (3, 9), (5, 9)], "src long, dst long")
        n = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 7, 9)], "node long")
        assert {tuple(r) for r in graph.components(e, n).collect()} == {(k, 1) for k in (1, 2, 3, 4, 5, 9)} | {(7, 7)}
        assert {tuple(r) for r in graph.components(e, n, spark.createDataFrame([(9,)], "node long")).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7)}

    def test_cycles_are_roots(self, spark):
        links = spark.createDataFrame([(2, 1), (3, 2), (5, 6), (6, 5)], "node long, parent long")
        got = {r["node"]: (r["root"], r["depth"]) for r in graph.tree_order(links, spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6)], "node long")).collect()}
        assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 5: (5, 0), 6: (6, 0)}

    def test_deep_chains_reach_their_root(self, spark):
        links = spark.createDataFrame([(k, k - 1) for k in range(1, 67)], "node long, parent long").coalesce(1)
        got = graph.tree_order(links, spark.createDataFrame([(66,)], "node long").coalesce(1)).collect()
        assert [tuple(r) for r in got] == [(66, 0, 66, list(range(67)))]


class TestMatrix:
    def test_agreement(self, spark):
        def brute(a, b):
            n = len(a)
            cells, x, y = Counter(zip(a, b, strict=True)), Counter(a), Counter(b)
            pairs = lambda c: sum(v * (v - 1) / 2 for v in c.values())
            chance = pairs(x) * pairs(y) / (n * (n - 1) / 2)
            half = (pairs(x) + pairs(y)) / 2
            h = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
            mi = sum(v / n * math.log(n * v / (x[i] * y[j])) for (i, j), v in cells.items())
            emi = sum(k / n * math.log(n * k / (u * v)) * math.comb(u, k) * math.comb(n - u, v - k) / math.comb(n, v) for u in x.values() for v in y.values() for k in range(max(1, u + v - n), min(u, v) + 1))
            return (1.0 if half == chance else (pairs(cells) - chance) / (half - chance)), (1.0 if abs((h(x) + h(y)) / 2 - emi) < 1e-12 else (mi - emi) / ((h(x) + h(y)) / 2 - emi))

        runs = [[k % 3 for k in range(60)], [k % 3 + 7 for k in range(60)], [k // 20 for k in range(60)], [0] * 60, list(range(60)), [0] * 55 + [1] * 5]
        df = spark.createDataFrame([(r, k, c) for r, own in enumerate(runs) for k, c in enumerate(own)], "run long, node long, community long")
        got = {(r["run_a"], r["run_b"]): (r["ari"], r["ami"]) for r in matrix.agreement(df, "run", "node", "community").collect()}
        assert len(got) == 15
        for (i, j), found in got.items():
            assert found == pytest.approx(brute(runs[i], runs[j]), abs=1e-9), (i, j)
        assert got[0, 1] == pytest.approx((1, 1))


class TestSources:
    def test_shards_last_write_wins(self, spark, tmp_path):
        import gzip

        for k, lines in enumerate((['{"a": 1, "w": "x", "v": 1}', "", '{"a": 1, "w": "x", "v": 2}'], ['{"a": 1, "w": "x", "v": 3}', '{"a": 2, "w": "y", "v": 9}'])):
            with gzip.open(tmp_path / f"batch_{k}.jsonl.gz", "wt") as f:
                f.write("\n".join(lines))
        schema = spark.createDataFrame([], "a long, w string, v long").schema
        assert {tuple(r) for r in tables.json_shards(spark, f"{tmp_path}/batch_*.jsonl.gz", schema, ["a", "w"]).collect()} == {(1, "x", 3), (2, "y", 9)}

    def test_layouts_round_trip(self, spark):
        df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None)], "k string, n long, t string")
        wide = tables.columnar(df, "k", ["n"], ["n", "t"])
        assert {tuple(r) for r in tables.rowwise(wide, "k", ["n", "t"]).collect()} == {tuple(r) for r in df.collect()}

    def test_sealed_xml_and_sheets(self, spark, tmp_path):
        key = F.lit("0123456789abcdef")
        assert spark.range(1).select(tables.opened(tables.sealed(F.lit("secret"), key), key)).first()[0] == "secret"
        xml = spark.createDataFrame([("<r><id>5</id></r>",), ("<!DOCTYPE r><r><id>5</id></r>",)], "x string")
        got = tables.xml_records(xml, "x", "id int").collect()
        assert got[0]["record"]["id"] == 5 and got[1]["record"] is None
        sheet = spark.createDataFrame([("A1234567890 A1234567891",), ("A1234567890 A1234567890",)], "row string")
        assert tables.workbook_ids(sheet, "row").count() == 1
        tables.write_csv(sheet, f"{tmp_path}/out.csv")
        assert spark.read.csv(f"{tmp_path}/out.csv", header=True).count() == 2
        assert tables.synthetic_refs(spark, 20, 50, 5).count() > 20


class TestIntegrity:
    def test_reviews(self, spark):
        df = spark.createDataFrame([("l", 1, "verified"), ("l", 2, "rejected"), ("l", 2, "verified"), ("m", 1, "verified")], "link string, at long, status string")
        assert {tuple(r) for r in integrity.review_state(df, "link", "at", "status").collect()} == {("l", "rejected"), ("m", "verified")}

    def test_upsert(self, spark):
        kind = "k string, a string, n long"
        out = integrity.upserted(spark.createDataFrame([("x", "old", 3), ("y", "keep", 1)], kind), spark.createDataFrame([("x", None, 2), ("z", "new", 5)], kind), ["k"], {"a": "new", "n": "min"})
        assert {tuple(r) for r in out.collect()} == {("x", "old", 2), ("y", "keep", 1), ("z", "new", 5)}


def test_stream_equals_batch(spark, tmp_path):
    from lodestone.streaming import events

    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 5} 0{k % 9}:00:00", float(k)) for k in range(40)], "id long, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    s = events.windowed(events.stream(spark, f"{tmp_path}/in", rows.schema), "ts", "1 day", "30 days", [])
    out = f"{tmp_path}/out"
    events.drained(s, lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"), f"{tmp_path}/state", "complete")
    last = spark.read.parquet(out)
    last = last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).select("start", "n", "total")
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in events.windowed(rows, "ts", "1 day", "30 days", []).select("start", "n", "total").collect()}


def test_titles_and_names(spark):
    from lodestone.operators import titles

    works = spark.createDataFrame([("p", 1, "A study of spin waves", 2001), ("p", 2, "Study of spin waves: a review", 2003), ("p", 3, "Other things", 2000), ("p", 4, None, 2004), ("q", 5, "a study of spin waves", 1990)], "person string, work long, title string, year int")
    assert {r["work"]: r["head"] for r in titles.merged_versions(works, "person", "work", "title", "year").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {"Mi-na Lee", "Lee Mina", "Yi, Mi na"} <= set(titles.name_variants("Lee", ["Mi", "na"], {"Lee": ["Lee", "Yi"]}))


class TestConfinedConsole:
    @pytest.mark.parametrize(
        "sql",
        [
            "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS professor_id",
            "SELECT `reflect`('java.lang.System', 'nanoTime') AS professor_id FROM people",
            "SELECT _c0 AS professor_id FROM csv.`/etc/hostname`",
            "SELECT professor_id FROM people WHERE professor_id IN (SELECT _c0 FROM csv.`/etc/hostname`)",
            "SELECT id AS professor_id FROM range(3)",
            "WITH t AS (SELECT 1 AS professor_id) SELECT professor_id FROM other",
        ],
    )
    def test_refused_before_it_runs(self, spark, sql):
        from lodestone.plans import console

        people = spark.createDataFrame([(1,), (2,)], "professor_id long")
        spark.createDataFrame([(1,)], "professor_id long").createOrReplaceTempView("other")
        with pytest.raises(console.Refused):
            console.confined(spark, sql, {"people": people.selectExpr("*")})
        spark.catalog.dropTempView("other")

    def test_views_go_and_results_stay(self, spark):
        from lodestone.plans import console

        people = spark.createDataFrame([(1,), (2,), (2,)], "professor_id long")
        ids, n = console.run(spark, "WITH t AS (SELECT professor_id AS p FROM people) SELECT max(p) OVER () AS professor_id FROM t", {"people": people}, people)
        assert n == 3 and [tuple(r) for r in ids.collect()] == [(2,)] and "people" not in {t.name for t in spark.catalog.listTables()}


class TestTopicQueries:
    def test_words_and_glossary(self, spark):
        assert search.words_of_query("Lithium-ion batteries, (spin) glasses · x") == ["lithium-ion", "battery", "spin", "glass"]
        glossary = spark.createDataFrame([("전자", ["electron"]), ("유전자", ["gene", "gene expression"]), ("물리", ["physics"])], "word string, means array<string>")
        said = lambda *t: {r[0] for r in search.expanded(list(t), glossary).collect()}
        assert said("전자") == {"electron"} and said("spin") == {"spin"} and said("물리학") == {"physics"} and said() == set()
        assert said("유전자학", "x ray") == {"gene", "gene expression", "expression", "electron", "x ray", "x", "ray"}

    def test_scratch_tables_go(self, spark):
        import glob

        from lodestone.operators import staging

        folder = staging.shared_folder(spark).removeprefix("file:")
        with staging.scratch(spark):
            assert staging.staged(spark.range(3)).count() == 3
            there = set(glob.glob(f"{folder}/table-*"))
        assert len(there - set(glob.glob(f"{folder}/table-*"))) == 1


class TestNearest:
    def test_chunks_of_queries_against_all_rows(self, spark):
        import numpy as np
        from lodestone.operators import matrix

        rng = np.random.default_rng(3)
        x = rng.integers(-2, 3, size=(90, 4)).astype(float)  # many ties, some zero vectors
        df = spark.createDataFrame([(int(i) * 3, list(map(float, v))) for i, v in enumerate(x)] + [(999, None)], "i long, v array<float>").repartition(5)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(n > 0, n, 1)
        c = np.round(u @ u.T, 9)
        want = {(i * 3, int(j) * 3, r + 1) for i in range(90) for r, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-c[i, j], j))[:6])}
        for chunk in (4096, 13):
            out = matrix.nearest(df, "i", "v", 6, chunk=chunk)
            assert {(r["id"], r["neighbour"], r["rank"]) for r in out.collect()} == want
        assert "Join" not in matrix.nearest(df, "i", "v", 6)._jdf.queryExecution().executedPlan().toString()  # no pairs of blocks
        assert matrix.nearest(df.limit(0), "i", "v", 6).count() == 0


class TestSharedTransitions:
    def test_same_as_along_links_without_their_pairs(self, spark):
        import random

        rng = random.Random(4)
        items = [(who, i, rng.randrange(4) if who < 3 else 2 * rng.randrange(2), rng.choice("xyz") if rng.random() < 0.9 else None) for who in range(4) for i in range(30)]
        refs = [(who, i, rng.randrange(9)) for who, i, *_ in items for _ in range(rng.choice([0, 1, 1, 3]))] + [(0, 1, None)]
        m = spark.createDataFrame(items, "who long, item long, w long, label string")
        r = spark.createDataFrame(refs, "who long, item long, ref long")
        links = information.neighbour_links(m, r, "who", "item", "w", "ref")
        want = information.transitions(m, "who", "item", "w", "label", links)
        out = information.shared_transitions(m.join(r.groupBy("who", "item").agg(F.collect_set("ref").alias("refs")), ["who", "item"], "left"), "who", "item", "w", "label", "refs")
        rows = lambda df: sorted(((x["who"], x["w"], x["a"] or "", x["b"] or "", round(x["mass"], 9)) for x in df.collect()))
        assert rows(out) == rows(want) and len(rows(out)) > 50
        assert out.columns == want.columns
