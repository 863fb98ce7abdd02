"""Career inference: spells from evidence, roster reconciliation, appointments, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.periods import term_index
from lodestone.operators import intervals, sets

#: Columns of a career spell.
SPELL = ["person", "stage", "unit", "institution", "start", "end", "kind", "confidence"]


def doctoral(people: DataFrame, years: int = 5) -> DataFrame:
    """[C1] The estimated doctoral spell of people (person, unit, institution, phd_year), in half-years."""
    return people.where("phd_year is not null").select("person", F.lit("doctoral").alias("stage"), "unit", "institution", ((F.col("phd_year") - years) * 2).alias("start"), (F.col("phd_year") * 2 + 1).alias("end"), F.lit("estimate").alias("kind"), F.lit("estimated").alias("confidence"))


def postdocs(evidence: DataFrame, people: DataFrame, faculty: DataFrame) -> DataFrame:
    """[C2, J22] Islands of publication half-years (person, unit, institution, at) at the doctoral unit, after the degree and before
    the first faculty spell."""
    first = faculty.groupBy("person").agg(F.min("start").alias("__first"))
    own = evidence.join(people.select("person", F.col("unit"), F.col("phd_year")), ["person", "unit"]).join(first, "person", "left")
    fit = own.where((F.col("at") > F.col("phd_year") * 2 + 1) & (F.col("__first").isNull() | (F.col("at") < F.col("__first"))))
    return intervals.islands(fit, ["person", "unit", "institution"], "at").select("person", F.lit("postdoc").alias("stage"), "unit", "institution", "start", "end", F.lit("publication").alias("kind"), F.lit("medium").alias("confidence"))


def faculty_posts(evidence: DataFrame, taken: DataFrame, current: DataFrame, least: int = 2, reach: int = 2) -> DataFrame:
    """[C3] Earlier faculty spells: units with at least ``least`` half-years, none of them within a postdoc spell (taken), the last
    at most ``reach``
    before the current post begins (current: person, start)."""
    clash = intervals.covering(evidence.select("person", "unit", "at"), taken.select("person", F.col("start").alias("s"), F.col("end").alias("e")), ["person"], "at", "s", "e").select("person", "unit").distinct()
    n = evidence.groupBy("person", "unit", "institution").agg(F.countDistinct("at").alias("n"), F.min("at").alias("start"), F.max("at").alias("end"))
    fit = n.where(F.col("n") >= least).join(clash, ["person", "unit"], "left_anti").join(current.select("person", F.col("start").alias("__c")), "person")
    return fit.where((F.col("end") < F.col("__c")) & (F.col("end") >= F.col("__c") - reach)).select("person", F.lit("faculty").alias("stage"), "unit", "institution", "start", "end", F.lit("publication").alias("kind"), F.lit("medium").alias("confidence"))


def reclassified(spells: DataFrame, title: Column) -> DataFrame:
    """[C4] Research posts are postdoc spells, unless the same unit has a faculty spell of the person."""
    regular = spells.where((F.col("stage") == "faculty") & ~title).select("person", "unit").distinct().withColumn("__f", F.lit(True))
    moved = (F.col("stage") == "faculty") & title & F.col("__f").isNull()
    return spells.join(regular, ["person", "unit"], "left").withColumn("stage", F.when(moved, "postdoc").otherwise(F.col("stage"))).drop("__f")


def observations(roster: DataFrame, release: int) -> DataFrame:
    """Valid rows (person, unit, institution, at) of a roster (person, unit, institution, year, term, semester)."""
    at = term_index(F.col("term"))
    ok = at.isNotNull() & F.col("year").isNotNull() & (F.floor(at / 2) == F.col("year")) & F.col("year").between(1900, release) & F.col("unit").isNotNull() & F.col("institution").isNotNull()
    named = F.col("semester").isNull() | (F.col("semester") == F.regexp_extract("term", r"-(\w+)$", 1))
    return roster.where(ok & named).select("person", "unit", "institution", at.alias("at")).distinct()


def reconciled(careers: DataFrame, observed: DataFrame) -> DataFrame:
    """[C5, W3, W4] Careers (SPELL; kind verified, inferred, publication, ...) with observed faculty half-years (person, unit,
    institution, at).

    Observed half-years become spells, one for each run; a gap is never bridged. Where no half-year of a person has two units:
    inferred faculty spells during
    which another unit alone was observed go, and publication postdoc spells lose the half-years at which the unit was observed.
    Where one has, nothing
    is taken away and the observed spells are of medium confidence. At last, faculty spells of a unit that overlap or adjoin are merged.
    """
    per = observed.groupBy("person", "at").agg(F.count("*").alias("k"), F.first("unit").alias("only"), F.first("institution").alias("only_name"))
    vague = per.groupBy("person").agg(F.max(F.col("k") > 1).alias("vague"))
    spells = careers.join(vague, "person", "left").withColumn("vague", F.coalesce("vague", F.lit(True)))  # a person without a roster keeps all
    faculty = (F.col("stage") == "faculty") & (F.col("kind") != "verified") & ~F.col("vague") & F.col("start").isNotNull() & F.col("end").isNotNull()
    same = F.when(F.col("unit").isNotNull(), F.col("unit") == F.col("only")).otherwise(F.col("institution") == F.col("only_name"))
    inferred = spells.where(faculty)
    against = inferred.join(per.where("k = 1"), "person").where((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end")) & ~same).select(*SPELL).distinct()
    keep = [F.col(f"i.{c}").eqNullSafe(F.col(f"x.{c}")) for c in SPELL]
    stay = inferred.select(*SPELL).alias("i").join(against.alias("x"), keep, "left_anti")
    post = (F.col("stage") == "postdoc") & (F.col("kind") == "publication") & ~F.col("vague") & F.col("unit").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    cut = spells.where(post).select(*SPELL, F.sequence("start", "end").alias("__all")).withColumn("at", F.explode("__all")).drop("__all")
    cut = cut.join(observed.select("person", "unit", "at").distinct(), ["person", "unit", "at"], "left_anti").withColumnsRenamed({"start": "__s", "end": "__e"})
    parts = intervals.islands(cut, ["person", "stage", "unit", "institution", "__s", "__e", "kind", "confidence"], "at").select(*SPELL)
    rest = spells.where(~(faculty | post)).select(*SPELL)
    seen = intervals.islands(observed, ["person", "unit", "institution"], "at").join(vague, "person").select("person", F.lit("faculty").alias("stage"), "unit", "institution", "start", "end", F.lit("observed").alias("kind"), F.when(F.col("vague"), "medium").otherwise("confirmed").alias("confidence"))
    all_ = stay.unionByName(parts).unionByName(rest).unionByName(seen)
    joined = intervals.merged(all_.where("stage = 'faculty'"), ["person", "stage", "unit", "institution"], "start", "end", 1, [F.min_by("kind", F.struct("start", "kind")).alias("kind"), F.min_by("confidence", F.struct("start", "kind")).alias("confidence")], ["kind"])
    return all_.where("stage <> 'faculty'").unionByName(joined.select(*SPELL))


def departments(spells: DataFrame, labels: DataFrame) -> DataFrame:
    """[C6] Each spell's (spell, unit, start, end) department: the one label (unit, at, label) within it, else null with a reason."""
    found = intervals.covering(labels, spells, ["unit"], "at", "start", "end").groupBy("spell").agg(F.countDistinct("label").alias("k"), F.min("label").alias("label"))
    return spells.select("spell").join(found, "spell", "left").select("spell", F.when(F.col("k") == 1, F.col("label")).alias("department"), F.when(F.col("k").isNull(), "none").when(F.col("k") > 1, "ambiguous").alias("reason"))


def appointments(observed: DataFrame) -> DataFrame:
    """[C7] (person, year, unit, terms) and, of the last half-year, whether it is the person's current one."""
    rows = observed.groupBy("person", F.floor(F.col("at") / 2).alias("year"), "unit").agg(F.array_sort(F.collect_set("at")).alias("terms"), F.max("at").alias("last"))
    return rows.withColumn("current", F.col("last") == F.max("last").over(Window.partitionBy("person"))).drop("last")


def candidates(works: DataFrame, people: DataFrame, faculty: DataFrame, least: int = 2) -> DataFrame:
    """[C8] (person, unit, start, end, n): units of at least so many works (person, work, unit, at) after the degree and before the
    first faculty post."""
    first = faculty.groupBy("person").agg(F.min("start").alias("__f"))
    fit = works.join(people.select("person", "phd_year"), "person").join(first, "person", "left").where((F.col("at") > F.col("phd_year") * 2 + 1) & (F.col("__f").isNull() | (F.col("at") < F.col("__f"))))
    return fit.groupBy("person", "unit").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.countDistinct("work").alias("n")).where(F.col("n") >= least)


def invalid_spells(spells: DataFrame) -> DataFrame:
    """[C9] Spells that end before they begin, or begin before an earlier one of the person and stage has ended: with a reason."""
    w = Window.partitionBy("person", "stage").orderBy("start", "end", "unit")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spells.withColumn("reason", F.when(F.col("end") < F.col("start"), "order").when(F.col("start") <= before, "overlap")).where("reason is not null")


def first_appointments(spells: DataFrame) -> DataFrame:
    """[C10, W6] Each person's first faculty unit, null if several begin at once."""
    f = spells.where("stage = 'faculty'")
    least = f.groupBy("person").agg(F.min("start").alias("start"))
    return f.join(least, ["person", "start"]).groupBy("person", "start").agg(F.when(F.countDistinct("unit") == 1, F.min("unit")).alias("unit"))


#: [C12] Which of a peer's stages count for one's own.
ALLOWED = {"doctoral": ("doctoral", "faculty"), "postdoc": ("doctoral", "postdoc", "faculty"), "first_faculty": ("doctoral", "faculty"), "current": ("current",)}


def permitted(own: Column, other: Column) -> Column:
    out = F.lit(False)
    for stage, others in ALLOWED.items():
        out = out | ((own == stage) & other.isin(*others))
    return out


def peers(ego: DataFrame, spells: DataFrame) -> DataFrame:
    """[C13, J8, G20] (person, n, share): others who shared stage, unit and year with the ego's spells, by permitted stages; the
    share is of the ego's stage-unit-years.
    ego: stage, unit, start, end of one person, which are few."""
    mine = intervals.points_of(ego.select("stage", "unit", "start", "end"), "start", "end", "at").select(F.col("stage").alias("own"), "unit", "at").distinct()
    total = mine.count()
    theirs = intervals.points_of(spells.select("person", "stage", "unit", "start", "end"), "start", "end", "at").select("person", "stage", "unit", "at").distinct()
    met = theirs.join(mine, ["unit", "at"]).where(permitted(F.col("own"), F.col("stage"))).select("person", "own", "unit", "at").distinct()
    return met.groupBy("person").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / max(total, 1), 6))


def ego_hypergraph(ego: DataFrame, spells: DataFrame) -> DataFrame:
    """[G20] One row for each of the egos' spells that others share: ego, stage, unit, start, end, members (the ego among them,
    sorted), evidence (for each spell of a peer that overlaps: person, stage, from, to of the common time, and the years of it;
    sorted),
    redundancy and weight among the ego's edges, as ``sets.weights`` has them.

    ego: ego, stage, unit, start, end, of a few people; spells: person, stage, unit, start, end. Peers' stages are those that the
    ego's permits; the ego is no peer of its own. Evidence travels with its edge from the overlap on and isn't looked up again.
    """
    own = ego.select("ego", F.col("stage").alias("own"), "unit", F.col("start").alias("from0"), F.col("end").alias("to0")).distinct()
    met = spells.join(own, "unit").where((F.col("start") <= F.col("to0")) & (F.col("end") >= F.col("from0")) & (F.col("person") != F.col("ego")) & permitted(F.col("own"), F.col("stage")))
    first, last = F.greatest("start", "from0"), F.least("end", "to0")
    found = F.struct("person", "stage", first.alias("from"), last.alias("to"), (last - first + 1).cast("long").alias("years"))
    key = ["ego", "own", "unit", "from0", "to0"]
    edges = met.groupBy(*key).agg(F.array_sort(F.collect_set(found)).alias("evidence"))
    members = F.array_sort(F.array_distinct(F.concat(F.array("ego"), F.transform("evidence", lambda e: e["person"]))))
    edges = edges.withColumn("members", members).withColumn("edge", F.struct("own", "unit", "from0", "to0"))
    weights = sets.weights(edges.select("edge", "ego", F.explode("members").alias("node")), "edge", "node", ["ego"])
    return edges.join(weights.select("ego", "edge", "redundancy", "weight"), ["ego", "edge"]).select("ego", F.col("own").alias("stage"), "unit", F.col("from0").alias("start"), F.col("to0").alias("end"), "members", "evidence", "redundancy", "weight")


def country_conflicts(people: DataFrame, school: str, country: str) -> DataFrame:
    """[C14] Schools with several countries over the whole population: counted before any filter."""
    n = people.where(F.col(country).isNotNull()).groupBy(school).agg(F.countDistinct(country).alias("__k"))
    return people.join(n, school, "left").withColumn("conflict", F.coalesce(F.col("__k") > 1, F.lit(False))).drop("__k")


def intervals_with_coverage(people: DataFrame, estimate: int = 5) -> DataFrame:
    """[C15, A43] (person, start, end, estimated, reason) from actual years where both are there and in order, else the degree
    year's estimate, else a reason."""
    actual = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end"))
    known = F.col("phd_year").isNotNull()
    return people.select("person", F.when(actual, F.col("start")).when(known, F.col("phd_year") - estimate).alias("start"), F.when(actual, F.col("end")).when(known, F.col("phd_year")).alias("end"), (~actual & known).alias("estimated"), F.when(~actual & ~known, "no_time").alias("reason"))
