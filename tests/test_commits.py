"""Stores with logs and the collector: crashes, conflicts, resumed runs."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.collector import Collector
from lodestone.sources.commits import Conflict, Manifest, Migration, Store, Violated, content_key


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, f"t{k % 3}", k * 1.5 if k % 4 else None) for k in range(40)], "id long, name string, price double")


def kept(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_key_is_of_the_rows_alone(rows):
    key = content_key(rows)
    assert key == content_key(rows.repartition(5).orderBy(F.desc("id"))) == content_key(rows.select("price", "id", "name")) and key[1] == 40
    for other in (rows.unionByName(rows.limit(1)), rows.where("id > 0"), rows.withColumn("price", F.coalesce("price", F.lit(0.0))), rows.withColumnRenamed("price", "cost")):
        assert content_key(other) != key


def test_importing_twice_equals_once(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.read() is None and s.manifest().number == 0
    s.append(rows)
    before = kept(s.read(), "id", "name", "price", "_commit")
    assert s.append(rows.repartition(3)).number == 1 and kept(s.read(), "id", "name", "price", "_commit") == before
    s.append(rows.where("id < 3"))  # other rows than any batch
    assert s.manifest().number == 2 and s.read().count() == 43


def test_a_failed_check_leaves_the_earlier_version(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(rows)
    with pytest.raises(Violated, match="price: 1[0-9]"):
        s.append(rows.withColumn("id", F.col("id") + 100), {"price": F.col("price") >= 0})
    assert s.manifest().number == 1 and s.read().count() == 40
    assert len(list((tmp_path / "s/data").iterdir())) == 1


def test_a_crash_before_publishing_changes_nothing(spark, rows, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(rows)

    def dies(made):
        raise KeyboardInterrupt

    monkeypatch.setattr(s, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        s.append(rows.where("id < 9"))
    again = Store(spark, s.path)
    assert again.read().count() == 40 and again.append(rows.where("id < 9")).number == 2 and again.read().count() == 49


def test_of_two_writers_one_wins(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(rows)
    with pytest.raises(Conflict):
        s._publish(Manifest(1, "batch", []))
    assert s.manifest().kind == "batch" and s.read().count() == 40 and s.numbers() == [1]


def test_overlay_and_rollback(spark, rows, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(rows)
    s.overlay(rows.where("id < 2").withColumn("name", F.lit("new")))
    s.overlay(rows.where("id = 1").withColumn("name", F.lit("newer")))
    assert kept(s.current(["id"]).where("id < 3"), "id", "name", "_commit") == [(0, "new", 2), (1, "newer", 3), (2, "t2", 1)]
    assert kept(s.current(["id"], 2).where("id < 2"), "name") == [("new",), ("new",)]
    s.rollback(1)
    assert kept(s.current(["id"]).where("id < 2"), "id", "name") == [(0, "t0"), (1, "t1")] and s.manifest().of == 1
    s.rollback(3)
    assert kept(s.current(["id"]).where("id = 1"), "name") == [("newer",)]


def test_migration_round_trip(spark, rows, tmp_path):
    steps = [Migration(2, {"key": "id", "name": "name", "price": "price"}, ["key"], ["id"]), Migration(3, {"key": "key", "label": "upper(name)", "price": "price"}, ["key"])]
    s = Store(spark, f"file://{tmp_path}/s", steps)
    s.append(rows)
    assert s.migrate(1).number == 1
    made = s.migrate(3)
    assert (made.schema, made.kind, s.read().columns) == (3, "migration", ["key", "label", "price", "_commit"])
    s.append(spark.createDataFrame([(99, "X", 1.0)], "key long, label string, price double"))
    assert kept(s.read().where("key in (1, 99)"), "key", "label", "_commit") == [(1, "T1", 1), (99, "X", 3)]
    assert s.read(1).columns == ["id", "name", "price", "_commit"]
    s.rollback(1)
    assert kept(s.read(), "id", "name", "price") == kept(rows, "id", "name", "price")


@pytest.mark.parametrize("bad", ["id + 1", "id % 7", "cast(null as bigint)"])
def test_a_migration_that_changes_keys_is_refused(spark, rows, tmp_path, bad):
    s = Store(spark, f"file://{tmp_path}/s", [Migration(2, {"id": bad}, ["id"])])
    s.append(rows)
    with pytest.raises(Violated, match="changes keys"):
        s.migrate(2)
    assert s.manifest().schema == 1 and s.read().count() == 40


def test_a_run_that_stops_after_any_batch_resumes(spark, tmp_path):
    links = [(k, (k * 5 + j) % 37) for k in range(30) for j in range(3)]
    edges = spark.createDataFrame(links, "src long, dst long")
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "node long")

    def collector(name, **more):
        stores = [Store(spark, f"file://{tmp_path}/{name}-{x}") for x in ("edges", "ledger")]
        return Collector(*stores, lambda nodes: edges.join(nodes, F.col("src") == F.col("node")).select("src", "dst"), size=4, **more)

    whole = collector("whole")
    n = whole.run(seeds, 2)
    want = kept(whole.states(seeds, 2), "node", "layer", "status", "tries", "n")
    assert {r[2] for r in want} == {"complete"} and n == 3
    first = collector("parts").plan(seeds, 2)
    assert (first.layer, first.nodes, first.batches, first.waiting) == (1, 3, 1, 1)
    done = 0
    while step := collector("parts").run(seeds, 2, most=1 + done):
        done += step
    assert done == n and kept(collector("parts").states(seeds, 2), "node", "layer", "status", "tries", "n") == want
    quiet = collector("quiet", tries=2, failed=lambda node: node == 1)
    quiet.run(seeds, 1)
    assert kept(quiet.states(seeds, 1), "node", "status", "tries") == [(0, "complete", 1), (1, "lost", 2), (2, "complete", 1)]
