"""The pipeline, stage by stage, over small tables with planted cases."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import mixing

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(k, " ".join(f"b{rng.randint(0, 10**6)}" for _ in range(25))) for k in range(5)]
    texts = {}
    for k in range(400):
        texts[k] = [word() for _ in range(rng.randint(30, 120))]
    toxic = set(range(0, 400, 8))
    for k in toxic:
        for _ in range(3):
            texts[k].insert(rng.randrange(len(texts[k])), rng.choice(["idiot", "m0ron", "scum"]))
    leaks = {k: items[k % 5][1] for k in range(3, 43, 8)}
    for k, passage in leaks.items():
        texts[k] += passage.upper().split()
    copies = {}
    for k in range(5, 105, 8):  # exact and near copies of clean documents
        for c in range(3):
            own = list(texts[k])
            if c:
                own[0 if c == 1 else -1] = "changed"
            copies[1000 + 3 * k + c] = k
            texts[1000 + 3 * k + c] = own
    docs = [(k, " ".join(t), "en", f"s{k % 3}", len(" ".join(t))) for k, t in texts.items()]
    docs += [(5000, None, None, None, None), (5001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {"path": path, "toxic": toxic, "leaks": set(leaks), "copies": copies, "docs": {d[0]: d for d in docs}}


def test_stages(spark, tables):
    path, docs = tables["path"], spark.read.parquet(f"{tables['path']}/documents.parquet")
    columns, kept = docs.columns, set(tables["docs"])
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, path).cache()
        rows = out.collect()
        ids = Counter(r["doc_id"] for r in rows)
        if name != "sharding":
            assert out.columns == columns
            assert all(tuple(r) == tables["docs"][r["doc_id"]] for r in rows)
        if name == "toxicity":
            assert set(ids) == kept - tables["toxic"]
        elif name == "near_duplicates":
            groups = defaultdict(set)
            for k in kept - tables["toxic"]:
                groups[tables["copies"].get(k, k) if k < 5000 else 5000].add(k)
            assert set(ids) == {min(g) for g in groups.values()}
        elif name == "decontamination":
            assert set(ids) == set(r["doc_id"] for r in before.collect()) - tables["leaks"]
        elif name == "mixing":
            plan = {r["source"]: r for r in mixing.mix(before).collect()}
            size = lambda r: len((r["text"] or "").split())
            taken = Counter()
            for r in rows:
                taken[r["source"]] += size(r)
            for source, p in plan.items():
                assert abs(taken[source] - p["target"]) <= max(map(size, before.collect()))
        else:
            by = defaultdict(list)
            for r in rows:
                by[r["shard"]].append(r["slot"])
            assert len(rows) == before.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
            assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run_gives_the_same_rows(spark, tables):
    once, again = (sorted(map(str, corpus_pipeline.run(spark, tables["path"]).collect())) for _ in range(2))
    assert once == again and once
