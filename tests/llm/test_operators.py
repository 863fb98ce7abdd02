"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, lm, mixing, sharding, simhash, tokens, topk, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, density double, number int, __extra array<string>"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def random_text(rng, n, vocabulary=30):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(k, random_text(rng, rng.randint(1, 60)), f"s{k % 4}") for k in range(80)]
    rows += [(k, "The same text\tagain é Ü and\nmore of it", "s0") for k in range(80, 110)]
    rows += [(110, None, "s1"), (111, "", None), (112, " \t ", None), (None, "no id here", "s2"), (113, "one", "s3"), (114, random_text(rng, 5000), "s3")]
    rows += [(5, rows[5][1], "s1")] * 2
    return spark.createDataFrame([(*r, 1.0, 2, ["x"]) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def trained(doc_id):
    return doc_id is not None and doc_id % 3 != 0


class TestLanguageModel:
    @pytest.mark.parametrize("buckets", [4, 8, 64, 200])
    def test_blocks_go_to_all_tasks(self, buckets):
        for tasks, blocks in ((buckets, 1), (buckets, 3), (1000, 2), (3, 200)):
            found = Counter(lm.home((part << 24) + k, buckets) for part in range(tasks) for k in range(blocks))
            even = tasks * blocks / buckets
            assert max(found.values()) <= even + min(tasks, blocks) and len(found) == min(buckets, tasks + blocks - 1)

    def test_rows_of_many_blocks_leave_by_many_tasks(self, spark):
        docs = spark.range(4000).repartition(4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 50), 10)).alias("text"))
        out = lm.backoff_scores(docs, "doc_id", "text", F.lit(True), block_tokens=2000)
        rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) == 4 and max(rows) < 1.2 * 1000

    def brute(self, rows, order, mu):
        counts = Counter()
        for doc_id, text in rows:
            if trained(doc_id):
                said = ["</s>", *words(text), "</s>"]
                for n in range(1, order + 1):
                    for k in range(1, len(said)):
                        if k - n + 1 >= 0:
                            counts[tuple(said[k - n + 1 : k + 1])] += 1
        unigrams = {g[0]: c for g, c in counts.items() if len(g) == 1}
        n, v = sum(unigrams.values()), len(unigrams)
        n1, n2 = (sum(c == k for c in unigrams.values()) for k in (1, 2))
        d = min(0.999, max(0.001, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

        def p(context, w):
            if not context:
                return (unigrams[w] - d) / n if w in unigrams else (d * v / n if n else 1.0)
            seen = unigrams.get(context[0], 0) if len(context) == 1 else counts[context]
            m = mu[len(context) + 1]
            return (counts[(*context, w)] + m * p(context[1:], w)) / (seen + m)

        out = []
        for doc_id, text in rows:
            said = ["</s>", *words(text), "</s>"]
            score = sum(math.log10(p(tuple(said[max(0, k - order + 1) : k]), said[k])) for k in range(1, len(said)))
            base = sum(math.log10((unigrams.get(w, 0) + 1) / (n + v + 1)) for w in said[1:])
            out.append((doc_id, len(said) - 1, sum(w in unigrams for w in said[1:]), n, base, score))
        return out

    @pytest.mark.parametrize(("order", "block"), [(3, 150), (2, 10_000), (1, 1)])
    def test_equals_a_walk_over_counts(self, docs, order, block):
        got = lm.backoff_scores(docs, "doc_id", "text", F.col("doc_id") % 3 != 0, order=order, block_tokens=block).collect()
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 6))
        want = sorted(self.brute(rows, order, lm.MU), key=key)
        have = sorted(((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
        assert [x[:4] for x in have] == [x[:4] for x in want]
        assert np.allclose([x[4:] for x in have], [x[4:] for x in want])

    def test_states_and_failure_arcs(self):
        """a b a b c: the states, arcs and failure arcs by hand."""
        names = ["a", "b", "c", "end"]
        hashes = np.array([11, 22, 33, int(lm.END)], np.uint64)
        codes = np.array([0, 1, 0, 1, 2, 3])
        grams = lm.Grams(hashes, codes, np.array([True] + [False] * 5), 3)
        totals = [np.bincount(at[at >= 0], minlength=len(h)).astype(np.uint32) for at, h in zip(grams.at, grams.hashes, strict=True)]
        model = lm.Automaton(grams, totals, np.array([6, 4, 2, 2]), {2: 1.0, 3: 1.0})
        word = {x: int(grams.at[0][codes.tolist().index(k)]) for k, x in enumerate(names)}
        pair = {p: int(grams.at[1][t]) for t, p in enumerate(["end a", "a b", "b a", "a b", "b c", "c end"])}
        state = {"": 0} | {x: 1 + k for x, k in word.items()} | {p: 1 + len(word) + k for p, k in pair.items()}
        assert all(model.failure[state[x]] == 0 for x in names) and all(model.failure[state[p]] == state[p.split()[1]] for p in pair)
        assert math.isclose(model.cost[state["a b"]], math.log10(1 / 3)) and math.isclose(model.cost[state["c"]], math.log10(1 / 2))
        arcs = {(int(o), int(t)) for k in range(3) for o, t, n in zip(model.origin[k], model.target[k], totals[k], strict=True) if n}
        want = {(state[""], state[x]) for x in names} | {(state[p.split()[0]], state[p]) for p in pair}
        want |= {(state["end a"], state["a b"]), (state["a b"], state["b a"]), (state["b a"], state["a b"]), (state["a b"], state["b c"]), (state["b c"], state["c end"])}
        assert arcs == want
        whole = model.walk()
        assert all(np.allclose(model.walk(piece), whole) for piece in (1, 2, 3, 5))

    def test_copies_in_training_show(self, spark):
        """A held-out text of which training holds a copy scores higher than one of which it holds none; a text that training holds twice higher than once."""
        rng = random.Random(8)
        text = lambda: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(40))
        rows = [(k, text(), True) for k in range(300)]
        rows += [(1000 + k, rows[k][1], False) for k in range(20)] + [(2000 + k, text(), False) for k in range(20)] + [(3000 + k, rows[30 + k][1], True) for k in range(20)]
        got = {r["id"]: r["score"] / r["n_tokens"] for r in lm.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), "doc_id", "text", F.col("t")).collect()}
        assert min(got[1000 + k] for k in range(20)) > max(got[2000 + k] for k in range(20)) and np.mean([got[30 + k] for k in range(20)]) > np.mean([got[60 + k] for k in range(200)])

    def test_conditional_probabilities_sum_to_one(self):
        codes = np.array([1, 2, 1, 2, 0, 1, 1, 0])  # 0: the end
        hashes = np.array([lm.END, 7, 9], np.uint64)
        grams = lm.Grams(hashes, codes, np.array([1, 0, 0, 0, 0, 1, 0, 0], bool), 2)
        assert len(grams.hashes[0]) == 3 and len(grams.hashes[1]) == len({(0, 1), (1, 2), (2, 1), (2, 0), (1, 1), (1, 0)})

    def test_nothing_and_no_training(self, none, docs):
        assert lm.backoff_scores(none, "doc_id", "text", F.lit(True)).collect() == []
        assert {r["score"] for r in lm.backoff_scores(docs, "doc_id", "text", F.lit(None).cast("boolean")).collect()} == {0.0}

    def test_packing(self):
        arrays = [np.array([5, 2**63], np.uint64), np.zeros(0, np.int64), np.array([True, False]), np.arange(1000, dtype=np.uint16)]
        assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True))


def brute_fingerprint(text):
    said = words(text)
    shingles = [" ".join(said[k : k + 3]) for k in range(len(said) - 2)] if len(said) >= 3 else [" ".join(said)] if said else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fs}


class TestSimHash:
    def test_fingerprints_and_classes(self, docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        fp = [brute_fingerprint(t) for _, t in rows]
        assert [simhash.fingerprint(t) for _, t in rows] == fp
        root = brute_components(set(fp), 2)
        least = {}
        for (i, _), f in zip(rows, fp, strict=True):
            if i is not None:
                least[root[f]] = min(i, least.get(root[f], i))
        want = Counter((i, f, least.get(root[f])) for (i, _), f in zip(rows, fp, strict=True))
        assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(docs).collect()) == want

    @pytest.mark.parametrize("bucket", [2, 1000])
    @pytest.mark.parametrize("distance", [0, 1, 2])
    def test_links_lose_none(self, spark, bucket, distance):
        rng = random.Random(distance)
        fps = {0, 1, 3, 7, 15, 31, (1 << 64) - 1, 1 << 63}
        for _ in range(12):
            center = rng.getrandbits(64)
            for _ in range(12):
                fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
        pairs = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance, bucket)
        roots = {signed[r["node"]]: signed[r["root"]] for r in simhash.components(pairs).collect()}
        classes = defaultdict(set)
        for f in fps:
            classes[roots.get(f, f)].add(f)
        want = defaultdict(set)
        for f, r in brute_components(fps, distance).items():
            want[r].add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))

    @pytest.mark.parametrize("used", [[(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(0, 64, 2)), 0), (list(range(1, 64, 2)), 1)], [(list(range(64)), 2)]])
    def test_unequal_thresholds_lose_none(self, spark, monkeypatch, used):
        rng = random.Random(4)
        fps = {rng.getrandbits(64) for _ in range(20)}
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for f in list(fps) for _ in range(3)}
        signed = {simhash.signed(f): f for f in fps}
        monkeypatch.setattr(simhash, "plan", lambda *_: used)
        got = {(signed[r["a"]], signed[r["b"]]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2, 100_000).collect()}
        assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}

    def test_hubs(self, spark, monkeypatch):
        monkeypatch.setattr(simhash, "HUB_ROWS", 5)
        pairs = spark.createDataFrame([(9, k) for k in range(10, 60)] + [(k, 100) for k in range(70, 90)] + [(59, 100), (200, 201)], "a long, b long")
        want = {(k, 9) for k in (*range(10, 60), *range(70, 90), 100)} | {(201, 200)}
        assert {(r["node"], r["root"]) for r in simhash.components(pairs).collect()} == want

    def test_a_long_chain(self, spark):
        pairs = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
        assert {(r["node"], r["root"]) for r in simhash.components(pairs).collect()} >= {(k, 0) for k in range(1, 301)}

    def test_thresholds(self):
        assert simhash.allocate([[1, 9], [1, 9], [1, 9]], 0) == (3.0, [0, 0, 0])
        assert simhash.allocate([[100, 101], [5, 500]], 1)[1] == [1, 0]
        assert simhash.allocate([[100, 101, 102], [1e9] * 3], 1)[1] == [2, -1]

    def test_one_of_each_stays(self, docs, none):
        rows, kept = docs.collect(), simhash.deduplicated(docs).collect()
        root = self.classes([r["text"] for r in rows])
        key = lambda r: root[" ".join(words(r["text"]))]
        assert Counter(map(key, kept)) == Counter(set(root.values()))
        least = {}
        for r in rows:
            if r["doc_id"] is not None:
                least[key(r)] = min(r["doc_id"], least.get(key(r), 1 << 60))
        assert {key(r): r["doc_id"] for r in kept} == {k: least.get(k) for k in set(root.values())}
        assert kept[0].asDict().keys() == rows[0].asDict().keys()
        assert simhash.deduplicated(none).collect() == [] == simhash.near_duplicates(none).collect()

    def classes(self, texts):
        """Class of each word sequence: fingerprints two bits or fewer apart, or four fifths of the five-word shingles in common."""
        seqs = sorted({" ".join(words(t)) for t in texts})
        fps = [brute_fingerprint(s) for s in seqs]
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(words, seqs)]
        root = list(range(len(seqs)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(seqs)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        return {s: find(k) for k, s in enumerate(seqs)}

    def test_near_copies_of_long_texts(self, spark):
        rng = random.Random(9)
        rows = []
        for g in range(12):
            base = [f"g{g}w{rng.randint(0, 5000)}" for _ in range(150)]
            for c in range(6):
                own = list(base)
                for _ in range(rng.randint(0, 3)):
                    own[rng.randrange(150)] = f"x{rng.random()}"
                rows.append((len(rows), " ".join(own)))
        rows += [(1000 + k, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60))) for k in range(40)]
        kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        root = self.classes([t for _, t in rows])
        assert len(kept) == len(set(root.values())) and set(kept) >= {1000 + k for k in range(40)}

    def kept(self, spark, texts):
        return sorted(r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())

    def test_similar_texts_with_far_fingerprints(self, spark):
        """Pairs of at least the similarity whose fingerprints are 12 to 14 bits apart, among many others."""
        rng, texts = random.Random(21), []
        while len(texts) < 80:
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
            line = [f"w{rng.randint(0, 10**6)}" for _ in range(4)]
            pair = [" ".join(base), " ".join(base + line * rng.randint(2, 6))]
            a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, pair))
            if 12 <= (brute_fingerprint(pair[0]) ^ brute_fingerprint(pair[1])).bit_count() <= 14 and len(a & b) >= 0.8 * len(a | b):
                texts += pair
        texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(8)) for _ in range(3000)]
        assert self.kept(spark, texts) == [*range(0, 80, 2), *range(80, len(texts))]

    def test_similar_texts_in_a_crowd(self, spark):
        """Texts that share two thirds of their words, so their fingerprints crowd together, and near copies of some of them."""
        rng, texts = random.Random(22), []
        common = [f"c{k}" for k in range(60)]
        while len(texts) < 120:
            base = common + [f"w{rng.randint(0, 10**6)}" for _ in range(36)]
            other = [*base[:-5], *(f"v{rng.randint(0, 10**6)}" for _ in range(5))]
            pair = [" ".join(base), " ".join(other)]
            if 7 <= (brute_fingerprint(pair[0]) ^ brute_fingerprint(pair[1])).bit_count() <= 11:
                texts += pair
        texts += [" ".join(common + [f"u{rng.randint(0, 10**6)}" for _ in range(36)]) for _ in range(400)]
        root, least = self.classes(texts), {}
        for k, t in enumerate(texts):
            least.setdefault(root[t], k)
        assert self.kept(spark, texts) == sorted(least.values())

    def test_a_repeated_line_hides_no_copy(self, spark):
        """The line's shingles count once for the similarity, but each time for the fingerprint."""
        rng, texts = random.Random(23), []
        for _ in range(20):
            base, line = ([f"w{rng.randint(0, 10**6)}" for _ in range(n)] for n in (200, 10))
            texts += [" ".join(base), " ".join(base + line * 60)]
        far = [(brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() for a, b in zip(texts[::2], texts[1::2], strict=True)]
        assert min(far) > 14
        assert self.kept(spark, texts) == [*range(0, 40, 2)]

    @pytest.mark.parametrize(("few", "low", "crowded"), [(16, simhash.LOW, False), (16, 1 << 60, False), (2, simhash.LOW, True), (2, 1 << 63, True)])
    def test_passages_of_many_texts_make_no_crowd(self, spark, monkeypatch, few, low, crowded):
        """Passages too rare for the sample, each in some 50 texts: only texts with too few words of their own file them."""
        rng, texts, filed = random.Random(24), [], []
        passages = [[f"p{rng.randint(0, 10**6)}" for _ in range(20)] for _ in range(12)]
        for k in range(300):
            own = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
            texts.append(" ".join(own + sum(rng.sample(passages, 2), [])))
            if k % 10 == 0:
                texts.append(" ".join([*own[:-4], *texts[-1].split()[60:]]))
        if crowded:  # nothing of their own, and pairs that share more or less than four fifths
            texts += [" ".join(sum(rng.sample(passages, rng.randint(5, 9)), [])) for _ in range(40)]
            texts += [" ".join(passages[k % 3] + passages[3] + passages[4] + passages[5][: rng.randint(4, 20)]) for k in range(60)]
        inner = simhash.apart_links
        monkeypatch.setattr(simhash, "SAMPLE", 1)
        monkeypatch.setattr(simhash, "FEW", few)
        monkeypatch.setattr(simhash, "LOW", low)
        monkeypatch.setattr(simhash, "apart_links", lambda many, *rest: filed.append(many.count()) or inner(many, *rest))
        root, least = self.classes(texts), {}
        for k, t in enumerate(texts):
            least.setdefault(root[" ".join(words(t))], k)
        assert self.kept(spark, texts) == sorted(least.values())
        assert crowded or filed == [0]

    def test_memory_of_a_block_is_that_of_some_rows(self):
        rng = np.random.default_rng(3)
        base = rng.integers(-(1 << 62), 1 << 62, (100, 8))
        sketches = [(base[k % 100] ^ (1 << k // 100)).tolist() for k in range(1000)]
        t = pa.table({"th": range(1000), "n": [400] * 1000, "root": range(1000), "near": [True] * 1000, "sketch": sketches})
        block = simhash.Block(t, 0.8)
        tracemalloc.start()
        try:
            got = [(a, b) for i, j in block.candidates() for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert sorted(got) == [(a, b) for a in range(1000) for b in range(a + 100, 1000, 100)] and peak < 8 << 20


class TestTokens:
    @pytest.mark.parametrize("rule", tokens.RULES)
    def test_every_token_goes_to_one_section(self, docs, rule):
        tokenizer, _ = tokens.encoding(tokens.TOKENIZER)
        texts = Counter(((r["doc_id"], r["text"] or "") for r in docs.collect()))
        rows = defaultdict(list)
        for r in tokens.section_tokens(docs, rule=rule).collect():
            rows[r["doc_id"]].append(r)
        for (doc_id, text), times in texts.items():
            own = [r for r in rows[doc_id] if r["char_end"] <= len(text)]
            assert sum(r["n_tokens"] for r in own) == times * len(tokenizer.encode_ordinary(text))
            assert len(own) == times * max(1, len(re.findall(r"[^\n]*\n|[^\n]+", text)))

    def test_rules_differ_on_a_token_over_a_border(self):
        ends, spans = np.array([4, 10]), np.array([3, 8, 10])
        assert tokens.owners(ends, spans, "start").tolist() == [0, 0, 1]
        assert tokens.owners(ends, spans, "end").tolist() == [0, 1, 1]
        assert tokens.owners(ends, spans, "most").tolist() == [0, 1, 1]
        assert tokens.owners(np.array([2, 4]), np.array([4]), "most").tolist() == [0]

    def test_spans_are_code_points(self, spark, none):
        got = tokens.section_tokens(spark.createDataFrame([(1, "é\nÜber")], "doc_id long, text string")).orderBy("section").collect()
        assert [(r["char_start"], r["char_end"]) for r in got] == [(0, 2), (2, 6)]
        assert tokens.section_tokens(none).collect() == []


class TestMixing:
    def test_targets_by_hand(self, spark):
        sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
        # budget 3150; a and null stop at 20 and 180; b and c share 2950 as 2 to 1, so b has 1966.7
        assert got["a"] == 20 and got[None] == 180 and math.isclose(got["b"], 2950 * 2 / 3) and math.isclose(got["c"], 2950 / 3)

    def test_sums_come_near_targets(self, docs, none):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        assert Counter(r["id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
        by = defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
        total = sum(r["size"] for r in rows)
        assert math.isclose(sum(v[0]["target"] for v in by.values()), 1.5 * total)
        for own in by.values():
            times = Counter((r["id"], r["place"]) for r in own)
            group = max(r["size"] * times[r["id"], r["place"]] for r in own)
            assert sum(r["size"] for r in own) == own[0]["source_size"]
            assert abs(sum(r["size"] * r["taken_times"] for r in own) - own[0]["target"]) <= group / 2 + 1e-6
            assert {r["taken_times"] for r in own} <= {0, 1, 2}
        assert mixing.mix(none).collect() == [] == mixing.repeated(none).collect()

    def test_reruns_agree_and_rows_are_repeated(self, docs):
        once, again = (sorted((str(r["id"]), r["place"], r["taken_times"]) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
        assert once == again
        assert mixing.repeated(docs).count() == sum(x[2] for x in once)
        assert mixing.repeated(docs).columns == docs.columns


class TestUrls:
    def test_hosts_paths_and_fixed_rules(self, spark):
        rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]
        rows = [(1, "https://A.Example.ORG/es/1?x"), (2, "http://example.org"), (3, "x://a.com/de/#f"), (4, None), (5, "nothing"), (6, "http://notexample.org/es/"), (7, "a://b?c://d/e"), (1, "https://A.Example.ORG/es/1?x")]
        pages = spark.createDataFrame(rows, "page_id long, url string")
        got = Counter(tuple(r)[:5] for r in urls.judged(pages, spark.createDataFrame([], "url string, bad boolean"), rules).collect())
        assert got == Counter(
            [(1, "a.example.org", "/es/1", "example.org/es/", "block")] * 2
            + [(2, "example.org", "", None, "allow"), (3, "a.com", "/de/", "com/de/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "notexample.org", "/es/", "org/", "allow"), (7, "b", "", None, "allow")]
        )
        assert urls.judged(pages.limit(0), pages.limit(0).select("url", F.lit(True).alias("bad")), rules).collect() == []

    @pytest.mark.parametrize("wide", [0, 2, 3, 12])
    def test_mined_rules_are_those_of_brute_force(self, spark, wide):
        rng = random.Random(1)
        rows = [(sorted(rng.sample("abcdef", rng.randint(1, 4))),) for _ in range(300)]
        rows = [(t, ("a" in t and "b" in t) if rng.random() < 0.9 else rng.random() < 0.3) for (t,) in rows]
        got = urls.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, wide=wide)
        from itertools import combinations

        want = {}
        for n in (1, 2, 3):
            for t in combinations("abcdef", n):
                hit = [bad for tokens_, bad in rows if set(t) <= set(tokens_)]
                if hit and sum(hit) >= max(3, 0.02 * len(rows)) and sum(hit) / len(hit) >= 0.6 and not any(set(o) < set(t) and c >= sum(hit) / len(hit) for o, c in want.items()):
                    want[t] = sum(hit) / len(hit)
        assert {t: round(c, 9) for t, c, _ in got} == {t: round(c, 9) for t, c in want.items()} and want

    def test_rare_tokens_of_long_urls_are_mined(self, spark):
        common = [f"t{k:02}" for k in range(30)]
        rows = [(common + (["rare"] if k % 10 == 0 else []), k % 10 == 0) for k in range(60)]
        assert [(t, c) for t, c, _ in urls.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6)] == [(("rare",), 1.0)]

    def test_urls_of_sixty_segments(self, spark):
        """Forty pages that share sixty segments: each tells, none is lost, no power set is listed."""
        path = "/".join(f"s{a}{b}" for a in "abcdef" for b in "ghijklmnop")
        rows = [(k, f"http://h{k}.net/{path}/{k}" if k < 40 else f"http://h{k}.net/plain/{k}", k < 40) for k in range(100)]
        pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
        more = spark.createDataFrame([(200, "http://x.net/sbk"), (201, "http://x.net/plain/sbq"), (202, "http://x.net/" + "y" * 50_000), (203, "")], "page_id long, url string")
        got = {r["id"]: r["verdict"] for r in urls.judged(pages.select("page_id", "url").unionByName(more), pages.select("url", "bad"), []).collect()}
        assert all((got[k] == "block") == (k < 40) for k in range(100)) and [got[k] for k in (200, 201, 202, 203)] == ["block", "allow", "allow", "allow"]

    def test_matching_finds_what_was_mined(self, spark):
        pages = spark.createDataFrame([(k, f"http://{'spam' if k % 3 == 0 else 'good'}.net/p/{k}") for k in range(60)], "page_id long, url string")
        out = urls.judged(pages, pages.select("url", (F.col("page_id") % 3 == 0).alias("bad")), []).collect()
        assert all((r["verdict"] == "block") == (r["id"] % 3 == 0) for r in out)


class TestTopK:
    def brute(self, rows, k):
        ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        out = set()
        for q in sorted({i for i, _ in ok if i % 20 == 0}):
            own = min(v for i, v in ok if i == q)
            ranked = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
        return out

    @pytest.mark.parametrize("chunk", [2, 100])
    def test_equals_brute_force(self, spark, chunk):
        rng = random.Random(5)
        rows = [(k, [float(np.float32(rng.gauss(0, 1))) for _ in range(9)]) for k in range(130)]
        rows += [(200 + k, rows[7][1]) for k in range(40)]  # ties
        rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 9), (303, [float("inf")] * 9), (304, [0.5, -0.5])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, chunk=chunk)
        assert {tuple(r) for r in got.collect()} == self.brute(rows, 5)

    def test_few_rows(self, spark):
        df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
        assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 20).collect()] == [(0, 1, 1, 64 * 128)]
        assert topk.top_k(df.limit(0), F.lit(True), 20).collect() == []


class TestSharding:
    def test_feistel_is_a_permutation(self, spark):
        for n in (1, 2, 3, 10, 97, 100, 1000):
            got = sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3)).collect())
            assert got == list(range(n))

    def test_large_numbers(self, spark):
        n = 3_000_000_000_000
        got = [r[0] for r in spark.range(n - 500, n).select(sharding.permuted(F.col("id"), n)).collect()]
        assert len(set(got)) == 500 and all(0 <= x < n for x in got)

    def test_long_walks_end(self, spark, monkeypatch):
        monkeypatch.setattr(sharding, "STEPS", 1)
        for n in (2, 3, 5, 10, 91):
            assert sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 1)).collect()) == list(range(n))

    def test_shards_and_slots(self, docs, none, monkeypatch):
        monkeypatch.setattr(sharding, "RUN", 8)
        rows = docs.select("doc_id", "number", "__extra", F.lit("old").alias("slot")).unionByName(docs.select(F.lit(9).cast("long").alias("doc_id"), "number", "__extra", F.lit("old").alias("slot")))
        got = sharding.shards(rows, 7).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows.collect())
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        again = sharding.shards(rows.repartition(3), 7).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        assert sharding.shards(none, 7).collect() == []


class TestDecontamination:
    ITEM = "Anna bought 12 apples for 30 euros and gave 5 of them to Peter before she walked 3 miles home with Anna's dog at 7"

    def held(self, spark, docs, items):
        d = spark.createDataFrame(docs, "doc_id long, text string")
        return {tuple(r)[:2]: r for r in decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def test_verbatim_and_reparameterised(self, spark):
        items = [(1, self.ITEM), (2, "too short"), (3, None), (4, "Kept words that stand in a row here and nowhere else at all")]
        other = "We say: so Maria bought 40 apples for 99 euros and gave 8 of them to Jonas before she walked 6 miles home with Maria's dog at 9. End."
        docs = [
            (10, f"Before. {self.ITEM}, after"),
            (11, self.ITEM.upper().replace(" ", "\n ")),
            (12, other),
            (13, "a text about apples and euros"),
            (14, None),
            (15, ""),
            (16, "kept words THAT stand in a row here and nowhere else at all"),
            (16, "kept words THAT stand in a row here and nowhere else at all"),
            (17, "Kept words that stand in a row"),
            (18, other.replace("Maria", "Ewa").replace("so Ewa", "Ewa", 1)),
        ]
        got = self.held(spark, docs, items)
        assert set(got) == {(10, 1), (11, 1), (12, 1), (16, 4), (18, 1)}
        assert got[12, 1]["kind"] == "template" and got[12, 1]["n_changed"] > 0 and got[10, 1]["kind"] == "verbatim"

    def test_an_item_full_of_numbers(self, spark):
        item = "please add the numbers 12 15 18 22 and 31 then divide the whole sum by 7 to get it"
        other = item.replace("12 15 18 22", "3 1 4 9").replace("31", "6").replace("by 7", "by 2")
        assert set(self.held(spark, [(1, other), (2, "please add the numbers and nothing else of it at all")], [(1, item)])) == {(1, 1)}

    def test_short_items_and_dense_ones(self, spark):
        items = [(1, "Forty-two!"), (2, "the grubble fish"), (3, "12 + 35 = 47, 9 * 8 = 72: sum, or product?"), (4, "..."), (5, "grubble fish")]
        docs = [
            (10, "what is it? forty-two"), (11, "forty two"), (12, "see The Grubble, fish swim"), (13, "the grubbles fish"), (14, "so: 1 + 2 = 3, 5 * 6 = 30: sum or product it is"),
            (15, "so: 1 + 2 = 1, 1 * 2 = 2: sum or product"), (16, "..."), (17, ""), (18, "the grubble"), (19, "word " * 30_000 + "the grubble fish"), (20, "12 + 35 = 47, 9 * 8 = 72: sum, or product?"),
        ]
        assert set(self.held(spark, docs, items)) == {(10, 1), (12, 2), (12, 5), (14, 3), (15, 3), (19, 2), (19, 5), (20, 3)}

    def test_clauses_that_an_item_repeats(self, spark):
        item = "If Sven has 131 marbles and gives 199 to Mbeki then he keeps some. If Sven has 723 pens and gives 46 to Mbeki then he keeps some. How many things does Mbeki get in all"
        other = item.replace("131", "5").replace("199", "81").replace("723", "64").replace("46", "7").replace("Sven", "Olga").replace("Mbeki", "Ravi")
        mixed = other.replace("gives 7", "gives 9").replace("Olga has 64", "Ravi has 64")
        assert (1, 1) in self.held(spark, [(1, f"Some words before. {other}. After"), (3, mixed)], [(1, item)])

    def test_recall_of_reparameterised_items(self, spark):
        """200 word problems with other names, numbers and units within documents: nine of ten are found, of the verbatim ones all, of other problems none."""
        rng = random.Random(12)
        people, units = ["Sven", "Mbeki", "Olga", "Ravi", "Chen", "Aoife", "Luis", "Mina"], ["km", "kg", "miles", "euros", "litres", "hours"]
        stories = [
            "If {0} has {a} marbles and gives {b} to {1} then how many marbles does {0} have after he finds {c} more of them on the way home",
            "A train leaves the town with {0} and {a} other people in it and after {b} {u} another {c} people get off so how many go on with {0} to the end",
            "{0} buys {a} pens at {b} cents each while {1} buys {c} pens at the same price and pays with a note so how much money is left for {1} in all",
            "When {0} runs {a} {u} every day and {1} runs {b} {u} every day for a week how much further does {0} go than {1} if one day is lost",
            "The garden of {0} is {a} {u} long and {b} {u} wide and a fence around all of it costs {c} coins for each piece so what does the fence cost",
            "If {0} has {a} apples and gives {b} to {1} then he is sad. If {1} has {c} pears and gives {b} to {0} then he is sad. How many things are there in all",
        ]

        def told(story, r):
            a, b = r.sample(people, 2)
            return story.format(a, b, a=r.randint(2, 900), b=r.randint(2, 90), c=r.randint(2, 90), u=r.choice(units))

        items, docs, words_ = [], [], [f"w{k}" for k in range(400)]
        for k in range(200):
            extra = " ".join(rng.choice(words_) for _ in range(8))  # makes items differ
            story = f"{stories[k % len(stories)]} and {extra}"
            items.append((k, told(story, rng)))
            around = lambda: " ".join(rng.choice(words_) for _ in range(30))
            docs += [(k, f"{around()} {told(story, rng)} {around()}"), (1000 + k, f"{around()} {items[-1][1]} {around()}"), (2000 + k, f"{around()} {around()}")]
        got = set(self.held(spark, docs, items))
        assert sum((k, k) in got for k in range(200)) >= 180 and all((1000 + k, k) in got for k in range(200)) and not any(d >= 2000 for d, _ in got)

    def test_equal_items_are_looked_up_once(self, spark, monkeypatch):
        items = [(k, self.ITEM) for k in range(30)] + [(40, "Kept words that stand in a row here and nowhere else at all"), (None, self.ITEM)]
        made = []
        index = decontaminate.Index
        monkeypatch.setattr(decontaminate, "Index", lambda ids, texts, parts: made.append(len(texts)) or index(ids, texts, parts))
        assert set(self.held(spark, [(1, self.ITEM)], items)) == {(1, k) for k in (*range(30), None)} and sum(made) == 2

    def test_windows_match_brute_force(self, spark):
        """Items of plain words: held where three fifths of their windows of five words are in the document, by sets of tuples."""
        rng = random.Random(31)
        items = [(k, random_text(rng, rng.randint(5, 14), 12)) for k in range(25)]
        docs = []
        for k in range(120):
            text = random_text(rng, rng.randint(0, 40), 12).split()
            cut = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(cut))
            at = rng.randint(0, len(text))
            docs.append((k, " ".join(text[:at] + cut[a : a + rng.randint(1, 12)] + text[at:])))
        grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
        starts = lambda t: [tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)]
        want = {(d, i) for d, x in docs for i, y in items if sum(g in grams(x) for g in starts(y)) >= 0.6 * len(starts(y))}
        assert set(self.held(spark, docs, items)) == want and len(want) > 10

    def test_clashing_names(self, spark):
        d = spark.createDataFrame([(1, f"x {self.ITEM} y", 5, "k"), (2, "plain", 6, "l")], "doc_id long, text string, item_id int, kind string")
        b = spark.createDataFrame([(7, self.ITEM, "t")], "item_id long, text string, doc_id string")
        assert [tuple(r)[:2] for r in decontaminate.contaminated(d, b).collect()] == [(1, 7)] and [tuple(r) for r in decontaminate.decontaminated(d, b).collect()] == [(2, "plain", 6, "l")]

    def test_inconsistent_slots_are_no_hit(self, spark):
        item = "if x costs 5 then two of x cost 5 and the rest of it at 5 is what you pay for 5 in all"
        fits = item.replace("5", "8")
        chance = "if x costs 1 then two of x cost 2 and the rest of it at 3 is what you pay for 4 in all"
        assert set(self.held(spark, [(1, fits), (2, chance)], [(1, item)])) == {(1, 1)}

    def test_a_benchmark_in_parts_and_filtering(self, spark, monkeypatch):
        rng = random.Random(2)
        items = [(k, " ".join(f"i{rng.randint(0, 10**6)}x" for _ in range(20))) for k in range(30)]
        docs = [(k, f"intro words {items[k][1]} outro") for k in range(30)] + [(k, random_text(rng, 200)) for k in range(30, 60)]
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        for size in (300, 1 << 20):
            monkeypatch.setattr(decontaminate.indexes, "__defaults__", (size,))
            assert {tuple(r)[:2] for r in decontaminate.contaminated(d, b).collect()} == {(k, k) for k in range(30)}
            assert sorted(r["doc_id"] for r in decontaminate.decontaminated(d, b).collect()) == list(range(30, 60))
        assert decontaminate.contaminated(d, b.limit(0)).collect() == [] == decontaminate.contaminated(d.limit(0), b).collect()
        assert decontaminate.decontaminated(d, b.limit(0)).count() == 60

    def test_memory_is_that_of_a_slice(self):
        rng = random.Random(5)
        texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(400)) for _ in range(1024)]
        texts[700] = f"so {self.ITEM} it is"
        index = decontaminate.Index([1], [self.ITEM])
        batch = pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array(texts)], names=["doc_id", "text"])
        tracemalloc.start()
        try:
            got = [b.column(0)[t].as_py() for b, held in index.looked_up(iter([batch]), 1) for t, *_ in held]
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert got == [700] and peak < 32 << 20


class TestChat:
    ROWS = [
        (1, 2, "assistant", "c<|im_end|>\\"), (1, 0, "system", None), (1, 1, "user", "é|im_next|>"), (1, 3, "assistant", "<|im_next|>\nd"), (1, 4, "user", "\\|<\\|"),
        (2, 0, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, None, "user\n<|im_head|>", "y<"), (3, 1, "user", "<"), (3, 2, "user", "|z"), (4, 0, "assistant", "long " * 20000),
    ]

    def test_round_trip(self, spark):
        df = spark.createDataFrame([(*r, "other") for r in self.ROWS], "conv_id long, turn long, role string, text string, formatted string")
        convs = defaultdict(list)
        for c, n, r, t in self.ROWS:
            convs[c].append((-1 if n is None else n, r or "", t or ""))
        got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
        assert set(got) == set(convs)
        for c, turns in convs.items():
            want = [(r, t) for _, r, t in sorted(turns)]
            assert [tuple(t) for t in got[c]["turns"]] == want
            assert list(got[c]["learned"]) == [t for r, t in want if r == "assistant"]
            whole, at, under = got[c]["formatted"], 0, []
            for chars, loss in got[c]["mask"]:
                under += [whole[at : at + chars]] if loss else []
                at += chars
            assert at == len(whole)
            assert [u.replace("\\|", "|").replace("\\\\", "\\") if "\\\\|" not in u else None for u in under if "\\" not in u] == [t for r, t in want if r == "assistant" and "\\" not in t and "<|" not in t]

    def test_runs_of_a_role_are_merged(self, spark):
        df = spark.createDataFrame([(1, k, "user" if k < 3 else "assistant", f"t{k}") for k in range(5)], "conv_id long, turn long, role string, text string")
        text = chat.formatted(df).first()["formatted"]
        assert text == "<|im_start|>user<|im_head|>\nt0<|im_next|>t1<|im_next|>t2<|im_end|>\n<|im_start|>assistant<|im_head|>\nt3<|im_next|>t4<|im_end|>\n"
        assert chat.read_back(chat.formatted(df.limit(0))).collect() == []

    def test_digest_query(self, spark, tmp_path):
        from lodestone.llm.queries import op9_chat_format

        spark.createDataFrame(self.ROWS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        got = {r["conv_id"]: r for r in op9_chat_format(spark, str(tmp_path)).collect()}
        said = "<|im_end|><|im_start|>assistant ok"
        assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(said) and got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


class TestToxicity:
    def test_numbers_stay_numbers(self):
        assert toxicity.folded("455 pages in 2014, $500 @ 3").split() == ["455", "pages", "in", "2014", "500", "3"]
        assert toxicity.folded("ph0n3 4pe $ick sh1t p@in тоxic naïve").split() == ["phone", "ape", "sick", "shit", "pain", "toxic", "naive"]

    @pytest.fixture(scope="class")
    def rows(self):
        rng = random.Random(7)
        out = []
        for k in range(1500):
            text = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 80))]
            toxic = k % 5 == 0
            if toxic:
                text[rng.randrange(len(text))] = rng.choice(["idiot", "1D10T", "іdiot", "grubble", "grubbling", "GRUBBLED!"])
            out.append((k, " ".join(text), int(toxic)))
        return out

    def test_learns_words_and_beginnings(self, spark, rows):
        d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5001, "")], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7000, 1)], "doc_id long, toxic int")
        model = toxicity.learn(d, labels, F.col("doc_id") % 3 != 0)
        assert any(e.startswith(" grubb") for e in model.entries)
        got = {r["doc_id"]: r["score"] for r in toxicity.scores(d, model, ["doc_id"]).collect()}
        held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
        assert sum(held) / len(held) > 0.98 and got[5000] == got[5001] < 0.5
        kept = toxicity.rejected(d, model)
        assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] < 0.5} and kept.columns == d.columns
        again = toxicity.learn(d.repartition(5), labels, F.col("doc_id") % 3 != 0)
        assert again.entries == model.entries and np.allclose(again.coefficients, model.coefficients)

    def test_folding_exceptions_and_nothing(self, spark):
        model = toxicity.Model({" clown ": 2.0, " idio": 3.0}, ("clown fish", "circus clown"))
        m = model.matcher()
        assert toxicity.measures("a clown fish", m) == (0.0, 0.0) == toxicity.measures(None, m)
        assert toxicity.measures("a CL0WN", m)[0] > 0 and toxicity.measures("ídіotic", m)[0] > 0 and toxicity.measures("preidiot", m) == (0.0, 0.0)
        assert toxicity.measures("clown", m)[0] > toxicity.measures("clown " + "x " * 50, m)[0]
        empty = spark.createDataFrame([], "doc_id long, text string")
        plain = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
        assert plain.entries == {} and toxicity.scores(empty, plain, ["doc_id"]).collect() == []
        one = toxicity.scores(spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string"), plain, ["doc_id"]).collect()
        assert {round(r["score"], 6) for r in one} == {0.05}

    def test_no_vocabulary_is_built_in(self):
        names = {k: v for k, v in vars(toxicity).items() if isinstance(v, (dict, tuple, list, frozenset, set)) and not k.startswith("__")}
        assert set(names) == {"SIGNS", "LOOKALIKES", "FOLD", "BEGINNINGS"} and all(len(k) == 1 for k in (*toxicity.SIGNS, *toxicity.LOOKALIKES))
        assert toxicity.Model({}).exceptions == ()

    def test_learns_exceptions(self, spark):
        rng = random.Random(11)
        rows = []
        for k in range(900):
            text = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(8, 30))]
            said = ["grubble"] if k % 3 == 0 else ["grubble", "fish"] if k % 3 == 1 and k % 2 else []
            at = rng.randrange(len(text))
            rows.append((k, " ".join(text[:at] + said + text[at:]), int(k % 3 == 0)))
        d, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        model = toxicity.learn(d, labels, F.lit(True))
        assert "grubble fish" in model.exceptions
        got = {r["doc_id"]: r["score"] for r in toxicity.scores(d, model, ["doc_id"]).collect()}
        assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)

    def test_matches_brute_force(self, spark):
        rng = random.Random(12)
        letters = "abcаβ01@ !"
        entries = {" ab ": 1.0, " abc": 2.0, " bca ": 0.5, " oa": 0.25}
        model = toxicity.Model(entries, ("ab ca", "bca abc", "c abca"), (-1.0, 2.0, 0.5))
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "ab " * 4000, "ab ca " * 3000]
        expect = {}
        for i, text in enumerate(texts):
            plain, signs = [], {"0": "o", "1": "i", "@": "a"}
            for k, c in enumerate(text or ""):  # a sign is a letter where its run of signs has a letter beside it, else a digit stays and another is a blank
                a = b = k
                while a and text[a - 1] in signs:
                    a -= 1
                while b + 1 < len(text) and text[b + 1] in signs:
                    b += 1
                beside = (a and text[a - 1].isalpha()) or text[b + 1 : b + 2].isalpha()
                plain.append((signs[c] if beside else c if c != "@" else " ") if c in signs else {"а": "a", "β": "b", "!": " "}.get(c, c))
            plain = "".join(plain)
            t = f" {plain} "
            covered = [(k, k + len(p) + 1) for p in model.exceptions for k in range(len(t)) if t.startswith(f" {p} ", k)] if len(t) < 1000 else None
            if covered is None:
                total = 0.0 if "ca" in t else 4000 * 1.0
            else:
                total = sum(w for e, w in entries.items() for k in range(len(t)) if t.startswith(e, k) and not any(a <= k and k + len(e) - 1 <= b for a, b in covered))
            expect[i] = 1 / (1 + math.exp(-(-1.0 + 2.0 * total / math.sqrt(1 + len(t.split())) + 0.5 * math.log1p(total))))
        got = {r["i"]: r["score"] for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model, ["i"]).collect()}
        assert got.keys() == expect.keys() and all(math.isclose(got[i], expect[i], rel_tol=1e-9) for i in expect)

    def test_rejects_among_clashing_names(self, spark):
        d = spark.createDataFrame([(1, "idiot", 1.0, "x"), (2, "fine", 2.0, "y")], "doc_id long, text string, __density double, score string")
        kept = toxicity.rejected(d, toxicity.Model({" idiot ": 5.0}))
        assert [tuple(r) for r in kept.collect()] == [(2, "fine", 2.0, "y")] and kept.columns == d.columns
        assert toxicity.scores(d, toxicity.Model({}), ["__density", "score"]).columns == ["__density", "score"]


#: Names that the operators use for columns of their own.
INTERNAL = "row id h h2 th fp n sketch keys short key at near times bucket start offset number k place copies cut rest low from size source_size target first none head root node a b density logsum score lang __row __hash __density __in __number __k".split()


class TestClashingNames:
    """Stages give back all columns as they were, whatever they are called."""

    OPERATORS = {
        "rejected": lambda d, spark: toxicity.rejected(d, toxicity.Model({" bad ": 9.0})),
        "deduplicated": lambda d, spark: simhash.deduplicated(d),
        "decontaminated": lambda d, spark: decontaminate.decontaminated(d, spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")),
        "repeated": lambda d, spark: mixing.repeated(d, weights=(1.0,), share=1.0),
        "shards": lambda d, spark: sharding.shards(d, 3).drop("shard", "slot"),
    }

    @pytest.mark.parametrize("name", OPERATORS)
    def test_columns_come_back(self, spark, name):
        rng = random.Random(5)
        rows = [(k, random_text(rng, 12, 500), f"s{k % 2}", *(f"{c}{k}" for c in INTERNAL)) for k in range(12)]
        d = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in INTERNAL)]))
        got = self.OPERATORS[name](d, spark)
        assert got.columns == d.columns and {tuple(r) for r in got.collect()} == set(rows)
