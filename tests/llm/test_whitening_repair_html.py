"""Whitening, conversation repair and main text: against brute force, on edges, and the registered queries."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html, queries, repair, whitening

SMALL = "/root/testdata/sf0.001"


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, n string, v int"


def brute_whitening(vectors, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, [sum(int(a) ** 2 for a in n * row - sums) for row in x], y @ u / np.sqrt(e), e / (y * y).sum() * n


class TestWhitening:
    def test_query_equals_a_dense_solver(self, spark):
        source = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
        n, deviations, want, explained = brute_whitening([r["embedding"] for r in source], 32)
        got = queries.op11_whitening(spark, SMALL).toPandas()
        assert len(got) == n * 32 and set(got.n) == {n} and got.identity_error.max() < 1e-10
        ids = [r["vec_id"] for r in source]
        wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
        assert np.allclose(wide * np.sign((wide * want).sum(0)), want, atol=1e-9)
        assert list(got[got.component == 1].set_index("vec_id").deviation.loc[ids]) == deviations
        assert np.allclose(got[got.vec_id == ids[0]].sort_values("component").explained, explained, rtol=1e-9)

    def test_few_components_take_many_passes(self, spark):
        rng = np.random.default_rng(3)
        x = rng.standard_normal((400, 40)) * np.linspace(1, 1.5, 40)
        rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)
        found = whitening.fit(rows, 40, 3, block=4)
        y = np.floor(64 * x)
        e, u = np.linalg.eigh(np.cov(y.T, bias=True))
        assert found.passes > 3 and np.allclose(found.variances, e[::-1][:3], rtol=1e-12)
        assert np.abs(np.abs(found.components.T @ u[:, ::-1][:, :3]) - np.eye(3)).max() < 1e-9
        again = whitening.fit(rows, 40, 3, block=4)
        assert (again.components == found.components).all()

    def test_edges(self, spark):
        nan, inf = float("nan"), float("inf")
        rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [1.0]), (9, [])]
        df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], VECTORS)
        got = whitening.whitened(df).collect()
        n, deviations, want, explained = brute_whitening([v for _, v in rows[:4]], 2)
        assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == sorted((i or 0, c, 4) for i, _ in rows[:4] for c in (1, 2))
        assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviations)
        assert sorted(abs(r["whitened"]) for r in got) == pytest.approx(sorted(abs(want).reshape(-1)))
        assert whitening.whitened(df.limit(0)).collect() == []
        assert whitening.whitened(df.where("vec_id = 2")).collect() == []  # no variance, no component
        assert whitening.whitened(df.where("vec_id = 1")).collect() == []
        flat = spark.createDataFrame([(k, [float(k), 7.0, -3.0], "x", 0) for k in range(9)], VECTORS)
        assert {r["component"] for r in whitening.whitened(flat).collect()} == {1}
        huge = spark.createDataFrame([(k, [1e30 * k], "x", 0) for k in range(3)], VECTORS)
        with pytest.raises(ValueError, match="too large"):
            whitening.whitened(huge)

    def test_deviations_are_exact(self):
        assert list(whitening.deviations(np.array([[3_000_000_001, 4], [1, 2]]))) == [3_000_000_001**2 + 16, 5]
        with pytest.raises(OverflowError):
            whitening.deviations(np.array([[4_000_000_000, 0]]))


# ---- conversation repair

TURNS = "conv_id long, turn long, role string, text string, key string, turns int"


def brute_plan(signature):
    """All edit strings of up to two inserts more than rows."""
    best = None
    n = len(signature)
    for length in range(n + 3):
        for edits in itertools.product("DIKR", repeat=length):
            if sum(e != "I" for e in edits) != n:
                continue
            at, cost, said = 0, 0, ""
            for e in edits:
                if e == "I":
                    cost, said = cost + 5, said + "?"
                    continue
                c = signature[at]
                at += 1
                if e == "D":
                    cost += 2
                    continue
                if c == "-" or (e == "K" and c in "xX"):
                    break
                cost += (e == "R") + 5 * c.isupper()
                said += c.lower() if e == "K" else "?"
            else:
                form = "".join(said)
                fits = any(len(form) == len(w) and all(a in ("?", b) for a, b in zip(form, w, strict=True)) and not (w[:1] == "s" and form[0] == "?") for w in ("", *("s" * s + "ua" * k for s in (0, 1) for k in range(1, 5))))
                if fits and (best is None or (cost, "".join(edits)) < best):
                    best = (cost, "".join(edits))
    return best


class TestRepair:
    def test_plans_equal_an_exhaustive_search(self):
        rng = random.Random(5)
        solve = repair.solver()
        signatures = {""} | set("suaxSUAX-") | {"".join(rng.choice("suaxSUA-") for _ in range(rng.randint(2, 5))) for _ in range(60)}
        assert {s: solve(s) for s in signatures} == {s: brute_plan(s) for s in signatures}

    def test_solver_is_the_same_with_and_without_memory(self):
        rng = random.Random(6)
        solve = repair.solver()
        for _ in range(50):
            s = "".join(rng.choice("suaxSUA-") for _ in range(rng.randint(0, 90)))
            assert solve(s) == repair.solver()(s)
            rows, roles = repair.replayed(s, solve(s)[1])
            said = "".join((r or {"s": "system", "u": "user", "a": "assistant"}[s[k].lower()])[0] for k, r in zip(rows, roles, strict=True))
            assert re.fullmatch("(s?(ua)+)?", said)

    def test_query_equals_brute_force(self, spark):
        def remainder(conv, turn):
            return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20

        blank = re.compile(r"[\x20\x09-\x0D]*")
        source = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        more = [(900, t, r, x) for t, r, x in ((None, None, None), (3, "user", "Hi."), (3, "user", "Hi."), (9, "tool", "x"), (4, "assistant", "Yes!  \n"), (None, "system", "é?"))]
        more += [(901, k, None if k % 3 else "assistant", None if k % 5 == 0 else "so.") for k in range(30)] + [(None, 1, "user", "A?"), (None, 2, "assistant", "B.")]
        rows = [tuple(r) for r in source] + more
        want = {}
        for conv in {r[0] for r in rows}:
            kept = []
            for _, turn, role, text in (r for r in rows if r[0] == conv):
                kind = remainder(conv, turn)
                role, text = role or " " if role is None else role, " " if text is None else text
                text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
                role = "user" if kind == 4 else role
                kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
            kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
            seen, signature, faults = set(), "", []
            for _, role, text in kept:
                initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
                fault = "blank" if blank.fullmatch(text) else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"
                seen.add((role, text))
                faults.append(fault)
                signature += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            cost, audit = repair.solver()(signature)
            at, said = 0, []
            for e in audit:
                needed = "assistant" if said and said[-1][0][:1] == "u" else "user"
                if e == "K":
                    said.append(kept[at][1:])
                elif e in "RI":
                    said.append((needed, "" if e == "I" else kept[at][2]))
                at += e != "I"
            turns = {t for t, _, _ in kept if t is not None}
            pairs = zip(kept[:-1], kept[1:], strict=True) if kept else ()
            want[conv] = (
                max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
            )
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        out = repair.repaired(repair.damaged(df), lost=F.col("lost"))
        text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        got = {r[0]: tuple(r)[1:] for r in out.select("conv_id", *columns, F.sha2(text, 256)).collect()}
        assert got == want

    def test_edges(self, spark):
        rows = [(1, 1, "user", "Hi.", "x", 0), (2, 1, "", "x.", "x", 0), (3, None, "user", "A.", "x", 0), (3, None, "assistant", "B.", "x", 0)]
        df = spark.createDataFrame(rows, TURNS)
        got = {r["conv_id"]: r for r in repair.repaired(df).collect()}
        assert (got[1]["audit"], got[1]["cost"], [tuple(t) for t in got[1]["turns"]]) == ("D", 2, [])
        assert (got[2]["audit"], got[2]["illegal"]) == ("D", 0)
        assert (got[3]["gaps"], got[3]["audit"]) == (0, "DD") or got[3]["audit"] == "RR"
        assert repair.repaired(df.limit(0)).collect() == []
        gone = repair.repaired(df, lost=F.lit(True)).collect()
        assert {(r["conv_id"], r["cost"], r["audit"], r["gaps"], len(r["turns"])) for r in gone} == {(k, 0, "", 0, 0) for k in (1, 2, 3)}
        long = [(5, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" + "." * (k % 50 != 0) + "long " * (k == 7) * 100_000 + ".", "x", 0) for k in range(3000)]
        one = repair.repaired(spark.createDataFrame(long, TURNS)).collect()
        assert len(one) == 1 and len(one[0]["audit"]) == 3000 and one[0]["cost"] == 0


# ---- main text

NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
LONG = "Words of the article that go on for a while, and then some more of them follow. "
CASES = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    ("plain  text\n only", "plain text only"),
    ("<p>one<p>two &amp; <b>three</b> &copy; &#233; &lt;p&gt;", "one\n\ntwo & three © é <p>"),
    ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
    ("<table><tr><td>x<td>y<tr><td>z</table>", "x y\n\nz"),
    ("<p>a<br>b</p><pre>c\n  d</pre>", "a b\n\nc d"),
    (f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p><p>no'</script></head><body>{NAV}</body></html>", ""),
    (f"<body>{NAV}<article><h1>T</h1><p>a</p></article><footer>&copy; x</footer>", "T\n\na"),
    (f"<body>{NAV}<article><h1>T</h1><p><b>a<br><p>b</p></article><div class='ad'>{LONG}</div>", "T\n\na\n\nb"),
    (f"<div class=has-sidebar><main><p>{LONG}</p></main><aside>{LONG}</aside></div>", LONG.strip()),
    (f"<article><header><h1>T</h1><p>By me</p></header><p>{LONG}</p><form>Subscribe</form><section><h2>3 Comments</h2><p>{LONG}</p></section></article>", f"T\n\n{LONG.strip()}"),
    (f"<body><div id='header'><h1>Site</h1></div><div class='story'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div id='comments'><p>{LONG * 9}</p></div>", f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<div class='post'><p>{LONG}</p><div class='share-buttons'>Share</div><p>{LONG}</p><ul><li><a>{LONG}</a><li><a>b</a><li><a>c</a></ul></div>", f"{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<body><div class='cookieNotice'>{LONG}</div><h1>T</h1><div><p>{LONG}</p><p>x</p></div>", f"T\n\n{LONG.strip()}\n\nx"),
    (f"<article><p hidden>no</p><p style='display: none'>no</p><p>{LONG}</p><!-- <p>no</p> --><noscript>no</noscript></article>", LONG.strip()),
    ("<article><p>a <a href='x'>linked</a> word</p><p>b</article>", "a linked word\n\nb"),
    ("<article><p title='a > b'>c</p><p title=\"'\">d", "c\n\nd"),
    ("<ARTICLE><P>A</P><UL><LI>b<LI>c</UL></ARTICLE>", "A\n\nb\n\nc"),
    ("<article>a</b></i></div>b</article>", "ab"),
    ("<article><p>x</p><p>cut off <a hre", "x\n\ncut off"),
    ("<article><p>x</p><!-- never ends <p>y", "x"),
]


class TestMainText:
    @pytest.mark.parametrize(("source", "want"), CASES)
    def test_cases(self, source, want):
        assert html.main_text(source) == want

    def test_densities_by_the_formula(self):
        page = html.Page("<div><p>aaaa<a>bb</a></p><p>cc</p></div>")
        out = html.left_out(page)
        dense, sums, chars, link_chars, links = html.densities(page, out)
        at = {t: k for k, t in reversed(list(enumerate(page.tag)))}
        assert (chars[0], link_chars[0], links[0]) == (8, 2, 1)
        base = np.log(6 / 4 * 2 + 2 / 8 * 6 + np.e)
        assert dense[at["p"]] == pytest.approx(6 / 1 * np.log(6 / 2 * 1 / 1) / np.log(base))
        assert sums[at["div"]] == pytest.approx(sum(dense[k] for k, t in enumerate(page.tag) if t == "p"))

    def test_pages_of_one_template(self, spark):
        import html as std

        want = {}
        for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
            body = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
            parts = (" ".join(std.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:h1|p)>", body))
            want[r["page_id"]] = "\n\n".join(p for p in parts if p)
        got = queries.op13_html_text(spark, SMALL).collect()
        assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)

    def test_edges(self, spark):
        rows = [(1, None, None, "k"), (1, None, None, "k"), (None, "u", "<p>x</p>", "k"), (3, "u", "<div>" * 20_000 + "deep", "k"), (4, "u", "<a '" * 20_000, "k"), (5, "u", f"<article>{'<p>w w w</p>' * 50_000}</article>", "k")]
        df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
        got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html.extracted(df).collect()))
        assert got == [(0, 1), (1, 0), (1, 0), (3, 4), (4, 0), (5, 50_000 * 7 - 2)]
        assert html.extracted(df.limit(0)).collect() == []
