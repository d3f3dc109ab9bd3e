import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from quernstone.llm import divergence as dv
from quernstone.llm import topk_search as tk
from quernstone.llm import whitening as wh

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, docs=3, ranks=200):
    """By the definition, for (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, c in seen[lang].items() if c >= docs]
        groups = sorted({s for _, k, s in rows if k == lang})

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        of = {s: p(counts[lang, s]) for s in groups}
        whole = p(sum((counts[lang, s] for s in groups), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, f(of[s][t], whole[t])) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(items, 1) if part == "pair" or i <= ranks]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Straße", "ÉTÉ", "THE", "the", "日本"]
    rows = []
    for _ in range(150):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice([None, "", "Z", "é", *(f"s{i}" for i in range(9))])
        size = min(len(words), 1 + int(rng.paretovariate(0.5)))
        rows.append((" 9_".join(rng.choice(words[-size:]) for _ in range(rng.randint(0, 25))), lang, source))
    return [*rows, (None, "en", "empty"), (" 12 ", "xx", "a"), ("one two", "xx", "b"), ("one", "yy", "only"), ("one", "yy", "only"), ("one", "yy", "only"), ("Long" * 5000, "en", "Z")]


@pytest.mark.parametrize("light,groups,terms", [(8, 128, 1024), (2, 3, 7), (0, 2, 5), (99, 4, 1024)])
def test_divergence_equals_brute_force(spark, light, groups, terms):
    rows = corpus(light)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string").repartition(3)
    assert told(dv.source_divergence(df, light=light, groups=groups, terms=terms)) == audited(rows)


def test_divergence_keeps_ranks_and_empty_tables(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert told(dv.source_divergence(df, docs=1, ranks=4)) == audited(rows, 1, 4)
    assert told(dv.source_divergence(df.limit(0))) == []


def test_shares_are_exact_for_huge_counts():
    n, size = [0, 1, 5 * 10**11, 10**15], [3, 10**12, 10**12, 3 * 10**15]
    assert dv.shares(np.array(n), np.array(size)).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n, size, strict=True)]
    assert dv.shares(np.array([0]), np.array([0])).tolist() == [1]


def searched(rows, k=5):
    """By the definition, for (vec_id, vector)."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x) in enumerate(good):
        if i is not None and i % 50 == 0:
            hits = [(-sum(p * q for p, q in zip(x, y, strict=False)), j is None, j or 0, j) for b, (j, y) in enumerate(good) if b != a]
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def vectors(seed, n, d=12):
    rng = np.random.default_rng(seed)
    some = rng.normal(size=(n, d)) * rng.choice([0.1, 1.0], size=(n, 1))
    some[n // 3 : n // 3 + n // 4] = some[0]  # ties
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(n) * (10 if seed else 1), some, strict=True)]


ODD = [(100, None), (150, []), (200, [None, 1.0]), (250, [float("nan")]), (300, [float("inf"), 1.0]), (None, [1.0] * 12), (None, [1.0] * 12), (50, [0.5, -0.5]), (50, [0.5, -0.5]), (50, [9.0] * 3), (-50, [0.0] * 12)]


@pytest.mark.parametrize("seed,n,block", [(0, 300, 8192), (1, 400, 64), (2, 3, 2)])
def test_search_equals_brute_force(spark, seed, n, block):
    rows = vectors(seed, n) + ODD
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<float>, q long, score int").repartition(3)
    got = tk.topk_search(df, block=block)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == searched(rows)


def test_search_of_few_and_of_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in tk.topk_search(df).collect()] == [(0, 1, 7, (256 * 3 + 2 * 256) * 256)]
    assert tk.topk_search(df.limit(0)).collect() == [] and tk.topk_search(df.limit(1)).collect() == []


def test_index_stops_on_proof_and_loses_nothing():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(4000, 64)) / 8).astype(np.int64)
    queries = np.concatenate([rows[:40] + 3, -rows[50:60], np.zeros((1, 64), np.int64)])
    index = tk.Index(rows)
    row, query, done = index.possible(queries[:40], 5)
    assert done < 0.8 * rows.size and len(row) < 0.2 * 40 * 4000  # it stopped early, with few rows left
    frame = pd.DataFrame({"side": [1] * 4000 + [0] * 51, "none": False, "key": [*range(4000), *range(51)], "x": [*rows, *queries]})
    got = tk.cell(frame, 5)
    scores = queries @ rows.T
    for q in range(51):
        best = sorted(range(4000), key=lambda i, q=q: (-scores[q, i], i))[:6]
        mine = got[got["q"] == q]
        assert mine["vec_id"].tolist() == best and mine["score"].tolist() == scores[q, best].tolist()


def whitened(rows, k=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    y = (x - s / n) @ w[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), y, e[:k] / np.trace(v)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    some = rng.normal(size=(400, 9)) @ np.diag([9, 7, 5, 4, 3, 2, 1, 0.5, 0.1]) + 100  # far from the origin
    rows = [(int(i), v.tolist()) for i, v in enumerate(some)] + [(3, some[3].tolist())] * 150
    odd = [(900, None), (901, [None] * 9), (902, [float("nan")] * 9), (903, [1.0, 2.0]), (904, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, n long, x int").repartition(3)
    got = wh.whitening(df).toPandas()
    n, deviation, y, explained = whitened(rows)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and n == 400 and set(got["vec_id"]) == set(range(400))
    by_id = {i: (d, z) for (i, _), d, z in zip(rows, deviation.tolist(), y, strict=True)}
    for c in range(4):
        part = got[got["component"] == c + 1]
        assert [by_id[i][0] for i in part["vec_id"]] == part["deviation"].tolist()
        told, mine = part["whitened"].to_numpy(), np.array([by_id[i][1][c] for i in part["vec_id"]])
        assert min(np.abs(told - mine).max(), np.abs(told + mine).max()) < 1e-8
        assert np.allclose(part["explained"], explained[c], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iat[0] < 1e-9


def test_whitening_without_variance_or_rows(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = wh.whitening(flat).collect()
    assert len(got) == 6 and {(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(c, 1, 0, None, None, 0.0) for c in (1, 2)}
    line = spark.createDataFrame([(i, [float(i), 0.0, -2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["component"]): r for r in wh.whitening(line).collect()}
    assert len(got) == 15 and got[0, 2]["whitened"] is None and got[0, 2]["explained"] == 0.0 and abs(abs(got[0, 1]["whitened"]) - math.sqrt(2)) < 1e-9
    assert wh.whitening(line.limit(0)).collect() == [] and wh.whitening(line.limit(0)).columns == wh.whitening(line).columns


def test_wide_sums_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))], "vec_id long, embedding array<double>")
    plain = wh.whitening(df).orderBy("vec_id", "component").collect()
    monkeypatch.setattr(wh, "_LONG", 1)
    monkeypatch.setattr(wh, "COLUMNS", 2)
    assert wh.whitening(df).orderBy("vec_id", "component").collect() == plain


def test_largest_components(spark):
    big = float(2**30)
    df = spark.createDataFrame([(i, [big * (i % 3), -big, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = wh.whitening(df.where("vec_id < 1")).collect()  # one vector: no difference to multiply
    assert {r["deviation"] for r in got} == {0}
    with pytest.raises(Exception, match="(?i)overflow"):
        wh.whitening(df).collect()  # deviations are beyond 64 bits
