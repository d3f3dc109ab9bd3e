import re

import pytest

from quernstone.llm.mixing import mix, rows


def targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in out]
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: most * sizes[s] for s in over}


def docs(spark, n=400):
    data = [(i, " ".join(["w"] * (1 + (i * 37) % 101)) + "\n", None if i % 7 == 6 else "s%d" % (i % 7 if i % 3 else 0), "x") for i in range(n)]
    data += [(n, None, "s1", "x"), (n + 1, "  \t", "s2", "x"), (3, data[3][1], data[3][2], "x"), (None, "a b c", "s1", "x")]
    return spark.createDataFrame(data, "doc_id long, text string, source string, size string")


def test_targets_sizes_and_bounds(spark):
    df = docs(spark)
    got = mix(df).collect()
    source = {}
    for r in df.collect():
        source.setdefault((r["doc_id"]), r["source"])
    sizes, taken = {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 25
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))


def test_rows_follow_the_decision(spark):
    df = docs(spark)
    want = {}
    for r in mix(df).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + (r["taken"] // r["size"] if r["size"] else 0)
    got = rows(df)
    assert got.columns == df.columns
    count = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert count == {k: v for k, v in want.items() if v}


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is taken as often as its expected copies say."""
    df = spark.createDataFrame([(i, " ".join(["w"] * (4 if i % 2 else 64)), "a" if i < 60 else "b") for i in range(80)], "doc_id long, text string, source string")
    seen = {}
    for seed in range(12):
        for r in mix(df, seed=seed, share=0.6).collect():
            seen.setdefault((r["doc_id"] < 60, r["size"]), []).append(r["taken"] / r["size"])
    mean = {k: sum(v) / len(v) for k, v in seen.items()}
    assert mean[(True, 4)] / mean[(True, 64)] == pytest.approx(2.0, rel=0.2)  # 16 ** 0.25


def test_empty_and_single(spark):
    empty = docs(spark, 10).limit(0)
    assert mix(empty).collect() == []
    one = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mix(one).collect()] in ([(1, 2, 2, 3.0, 2)], [(1, 2, 2, 3.0, 4)])
