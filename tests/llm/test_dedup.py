import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quernstone.llm import line_dedup as lines
from quernstone.llm import ngram_join as nj
from quernstone.llm.components import components
from quernstone.llm.exact_dedup import exact_dedup


def near_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ünïcode", "THE", "the"]
    rows = []
    boiler = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.4:
            base = boiler + base
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randint(0, 12))]
            rows.append((" " if rng.random() < 0.5 else "\n").join(w))
    rng.shuffle(rows)
    out: list[tuple] = list(enumerate(rows))
    return [*out, (900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  two"), (None, rows[0]), (3, rows[3]), (905, "x " * 4000)]


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(rows, n, num):
    sets = [(d, shingles(t, n)) for d, t in rows]
    low = {d: d for d, _ in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("n,num", [(4, 85), (2, 60)])
def test_components_equal_brute_force(frame, monkeypatch, seed, n, num):
    monkeypatch.setattr(nj, "TILE", 2)  # every open group is cut
    rows = near_corpus(seed)
    got = nj.ngram_join(frame([(*r, 1) for r in rows], ", n long"), nj.Likeness(n, num, 100)).collect()
    assert sorted(map(tuple, got), key=str) == classes(rows, n, num)


def test_groups_that_one_centre_does_not_link(frame):
    """A group's smallest document is far from two others that are alike: only tiles find that link."""
    base = [f"c{i}" for i in range(30)]
    far = base + [f"f{i}" for i in range(9)]
    a, b = base + [f"a{i}" for i in range(6)], base + [f"a{i}" for i in range(5)] + ["z"]
    rows = [(0, " ".join(far)), (1, " ".join(a)), (2, " ".join(b))]
    like = nj.Likeness(1, 80, 100)
    got = nj.ngram_join(frame(rows), like).collect()
    assert sorted(map(tuple, got)) == classes(rows, 1, 80) and {r["component_id"] for r in got} == {0, 1}


def test_bit_counts_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, rng.integers(0, len(x) + 1), replace=False), rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)]))
        if len(y):
            a, b = (np.frombuffer(nj.signature(v), np.uint8) for v in (x, y))
            assert nj.most_shared(a, b, len(x), len(y)) >= len(np.intersect1d(x, y))


def test_one_of_each_group_stays(frame):
    text = " ".join(f"w{i}" for i in range(50))
    got = nj.one_of_each(frame([(1, text, "a"), (2, text + " more", "b"), (3, "other text", "c"), (4, None, "d")], ", source string"))
    assert got.columns == ["doc_id", "text", "source"] and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
    assert nj.ngram_join(frame([])).collect() == []


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(500, 400 + i) for i in range(40)] + [(7, 7)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_copies_equal_brute_force(frame):
    rng = random.Random(4)
    long = "".join(rng.choices("ab ", k=3000))
    texts = ["", None, " ", "a b", "a  b", "a\t\nb", "é", "e", long, long[:-1] + "c", long.replace(" ", "\n\n"), long[:200], long[:200] + "x", "a b ", "x" * 64, "x" * 65, "x" * 64 + "y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, rng.choice(texts)) for i in range(60)] + [(3, "a b"), (None, "é"), (None, "unseen")]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = []
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    got = exact_dedup(frame([(*r, 1) for r in rows], ", size int"), first=8, factor=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup(frame([])).collect() == []


def chunk_brute(rows, grids):
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    place, chunks = {}, []
    for d, t in rows:
        spans, ls = set(), [] if t is None else t.split("\n")
        for g in range(grids):
            part = [h(x) // 3**g % 3 for x in ls]
            a = 0
            for i in range(len(ls)):
                if i == len(ls) - 1 or part[i] == 1 or part[i + 1] == 0:
                    spans.add((a, i + 1))
                    a = i + 1
        some = [i for i, x in enumerate(ls) if x.strip(" \t\n\v\f\r")]
        spans |= {(i, j + 1) for i, j in zip(some, some[1:], strict=False)}
        spans = {x for x in [*spans, (0, len(ls))] if x[1] - x[0] > 1 and "".join(ls[x[0] : x[1]]).strip()}
        chunks.append((d, t, ls, spans))
    for d, _, ls, spans in sorted(chunks, key=lambda x: x[0]):
        for a, b in sorted(spans):
            place.setdefault("\n".join(ls[a:b]), (d, a))
    out = []
    for d, t, ls, spans in chunks:
        gone = {i for a, b in spans if place["\n".join(ls[a:b])] != (d, a) for i in range(a, b)}
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_lines_equal_brute_force(frame, seed):
    rng = random.Random(seed)
    block = ["\n".join("shared line %d of %d" % (i, b) for i in range(12)) for b in range(3)]
    rows = [(i, "\n".join([*("own %d %d" % (i, j) for j in range(rng.randint(0, 5))), rng.choice([*block, ""]), *("tail %d" % rng.randrange(5) for _ in range(rng.randint(0, 4)))])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, block[0] + "\n" + block[0]), (54, "a line"), (55, "a line"), (56, "\n\n\n")]
    df = frame([(*r, "k") for r in rows], ", _row string")
    got = lines.line_dedup(df).collect()
    want = chunk_brute(rows, lines.GRIDS)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=str) == want
    assert any(w[3] for w in want) and {r["_row"] for r in got} == {"k"}
    assert lines.cleaned(df).columns == df.columns


def test_line_edges(frame):
    text = "\n".join(f"line {i}" for i in range(9))
    got = lines.line_dedup(frame([(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got if r["doc_id"] == 1) == [("1", 0), ("1", 0)]
    assert next(r["n_removed"] for r in got if r["doc_id"] is None) == 9
    assert lines.line_dedup(frame([])).collect() == []


def test_copies_and_short_passages_go(frame):
    """A copy goes whole; passages of two lines and more in two otherwise different texts are all found, blank lines inside included, and none in clean texts."""
    rng = random.Random(7)
    own = lambda i, n: ["document %d line %d %d" % (i, j, rng.randrange(10**6)) for j in range(n)]
    passages = [["passage %d of line %d" % (p, j) if j != 1 or p % 7 else " " for j in range(2 + p % 5 + (p % 7 == 0))] for p in range(200)]
    rows = [(2 * p + k, "\n".join([*own(2 * p + k, 3), *passages[p], *own(2 * p + k, 3)])) for p in range(200) for k in range(2)]
    rows += [(1000 + i, "\n".join(own(1000 + i, 5))) for i in range(50)] + [(2000 + i, rows[i][1]) for i in range(50)]
    got = {r["doc_id"]: r for r in lines.line_dedup(frame(rows)).collect()}
    assert all(got[2000 + i]["text"] == "" for i in range(50))
    assert [got[2 * p + 1]["n_removed"] for p in range(200)] == [len(p) for p in passages]
    assert all(r["n_removed"] == 0 for d, r in got.items() if d < 400 and d % 2 == 0 or 1000 <= d < 2000)


def test_a_long_text_of_many_lines(frame):
    """Work on a document grows with its lines, not with their square; blocks at its start, middle and end stay in order."""
    rng = random.Random(8)
    ls = ["row %d" % rng.randrange(20_000) for _ in range(40_000)]
    rows = [(1, "\n".join(ls)), (2, "\n".join(ls[10_000:30_000])), (3, "x\n" * 30_000)]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.line_dedup(frame(rows)).collect()), key=str)
    assert got == chunk_brute(rows, lines.GRIDS)


def test_seeds_in_one_text_and_with_other_first_places(frame):
    """A line stays where it occurs first, though chunks that share it have first places in different documents."""
    rows = [(1, "b\nc\nz"), (2, "a\nb\nc"), (3, "x\na\nb"), (4, "q\nq\nq"), (5, "b\n\nc")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.line_dedup(frame(rows)).collect()}
    assert got == {1: ("b\nc\nz", 0), 2: ("a", 2), 3: ("x", 2), 4: ("q", 2), 5: ("b\n\nc", 0)}


def test_long_words_of_one_hash_are_different_words(frame):
    """Thue-Morse words have one polynomial hash modulo 2^64 for any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("ab"[b] for b in bits))]
    got = {r["doc_id"]: r["component_id"] for r in nj.ngram_join(frame(rows), nj.Likeness(4, 85, 100)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_ngram_join_decides_a_family_in_tiles_that_get_a_set_once(spark, frame, monkeypatch):
    """Sets of candidate pairs once travelled with each pair (two sets a pair), so a family of near copies cost its square in shuffled bytes."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.choice(60, 3, replace=False).tolist():
            words[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    docs = frame(list(enumerate(texts)))
    like = nj.Likeness(1, 92, 100)
    sets = [set(t.split()) for t in texts]
    pairs = [(i, j) for i in range(40) for j in range(i)]
    linked = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 92 * len(sets[i] | sets[j])]
    for block in (nj.BLOCK, 200):  # one tile, many tiles
        monkeypatch.setattr(nj, "BLOCK", block)
        got = nj._linked_in_tiles(spark.createDataFrame(pairs, "a long, b long"), docs, like, "test-tiles")
        links = {(r["a"], r["b"]) for r in got.collect()}
        assert links <= set(linked)
        root = list(range(40))
        def group(edges):
            root[:] = range(40)
            for _ in range(40):
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
            return list(root)
        assert group(links) == group(linked)
        if block == nj.BLOCK and block > 200:
            assert len(links) <= 39


def test_both_comparisons_of_a_tile_agree(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    for edge in (0, 30):
        rows = []
        for d in range(90):
            grams = np.unique(np.concatenate([base[: 200 - d % 50], rng.integers(0, 1 << 62, d % 9).astype(np.uint64)]))
            rows.append([0 if d < edge else 1 if edge else 2, d, len(grams), nj.signature(grams), d % 40])
        rows.sort(key=lambda r: (r[0], r[2]))
        got = []
        for few in (0, 1000):
            monkeypatch.setattr(nj, "FEW", few)
            got.append(sorted(zip(*map(list, nj._compare(rows, nj.Likeness(4, 85, 100))), strict=True)))
        assert got[0] == got[1] and got[0]
