import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quernstone.llm import passages
from quernstone.llm.substring_dedup import substring_dedup
from quernstone.llm.suffix_dedup import repeats, suffix_dedup


def corpus(seed: int, docs: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 5))).strip() or "x" for _ in range(60)]
    passage = [" ".join(rng.choices(vocabulary, k=70)) for _ in range(4)]
    rows: list[tuple] = []
    for i in range(docs):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 90)))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passage), "\n".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        rows.append((i, " ".join(parts)))
    rows += [(docs, None), (docs + 1, ""), (docs + 2, "ab " * 300), (docs + 3, "a" * 500), (docs + 4, rows[0][1]), (docs + 4, rows[0][1]), (None, passage[0])]
    rows.append((docs + 5, passage[0][:-30] + " other end"))
    return rows


def bytes_brute(rows, length):
    seen = defaultdict(int)
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words_brute(rows, length):
    first: dict = {}
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if d is not None and first.get(key, d) >= d:
                first[key] = d
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_finds_every_repeat(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + (2 if seed % 2 else 20), 3000).astype(np.uint8)
    data = np.concatenate([base, [255], base[500:900], [255], rng.integers(97, 117, 400).astype(np.uint8), base[700:760], [255], np.full(300, 97), [255]]).astype(np.uint8)
    for length in (9, 20, 64, 200):
        raw = data.tobytes()
        count = defaultdict(int)
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] += 1
        got = repeats(data, length)
        for i in range(len(raw) - length + 1):
            if 255 not in raw[i : i + length]:
                assert got[i] == (count[raw[i : i + length]] > 1)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("hot", [passages.HOT_BUCKET, 0])
def test_removed_bytes_equal_brute_force(spark, frame, monkeypatch, seed, hot):
    monkeypatch.setattr(passages, "HOT_BUCKET", hot)
    rows = corpus(seed)
    got = suffix_dedup(frame([(*r, "x") for r in rows], ", th string"), 60, 20).collect()
    assert sorted(map(tuple, got), key=str) == bytes_brute(rows, 60)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("hot", [passages.HOT_BUCKET, 0])
def test_removed_words_equal_brute_force(spark, frame, monkeypatch, seed, hot):
    monkeypatch.setattr(passages, "HOT_BUCKET", hot)
    rows = corpus(seed)
    got = substring_dedup(frame([(*r, "x") for r in rows], ", h string"), 20, 5).collect()
    assert sorted(map(tuple, got), key=str) == words_brute(rows, 20)


def test_rows_without_id_whose_texts_share_a_32_bit_hash(spark, frame):
    """Two texts without doc_id and with one 32-bit hash; what repeats in one of them is not taken from the other."""
    from pyspark.sql import functions as F

    texts = spark.range(300_000).select(F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(" text of its own "), F.md5(F.col("id").cast("string"))).alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("x")).where("size(x) > 1").orderBy(F.expr("x[0]")).first()["x"][:2]
    rows = [(None, pair[0]), (None, pair[1]), (5, "head " + pair[0] + " tail")]
    got = suffix_dedup(frame(rows), 30, 12).collect()
    assert sorted(map(tuple, got), key=str) == bytes_brute(rows, 30) and sorted(r["n_removed"] for r in got)[0] == 0
    got = substring_dedup(frame(rows), 5, 2).collect()
    assert sorted(map(tuple, got), key=str) == words_brute(rows, 5)


def test_near_copies_in_one_bucket(frame, monkeypatch):
    """Many edited copies of one passage: their bucket is cut into ranges of windows, and these into windows."""
    monkeypatch.setattr(passages, "HOT_BUCKET", 5)
    rng = random.Random(11)
    base = ["w%d" % rng.randrange(900) for _ in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(60)] = "e%d" % rng.randrange(9)
        rows.append((i, " ".join(words)))
    got = substring_dedup(frame(rows), 20, 5).collect()
    assert sorted(map(tuple, got), key=str) == words_brute(rows, 20)
    got = suffix_dedup(frame(rows), 60, 20).collect()
    assert sorted(map(tuple, got), key=str) == bytes_brute(rows, 60)


def test_kept_text_and_spans(frame):
    a, b = "head one two ", "shared passage of some length here"
    got = suffix_dedup(frame([(1, a + b), (2, b + " tail")]), 20, 8, text=True).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in got] == [a.encode(), b" tail"]
    assert got[1]["spans"] == [[0, len(b)]]
    got = substring_dedup(frame([(1, a + b), (2, "x  y\t" + b + " tail")]), 4, 2, text=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == ["head one two " + b, "x y tail"]


def test_empty_table(frame):
    assert suffix_dedup(frame([])).collect() == []
    assert substring_dedup(frame([])).collect() == []


def test_an_anchor_depends_on_its_window_only():
    """The same window in a short and in a long block, among hashes that differ in their low bits only."""
    rng = np.random.default_rng(5)
    units = passages.Units(200, 40, False)
    window = rng.integers(1 << 40, 1 << 63, 161, np.uint64)
    window[20], window[90] = 1 << 10, (1 << 10) - 1  # whether these differ depends on how many bits are compared
    seen = set()
    for before, after in ((0, 0), (100, 40), (3, 500_000), (60_000, 400_000)):
        noise = rng.integers(1 << 40, 1 << 63, before + after, np.uint64)
        hashes = np.concatenate([noise[:before], window, noise[before:]])
        _, start, n, at = passages.anchors(hashes, np.array([0, len(hashes) + 39]), units)
        run = int(np.flatnonzero((start <= before) & (before < start + n))[0])
        seen.add(int(at[run]) - before)
    assert len(seen) == 1
