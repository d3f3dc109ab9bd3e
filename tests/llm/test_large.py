"""Texts of megabytes and ties, in the operators that have no such test of their own."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quernstone.llm import language, line_dedup, media, mixing, packing
from quernstone.llm.exact_dedup import exact_dedup
from quernstone.llm.ngram_join import Likeness, ngram_join
from quernstone.llm.substring_dedup import substring_dedup
from quernstone.llm.suffix_dedup import suffix_dedup


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    long = "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(18_000))
    assert len(long) > 1_200_000
    return [(1, long), (2, long), (3, "short text"), (4, long[: 1 << 20] + " another end"), (5, None), (6, "x" * 1_000_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_exact_copies(docs, rows):
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert {d: r["keep_id"] for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6} and got[2]["group_size"] == 2
    assert all(got[d]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for d, t in rows)


def test_passages(docs, rows):
    text = {d: t or "" for d, t in rows}
    got = {r["doc_id"]: r for r in suffix_dedup(docs).collect()}
    shared = len(rows[3][1]) - len(" another end")
    # the cut of row 4 ends where row 1 goes on with the same bytes, or not
    tail = next(i for i, (a, b) in enumerate(zip(text[4][shared:], text[1][shared:], strict=False)) if a != b)
    assert [(got[d]["n_bytes"], got[d]["n_removed"]) for d in (1, 2, 3, 4, 5, 6)] == [(len(text[1]),) * 2, (len(text[2]),) * 2, (10, 0), (len(text[4]), shared + tail), (0, 0), (10**6, 10**6)]
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in text.items()}
    same = next(i for i, (a, b) in enumerate(zip(words[4], words[1], strict=False)) if a != b)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect()}
    assert got == {1: (len(words[1]), 0), 2: (len(words[2]),) * 2, 3: (2, 0), 4: (len(words[4]), same), 5: (0, 0), 6: (1, 0)}


def test_lines(docs, rows):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 18_000 and got[2]["text"] == "" and got[4]["n_removed"] > 0.8 * got[4]["n_lines"] and got[6]["text"] == rows[5][1]

@pytest.mark.parametrize("num", [60, 80])
def test_links(docs, rows, num):
    words = {d: (t or "").split() for d, t in rows}
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    linked = 100 * len(grams[1] & grams[4]) >= num * len(grams[1] | grams[4])
    parts = {r["doc_id"]: r["component_id"] for r in ngram_join(docs, Likeness(5, num, 100)).collect()}
    assert parts == {1: 1, 2: 1, 3: 3, 4: 1 if linked else 4, 5: 5, 6: 6}


def test_media(docs, rows):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (got[d]["n_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_packing_of_long_texts_and_ties(docs, rows):
    got = packing.pack(docs.where("doc_id <> 6")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    ids = lambda x: [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[x], key=lambda r: r["piece"])]
    assert ids(1) == ids(2) and len(ids(1)) > 100 and all(r["length"] == 2048 for r in by[1] if r["piece"])
    used = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_mixing_of_equal_sizes(spark):
    """All documents of a source are alike: the sample still meets the target, no row twice over, and reruns agree."""
    table = spark.createDataFrame([(i, "a b c d", "s%d" % (i % 3)) for i in range(900)] + [(900, "w " * 300_000, "s0")], "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    for name in range(3):
        own = [r for r in got if r["doc_id"] % 3 == name and r["doc_id"] < 900] + [r for r in got if r["doc_id"] == 900 and name == 0]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        biggest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(biggest, 0.02 * own[0]["target"])
        assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(table).collect()))


def test_language_of_ties(spark):
    """Two languages that learned the same: the first by name, at one half; a text of a megabyte in one word and one in many."""
    rows = [(i, "same words here", "bb" if i % 2 else "aa") for i in range(64)] + [(100, "same words here", None), (101, "same " * 250_000, None), (102, "s" * 1_000_000, None)]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(table, language.fit(table, F.lit(True)), ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == "aa" and got[i]["score"] == pytest.approx(0.5) for i in (100, 101, 102))
