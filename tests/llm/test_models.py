import random
import zlib

import numpy as np
import pytest

from quernstone.llm import language, packing, toxicity

TEST = "/root/testdata/sf0.001"


def test_forward_sums_every_segmentation():
    """Against all segmentations, one by one."""
    path = packing.tokenizer_file()
    hashes, sizes = language.pieces(path)
    rng = np.random.default_rng(0)
    p = rng.random((len(hashes), 2)) * 1e-2
    words = [b"the", b"nation", b"zz", "été".encode(), b"a", b"information", b"x9!"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    model = language.Model(["x", "y"], np.zeros(2), p, path)
    got = model.words(data, starts, ends)
    table = language.forward(language.Lattice(data, starts, ends, path), p)

    def hashed(piece):
        from quernstone.llm import blocks

        d = np.frombuffer(piece, np.uint8)
        return blocks.word_hashes(d, np.array([0]), np.array([len(d)]))[0]

    def brute(w, lang):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, min(len(w), language.LONGEST) + 1):
            k = np.searchsorted(hashes, hashed(w[:n]))
            if k < len(hashes) and hashes[k] == hashed(w[:n]):
                total += p[k, lang] * brute(w[n:], lang)
        return total

    order = language.Lattice(data, starts, ends, path).order
    for i, w in enumerate(words):
        for lang in range(2):
            assert np.exp(got[i, lang]) == pytest.approx(brute(w, lang))
            assert table[np.flatnonzero(order == i)[0], len(w), lang] == pytest.approx(brute(w, lang))
    assert sizes.max() <= language.LONGEST


def test_long_words_and_the_cache():
    """Logarithms give what plain products give, a word beyond PLAIN bytes equals its brute-force sum, cuts keep characters whole, and cached scores do not differ."""
    path = packing.tokenizer_file()
    hashes, sizes = language.pieces(path)
    rng = np.random.default_rng(1)
    p = rng.random((len(hashes), 2)) * 1e-3
    words = [b"internationalisation", b"-" * 70, b"=" * 128 + b"x" * 40, "ünïcödé".encode() * 5, ("日本語" * 100).encode(), b"z"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    model = language.Model(["x", "y"], np.zeros(2), p, path)
    a, b, of = language.chunks(data, starts, ends)
    assert (b - a <= language.CHUNK).all() and (b > a).all() and of.tolist() == [0, 1, 2, 3, 4, 4, 4, 4, 5]
    held = data.tobytes()
    parts = [held[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert b"".join(parts) == held and all(x.decode() for x in parts)
    got = model.words(data, a, b)
    from quernstone.llm import blocks

    piece = {}
    for i, w in enumerate(parts):
        best = [[0.0, 0.0]] + [[-np.inf, -np.inf] for _ in w]
        for j in range(1, len(w) + 1):
            for n in range(1, j + 1):
                sub = w[j - n : j]
                if sub not in piece:
                    d = np.frombuffer(sub, np.uint8)
                    h = blocks.word_hashes(d, np.array([0]), np.array([n]))[0]
                    k = np.searchsorted(hashes, h)
                    piece[sub] = k if k < len(hashes) and hashes[k] == h else None
                if piece[sub] is not None:
                    best[j] = [np.logaddexp(best[j][x], best[j - n][x] + np.log(p[piece[sub], x])) for x in range(2)]
        assert got[i] == pytest.approx(best[-1])
    short = language.Lattice(data, starts[:1], ends[:1], path)
    assert np.log(language.forward(short, p)[0, -1]) == pytest.approx(language.forward(short, p, language.BY_LOG)[0, -1])
    keep = language.CACHE
    try:
        for language.CACHE in (0, 8, 1 << 20):
            scored = language._Scored(model)
            for _ in range(3):
                order = rng.permutation(len(words))[:4]
                h = blocks.word_hashes(data, starts[order], ends[order])
                order = order[np.argsort(h)]
                want = np.array([got[of == i].sum(axis=0) for i in order])
                assert np.allclose(scored.words(data, starts[order], ends[order], np.sort(h)), want)
    finally:
        language.CACHE = keep


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TEST}/documents.parquet")
    got = {r["doc_id"]: r for r in language.language_id(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert out and all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_accuracy_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for name in {r["lang"] for r in got}:
        own = [r["lang_pred"] == name for r in got if r["lang"] == name]
        assert sum(own) >= 0.95 * len(own), name


def test_every_sampled_word_teaches(spark):
    """A rare language beside one with more distinct words than any bound on words, and a piece of more than 12 bytes."""
    rows = [(i, " ".join("w%dx%d" % (i, j) for j in range(300)) + (" w%dx0" % i) * 3, "aa") for i in range(250)] + [(1000, "zebra zodiac international", "zz")]
    from pyspark.sql import functions as F

    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    data = np.frombuffer(b"zebrazodiacinternational", np.uint8)
    per = model.words(data, np.array([0, 5, 11]), np.array([5, 11, 24]))
    flat = language.Model(["u"], np.zeros(1), np.full((len(model.p), 1), 1 / len(model.p)), model.path).words(data, np.array([0, 5, 11]), np.array([5, 11, 24]))
    assert model.languages == ["aa", "zz"] and (per[:, 1] > per[:, 0] + 1).all() and (per[:, 1] > flat[:, 0] + 1).all()
    assert language.pieces(model.path)[1].max() > 12


def test_language_edges(spark):
    rows = [(i, "the house and the garden %d" % i, "en", "s") for i in range(30)] + [(100 + i, "das Haus und der Garten %d" % i, "de", "s") for i in range(30)]
    rows += [(200, None, "en", "s"), (201, "", "de", "s"), (202, "123 !?", "en", "s"), (203, "ü", None, "s"), (None, "das Haus", None, "s"), (1, rows[1][1], "en", "s"), (204, "x" * 500, None, "s"), (205, "the house " * 3000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.language_id(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (200, 201, 202))
    assert by[203]["lang_pred"] in ("de", "en") and by[None]["lang_pred"] == "de" and by[None]["held_out"] is False and by[205]["lang_pred"] == "en"
    kept = language.accepted(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({200, 201, 202})
    assert language.language_id(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.language_id(df.withColumn("lang", df["lang"].substr(9, 2)).where("lang is null or lang = '' ").selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def counts(text):
    return {k: v for k, v in zip(toxicity.PATTERNS, toxicity.matches(text.lower().encode()), strict=True) if v}


def test_patterns():
    assert counts("You are an idiot.") == {"directed insult": 1}
    assert counts("What an idiot!") == {"insult": 1}
    assert counts("This is not an idiot") == {"negated": 1}
    assert counts("He said that fool is a moron") == {"reported": 2}
    assert counts("you are pathetic; utter trash") == {"directed slight": 1, "slight": 1}
    assert counts("I will kill you") == {"threat": 1}
    assert counts("We kill you") == {"threat": 1}
    assert counts("to kill time") == {}
    assert counts("He said so. You moron") == {"directed insult": 1}
    assert counts("scumble, idiotism, clownish") == {}
    assert counts("a stupid$$$ thing | moron | x") == {"insult": 2}
    assert counts("no " * 50 + "x y z idiot") == {"insult": 1}
    assert counts("idiot " * 1000)["insult"] == 1000
    assert counts("") == {}


def test_long_clauses_are_read_whole():
    far = "word " * 300
    assert counts("He said " + far + "you are a moron") == {"reported": 1}
    assert counts("He said you idiot " + far + "moron " + far + "scum") == {"reported": 3}
    assert counts("He said so. " + far + "moron") == {"insult": 1}


def test_composition_equals_the_machines_in_turn():
    machines = [toxicity.negation(), toxicity.reported(), toxicity.directed(), toxicity.threat()]
    table = toxicity.compose(machines, toxicity.CLASSES)
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choices(toxicity.CLASSES, k=rng.randint(0, 25)))
        state, got = (0, 0, 0, 0), ""
        for c in text:
            state, out = table[state, c]
            got += out
        want = text
        for m in machines:
            s, out = 0, ""
            for c in want:
                s, x = m.step(s, c)
                out += x
            want = out
        assert got == want


@pytest.mark.parametrize("size, least", [("sf0.01", {"en": 0.9}), ("sf0.1", {"en": 0.85, "de": 0.9, "fr": 0.9})])
def test_toxicity_of_held_out_documents(spark, size, least):
    """Recall by language and false hits on rows that taught nothing; with few labels only the largest language can be learned."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    hits = {True: [], False: []}
    for r in labels.collect():
        x = got[r["doc_id"]]
        assert x["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and x["predicted"] == int(x["score"] >= 0.7)
        if x["held_out"]:
            hits[r["toxic"] == 1].append((lang[r["doc_id"]], x["predicted"]))
    assert sum(p for _, p in hits[False]) <= 0.02 * len(hits[False])
    for name, share in least.items():
        own = [p for x, p in hits[True] if x == name]
        assert sum(own) >= share * len(own), name
    if size == "sf0.1":
        assert sum(p for _, p in hits[True]) >= 0.88 * len(hits[True])


def test_learned_words_equal_brute_force(spark):
    """Support counts the first row of each word between two neighbours; copies, and a word that one row repeats, are no evidence."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=30)
        if toxic := int(i % 4 == 0):
            words[rng.randrange(30)] = words[rng.randrange(30)] = "Grobian"
        rows.append((i, toxic, " ".join(words)))
    rows += [(200 + i, 1, "copied words " + "einmalig " * 3) for i in range(60)] + [(300, 1, "echo x echo y echo z echo"), (301, 0, None), (302, 0, "")]
    first = {}
    for d, y, t in rows:
        ws = (t or "").lower().split()
        for x, w, z in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
            first[w, x, z, y] = min(d, first.get((w, x, z, y), d))
    want = {}
    for (w, _, _, y), d in first.items():
        want.setdefault(w, ([set(), set()]))[y].add(d)
    table = spark.createDataFrame(rows, "doc_id long, toxic int, text string").repartition(5)
    assert {r["w"]: (r["a"], r["b"]) for r in toxicity.support(table).collect()} == {w: (len(v[1]), len(v[0])) for w, v in want.items()}
    assert toxicity.learn(table) == {"grobian": "I"}
    lexicon = toxicity.Lexicon.of({"grobian": "I", "not": "I", "kill": "S"})
    assert lexicon.classes["not"] == "N" and lexicon.classes["kill"] == "V" and toxicity.matches("Du GROBIAN. you grobian".encode(), lexicon)[:2].tolist() == [1, 1]


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "you idiot", "c"), (3, "fine", "d"), (3, "fine", "d"), (4, "you moron " * 2000, "e")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, none).collect()
    assert len(got) == 6 and {r["predicted"] for r in got if r["doc_id"] in (None, 4)} == {1} and {r["predicted"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    odd = spark.createDataFrame([(1, 0, None), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.toxicity(df, odd).collect()) == 6
    assert toxicity.toxicity(df.limit(0), odd).collect() == []
