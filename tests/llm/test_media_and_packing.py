import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import flac, media, packing


def signals():
    rng = np.random.default_rng(0)
    n = flac.BLOCK
    text = np.frombuffer(("All of this is text, and some of it is long. " * 50).encode()[: n * 11], np.uint8)
    return [
        np.zeros(n, np.int8), np.full(2 * n, -128, np.int8), rng.integers(-128, 128, 10 * n).astype(np.int8), (100 * np.sin(np.arange(30 * n) / 20)).astype(np.int8),
        np.cumsum(rng.integers(-2, 3, 5 * n)).clip(-128, 127).astype(np.int8), np.repeat(np.array([127, -128], np.int8), 3 * n), (text ^ 0x80).view(np.int8),
        np.where(np.arange(n) == 77, 127, 0).astype(np.int8), np.tile(np.arange(-128, 64, dtype=np.int8), 200),
    ]


def test_streams_come_back_whole_and_plainly():
    xs = signals()
    streams = flac.encode(xs)
    for x, y in zip(xs, flac.decode(streams), strict=True):
        assert (x == y).all()
    for x, s in zip(xs, streams, strict=True):  # the same frames, one sample after another
        _, _, _, at = flac._parts(s)
        parts = []
        while at < len(s):
            got, at = flac.plain_frame(s, at)
            parts.append(got)
        assert (np.concatenate(parts) == x).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-128, 127), min_size=1, max_size=400), st.integers(1, 3))
def test_any_samples_come_back(values, repeat):
    x = np.resize(np.array(values, np.int8), flac.BLOCK * repeat)
    assert (flac.decode(flac.encode([x]))[0] == x).all()


def test_every_subframe_kind_is_used():
    kinds = set()
    for s in flac.encode(signals()):
        _, _, table, first = flac._parts(s)
        for p in np.frombuffer(table, [("s", ">u8"), ("o", ">u8"), ("n", ">u2")]):
            at = first + int(p["o"])
            extra = 0 if s[at + 4] < 0xC0 else 1
            kinds.add(s[at + 6 + extra] >> 1)
    assert {0, 1, 33} <= kinds and kinds & {8, 9, 10, 11, 12}


def test_a_changed_byte_is_noticed():
    s = flac.encode([signals()[3]])[0]
    for at in (30, len(s) // 2, len(s) - 1):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises(flac.Corrupt):
            flac.decode([bytes(bad)])


def test_media_columns(spark, frame):
    rows = [(1, "text é " * 200), (2, ""), (3, None), (4, "x" * 192), (5, "x" * 193), (6, "text é " * 200), (None, "y")]
    import hashlib

    got = media.media_columns(frame([(*r, 1) for r in rows], ", media int")).collect()
    by = {(r["doc_id"]): r for r in got}
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert by[1][1:] == by[6][1:] and by[2][1:] == by[3][1:]
    blocks = media.pcm_blocks(media.store(frame(rows[:1])), 500).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks)[: len(rows[0][1].encode())] == rows[0][1].encode() and [b["sample_offset"] for b in blocks] == [500 * i for i in range(len(blocks))]
    assert media.media_columns(frame([])).collect() == []


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.tokenizer_file()), packing.encoder(packing.tokenizer_file())
    rng = random.Random(2)
    texts = ["", "a", " \n\n x", "It's <|endoftext|> here<|endoftext|>", "日本語 ü é ñ ß", "a" * 3000, "1234 !!! ###\t\t", "   x", "don't we'll I'M"]
    texts += ["".join(rng.choices("ab \n\té1!'sß|<>", k=rng.randint(1, 200))) for _ in range(300)]
    for t in texts:
        assert tok.encode(t, add_special_tokens=False).ids == enc.encode(t, allowed_special="all")


def check_packing(got, rows, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    seqs = {}
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids) % capacity, len(ids) + 1, capacity))
        cuts = [c for c in dict.fromkeys([0, *cuts])]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return seqs, sum(w[3] for w in want)


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_packs_are_gapless_whole_and_few(frame, choose):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "of", "the", "Zürich"], k=int(rng.lognormvariate(3, 1))))) for i in range(300)] + [(7, "again"), (7, "again"), (None, "no id"), (400, None), (401, "")]
    rows.append((500, "word " * 900))
    got = packing.pack(frame([(*r, 1) for r in rows], ", piece int"), packing.Capacity(128, choose=choose)).collect()
    seqs, total = check_packing(got, rows, 128)
    assert len(seqs) <= -(-total // 128) + 2
    assert packing.pack(frame([])).collect() == []


def test_every_capacity_holds():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 40) for n in range(1, 65)}
    for capacity in (packing.Capacity(64, 3, None), packing.Capacity(64, None, 1500), packing.Capacity(64, 4, 2500, (1, 1, 1), "dot"), packing.Capacity(64)):
        limit = capacity.vector()
        if any(n * n > limit[2] for n in counts):
            with pytest.raises(ValueError, match="larger"):
                packing.plan(counts, capacity)
            small = {n: c for n, c in counts.items() if n * n <= limit[2]}
        else:
            small = counts
        runs, bins = packing.plan(small, capacity)
        inside = {}
        seen = {n: 0 for n in small}
        for length, first, items, b0, offset, per in runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist():
            assert first == seen[length]
            seen[length] += items
            for i in range(items):
                inside.setdefault(b0 + i // per, []).append((offset + i % per * length, length))
        assert seen == small and len(inside) == bins
        for parts in inside.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= limit[0] and len(parts) <= limit[1] and sum(n * n for _, n in parts) <= limit[2]


def test_words_are_those_of_the_contract():
    from quernstone.llm import blocks

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab é\t\n\x0b\x0c\r\x1c\x85 ", k=rng.randint(0, 30))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, first = blocks.spans(data, offsets)
    for i, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t)
