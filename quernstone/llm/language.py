"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over *all* its
segmentations into pieces, by the forward algorithm; a text's log-likelihood is the sum over its words. The piece
probabilities are learned by expectation maximisation (forward-backward over all segmentations) on all words of a bounded sample of
labelled texts, in executors; only expected counts of pieces reach the driver. The forward pass runs over all distinct words of a block at once, one byte position
after another; words that blocks before it held are not scored again, as far as a bounded cache goes.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; words longer than CHUNK bytes are cut before the
character that passes them, and the segmentations of each part are summed by itself; equal scores go to the first language by name; a null doc_id is not held out; without any labelled row every
text is ``und``; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, scratch
from .packing import tokenizer_file

#: Bound of what is learned from: labelled texts (chosen by hash), with all their words.
SAMPLE = 6000
#: Bytes of the longest part of a word, and so of a piece that can occur.
CHUNK = LONGEST = 256
#: Up to this length a product of piece probabilities is within the range of a double; longer words are summed as logarithms.
PLAIN = 32
#: Numbers (words times languages) of the cache of word scores that a task keeps.
CACHE = 1 << 20
#: Expected counts are rounded to one in so many.
PARTS = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


@lru_cache(2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and lengths of the vocabulary's pieces that have no space inside, every byte included; a leading space is dropped, case is folded."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    got = {bytes(byte[c] for c in t).strip(b" \t\n\r\x0b\x0c").lower() for t in vocabulary} | {bytes([b]) for b in range(256)}
    got = sorted(x for x in got if 0 < len(x) <= LONGEST and not blocks._SPACE[list(x)].any() or len(x) == 1)
    data = np.frombuffer(b"".join(got), np.uint8)
    ends = np.cumsum([len(x) for x in got])
    h = blocks.word_hashes(data, np.concatenate(([0], ends[:-1])), ends)
    order = np.argsort(h)
    return h[order], np.array([len(x) for x in got])[order]


@lru_cache(2)
def _filter(path: str) -> tuple[np.ndarray, list[int]]:
    """Which values the first 22 bits of a piece's hash take, and the lengths that pieces have."""
    hashes, sizes = pieces(path)
    out = np.zeros(1 << 22, bool)
    out[hashes >> np.uint64(42)] = True
    return out, np.unique(sizes).tolist()


@dataclass(frozen=True)
class Sums:
    """How probabilities are held, multiplied and added: as they are, or as logarithms."""

    zero: float
    one: float
    times: Callable
    plus: Callable
    held: Callable  # from probabilities
    log: Callable
    share: Callable  # a * b / total as probability


PLAINLY = Sums(0.0, 1.0, np.multiply, np.add, lambda p: p, np.log, lambda a, b, total: a * b / total)
BY_LOG = Sums(-np.inf, 0.0, np.add, np.logaddexp, np.log, lambda x: x, lambda a, b, total: np.exp(a + b - total))


class Lattice:
    """Distinct words as byte rows, and the piece at each (word, start, length)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str):
        self.hashes, _ = pieces(path)
        self.maybe, self.sizes = _filter(path)
        order = np.argsort(ends - starts, kind="stable")[::-1]  # longest first: those still going at a position come first
        self.order, self.starts, self.length = order, starts[order], (ends - starts)[order]
        self.longest = int(self.length[0]) if len(order) else 0
        self.sums, self.inverse = blocks._sums(data)

    def reach(self, position: int) -> int:
        """How many words reach ``position``."""
        return int(np.searchsorted(-self.length, -position, "right"))

    def at(self, position: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each length of a piece that ends at ``position``: the words that have one there, and which."""
        n = self.reach(position)
        for size in self.sizes:
            if size > position:
                break
            a = self.starts[:n] + (position - size)
            h = blocks.mix((self.sums[a + size] - self.sums[a]) * self.inverse[a] + np.uint64(size))
            some = np.flatnonzero(self.maybe[h >> np.uint64(42)])
            h = h[some]
            k = np.searchsorted(self.hashes, h)
            k[k == len(self.hashes)] = 0
            found = np.flatnonzero(self.hashes[k] == h)
            if len(found):
                yield size, some[found], k[found]


def forward(lattice: Lattice, p: np.ndarray, how: Sums = PLAINLY) -> np.ndarray:
    """Table (words, positions, languages) of the summed probability of all segmentations up to each position; p: (pieces, languages)."""
    p = how.held(p)
    table = np.full((len(lattice.length), lattice.longest + 1, p.shape[1]), how.zero)
    table[:, 0] = how.one
    for j in range(1, lattice.longest + 1):
        for size, found, k in lattice.at(j):
            table[found, j] = how.plus(table[found, j], how.times(table[found, j - size], p[k]))
    return table


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    p: np.ndarray  # pieces x languages
    path: str

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log probability of each word in each language."""
        out = np.zeros((len(starts), len(self.languages)))
        plain = ends - starts <= PLAIN
        for which, how in ((np.flatnonzero(plain), PLAINLY), (np.flatnonzero(~plain), BY_LOG)):
            if len(which):
                out[which] = self._words(Lattice(data, starts[which], ends[which], self.path), how)
        return out

    def _words(self, lattice: Lattice, how: Sums) -> np.ndarray:
        # of the table of forward() only the positions that a piece can reach back to are kept
        p, shape = how.held(self.p), len(self.languages)
        out = np.zeros((len(lattice.length), shape))
        back = min(lattice.longest, lattice.sizes[-1]) + 1
        ring = [np.full((len(lattice.length), shape), how.one)] + [np.zeros((0, shape))] * (back - 1)
        for j in range(1, lattice.longest + 1):
            n = lattice.reach(j)
            now = np.full((n, shape), how.zero)
            for size, found, k in lattice.at(j):
                now[found] = how.plus(now[found], how.times(ring[(j - size) % back][found], p[k]))
            ring[j % back] = now
            last = np.flatnonzero(lattice.length[:n] == j)
            out[lattice.order[last]] = how.log(now[last])
        return out


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut to CHUNK bytes at most: starts, ends and the index of the word. A cut steps back to the start of its character."""
    n = 1 + np.maximum(0, ends - starts - 1) // (CHUNK - 3)
    of = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a = starts[of] + k * (CHUNK - 3)
    for _ in range(3):
        a = a - ((k > 0) & (data[np.minimum(a, len(data) - 1)] >> 6 == 2)) if len(a) else a
    b = np.append(a[1:], 0)
    whole = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    return a, np.where(whole, ends[of], b), of


def expectation(p: np.ndarray, names: list[str], path: str):
    """For mapInArrow over (lang, w, c): how often each piece is expected in the words of a partition, in whole PARTS, so that sums have no order."""

    def count(lattice: Lattice, lang: np.ndarray, c: np.ndarray, how: Sums, expected: np.ndarray) -> None:
        lang, c, q = lang[lattice.order], c[lattice.order], how.held(p)
        words = np.arange(len(lang))
        alpha, beta = (np.full((len(lang), lattice.longest + 1), how.zero) for _ in range(2))
        alpha[:, 0] = how.one
        steps = [(j, *x) for j in range(1, lattice.longest + 1) for x in lattice.at(j)]
        for j, size, found, k in steps:
            alpha[found, j] = how.plus(alpha[found, j], how.times(alpha[found, j - size], q[k, lang[found]]))
        beta[words, lattice.length] = how.one
        total = alpha[words, lattice.length]
        for j, size, found, k in reversed(steps):
            flow = how.times(q[k, lang[found]], beta[found, j])
            np.add.at(expected, (k, lang[found]), how.share(alpha[found, j - size], flow, total[found]) * c[found])
            beta[found, j - size] = how.plus(beta[found, j - size], flow)

    def run(batches):
        expected = np.zeros_like(p)
        for batch in batches:
            w = batch.column("w").cast(pa.large_binary())
            offsets = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
            if not len(w):
                continue
            data = np.frombuffer(w.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            starts, ends, of = chunks(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            weight = batch.column("c").to_numpy().astype(float)[of]
            lang = np.searchsorted(np.array(names), np.array(batch.column("lang").to_pylist(), str))[of]
            for i in range(0, len(starts), 2_000):
                a, b, own, c = (x[i : i + 2_000] for x in (starts, ends, lang, weight))
                near, a, b = data[a[0] : b[-1]], a - a[0], b - a[0]  # words lie in a row
                plain = b - a <= PLAIN
                for which, how in ((np.flatnonzero(plain), PLAINLY), (np.flatnonzero(~plain), BY_LOG)):
                    if len(which):
                        count(Lattice(near, a[which], b[which], path), own[which], c[which], how, expected)
        piece, lang = np.nonzero(expected)
        n = np.rint(expected[piece, lang] * PARTS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(n)], names=["piece", "lang", "n"])

    return run


def fit(docs: DataFrame, train: Column, path: str | None = None, rounds: int = 3, sample: int = SAMPLE) -> Model | None:
    """Learns from at most about ``sample`` texts whose lang is known and for which ``train`` holds."""
    path = path or tokenizer_file()
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not per:
        return None
    part = min(1.0, sample / sum(per.values()))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    words = F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"))
    counts = drawn.select("lang", words.alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("c")).sortWithinPartitions("lang", "w")
    counts = scratch.save(counts, "words", "fit")
    names = sorted(per)
    _, sizes = pieces(path)
    p = np.repeat((4.0 ** -sizes)[:, None], len(names), 1)
    p /= p.sum(axis=0)
    for _ in range(rounds):
        expected = np.zeros_like(p)
        got = counts.mapInArrow(expectation(p, names, path), "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # bounded by the vocabulary
        expected[got["piece"].to_numpy(int), got["lang"].to_numpy(int)] = got["n"].to_numpy(float) / PARTS
        p = expected + 0.05
        p /= p.sum(axis=0)
    scratch.release(docs.sparkSession, "fit")
    prior = np.array([per[x] for x in names], float)
    return Model(names, np.log(prior / prior.sum()), p, path)


class _Scored:
    """Scores of words by hash; what a block needs beyond ``CACHE`` numbers takes the place of what is held."""

    def __init__(self, model: Model):
        self.model = model
        self.h, self.s = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """log probabilities of words with these (sorted, distinct) hashes."""
        k = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        new = self.h[k] != h if len(self.h) else np.ones(len(h), bool)
        out = np.zeros((len(h), len(self.model.languages)))
        out[~new] = self.s[k[~new]] if len(self.h) else 0
        a, b, of = chunks(data, starts[new], ends[new])
        got = np.zeros((int(new.sum()), out.shape[1]))
        np.add.at(got, of, self.model.words(data, a, b))
        out[new] = got
        if (len(self.h) + len(got)) * out.shape[1] > CACHE:
            self.h, self.s = h, out
        else:
            at = np.searchsorted(self.h, h[new])
            self.h, self.s = np.insert(self.h, at, h[new]), np.insert(self.s, at, got, axis=0)
        return out


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, lang_pred and score: the posterior of that language, which is the largest. ``text`` may be one of them; it moves once."""
    sent = docs.select(*keep, *([text] if text not in keep else []))

    def run(batches):
        scored = _Scored(model) if model else None
        for rows, data, offsets in blocks.blocks(batches, text):
            n = rows.num_rows
            names, score = ["und"] * n, np.zeros(n)
            if model:
                data = blocks.lowered(data)
                starts, ends, first = blocks.spans(data, offsets)
                h, one, inverse = np.unique(blocks.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                likely = scored.words(data, starts[one], ends[one], h)
                sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(likely[inverse], axis=0)])
                total = sums[first[1:]] - sums[first[:-1]] + model.log_prior
                best = total.argmax(axis=1)
                total -= total.max(axis=1, keepdims=True)
                score = 1 / np.exp(total).sum(axis=1)
                letters = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
                some = letters[offsets[1:]] > letters[offsets[:-1]]
                held = data.tobytes()
                for i in range(n):
                    if some[i] or offsets[i] < offsets[i + 1] and _LETTER.search(held[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")):
                        names[i] = model.languages[best[i]]
                    else:
                        score[i] = 0
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    shape = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return sent.mapInArrow(run, shape)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = fit(docs, ~F.col("held_out"))
    return identify(docs, model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least this posterior."""
    model = fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    numbered = [f"_{i}" for i in range(len(docs.columns))]  # names of their own, as the prediction adds two
    found = identify(docs.toDF(*numbered), model, numbered, numbered[docs.columns.index("text")])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*numbered).toDF(*docs.columns)
