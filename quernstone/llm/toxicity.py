"""Toxicity by a weighted finite-state pattern grammar.

A word is first sent to a class by a lexicon. Four small transducers then rewrite the class string of a clause, each in one
concern - what a negation covers, what is reported speech, who is addressed, what is a threat - and are composed into one
machine by the product construction. Its outputs are *matches of patterns* ("directed insult", "negated insult", ...), and
the score is a logistic function of their counts, whose weights start from priors and are fitted to a bounded sample of
labelled rows. A clause without an insult or a threat word has no match, so only clauses with such a word are read, each as a whole.

The lexicon has fixed words and learned ones, of any language: a word of the sampled rows is an insult, or on less evidence a slight, if it
stands in toxic rows more often than chance allows (a Chernoff bound of the binomial test, corrected for the number of words).
A row counts for a word only where it is the first (smallest doc_id) to show the word between these two neighbours, so neither copies of
a text nor a word that one text repeats are taken for evidence.

Defined cases: null and empty texts have no match and get the base score; rows that repeat a doc_id are scored alike if their
texts are, and one of them teaches; of contradicting labels of a doc_id the larger one counts; a null doc_id is not held out and teaches nothing; without labels
the prior weights and fixed words hold; an empty table gives no rows; columns other than doc_id and text are not read for a score.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch
from .language import held_out

#: Labelled rows that words and weights are learned from, at most; chosen by hash of doc_id.
SAMPLE = 20_000
#: Words that chance alone may make insults, and slights, in one fit; and the chance of a word to become a slight, at most.
STRONG, WEAK, RARE = 0.01, 100.0, 1e-3
#: A learned word is so many times as frequent in toxic rows as in others, at least.
TIMES = 4.0

# Word lists: fixed values, in natural order.
INSULTS = "idiot idiots idiotic imbecile imbeciles moron morons moronic stupid scum scumbag bastard bastards bitch bitches asshole assholes dumbass retard retarded cretin vermin subhuman idiota idiote estúpido estúpida imbécil imbécile dummkopf arschloch abschaum connard salaud".split()
SLIGHTS = "clown clowns coward disgusting filth filthy fool fools garbage hideous loser losers pathetic pig pigs rat rats trash ugly useless worthless".split()
THREATS = "kill hurt destroy beat shoot stab burn murder strangle attack punch hang töten umbringen tuer matar".split()
INTENT = "will gonna shall going should must ll".split()
TARGETS = "you your yours yourself u ya ur they them their he him she her we us all everyone everybody".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot".split()
REPORTED = "said says say saying told tells wrote writes claimed claims called calls quoted reported according alleged".split()

#: Pattern matches in the order of the weights, and their prior weights.
PATTERNS = ("insult", "directed insult", "slight", "directed slight", "threat", "negated", "reported")
PRIOR = np.array([-3.0, 5.6, 6.5, 4.5, 5.6, 6.5, 0.5, 0.5])  # the first is the base score


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, outputs); a pair that is missing copies the symbol and returns to state 0."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (0, symbol))


def compose(machines: list[Transducer], symbols: str) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """The reachable part of the product: each machine reads what the one before it writes."""
    start = (0,) * len(machines)
    table, open_ = {}, [start]
    while open_:
        state = open_.pop()
        for symbol in symbols:
            now, text = list(state), symbol
            for i, m in enumerate(machines):
                out = ""
                for c in text:
                    now[i], got = m.step(now[i], c)
                    out += got
                text = out
            to = tuple(now)
            if (state, symbol) not in table:
                table[state, symbol] = (to, text)
                if all((to, s) not in table for s in symbols) and to != state:
                    open_.append(to)
    return table


# Classes: I insult, S slight, V threat verb, M intent, T target, N negation, R reporting verb, X other.
# Rewritten: n negated, r reported, D directed insult, E directed slight, H threat.
CLASSES = "ISVMTNRX"


def negation(reach: int = 3) -> Transducer:
    """An insult, slight or threat at most ``reach`` words after a negation is negated."""
    arcs = {(s, "N"): (1, "N") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, c): (0, "n") for c in "ISV"}
        arcs |= {(s, c): ((s + 1) % (reach + 1), c) for c in "MTRX"}
    return Transducer(arcs)


def reported() -> Transducer:
    """What follows a reporting verb in its clause is reported."""
    return Transducer({(0, "R"): (1, "R")} | {(1, c): (1, "r") for c in "ISV"} | {(1, c): (1, c) for c in "MTNRXnr"})


def directed(reach: int = 3) -> Transducer:
    """An insult or slight at most ``reach`` words after a target is directed."""
    arcs = {(s, "T"): (1, "T") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, "I"): (s, "D"), (s, "S"): (s, "E")}
        arcs |= {(s, c): ((s + 1) % (reach + 1), c) for c in "VMNRXnr"}
    return Transducer(arcs)


def threat(reach: int = 4) -> Transducer:
    """A threat verb after a word of intent, or before a target, within ``reach`` words; any other one is nothing."""
    arcs = {}
    for s in range(2 * reach + 1):
        arcs |= {(s, "M"): (1, "M"), (s, "V"): (reach + 1, "X")}
        if s:
            last = s in (reach, 2 * reach)
            arcs |= {(s, c): (0 if last else s + 1, c) for c in "ISNRXnrDE"}
            arcs[s, "T"] = (0, "TH") if s > reach else (0 if last else s + 1, "T")
            if s <= reach:
                arcs[s, "V"] = (0, "H")
    return Transducer(arcs)


@lru_cache(1)
def _machine() -> dict:
    return compose([negation(), reported(), directed(), threat()], CLASSES)


@dataclass(frozen=True)
class Lexicon:
    """Words by class; ``hot`` are those without which a clause has no match."""

    classes: dict[str, str]
    hot: frozenset[str]

    @classmethod
    def of(cls, learned: dict[str, str] | None = None) -> Lexicon:
        """The fixed words and learned ones. A word that steers (target, negation, report, intent) or threatens keeps its fixed class."""
        fixed = {w: c for c, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTED), ("M", INTENT), ("V", THREATS), ("S", SLIGHTS), ("I", INSULTS)) for w in ws}
        classes = fixed | {w: c for w, c in (learned or {}).items() if fixed.get(w, "X") in "ISX"}
        return cls(classes, frozenset(w for w, c in classes.items() if c in "ISV"))


FIXED = Lexicon.of()
_CLAUSE = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_COUNTED = {"I": 0, "D": 1, "S": 2, "E": 3, "H": 4, "n": 5, "r": 6}


def folded(text: bytes) -> str:
    """The text as it is read: in lower case, with one kind of apostrophe."""
    return text.decode("utf-8", "replace").lower().replace("’", "'")


def matches(text: bytes, lexicon: Lexicon = FIXED) -> np.ndarray:
    """Counts of PATTERNS in a text."""
    out = np.zeros(len(PATTERNS))
    whole = folded(text)
    if lexicon.hot.isdisjoint(_WORD.findall(whole)):
        return out
    table = _machine()
    for clause in _CLAUSE.split(whole):
        words = _WORD.findall(clause)
        if lexicon.hot.isdisjoint(words):
            continue
        state: tuple[int, ...] = (0, 0, 0, 0)
        for w in words:
            state, got = table[state, lexicon.classes.get(w, "X")]
            for c in got:
                if c in _COUNTED:
                    out[_COUNTED[c]] += 1
    return out


def features(docs: DataFrame, keep: list[str], lexicon: Lexicon = FIXED) -> DataFrame:
    """Columns ``keep`` and the pattern counts (array) of every row; whole texts are read."""

    def run(batches):
        for rows, data, offsets in blocks.blocks(batches):
            held, at = data.tobytes(), offsets.tolist()
            got = [matches(held[a:b], lexicon).tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(1, rows.num_columns)), pa.array(got, pa.list_(pa.float64()))], names=[*rows.schema.names[1:], "f"])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{shape}, f array<double>")


def support(rows: DataFrame) -> DataFrame:
    """(w, a, b) from (doc_id, toxic, text): in how many toxic rows, and in how many others, a word counts."""

    def run(batches):
        for part, data, offsets in blocks.blocks(batches):
            held, at = data.tobytes(), offsets.tolist()
            ids, toxic = part.column(1), part.column(2)
            words, near, row = [], [], []
            for i in range(part.num_rows):
                ws = _WORD.findall(folded(held[at[i] : at[i + 1]]))
                seen = {(w, zlib.crc32(f"{x} {y}".encode())) for x, w, y in zip(["", *ws], ws, [*ws[1:], ""], strict=False)}
                words += [w for w, _ in seen]
                near += [n for _, n in seen]
                row += [i] * len(seen)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), ids.take(take), toxic.take(take)], names=["w", "near", "doc_id", "toxic"])

    shown = rows.select("text", "doc_id", "toxic").mapInArrow(run, "w string, near long, doc_id long, toxic int")
    first = shown.groupBy("w", "near", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return first.select("w", "toxic", "doc_id").distinct().groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


def learn(rows: DataFrame, owner: str = "query") -> dict[str, str]:
    """Classes of the words that mark toxic rows, from (doc_id, toxic, text) of at most SAMPLE doc_ids.

    With q the share of toxic rows in all support, a word of a toxic and b other rows exceeds it by chance with a probability of
    at most exp(-(a + b) * KL(a / (a + b), q)). At least log(1 / RARE) / log(1 / q) rows are needed, so the words that reach the
    driver are fewer than those of the sample by that factor.
    """
    held = scratch.save(support(rows), "support", owner)
    n, a, b = held.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    if not a or not b:
        return {}
    q, r = a / (a + b), F.col("a") / (F.col("a") + F.col("b"))
    other = F.when(F.col("b") > 0, (1 - r) * F.log((1 - r) / (1 - q))).otherwise(0.0)
    told = held.where((F.col("a") > 0) & (r > q)).withColumn("nats", (F.col("a") + F.col("b")) * (r * F.log(r / q) + other))
    times = (F.col("a") + 0.5) / (F.col("b") + 0.5) / (a / b)
    least = -math.log(min(RARE, WEAK / n))
    found = told.where((F.col("nats") >= least) & (times >= TIMES)).select("w", "nats").collect()
    return {x["w"]: "I" if x["nats"] >= math.log(n / STRONG) else "S" for x in found}


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.3, steps: int = 30) -> np.ndarray:
    """Logistic weights of log(1 + counts), with a Gaussian prior around PRIOR."""
    z = np.column_stack([np.ones(len(x)), np.log1p(x)]) if len(x) else np.zeros((0, len(PRIOR)))
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + strength * (w - PRIOR)
        hess = (z * (p * (1 - p))[:, None]).T @ z + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def score(table: DataFrame, w: np.ndarray) -> Column:
    terms = [F.log1p(F.element_at("f", i + 1)) * float(v) for i, v in enumerate(w[1:])]
    return 1 / (1 + F.exp(-(sum(terms, F.lit(float(w[0]))))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, owner: str = "query") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels (doc_id, toxic) teach where they are not held out."""
    known = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(~held_out(3, 1))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    drawn = scratch.save(known.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(sample), "drawn", owner)
    drawn = F.broadcast(drawn)  # at most ``sample`` rows of two numbers
    lexicon = Lexicon.of(learn(docs.select("doc_id", "text").join(drawn, "doc_id"), owner))
    found = features(docs.select("doc_id", "text").withColumn("held_out", held_out(3, 1)), ["doc_id", "held_out"], lexicon)
    found = scratch.save(found, "matches", owner)
    rows = found.join(drawn, "doc_id").groupBy("doc_id").agg(F.min("f").alias("f"), F.first("toxic").alias("toxic")).orderBy("doc_id").toPandas()  # at most ``sample`` rows
    w = fit(np.array(rows["f"].tolist()).reshape(len(rows), len(PATTERNS)), rows["toxic"].to_numpy(float))
    return found.select("doc_id", "held_out", score(found, w).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
