"""Toxicity by weak supervision.

Many voters mark texts: words of abuse, patterns, and up to MINED_VOTERS words, stems and character n-grams that the
training labels show to go with abuse, so that languages without a word list have voters too. Labels of training
rows are two more voters, noisy ones. A generative label model is fitted by expectation maximisation to the votes of
all training rows: a two-class mixture in which each voter has a firing rate for each class and, where votes stay
correlated within a class, depends on one other voter (a maximum spanning forest over the conditional mutual
information); the rates with and without that other voter are estimated in the same rounds. Its posterior labels train
a sparse linear classifier on words, stems and n-grams (by 64-bit hashes), which scores every text.

What grows with the data stays in Spark: vote patterns are counted there and every round of the fit is one aggregation
with as many sums as there are voters and links. Voters are mined and the classifier is trained on at most ``TRAIN_ROWS``
labelled rows; the features looked at are those in most toxic rows of these, CANDIDATES at most.

A feature becomes a voter when nearly all rows that have it are labelled toxic and it explains at least LEAST_NEW toxic rows
that no voter before it does; near copies count once. So a word that only shares its texts with abuse never votes.

Defined results: a null or empty text has no features and gets the classifier's base score. Repeated rows are
scored each. Rows with a null doc_id are scored but never trained on; a repeated doc_id is trained on once, with its least
text. An empty table gives no rows. Without any labelled training row the lexicon's voters alone make the labels. An
extra column named like the score gives way to it in scored rows, and stays as it is where rows are only dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscope.llm.common import blocks, bound_batches, free_name, materialize, plain_names, text_or_empty, utf8_buffers
from turnscope.llm.words import BLOCK_BYTES, grams, hash_words, mix, prefixes, shingles

#: Bound on the labelled rows that are mined for voters and train the classifier.
TRAIN_ROWS = 6_000
#: Features that are looked at, and those that the classifier may weigh.
CANDIDATES = 1 << 16
MODEL_FEATURES = 1024
MINED_VOTERS = 64
#: Toxic rows that a mined voter explains first, and the share of its rows that are toxic.
LEAST_NEW, PRECISION = 3, 0.8
THRESHOLD = 0.7
#: Labels of either class are wrong as often as this at most.
LABEL_NOISE = 0.02
#: Bytes of a stem, and of a character n-gram inside a word.
STEM = (3, 9)
GRAM = 6
#: Conditional mutual information (nats a row) from which two voters are linked.
LINK = 1e-4
_SOURCES = 3

#: Words of abuse; each is one voter.
LEXICON = """
idiot moron imbecile stupid dumb fool loser scum trash worthless pathetic disgusting clown garbage vermin
filthy bastard bitch asshole shit fuck fucking crap slut whore retard retarded coward pig swine freak
subhuman parasite hateful
""".split()

#: Patterns of abuse on lower-cased text; each is one voter, behind a literal that it contains.
PATTERNS = (
    ("you", r"\byou(?:'re| are)(?: all)?(?: an?| such an?)? (?:" + "|".join(LEXICON) + r")s?\b"),
    ("shut", r"\bshut (?:the \w+ )?up\b"),
    ("kill", r"\bkill (?:yourself|yourselves|them all)\b"),
    ("hate", r"\bi hate (?:you|them|those|all)\b"),
    ("go ", r"\bgo (?:to hell|die)\b"),
)
_COMPILED = [(literal, re.compile(p)) for literal, p in PATTERNS]
N_FIXED = len(LEXICON) + len(PATTERNS)
#: Behind the others: one voter fires on label 1, one on label 0.
LAST_VOTERS = 2


def feature_blocks(texts: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """(first row, last row + 1, parts, word hashes, row starts) over blocks of bounded bytes. ``parts`` yields (row in the block,
    feature hash): of words, of their stems and of the n-grams inside them."""
    data, offsets = utf8_buffers(texts)
    for lo, hi in blocks(offsets, BLOCK_BYTES):
        own = offsets[lo : hi + 1]
        h, begin, rows = hash_words(data, own)
        yield lo, hi, _parts(data, own, h, begin, rows), h, rows


def _parts(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield np.repeat(np.arange(len(rows) - 1), np.diff(rows)), h
    yield from prefixes(data, offsets, begin, rows, *STEM)
    yield from grams(data, offsets, GRAM)


def distinct_features(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) pairs in order, each once."""
    row, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[first], h[first]


class Keys:
    """A few sorted hashes to be found among many: a small table passes over nearly all of them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << 16, bool)
        self.table[(keys >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``h``, place in the keys) of every hit."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        same = self.keys[at] == h[maybe]
        return maybe[same], at[same]

    def pairs(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, 2 * place in the keys) of every hit in order, each once, and (row, 2 * place + 1) where there are several."""
        found = [np.zeros(0, np.int64)]
        for row, h in parts:
            place, key = self.find(h)
            found.append(row[place] * len(self.keys) + key)
        both, n = np.unique(np.concatenate(found), return_counts=True)
        both = np.sort(np.concatenate((2 * both, 2 * both[n > 1] + 1)))
        return both // max(2 * len(self.keys), 1), both % max(2 * len(self.keys), 1)


def _lexicon_hashes() -> np.ndarray:
    data, offsets = utf8_buffers(pa.array([" ".join(LEXICON)]))
    return hash_words(data, offsets)[0]


def _said(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(row, pattern) of every pattern that a text has."""
    data, offsets = utf8_buffers(texts)
    for i in range(len(texts)):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        for k, (literal, pattern) in enumerate(_COMPILED):
            if literal.encode() in raw and pattern.search(raw.decode()):
                yield i, k


def votes(texts: pa.Array, mined: list[tuple[int, int]]) -> pa.ListArray:
    """The voters that fire on each text, in order: lexicon words, patterns, then mined features (hash, 1 if it takes several hits)."""
    known = [(int(h), 0) for h in _lexicon_hashes()] + list(mined)
    hashes = np.unique(np.array([h for h, _ in known], np.uint64))
    keys, voter = Keys(hashes), np.full(2 * len(hashes), -1)
    for j, (h, several) in enumerate(known):
        voter[2 * np.searchsorted(hashes, np.uint64(h)) + several] = j if j < len(LEXICON) else j + len(PATTERNS)
    rows, fired = [], []
    for lo, _, parts, _, _ in feature_blocks(texts):
        row, key = keys.pairs(parts)
        rows.append(lo + row[voter[key] >= 0])
        fired.append(voter[key][voter[key] >= 0])
    said = np.array(list(_said(texts)), np.int64).reshape(-1, 2)
    row, fired = np.concatenate([*rows, said[:, 0]]), np.concatenate([*fired, len(LEXICON) + said[:, 1]])
    order = np.lexsort((fired, row))
    starts = np.searchsorted(row[order], np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(fired[order].astype(np.int32)))


@dataclass
class LabelModel:
    """``prior``: the share of class 1. ``fire[c, j]``: how often voter j fires in class c. ``parent[j]``: the voter that j depends on, or
    -1; ``given[c, j]``: how often j fires where its parent does. ``correlation``: between voters within class 1."""

    prior: float
    fire: np.ndarray
    parent: np.ndarray
    given: np.ndarray
    correlation: np.ndarray

    def terms(self) -> tuple[float, np.ndarray, np.ndarray]:
        """(constant, by voter that fires, by voter that fires as its parent does) of the log odds of class 1."""
        on = np.log(self.fire[1] / self.fire[0])
        return math.log(self.prior / (1 - self.prior)), on, np.where(self.parent < 0, 0, np.log(self.given[1] / self.given[0]) - on)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Class 1 given which voters fired, one row a text; a voter that does not fire abstains."""
        constant, on, together = self.terms()
        linked = fired * np.where(self.parent < 0, 0, fired[:, self.parent])
        return 1 / (1 + np.exp(-np.clip(constant + fired @ on + linked @ together, -500, 500)))


def fit_label_model(patterns: DataFrame, fixed: int, voters: int, rounds: int = 12) -> LabelModel:
    """``patterns``: (fired, n), how many rows have each ordered list of fired voters. The first ``fixed`` voters start the fit,
    the last two are the labels'. The first half of the rounds takes voters for independent, the others know the links."""
    fire = np.full((2, voters), 0.05)
    fire[1, :fixed], fire[0, :fixed] = 0.2, 0.002
    fire[[0, 1], [-1, -2]], fire[[0, 1], [-2, -1]] = 0.3, 0.3 * LABEL_NOISE
    none = np.full(voters, -1)
    model = LabelModel(0.05, fire, none, fire, np.zeros((voters, voters)))

    def scored(m: LabelModel) -> DataFrame:
        constant, on, together = m.terms()
        on, together, up = (F.array(*(F.lit(x) for x in v.tolist())) for v in (on, together, m.parent))
        has = lambda j: F.array_contains("fired", F.get(up, j))
        add = lambda total, j: total + F.get(on, j) + F.when(has(j), F.get(together, j)).otherwise(0.0)
        logit = F.aggregate("fired", F.lit(constant), add)
        linked = F.transform(F.filter("fired", has), lambda j: j + F.lit(voters))
        return patterns.select("n", "fired", linked.alias("linked"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("p"))

    def sums(rows: DataFrame, *by: str) -> list:
        return rows.groupBy(*by).agg(F.sum(F.col("p") * F.col("n")).alias("one"), F.sum((1 - F.col("p")) * F.col("n")).alias("zero")).collect()

    for step in range(rounds):
        rows = scored(model)
        got = np.zeros((2, 2 * voters + 1))  # by voter, by linked voter, and of all rows
        for r in sums(rows.select("n", "p", F.explode(F.concat(F.array(F.lit(-1)), "fired", "linked")).alias("j")), "j"):
            got[:, r["j"]] = r["zero"], r["one"]
        n0, n1 = got[:, -1]
        if n1 + n0 == 0:
            return model
        prior = min(max(n1 / (n1 + n0), 1e-4), 0.5)
        fire = np.stack([(got[0, :voters] + 0.05) / (n0 + 50), (got[1, :voters] + 0.5) / (n1 + 5)])
        fire[1, :fixed] = np.maximum(fire[1, :fixed], fire[0, :fixed])  # abuse never speaks for class 0
        fire[[0, 1], [-2, -1]] = np.minimum(fire[[0, 1], [-2, -1]], LABEL_NOISE * fire[[0, 1], [-1, -2]])
        parent, correlation = model.parent, model.correlation
        if step == rounds // 2:
            pairs = rows.select("n", "p", "fired", F.explode("fired").alias("i")).select("n", "p", "i", F.explode("fired").alias("j")).filter("i < j")
            together = np.zeros((2, voters, voters))
            for r in sums(pairs, "i", "j"):  # at most voters squared rows come back
                together[:, r["i"], r["j"]] = together[:, r["j"], r["i"]] = r["zero"], r["one"]
            parent, correlation, got[:, voters:-1] = _links(together, got[:, :voters], np.array([n0, n1]))
        up = np.where(parent < 0, 0, parent)
        # Five rows of each class follow the rate of both, so a link without rows says nothing of the class.
        parents, joint = got[:, up], got[:, voters:-1]
        given = (joint + 5 * (joint.sum(axis=0) + 1e-3) / (parents.sum(axis=0) + 1e-3)) / (parents + 5)
        change = np.abs(np.log(fire / model.fire)).max() + abs(prior - model.prior) / prior
        model = LabelModel(prior, fire, parent, np.where(parent < 0, fire, np.clip(given, 1e-6, 1)), correlation)
        if change < 1e-3 and step > rounds // 2:
            break
    return model


def _links(together: np.ndarray, fired: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parents, correlations in class 1, sums of each voter with its parent): a maximum spanning forest over the conditional mutual
    information of voters, given how often each pair and each voter fires in each class."""
    voters = fired.shape[1]
    n = np.maximum(rows, 1e-9)[:, None, None]
    a, b, both = fired[:, :, None] / n, fired[:, None, :] / n, together / n
    information = np.zeros((voters, voters))
    for joint, expected in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
        joint = np.clip(joint, 0, 1)
        information += ((rows / rows.sum())[:, None, None] * joint * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=0)
    rate = np.clip(fired[1] / n[1, 0, 0], 1e-9, 1 - 1e-9)
    deviation = np.sqrt(rate * (1 - rate))
    correlation = np.clip((both[1] - np.outer(rate, rate)) / np.outer(deviation, deviation), -1, 1)
    np.fill_diagonal(correlation, 0)
    np.fill_diagonal(information, 0)
    parent = np.full(voters, -1)
    best, towards = np.zeros(voters), np.full(voters, -1)
    left = set(range(voters))
    while left:
        j = max(sorted(left), key=lambda j: best[j])
        left.remove(j)
        parent[j] = towards[j]
        closer = information[j] > np.maximum(best, LINK)
        best[closer], towards[closer] = information[j][closer], j
    sums = together[:, np.arange(voters), np.where(parent < 0, 0, parent)]
    return parent, correlation, np.where(parent < 0, 0, sums)


@dataclass
class Classifier:
    """Two weights for each feature with one of the sorted hashes ``keys``, for a hit and for several; others have none."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        row, key = Keys(self.keys).pairs(parts)
        margin = np.bincount(row, self.weights[key], minlength=rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def train_classifier(row: np.ndarray, feature: np.ndarray, hashes: np.ndarray, target: np.ndarray, rounds: int = 200, sparse: float = 0.5, ridge: float = 0.01, lift: float = 4.0, least: float = 3.0) -> Classifier:
    """Logistic regression on soft targets by Newton steps, with weights of at least 0 and a penalty of ``sparse`` on their
    sum, over the at most MODEL_FEATURES features that raise the share of class 1 by ``lift`` with a mass of at least
    ``least``. A feature gets a weight only where the others leave more than ``sparse`` rows of class 1 unexplained.
    ``feature`` has twice the places in the sorted ``hashes``, plus 1 for several hits."""
    n = len(target)
    share = min(max(float(target.mean()), 1e-3), 0.5) if n else 0.05
    seen = np.bincount(feature, minlength=2 * len(hashes))
    mass = np.bincount(feature, target[row], minlength=2 * len(hashes))
    good = np.flatnonzero((mass >= least) & (mass >= min(lift * share, 0.5) * seen))
    good = np.sort(good[np.argsort(-mass[good], kind="stable")][:MODEL_FEATURES])
    if not len(good):
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), math.log(share / (1 - share)))
    keep = np.isin(feature, good)
    x = np.zeros((n, len(good) + 1), np.float32)
    x[row[keep], np.searchsorted(good, feature[keep])] = 1
    x[:, -1] = 1
    pull = np.append(np.full(len(good), sparse), 0.0)
    w = np.append(np.zeros(len(good)), math.log(share / (1 - share)))

    def loss(w: np.ndarray) -> float:
        margin = x @ w
        return float(np.logaddexp(0, margin).sum() - target @ margin + pull @ w + ridge / 2 * (w[:-1] ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + pull + ridge * np.append(w[:-1], 0)
        # Newton steps over the weights in use and the few that would help most.
        entering = np.flatnonzero((w[:-1] <= 0) & (gradient[:-1] < -1e-3))
        entering = entering[np.argsort(gradient[entering], kind="stable")][:8]
        free = np.unique(np.concatenate((np.flatnonzero(w[:-1] > 0), entering, [len(good)])))
        xf = x[:, free].astype(np.float64)
        hessian = (xf * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ xf + (ridge + 1e-6) * np.eye(len(free))
        step = np.clip(np.linalg.solve(hessian, gradient[free]), -3, 3)
        size = 1.0
        while size > 1e-4:
            new = w.copy()
            new[free] -= size * step
            new[:-1] = np.maximum(new[:-1], 0)
            then = loss(new)
            if then < now:
                break
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * max(now, 1.0):
            break
        w, now = new, then
    weights = np.zeros(2 * len(hashes))
    weights[good] = w[:-1]
    used = np.flatnonzero(weights.reshape(-1, 2).any(axis=1))
    return Classifier(hashes[used], weights.reshape(-1, 2)[used].ravel(), float(w[-1]))


def _first_of_sources(sources: np.ndarray) -> np.ndarray:
    """Of rows that share a min-hash of their shingles - near copies, mostly - only the first."""
    first = np.ones(len(sources), bool)
    for column in sources.T:
        known = np.flatnonzero(column != 0)
        order = known[np.argsort(column[known], kind="stable")]
        first[order[1:][column[order[1:]] == column[order[:-1]]]] = False
    return first


def mine(row: np.ndarray, feature: np.ndarray, gold: np.ndarray, known: np.ndarray, features: int) -> np.ndarray:
    """Features that training labels mark as toxic nearly always, most explaining first: voters for what the fixed ones, which
    speak on the ``known`` rows, do not see. One that explains nothing new is none."""
    seen, bad = np.bincount(feature, minlength=features), np.bincount(feature, gold[row], minlength=features)
    good = np.flatnonzero((bad >= LEAST_NEW) & ((bad + 0.5) / (seen + 1) >= PRECISION))
    toxic = np.flatnonzero(gold == 1)
    keep = np.isin(feature, good) & (gold[row] == 1)
    has = np.zeros((len(good), len(toxic)), np.float32)
    has[np.searchsorted(good, feature[keep]), np.searchsorted(toxic, row[keep])] = 1
    open_ = ~known[toxic]
    chosen = []
    while len(chosen) < MINED_VOTERS and len(good):
        new = has @ open_.astype(np.float32)
        best = int(np.lexsort((-bad[good], -new))[0])
        if new[best] < LEAST_NEW:
            break
        chosen.append(int(good[best]))
        open_ &= has[best] == 0
    return np.array(chosen, np.int64)


def _sources(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A few min-hashes of every row's shingles; 0 without words."""
    s, starts = shingles(h, rows, 5)
    out = np.zeros((len(rows) - 1, _SOURCES), np.uint64)
    full = np.flatnonzero(np.diff(starts))
    for k in range(_SOURCES if len(full) else 0):
        out[full, k] = np.minimum.reduceat(mix(s ^ np.uint64(k + 1)), starts[full])
    return out


def _counted(rows: DataFrame, keys: np.ndarray | None) -> DataFrame:
    """(feature, n): in how many rows each feature is, or each of ``keys`` by its place. Summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if keys is None else Keys(keys)
        for batch in batches:
            for _, _, parts, _, _ in feature_blocks(batch.column(0)):
                found = distinct_features(parts)[1].view(np.int64) if known is None else _places(known.pairs(parts)[1])
                value, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["feature", "n"])

    return rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _places(keys: np.ndarray) -> np.ndarray:
    return keys[keys % 2 == 0] // 2


def _candidates(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the features of at least LEAST_NEW toxic rows of the sample that raise the share of toxic rows twofold."""
    toxic = _counted(sample.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_NEW)
    frequent = toxic.orderBy(F.desc("n"), "feature").limit(CANDIDATES).toArrow()
    hashes = frequent.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, bad = hashes[order], frequent.column(1).to_numpy()[order]
    everywhere = _counted(sample, hashes).toArrow()
    seen = np.zeros(len(hashes))
    seen[everywhere.column(0).to_numpy()] = everywhere.column(1).to_numpy()
    total = sample.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    return hashes[bad >= min(2 * total[1] / max(total[0], 1), 0.5) * seen]


@dataclass
class Sample:
    """The labelled rows: their labels, fixed voters, min-hashes, and (row, twice the place in ``hashes``, plus 1
    for several hits) of their features."""

    toxic: np.ndarray
    fixed: np.ndarray
    sources: np.ndarray
    hashes: np.ndarray
    row: np.ndarray
    feature: np.ndarray

    @staticmethod
    def read(sample: DataFrame, hashes: np.ndarray) -> Sample:
        """At most TRAIN_ROWS rows come to the driver, with their candidate features only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = Keys(hashes)
            for batch in batches:
                lists, sources = [], []
                for lo, hi, parts, h, rows in feature_blocks(batch.column(1)):
                    row, key = keys.pairs(parts)
                    lists += np.split(key.astype(np.int32), np.searchsorted(row, np.arange(1, hi - lo)))
                    sources += list(_sources(h, rows).view(np.int64))
                fired = votes(batch.column(1), [])
                yield pa.RecordBatch.from_arrays([batch.column(0), fired, pa.array(sources, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "fired", "sources", "features"])

        got = sample.select("toxic", "text").mapInArrow(run, "toxic int, fired array<int>, sources array<long>, features array<int>").toArrow().combine_chunks()
        n = got.num_rows
        flat = lambda c: (np.repeat(np.arange(n), pa.compute.list_value_length(got.column(c)).to_numpy()), pa.compute.list_flatten(got.column(c)).to_numpy()) if n else (np.zeros(0, np.int64),) * 2
        fixed = np.zeros((n, N_FIXED), bool)
        fixed[flat(1)] = True
        row, feature = flat(3)
        return Sample(got.column(0).to_numpy().astype(np.int64), fixed, flat(2)[1].reshape(n, _SOURCES), hashes, row, feature.astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, training: str) -> tuple[Classifier, LabelModel]:
    """Fit the label model and the classifier. ``docs``: doc_id, text; ``labels``: doc_id, toxic; ``training``: SQL
    that says of a doc_id whether its labels may be learnt from."""
    spark = docs.sparkSession
    bound_batches(spark)
    gold = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(training).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # bounded, so small enough to send
    texts = docs.select("doc_id", F.lower(text_or_empty()).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = materialize(spark, sample, "toxicity-sample")
    data = Sample.read(sample, _candidates(sample))
    toxic, row, feature, hashes = data.toxic, data.row, data.feature, data.hashes

    known = data.fixed.any(axis=1)
    once = _first_of_sources(data.sources)[row]
    places = mine(row[once], feature[once], toxic, known, 2 * len(hashes))
    mined = [(int(hashes[p // 2]), int(p % 2)) for p in places]
    fixed = N_FIXED + len(mined)
    voters = fixed + LAST_VOTERS

    def voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), votes(batch.column(1), mined)], ["doc_id", "fired"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    voted = texts.filter(training).mapInArrow(voting, f"doc_id {kind}, fired array<int>").join(gold, "doc_id", "left")
    says = F.when(F.col("toxic") == 1, F.array(F.lit(fixed))).when(F.col("toxic") == 0, F.array(F.lit(fixed + 1))).otherwise(F.array().cast("array<int>"))
    counted = voted.groupBy(F.concat("fired", says).alias("fired")).agg(F.count("*").alias("n"))
    model = fit_label_model(materialize(spark, counted, "toxicity-votes"), fixed, voters)

    fired = np.zeros((len(toxic), voters))
    fired[:, :N_FIXED] = data.fixed
    for j, place in enumerate(places):
        fired[row[feature == place], N_FIXED + j] = 1
    fired[:, fixed], fired[:, fixed + 1] = toxic == 1, toxic == 0
    return train_classifier(row, feature, hashes, model.posterior(fired)), model


def lexicon_classifier() -> Classifier:
    """What scores texts when there is nothing to train on: any lexicon word tips the balance."""
    keys = np.sort(_lexicon_hashes())
    return Classifier(keys, np.tile([5.0, 0.0], len(keys)), -3.0)


def score(docs: DataFrame, classifier: Classifier, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``; the classifier's size is bounded by MODEL_FEATURES, so it can be sent along."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch))
            for lo, hi, parts, _, _ in feature_blocks(batch.column(batch.num_columns - 1)):
                out[lo:hi] = classifier.score(parts, hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names)

    docs = docs.drop(name)
    names = [*docs.columns, name]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return plain_names(docs.select("*", F.lower(text_or_empty()))).mapInArrow(run, schema)


def score_corpus(docs: DataFrame, labels: DataFrame, training: str, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` from a classifier trained on what ``training`` allows."""
    classifier, _ = train(docs, labels, training)
    if not classifier.weights.any():
        classifier = lexicon_classifier()
    return score(docs, classifier, name)


def drop_toxic(docs: DataFrame, labels: DataFrame, training: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold."""
    name = free_name(docs, "toxicity")
    return score_corpus(docs, labels, training, name).filter(F.col(name) < threshold).drop(name)
