"""Full-text search: a query language, a positional inverted index as tables, and column-weighted BM25.

Words are ORed, quoted phrases are required, ``-word`` excludes. Every term is tokenised like the text, so a term
of several tokens is a phrase. Scores use statistics of the whole index, never of the filtered rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscope.functions.stemming import stems
from turnscope.operators.errors import BadRequest

# Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TURN_WEIGHTS = {"prompt": 3.0, "files": 2.0, "reply": 1.0, "commands": 0.5}
CANDIDATES = 200
DAY_MS = 86_400_000
BOOST, BOOST_DAYS, NO_REPLY = 0.3, 90.0, 0.5


@dataclass
class Parsed:
    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @property
    def scored(self) -> list[str]:
        """What adds to a score, as often as it does. Beside words, the first phrase counts once more."""
        return self.phrases + (self.phrases[:1] if self.words else []) + self.words

    @property
    def empty(self) -> bool:
        return not (self.words or self.phrases)


def parse_query(text: str) -> Parsed:
    """Split a query into words, phrases and exclusions; terms without a letter or number are dropped."""
    out, at = Parsed(), 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == '"':
            end = text.find('"', at + 1)
            end = len(text) if end < 0 else end
            kind, term, at = out.phrases, text[at + 1 : end], end + 1
        else:
            end = next((i for i in range(at, len(text)) if text[i].isspace()), len(text))
            term, at = text[at:end], end
            kind = out.words
            if len(term) > 1 and term[0] == "-":
                kind, term = out.excluded, term[1:]
        if any(c.isalnum() for c in term):
            kind.append(term)
    if out.empty and out.excluded:
        raise BadRequest("exclusions need at least one word or phrase to exclude from")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems_col(text: pd.Series) -> pd.Series:
    return text.map(lambda t: stems(t or ""))


def plain_tokens(text: Column) -> Column:
    """Tokens without stemming, in the JVM: lower case, cut at what is no letter or number."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(rows: DataFrame, key: Sequence[str], columns: Sequence[str], tokens: Callable[[Column], Column] = stems_col) -> DataFrame:
    """(key..., col, term, pos) of every token."""
    parts = [rows.select(*key, F.lit(c).alias("col"), F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("pos", "term")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*key, "col", "term", "pos")


def document_lengths(index: DataFrame, key: Sequence[str]) -> DataFrame:
    return index.groupBy(*key).agg(F.count("*").alias("dl"))


def corpus_stats(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: n documents (with or without tokens) and their average length."""
    return rows.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))


def phrase_hits(index: DataFrame, key: Sequence[str], terms: Sequence[str], split: Callable[[str], list[str]] = stems, weights: dict[str, float] | None = None) -> DataFrame:
    """(key..., phrase, f): the weighted number of occurrences of each distinct term, where it occurs.

    The query's tokens are a literal in the plan, so postings are filtered to them before anything moves; then
    a term's tokens are aligned by counting, per document and column, the places at which all of them meet.
    """
    wanted = [(term, tokens) for term in dict.fromkeys(terms) if (tokens := split(term))]
    places: dict[str, list[tuple[str, int, int]]] = {}
    for term, tokens in wanted:
        for i, token in enumerate(tokens):
            places.setdefault(token, []).append((term, i, len(tokens)))
    kind = "array<struct<phrase:string,i:int,n:int>>"
    at = F.lit(None).cast(kind)
    for token, uses in places.items():
        at = F.when(F.col("term") == token, F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("i"), F.lit(n).alias("n")) for p, i, n in uses))).otherwise(at)
    met = index.filter(F.col("term").isin(list(places))).select(*key, "col", "pos", F.explode(at).alias("use"))
    single = met.filter("use.n = 1").select(*key, "col", F.col("use.phrase").alias("phrase"))
    longer = met.filter("use.n > 1").groupBy(*key, "col", F.col("use.phrase").alias("phrase"), (F.col("pos") - F.col("use.i")).alias("start")).agg(F.count("*").alias("m"), F.max("use.n").alias("n"))
    found = single.unionByName(longer.filter("m = n").select(*key, "col", "phrase")) if any(len(t) > 1 for _, t in wanted) else single
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("col") == name, F.lit(w)).otherwise(weight)
    return found.groupBy(*key, "phrase").agg(F.sum(weight).alias("f"))


def matches(index: DataFrame, lengths: DataFrame, stats: DataFrame, query: Parsed, key: Sequence[str], split: Callable[[str], list[str]] = stems, weights: dict[str, float] | None = None) -> DataFrame:
    """(key..., bm25) of matching documents; lower is better."""
    times: dict[str, int] = {}
    for t in query.scored:
        times[t] = times.get(t, 0) + 1
    hits = phrase_hits(index, key, [*times, *query.excluded], split, weights)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))  # at most one row per term of the query
    times_col, required, excluded = F.lit(0), F.lit(0), F.lit(0)
    for t, n in times.items():
        times_col = F.when(F.col("phrase") == t, F.lit(n)).otherwise(times_col)
    required = F.col("phrase").isin(query.phrases).cast("int") if query.phrases else F.lit(0)
    excluded = F.col("phrase").isin(query.excluded).cast("int") if query.excluded else F.lit(0)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    norm = F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = -times_col * idf * F.col("f") * (K1 + 1) / norm
    scored = hits.join(F.broadcast(df), "phrase").join(lengths, list(key)).crossJoin(F.broadcast(stats))
    total = scored.groupBy(*key).agg(F.sum(part).alias("bm25"), F.sum(required).alias("required"), F.max(excluded).alias("excluded"), F.max(times_col).alias("scored"))
    needed = len(dict.fromkeys(p for p in query.phrases if split(p)))
    return total.filter((F.col("required") == needed) & (F.col("excluded") == 0) & (F.col("scored") > 0)).select(*key, "bm25")


def score_col(bm25: Column, date: Column, now_ms: int, has_reply: Column) -> Column:
    """Higher is better: newer turns gain, turns without a reply lose half."""
    age = F.greatest(F.lit(now_ms) - date, F.lit(0)) / F.lit(float(DAY_MS))
    return -bm25 * (1 + BOOST * F.exp(-age / BOOST_DAYS)) * F.when(has_reply, 1.0).otherwise(NO_REPLY)


def score(bm25: float, date: int, now_ms: int, has_reply: bool) -> float:
    age = max(now_ms - date, 0) / DAY_MS
    return -bm25 * (1 + BOOST * math.exp(-age / BOOST_DAYS)) * (1.0 if has_reply else NO_REPLY)


def ranked(matched: DataFrame, key: Sequence[str], now_ms: int, limit: int, offset: int = 0) -> DataFrame:
    """The page of matches (with date and has_reply) after rescoring the best candidates by BM25."""
    best = matched.orderBy("bm25", *key).limit(CANDIDATES)
    scored = best.withColumn("score", score_col(F.col("bm25"), F.col("date"), now_ms, F.col("has_reply")))
    return scored.orderBy(F.desc("score"), F.desc("date"), "bm25", *key).offset(offset).limit(limit)


def snippet(text: str, terms: Sequence[str], most: int = 24) -> str | None:
    """The part of ``text`` of at most ``most`` tokens with the most matched terms, null if none matches."""
    import re

    spans = [m.span() for m in re.finditer(r"\w+", text)]
    tokens = [" ".join(stems(text[a:b])) for a, b in spans]
    hit = [False] * len(tokens)
    for term in terms:
        wanted = stems(term)
        for i in range(len(tokens) - len(wanted) + 1):
            if wanted and tokens[i : i + len(wanted)] == wanted:
                hit[i : i + len(wanted)] = [True] * len(wanted)
    if not any(hit):
        return None
    starts = range(max(1, len(tokens) - most + 1))
    start = max(starts, key=lambda s: (sum(hit[s : s + most]), -s))
    end = min(start + most, len(tokens))
    left = "" if start == 0 else " … "
    right = "" if end == len(tokens) else " … "
    return left + text[0 if start == 0 else spans[start][0] : len(text) if end == len(tokens) else spans[end - 1][1]] + right
