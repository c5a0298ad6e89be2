"""Toxicity: a lexicon learned from labels, found with spelling errors by an automaton, weighed by its context.

Words and word beginnings that stand out in toxic documents become terms of a trie. A Levenshtein automaton over the trie
finds them, misspelled too; how far each term and number of edits is to be trusted is learned from the same rows. A window
around a hit tells a quotation or report from abuse. Labels are read only from rows whose crc32 of the id isn't a multiple of
5, and only from ``fit_rows`` of them at most (the first by a hash of the id); near copies among those count once.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import LexiconAutomaton
from .common import cut, id_and_text, strings

FIT_ROWS, MAX_TERMS = 100_000, 2_000
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may be terms
LEAST_DOCS, LEAST_LIFT, LEAST_SURE = 10, 20.0, 0.8
WINDOW = 8  # words on either side of a hit
QUOTES = set("\"“”„«»‟‘’")
REPORTS = {"said", "says", "wrote", "writes", "called", "calls", "quoted", "quote", "quotes", "quoting", "reported", "according", "slur", "insult", "word", "term",
           "dijo", "llamó", "escribió", "dit", "écrit", "appelé", "sagte", "schrieb", "nannte"}
SCORES = "doc_id long, score double"


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """toxic and distinct words of at most ``fit_rows`` labelled documents that aren't held out, one of each kind of near copies."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # the documented bound: 16 bytes a row
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    rows = docs.join(F.broadcast(own), "doc_id").select("doc_id", "toxic", words.alias("words"))
    triple = F.expr("array_min(transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))")
    rows = cut(rows.select("doc_id", "toxic", F.when(F.size("words") >= 3, triple).otherwise(F.xxhash64("words")).alias("kind"), F.array_distinct("words").alias("words")), "labelled")
    first = rows.groupBy("kind", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi")  # no more rows than fit_rows


def best_terms(counted: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool]]:
    """Terms from the surest on; what a chosen term explains is taken from the word beginnings above it and ends those below."""
    left = {(t, stem): (n1, n0) for t, stem, n1, n0 in counted}
    sure = lambda x: (left[x][0] + 0.5) / (left[x][0] + left[x][1] + 3)
    found = []
    while left and len(found) < MAX_TERMS:
        term, stem = best = max(left, key=lambda x: (sure(x), len(x[0]), x))
        if sure(best) < LEAST_SURE:
            break
        if left[best][0] < LEAST_DOCS:
            del left[best]
            continue
        found.append(best)
        n1, n0 = left.pop(best)
        for n in range(1, len(term) + (not stem)):
            if (above := (term[:n], True)) in left and above != best:
                left[above] = (left[above][0] - n1, max(0, left[above][1] - n0))
        if stem:
            left = {x: v for x, v in left.items() if not (x[0].startswith(term) and (len(x[0]) > len(term)))}
    return found


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[tuple[str, bool]], dict[tuple[int, int], float], float]:
    """Terms (at most ``MAX_TERMS``), the precision of each (term, edits), and the share of toxic rows."""
    rows = training_rows(docs, labels, fit_rows)
    toxic, clean = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    base = (toxic + 0.5) / (toxic + clean + 2)
    counts = cut(rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")), "words")
    forms = [F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))]
    forms += [F.when(F.length("word") > n, F.struct(F.substring("word", 1, n).alias("term"), F.lit(True).alias("stem"))) for n in STEMS]
    terms = counts.select("n1", "n0", F.explode(F.filter(F.array(*forms), lambda x: x.isNotNull())).alias("f")).groupBy("f.term", "f.stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    lift = (F.col("n1") + 0.5) / (toxic + 1) / ((F.col("n0") + 0.5) / (clean + 1))
    chosen = terms.where((F.col("n1") >= max(LEAST_DOCS, toxic // 1000)) & (lift >= LEAST_LIFT) & (F.length("term") >= 3)).orderBy(F.desc("n1"), "term", "stem").limit(5 * MAX_TERMS)
    found = best_terms([tuple(r) for r in chosen.select("term", "stem", "n1", "n0").collect()])  # at most 5 * MAX_TERMS
    if not found:
        return [], {}, base

    def spelled(batches):
        automaton = LexiconAutomaton(found)
        for batch in batches:
            hits = [(k, e, n1, n0) for w, n1, n0 in zip(*(batch[c].to_pylist() for c in ("word", "n1", "n0"))) for k, e in automaton.matches(w)]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["term", "edits", "n1", "n0"])

    seen = {(r["term"], r["edits"]): (r["n1"], r["n0"]) for r in counts.mapInArrow(spelled, "term int, edits int, n1 long, n0 long").groupBy("term", "edits").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()}
    trust = {}
    for edits in range(3):
        there = [seen.get((k, edits), (0, 0)) for k in range(len(found))]
        pooled = (sum(a for a, _ in there) + 0.5) / (sum(a + b for a, b in there) + 2)
        trust |= {(k, edits): (a + 4 * pooled) / (a + b + 4) for k, (a, b) in enumerate(there)}
    return found, trust, base


class Scorer:
    """Scores texts; words are looked up in the automaton once and remembered up to ``limit``."""

    def __init__(self, terms, trust, base, limit: int = 400_000):
        self.automaton, self.trust, self.base, self.limit = LexiconAutomaton(terms), trust, base, limit
        self.known: dict[str, tuple[float, int] | None] = {}

    def trusted(self, token: str) -> tuple[float, int] | None:
        """The most trusted term of a token: (precision, term number)."""
        letters = re.findall(r"[^\W_]+", token)
        best = None
        for form in dict.fromkeys(("".join(letters), *letters)):
            for k, edits in self.automaton.matches(form):
                best = max(best or (0.0, -1), (self.trust[k, edits], k))
        return best

    def score(self, text: str) -> float:
        tokens = text.lower().split()
        new = set(tokens).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, set(tokens)
        for token in new:
            self.known[token] = self.trusted(token)
        hits = [i for i, token in enumerate(tokens) if self.known[token]]
        best: dict[int, float] = {}
        for i in hits:
            p, k = self.known[tokens[i]]
            best[k] = max(best.get(k, 0.0), p * self.context(tokens, i) if p > self.base else p)
        if not best:
            return self.base * 0.5
        strong = sorted(best.values(), reverse=True)
        missing = (1 - strong[0]) * math.prod(1 - 0.2 * p for p in strong[1:] if p >= 0.5)
        return min(1.0, max(self.base * 0.5, 1 - missing))

    @staticmethod
    def context(tokens: list[str], i: int) -> float:
        """Below 1 where the words around a hit quote or report it: both are in the window, or only the quotation marks."""
        before, after = tokens[max(0, i - WINDOW):i + 1], tokens[i:i + WINDOW + 1]
        opened = any(t[0] in QUOTES for t in before)
        closed = any(t[-1] in QUOTES or t[:-1][-1:] in QUOTES for t in after)
        if not (opened and closed):
            return 1.0
        return 0.35 if any(t.strip(".,:;!?\"'“”„«»") in REPORTS for t in before + after) else 0.6


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score from 0 to 1, predicted (1 from 0.5 on).

    A null or empty text scores half the share of toxic rows, like any text without a term. Rows that repeat an id are
    scored each; a null id is scored and counts as not held out. Labels that are null or name no document are not read;
    without usable labels every score is that share. A document labelled twice is toxic if one label says so.
    """
    docs = id_and_text(docs)
    terms, trust, base = learn(docs, labels, fit_rows)

    def convert(batches):
        scorer = Scorer(terms, trust, base)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([scorer.score(t) for t in strings(batch["text"])], pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(convert, SCORES).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their score doesn't reject, with all their columns; rows are judged one by one, in one pass, so
    repeated rows fare alike. Null and empty texts and null ids are judged like any other; without usable labels all stay."""
    terms, trust, base = learn(id_and_text(docs), labels)

    def keep(batches):
        scorer = Scorer(terms, trust, base)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in strings(batch["text"])], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
