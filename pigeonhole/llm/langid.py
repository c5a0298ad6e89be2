"""Language identification by compression: the language whose dictionary makes a text smallest.

Of every language a raw-content zstandard dictionary holds its most widespread words, the commonest last, where the coder
finds them nearest. A text is brought to the same form (letters in lower case, one space between words) and coded in windows
against each dictionary, so that a long text can't become its own dictionary. The smallest sum wins; where the margin to the
next one is narrow the answer is marked as not certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, row_chunks, salt_of, strings

FIT_ROWS, DICTIONARY_BYTES = 5_000, 32 << 10  # of each language: labelled rows read, size of its dictionary
WINDOW_BYTES = 2_000  # of text coded together
LEAST_MARGIN, LEAST_BYTES = 0.02, 2  # share and bytes that the next language must need more
UNKNOWN, SALTS = "und", 64
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
CODER = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 4,
         "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
PREDICTED = "doc_id long, lang_pred string, score double, certain boolean"


def held_out(folds: int = 4, fold: int = 2, doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def training_rows(docs: DataFrame, fit_rows: int) -> DataFrame:
    """Language and text of at most ``fit_rows`` ids of each language, the first by a hash of the id."""
    rows = docs.where("doc_id is not null and lang is not null").where(~held_out())
    ids = rows.select("doc_id", "lang").distinct().withColumn("at", F.xxhash64("doc_id"))
    for keys in (("lang", "salt"), ("lang",)):  # a language of a third of all rows is thinned out in parts first
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "doc_id"))
        ids = ids.withColumn("salt", salt_of("doc_id", salts=SALTS)).withColumn("place", place).where(F.col("place") <= fit_rows).drop("place")
    chosen = F.broadcast(ids.select("doc_id", "lang"))  # no more than fit_rows of each language, so no text is shuffled
    return rows.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """Languages with their dictionaries, those with the most texts read first."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in row_chunks(batch["text"]):
                langs, words = batch["lang"].slice(at, len(part)).to_pylist(), [["", *dict.fromkeys(words_of(t))] for t in strings(part)]
                at += len(part)
                own = [lang for lang, w in zip(langs, words) for _ in w]  # the empty word counts texts
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([x for w in words for x in w], pa.string())], ["lang", "word"])

    rows = training_rows(docs, fit_rows).select("lang", "text").mapInArrow(convert, "lang string, word string")
    counts = cut(rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    sizes = {r.lang: r.n for r in counts.where("word = ''").collect()}  # one row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.where("word <> '' and n > 1").withColumn("place", place).where(F.col("place") <= dictionary_bytes // 2)
    words: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in best.orderBy("lang", "place").collect():  # a word takes two bytes at least
        words[r.lang].append(r.word)
    found = []
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        kept, size = [], 1
        for w in words[lang]:
            size += len(w.encode()) + 1
            if size > dictionary_bytes:
                break
            kept.append(w)
        found.append((lang, f" {' '.join(reversed(kept))} ".encode()))
    return found


class Classifier:
    def __init__(self, languages: list[tuple[str, bytes]], least_margin: float):
        params = zstandard.ZstdCompressionParameters(**CODER)
        self.coders, self.least_margin = [], least_margin
        for lang, content in languages:
            held = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.coders.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=params)))

    def predict(self, text: str) -> tuple[str, float, bool]:
        words = words_of(text)
        if not words or not self.coders:
            return UNKNOWN, 0.0, False
        data = f" {' '.join(words)} ".encode()
        windows = [data[i:i + WINDOW_BYTES] for i in range(0, len(data), WINDOW_BYTES)]
        sizes = [sum(len(coder.compress(w)) for w in windows) for _, coder in self.coders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)  # equal sizes: the language with more texts
        best = sizes[order[0]]
        score = 1 / sum(2.0 ** max(best - s, -1000) for s in sizes)  # every byte more halves the odds
        certain = len(order) == 1 or sizes[order[1]] - best >= max(LEAST_BYTES, self.least_margin * best)
        return self.coders[order[0]][0], score, certain


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score from 0 to 1, certain.

    Dictionaries are learned from ``lang`` and text of rows that aren't held out (crc32 of the id modulo 4 is 2), at most
    ``fit_rows`` of each language; a word must occur in two of them. A text without letters, null or empty, is ``und`` with
    score 0, and so is every text if there are no languages to learn. ``certain`` is false where the next language needs less than
    ``least_margin`` (and two bytes) more. Equal sizes go to the language with more texts read, then to the first name. Rows
    that repeat an id are predicted each; a null id is predicted, counts as not held out and isn't learned from. Other columns are
    not read.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = learn(labelled, fit_rows, dictionary_bytes)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(languages, least_margin)
        for batch in batches:
            found = [classifier.predict(t) for t in strings(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "certain"])

    return id_and_text(docs).mapInArrow(convert, PREDICTED).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "certain")


def rejected_as_unknown(predicted: DataFrame) -> DataFrame:
    """The same rows with ``und`` where the margin is narrow."""
    return predicted.withColumn("lang_pred", F.when(F.col("certain"), F.col("lang_pred")).otherwise(F.lit(UNKNOWN)))
