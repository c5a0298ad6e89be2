"""Text columns: UTF-16 lengths, ECMAScript white space, tokens, evidence comparison."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pigeonhole import constants as k

# The white space class of ECMAScript. Java's \s covers ASCII only.
ES_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
TOKEN = r"[\p{L}\p{N}]+"


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 code units; ``length`` counts code points and is one short per astral character."""
    return F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1).cast("long")


def es_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{ES_SPACE}]+|[{ES_SPACE}]+$", "")


def blank(c: Column) -> Column:
    """True for null, empty or all-white-space text."""
    return F.coalesce(~c.rlike(f"[^{ES_SPACE}]"), F.lit(True))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def words_nfkc(c: Column) -> Column:
    """Loader tokens: compatibility normalisation first, the one step Spark has no function for (Arrow batches)."""
    return words(nfkc(c))


def token_phrase(c: Column) -> Column:
    """Tokens joined and padded by single spaces, so that whole-word phrase search is a substring test."""
    tokens = words(c)
    return F.when(F.size(tokens) > 0, F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))).otherwise(F.lit(""))


def canonical_evidence(c: Column) -> Column:
    straight = F.translate(c, "\u2018\u2019\u201C\u201D", "''\"\"")
    return F.trim(F.regexp_replace(straight, f"[{ES_SPACE}]+", " "))


def evidence_policy(c: Column) -> Column:
    """Null means the oldest policy; an unknown one raises."""
    known = F.coalesce(c, F.lit(k.EVIDENCE_EXACT))
    return F.when(known.isin(k.EVIDENCE_EXACT, k.EVIDENCE_SPACING), known).otherwise(
        F.raise_error(F.concat(F.lit("Unknown evidence policy: "), known)))


def evidence_matches(text: Column, quote: Column, policy: Column, canonical_text: Column | None = None) -> Column:
    """Contiguous passage test. Pass ``canonical_text`` to canonicalise a document once for many quotes."""
    canonical_text = canonical_evidence(text) if canonical_text is None else canonical_text
    clean = canonical_evidence(quote)
    return (F.when(evidence_policy(policy) == k.EVIDENCE_EXACT, (F.length(quote) > 0) & F.contains(text, quote))
            .otherwise((F.length(clean) > 0) & F.contains(canonical_text, clean)))


def sha256(c: Column) -> Column:
    """Full lower-case hex digest of bytes or UTF-8 text."""
    return F.sha2(c, 256)


def quote_regex(c: Column) -> Column:
    """Escape a literal for use inside a regular expression."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")
