"""Quality rules by repetition coverage (operator 2).

Rolling hashes of several n-gram lengths, in numpy over blocks of whole texts,
find every word window that occurs at least twice in its text; the characters
of the words inside such windows, and those of repeated lines, are measured
against all characters of words.

Defined results: a null or empty text has no words (all counts 0) and fails the
base rule; a text of any length is read whole; rows are judged one by one, so
ties and repeated rows get equal results; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import Block, blocks, mix, ngrams, prefix, span_hash, strings

BASE_N = 8              # the base rule's window
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Share of the characters of words that may lie inside repeated windows of n words,
# and inside lines that repeat an earlier line. Chosen against all quality labels of two tables:
# the most that a document labelled good has there is 0.306, 0.306, 0.306 and 0.153.
NGRAM_LIMITS = {5: 0.36, 8: 0.33, 12: 0.33}
LINE_LIMIT = 0.20

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
           *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS))
RESULT = "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ">"
_SYMBOL = np.zeros(129, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the entries whose value occurs at least twice."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the words inside any window of n words that starts at ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of every text of one block."""
    b = Block(texts)
    starts, ends = b.blank_words()
    doc, chars = b.doc_of(starts), ends - starts

    def per_doc(where, weights=None):
        return np.bincount(where, weights=weights, minlength=b.n).astype(np.int64)

    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars)}
    out["n_symbols"] = per_doc(b.doc_of(np.flatnonzero(_SYMBOL[np.minimum(b.cp, 128)])))
    pre = b.char_prefix()
    word = span_hash(pre, starts, ends)
    salt = mix(np.arange(b.n, dtype=np.uint64) + np.uint64(1))  # windows of two texts never count as equal

    # lines: from each text's start and after each line feed, up to the next one or the text's end
    feeds = np.flatnonzero(b.cp == 10)
    line_start = np.sort(np.concatenate([b.start, feeds + 1]))
    line_end = np.sort(np.concatenate([b.start + b.length, feeds]))
    first_word = np.searchsorted(starts, line_start)
    words_in = np.searchsorted(starts, line_end) - first_word
    line_start, line_end, first_word, words_in = (x[words_in > 0] for x in (line_start, line_end, first_word, words_in))
    line_doc = b.doc_of(line_start)
    key = span_hash(pre, line_start, line_end) ^ salt[line_doc]
    _, first = np.unique(key, return_index=True)  # the first of equal lines: lines are in text order
    later = np.ones(len(key), bool)
    later[first] = False
    out["n_dup_lines"] = per_doc(line_doc[later])
    upto = np.concatenate([[0], np.cumsum(chars)])
    line_chars = upto[first_word + words_in] - upto[first_word]
    out["dup_line_chars"] = per_doc(line_doc[later], line_chars[later])

    word_pre = prefix(word, 0xD6E8FEB86659FD93)
    for n in sorted({BASE_N, *NGRAM_LIMITS}):
        at, hashes = ngrams(word, doc, n, word_pre)
        inside = _covered(at[_repeated(hashes ^ salt[doc[at]])], n, len(word))
        if n == BASE_N:
            out["n_repeat_words"] = per_doc(doc[inside])
        if n in NGRAM_LIMITS:
            out[f"dup_{n}gram_chars"] = per_doc(doc[inside], chars[inside])
    return out


def _measure_column(column: pa.Array) -> pa.Array:
    texts = strings(column)
    parts = [measure(texts[lo:hi]) for lo, hi in blocks(texts)]
    arrays = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64())
              for c in _COUNTS]
    return pa.StructArray.from_arrays(arrays, list(_COUNTS))


def coverage(text: Column) -> Column:
    """The counts of a text column, as a struct."""
    return F.arrow_udf(_measure_column, RESULT)(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def method_failed(m: Column) -> Column:
    """Too many characters inside repeated windows of some length, or inside repeated lines."""
    failed = m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for n, limit in NGRAM_LIMITS.items():
        failed = failed | (m[f"dup_{n}gram_chars"] > limit * m["word_chars"])
    return failed


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, ``base_failed`` and ``kept`` of every row."""
    m = F.col("_m")
    return (docs.select(F.col(id_col).alias(id_col), coverage(F.col(text_col)).alias("_m"))
            .select(id_col, "_m.*", base_failed(m).alias("base_failed"),
                    (~base_failed(m) & ~method_failed(m)).alias("kept")))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their columns as they are."""
    from .common import fresh
    tmp = fresh(docs, "_m")
    m = F.col(tmp)
    return (docs.withColumn(tmp, coverage(F.col(text_col)))
            .where(~base_failed(m) & ~method_failed(m)).drop(tmp))
