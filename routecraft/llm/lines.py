"""Line dedup by an exact set-similarity join (operator 3), on DataFrame functions only.

A line's tokens are its distinct five-word shingles (A-Z lower-cased words; a
line of fewer words is one token), ordered by hash, those of many lines last.
Lines whose token sets have a Jaccard similarity of 0.75 or more match (prefix,
positional and length filters, then verification: ``setjoin``). Lines come in the
order of document id, then text, then line number. Two rules say which lines go:

* ``closed`` (op3_line_dedup and the pipeline): matches are closed transitively, and
  of each group the line that comes first stays, the later ones go;
* otherwise a line goes if it matches an earlier line itself, whether that one
  stays or goes; a line that only matches later ones stays.

Defined results: lines without words have no tokens and always stay; null and
empty texts have no lines with words; a null id comes before all others; rows
equal in id and text are one document and get equal results; an empty table
gives an empty result; other columns are never read. Whole texts are used,
whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import ROW_CELLS, WORD_BITS, bitmap_column, bitmap_words, dense_cells, in_bitmap
from .common import fresh, hand_off, row_key, settled
from .setjoin import LIST_CELLS, matched_earlier, needed, prefix_size, similar, sizes_fit

N = 5
SET_CELLS = 1 << 22
CROWDED = 32            # sets beyond which a token moves back in the order
_CAPITALS, _BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\t\x0b\x0c\r"
_FROM, _TO = _CAPITALS + _BLANKS, _CAPITALS.lower() + " " * len(_BLANKS)


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.select("doc_id", row_key().alias("rid"), F.split("text", "\n", -1).alias("ls"))
    return split.select("doc_id", "rid", F.posexplode("ls").alias("line_no", "line"))


def _words(line: Column) -> Column:
    """Words of the line, A-Z lower-cased. ``lower`` is many times faster than
    ``translate`` and equal to it unless the line has other capitals."""
    odd_blank = line.rlike(r"[\t\x0b\x0c\r]")
    other_capital = (F.octet_length(line) != F.length(line)) & line.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    exact = F.translate(line, _FROM, _TO)
    return F.array_remove(F.split(F.when(odd_blank | other_capital, exact).otherwise(F.lower(line)), " ", -1), "")


def _shingles(words: str) -> Column:
    """Distinct hashes of five words each, zipped from the shifted word hashes."""
    w = F.col(words)
    size = F.size(w) - (N - 1)
    shifted = F.arrays_zip(*[F.slice(w, i + 1, size) for i in range(N)])
    five = F.array_distinct(F.transform(shifted, lambda s: F.xxhash64(s)))
    return F.when(F.size(w) >= N, five).when(F.size(w) > 0, F.array(F.xxhash64(w, F.lit(1))))


def _tokens(lines: DataFrame) -> DataFrame:
    """``lines`` with h, the distinct shingle hashes of the lines that have words."""
    return (lines.where(F.col("line").rlike(r"[^ \t-\r]")).withColumn("w", F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
            .withColumn("h", _shingles("w")).drop("w", "line"))


def _sets(lines: DataFrame) -> DataFrame:
    """k, n and s (the sorted tokens) of the lines that have words; k stands for the set."""
    return _tokens(lines).withColumn("s", F.sort_array("h")).drop("h").withColumn("k", F.xxhash64("s")).withColumn("n", F.size("s"))


def _prefix(tokens: str) -> Column:
    return F.slice(tokens, 1, prefix_size(F.col("n")))


def _with_token(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """k of the ``sets`` (k, n, toks) that have one of ``tokens`` (h) in their prefix, each once."""
    return sets.select("k", F.explode(_prefix("toks")).alias("h")).join(tokens.select("h"), "h", "left_semi").select("k").distinct()


def _may_be(keys: DataFrame, key: str, value: Column, size: int = LIST_CELLS) -> Column:
    """Whether ``value`` may be among the ``keys``. The bitmap is written, not part of each plan that asks it."""
    cells = hand_off(dense_cells(bitmap_words(keys, key, size), -(-size // WORD_BITS)), "line-filter")
    return in_bitmap(cells.scalar(), value, size)


def _of(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``sets`` of ``keys`` (k); the others leave before the shuffle of the join."""
    return sets.where(_may_be(keys, "k", F.col("k"), SET_CELLS)).join(keys, "k", "left_semi")


def _ranked(sets: DataFrame) -> DataFrame:
    """k, n, pref: the prefixes of ``sets`` (k, n, toks) in the order of the tokens' level,
    then hash. Tokens of more than CROWDED prefixes, or of more than CROWDED of the sets
    that have such a token in their prefix, have the log2 of that count as their level,
    all others 0; so a set without a crowded token in its first tokens by hash keeps those."""
    def crowded(tokens):
        return tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWDED)

    first = hand_off(crowded(sets.select(F.explode(_prefix("toks")).alias("h"))), "line-crowded")
    touched = _of(sets.select("k", "toks"), hand_off(_with_token(sets, first), "line-touched"))
    levels = hand_off(crowded(touched.select(F.explode("toks").alias("h"))).unionByName(first).groupBy("h").agg(
        F.floor(F.log2(F.max("c"))).cast("int").alias("level")), "line-levels")
    moved = hand_off(_with_token(sets, levels), "line-moved")
    spread = _of(sets, moved).select("k", "n", F.explode("toks").alias("h")).join(levels, "h", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(0)).alias("level"), "h")))["h"]
    again = spread.groupBy("k", "n").agg(order.alias("toks")).select("k", "n", _prefix("toks").alias("pref"))
    return sets.select("k", "n", _prefix("toks").alias("pref")).join(moved, "k", "left_anti").unionByName(again)


def _alike(members: DataFrame) -> DataFrame:
    """k of the sets that may match another one with which they share a token of ``members`` (h, k, n,
    last: the last token of the prefix by hash). The tokens of the prefix that ends first are in the
    other prefix or not in the other set at all, and a match leaves only few of a set's tokens out."""
    x, y = members.alias("x"), members.alias("y")
    n1, n2, need = F.col("x.n"), F.col("y.n"), needed(F.col("x.n"), F.col("y.n"))
    # no positional filter: it holds for the first token in common only, and all of them are counted
    fits = (F.col("x.h") == F.col("y.h")) & (F.col("x.k") < F.col("y.k")) & sizes_fit(n1, n2)
    ends = F.when(F.col("x.last") <= F.col("y.last"), n1).otherwise(n2)
    least = prefix_size(ends) - (ends - need)
    return (x.join(y, fits).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), least.alias("least"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("least").alias("least")).where("c >= least")
            .select(F.explode(F.array("a", "b")).alias("k")))


def _open(entities: DataFrame, repeated: DataFrame) -> DataFrame:
    """k of the classes that may match another class: those with a token of more than CROWDED
    prefixes, those that ``_alike`` leaves, and those of more than one line (``repeated``). The
    tokens of a class count once, so that copies open nothing else."""
    copied = _may_be(repeated, "k", F.col("k"), SET_CELLS)
    once = hand_off(entities.where(copied).groupBy("k").agg(F.any_value("n").alias("n"), F.any_value("pref").alias("pref")), "line-copied")
    sets = entities.where(~copied).select("k", "n", "pref").unionByName(once)
    # a count is half of what two ids for each token weigh
    shared = hand_off(sets.select(F.explode("pref").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "line-shared")
    members = hand_off(sets.select("k", "n", F.element_at("pref", -1).alias("last"), F.explode("pref").alias("h"))
                       .where(_may_be(shared, "h", F.col("h"))).join(shared, "h"), "line-members")
    crowded = members.where(F.col("c") > CROWDED).select("k")
    return crowded.unionByName(_alike(members.where(F.col("c") <= CROWDED))).unionByName(repeated.select("k")).distinct()


def _classes(docs: DataFrame, closed: bool) -> tuple[DataFrame, DataFrame]:
    """Every line with words as (doc_id, rid, line_no, k), and the classes of equal sets with
    more than one line or a match as (k, first, c, matched): the first line's place, the number
    of lines, and whether the first line matches an earlier one of another class (``closed``:
    whether its group has an earlier one).

    Any order of the tokens finds all matches. By hash alone it needs no count of them, and
    sets whose first tokens are in no other set, or too few of them, most sets, are done with:
    only the rest, the open classes, are made again in full and ordered by rarity."""
    place = ("doc_id", "rid", "line_no")
    entities = hand_off(_sets(_lines(docs)).select(*place, "k", "n", _prefix("s").alias("pref")), "line-sets")
    repeated = hand_off(entities.groupBy("k").agg(F.min(F.struct(*place)).alias("first"), F.count(F.lit(1)).alias("c"))
                        .where("c > 1"), "line-repeated")
    is_open = hand_off(_open(entities, repeated), "line-may-match")
    alone = (entities.where(_may_be(is_open, "k", F.col("k"), SET_CELLS)).join(is_open, "k", "left_semi").join(repeated, "k", "left_anti")
             .select("k", F.struct(*place).alias("first"), F.lit(1).cast("long").alias("c"), F.lit(True).alias("is_open")))
    classes = hand_off(repeated.join(is_open.withColumn("is_open", F.lit(True)), "k", "left").unionByName(alone), "line-classes")
    # o: ids in the order of the first lines
    ordered = hand_off(classes.where("is_open").select("k", "first").orderBy("first").select(
        F.monotonically_increasing_id().alias("o"), "k", F.xxhash64("first.rid", "first.line_no").alias("at")), "line-open")

    asked = _lines(docs).where(_may_be(ordered, "at", F.xxhash64("rid", "line_no")))
    sets = hand_off(_sets(asked).select("k", "n", F.col("s").alias("toks")).dropDuplicates(["k"]).join(ordered.select("k", "o"), "k")
                    .select(F.col("o").alias("k"), "n", "toks"), "line-open-sets")
    prefixes, full_sets = hand_off(_ranked(sets), "line-prefixes"), lambda keys: _of(sets.select("k", "toks"), keys)
    # the least id of a group is its first line's class
    matched = similar(prefixes, full_sets).where("k <> comp") if closed else matched_earlier(prefixes, full_sets)
    matched = ordered.join(matched.select(F.col("k").alias("o")), "o", "left_semi").select("k", F.lit(True).alias("matched"))
    return entities.select(*place, "k"), classes.join(matched, "k", "left").select(
        "k", "first", "c", F.coalesce("matched", F.lit(False)).alias("matched"))


def removed_lines(docs: DataFrame, closed: bool = False) -> DataFrame:
    """rid (``row_key``), removed: the numbers (from 0) of the lines that go, for documents that lose any."""
    return settled(docs.sparkSession, lambda: _removed(docs, closed), "line-removed")


def _removed(docs: DataFrame, closed: bool) -> DataFrame:
    lines, classes = _classes(docs, closed)
    at = F.struct("doc_id", "rid", "line_no")
    losing = hand_off(classes.where("c > 1 or matched").drop("c"), "line-losing")
    later = lines.join(losing, "k").where(F.col("matched") | (at > F.col("first")))
    return later.groupBy("rid").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def line_dedup(docs: DataFrame, closed: bool = False) -> DataFrame:
    """doc_id, n_lines (with words or not), removed of every row."""
    base = docs.select("doc_id", row_key().alias("rid"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    return (base.join(removed_lines(docs, closed), "rid", "left")
            .select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def drop_lines(docs: DataFrame, closed: bool = False) -> DataFrame:
    """The rows without the lines that go; n_chars, if there, follows the text. A row that
    had words and has none left goes altogether."""
    key, gone, text = fresh(docs, "_rid"), fresh(docs, "_removed"), fresh(docs, "_text")
    removed = removed_lines(docs, closed).select(F.col("rid").alias(key), F.col("removed").alias(gone))
    # rows that lose no line need not travel to the join with their texts
    losing = in_bitmap(bitmap_column(removed, key, ROW_CELLS), row_key(), ROW_CELLS)
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = (docs.where(losing).withColumn(key, row_key()).join(removed, key, "left")
           .withColumn(text, F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
           .where(F.col(gone).isNull() | F.col(text).rlike(r"[^ \t-\r]")).drop(key, gone)
           .unionByName(docs.where(~losing).withColumn(text, F.col("text"))))
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
