"""Exact Jaccard links between token sets, on DataFrame operations only.

Tokens are longs that sort rare-first (the rarity level in the top bits), so a
set's prefix holds its rarest tokens. Two sets of at least 75 % Jaccard share a
token of their prefixes (prefix filter) at positions that leave room for the
overlap they need (positional filter) and have similar sizes (length filter).

All pairs of a posting list would grow with the square of a group of near
copies, so the work goes in rounds that lose no link between components:

1. every set is verified against the one list leader (the least id of a list)
   that it shares most prefix tokens with: at most one pair for each set;
2. for a few rounds, as long as they find links, every set of a long list in which
   components still meet is verified against one leader of another component, drawn
   anew for each list and band of sizes: at most one pair for each member and round. Which lists
   are long is asked list by list, so that tables of any size go through the same rounds;
3. pairs whose sets are still in different components are verified, each once.
   A pair already inside one component would not change the components.

``matched_earlier`` asks instead, for sets in an order, which ones match an earlier
set directly: the rest is then the sets that their leader does not decide, each against
all candidates before it, inside its component or not.

``all_links`` gives the links themselves, so it verifies every candidate pair.

Every step aggregates or joins by key, with partial aggregation or splittable
joins, so that a hot token or group never lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap_column, in_bitmap
from .common import hand_off

PERCENT = 75
DRAWS = 4               # rounds with drawn leaders; what they leave goes to the last step
CROWDED = 4             # members of a list beyond which such rounds pay
LEVEL_CELLS = 1 << 18   # counters of the rarity order, whatever the corpus
LEVEL_SHIFT = 57        # a token: level in the bits from here on, 57 bits of its hash below
LIST_CELLS = 1 << 25    # bits of the filter that lets through tokens of lists with two sets or more


def prefix_size(n: Column) -> Column:
    return n - F.floor((n * PERCENT + 99) / 100).cast("int") + 1


def needed(n1: Column, n2: Column) -> Column:
    """Overlap that two sets of these sizes need."""
    return F.ceil((n1 + n2) * PERCENT / (100 + PERCENT))


def sizes_fit(n1: Column, n2: Column) -> Column:
    return (n1 * 100 >= n2 * PERCENT) & (n2 * 100 >= n1 * PERCENT)


def components(edges: DataFrame) -> DataFrame:
    """k, comp: for every end of an edge (a, b) the least id of its component. Each
    round every node takes the least id next to it, twice over (a pointer jump),
    and edges inside a merged node go."""
    label = None
    edges = hand_off(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = hand_off(both.groupBy(F.col("a").alias("k")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "least")
        jump = least.alias("x").join(least.select(F.col("k").alias("to"), F.col("to").alias("to2")), "to", "left") \
            .select("k", F.coalesce("to2", "to").alias("to"))
        merged = hand_off(jump, "merged")
        label = merged.withColumnRenamed("to", "comp") if label is None else hand_off(
            label.join(merged.select(F.col("k").alias("comp"), "to"), "comp", "left")
            .select("k", F.coalesce("to", "comp").alias("comp")), "labels")
        edges = hand_off(edges.join(merged.select(F.col("k").alias("a"), F.col("to").alias("a2")), "a")
                         .join(merged.select(F.col("k").alias("b"), F.col("to").alias("b2")), "b")
                         .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                         .where("a <> b").distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("k"), F.col("b").alias("comp"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (k, toks) have the Jaccard similarity asked for."""
    both = (pairs.join(sets.select(F.col("k").alias("a"), F.col("toks").alias("ta")), "a")
            .join(sets.select(F.col("k").alias("b"), F.col("toks").alias("tb")), "b")
            .select("a", "b", F.size("ta").alias("n1"), F.size("tb").alias("n2"),
                    F.size(F.array_intersect("ta", "tb")).alias("both")))
    return both.where(F.col("both") * 100 >= (F.col("n1") + F.col("n2") - F.col("both")) * PERCENT).select("a", "b")


class _Lists:
    """Posting lists of the prefix tokens of ``entities``: k (id of a set; rows of equal
    sets share it), n (set size), pref (its prefix tokens, rarest first) and, if known,
    hist (how many tokens of the set fall into each of some classes) and odd0, odd1 and so
    on (longs whose bits say of which of some classes the set has an odd number of tokens).
    ``full_sets(keys)`` gives (k, toks) once for each k of ``keys``.
    """

    def __init__(self, entities: DataFrame, full_sets: Callable[[DataFrame], DataFrame]):
        self.full_sets = full_sets
        lists = hand_off(entities.select("k", F.explode("pref").alias("h"))
                         .groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
                         .where("lo < hi").select("h", "lo"), "lists")
        shared = bitmap_column(lists, "h", LIST_CELLS)
        self.odd = [c for c in entities.columns if c.startswith("odd")]
        self.members = hand_off(entities.select("k", "n", *self.odd, F.posexplode("pref").alias("pos", "h"))
                                .where(in_bitmap(shared, F.col("h"), LIST_CELLS))
                                .join(lists, "h").select("h", "k", "n", *self.odd, "pos", "lo"), "members")
        info = entities.join(self.members.select("k").distinct(), "k", "left_semi").groupBy("k").agg(
            F.any_value("n").alias("n"), *[F.any_value(c).alias(c) for c in entities.columns if c == "hist"])
        self.info = hand_off(info, "sizes")

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """Length filter and, with hist, suffix filter: the classes' differences are a
        lower bound of the tokens that only one of the sets has."""
        info = self.info
        side = lambda k, i: info.select(*[F.col(c).alias(k if c == "k" else f"{c}{i}") for c in info.columns])
        p = pairs.join(side("a", 1), "a").join(side("b", 2), "b").where(sizes_fit(F.col("n1"), F.col("n2")))
        if "hist" in info.columns:
            apart = F.aggregate(F.zip_with("hist1", "hist2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
            p = p.where(apart <= F.col("n1") + F.col("n2") - 2 * needed(F.col("n1"), F.col("n2")))
        return p.select("a", "b")

    def check(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that match."""
        pairs = hand_off(self._plausible(pairs), f"pairs-{name}")
        keys = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        return hand_off(verified(pairs, self.full_sets(keys)), f"links-{name}")

    def led(self) -> DataFrame:
        """(a, b): every set b with the list leader a < b that it shares most prefix tokens with."""
        return (self.members.where("k <> lo").groupBy("k", "lo").agg(F.count(F.lit(1)).alias("votes"))
                .groupBy("k").agg(F.max(F.struct("votes", "lo"))["lo"].alias("a")).select("a", F.col("k").alias("b")))

    def pairs(self, earlier: DataFrame, later: DataFrame, more: Column | None = None) -> DataFrame:
        """Distinct (a, b), a < b, of sets that share a prefix token where length and
        positions fit: a from ``earlier``, b from ``later`` (h, k, n, pos), as x and y in ``more``.
        Each class that is odd in one set only has a token that is in one set only.
        What they share is the tokens of both prefixes up to the last common one, which all
        are common lists, and at most what the smaller one has behind it."""
        x, y = earlier.alias("x"), later.alias("y")
        n1, n2 = F.col("x.n"), F.col("y.n")
        fits = ((F.col("x.h") == F.col("y.h")) & (F.col("x.k") < F.col("y.k")) & sizes_fit(n1, n2)
                & (F.least(n1 - F.col("x.pos"), n2 - F.col("y.pos")) >= needed(n1, n2)))
        if self.odd:
            apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in self.odd), F.lit(0))
            fits = fits & (apart <= n1 + n2 - 2 * needed(n1, n2))
        behind = F.least(n1 - F.col("x.pos"), n2 - F.col("y.pos")) - 1
        return (x.join(y, fits if more is None else fits & more)
                .select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), behind.alias("behind"), needed(n1, n2).alias("needed"))
                .groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("behind").alias("behind"), F.max("needed").alias("needed"))
                .where(F.col("c") + F.col("behind") >= F.col("needed")).select("a", "b"))


def _open_members(lists: _Lists, comp: DataFrame, more_than: int = 1) -> DataFrame:
    """h, k, n, pos, comp (and what bits there are) of the members of lists of ``more_than`` members in which more than one component meets."""
    labelled = lists.members.drop("lo").join(comp, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    open_lists = (labelled.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("c"))
                  .where((F.col("c0") < F.col("c1")) & (F.col("c") > more_than)).select("h"))
    return hand_off(labelled.join(open_lists, "h").groupBy("h", "k").agg(
        F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("comp").alias("comp"), *[F.any_value(c).alias(c) for c in lists.odd]), "open")


def _drawn_leaders(rest: DataFrame, draw: int) -> DataFrame:
    """(a, b), a < b: every set of an open list with the leader of its list and size, drawn anew
    for each list, band of sizes that fit each other (edges move with the round) and round,
    where the leader is of another component and positions fit."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT)) + draw / DRAWS).cast("int").alias("band")
    banded = rest.select("*", band)
    lead = banded.groupBy("h", "band").agg(F.min(F.struct(F.xxhash64("k", F.lit(draw)), "k", "comp", "n", "pos")).alias("m")).select(
        "h", "band", F.col("m.k").alias("lead"), F.col("m.comp").alias("lead_comp"), F.col("m.n").alias("lead_n"), F.col("m.pos").alias("lead_pos"))
    n1, n2 = F.col("n"), F.col("lead_n")
    fits = sizes_fit(n1, n2) & (F.least(n1 - F.col("pos"), n2 - F.col("lead_pos")) >= needed(n1, n2))
    return (banded.join(lead, ["h", "band"]).where((F.col("comp") != F.col("lead_comp")) & fits)
            .select(F.least("k", "lead").alias("a"), F.greatest("k", "lead").alias("b")).distinct())


def _joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``comp`` merged along the further links ``more``."""
    def of(side):
        return comp.select(F.col("k").alias(side), F.col("comp").alias(f"c{side}"))
    merged = components(more.join(of("a"), "a", "left").join(of("b"), "b", "left")
                        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    to = merged.select(F.col("k").alias("comp"), F.col("comp").alias("to"))
    old = comp.join(to, "comp", "left").select("k", F.coalesce("to", "comp").alias("comp"))
    # ends of the new links that had no component of their own yet
    return hand_off(old.unionByName(merged.join(comp.select("k"), "k", "left_anti")), "merged-components")


def similar(entities: DataFrame, full_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of the similarity graph, as (k, comp) for each k with a link
    (arguments: ``_Lists``)."""
    lists = _Lists(entities, full_sets)
    tried = lists.led().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    comp = components(lists.check(tried, "leaders"))
    for draw in range(DRAWS):
        rest = _open_members(lists, comp, CROWDED)
        if rest.isEmpty():
            break
        pairs = hand_off(_drawn_leaders(rest, draw).join(tried, ["a", "b"], "left_anti"), "drawn")
        tried = tried.unionByName(pairs)
        more = lists.check(pairs, "drawn")
        if more.isEmpty():
            break
        comp = _joined(comp, more)
    rest = _open_members(lists, comp)
    across = lists.pairs(rest, rest, F.col("x.comp") != F.col("y.comp"))
    more = lists.check(across.join(tried, ["a", "b"], "left_anti"), "across")
    return comp if more.isEmpty() else _joined(comp, more)


def matched_earlier(entities: DataFrame, full_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """k of each set that matches a set of a lesser k itself, not through others
    (arguments: ``_Lists``, one row for each k). A set that the leader, the first of
    its list, decides is never a later one again; each of the others is verified
    against every candidate before it, but none of them twice."""
    lists = _Lists(entities, full_sets)
    led = lists.led()
    decided = lists.check(led, "leaders").select(F.col("b").alias("k"))
    members = lists.members.drop("lo")
    still = lists.members.where("k <> lo").drop("lo").join(decided, "k", "left_anti")
    more = lists.check(lists.pairs(members, still).join(led, ["a", "b"], "left_anti"), "earlier")
    return decided.unionByName(more.select(F.col("b").alias("k")).distinct())


def all_links(entities: DataFrame, full_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every pair (a, b), a < b, of different sets that match, each verified once, inside a
    component or not (arguments: ``_Lists``)."""
    lists = _Lists(entities, full_sets)
    members = hand_off(lists.members.groupBy("h", "k").agg(
        F.min("n").alias("n"), F.min("pos").alias("pos"), *[F.any_value(c).alias(c) for c in lists.odd]), "all-members")
    return lists.check(lists.pairs(members, members), "all")
