"""How filters of texts interact: what each removes in every order, and its fair share of all that is removed.

The removal game of some documents: a coalition of filters is worth the documents that fail one of its filters. Texts are
judged once; the documents of each part are then counted by the set of filters that they fail, and everything else is
arithmetic on a part's 2^k coalitions. A step of an order is the difference of two coalitions. The Hart-Mas-Colell
potential of a coalition is its worth plus the potentials of it without each of its filters, divided by its size; a
filter's Shapley value is the potential of all filters less that of all others. Potentials are kept k! times as large,
which makes them whole numbers, and the share the sum over all orders.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whether a text fails, from the text (never null) and its words.
Filter = Callable[[Column, Column], Column]

#: Most filters: every order of them is a row of each step.
MOST_FILTERS = 7

#: Too short, repetitive, shouting, markup.
TEXT_FILTERS: dict[str, Filter] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
#: The filter that is not a function of one text: a copy of the text of a smaller doc_id.
COPY = "E"


def words_of(text: Column) -> Column:
    """Its words ``[^\\x20\\x09-\\x0D]+``, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = TEXT_FILTERS, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail, bit by bit, copies last.

    Only digests of texts are shuffled, and equal rows are counted before; a text that very many documents share is
    counted in all tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    cut = named.select("*", words_of(F.col("text")).alias("words"))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    judged = cut.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = judged.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))

    # Rows without an id meet no label; they are spread by their texts.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("spread")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("spread")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marked = rows.select("*", spread).join(marks, ["doc_id", "spread"], "left").fillna(False, ["good", "toxic"])

    # Of a text's rows only those of its least doc_id are originals.
    named_first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    unnamed = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), named_first, unnamed)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", "n", originals.alias("originals"))
    copy = 1 << len(filters)
    both = F.array(F.struct("mask", F.col("originals").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    marked_so = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("x.n"))), F.lit(0)).alias(c)
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), marked_so("good"), marked_so("toxic"))


def removal_games(counts: DataFrame, k: int) -> DataFrame:
    """part, docs, and for every coalition, by its bits, the documents, good ones and toxic ones that it removes."""
    of = F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("coalition")
    met = counts.select("*", of).withColumn("hit", F.col("mask").bitwiseAND(F.col("coalition")) != 0)
    removed = lambda c: F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0))
    worth = met.groupBy("part", "coalition").agg(F.sum("n").alias("docs"), removed("n").alias("n"), removed("good").alias("good"), removed("toxic").alias("toxic"))
    entries = F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic")))  # 2^k of each part
    games = worth.groupBy("part").agg(F.max("docs").alias("docs"), entries.alias("game"))
    return games.select("part", "docs", *(F.col(f"game.{c}").alias(c) for c in ("n", "good", "toxic")))


def potentials(worth: Column, k: int) -> Column:
    """k! times the Hart-Mas-Colell potential of each coalition of a game, from the empty one up."""

    def next_one(so_far: Column, s: Column) -> Column:
        without = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(so_far, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0) for i in range(k)), F.lit(0))
        total = F.lit(factorial(k)) * F.get(worth, s) + without
        return F.concat(so_far, F.array(F.call_function("div", total, F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), next_one)


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = TEXT_FILTERS, copy: str = COPY, part: str = "source") -> DataFrame:
    """What each step of each order of the filters does to each part of ``docs`` (doc_id, text and the column ``part``).

    part, filter_order, step (from 1), kept, removed, redundant (failing the step's filter, but gone before),
    unique_fails (failing no other filter), good_lost, toxic_lost (removed here, by ``labels``), shapley (removed by the
    filter, summed over all orders). Filters have names of one letter; ``copy`` is the one for texts of a smaller doc_id,
    whether that row is removed or not.

    A null text is empty, a null part the empty one; an empty text has no words. Repeated rows count each; rows of one id
    and text are not each other's copies. A row with a null id is nobody's copy, makes none and has no label. A label that
    repeats counts if one of its rows is 1; null counts as 0. An empty table gives no rows. Other columns are not read.
    """
    names = [*filters, copy]
    k = len(names)
    if k > MOST_FILTERS or len(set(names)) < k or any(len(x) != 1 for x in names):
        raise ValueError(f"up to {MOST_FILTERS} filters with different names of one letter")
    games = removal_games(failures(docs, labels, filters, part), k).withColumn("potential", potentials(F.col("n"), k))
    orders = ",".join("".join(p) for p in permutations(sorted(names)))
    each = games.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = [F.instr("filter_order", x) for x in names]
    gone = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    each = each.select("*", gone.alias("gone"), own.alias("own"))
    every = F.lit((1 << k) - 1)
    after, others = F.col("gone").bitwiseOR(F.col("own")), every.bitwiseXOR(F.col("own"))
    more = lambda game: F.get(game, after) - F.get(game, "gone")
    alone = lambda game: F.get(game, every) - F.get(game, others)
    return each.select(
        "part", "filter_order", "step", (F.col("docs") - F.get("n", after)).alias("kept"), more("n").alias("removed"), (F.get("n", "own") - more("n")).alias("redundant"),
        alone("n").alias("unique_fails"), more("good").alias("good_lost"), more("toxic").alias("toxic_lost"), alone("potential").alias("shapley"),
    )
