"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / quality``, with u from a hash of its
id, so keys are the same on every run. In each source, whole epochs come first; the
rest of the token budget goes to the documents of smallest key.

No task ever sorts a whole source: keys fall into ranges, ``RANGES`` for each doubling,
whose word counts are summed before the shuffle; prefix sums over those show in which
range a source's budget ends, and only that range's documents are sorted. Ranges grow with
the keys, so none holds more than a thousandth of the documents of one weight, whatever the weight. What a source
decides is one row, (epochs, the key at which it stops), to which its documents are
compared. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, materialise, narrowed

#: Target weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MAX_EPOCHS = 3
#: Ranges of keys per doubling; a source's keys span some 60 doublings at most.
RANGES = 256
#: Up to this many sources, their decisions (about 100 bytes each) are broadcast.
BROADCAST_SOURCES = 50_000
#: Hexadecimal digits of the id's MD5 that make u.
DIGITS = 12


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight in 1/16..1: the share of characters that are neither digits nor ASCII signs."""
    n = F.length(text)
    signs = n - F.length(F.regexp_replace(text, "[!-/0-9:-@\\[-`{-~]", ""))
    return F.when(n > 0, F.greatest(F.lit(1 / 16), 1 - signs / n)).otherwise(F.lit(1.0))


def keyed(id_: Column, weight: Column, seed: int) -> Column:
    """The exponential key of a document: smaller is taken earlier."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / weight


def bucket(key: Column) -> Column:
    return F.floor(F.log2(key) * RANGES).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources in code point order, null last, get the repeating weights and share the sum
    of all sizes. A target stops at ``most`` times its source's size; the excess is
    shared by weight until none is above, which is a level L such that every target is
    min(L * weight, most * size). One row per source, so one task for the ranks.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.get(kinds, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    # By the level at which a source is full; those before it are full as well. The first
    # level at which the next source isn't full is the one, and the highest that fits.
    by_level = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.select(
        "source", "source_size", "w", F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        F.sum("w").over(rest).alias("open_w"))
    level = (F.col("total") - most * F.col("full")).cast("double") / F.col("open_w")
    fits = level * F.col("w") <= (most * F.col("source_size")).cast("double")
    levels = levels.withColumn("level", F.max(F.when(fits, level)).over(everything))
    return levels.select(
        "source", "source_size",
        F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(0.0)), (most * F.col("source_size")).cast("double")).alias("target"))


def decisions(rows: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source from rows (source, id, size, key): where its selection stops.

    Columns: source, source_size, target, epochs, cut_key, cut_id, cut_size, cut_words.
    Documents before (cut_key, cut_id, cut_size) are taken once more, those equal to
    it give ``cut_words`` words each.
    """
    rows = rows.withColumn("bucket", bucket(F.col("key")))
    sums = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = aims.withColumn("budget", F.floor(F.col("target") - (F.col("epochs") * F.col("source_size"))).cast("long"))
    aims = materialise(aims, "mix-targets")

    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(prior), F.lit(0)))
        .join(aims.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("budget") - F.col("before"))
        .toDF("s", "b", "left"))
    inside = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    same = inside.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size")
    prior = run.rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        same.withColumn("left", F.col("left") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(prior), F.lit(0)))
        .where((F.col("left") >= 0) & (F.col("left") < F.col("n") * F.col("size")))
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"),
                F.floor(F.col("left") / F.col("n")).cast("long").alias("cut_words")))
    return aims.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget")


def with_taken(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, epochs and taken; needs source, id, size and key."""
    decided = decided.withColumnRenamed("source", "s")
    if decided.count() <= BROADCAST_SOURCES:
        decided = F.broadcast(decided)
    joined = rows.join(decided, F.col("source").eqNullSafe(F.col("s")))
    mine, cut = (F.struct(F.col(p + "key").alias("k"), F.col(p + "id").alias("i"), F.col(p + "size").alias("n")) for p in ("", "cut_"))
    # A source without a cut has a budget of no words beyond its epochs.
    once = F.when(F.col("cut_key").isNull(), 0).when(mine < cut, F.col("size")).when(mine == cut, F.col("cut_words")).otherwise(0)
    return joined.withColumn("extra", once.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, most: int = MAX_EPOCHS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of every document the mix takes.

    Returns doc_id, source, size, source_size, target (both its source's), epochs and
    taken. Null and empty texts have size 0 and are taken 0 times; a null source is a
    source of its own, the last; a null id counts as one id; repeated rows count as often
    as they occur, and rows equal in source, id and size share a cut evenly. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = narrowed(docs, id=id_col, text=text_col, source=source_col)
    rows = rows.select("id", "source", words(F.col("text")).alias("size"), keyed(F.col("id"), quality(F.col("text")), seed).alias("key"))
    rows = materialise(rows, "mix-rows")
    out = with_taken(rows, decisions(rows, weights, most))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "epochs", "taken")


def mixed_documents(docs: DataFrame, seed: int = 7, weights=WEIGHTS, most: int = MAX_EPOCHS, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document's row once per copy, the last copy cut to the words taken.

    All columns of ``docs`` stay as they are, except that a cut copy's text ends after
    its last word. Documents of which nothing is taken have no row.
    """
    names = docs.columns
    keep = docs.select(F.struct(*[docs[c] for c in names]).alias("row"))
    text = F.col("row")[text_col]
    rows = keep.select("row", F.col("row")[id_col].alias("id"), F.col("row")[source_col].alias("source"),
                       words(text).alias("size"), keyed(F.col("row")[id_col], quality(text), seed).alias("key"))
    small = materialise(rows.select("id", "source", "size", "key"), "mix-rows")
    taken = with_taken(rows, decisions(small, weights, most))
    copies = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    spread = taken.where(F.col("taken") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), "")
    cut = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    return spread.select(*[(F.when(cut, part).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in names])
