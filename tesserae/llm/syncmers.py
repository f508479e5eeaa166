"""Document fingerprints from closed syncmers.

A text is read as symbols: runs of non-white-space of at most ``RUN`` code points, and
single characters in scripts written without spaces. Of its k-symbol windows those are
anchors (closed syncmers) whose smallest inner s-symbol substring, by hash, stands at
one of the window's edges. Whether a window is an anchor depends on nothing around it,
so an edit changes only the anchors that it touches, and equal passages have equal
anchors wherever they stand. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, narrowed

#: Symbols in a window and in its inner substrings.
K, S = 6, 2
RUN = 16
#: Scripts in which a character is a symbol.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
SYMBOL = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]{{1,{RUN}}}"

#: Documents that lie together when neighbours are looked up, about.
NEIGHBOURS = 1500
#: Quantiles of the ids that the driver keeps at most.
QUANTILES = 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, not again for each element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (pos, hash) of the closed syncmers of a text, in its order; pos counts symbols from 0.

    A text without closed syncmers, as of fewer than k symbols, has its symbols themselves as its anchors.
    Null counts as empty. The work is linear in the text's length.
    """
    symbols = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)), lambda x: F.xxhash64(x))
    inner = k - s + 1

    def windows(h: Column) -> Column:
        parts = [F.slice(h, F.lit(i + 1), F.size(h) - (s - 1)) for i in range(s)]
        subs = parts[0]
        for part in parts[1:]:
            subs = F.zip_with(subs, part, lambda a, b: F.xxhash64(a, b))

        def at(m: Column) -> Column:
            def edge(i: Column) -> Column:
                ends = F.least(F.get(m, i), F.get(m, i + (inner - 1)))
                middle = [F.get(m, i + j) for j in range(1, inner - 1)]
                return ends <= (F.least(*middle) if len(middle) > 1 else middle[0])

            found = F.filter(F.sequence(F.lit(0), F.size(h) - k), edge)
            return F.transform(found, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))

        return _let(subs, at)

    def whole(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.struct(i.alias("pos"), x.alias("hash")))
        some = lambda found: F.when(F.size(found) == 0, each).otherwise(found)
        return F.when(F.size(h) < k, each).otherwise(_let(windows(h), some))

    return _let(symbols, whole)


def hashes(found: Column) -> Column:
    return F.transform(found, lambda x: x["hash"])


def fingerprint(found: Column) -> Column:
    """The anchors' upper 32 bits as hexadecimal digits, 8 an anchor, in the text's order."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(F.shiftrightunsigned(x["hash"], 32)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of anchor hashes as sets; 1 if both are empty."""

    def both(common: Column) -> Column:
        return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common))

    return _let(F.size(F.array_intersect(a, b)), both).cast("double")


def matched_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where the documents of ``right`` hold passages of those of ``left``.

    Both have id and anchors. Returns (left_id, right_id, shift, n, first, last): n
    distinct anchors that stand ``shift`` symbols later in the right document, and the
    symbols of the left one between which they stand. Empty tables and documents without anchors
    give no rows. The join is on the anchor's hash, never on all pairs of documents.
    """
    a = left.select(F.col("id").alias("left_id"), F.explode("anchors").alias("a")).select("left_id", F.col("a.pos").alias("p"), F.col("a.hash").alias("h"))
    b = right.select(F.col("id").alias("right_id"), F.explode("anchors").alias("b")).select("right_id", F.col("b.pos").alias("q"), F.col("b.hash").alias("h"))
    joined = a.join(b, "h").select("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift"), "p")
    return joined.groupBy("left_id", "right_id", "shift").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"), F.max("p").alias("last"))


def _with_bucket(rows: DataFrame) -> DataFrame:
    """``rows`` with ``bucket``, which grows with id; null ids lie in the lowest.

    Quantiles of the ids, at most QUANTILES of them on the driver, are split evenly
    further down, so the number of buckets follows the number of rows.
    """
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    if low is None:
        return rows.withColumn("bucket", F.lit(-1).cast("long"))
    parts = max(1, min(QUANTILES, n // NEIGHBOURS))
    points = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", points, 20 * QUANTILES)).first()[0] if points else []
    cuts = sorted({low, *cuts})
    finer = max(1, n // (NEIGHBOURS * len(cuts)))
    # Two short searches instead of one along all cuts.
    step = max(1, int(len(cuts) ** 0.5))
    rough = F.split(F.lit(",".join(map(str, cuts[::step]))), ",").cast("array<bigint>")
    exact = F.split(F.lit(",".join(map(str, [*cuts, high + 1]))), ",").cast("array<bigint>")
    known = F.coalesce("id", F.lit(low))
    upto = lambda array: F.size(F.filter(array, lambda c: c <= known))
    rough_at, cut_at = fresh(rows, "rough", "cut")
    rows = rows.withColumn(rough_at, (upto(rough) - 1) * step)
    rows = rows.withColumn(cut_at, F.col(rough_at) + upto(F.slice(exact, F.col(rough_at) + 1, F.lit(step))) - 1)
    start, end = F.get(exact, F.col(cut_at)), F.get(exact, F.col(cut_at) + 1)
    within = F.least(F.lit(finer - 1), F.floor((known - start) * finer / (end - start)))
    bucket = F.when(F.col("id").isNull(), -1).otherwise(F.col(cut_at).cast("long") * finer + within)
    return rows.withColumn("bucket", bucket.cast("long")).drop(rough_at, cut_at)


def with_next(rows: DataFrame, extra: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows (id, text) with ``next``, the text that follows by descending id; the first follows the last.

    ``extra`` names columns computed from text; each has a ``next_`` twin. Equal ids are
    ordered by text, null ids come last. Documents are sorted in buckets of neighbouring
    ids; a bucket's last row gets the first row of the next bucket by a join, so no
    task sees more than a bucket and each text is shuffled once.
    """
    dealt = _with_bucket(rows).repartition("bucket")
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("id", "text")).alias("head"))
    order = Window.orderBy(F.col("bucket").desc())
    ids = _with_bucket(rows.select("id")).select("bucket").distinct()
    # The bucket whose last row is followed by this bucket's head; one short row a bucket.
    before = ids.withColumn("into", F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy())))
    heads = heads.join(before, "bucket").select("into", F.struct(F.col("head.text").alias("text"), *[f(F.col("head.text")).alias(c) for c, f in extra.items()]).alias("head"))
    for c, f in extra.items():
        dealt = dealt.withColumn(c, f(F.col("text")))
    inside = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), F.col("text").desc())
    out = dealt.withColumn("follows", F.lead(F.struct("text", *extra)).over(inside))
    out = out.join(heads, F.col("bucket") == F.col("into"), "left")
    follows = F.coalesce(F.col("follows"), F.col("head"))
    return out.select("id", "text", *extra, follows["text"].alias("next"), *[follows[c].alias(f"next_{c}") for c in extra])


def fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document by descending doc_id, the first after the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty: fingerprint '', and likeness 1 to a text
    without symbols, else 0. Repeated ids follow each other in order of their texts
    and null ids come last; a single document follows itself; an empty table gives no rows.
    Other columns are ignored.
    """
    rows = narrowed(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, {"anchors": lambda t: anchors(t, k, s)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    rows = rows.withColumn("edited_anchors", anchors(F.col("edited"), k, s))
    own, near, changed = (hashes(F.col(c)) for c in ("anchors", "next_anchors", "edited_anchors"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, near).alias("near_next"))
