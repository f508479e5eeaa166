"""Full-text search with BM25 or cosine ranking.

Documents keep their words as an array, in order, and their weight. A query's statistics
(documents, mean length, the frequencies of its words) are one row, read as a scalar subquery;
documents are then counted and scored where they stand, without a shuffle, and only those that
the query's other parts leave. Words that a pattern matches have frequencies of their own: one
small row for each document and such word is shuffled, not the corpus's postings. Scores are
integers, scaled by 1024, so sums don't depend on their order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.errors import CatalogError, QueryError
from tesserae.functions import text as pipelines
from tesserae.operators import parser
from tesserae.operators.kinds import KINDS, Kind
from tesserae.operators.parser import And, Glob, Node, Not, Or, Phrase, Word
from tesserae.plans.query import IndexQuery
from tesserae.plans.specs import column

SCALE = 1024.0


def scaled(x: Column) -> Column:
    return F.floor(x * SCALE + 0.5).cast("bigint")


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + n / df)


@dataclass(frozen=True)
class Okapi:
    """BM25."""

    k1: float = 1.2
    b: float = 0.75

    def score(self, f: Column, length: Column, weight: Column, n: Column, mean: Column, df: Column) -> Column:
        tf = f * (self.k1 + 1.0) / (f + self.k1 * ((1.0 - self.b) + self.b * length / mean))
        return scaled(tf * idf(n, df))

    def query_weight(self, n: Column, df: Column) -> Column:
        """The highest score that a query can reach."""
        return F.coalesce(F.sum(scaled(idf(n, df) * (self.k1 + 1.0))), F.lit(0))


@dataclass(frozen=True)
class Cosine:
    """Cosine of the angle between document and query, the query's length left out."""

    def score(self, f: Column, length: Column, weight: Column, n: Column, mean: Column, df: Column) -> Column:
        return scaled((1.0 + F.log(f)) / weight) * scaled(idf(n, df))

    def query_weight(self, n: Column, df: Column) -> Column:
        return F.coalesce(scaled(F.sqrt(F.sum(F.pow(idf(n, df), F.lit(2.0))))), F.lit(0))


#: Scorers by name; ``register_scorer`` adds others.
SCORERS: dict[str, object] = {"okapi": Okapi(), "cosine": Cosine()}


def register_scorer(name: str, scorer: object) -> None:
    if name in SCORERS:
        raise CatalogError(f"there is a scorer {name!r} already")
    SCORERS[name] = scorer


def document_weight(words: Column) -> Column:
    """sqrt of the sum over distinct words of (1 + ln f)^2: a run-length pass over the sorted words."""
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("f"), F.lit(0.0).alias("sum"))
    square = lambda f: F.when(f > 0, (1.0 + F.log(f)) * (1.0 + F.log(f))).otherwise(0.0)

    def step(a: Column, w: Column) -> Column:
        same = a["word"].eqNullSafe(w)
        return F.struct(w.alias("word"), F.when(same, a["f"] + 1.0).otherwise(1.0).alias("f"), F.when(same, a["sum"]).otherwise(a["sum"] + square(a["f"])).alias("sum"))

    return F.aggregate(F.sort_array(words), start, step, lambda a: F.sqrt(a["sum"] + square(a["f"])))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(ordered: Column, word: Callable[[Column], Column], entry: Callable[[Column, Column, Column], Column]) -> Column:
    """``entry(ordered, start, f)`` of each run of equal words; ``word`` is that of an element of ``ordered``."""

    def entries(items: Column) -> Column:
        first = lambda x, i: F.when((i == 0) | ~word(x).eqNullSafe(word(F.get(items, i - 1))), i)
        starts = F.filter(F.transform(items, first), F.isnotnull)
        return _let(starts, lambda at: F.transform(at, lambda i, k: entry(items, i, F.coalesce(F.get(at, k + 1), F.size(items)) - i)))

    return _let(ordered, entries)


def counted(words: Column) -> Column:
    """(word, f) of each distinct word of an array: a document's postings, counted where it stands."""
    return _runs(F.sort_array(words), lambda x: x, lambda items, i, f: F.struct(F.get(items, i).alias("word"), f.cast("bigint").alias("f")))


def located(words: Column) -> Column:
    """(word, f, positions) of each distinct word of an array."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("position"))))
    spots = lambda items, i, f: F.transform(F.slice(items, i + 1, f), lambda x: x["position"])
    return _runs(placed, lambda x: x["word"], lambda items, i, f: F.struct(F.get(items, i)["word"].alias("word"), f.cast("bigint").alias("f"), spots(items, i, f).alias("positions")))


def glob_pattern(glob: str) -> tuple[str, str]:
    """(literal prefix, anchored regular expression) of a pattern with * and ?."""
    prefix = re.match(r"[^*?]*", glob)[0]
    if not prefix:
        raise QueryError(f"pattern {glob!r} shouldn't start with a wildcard")
    body = "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"(\W)", r"\\\1", c) for c in glob)
    return prefix, f"^{body}$"


@dataclass(frozen=True)
class Inverted:
    """A stored inverted index: postings (word, rid, f, length, weight, df, positions) sorted by word, and the corpus's size.

    Files hold ranges of words, so a search reads the row groups of its words only.
    """

    postings: DataFrame
    n: float
    mean: float | None


class Text(Kind):
    """A text index. Options: pipeline (Pipeline), scorer (a name in SCORERS or a scorer).

    Null text isn't indexed, empty text is, with length 0. Several sources are one text.
    """

    options = ("query",)
    sortable = False
    unique_values = False
    scored = True

    @property
    def pipeline(self) -> pipelines.Pipeline:
        return self.spec.options.get("pipeline", pipelines.DEFAULT)

    @property
    def scorer(self):
        named = self.spec.options.get("scorer", "okapi")
        return SCORERS[named] if isinstance(named, str) else named

    def stored(self, df: DataFrame) -> dict[str, Column]:
        sources = [column(s) for s in self.spec.sources]
        some = F.coalesce(*[s.isNotNull() for s in sources]) if len(sources) == 1 else F.greatest(*[s.isNotNull() for s in sources])
        words = F.when(some, self.pipeline.column(F.concat_ws(" ", *sources)))
        return {self.at: words}

    def derived(self) -> dict[str, Column]:
        # Computed once a document, when it is catalogued: queries read it as a column.
        return {self.weight: document_weight(self.value)}

    @property
    def weight(self) -> str:
        return f"{self.at}__weight"

    def parse(self, request: Mapping) -> IndexQuery | None:
        return super().parse(request)

    def parsed(self, query: IndexQuery) -> parser.Parsed | None:
        text = " ".join(str(k) for k in query.keys if k is not None)
        return parser.parse(text, self.pipeline.query_words) if text else None

    def predicate(self, query: IndexQuery, rows: DataFrame) -> Column:
        raise CatalogError("text is searched by matches(), not by a predicate")

    # -- statistics

    def _leaf_condition(self, leaf: Word | Glob, word: Column) -> Column:
        if isinstance(leaf, Word):
            return word == leaf.text
        prefix, pattern = glob_pattern(leaf.text)
        return F.startswith(word, F.lit(prefix)) & word.rlike(pattern)

    def _postings(self, rows: DataFrame, simple: list[Word | Glob], phrases: list[Phrase], weigh: bool) -> DataFrame:
        """(rid, length, weight, phrase flags, word, f) of the words that some leaf matches."""
        wanted = lambda w: F.coalesce(*[c for c in [self._any_leaf(simple, w)]])
        spaced = F.concat(F.lit(" "), F.array_join(self.value, " "), F.lit(" "))
        flags = [F.contains(spaced, F.lit(" " + " ".join(p.words) + " ")).alias(f"p{i}") for i, p in enumerate(phrases)]
        hits = rows.where(self.indexed).select("rid", F.size(self.value).alias("length"), F.col(self.weight).alias("weight") if weigh else F.lit(1.0).alias("weight"), F.filter(self.value, wanted).alias("hits"), *flags)
        keep = ["rid", "length", *[f"p{i}" for i in range(len(phrases))]]
        return hits.select(*keep, "weight", F.inline(counted(F.col("hits")))).withColumn("f", F.col("f").cast("double"))

    def _any_leaf(self, leaves: list[Word | Glob], word: Column) -> Column:
        literal = [x.text for x in leaves if isinstance(x, Word)]
        out = word.isin(*literal) if literal else F.lit(False)
        for leaf in leaves:
            if isinstance(leaf, Glob):
                out = out | self._leaf_condition(leaf, word)
        return out

    def frequencies(self, rows: DataFrame, words: list[str]) -> DataFrame:
        """(word, df) of the given words that occur."""
        each = rows.where(self.indexed).select(F.explode(F.array_distinct(F.filter(self.value, lambda w: w.isin(*words)))).alias("word"))
        return each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    # -- search

    def matches(self, tree: Node, rows: DataFrame, within: Column | None = None, index: Inverted | None = None) -> DataFrame:
        """(rid, score) of the documents that a query tree selects, of those ``within`` if that is given.

        Statistics are those of all documents. With ``index`` the documents' words aren't read.
        """
        leaves = _all_leaves(tree)
        phrases = [x for x in leaves if isinstance(x, Phrase)]
        simple = list(dict.fromkeys([x for x in leaves if not isinstance(x, Phrase)] + [Word(w) for p in phrases for w in p.words]))
        if index is not None:
            documents = self._by_index(simple, phrases, rows, within, index)
        elif any(isinstance(x, Glob) for x in simple):
            documents = self._by_postings(simple, phrases, rows, within)
        else:
            documents = self._in_place(simple, phrases, rows, within)

        def evaluate(node: Node) -> Column:
            """The node's score for a document, null where it doesn't match."""
            if isinstance(node, Phrase):
                words = [evaluate(Word(w)) for w in node.words]
                return F.when(F.col(f"p{phrases.index(node)}"), _plus(words))
            if isinstance(node, (Word, Glob)):
                return F.col(f"s{simple.index(node)}")
            if isinstance(node, Or):
                found = [evaluate(c) for c in node.children]
                some = found[0].isNotNull()
                for x in found[1:]:
                    some = some | x.isNotNull()
                return F.when(some, _plus([F.coalesce(x, F.lit(0)) for x in found]))
            score = _plus([evaluate(c) for c in node.children if not isinstance(c, Not)])
            for c in node.children:
                if isinstance(c, Not):
                    score = F.when(evaluate(c.child).isNull(), score)
            return score

        return documents.select("rid", evaluate(tree).cast("bigint").alias("score")).where("score is not null")

    def _measured(self, rows: DataFrame, of: Callable[[Column], list[Column]]) -> DataFrame:
        """(rid, weight, length and what ``of`` makes of the words) of the indexed documents.

        Text is split once a document, whatever is asked of these columns: Spark copies the
        expressions that a condition uses below selects, but not below a generator.
        """
        documents = self._documents(rows).drop("length")
        return documents.select("rid", "weight", F.inline(F.transform(F.array("words"), lambda ws: F.struct(F.size(ws).alias("length"), *of(ws)))))

    def _in_place(self, simple: list[Word], phrases: list[Phrase], rows: DataFrame, within: Column | None) -> DataFrame:
        """(rid, s0 .., p0 ..): each word's score and whether each phrase occurs, for documents with some word."""
        held = lambda ws: [F.array_contains(ws, x.text).alias(f"h{i}") for i, x in enumerate(simple)]
        counts = [F.sum(F.when(F.col(f"h{i}"), 1.0).otherwise(0.0)).alias(f"d{i}") for i in range(len(simple))]
        stats = self._measured(rows, held).agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"), *counts).alias("stats")).scalar()

        def counted_and_found(ws: Column) -> list[Column]:
            spaced = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
            fs = [F.size(F.filter(ws, lambda w: w == x.text)).cast("double").alias(f"f{i}") for i, x in enumerate(simple)]
            return fs + [F.contains(spaced, F.lit(" " + " ".join(p.words) + " ")).alias(f"p{i}") for i, p in enumerate(phrases)]

        has = [F.col(f"f{i}") > 0 for i in range(len(simple))]
        some = has[0]
        for h in has[1:]:
            some = some | h
        # A subquery of its own column is read once a row, however many words ask for it.
        found = self._measured(rows if within is None else rows.where(within), counted_and_found).where(some).withColumn("stats", stats)
        scores = []
        for i in range(len(simple)):
            df = F.nullif(F.col(f"stats.d{i}"), F.lit(0.0))
            score = self.scorer.score(F.col(f"f{i}"), F.col("length").cast("double"), F.col("weight"), F.col("stats.n"), F.col("stats.mean"), df)
            scores.append(F.when(has[i], score).alias(f"s{i}"))
        return found.select("rid", *scores, *[f"p{i}" for i in range(len(phrases))])

    def _by_postings(self, simple: list[Word | Glob], phrases: list[Phrase], rows: DataFrame, within: Column | None) -> DataFrame:
        """The same where patterns match words that aren't known beforehand."""
        weigh = not isinstance(self.scorer, Okapi)
        df = self._postings(rows, simple, [], False).groupBy(F.col("word").alias("w")).agg(F.count(F.lit(1)).alias("df"))
        postings = self._postings(rows if within is None else rows.where(within), simple, phrases, weigh)
        stats = rows.where(self.indexed).agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(self.value)).alias("mean")).alias("stats")).scalar()
        scored = postings.join(df, F.col("word") == F.col("w")).withColumn("stats", stats)
        scored = scored.withColumn("s", self.scorer.score(F.col("f"), F.col("length").cast("double"), F.col("weight"), F.col("stats.n"), F.col("stats.mean"), F.col("df").cast("double")))
        sums = [F.sum(F.when(self._leaf_condition(leaf, F.col("word")), F.col("s"))).alias(f"s{i}") for i, leaf in enumerate(simple)]
        flags = [F.first(f"p{i}").alias(f"p{i}") for i in range(len(phrases))]
        return scored.groupBy("rid").agg(*sums, *flags)

    def _by_index(self, simple: list[Word | Glob], phrases: list[Phrase], rows: DataFrame, within: Column | None, index: Inverted) -> DataFrame:
        """The same from a stored index; phrases by the positions of their words."""
        hits = index.postings.where(self._any_leaf(simple, F.col("word")))
        if within is not None:
            hits = hits.join(rows.where(within).select("rid"), "rid", "left_semi")
        mean = F.lit(index.mean).cast("double")
        hits = hits.withColumn("s", self.scorer.score(F.col("f").cast("double"), F.col("length").cast("double"), F.col("weight"), F.lit(index.n), mean, F.col("df").cast("double")))
        sums = [F.sum(F.when(self._leaf_condition(leaf, F.col("word")), F.col("s"))).alias(f"s{i}") for i, leaf in enumerate(simple)]
        spots = {w: f"at{i}" for i, w in enumerate(dict.fromkeys(w for p in phrases for w in p.words))}
        found = hits.groupBy("rid").agg(*sums, *[F.max(F.when(F.col("word") == w, F.col("positions"))).alias(c) for w, c in spots.items()])
        flags = [self._follow([F.col(spots[w]) for w in p.words]).alias(f"p{i}") for i, p in enumerate(phrases)]
        return found.select("rid", *[f"s{i}" for i in range(len(simple))], *flags)

    @staticmethod
    def _follow(spots: list[Column]) -> Column:
        """Whether words stand one after another somewhere; null if one doesn't stand there at all."""
        starts = spots[0]
        for i, later in enumerate(spots[1:], 1):
            starts = F.array_intersect(starts, F.transform(later, _back(i)))
        return F.size(starts) > 0

    def inverted(self, rows: DataFrame) -> DataFrame:
        """The postings of a stored index, dealt out by ranges of words."""
        each = self._documents(rows).select("rid", "length", "weight", F.inline(located(F.col("words"))))
        df = rows.where(self.indexed).select(F.explode(F.array_distinct(self.value)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
        out = each.join(df, F.col("word") == F.col("w")).select("word", "rid", "length", "weight", "f", "positions", "df")
        # A word that all documents hold spans several ranges.
        return out.repartitionByRange("word", "rid").sortWithinPartitions("word", "rid")

    def _documents(self, rows: DataFrame) -> DataFrame:
        """(rid, length, weight, words) of the indexed documents: what stands before their words are dealt out, so that no word carries the others."""
        return rows.where(self.indexed).select("rid", F.size(self.value).alias("length"), F.col(self.weight).alias("weight"), F.col(self.at).alias("words"))

    def query_weight(self, tree: Node, rows: DataFrame) -> DataFrame:
        """One row, ``weight``: each occurrence of a word in the query counts."""
        words = parser.terms(tree)
        occurrences = F.explode(F.array(*[F.lit(w) for w in words])).alias("q")
        asked = rows.sparkSession.range(1).select(occurrences)
        df = asked.join(self.frequencies(rows, words), F.col("q") == F.col("word"))
        n = rows.where(self.indexed).agg(F.count(F.lit(1)).cast("double")).scalar()
        return df.withColumn("n", n).agg(self.scorer.query_weight(F.col("n"), F.col("df").cast("double")).cast("bigint").alias("weight"))

    # -- lexicon

    def vocabulary(self, rows: DataFrame, glob: str | None = None) -> DataFrame:
        """(word, df) of the index's words, those that a pattern matches."""
        words = rows.where(self.indexed).select(F.explode(F.array_distinct(self.value)).alias("word"))
        if glob:
            words = words.where(self._leaf_condition(Glob(glob) if set("*?") & set(glob) else Word(glob), F.col("word")))
        return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def postings(self, rows: DataFrame) -> DataFrame:
        """(word, rid, f, length, weight): the whole inverted table, to be written by word for reuse."""
        each = self._documents(rows).select("rid", "length", "weight", F.inline(counted(F.col("words"))))
        return each.select("word", "rid", "length", "weight", "f")


def _back(by: int):
    return lambda x: x - by


def _plus(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _all_leaves(node: Node) -> list[Word | Glob | Phrase]:
    if isinstance(node, Not):
        return _all_leaves(node.child)
    if isinstance(node, (And, Or)):
        return list(dict.fromkeys(x for c in node.children for x in _all_leaves(c)))
    return [node]


KINDS["text"] = Text


def weighted(parts: list[tuple[DataFrame, float]], how: str) -> DataFrame:
    """Union or intersection of (rid, score) tables, each score times its weight."""
    rows = None
    for i, (part, weight) in enumerate(parts):
        one = part.select("rid", (F.col("score") * weight).alias("score"), F.lit(i).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("there is nothing to combine")
    out = rows.groupBy("rid").agg(F.sum("score").alias("score"), F.count_distinct("part").alias("parts"))
    if how == "intersection":
        out = out.where(F.col("parts") == len(parts))
    elif how != "union":
        raise ValueError(f"how is union or intersection, not {how!r}")
    return out.drop("parts")


def n_best(scores: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The n best of (rid, score), and how many there are in all."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return scores.orderBy(F.col("score").desc(), F.col("rid").desc()).limit(n), scores.count()
