"""Language identification by Bayesian evidence fusion.

For each language l the evidence adds up in logarithms:

* text: naive Bayes over hashed byte trigrams, the mean log-likelihood of a trigram
  times at most ``EFFECTIVE`` of them (neighbouring trigrams aren't independent);
* the language declared in the markup and the suffix of the address, each by how often
  it goes with texts of each language, from grouped counts with add-one smoothing;
* the host's prior, shrunk to its domain's, which is shrunk to the whole corpus's.

Counts come from aggregated passes over the whole corpus, the languages among them; only the
text model is fitted on a bounded sample of labelled rows of each language.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import claim, column_or_null, fresh, materialise, narrowed, without
from tesserae.llm.html import parse

#: Labelled rows of each language that the text model is fitted on, at most.
SAMPLE = 2000
#: Different labelled texts that a language needs in the whole table.
LEAST_ROWS = 3
#: Hashed trigrams.
BUCKETS = 1 << 15
#: Trigrams that count as independent evidence.
EFFECTIVE = 100
#: Rows' worth of a parent's prior in a domain's and a host's.
STRENGTH = 20.0
#: A document is kept at this posterior and number of letters (lower-case ASCII or non-ASCII bytes) at least.
CONFIDENT, LETTERS = 0.5, 3
#: Bytes counted at a time.
CHUNK = 1 << 20


_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ROOT = re.compile(r"<html(?:\s[^>]*)?>", re.I)
_LANG = re.compile(r"\s(?:xml:)?lang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_META = re.compile(r"<meta\s+http-equiv\s*=\s*[\"']?content-language[\"']?\s+content\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(text) - 2), CHUNK):
        b = np.frombuffer(text[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(2654435761)
            out += np.bincount(h >> np.uint32(17), minlength=BUCKETS)
    return out


def _lower(text) -> bytes:
    return (text.as_py() or "").lower().encode("utf-8", "ignore")


def fit(docs: DataFrame, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigrams, from ``sample`` labelled rows of each.

    All labels of the table are counted. Of each the rows of smallest hash are taken: first
    the hash that bounds them, then the texts.
    """
    rows = docs.select(docs[text_col].alias("text"), docs[label_col].cast("string").alias("label"))
    rows = rows.where("label is not null and length(text) > 0").withColumn("h", F.xxhash64("label", "text"))
    each = materialise(rows.select("label", "h").distinct(), "labels")
    totals = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    found = {x.label: x.n for x in totals.collect()}
    if not found:
        return [], np.zeros((BUCKETS, 0))
    names = sorted(x for x in found if found[x] >= LEAST_ROWS) or sorted(found)
    # Twice as many as needed by the hash's share of all hashes; of these the window takes the smallest.
    near = F.col("h") / 2.0**64 + 0.5 <= 2 * sample / F.col("n")
    least = each.join(F.broadcast(totals.where(F.col("label").isin(names)) if len(names) < len(found) else totals), "label").where((F.col("n") <= 2 * sample) | near)
    least = least.withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("row") <= sample)
    edges = least.groupBy("label").agg(F.max("h").alias("edge"))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held.setdefault(label, np.zeros(BUCKETS, np.int64))
                own += trigram_counts(_lower(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["label", "counts"])

    chosen = rows.join(F.broadcast(edges), "label").where(F.col("h") <= F.col("edge")).dropDuplicates(["label", "h"]).select("label", "text", (F.col("h") % 4).alias("part"))
    table = np.full((BUCKETS, len(names)), 0.5)
    at = {x: i for i, x in enumerate(names)}
    # Up to seven parts of a label, each with one vector of fixed length.
    for label, counts in chosen.repartition("label", "part").mapInArrow(count, "label string, counts binary").toLocalIterator():
        table[:, at[label]] += np.frombuffer(zlib.decompress(counts), np.int64)
    return names, np.log(table / table.sum(axis=0))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^(?:[^/@?#]*@)?([^/:?#]*)", 1))


def evidence(docs: DataFrame, id_col: str, text_col: str, declared_col: str | None, url_col: str | None, host_col: str | None, model) -> DataFrame:
    """One row per document: doc_id, mark (of the text), declared, suffix, domain, host, letters, loglik."""
    names, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)
    url = column_or_null(docs, url_col, "string")
    host = F.nullif(_host(url), F.lit("")) if host_col is None else column_or_null(docs, host_col, "string")
    labels = F.split(host, r"\.")
    several = F.size(labels) > 1
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("mark"),
        F.lower(F.substring_index(F.trim(column_or_null(docs, declared_col, "string")), "-", 1)).alias("declared"),
        F.when(several, F.element_at(labels, -1)).alias("suffix"),
        F.when(several, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host).alias("domain"), host.alias("host"), docs[text_col].alias("text"))

    def score(batches):
        claim("langid")
        w = held.value
        for batch in batches:
            letters, logs = [], []
            for text in batch.column(batch.num_columns - 1):
                data = _lower(text)
                b = np.frombuffer(data, np.uint8)
                n = int(np.count_nonzero((b >= 97) & (b != 123) & (b != 124) & (b != 125) & (b != 126)))
                counts = trigram_counts(data)
                letters.append(n)
                some = np.flatnonzero(counts)
                logs.append(counts[some] @ w[some] / max(1, int(counts.sum())) * min(n, EFFECTIVE))
            columns = batch.columns[:-1] + [pa.array(letters, pa.int64()), pa.array(logs, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "letters", "loglik"])

    return rows.mapInArrow(score, "doc_id long, mark long, declared string, suffix string, domain string, host string, letters long, loglik array<double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             url_col: str | None = None, host_col: str | None = None, label_col: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """The language of every document, and whether that is sure enough to keep it.

    ``declared_col`` is the language that the markup declares (``en-GB`` counts as ``en``);
    address suffix, domain and host come from ``url_col``, or the host alone from
    ``host_col``; what a table lacks or is null is no evidence. The text model learns from
    ``label_col``, or else the declared language.

    Returns doc_id, lang, posterior, text_lang (by the text alone), declared, keep, mark. Texts without
    letters, null and empty ones included, have lang 'und', posterior 0 and aren't kept.
    Repeated rows get equal results; ties go to the first language by name; a table without
    labels gives 'und' throughout, an empty one no rows.
    """
    model = fit(docs, text_col, label_col or declared_col, sample)
    names = model[0]
    rows = evidence(docs, id_col, text_col, declared_col, url_col, host_col, model)
    none = (F.lit("und"), F.lit(0.0), F.lit("und"))
    if not names:
        return rows.select("doc_id", *[c.alias(n) for c, n in zip(none, ("lang", "posterior", "text_lang"), strict=True)], "declared", F.lit(False).alias("keep"), "mark")
    best = F.array_position("loglik", F.array_max("loglik")) - 1
    rows = materialise(rows.withColumn("best", F.when(F.col("letters") >= LETTERS, best)), "language")

    each = range(len(names))
    counts = [F.sum((F.col("best") == i).cast("long")).alias(f"c{i}") for i in each]
    seen = [x or 0 for x in rows.agg(*counts).first()]
    prior = [(x + 1) / (sum(seen) + len(names)) for x in seen]

    def likelihood(column: str) -> DataFrame:
        """value -> log P(value | language) for each language."""
        table = rows.where(F.col(column).isNotNull() & F.col("best").isNotNull()).groupBy(column).agg(*counts)
        totals = table.agg(F.count(F.lit(1)), *[F.sum(f"c{i}") for i in each]).first()
        values = [F.log((F.col(f"c{i}") + 1) / F.lit(float((totals[i + 1] or 0) + totals[0] + 1))) for i in each]
        return table.select(F.col(column).alias(f"_{column}"), F.array(*values).alias(f"{column}_log"))

    host = rows.where("host is not null and best is not null").groupBy("domain", "host").agg(*counts)
    domain = host.groupBy(F.col("domain").alias("d")).agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in each])
    # Sums of all languages are columns of their own: repeated in each language's formula they'd grow with the square.
    host = host.withColumn("c", sum(F.col(f"c{i}") for i in each))
    domain = domain.withColumn("d_", sum(F.col(f"d{i}") for i in each))
    shrunk = lambda own, up, all_: (own + STRENGTH * up) / (all_ + STRENGTH)
    up = [shrunk(F.col(f"d{i}"), F.lit(prior[i]), F.col("d_")) for i in each]
    low = [F.log(shrunk(F.col(f"c{i}"), F.col(f"u{i}"), F.col("c"))) for i in each]
    domain = domain.select("d", *[u.alias(f"u{i}") for i, u in enumerate(up)])
    host = host.join(domain, host["domain"] == domain["d"]).select(F.col("host").alias("_host"), F.array(*low).alias("host_log"))

    out = rows
    for column, table in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", host)):
        out = out.join(table, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
    start = F.array(*[F.lit(float(np.log(p))) for p in prior])
    add = lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    score = add(add(add(F.col("loglik"), F.coalesce("host_log", start)), F.col("declared_log")), F.col("suffix_log"))
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    share = 1 / F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    known = F.col("best").isNotNull()
    kinds = F.array(*[F.lit(x) for x in names])
    name = lambda array: F.get(kinds, (F.array_position(array, F.array_max(array)) - 1).cast("int"))
    return out.select(
        "doc_id", F.when(known, name(F.col("score"))).otherwise("und").alias("lang"), F.when(known, share).otherwise(0.0).alias("posterior"),
        F.when(known, name(F.col("loglik"))).otherwise("und").alias("text_lang"), "declared",
        (known & (share >= CONFIDENT)).alias("keep"), "mark")


def declared_language(page: str) -> str | None:
    """The language that a page's markup declares: of its ``html`` element, or else of a ``meta`` element."""
    page = _COMMENT.sub(" ", page)
    root = _ROOT.search(page)
    for pattern, inside in ((_LANG, root[0] if root else ""), (_META, page)):
        m = pattern.search(inside)
        value = next((x for x in m.groups() if x), "").split(",")[0].strip() if m else ""
        if value:
            return value.replace("_", "-")
    return None


def _marked_up(batches):
    for batch in batches:
        texts, declared = [], []
        for value in batch.column(batch.num_columns - 1):
            page = value.as_py() or ""
            texts.append("\n".join(text for text, _, left_out in parse(page) if not left_out))
            declared.append(declared_language(page))
        columns = [*batch.columns[:-1], pa.array(declared, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "declared", "text"])


def identify_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``identify`` for raw web pages: page_id instead of doc_id, without mark.

    The text and the declared language are read from the markup, suffix, domain and host
    from the address. What ``identify`` says of null and empty texts holds for pages.
    """
    rows = narrowed(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = materialise(rows.mapInArrow(_marked_up, "page_id long, url string, declared string, text string"), "marked-up")
    return identify(rows, "page_id", "text", "declared", "url", sample=sample).withColumnRenamed("doc_id", "page_id").drop("mark")


def kept(docs: DataFrame, **how) -> DataFrame:
    """The documents whose language is sure enough, all columns as they are."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    gone_id, gone_mark = fresh(docs, "gone", "mark")
    gone = identify(docs, **how).where(~F.col("keep")).select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    gone = materialise(gone, "rejected")
    return without(docs, gone, docs[id_col].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text_col]) == F.col(gone_mark)))
