"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Base spans (email, ip, card, phone) follow fixed rules. They are seeds, and so are secrets
of a known form, which are no base spans. What stands before a seed makes two lexical
patterns: the last word and the marks after it (``token = "``), and the same with the word
before. Other tokens that may be identifiers are instances, which the same patterns tie to
the seeds. Spark scores this graph in turns: a pattern by the share of its occurrences that
are seeds of one kind or instances trusted as that kind, an instance by its best pattern that
enough different seeds or trusted instances support. So instances found in one turn support
other patterns in the next. New spans, of kind ``id``, are the instances of high-confidence patterns
and the secrets.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, claim, fresh, materialise, narrowed

#: In the order in which spans of one start are listed; the last is what the method adds.
KINDS = ("email", "ip", "card", "phone", "id")
#: Turns of scoring.
ROUNDS = 6
#: A pattern is trusted at this score and number of different seeds and trusted instances, an instance at this score.
PATTERN_SCORE, SUPPORT, INSTANCE_SCORE = 0.4, 3, 0.4
#: What an instance that is no seed adds to its patterns' scores, for its own score.
TRUST = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Addresses of four numbers and cards lie within such stretches.
_ZONE = re.compile(r"[0-9][0-9 .\-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An identifier written in groups of digits, such as 0171 234 5678.
_GROUPS = re.compile(r"(?<!\S)\(?[0-9]++(?:(?:[ /.-]|\) ?| \(|\)[/-])[0-9]++)*+(?=[\"'`)\]}>,;:!?.]*+(?:\s|\Z))")
_EDGES = "\"'`()[]{}<>,;:!?.=#$%&*|"
#: Seeds that are no base spans: long hexadecimal digits, and key formats that name themselves.
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])")
#: Shorter ones make patterns, but need one themselves to be personal data.
_LIKELY = re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,31}(?![A-Za-z0-9])")
#: Tokens that may be identifiers hold a digit, or a mark within that no ordinary word has, or follow = or :.
_TOKEN = re.compile(
    r"(?:(?<=[=:])|(?<=[=:][\s\"'`])|(?<=[=:]\s[\"'`]))(?P<named>[^\s=:\"'`][^\s=:]*+)"
    r"|(?<![^\s=:])[^\s=:0-9()@+~^\\{}\[\]]*+[0-9()@+~^\\{}\[\]][^\s=:]*+")
_ODD = re.compile(r"[0-9]|(?<=[^\W_])[()@+~^\\{}\[\]](?=[^\W_])")
_CONTEXT = re.compile(r"[^\W\d_]+|[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")

SPAN = "struct<start:int,kind:int,end:int>"
SEEN = "struct<start:int,kind:int,end:int,pattern:array<bigint>,instance:bigint>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: in each stretch of local characters before an @, the start is the first."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in a whole text, sorted; linear in its length."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for zone in _ZONE.finditer(text):
        start, end = zone.span()
        if end - start < 7:
            continue
        for m in _IP.finditer(text, start, end):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        if end - start >= 12:
            for m in _CARD.finditer(text, start, end):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def _instances(text: str, base: list[tuple[int, int, int]]):
    """(start, kind, end) of tokens that may be identifiers and runs of digit groups, outside of base spans.

    ``kind`` is that of secrets of a known form, one more for what is likely one, else None.
    Linear in the text's length.
    """
    secrets = [(*m.span(), len(KINDS) - 1) for m in _SECRET.finditer(text)] + [(*m.span(), len(KINDS)) for m in _LIKELY.finditer(text)]
    runs = [m.span() for m in _GROUPS.finditer(text) if " " in m[0]]
    tokens = []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if m["named"] is None and not _ODD.search(text, start, end):
            continue
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if start < end:
            tokens.append((start, end))
    # What starts first wins, of equal starts the earlier sort.
    last, i, taken = 0, 0, sorted((a, b) for a, _, b in base)
    for start, rank, end, kind in sorted([(a, 0, b, k) for a, b, k in secrets] + [(a, 1, b, None) for a, b in runs] + [(a, 2, b, None) for a, b in tokens], key=lambda x: x[:3]):
        if start < last:
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        last = end
        yield start, kind, end


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _occurrences(text: str, base: list[tuple[int, int, int]]):
    """(start, kind, end, patterns) of seeds and instances; each part of the text is read once for its context."""
    words, at = [], 0
    for start, kind, end in sorted([*base, *_instances(text, base)], key=lambda x: (x[0], x[2])):
        if start >= at:
            found = list(_CONTEXT.finditer(text, at, start))[-2:]
            marks = "".join(text[found[-1].end() if found else at : start].split())
            words = [*words, *(m[0].lower() if _LETTER.match(m[0]) else "0" for m in found)][-2:]
            # A pattern has a word at least; a number alone says nothing.
            contexts = [words[-n:] for n in (1, 2) if len(words) >= n and set(words[-n:]) != {"0"}]
            yield start, kind, end, [_hash(f"{' '.join(c)} {marks}") for c in contexts]
            words, at = [*words, "0"][-2:], end


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _found(batches):
    claim("pii")
    for batch in batches:
        base, seen = [], []
        for value in batch.column(2):
            text = value.as_py() or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            own = [{"start": a, "kind": k, "end": b, "pattern": p, "instance": _hash(text[a:b].lower())} for a, k, b, p in _occurrences(text, spans)]
            seen.append(own)
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        entry = pa.struct([*span, ("pattern", pa.list_(pa.int64())), ("instance", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(seen, pa.list_(entry))],
            names=["doc_id", "mark", "base", "seen"])


def scored(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Edges (pattern, instance, kind, n) -> trusted patterns (pattern, score) and instances (instance, trust).

    ``kind`` is null for an instance that isn't a seed. A pattern's score is that of its
    best kind. Both sides are aggregated before they are shuffled.
    """
    kinds = range(len(KINDS))
    n, seed = F.col("n"), F.col("kind").isNotNull()

    def patterns(joined: DataFrame) -> DataFrame:
        worth = [F.when(F.col("kind") == k, 1.0).when(~seed, TRUST * F.coalesce(F.col(f"t{k}"), F.lit(0.0))).otherwise(0.0) for k in kinds]
        sums = [F.sum(n * w).alias(f"s{k}") for k, w in zip(kinds, worth, strict=True)]
        support = [F.count(F.when(w >= INSTANCE_SCORE, 1)).alias(f"m{k}") for k, w in zip(kinds, worth, strict=True)]
        each = joined.groupBy("pattern").agg(F.sum("n").alias("all"), *sums, *support)
        score = [F.when(F.col(f"m{k}") >= SUPPORT, F.col(f"s{k}") / (F.col("all") + 1)) for k in kinds]
        best = F.greatest(*score)
        return each.where(best >= PATTERN_SCORE).select(F.col("pattern").alias("p"), best.alias("score"), *[F.coalesce(x, F.lit(0.0)).alias(f"w{k}") for k, x in zip(kinds, score, strict=True)])

    pats = materialise(patterns(edges.withColumns({f"t{k}": F.lit(None).cast("double") for k in kinds})), "pii-patterns")
    trust = None
    for turn in range(rounds):
        some = edges.where(~seed).join(pats, F.col("pattern") == F.col("p"))
        trust = some.groupBy(F.col("instance").alias("i")).agg(*[F.max(f"w{k}").alias(f"t{k}") for k in kinds])
        trust = materialise(trust, "pii-instances")
        if turn == rounds - 1:
            break
        pats = materialise(patterns(edges.join(trust, ~seed & (F.col("instance") == F.col("i")), "left")), "pii-patterns")
    return pats.select(F.col("p").alias("pattern"), "score"), trust.select(F.col("i").alias("instance"), F.greatest(*[F.col(f"t{k}") for k in kinds]).alias("trust"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, mark (of the text), base and added: arrays of (start, kind, end), kind
    a position in ``KINDS``, offsets in code points, end exclusive. Null and empty texts
    have none. Repeated rows give equal rows and count once; an empty table gives none. Other
    columns are ignored.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    found = materialise(rows.mapInArrow(_found, f"doc_id long, mark long, base array<{SPAN}>, seen array<{SEEN}>"), "pii-found")
    last = len(KINDS) - 1
    # A text that is repeated counts once.
    once = found.where(F.size("seen") > 0).groupBy("mark").agg(F.first("seen").alias("seen"))
    once = once.select("mark", F.explode("seen").alias("s")).select("mark", "s.start", "s.kind", "s.end", "s.instance", F.explode_outer("s.pattern").alias("pattern"))
    once = materialise(once, "pii-seen")
    edges = materialise(once.where("pattern is not null").groupBy("pattern", "instance", F.when(F.col("kind") > last, last).otherwise(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    patterns, instances = scored(edges)
    sure = instances.where(F.col("trust") >= INSTANCE_SCORE).select("instance", F.lit(True).alias("sure"))
    new = once.where(f"kind is null or kind > {last}").join(patterns.select("pattern"), "pattern", "left_semi")
    new = new.join(sure, "instance", "left").where("sure or kind is not null")
    new = new.select("mark", "start", "end").unionByName(once.where(F.col("kind") == last).select("mark", "start", "end"))
    new = new.groupBy(F.col("mark").alias("m")).agg(F.array_sort(F.collect_set(F.struct("start", F.lit(last).alias("kind"), "end"))).alias("added"))
    # Texts without occurrences, however often they are repeated, need no join.
    none = F.array().cast(f"array<{SPAN}>")
    met = found.where(F.size("seen") > 0).join(new, F.col("mark") == F.col("m"), "left").select("doc_id", "mark", "base", F.coalesce("added", none).alias("added"))
    return met.unionByName(found.where(F.size("seen") == 0).select("doc_id", "mark", "base", none.alias("added")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    The first counts and the digest are of the base spans; ``spans`` lists all as kind:start:end
    by start, then kind; n_added and n_spans count the method's and all. The cases that ``detect`` names hold.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    found = detect(docs, id_col, text_col)
    return found.select(
        "doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in brackets, e.g. [EMAIL].

    Overlapping spans make one, of the first's kind. All other columns and all rows stay.
    """
    key, mark, more_col = fresh(docs, "key", "mark", "added")
    added = detect(docs, id_col, text_col).where(F.size("added") > 0).select(F.col("mark").alias(mark), F.col("added").alias(more_col)).dropDuplicates([mark])
    added = materialise(added, "pii-added")
    # Few spans are broadcast, after they have been counted; with more the texts are shuffled.
    if (added.agg(F.sum(F.size(more_col))).first()[0] or 0) <= BROADCAST_ROWS:
        added = F.broadcast(added)
    names = docs.columns
    at = names.index(text_col)

    def masked(batches):
        claim("pii")
        for batch in batches:
            texts = []
            for value, more in zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True):
                text = value.as_py()
                if text is not None:
                    out, end = [], 0
                    for a, k, b in sorted([*base_spans(text), *((x["start"], x["kind"], x["end"]) for x in more or ())]):
                        if a >= end:
                            out += [text[end:a], f"[{KINDS[k].upper()}]"]
                        end = max(end, b)
                    text = "".join([*out, text[end:]])
                texts.append(text)
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    keyed = keyed.join(added, F.col(key) == F.col(mark), "left").select(*[F.col(f"`{c}`") for c in names], more_col)
    return keyed.mapInArrow(masked, docs.schema)
