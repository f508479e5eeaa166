"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. With a and b
elements, two sets are similar enough exactly if their symmetric difference D has
``(num + den) * D <= (den - num) * (a + b)``: for 0.9, ``19 * D <= a + b``.

A set's parity sketch has 2**32 bits: a bit is 1 if an odd number of elements is hashed to
it. It is kept sparse (the upper halves of the hashes are the bits' positions) and used in two
ways. Neither can differ in more places than the sets do:

* in segments. A scheme serves the sets of one size band and the somewhat larger ones that a
  set of the band can be similar to. It knows the largest D that a link can have, d, and
  cuts the sketch into d + 1 + z segments. By the pigeonhole principle linked sets agree in
  z + 1 of them at least. Segments without bits make no keys, or they would gather unrelated
  sets; z is chosen so that few sets have more than z of those. Sets that do are cut up
  again by other positions, so two of them meet there;
* folded to two bits or more an element, to tell unrelated sets apart.

Sets that agree in a segment meet in its bucket.

* Star round: members meet the bucket's first member only. Pairs whose folded sketches are
  near enough are verified on the sets; components follow. A key that many sets of one
  batch share goes to its bucket once for the batch, so a hot key is small before the shuffle.
* Rest: buckets whose members are still in several components are compared by folded sketch
  inside the task, blocks of ``BLOCK`` members at a time; of buckets with the same members one
  is. A task gives links that span what it holds, one fewer than its members at most.
* Doubt: where verification refutes such a link, others may have been left out for it, but
  only between components that refuted links join. The nodes of these, each once, are compared
  in the same way, refuted pairs left out, until nothing is left.

Nothing is left out: no cap on buckets, partners or candidates. Equal sets are one node,
so copies are never expanded into pairs. Sets are shipped for verification only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import claim, fresh, holds, materialise, narrowed, without
from tesserae.llm.graph import components

#: Members of a bucket that are compared in one task at a time.
BLOCK = 2048
#: Words whose hashes a worker keeps.
MAX_WORDS = 150_000
#: Bits of the filter of texts whose sets are wanted: for each text, and at most (32 MB). A
#: full filter costs sets that aren't needed, never a link.
FILTER_EACH, FILTER_BITS = 16, 1 << 28
#: Bits of the filter that one row holds.
FILTER_ROW = 1 << 17
#: Bits of a folded sketch: at least, at most, and for an element.
SKETCH_BITS, SKETCH_EACH = (256, 1 << 20), 2
#: Growth of the size bands; divisions into segments that are tried before empty ones count.
GROWTH, LEVELS = 1.5, 8
#: Keys that a task gathers before it writes them, and how many sets of these make one hot.
GATHERED, HOT = 200_000, 16
#: Nodes that a task remembers, and the bits of a bucket's key that are shuffled.
MAX_SEEN = 100_000

U = np.uint64
KEY_MASK = U((1 << 48) - 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
holds("jaccard", _hashes.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles of a whole text.

    Words are the runs without white space, A-Z in lower case. A text of fewer words has
    its whole sequence as its one shingle; without words the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.array(list(map(_hashes.__getitem__, words)), dtype=U)
    n, k = max(1, len(h) - width + 1), min(width, len(h))
    out = np.full(n, k, U)
    for i in range(k):
        out = _mix(out + h[i : i + n])
    return np.unique(out)


class Schemes:
    """Size bands, and how their sketches are cut up, for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
        self.low = np.array(low)
        self.cuts: dict[int, tuple[int, int]] = {}

    def difference(self, scheme: int) -> int:
        """The largest symmetric difference of a link that the scheme serves."""
        top = int(self.low[scheme + 1]) - 1
        return (self.den - self.num) * (top + top * self.den // self.num) // (self.den + self.num)

    def cut(self, scheme: int) -> tuple[int, int]:
        """(segments, z): linked sets agree in z + 1 segments at least."""
        if scheme not in self.cuts:
            need, least, z = self.difference(scheme) + 1, int(self.low[scheme]), 0
            while need > 1 and z < need:
                empty = (need + z) * float(np.exp(-least / (need + z)))
                more = int(np.ceil(empty + 2 * empty**0.5)) if empty > 0.02 else 0
                if more <= z:
                    break
                z = min(more, need)
            self.cuts[scheme] = need + z, z
        return self.cuts[scheme]

    def of(self, size: int) -> list[int]:
        """The schemes that serve a set: its band's, and lower ones with sets that it can be similar to."""
        own = int(np.searchsorted(self.low, size, "right")) - 1
        out, scheme = [own], own - 1
        while scheme >= 0 and (int(self.low[scheme + 1]) - 1) * self.den // self.num >= size:
            out.append(scheme)
            scheme -= 1
        return out

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """Bucket keys of a set of sorted elements, one for each segment that has bits.

        With more than z segments empty, the set is cut up again by other positions; the last
        division, which practically none reaches, keeps all its segments.
        """
        out = []
        for scheme in self.of(len(elements)):
            m, z = self.cut(scheme)
            for level in range(LEVELS):
                at = (np.sort(_mix(elements ^ U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) if level else elements) >> U(32)
                segment = at * U(m) >> U(32)
                starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
                bits, segment = np.bitwise_xor.reduceat(_mix(at), starts), segment[starts]
                some = bits != 0
                enough = m - int(np.count_nonzero(some)) <= z
                if enough or level < LEVELS - 1:
                    bits, segment = bits[some], segment[some]
                else:
                    full = np.zeros(m, U)
                    full[segment.astype(np.int64)] = bits
                    bits, segment = full, np.arange(m, dtype=U)
                out.append(_mix(bits + _mix(segment * U(0x9E3779B97F4A7C15) + U(1000 * level + scheme + 1))))
                if enough:
                    break
        return np.concatenate(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The parity sketch folded to ``SKETCH_EACH`` bits an element or more, a power of two wide."""
    bits = SKETCH_BITS[0]
    while bits < SKETCH_EACH * len(elements) and bits < SKETCH_BITS[1]:
        bits *= 2
    at = elements >> U(32) & U(bits - 1)
    words = np.zeros(bits // 64, U)
    np.bitwise_xor.at(words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return words


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """The sketch of the same set ``width`` words wide: the parity of bits that now fall together."""
    return np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)


def _node(elements: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(elements.tobytes())
    return x - (x >> 63 << 64)


DOCUMENTS = "doc_id long, mark long, n long, node long, sketch binary, keys array<long>, hot array<struct<key:long,pivot:long>>"


def _documents(width: int, schemes: Schemes):
    """(doc_id, mark, text) -> DOCUMENTS; node is null for an empty set.

    Sketch and keys are given once while a task remembers the node. Of a key that ``HOT``
    nodes of those gathered share, only the first is in ``keys``; the others, and that one
    as well, have it in ``hot`` with the first as pivot.
    """

    def written(rows):
        lengths = np.array([len(r[5]) for r in rows])
        keys = np.concatenate([r[5] for r in rows]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        nodes = np.repeat(np.array([r[3] or 0 for r in rows], np.int64), lengths)
        order = np.lexsort((nodes, keys))
        k, v = keys[order], nodes[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(k)))
        many = np.repeat(counts >= HOT, counts)
        pivots = np.repeat(v[starts], counts)
        hot, plain, pivot = np.zeros(len(k), bool), np.ones(len(k), bool), np.zeros(len(k), np.int64)
        hot[order], plain[order], pivot[order] = many, ~many | (v == pivots), pivots
        ends = lambda chosen: np.concatenate([[0], np.cumsum(chosen)])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(keys[hot]), pa.array(pivot[hot])], names=["key", "pivot"])
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        columns += [pa.ListArray.from_arrays(pa.array(ends(plain)), pa.array(keys[plain])), pa.ListArray.from_arrays(pa.array(ends(hot)), struct)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "node", "sketch", "keys", "hot"])

    def run(batches):
        claim("jaccard")
        seen: set[int] = set()
        rows, held, none = [], 0, np.zeros(0, U)
        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py() or b"", width)
                node = _node(s) if len(s) else None
                bits, keys = None, none
                if node is not None and node not in seen:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(node)
                    bits, keys = sketch(s).tobytes(), schemes.keys(s) & KEY_MASK
                rows.append((doc_id, mark, len(s), node, bits, keys))
                held += len(keys)
                if held >= GATHERED or len(rows) >= GATHERED // 10:
                    yield written(rows)
                    rows, held = [], 0
        if rows:
            yield written(rows)
        _hashes.clear()

    return run


def _columns(**arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays.values()], names=list(arrays))


def _shared_buckets(batches):
    """Sorted (key, node) -> (key, node, pivot) of keys with two nodes at least, in constant memory."""
    key = pivot = None
    alone = False  # the pivot's own row is still to be given
    for batch in batches:
        k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(k):
            continue
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        fresh = first.copy()
        fresh[1:] |= v[1:] != v[:-1]
        if k[0] == key:
            first[0] = False
            fresh[0] = v[0] != last
        last = v[-1]
        group = np.cumsum(first)  # 0: goes on from the batch before
        starts = np.flatnonzero(first)
        pivots = np.concatenate([[pivot if pivot is not None else 0], v[starts]])[group]
        others = fresh & (v != pivots)
        many = np.bincount(group, weights=others, minlength=len(starts) + 1) > 0
        out = others | (first & many[group])
        ks, vs, ps = k[out], v[out], pivots[out]
        if alone and many[0]:
            ks, vs, ps = (np.concatenate([[x], y]) for x, y in ((key, ks), (pivot, vs), (pivot, ps)))
        alone = not many[-1] if len(starts) else alone and not many[0]
        key, pivot = k[-1], pivots[-1]
        if len(ks):
            yield _columns(key=ks, node=vs, pivot=ps)


def _near(num: int, den: int):
    """Pairs with sizes and sketches -> the pairs that sketches can't exclude."""

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                w = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum())
                keep.append((num + den) * apart <= (den - num) * (na + nb))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


GROUP = "key long, block int, other int, kind int, node long, component long, side int, n long, sketch binary"


def _links_within(held: list, refuted: set, num: int, den: int, each: int | None) -> list[tuple[int, int]]:
    """Pairs of one group's members that sketches can't exclude, not refuted, in different components.

    ``held`` has (node, component, side, n, sketch); with both sides there, only pairs of
    different sides count. With ``each`` None a pair joins its components at once, so the pairs
    span what they join; else every member gives up to ``each`` pairs.
    """
    if len(held) < 2:
        return []
    held = sorted(held)
    nodes, comps, sides, sizes = (np.array([h[i] for h in held]) for i in range(4))
    width = min(len(h[4]) for h in held) // 8
    bits = np.stack([fold(np.frombuffer(h[4], U), width) for h in held])
    two = len(set(sides.tolist())) > 1
    out, now = [], comps.copy()
    for i in range(len(held) - 1):
        later = slice(i + 1, None)
        ok = (now[later] != now[i]) & (nodes[later] != nodes[i])
        ok &= den * np.minimum(sizes[later], sizes[i]) >= num * np.maximum(sizes[later], sizes[i])
        if two:
            ok &= sides[later] != sides[i]
        js = np.flatnonzero(ok) + i + 1
        if not len(js):
            continue
        apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
        js = js[(num + den) * apart <= (den - num) * (sizes[js] + sizes[i])]
        given = 0
        for j in js.tolist():
            if now[j] == now[i] or (int(nodes[i]), int(nodes[j])) in refuted:
                continue
            out.append((int(nodes[i]), int(nodes[j])))
            if each is None:
                now[now == now[j]] = now[i]
            else:
                given += 1
                if given >= each:
                    break
    return out


def _inside(num: int, den: int, each: int | None):
    """Sorted rows of GROUP -> candidate links (key, block, other, a, b). Rows of kind 0 are refuted pairs (node, component)."""

    def run(batches):
        claim("jaccard")
        now, held, refuted = None, [], set()
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    found += [(*now, *p) for p in _links_within(held, refuted, num, den, each)] if now else []
                    now, held, refuted = row[:3], [], set()
                if row[3]:
                    held.append(row[4:])
                else:
                    refuted.add(row[4:6])
            if found:
                yield _candidates(found)
        found = [(*now, *p) for p in _links_within(held, refuted, num, den, each)] if now else []
        if found:
            yield _candidates(found)

    return run


def _candidates(found: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["key", "block", "other", "a", "b"])


def _filter_rows(batches):
    """Sorted (row, bit) -> (row, bytes of FILTER_ROW bits)."""
    now, bits = None, None
    for batch in batches:
        rows, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for row in np.unique(rows).tolist():
            if row != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["row", "bits"])
                now, bits = row, np.zeros(FILTER_ROW, bool)
            bits[at[rows == row]] = True
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["row", "bits"])


def _filter_of(marks: DataFrame) -> np.ndarray:
    """A bit for the hash of every mark, ``FILTER_EACH`` bits a mark; FILTER_BITS / 8 bytes reach the driver at most."""
    n, bits = marks.count(), FILTER_ROW
    while bits < FILTER_EACH * n and bits < FILTER_BITS:
        bits *= 2
    at = F.col("mark").bitwiseAND(F.lit(bits - 1))
    rows = marks.select(F.floor(at / FILTER_ROW).alias("row"), F.pmod(at, F.lit(FILTER_ROW)).alias("bit"))
    rows = rows.repartition("row").sortWithinPartitions("row").mapInArrow(_filter_rows, "row long, bits binary")
    out = np.zeros((bits // FILTER_ROW, FILTER_ROW // 8), np.uint8)
    for row, data in rows.collect():
        out[row] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def _wanted(width: int, held):
    """(mark, text) -> (node, n, elements) of the texts in the filter; others aren't read."""

    def run(batches):
        claim("jaccard")
        bits = held.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & (len(bits) * 8 - 1)
            some = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            nodes, sizes, sets = [], [], []
            for i in some.tolist():
                s = shingle_set(batch.column(1)[i].as_py() or b"", width)
                if len(s):
                    nodes.append(_node(s))
                    sizes.append(len(s))
                    sets.append(s.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "elements"])

    return run


def _both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b, ...) with the columns of both nodes."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(end), *[F.col(c).alias(c + end) for c in columns]), end)
    return pairs


class _Sets:
    """Verification: the sets of the nodes that pairs ask for, read from the texts when they are first needed."""

    def __init__(self, rows: DataFrame, found: DataFrame, width: int, num: int, den: int):
        self.rows, self.found, self.width, self.num, self.den, self.held = rows, found, width, num, den, None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) with ``linked``, whether the sets are similar enough."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.held is not None:
            nodes = nodes.join(self.held.select("node"), "node", "left_anti")
        # Any text of a node gives its set.
        marks = materialise(self.found.select("node", "mark").join(nodes, "node").groupBy("node").agg(F.min("mark").alias("mark")), "wanted")
        if not marks.isEmpty():
            bits = self.rows.sparkSession.sparkContext.broadcast(_filter_of(marks))
            more = self.rows.select("mark", "text").mapInArrow(_wanted(self.width, bits), "node long, n long, elements array<long>")
            more = materialise(more.join(marks.select("node"), "node", "left_semi").dropDuplicates(["node"]), "elements")
            self.held = more if self.held is None else self.held.unionByName(more)
        if self.held is None:
            return pairs.select("a", "b", F.lit(True).alias("linked")).limit(0)
        pair = _both(pairs.select("a", "b").distinct(), self.held, "n", "elements")
        inter = F.size(F.array_intersect("elementsa", "elementsb"))
        return materialise(pair.select("a", "b", (self.den * inter >= self.num * (F.col("na") + F.col("nb") - inter)).alias("linked")), "links")


def _dealt(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """(key, block, other, side, node) of the buckets with members in several components.

    ``buckets`` has distinct (key, node). Of buckets with the same members one stays. Of a
    bucket beyond ``BLOCK`` members, its largest component's members aren't compared with
    each other: blocks of the others meet all blocks, its own meet those only.
    """
    each = buckets.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = each.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"))
    mixed = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("members"), F.bit_xor("same").alias("same"), F.max(F.struct("n", "component")).alias("largest")).where("components > 1")
    mixed = mixed.groupBy("same", "members").agg(F.min("key").alias("key"), F.first("largest").alias("largest"))
    large = F.col("members") > BLOCK
    rest = F.when(large, F.col("members") - F.col("largest.n")).otherwise(F.col("members"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", blocks(rest).alias("rest"), F.when(large, blocks(F.col("largest.n"))).otherwise(0).alias("own"), F.when(large, F.col("largest.component")).alias("largest"))
    rows = each.join(mixed, "key")
    inner = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    # Keys above tell a bucket's rows apart already; the block comes from other bits of the node.
    spot = F.xxhash64("node", F.lit(1))
    block = F.when(inner, F.col("rest") + F.pmod(spot, F.col("own"))).otherwise(F.pmod(spot, F.col("rest"))).cast("int")
    others = F.when(inner, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("own") - 1))
    rows = rows.select("key", "node", block.alias("block"), F.explode(others).alias("other"))
    return rows.select("key", F.least("block", "other").alias("block"), F.greatest("block", "other").alias("other"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node")


def _compared(dealt: DataFrame, label: DataFrame, sketches: DataFrame, num: int, den: int, each: int | None, refuted: DataFrame | None = None) -> DataFrame:
    """Candidate links (key, block, other, a, b) of dealt groups; with ``refuted``, of the groups that hold some."""
    group = dealt if refuted is None else dealt.join(refuted.select("key", "block", "other").distinct(), ["key", "block", "other"], "left_semi")
    group = group.join(label, "node", "left").join(sketches, "node")
    group = group.select("key", "block", "other", F.lit(1).alias("kind"), "node", F.coalesce("component", "node").alias("component"), "side", "n", "sketch")
    if refuted is not None:
        known = refuted.select("key", "block", "other", F.lit(0).alias("kind"), F.col("a").alias("node"), F.col("b").alias("component"))
        group = group.unionByName(known, allowMissingColumns=True)
    group = group.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "kind")
    return materialise(group.mapInArrow(_inside(num, den, each), "key long, block int, other int, a long, b long"), "candidates")


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """Components of what ``label`` joins already and more links (a, b)."""
    return components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "components")


def _in_doubt(label: DataFrame, refuted: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, node): the nodes of components that refuted links (a, b) join; key is the smallest of these components."""
    of = label.select(F.col("node").alias("x"), F.col("component").alias("c"))
    ends = refuted.select("a", "b").distinct()
    for end in ("a", "b"):
        ends = ends.join(of, F.col(end) == F.col("x"), "left").withColumn(end, F.coalesce("c", end)).drop("x", "c")
    joined = components(ends, "doubt").select(F.col("node").alias("of"), F.col("component").alias("key"))
    joined = joined.unionByName(joined.select(F.col("key").alias("of"), "key").distinct())
    nodes = sketches.select("node").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("of"))
    return nodes.join(joined, "of").select("key", "node")


def link(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num / den or more.

    Returns one row per document: doc_id, n_shingles and component_id, the smallest
    doc_id reachable by links, itself included. Null and empty texts, and those of white
    space alone, have 0 shingles and no links. Repeated rows have equal sets and so are
    linked; a null id never names a component that holds another id. An empty table gives
    no rows. Other columns are ignored.
    """
    schemes = Schemes(num, den)
    rows = narrowed(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary"))
    found = materialise(rows.mapInArrow(_documents(width, schemes), DOCUMENTS), "sets")

    keyed = found.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    shared = keyed.mapInArrow(_shared_buckets, "key long, node long, pivot long")
    hot = found.select(F.explode("hot").alias("h"), "node").select("h.key", "node", "h.pivot")
    buckets = materialise(shared.unionByName(hot), "buckets")
    met = buckets.select("node").distinct()
    sketches = materialise(found.where("sketch is not null").join(met, "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")
    sets = _Sets(rows, found, width, num, den)

    star = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = _both(star, sketches, "n", "sketch").select("a", "b", "na", "nb", "sketcha", "sketchb")
    near = materialise(star.mapInArrow(_near(num, den), "a long, b long"), "near")
    label = components(sets.verified(near).where("linked").select("a", "b"), "star-components")

    def compared(dealt, label, each=None, refuted=None):
        """(label, refuted links; None if there were no candidates) after one comparison of dealt groups."""
        candidates = _compared(dealt, label, sketches, num, den, each, refuted)
        if candidates.isEmpty():
            return label, None
        judged = sets.verified(candidates)
        wrong = materialise(candidates.join(judged.where("not linked").select("a", "b"), ["a", "b"], "left_semi").select(candidates.columns), "refuted")
        return _joined(label, judged.where("linked").select("a", "b")), wrong

    label, wrong = compared(_dealt(buckets.select("key", "node").distinct(), label), label)
    if wrong is not None and not wrong.isEmpty():
        doubt = materialise(_dealt(_in_doubt(label, wrong, sketches), label), "doubt")
        label, refuted = compared(doubt, label)
        each = 4
        # Groups without refuted links are done; the others end when no candidate is left.
        while wrong is not None and refuted is not None and not refuted.isEmpty():
            label, wrong = compared(doubt, label, each, refuted)
            if wrong is not None:
                refuted, each = materialise(refuted.unionByName(wrong), "refuted"), 8 * each

    own = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    own = own.join(label, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    lowest = own.groupBy("component").agg(F.min("low").alias("component_id"))
    named = own.join(lowest, "component").select("node", "component_id")
    out = found.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component; of repeated rows one stays.

    All columns stay as they are. Rows without an id stay unless all of those are linked to
    documents that have one; of rows that share an id all texts stay if one names its component.
    """
    linked = materialise(link(docs, width, num, den, id_col, text_col), "linked")
    gone_id, again_id = fresh(docs, "gone", "again")
    names_it = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = linked.groupBy("doc_id").agg(F.bool_or(names_it).alias("stays"), F.count(F.lit(1)).alias("rows"))
    gone = materialise(ids.where("not stays").select(F.col("doc_id").alias(gone_id)), "copies")
    kept = without(docs, gone, docs[id_col].cast("long").eqNullSafe(F.col(gone_id)))
    again = ids.where("stays and rows > 1 and doc_id is not null").select(F.col("doc_id").alias(again_id))
    if again.isEmpty():
        return kept
    # Only rows of repeated ids are compared with each other.
    repeated = F.col(id_col).cast("long") == F.col(again_id)
    return kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated, "left_semi").dropDuplicates([id_col, text_col]))
