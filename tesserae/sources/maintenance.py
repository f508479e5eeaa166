"""Upserts, deletes and rebuilds (S1-S14), each a lazy plan over the catalog's table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.catalog import Catalog, ingest
from tesserae.functions.scalars import normalized_path
from tesserae.operators.kinds import KINDS, UUID
from tesserae.operators.textsearch import Inverted, Text

#: Called with (stage, rows so far or None).
Progress = Callable[[str, int | None], None]


def _latest(rows: DataFrame) -> DataFrame:
    """One row a uid: that of the greatest rid, which was catalogued last; ties go by a hash of the row."""
    tie = F.xxhash64(*[F.col(c).cast("string") for c, kind in rows.dtypes if "map" not in kind])
    return rows.groupBy("uid").agg(F.max_by(F.struct(*rows.columns), F.struct("rid", tie)).alias("row")).select("row.*")


def _resolved(catalog: Catalog, objects: DataFrame) -> DataFrame:
    """The objects as the catalog's rows: one a uid, with the rid that they have there.

    A known uid keeps its rid. A new one takes its object's, unless another record has it;
    then it gets one of its own, a negative hash of the uid. What a unique value's row was
    found by before is kept in the index's flag, false for other rows.
    """
    new, held = _latest(ingest(objects, catalog.spec)), catalog.rows
    unique = [k for k in catalog.kinds.values() if isinstance(k, UUID)]
    ids = held.select(F.col("uid").alias("held_uid"), F.col("rid").alias("held_rid"), *[F.when(F.col(k.first), F.col(k.at)).alias(f"held_{k.first}") for k in unique])
    rows = new.join(ids, F.col("uid") == F.col("held_uid"), "left")
    taken = held.select(F.col("rid").alias("taken_rid"))
    rows = rows.join(taken, F.col("held_rid").isNull() & (F.col("rid") == F.col("taken_rid")), "left")
    # Of new uids that share a rid the first by name takes it.
    group = Window.partitionBy("rid", F.coalesce("held_rid", "rid")).orderBy(F.col("held_rid").isNotNull(), "uid")
    own = -(F.xxhash64("uid").bitwiseAND(F.lit((1 << 63) - 1))) - 1
    clash = F.col("taken_rid").isNotNull() | (F.row_number().over(group) > 1) | F.col("rid").isNull()
    rid = F.coalesce("held_rid", F.when(clash, own).otherwise(F.col("rid")))
    flags = {k.first: F.coalesce(F.col(f"held_{k.first}") == F.col(k.at), F.lit(False)) for k in unique}
    rows = rows.withColumn("resolved", rid).withColumns(flags)
    return rows.select(F.col("resolved").alias("rid"), *[c for c in held.columns if c != "rid"])


def _settled(catalog: Catalog, rows: DataFrame) -> Catalog:
    """A catalog of changed rows, in which every unique value finds one."""
    for k in catalog.kinds.values():
        if isinstance(k, UUID):
            rows = rows.withColumn(k.first, k.is_first(F.col(k.at), F.col(k.first)))
    return catalog.with_rows(rows.select(*catalog.rows.columns))


def upsert(catalog: Catalog, objects: DataFrame, idxs: Iterable[str] | None = None, update_metadata: bool = True) -> Catalog:
    """Catalog ``objects``; those whose uid is known replace what is held.

    A known uid keeps its rid, a new one never takes another record's. Of objects with the
    same uid the one of greatest rid counts. A unique value goes on finding the record that it
    found. With ``idxs`` only those indexes are applied to known objects, and metadata only
    with ``update_metadata``; new objects get everything.
    """
    new, held = _resolved(catalog, objects), catalog.rows
    if idxs is None and update_metadata:
        # All of a known record is replaced but its rid.
        kept = held.join(new.select("uid"), "uid", "left_anti").select(*held.columns)
        return _settled(catalog, kept.unionByName(new))
    wanted = set(catalog.spec.indexes if idxs is None else idxs)
    changed = {c for name in wanted for c in catalog.stored_columns(name)}
    if update_metadata:
        changed |= {f"m__{c}" for c in catalog.spec.columns}
    both = held.alias("h").join(new.alias("n"), F.col("h.uid") == F.col("n.uid"), "full_outer")
    known, given = F.col("h.uid").isNotNull(), F.col("n.uid").isNotNull()
    columns = [F.coalesce("h.rid", "n.rid").alias("rid"), F.coalesce("h.uid", "n.uid").alias("uid")]
    for c in held.columns[2:]:
        take = given & (F.lit(c in changed) | ~known)
        columns.append(F.when(take, F.col(f"n.`{c}`")).otherwise(F.col(f"h.`{c}`")).alias(c))
    return _settled(catalog, both.select(*columns))


def delete(catalog: Catalog, uids: DataFrame | Iterable[str]) -> Catalog:
    """Without the given uids; unknown ones don't matter."""
    if isinstance(uids, DataFrame):
        gone = uids.select(F.col(uids.columns[0]).cast("string").alias("uid"))
        return catalog.with_rows(catalog.rows.join(gone, "uid", "left_anti").select(*catalog.rows.columns))
    uids = list(uids)
    return catalog.with_rows(catalog.rows.where(~F.col("uid").isin(*uids)) if uids else catalog.rows)


def metadata_changes(catalog: Catalog, objects: DataFrame) -> DataFrame:
    """uids of known objects whose metadata differs, nulls being equal to each other."""
    names = [f"m__{c}" for c in catalog.spec.columns]
    new = ingest(objects, catalog.spec).select("uid", *[F.col(n).alias(f"n{i}") for i, n in enumerate(names)])
    differs = F.lit(False)
    for i, n in enumerate(names):
        differs = differs | ~F.col(n).eqNullSafe(F.col(f"n{i}"))
    return catalog.rows.join(new, "uid").where(differs).select("uid")


def reindex(catalog: Catalog, objects: DataFrame, names: Iterable[str]) -> Catalog:
    """Rebuild some indexes from ``objects``, metadata untouched."""
    for n in names:
        catalog.kind(n)
    known = objects.join(catalog.rows.select(F.col("uid").alias("__uid")), _uid(catalog, objects) == F.col("__uid"), "left_semi")
    return upsert(catalog, known, list(names), update_metadata=False)


def _uid(catalog: Catalog, objects: DataFrame) -> Column:
    from tesserae.plans.specs import column

    spec = catalog.spec
    return (column(spec.rid).cast("bigint").cast("string") if spec.uid is None else column(spec.uid).cast("string"))


def refresh(catalog: Catalog, objects: DataFrame, clear: bool = False) -> Catalog:
    """Catalog anew what is held, from ``objects`` (S10); with ``clear`` what isn't there goes."""
    known = objects.join(catalog.rows.select(F.col("uid").alias("__uid")), _uid(catalog, objects) == F.col("__uid"), "left_semi")
    return Catalog.of(known, catalog.spec, catalog.report) if clear else upsert(catalog, known)


def clear(catalog: Catalog) -> Catalog:
    return catalog.with_rows(catalog.rows.where(F.lit(False)))


def clear_index(catalog: Catalog, name: str) -> Catalog:
    """An index without entries; the records stay."""
    catalog.kind(name)
    rows, kinds = catalog.rows, dict(catalog.rows.dtypes)
    for c in catalog.stored_columns(name):
        rows = rows.withColumn(c, F.lit(False) if kinds[c] == "boolean" and c.count("__") > 1 else F.lit(None).cast(kinds[c]))
    return catalog.with_rows(rows)


def normalize_paths(catalog: Catalog, resolvable: DataFrame | None = None) -> Catalog:
    """uids as paths with single slashes; of those that become equal the smallest rid stays, and with
    ``resolvable`` (its first column) only those that it lists (S14)."""
    rows = catalog.rows.withColumn("uid", normalized_path(F.col("uid")))
    first = rows.groupBy("uid").agg(F.min("rid").alias("rid"))
    rows = rows.join(first, ["uid", "rid"], "left_semi")
    if resolvable is not None:
        paths = resolvable.select(F.col(resolvable.columns[0]).alias("uid"))
        rows = rows.join(paths, "uid", "left_semi")
    return catalog.with_rows(rows.select(*catalog.rows.columns))


def save(catalog: Catalog, path: str, progress: Progress | None = None, **options) -> Catalog:
    """Write the table as Parquet, sorted by uid within files, its text indexes beside it, and go on from there."""
    catalog.rows.sortWithinPartitions("uid").write.options(**options).mode("overwrite").parquet(path)
    saved = catalog.with_rows(catalog.rows.sparkSession.read.schema(catalog.rows.schema).parquet(path))
    if progress:
        progress("saved", saved.rows.count())
    for name, kind in catalog.kinds.items():
        if isinstance(kind, Text):
            kind.inverted(saved.rows).write.options(**options).mode("overwrite").parquet(_text_path(path, name))
            size = saved.rows.where(kind.indexed).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(kind.value)).alias("mean"))
            size.write.options(**options).mode("overwrite").parquet(_text_path(path, name) + "-size")
            if progress:
                progress(f"indexed {name}", None)
    return load(catalog.rows.sparkSession, path, catalog.spec, catalog.report)


def _text_path(path: str, name: str) -> str:
    return f"{path.rstrip('/')}-text/{name}"


def load(spark, path: str, spec, report=None) -> Catalog:
    """A saved catalog with its text indexes."""
    inverted = {}
    for name, index in spec.indexes.items():
        if issubclass(KINDS[index.kind], Text):
            size = spark.read.parquet(_text_path(path, name) + "-size").first()
            inverted[name] = Inverted(spark.read.parquet(_text_path(path, name)), size.n, size["mean"])
    return Catalog(spark.read.parquet(path), spec, report, inverted)
