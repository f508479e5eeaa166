"""A stream of changed objects, applied batch by batch.

Each micro-batch is upserted into a versioned table. When version n is complete, those before
n - 1 go; the one before stays, so a batch that is run again after a failure starts from the
same table and gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.catalog import Catalog
from tesserae.plans.specs import CatalogSpec
from tesserae.sources import maintenance


class CatalogSink:
    """``foreachBatch`` target: ``stream.writeStream.foreachBatch(CatalogSink(path, spec))``.

    ``deleted`` names a boolean column of the objects that marks deletions; ``order`` one
    by which the last change of a uid within a batch counts.
    """

    def __init__(self, path: str, spec: CatalogSpec, deleted: str | None = None, order: str | None = None):
        self.path, self.spec, self.deleted, self.order = path.rstrip("/"), spec, deleted, order

    def version(self, n: int) -> str:
        return f"{self.path}/v={n}"

    def current(self, spark, before: int | None = None) -> Catalog | None:
        """The newest complete version, older than batch ``before``."""
        done = [n for n in self._complete(spark)[1] if before is None or n < before]
        return Catalog(spark.read.parquet(self.version(max(done))), self.spec) if done else None

    def _complete(self, spark):
        """The table's file system and its complete versions."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        return fs, sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.order:
            uid = maintenance._uid(Catalog.of(batch, self.spec), batch)
            last = batch.groupBy(uid.alias("__uid")).agg(F.max_by(F.struct(*batch.columns), self.order).alias("row"))
            batch = last.select("row.*")
        held = self.current(spark, before=batch_id)
        changed = batch.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else batch
        new = maintenance.upsert(held, changed) if held else Catalog.of(changed, self.spec)
        if self.deleted and held:
            gone = Catalog.of(batch.where(F.col(self.deleted)), self.spec).rows.select("uid")
            new = maintenance.delete(new, gone)
        new.rows.write.mode("overwrite").parquet(self.version(batch_id))
        fs, done = self._complete(spark)
        for n in [n for n in done if n < batch_id][:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(self.version(n)), True)
