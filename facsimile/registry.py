"""Named datasets (A10): snapshots in the shared folder, found again by what they hold.

A dataset is registered under a name.  Its rows are written once as Parquet under
``<root>/<name>/<digest>``; the digest covers the schema and the rows, so the same
content is never written twice and a changed source gets a snapshot of its own.  A temp
view of the name reads the snapshot.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions.names import named
from facsimile.session import checkpoint_dir


@dataclass(frozen=True)
class Snapshot:
    name: str
    digest: str
    path: str
    rows: int
    reused: bool        # True if the snapshot was there already


def content_digest(df: DataFrame) -> tuple[str, int]:
    """(digest, rows): the same for the same schema and rows in any order and partitioning.

    Two 64-bit hashes of every row are added up, as numbers no row count overflows; one aggregate.
    """
    cols = [F.to_json(named(f.name)).alias(f.name) if f.dataType.typeName() == "map" else named(f.name) for f in df.schema.fields]
    h = [F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols]).cast("decimal(38,0)") for seed in (1, 2)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"h{i}") for i, x in enumerate(h)]).first()
    text = f"{df.schema.jsonValue()}|{r['n']}|{r['h0']}|{r['h1']}"
    return hashlib.sha256(text.encode()).hexdigest()[:32], r["n"]


def view_name(name: str) -> str:
    """A name a temp view can have: letters, digits and underscores."""
    plain = re.sub(r"\W+", "_", name).strip("_") or "dataset"
    return plain if not plain[0].isdigit() else f"_{plain}"


class Registry:
    """Datasets by name under ``root`` (by default in the folder that ``spark.checkpoint.dir`` names)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{checkpoint_dir(spark).rstrip('/')}/facsimile-datasets").rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _is_whole(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def register(self, name: str, df: DataFrame) -> Snapshot:
        """Write the dataset unless a whole snapshot of the same content is there, and point the name's view at it.

        A write that a lost driver left unfinished has no success mark and is done again.
        """
        digest, rows = content_digest(df)
        path = f"{self.root}/{view_name(name)}/{digest}"
        found = self._is_whole(path)
        if not found:
            df.write.mode("overwrite").parquet(path)
        self.spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(view_name(name))
        return Snapshot(name, digest, path, rows, found)

    def get(self, name: str, digest: str | None = None) -> DataFrame:
        """The dataset registered last under the name, or the snapshot of a digest."""
        if digest is None:
            found = self.snapshots(name)
            if not found:
                raise KeyError(f"no dataset {name!r}")
            digest = found[-1][0]
        path = f"{self.root}/{view_name(name)}/{digest}"
        if not self._is_whole(path):
            raise KeyError(f"no snapshot {digest} of {name!r}")
        return self.spark.read.parquet(path)

    def snapshots(self, name: str) -> list[tuple[str, int]]:
        """(digest, time written) of the name's whole snapshots, the oldest first."""
        fs, p = self._fs(f"{self.root}/{view_name(name)}")
        if not fs.exists(p):
            return []
        own = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
        out = []
        for digest, path in own:
            if self._is_whole(path):
                mark, at = self._fs(f"{path}/_SUCCESS")
                out.append((digest, mark.getFileStatus(at).getModificationTime()))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
