"""Materialized projections: created, incrementally refreshed, dropped, catalogued.

A projection is a Parquet copy of some columns of a source, its files sorted by the
scalar (grouping) columns and the order key, so that row-group bounds prune both. The
catalog is one small JSON folder a projection and a source, under the catalog's root; a
refresh without order key writes a new version beside the old one and then points the
catalog entry to it. A refreshed projection is a view under its own name.

Names are not case-sensitive. Rows whose order key is null are in a projection too: as
no bound tells new ones, a refresh that finds another number of them in the source than
in the projection writes a new version.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import in_ranges, write_counted


#: Version of a projection that a stream fills.
STREAMED = "streamed"


@dataclass(frozen=True)
class Projection:
    name: str
    source: str
    vector_columns: tuple[str, ...]
    scalar_columns: tuple[str, ...] = ()
    order_by: str | None = None
    #: Folder under the root that holds the data; None before the first refresh.
    version: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return self.scalar_columns + self.vector_columns


class Catalog:
    """Sources (Parquet paths by name) and their projections, kept under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.sources: dict[str, str] = {}
        #: Sources as they were registered.
        self.views: dict[str, DataFrame] = {}
        self.projections: dict[str, Projection] = {}
        #: Counts changes of sources and projections, refreshes among them.
        self.generation = 0
        self._load()

    # The catalog's files go through Hadoop's file systems, like the data.

    def _path(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _lines(self, folder: str) -> list[dict]:
        files, path = self._path(folder)
        if not files.exists(path) or not len(files.listStatus(path)):
            return []
        return [json.loads(row["value"]) for row in self.spark.read.text(f"{self.root}/{folder}/*").collect()]

    def _write_line(self, folder: str, name: str, value: dict) -> None:
        line = self.spark.createDataFrame([(json.dumps(value),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.root}/{folder}/{name}")
        self.generation += 1

    def _load(self) -> None:
        for found in self._lines("_sources"):
            self.sources[found["name"]] = found["path"]
            self._show(found["name"])
        for found in self._lines("_catalog"):
            own = Projection(**found | {k: tuple(found[k]) for k in ("vector_columns", "scalar_columns")})
            self.projections[own.name] = own
            if own.version:
                self.read(own.name).createOrReplaceTempView(own.name)

    def _store(self, projection: Projection) -> Projection:
        self._write_line("_catalog", projection.name, asdict(projection))
        self.projections[projection.name] = projection
        return projection

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.sources[name.lower()])

    def register_source(self, name: str, path: str) -> DataFrame:
        """Names a Parquet table; it becomes a temporary view of the session."""
        name = name.lower()
        self.sources[name] = path
        self._write_line("_sources", name, {"name": name, "path": path})
        return self._show(name)

    def _show(self, name: str) -> DataFrame:
        rows = self.views[name] = self.source(name)
        rows.createOrReplaceTempView(name)
        return rows

    def create_projection(self, name: str, source: str, vector_columns, scalar_columns=(), order_by: str | None = None) -> Projection:
        name, source = name.lower(), source.lower()
        if name in self.projections or name in self.sources:
            raise ValueError(f"{name} exists")
        if source not in self.sources:
            raise ValueError(f"no source {source}")
        known = self.spark.read.parquet(self.sources[source]).columns
        missing = [c for c in (*vector_columns, *scalar_columns) if c not in known]
        if missing:
            raise ValueError(f"no such columns in {source}: {', '.join(missing)}")
        if order_by is not None and order_by not in vector_columns:
            raise ValueError("the order key must be one of the vector columns")
        if set(vector_columns) & set(scalar_columns):
            raise ValueError("a column is either a vector or a scalar column")
        return self._store(Projection(name, source, tuple(vector_columns), tuple(scalar_columns), order_by))

    def data_path(self, name: str) -> str:
        own = self.projections[name.lower()]
        if own.version is None:
            raise ValueError(f"projection {own.name} has not been refreshed")
        return f"{self.root}/{own.name}/{own.version}"

    def read(self, name: str) -> DataFrame:
        own = self.projections[name.lower()]
        schema = self.source(own.source).select(*own.columns).schema if own.source in self.sources else None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.data_path(name))

    def refresh(self, name: str) -> int:
        """Appends the source's rows whose order key is greater than any in the
        projection; without order key, or where the rows with a null key are not the same
        number, replaces its rows. Returns the rows written."""
        own = self.projections[name.lower()]
        if own.version == STREAMED:
            raise ValueError(f"projection {own.name} is refreshed as a stream")
        # The source's view lists its files again too, so both show the same rows.
        rows = self._show(own.source).select(*own.columns)
        number = int(own.version[1:]) if own.version else 0
        version = f"v{number + 1}"
        if own.order_by and own.version:
            # The greatest key comes from the footers' bounds where its type has them.
            key = F.col(own.order_by)
            last = self.read(name).agg(F.max(key).alias("last")).first()["last"]
            lost = [df.where(key.isNull()).count() for df in (rows, self.read(name))]
            if lost[0] == lost[1]:
                version = own.version
                rows = rows.where(key > F.lit(last) if last is not None else key.isNotNull())
        sort = [*own.scalar_columns, *([own.order_by] if own.order_by else [])]
        if sort:
            # Scalar columns have few values; rows of files come in a fixed order.
            rows = in_ranges(rows, sort, F.monotonically_increasing_id())
        written = write_counted(rows, f"{self.root}/{own.name}/{version}")
        self.generation += 1
        if version != own.version:
            self._store(replace(own, version=version))
            if own.version:
                self._delete(own.name, own.version)
        self.read(name).createOrReplaceTempView(own.name)
        return written

    def drop_projection(self, name: str) -> None:
        name = name.lower()
        del self.projections[name]
        self.generation += 1
        self.spark.catalog.dropTempView(name)
        self._delete("_catalog", name)
        self._delete(name)

    def _delete(self, *parts: str) -> None:
        files, path = self._path(*parts)
        files.delete(path, True)
