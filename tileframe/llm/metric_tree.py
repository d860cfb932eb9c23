"""Exact top-k inner products by best-first search of M-trees.

Vectors become integers floor(scale * x). Rows are dealt to shards of about
``SHARD_ROWS``; a shard's task gets its rows once, loads them in bulk into one M-tree of
pages (routing objects with covering radii and distances to their parents, leaf pages
with distances of the entries to their routing object) and then searches it for one
block of ``QUERY_ROWS`` queries after the other (a stated query set against all rows, in
blocks). Only blocks are copied, one to each shard.

With Euclidean distance d, <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so a lower
bound of the distance is an upper bound of the score. The bound of a page is
d(q, routing object) - radius, that of a page or an entry whose distance has not
been computed |d(q, parent) - d(object, parent)|: where it cannot reach the k-th
best score so far, no distance is computed. Bounds and k-th scores are each query's own:
every query first goes down to one leaf page, then to the pages it may need from its
best one on, twice as many in each round, until its next page's bound is below its k-th
score. What queries ask of the same page in a round is computed together. Ties at the k-th score are kept, so that
the smaller id wins. ``search`` counts pages and distances that were spared.

Defined cases: vectors that are null or hold null or non-finite components take no part;
an empty vector scores 0 with all; vectors of different lengths are filled up with zeros;
rows that repeat an id are queries and candidates each, only a query's own row is no
candidate of it; a row with a null id is a candidate, last among ties, and no query; with
fewer than k other rows all are returned; an empty table gives an empty result; scores are
exact as long as they fit a long; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 64
TOP = 20
EVERY = 20
SHARD_ROWS = 8192
QUERY_ROWS = 512
PAGE_ROWS = 64
FANOUT = 8
#: Added to bounds, for rounding of distances (scores are whole numbers).
SLACK = 1e-3


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, vec (array<bigint>) of the rows that take part; ``row`` tells rows
    apart once the result has been written."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    valid = table.filter(F.col("embedding").isNotNull() & finite)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return valid.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def _matrix(column):
    """Matrix of a list column, short vectors filled up with zeros."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def build_tree(vectors) -> dict:
    """Arrays of an M-tree, loaded in bulk. ``rows`` is the order in which a leaf page is a
    slice; nodes: ``first``, ``last`` (child nodes, or places of a leaf), ``is_leaf``,
    ``center`` (place of the routing object), ``radius``, ``to_parent``, ``norm`` (largest in
    the page)."""
    import numpy as np

    points = vectors.astype(np.float64)
    norms = np.sqrt((points**2).sum(1))
    nodes: list[list] = []
    order: list = []
    near: list = []

    def split(rows, routing):
        """Groups of rows around routing objects far from each other."""
        chosen, gap = [routing], np.linalg.norm(points[rows] - points[routing], axis=1)
        owner = np.zeros(len(rows), np.int64)
        for k in range(1, FANOUT):
            far = int(gap.argmax())
            if gap[far] <= 0:
                break
            chosen.append(rows[far])
            away = np.linalg.norm(points[rows] - points[rows[far]], axis=1)
            owner[away < gap] = k
            gap = np.minimum(gap, away)
        return [(c, rows[owner == k]) for k, c in enumerate(chosen)]

    pending = [(0, np.arange(len(vectors)), None)]
    nodes.append([0, 0, False, 0, 0.0, 0.0, 0.0])
    while pending:  # breadth first: the children of a node are neighbours
        at, rows, parent = pending.pop(0)
        center = nodes[at][3]
        away = np.linalg.norm(points[rows] - points[center], axis=1)
        nodes[at][4], nodes[at][6] = float(away.max()), float(norms[rows].max())
        nodes[at][5] = float(np.linalg.norm(points[center] - points[parent])) if parent is not None else 0.0
        if len(rows) <= PAGE_ROWS or away.max() == 0:
            start = sum(map(len, order))
            order.append(rows)
            near.append(away)
            nodes[at][:3] = [start, start + len(rows), True]
            continue
        groups = split(rows, center)
        nodes[at][:2] = [len(nodes), len(nodes) + len(groups)]
        for routing, own in groups:
            pending.append((len(nodes), own, center))
            nodes.append([0, 0, False, int(routing), 0.0, 0.0, 0.0])
    rows = np.concatenate(order)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    first, last, leaf, center, radius, to_parent, norm = map(np.array, zip(*nodes, strict=True))
    return {"rows": rows, "vectors": vectors[rows], "norms": norms[rows], "near": np.concatenate(near), "first": first, "last": last, "is_leaf": leaf, "center": place[center], "radius": radius, "to_parent": to_parent, "norm": norm}


class Search:
    """The best ``top`` places of a tree for each query. ``rank`` orders the tree's places
    by id; ``own`` is the place of each query's own row, or -1."""

    def __init__(self, tree: dict, rank, queries, own, top: int = TOP):
        import numpy as np

        self.tree, self.rank, self.own, self.top = tree, rank, own, top
        vectors = tree["vectors"]
        width = max(vectors.shape[1], queries.shape[1], 1)
        vectors, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))
        reach = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * width
        exact = np.float64 if reach < 2**52 else np.int64
        self.points, self.asked = vectors.astype(exact), queries.astype(exact)
        self.squares, self.lengths = ((x.astype(np.float64) ** 2).sum(1) for x in (vectors, queries))
        self.span = 2 ** max(1, int(len(vectors)).bit_length())
        self.none = np.iinfo(np.int64).min
        # Score times span plus more for a smaller id; unordered.
        self.best = np.full((len(queries), top), self.none)
        self.floor = np.full(len(queries), -np.inf)  # the k-th best score, or less
        self.known = self.floor.copy()  # what it was after the first descent
        self.counts = {"pages": int(tree["is_leaf"].sum()) * len(queries), "opened": 0, "distances": 0}

    def scores(self, which, places):
        self.counts["distances"] += len(which) * len(places)
        return (self.asked[which] @ self.points[places].T).astype("int64")

    def distances(self, which, places):
        import numpy as np

        return np.sqrt(np.maximum(self.lengths[which, None] + self.squares[places] - 2 * self.scores(which, places), 0))

    def bound(self, which, gap, norm):
        """Largest score at a distance of ``gap`` or more."""
        import numpy as np

        own = self.lengths[which]
        return np.minimum((own + norm**2 - np.maximum(gap, 0) ** 2) / 2, np.sqrt(own) * norm) + SLACK

    def open_leaf(self, node: int, which, gap) -> None:
        """Takes in a leaf page for some queries; gap: their distances to its center."""
        import numpy as np

        t = self.tree
        first, last = t["first"][node], t["last"][node]
        self.counts["opened"] += len(which)
        could = self.bound(which[:, None], np.abs(gap[:, None] - t["near"][first:last]), t["norms"][first:last]) >= self.floor[which, None]
        which, could = which[could.any(1)], could[could.any(1)]
        places = first + np.flatnonzero(could.any(0))
        if not len(places):
            return
        keys = self.scores(which, places) * self.span + (self.span - 1 - self.rank[places])
        keys[self.own[which, None] == places] = self.none
        better = keys.max(1) > self.best[which].min(1)
        which, keys = which[better], keys[better]
        if not len(which):
            return
        both = np.concatenate([self.best[which], keys], axis=1)
        self.best[which] = np.partition(both, both.shape[1] - self.top, axis=1)[:, -self.top :]
        least = self.best[which].min(1)
        self.floor[which] = np.maximum(self.known[which], np.where(least == self.none, -np.inf, least // self.span))

    def run(self):
        """(query, place, score) arrays."""
        import numpy as np

        t = self.tree
        everyone = np.arange(len(self.asked))
        at_root = self.distances(everyone, t["center"][:1])[:, 0]
        # Down to one leaf a query, by the best bound at each node.
        here = {0: (everyone, at_root)}
        while here:
            node, (which, gap) = here.popitem()
            if t["is_leaf"][node]:
                self.open_leaf(node, which, gap)
                continue
            children = np.arange(t["first"][node], t["last"][node])
            away = self.distances(which, t["center"][children])
            reach = self.bound(which[:, None], away - t["radius"][children], t["norm"][children])
            pick = reach.argmax(1)
            for k in np.unique(pick):
                here[int(children[k])] = which[pick == k], away[pick == k, k]
        # At least so good is each k-th score; the pages met so far are met again.
        self.known = seeded = self.floor.copy()
        self.best[:] = self.none
        # All pages that a query may still need, with its distance and bound.
        pages: list[tuple] = []
        level = [(0, everyone, at_root)]
        while level:
            following = []
            for node, which, gap in level:
                if t["is_leaf"][node]:
                    most = self.bound(which, gap - t["radius"][node], t["norm"][node])
                    pages.append((np.full(len(which), node), which, gap, most))
                    continue
                children = np.arange(t["first"][node], t["last"][node])
                stored = np.abs(gap[:, None] - t["to_parent"][children]) - t["radius"][children]
                could = self.bound(which[:, None], stored, t["norm"][children]) >= seeded[which, None]
                for k in np.flatnonzero(could.any(0)):
                    asks = which[could[:, k]]
                    away = self.distances(asks, t["center"][children[k] : children[k] + 1])[:, 0]
                    live = self.bound(asks, away - t["radius"][children[k]], t["norm"][children[k]]) >= seeded[asks]
                    if live.any():
                        following.append((int(children[k]), asks[live], away[live]))
            level = following
        if pages:
            self._best_first(*[np.concatenate(x) for x in zip(*pages, strict=True)])
        q, k = np.nonzero(self.best != self.none)
        keys = self.best[q, k]
        by_rank = np.argsort(self.rank)
        return q, by_rank[self.span - 1 - keys % self.span], keys // self.span

    def _best_first(self, node, which, gap, most) -> None:
        """Each query's pages from its best one on, until none can reach its k-th score."""
        import numpy as np

        order = np.lexsort((-most, which))
        node, which, gap, most = node[order], which[order], gap[order], most[order]
        starts = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        ends, take = np.append(starts[1:], len(which)), 1
        while len(starts):
            several = np.minimum(take, ends - starts)
            at = np.repeat(starts - np.cumsum(several) + several, several) + np.arange(int(several.sum()))
            at = at[most[at] >= self.floor[which[at]]]
            grouped = at[np.argsort(node[at], kind="stable")]
            for part in np.split(grouped, np.flatnonzero(np.diff(node[grouped])) + 1):
                if len(part := part[most[part] >= self.floor[which[part]]]):
                    self.open_leaf(int(node[part[0]]), which[part], gap[part])
            starts, take = starts + several, 2 * take
            more = starts < ends
            starts, ends = starts[more], ends[more]
            live = most[starts] >= self.floor[which[starts]]
            starts, ends = starts[live], ends[live]


def _packed(rows, ids, vectors) -> list:
    """Bytes of rows, ids with null mask, and the vectors in the narrowest type."""
    import numpy as np

    top = int(np.abs(vectors).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    plain = ids.fill_null(0).to_numpy()
    return [rows.tobytes(), known.astype(np.int8).tobytes() + plain.tobytes(), np.dtype(kind).char.encode() + vectors.astype(kind).tobytes(), len(rows)]


def _unpacked(rows: bytes, ids: bytes, vectors: bytes, n: int):
    import numpy as np

    known = np.frombuffer(ids, np.int8, n).astype(bool)
    kind = np.dtype(vectors[:1].decode())
    return np.frombuffer(rows, np.int64), known, np.frombuffer(ids, np.int64, n, n), np.frombuffer(vectors, kind, offset=1).reshape(n, -1).astype(np.int64)


def query_blocks(queries: DataFrame) -> DataFrame:
    """rows, ids, vectors (bytes), n of blocks of at most QUERY_ROWS queries."""
    schema = pa.schema([("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int32())])

    def pack(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(k, QUERY_ROWS)
                own = _packed(part.column(0).to_numpy(), part.column(1), _matrix(part.column(2)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, own, strict=True))], schema=schema)

    return queries.select("row", "vec_id", "vec").mapInArrow(pack, "rows binary, ids binary, vectors binary, n int")


def _grown(parts) -> tuple:
    """(tree, rank, rows, known, ids, by_row) of a shard's vectors, in the tree's order."""
    import numpy as np

    width = max(p[3].shape[1] for p in parts)
    rows, known, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
    tree = build_tree(np.concatenate([np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in parts]))
    rows, known, ids = rows[tree["rows"]], known[tree["rows"]], ids[tree["rows"]]
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((ids, ~known))] = np.arange(len(rows))
    return tree, rank, rows, known, ids, np.argsort(rows)


def _search_stream(top: int):
    """Of a stream sorted by shard, vectors first: a tree for each shard's vectors, then one
    search a query block."""

    def run(batches):
        import numpy as np

        shard, parts, grown = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column(0).to_numpy()
            is_vector = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | ~is_vector[1:] | ~is_vector[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if shards[a] != shard:
                    shard, parts, grown = shards[a], [], None
                if is_vector[a]:
                    row, ids, vec = (batch.column(k).slice(a, b - a) for k in (1, 2, 3))
                    known = ids.is_valid().to_numpy(zero_copy_only=False)
                    parts.append((row.to_numpy(), known, ids.fill_null(0).to_numpy(), _matrix(vec)))
                    continue
                if not parts:
                    continue  # a shard without vectors
                grown = grown or _grown(parts)
                tree, rank, rows, known, ids, by_row = grown
                asked = _unpacked(*[batch.column(k)[a].as_py() for k in (4, 5, 6, 7)])
                at = np.minimum(rows[by_row].searchsorted(asked[0]), len(rows) - 1)
                own = np.where(rows[by_row[at]] == asked[0], by_row[at], -1)
                q, p, s = Search(tree, rank, asked[3], own, top).run()
                yield pa.RecordBatch.from_arrays([pa.array(asked[0][q]), pa.array(asked[2][q]), pa.array(ids[p], mask=~known[p]), pa.array(s)], ["row", "query_id", "vec_id", "score"])

    return run


def top_scores(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of every row of ``vectors`` that ``is_query`` marks."""
    vectors = common.materialize(vectors, "vectors")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    own = vectors.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "vec_id", "vec")
    asked = query_blocks(vectors.filter(is_query)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stream = own.unionByName(asked, allowMissingColumns=True).select("shard", "row", "vec_id", "vec", "rows", "ids", "vectors", "n")
    stream = stream.repartition(F.col("shard")).sortWithinPartitions("shard", F.col("row").isNull())
    found = stream.mapInArrow(_search_stream(top), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(common.bare(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return top_scores(vectors, F.col("vec_id") % EVERY == 0)


OP8_SQL = f"""
WITH valid AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])), 0) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
WHERE rank <= {TOP}
"""
