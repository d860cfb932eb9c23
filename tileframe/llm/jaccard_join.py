"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles as 64-bit hashes; two documents
link when 100 * intersection >= 80 * union. The work, in this order:

1. A sketch of ``SKETCH`` counters holds in how many documents the shingles of each
   hash range occur (all documents are counted). It only orders shingles, rare first,
   so its size is fixed and its collisions cost time, never results.
2. Each set's prefix (its first n - ceil(0.8 n) + 1 shingles in that order) goes into
   inverted lists. Linked sets share a shingle of their prefixes; at the first one the
   positions i and j leave min(n_x - i, n_y - j) shingles, which must be enough.
3. Index-level skipping: a list is sorted by set size and, in the block of one size, by
   position, so for a probing set each block is cut where positions get too high, and
   skipped whole where its own position is. The set at the lowest position leads its
   list and stands for the sets that could link with it; led pairs are verified first.
4. Answer-level skipping: with the verified overlaps with a leader p, other pairs of a
   list follow from p's answers: sets in one component need no check, and
   |x & y| <= min(|x & p|, |y & p|) + min(n_x - |x & p|, n_y - |y & p|) rules out others.
   Pairs that neither rule settles are verified.

Before sets are compared, pairs pass a bound by parity bitmaps (64 bytes or more a set):
differing bits are at most the size of the symmetric difference. Verification compares
whole sets, so results are exact up to equality of 64-bit hashes.

Exact copies have one set id (a 64-bit hash of the set) and never meet each other in a
list; a list row is 24 bytes, and no text or set is gathered by shingle. A list of more
than ``LIST_ROWS`` rows is dealt to blocks by a hash of the set id. Its chief, the set at
the lowest position, leads in every block, so near copies meet one leader; afterwards sets
of other components than the chief's visit the blocks they are not at home in, so every
pair that is not settled meets once. Components are
found in rounds of joins. Nothing that grows with the table goes to the driver; the ids
of the documents whose sets are compared are broadcast up to ``BROADCAST_IDS`` of them
and joined by shuffle beyond.

Defined cases: words are lower-cased in A-Z only; a very long text is one set, compared
whole; a row without an id has a set like others and names its component only where no
row has an id; a document with fewer than five words
has one shingle, the whole sequence; a null or empty text has none, and is its own
component; rows that repeat an id are rows of the result each, their component that of
their own text, with the smallest id among its rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common, components, ngrams

SHINGLE = 5
#: Link: LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 80)
SKETCH_BITS = 21
SKETCH = 1 << SKETCH_BITS
SKETCH_PARTS = 64
BROADCAST_IDS = 1_000_000
LIST_ROWS = 512
#: Pairs of whole sets that a task compares, and rows of small columns that it writes.
PAIRS_A_TASK = 2_000
ROWS_A_TASK = 20_000
#: Pairs that a task gathers before it hands them on.
PAIR_BATCH = 65_536
FACTOR = 0x9E3779B97F4A7C15 | 1


def shingles(text: str | None):
    """Sorted distinct shingle hashes (uint64) of a text."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(SHINGLE, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(FACTOR) + words[k : len(words) - width + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return ngrams.distinct(mixed)


def least_overlap(total):
    """Smallest intersection with which sets of ``total`` elements together link."""
    a, b = LINK
    return -(-b * total // (a + b))


def prefix_length(n):
    return n - (-(-LINK[1] * n // LINK[0])) + 1


def _as_long(x):
    return pa.array(x.view("int64"), pa.int64())


def sketch(texts: DataFrame):
    """Document frequencies by hash range: a numpy array of SKETCH counters."""
    import numpy as np
    import zstandard

    def count(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            if found:
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(np.minimum(part, 2**32 - 1).astype(np.uint32).tobytes()) for part in np.split(counts, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(key, frame):
        import pandas as pd

        unpack = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(unpack.decompress(c), np.uint32).astype(np.int64) for c in frame["counts"])
        return pd.DataFrame({"part": [key[0]], "counts": [zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())]})

    rows = texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros(SKETCH, np.uint32)
    size = SKETCH // SKETCH_PARTS
    for r in rows:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.uint32)
    return out


def _bitmap(own) -> bytes:
    import numpy as np

    bits = max(256, 1 << int(len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def set_id(own) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


SETS_SCHEMA = "doc_id long, sid long, n int, prefix array<long>, light int, bitmap binary"


def prefixes(docs: DataFrame, counts) -> DataFrame:
    """doc_id, sid, n, prefix (rare shingles first), light (how many of them, from the first
    on, have lists of LIST_ROWS at most for certain), bitmap. Copies of a set in the same
    batch have a null prefix; an empty set has a null sid."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        df = sent.value
        for batch in batches:
            seen: set[int] = set()
            sids, sizes, fronts, lights, maps = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                n = len(own)
                sid = set_id(own) if n else None
                sids.append(sid)
                sizes.append(n)
                if not n or sid in seen:
                    fronts.append(None)
                    lights.append(None)
                    maps.append(None)
                    continue
                seen.add(sid)
                often = df[own >> np.uint64(64 - SKETCH_BITS)]
                rare = np.argsort(often, kind="stable")[: prefix_length(n)]
                fronts.append(own[rare].view(np.int64))
                lights.append(int((often[rare] <= LIST_ROWS).sum()))
                maps.append(_bitmap(own))
            arrays = [batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fronts, pa.list_(pa.int64())), pa.array(lights, pa.int32()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sid", "n", "prefix", "light", "bitmap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SETS_SCHEMA)


class _Blocks:
    """A list sorted by set size and position; blocks of one size."""

    def __init__(self, n, pos):
        import numpy as np

        self.n, self.pos = n, pos
        self.starts = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        self.ends = np.append(self.starts[1:], len(n))
        self.sizes = n[self.starts]

    def reach(self, at: int):
        """(start, end) of the entries, block by block, that could link with entry ``at``."""
        own, room = int(self.n[at]), int(self.n[at] - self.pos[at])
        a, b = LINK
        low = self.sizes.searchsorted(-(-b * own // a))
        high = self.sizes.searchsorted(a * own // b, "right")
        for k in range(low, high):
            size = int(self.sizes[k])
            need = least_overlap(own + size)
            if room < need:
                break  # larger sets need more
            start, end = int(self.starts[k]), int(self.ends[k])
            yield start, start + int(self.pos[start:end].searchsorted(size - need, "right"))


def led_pairs(n, pos, sid):
    """(members, leader) positions in one list, leader by leader."""
    import numpy as np

    blocks, free = _Blocks(n, pos), np.ones(len(n), bool)
    for lead in np.lexsort((sid, pos)):
        if not free[lead]:
            continue
        free[lead] = False
        led = [start + np.flatnonzero(free[start:end]) for start, end in blocks.reach(lead)]
        if led and len(members := np.concatenate(led)):
            free[members] = False
            yield members, lead


def unsettled_pairs(n, pos, root, leader, overlap, home):
    """(position, positions) of pairs of one list in different components whose leader's
    answers do not rule them out, one of them at home. Only sets outside the list's largest
    component probe."""
    import numpy as np

    names, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return
    blocks, largest = _Blocks(n, pos), counts.argmax()
    for at in np.flatnonzero(which != largest):
        for start, end in blocks.reach(at):
            other = np.arange(start, end)
            other = other[(which[other] != which[at]) & ((which[other] == largest) | (other > at)) & (home[at] | home[other])]
            if leader[at] != 0 and len(other):
                most = np.minimum(overlap[other], overlap[at]) + np.minimum(n[other] - overlap[other], n[at] - overlap[at])
                other = other[(leader[other] != leader[at]) | (most >= least_overlap(n[other].astype(np.int64) + n[at]))]
            if len(other):
                yield at, other


def _by_list(batches, width: int):
    """Whole lists from sorted batches: (columns, starts, ends) of lists of two sets or
    more, without the copies of a set."""
    import numpy as np

    def whole(columns):
        token, sid = columns[0], columns[3]
        new = np.append(True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]))
        columns = [c[new] for c in columns]
        token = columns[0]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        keep = np.repeat(sizes > 1, sizes)
        columns = [c[keep] for c in columns]
        ends = np.cumsum(sizes[sizes > 1])
        return columns, ends - sizes[sizes > 1], ends

    held: list = []  # of the list that goes on
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        if not len(columns[0]):
            continue
        first = columns[0].searchsorted(columns[0][-1])  # where the last list begins
        if first == 0 and held and held[-1][0][-1] == columns[0][0]:
            held.append(columns)
            continue
        if held or first:
            yield whole([np.concatenate([*[h[k] for h in held], columns[k][:first]]) for k in range(width)])
        held = [[c[first:] for c in columns]]
    if held:
        yield whole([np.concatenate([h[k] for h in held]) for k in range(width)])


LISTS_SCHEMA = "token long, pos int, n int, sid long, leader long"


def _scan_lists(batches):
    """Rows of lists with two sets or more (leader null) and led pairs (token null)."""
    import numpy as np

    for (token, n, pos, sid), starts, ends in _by_list(batches, 4):
        members, leads = [], []
        two = starts[ends - starts == 2]
        x, y = two, two + 1
        need = least_overlap(n[x].astype(np.int64) + n[y])
        fits = (n[x] - pos[x] >= need) & (n[y] - pos[y] >= need)
        members.append(x[fits])
        leads.append(y[fits])
        for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            for found, lead in led_pairs(n[start:end], pos[start:end], sid[start:end]):
                members.append(start + found)
                leads.append(np.full(len(found), start + lead))
        a, b = np.concatenate(members).astype(np.int64), np.concatenate(leads).astype(np.int64)
        rows, pairs = len(token), len(a)
        arrays = [
            pa.concat_arrays([pa.array(token), pa.nulls(pairs, pa.int64())]),
            pa.concat_arrays([pa.array(pos), pa.nulls(pairs, pa.int32())]),
            pa.concat_arrays([pa.array(n), pa.nulls(pairs, pa.int32())]),
            pa.array(np.concatenate([sid, sid[a]])),
            pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(sid[b])]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["token", "pos", "n", "sid", "leader"])


def _scan_settled(batches):
    """Pairs that need a check although their lists' leaders are known."""
    import numpy as np

    for (_, n, pos, sid, root, leader, overlap, home), starts, ends in _by_list(batches, 8):
        held: list = []
        size = 0

        def pairs():
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b])], ["a", "b"])  # noqa: B023

        for start, end in zip(starts, ends, strict=True):
            own = slice(start, end)
            for at, other in unsettled_pairs(n[own], pos[own], root[own], leader[own], overlap[own], home[own]):
                held.append((np.full(len(other), start + at), start + other))
                size += len(other)
                if size >= PAIR_BATCH:
                    yield pairs()
                    held, size = [], 0
        if held:
            yield pairs()


def _pass_bitmaps(batches):
    """Of a, b, n_a, n_b, map_a, map_b those whose bitmaps permit a link."""
    import numpy as np

    for batch in batches:
        keep = []
        for n_a, n_b, map_a, map_b in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
            x, y = (np.frombuffer(m, np.uint8) for m in (map_a, map_b))
            while len(x) != len(y):  # fold the longer one: parities add
                x, y = sorted((x, y), key=len)
                y = _fold(y)
            apart = int(np.bitwise_count(x ^ y).sum())
            keep.append((n_a + n_b - apart) // 2 >= least_overlap(n_a + n_b))
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))


def _fold(bitmap):
    half = len(bitmap) // 2
    return bitmap[:half] ^ bitmap[half:]


def _overlaps(batches):
    import numpy as np

    for batch in batches:
        got = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(large.searchsorted(small), len(large) - 1)
            got.append(int((large[at] == small).sum()))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(got, pa.int32())], ["a", "b", "n_a", "n_b", "overlap"])


def _home():
    """Block of a long list where a set is at home."""
    return F.pmod(F.xxhash64("sid", F.lit("block")), F.col("blocks")).cast("int")


class Join:
    """One run of the join; ``docs`` needs doc_id and text."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("long"), "text")
        self.own = common.materialize(prefixes(self.docs, sketch(self.docs)), "jaccard-prefixes")
        maps = self.own.filter("prefix IS NOT NULL").select("sid", "n", "bitmap", "doc_id")
        # One row a set: its smallest document that has a bitmap, by which its text is found.
        sets = maps.groupBy("sid").agg(F.min(F.struct("doc_id", "n", "bitmap")).alias("s")).select("sid", "s.doc_id", "s.n", "s.bitmap")
        self.sets = common.materialize(sets, "jaccard-sets")

    def _permitted(self, pairs: DataFrame) -> DataFrame:
        side = lambda s: self.sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"map_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "map_a", "map_b")
        return both.mapInArrow(_pass_bitmaps, "a long, b long, n_a int, n_b int")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Adds ``overlap`` to a, b, n_a, n_b (a materialized table)."""
        asked = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        wanted = common.materialize(asked.join(self.sets.select("sid", "doc_id"), "sid"), f"{name}-ids")
        ids = wanted.select("doc_id").distinct()
        n_wanted, n_pairs = wanted.count(), pairs.count()
        few = n_wanted <= BROADCAST_IDS

        def whole(batches):
            for batch in batches:
                found = [shingles(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) if len(s) else None for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["sid", "elements"])

        ids = ids.withColumnRenamed("doc_id", "_id")
        ids = F.broadcast(ids) if few else ids.hint("shuffle_hash")
        elements = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(whole, "sid long, elements binary").dropDuplicates(["sid"])
        elements = common.materialize(common.gathered(elements, n_wanted, PAIRS_A_TASK), f"{name}-sets")
        both = pairs.join(elements.select(F.col("sid").alias("a"), F.col("elements").alias("x")), "a").join(elements.select(F.col("sid").alias("b"), F.col("elements").alias("y")), "b")
        both = common.gathered(both.select("a", "b", "n_a", "n_b", "x", "y"), n_pairs, PAIRS_A_TASK)
        return common.materialize(both.mapInArrow(_overlaps, "a long, b long, n_a int, n_b int, overlap int"), name)

    def _long_lists(self) -> tuple[DataFrame, DataFrame]:
        """Rows of the lists (token, n, pos, sid, light), and token, blocks, chief of those
        that are dealt to blocks."""
        rows = self.own.filter("prefix IS NOT NULL").select(F.posexplode("prefix").alias("pos", "token"), "n", "sid", "light")
        sizes = rows.filter("pos >= light").groupBy("token").agg(F.count("*").alias("of"), F.min(F.struct("pos", "sid", "n")).alias("chief"))
        long = sizes.filter(F.col("of") > LIST_ROWS).select("token", F.ceil(F.col("of") / LIST_ROWS).cast("int").alias("blocks"), "chief")
        long = common.materialize(long, "jaccard-long")
        return rows, F.broadcast(long) if long.count() <= BROADCAST_IDS else long

    def _visits(self, rows: DataFrame, long: DataFrame, state: DataFrame) -> DataFrame:
        """Sets of long lists outside the chief's component, at each block but their own."""
        chiefs = long.select("token", F.col("chief.sid").alias("sid")).join(state, "sid", "left").select("token", F.coalesce("root", "sid").alias("chief_root"))
        known = rows.filter("pos >= light").join(long.select("token", "blocks"), "token").join(state, "sid", "left").join(chiefs, "token")
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        others = known.filter(F.coalesce("root", "sid") != F.col("chief_root")).select("*", block).filter(F.col("block") != _home())
        return others.select(F.xxhash64("token", "block").alias("token"), "n", "pos", "sid", "root", "leader", "overlap", F.lit(False).alias("home"))

    def links(self) -> DataFrame:
        """a, b, overlap, n_a, n_b: verified links between sets, enough to connect every
        pair of linked sets (links inside a component are not all listed)."""
        first, second, _ = self._linked()
        return first.unionByName(second)

    def _linked(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links with leaders, the other links, and the components that the first ones make:
        sid, root (null: the set is its own)."""
        rows, long = self._long_lists()
        at = F.when(F.col("blocks").isNull(), F.col("token")).otherwise(F.xxhash64("token", _home()))
        dealt = rows.join(long.select("token", "blocks"), "token", "left").select(at.alias("token"), "n", "pos", "sid")
        chiefs = long.select("token", "chief", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        dealt = dealt.union(chiefs.select(F.xxhash64("token", "block"), "chief.n", "chief.pos", "chief.sid"))
        dealt = dealt.repartition("token").sortWithinPartitions("token", "n", "pos", "sid")
        scanned = common.materialize(dealt.mapInArrow(_scan_lists, LISTS_SCHEMA), "jaccard-lists")
        led = scanned.filter("leader IS NOT NULL").groupBy(F.col("sid").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("met"))
        led = common.materialize(led, "jaccard-led")
        permitted = self._permitted(led.select("a", "b")).join(led, ["a", "b"])
        # Each set is compared with the leader that it meets most often.
        best = permitted.groupBy("a").agg(F.max(F.struct("met", F.col("b"), "n_a", "n_b")).alias("s")).select("a", "s.b", "s.n_a", "s.n_b")
        # A set has one such leader, so these tables have no more rows than there are sets.
        n_sets = self.sets.count()
        first = self._verified(common.materialize(common.gathered(best, n_sets, ROWS_A_TASK), "jaccard-first"), "jaccard-answers")
        is_link = LINK[0] * F.col("overlap") >= LINK[1] * (F.col("n_a") + F.col("n_b") - F.col("overlap"))
        first_links = first.filter(is_link)
        roots = components.roots(first_links.select("a", "b"), "jaccard-roots", n_sets)
        # What is known of a set: its component, its leader and the overlap with it. A
        # leader knows itself wholly.
        known = first.select(F.col("a").alias("sid"), F.col("b").alias("leader"), "overlap", F.lit(1).alias("order"))
        selves = first.select(F.col("b").alias("sid"), F.col("b").alias("leader"), F.col("n_b").alias("overlap"), F.lit(0).alias("order"))
        answers = known.union(selves).groupBy("sid").agg(F.min(F.struct("order", "leader", "overlap")).alias("s")).select("sid", "s.leader", "s.overlap")
        state = answers.join(roots.withColumnRenamed("id", "sid"), "sid", "full")
        state = common.materialize(common.gathered(state, n_sets, ROWS_A_TASK), "jaccard-state")
        entries = scanned.filter("leader IS NULL").drop("leader").join(state, "sid", "left").withColumn("home", F.lit(True))
        entries = entries.unionByName(self._visits(rows, long, state))
        entries = entries.select("token", "n", "pos", "sid", F.coalesce("root", "sid").alias("root"), F.coalesce("leader", F.lit(0)).alias("leader"), F.coalesce("overlap", F.lit(0)).alias("overlap"), "home")
        left = entries.repartition("token").sortWithinPartitions("token", "n", "pos", "sid", F.desc("home")).mapInArrow(_scan_settled, "a long, b long")
        left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = self._permitted(common.materialize(left.join(done, ["a", "b"], "left_anti"), "jaccard-left"))
        second = self._verified(common.materialize(rest, "jaccard-second"), "jaccard-rest")
        names = ["a", "b", "overlap", "n_a", "n_b"]
        return first_links.select(names), second.filter(is_link).select(names), state.select("sid", "root")

    def _rooted(self) -> DataFrame:
        """sid, smallest (id of its rows), root of every set."""
        _, second, first = self._linked()
        # The other links only join components of the first ones.
        root = lambda s: first.select(F.col("sid").alias(s), F.col("root").alias(f"root_{s}"))
        between = second.join(root("a"), "a", "left").join(root("b"), "b", "left")
        between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components.roots(between, "jaccard-components", second.count()).select(F.col("id").alias("root"), F.col("root").alias("whole"))
        roots = first.filter("root IS NOT NULL").join(joined, "root", "full").select(F.coalesce("sid", "root").alias("id"), F.coalesce("whole", "root").alias("root"))
        smallest = self.own.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("smallest"))
        return smallest.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    def survivors(self) -> DataFrame:
        """doc_id, sid of one row of each component: the smallest id, null only where there
        is no other, then the smallest sid. Rows without a set are their own components."""
        first = F.min(F.struct(F.col("smallest").isNull().alias("lost"), F.col("smallest").alias("doc_id"), "sid"))
        named = self._rooted().groupBy("root").agg(first.alias("s")).select("s.doc_id", "s.sid")
        return named.union(self.own.filter("sid IS NULL").select("doc_id", "sid"))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        rooted = self._rooted()
        named = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").select("sid", "component_id")
        joined = self.own.select("doc_id", "sid", "n").join(named, "sid", "left")
        return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return Join(docs).result()


def _with_sid(docs: DataFrame) -> DataFrame:
    """Adds ``_sid``, the id of the text's set."""

    def run(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            sids = pa.array([set_id(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sids], [*batch.schema.names, "_sid"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_sid", LongType())]))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, of the smallest id and for that id the smallest set, with
    the columns of ``docs``. Rows that repeat an id are told apart by their sets: those of
    different components stay; of rows with the same id and set, one. A row with a null id
    stays only where its component has no other id, and then one of them; rows with a null
    id and no words all stay."""
    inner, names = common.set_aside(docs, "doc_id", "text")
    join = Join(inner)
    kept = common.materialize(join.survivors(), "jaccard-kept").select(F.col("doc_id").alias("_kept"), F.col("sid").alias("_of"))
    repeated = join.own.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").select("_id")
    repeated = common.materialize(repeated, "jaccard-repeated")
    n_repeated = repeated.count()
    single = kept.filter("_kept IS NOT NULL")
    if n_repeated:
        single = single.join(repeated, single["_kept"] == repeated["_id"], "left_anti")
    stay = inner.join(single.hint("shuffle_hash"), inner["doc_id"] == single["_kept"], "left_semi")
    if n_repeated:
        ids = F.broadcast(repeated) if n_repeated <= BROADCAST_IDS else repeated.hint("shuffle_hash")
        rows = _with_sid(inner.join(ids, inner["doc_id"] == repeated["_id"], "left_semi"))
        rows = rows.join(kept, (F.col("doc_id") == F.col("_kept")) & F.col("_sid").eqNullSafe(F.col("_of")), "left_semi")
        stay = stay.unionByName(rows.dropDuplicates(["doc_id", "_sid"]).drop("_sid"))
    lost = _with_sid(inner.filter("doc_id IS NULL"))
    sets = kept.filter("_kept IS NULL AND _of IS NOT NULL")
    stay = stay.unionByName(lost.filter("_sid IS NULL").drop("_sid"))
    stay = stay.unionByName(lost.join(sets, F.col("_sid") == F.col("_of"), "left_semi").dropDuplicates(["_sid"]).drop("_sid"))
    return stay.select(*names)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))
