"""MinHash near-dedup by an LSH forest: sorted signature orders, prefix neighbours, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.llm.common import blocks, broadcast_if_small, read_table, shuffle_partitions, small, small_batches, stored, text_buffer
from ocellus.llm.components import connected
from ocellus.llm.hashing import Hasher, fresh, mix, window_starts, word_bounds

_U = np.uint64
TREES, LEAST_DEPTH, DEPTH, SPARSE = 35, 4, 5, 64
REGION, REGION_ELEMENTS, HUBS = 4096, 1 << 22, 16
ORDER_ROWS = 1_000_000
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted within it; where each text's begin: n + 1 values).

    Words have A-Z lowered. A text with fewer words than ``width`` has all of them as its one shingle.
    """
    starts, ends, before = word_bounds(buf, offsets)
    n = len(offsets) - 1
    words = hasher.words(buf, starts, ends, fold=True)
    count = np.diff(before)
    inside = window_starts(before, width)
    parts = [hasher.windows(words, width)[inside]]
    docs = [np.searchsorted(before, np.flatnonzero(inside), side="right") - 1]
    for few in range(1, width):
        if len(short := np.flatnonzero(count == few)):
            parts.append(hasher.windows(words, few)[before[short]])
            docs.append(short)
    h, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def signatures(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """16 bits of each of TREES * DEPTH minima, for texts with a shingle at least; others get zeros."""
    out = np.zeros((len(cuts) - 1, TREES * DEPTH), np.uint16)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        low, at = (h >> _U(32)).astype(np.uint32), cuts[:-1][some]
        for k in range(TREES * DEPTH):
            x = low * _A[k]
            x ^= x >> np.uint32(15)
            x *= _B[k]
            least = np.minimum.reduceat(x, at)
            out[some, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sketch(docs: DataFrame, width: int, first: Hasher, second: Hasher) -> DataFrame:
    """(doc_id, n, set_a, set_b, sig): number of shingles, the sum of their hashes by either hasher, signature bytes."""

    def total(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _U(0x2545F4914F6CDD1D)), dtype=np.uint64)])
        return sums[cuts[1:]] - sums[cuts[:-1]]

    def run(batches):
        for b in small(batches):
            buf, offsets = text_buffer(b.column(1))
            parts = []
            for i, j in blocks(offsets):
                part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, cuts = shingles(part, offs, width, first)
                parts.append((np.diff(cuts), total(h, cuts), total(*shingles(part, offs, width, second)), signatures(h, cuts)))
            n, x, y, sig = (np.concatenate(p) for p in zip(*parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array([s.astype(">u2").tobytes() for s in sig], pa.binary())], ["doc_id", "n", "set_a", "set_b", "sig"])

    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, set_a long, set_b long, sig binary")


def regions(order: DataFrame) -> DataFrame:
    """(tree, id, head) of the rows in runs of sorted orders of (tree, key, id).

    A run is a region of the order whose rows share a prefix of their keys, with a depth that adapts to
    it (see ``_heads``); its head is its first row. Where a full key goes on over partitions, the driver,
    which sees two rows of each partition, gives the run's later heads the first one.
    """

    def run(batches):
        from pyspark import TaskContext

        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables)
        ids, tree = t["id"].to_numpy(), t["tree"].to_numpy()
        keys = np.frombuffer(b"".join(t["key"].to_pylist()), ">u2").reshape(len(ids), DEPTH)
        lcp = np.zeros(len(ids), np.int64)
        same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1)
        lcp[1:] = np.where(tree[1:] == tree[:-1], same, 0)
        head = _heads(lcp)
        edge = [0, len(ids) - 1]
        some = np.bincount(head, minlength=len(ids))[head] > 1
        some[edge] = some[head[-1]] = True
        some = np.flatnonzero(some)
        part = TaskContext.get().partitionId()
        at = np.concatenate([some, edge])
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree[at], pa.int16()), pa.array(ids[at]), pa.array(ids[head[at]]), pa.array([None] * len(some) + [2 * part, 2 * part + 1], pa.int32()), pa.array([None] * len(some) + [keys[k].tobytes() for k in edge], pa.binary())],
            ["tree", "id", "head", "border", "key"],
        )

    found = stored(order.mapInArrow(run, "tree short, id long, head long, border int, key binary"), "forest")
    ends = found.filter("border IS NOT NULL").orderBy("border").collect()
    moved, last, last_head = [], None, None
    for y, z in zip(ends[::2], ends[1::2]):
        first, first_head = (y["tree"], bytes(y["key"])), y["head"]
        if first == last:
            moved.append((y["tree"], first_head, last_head))
            first_head = last_head
        last = (z["tree"], bytes(z["key"]))
        last_head = first_head if last == first else z["head"]
    runs = found.filter("border IS NULL").select("tree", "id", "head")
    if not moved:
        return runs
    moved = found.sparkSession.createDataFrame(moved, "tree short, head long, top long")
    return runs.join(F.broadcast(moved), ["tree", "head"], "left").select("tree", "id", F.coalesce("top", "head").alias("head"))


def _heads(lcp: np.ndarray, least: int = LEAST_DEPTH, most: int = DEPTH, sparse: int = SPARSE) -> np.ndarray:
    """First row of each row's run, from the longest common prefix of each row with the one before.

    A run shares at least ``least`` values; where it has more than ``sparse`` rows it is parted by one more
    value, and so on, down to runs of ``most`` values, which stay whole whatever their size.
    """
    first = lcp < least
    for depth in range(least, most + 1):
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, len(lcp)))
        if depth == most:
            return np.repeat(starts, size)
        first |= np.repeat(size > sparse, size) & (lcp < depth + 1)


def _centrality(flat: np.ndarray, doc: np.ndarray, df: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean, over a set's elements, of the number of sets that have the element, if others have it."""
    return np.bincount(doc, df[flat].astype(np.float64), minlength=len(size)) / np.maximum(1, size)


def confirm(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Component of each set under links 100 * |a & b| >= percent * |a | b|: every link between components is found.

    ``known``: labels of sets whose equals are linked already.

    A set's overlaps with all others come from one pass over their elements. Central sets go first;
    once they have grown a large component, only sets outside the largest one are compared with all,
    as every pair of different components has such a member.
    """
    n = len(sets)
    root = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    if n < 2:
        return root
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(flat, minlength=len(values))
    doc = np.repeat(np.arange(n), size)
    shared = df[flat] > 1
    flat, doc = flat[shared], doc[shared]
    cuts = np.searchsorted(doc, np.arange(n + 1))
    mark, compared = np.zeros(len(values), bool), np.zeros(n, bool)

    def compare(k: int) -> None:
        compared[k] = True
        own = flat[cuts[k] : cuts[k + 1]]
        mark[own] = True
        total = np.concatenate([[0], np.cumsum(mark[flat])])
        mark[own] = False
        both = total[cuts[1:]] - total[cuts[:-1]]
        linked = np.flatnonzero(100 * both >= percent * (size[k] + size - both))
        roots = np.unique(np.append(root[linked], root[k]))
        root[np.isin(root, roots)] = roots[0]

    central = _centrality(flat, doc, df, size)
    for k in np.argsort(-central, kind="stable")[: min(n, 16)]:
        compare(int(k))
    while True:
        roots, members = np.unique(root, return_counts=True)
        rest = np.flatnonzero((root != roots[members.argmax()]) & ~compared)
        if not len(rest):
            return root
        compare(int(rest[0]))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by shingle sets that overlap by ``percent``.

    Equal sets first become one class, by their size and two sums of hashes, aggregated map-side. Class
    representatives (smallest id) go into TREES sorted orders of signature keys; rows that share a
    prefix of a key form runs (see ``regions``); representatives that runs connect, directly or not, are
    a block, and blocks are confirmed on full sets (see ``confirm``), so a pair is lost only if no
    order brings it together: at most (1 - s ** DEPTH) ** TREES at a similarity of s, 1e-9 at 0.85 and
    1e-6 at 0.8. Sets are confirmed by other hashes than those that made the signatures.
    A block of more than REGION documents, or as many REGION_ELEMENTS shingles, is not given to one task:
    each of its runs is, and runs of more than that go to ``_between_parts``, which also misses no link;
    what is found is put together by ``connected``. So one task's sets have bounded bytes, but for a
    single document's.

    Null and empty texts and rows without id have an empty or no set: linked with nothing; a null id
    has a null component and is kept. Rows that repeat an id are one document.
    """
    spark = docs.sparkSession
    first, second = fresh(), fresh()
    sketched = stored(sketch(docs, width, first, second), "sketch")
    key = ["n", "set_a", "set_b"]
    classes = stored(sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    order = classes.select("id", "sig", tree).select(F.col("tree").cast("short").alias("tree"), F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "id")
    parts = max(2 * shuffle_partitions(spark), -(-classes.count() * TREES // ORDER_ROWS))
    runs = regions(order.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id"))
    # A document of many shingles counts as several rows.
    rows = F.greatest(F.lit(1.0), F.col("n") * (REGION / REGION_ELEMENTS)).alias("rows")
    weights = classes.select("id", rows)
    blocks_ = stored(connected(runs.filter("id <> head"), "id", "head").join(weights, "id"), "blocks")
    huge = stored(blocks_.groupBy("root").agg(F.sum("rows").alias("size")).filter(F.col("size") > REGION).select("root"), "huge")
    members = blocks_.select("id", F.col("root").alias("block"))
    split = huge.limit(1).count() > 0
    if split:
        huge = broadcast_if_small(huge)
        inner = blocks_.join(huge, "root", "left_semi").select("id", "rows")
        runs = stored(runs.join(inner, "id"), "runs")
        sizes = runs.groupBy("tree", "head").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(id))").alias("x"))
        # Orders that bring the same documents together count once.
        once = stored(sizes.filter("m > 1").groupBy("head", "m", "x").agg(F.min(F.struct("tree", "n")).alias("t")).select("t.tree", "head", "t.n"), "run-sizes")
        over = stored(once.filter(F.col("n") > REGION), "over")
        block = F.xxhash64("tree", "head").alias("block")
        large = runs.select("tree", "head", "id", "rows").join(broadcast_if_small(over), ["tree", "head"]).select("id", block, "n", "rows")
        # Dropped first, so that the other join has no hot key.
        hot = stored(sizes.filter(F.col("n") > REGION).select("tree", "head"), "hot")
        rest = runs.join(broadcast_if_small(hot), ["tree", "head"], "left_anti").select("tree", "head", "id").join(once.select("tree", "head"), ["tree", "head"]).select("id", block)
        members = blocks_.join(huge, "root", "left_anti").select("id", F.col("root").alias("block")).union(rest)
    sets = _Sets(docs, width, second)
    found = _confirmed(sets, members, percent)
    if split:
        if over.limit(1).count():
            found = _between_parts(sets, stored(large, "large-runs"), found, percent)
        found = connected(found, "id", "root")
    roots = found.filter("root <> id").select(F.col("id").alias("rep"), F.col("root"))
    rep = sketched.select("doc_id", *key).join(classes.select(*key, F.col("id").alias("rep")), key, "left")
    out = rep.join(roots, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


class _Sets:
    """The shingles of documents, made from their texts as they are asked for."""

    def __init__(self, docs: DataFrame, width: int, hasher: Hasher):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        self.width, self.hasher = width, hasher

    def of(self, members: DataFrame) -> DataFrame:
        """members with the column elements: the shingles of the document of each id."""
        members, width, hasher = stored(members, "members"), self.width, self.hasher
        columns, schema = members.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)

        def to_sets(batches):
            for b in small(batches):
                buf, offsets = text_buffer(b.column(len(columns)))
                out = []
                for i, j in blocks(offsets):
                    h, cuts = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, hasher)
                    out += [h[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(out, pa.binary())], [*columns, "elements"])

        return self.texts.join(broadcast_if_small(members), "id").select(*columns, "text").mapInArrow(to_sets, f"{schema}, elements binary")


def _first_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, the row of each, its set)."""
    ids, at = np.unique(table["id"].to_numpy(), return_index=True)
    elements = table["elements"]
    return ids, at, [np.frombuffer(elements[int(k)].as_py(), np.uint64) for k in at]


def _confirmed(sets_: _Sets, members: DataFrame, percent: int) -> DataFrame:
    """(id, root) within each block. members: (id, block), and known if what has one value of it is linked already."""

    def judge(table: pa.Table) -> pa.Table:
        ids, at, sets = _first_rows(table)
        root = confirm(sets, percent, table["known"].to_numpy()[at] if "known" in table.column_names else None)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        return pa.table([pa.array(ids), pa.array(least[root])], ["id", "root"])

    return stored(sets_.of(members).groupBy("block").applyInArrow(judge, "id long, root long"), "confirmed")


def _between_parts(sets_: _Sets, large: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """found and all links between components within runs of more than REGION rows. large: (id, block, n, rows).

    rows: 1, or more for a document of very many shingles; n: their sum over the run.

    A run is dealt by hash to parts of about REGION / 2. Each part is confirmed together with the run's
    HUBS most central documents, which joins what are copies of one document in one pass. As in
    ``confirm``, a link between two components then has an end outside the run's largest one: the
    documents outside are dealt to parts too, and each of these is confirmed with each part of the run.
    """
    half = max(1, REGION // 2)

    def dealt(n: str, seed: int):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col(n) / half))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / half) - 1))

    def central(table: pa.Table) -> pa.Table:
        ids, at, sets = _first_rows(table)
        size = np.array([len(s) for s in sets])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        df, doc = np.bincount(flat, minlength=len(values)), np.repeat(np.arange(len(ids)), size)
        shared = df[flat] > 1
        score = _centrality(flat[shared], doc[shared], df, size)
        best = np.argsort(-score, kind="stable")[:HUBS]
        return pa.table([pa.array(ids[best]), table["run"].take(pa.array(at[best])), pa.array(score[best])], ["id", "run", "score"])

    runs = large.select("id", F.col("block").alias("run"), "n", "rows", dealt("n", 1).alias("part"))
    part = F.xxhash64("run", "part").alias("block")
    hubs = sets_.of(runs.select("id", "run", part)).groupBy("block").applyInArrow(central, "id long, run long, score double")
    order = Window.partitionBy("run").orderBy(F.desc("score"), "id")
    hubs = stored(hubs.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= HUBS).select("id", "run"), "hubs")
    sizes = broadcast_if_small(stored(large.select(F.col("block").alias("run"), "n").distinct(), "large-sizes"))
    seen = runs.select("id", part).union(hubs.join(sizes, "run").select("id", "run", every("n").alias("part")).select("id", part))
    found = found.union(_confirmed(sets_, seen, percent))
    known = stored(runs.select("id", "run", "n", "rows", dealt("n", 2).alias("j")).join(connected(found, "id", "root").withColumnRenamed("root", "known"), "id"), "known")
    most = stored(known.groupBy("run", "known").count().groupBy("run").agg(F.max(F.struct("count", "known"))["known"].alias("most")), "most")
    outside = stored(known.join(broadcast_if_small(most), "run").filter("known <> most").select("id", "run", "n", "rows", "known"), "outside")
    many = stored(outside.groupBy("run").agg(F.sum("rows").alias("m")), "outside-sizes")
    if not many.limit(1).count():
        return found
    many = broadcast_if_small(many)
    block = F.xxhash64("run", "i", "j").alias("block")
    own = outside.join(many, "run").select("id", "run", "known", dealt("m", 3).alias("i"), every("n").alias("j"))
    all_ = known.join(many, "run").select("id", "run", "known", every("m").alias("i"), "j")
    return found.union(_confirmed(sets_, own.select("id", block, "known").union(all_.select("id", block, "known")), percent))


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
