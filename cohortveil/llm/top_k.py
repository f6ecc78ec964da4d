"""Exact top-k search by inner product: block-at-a-time pruning.

Rows are sorted into ranges by their strongest dimensions and cut into blocks
of at most BLOCK rows, which hold their vectors (the forward index) and each
dimension's greatest and least value.  A block can't score more than the sum,
over a query's dimensions, of its value times that extreme; a query takes
blocks in order of these sums, in waves, and stops where they fall below its
kth best score.  Blocks stand in shards of at most SHARD rows.  A query first
searches its own shard, which gives it a first kth score; then sets of at most
SLOT queries meet all other shards, where only what reaches that score comes
out.  A set of stated queries against all rows is quadratic by its nature; no
task holds more than a shard and a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import stored

BLOCK, SHARD, SLOT = 64, 16_384, 65_536
#: A block and a shard also end at so many bytes of values.
BLOCK_BYTES, SHARD_BYTES = 1 << 22, 1 << 24
SCALE = 256
#: Double arithmetic is exact below this.
EXACT = 2.0**53
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max

INDEX = "part int, seq long, queries boolean, n int, dim int, ids binary, known binary, code string, values binary, scores binary, best binary, best_known binary, place long"


def scaled(df: DataFrame, asked: Column) -> DataFrame:
    """Rows that take part: asked, vec_id and the whole numbers that stand for their vectors."""
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < float("inf")))
    own = df.where(good).select(F.coalesce(asked, F.lit(False)).alias("asked"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("v"))
    return own.withColumns({"dim": F.size("v"), "up": F.array_position("v", F.array_max("v")), "down": F.array_position("v", F.array_min("v"))})


def narrow(values: np.ndarray) -> tuple[str, bytes]:
    """Values in the fewest bytes that hold them."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    code = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return code, values.astype(code).tobytes()


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, over the components that both have."""
    m = min(a.shape[1], b.shape[1])
    a, b = a[:, :m], b[:, :m]
    if float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(m, 1) < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    full = a.astype(object) @ b.astype(object).T
    return np.array([[min(max(x, NONE + 1), MOST) for x in row] for row in full], np.int64)


class Block:
    def __init__(self, values: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.values, self.ids, self.known = values, ids, known
        self.high, self.low = values.max(0).astype(float), values.min(0).astype(float)


class Best:
    """The k best (score, id) of each query; ids that are null come after others of equal score."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids, self.known = np.full((n, k), NONE), np.full((n, k), MOST), np.zeros((n, k), bool)

    def meet(self, at: np.ndarray, found: np.ndarray, block: Block) -> None:
        k = self.scores.shape[1]
        s = np.concatenate((self.scores[at], found), 1)
        ids = np.concatenate((self.ids[at], np.broadcast_to(block.ids, found.shape)), 1)
        known = np.concatenate((self.known[at], np.broadcast_to(block.known, found.shape)), 1)
        order = np.lexsort((ids, ~known, -s.astype(float) if abs(s[s > NONE]).max(initial=0) < EXACT else ~s), axis=1)[:, :k]
        self.scores[at], self.ids[at], self.known[at] = (np.take_along_axis(x, order, 1) for x in (s, ids, known))


def search(asked: np.ndarray, own: np.ndarray, blocks: list[Block], k: int, floor: np.ndarray) -> Best:
    """The k best rows of the blocks for each query; rows below `floor` may be left out, and rows with the query's id (own) are."""
    best = Best(len(asked), k)
    up, down = np.maximum(asked, 0).astype(float), np.minimum(asked, 0).astype(float)
    bounds = np.empty((len(asked), len(blocks)))
    by_dim: dict[int, list[int]] = {}
    for j, b in enumerate(blocks):
        by_dim.setdefault(len(b.high), []).append(j)
    for dim, at in by_dim.items():
        m = min(dim, asked.shape[1])
        high, low = (np.stack([x[:m] for x in xs]) for xs in zip(*((blocks[j].high, blocks[j].low) for j in at), strict=True))
        bounds[:, at] = up[:, :m] @ high.T + down[:, :m] @ low.T
    bounds[~(np.abs(bounds) < EXACT)] = np.inf
    order = np.argsort(-bounds, axis=1, kind="stable")
    began, width = 0, 1
    while began < len(blocks):
        wave = order[:, began : began + width]
        kth = np.maximum(best.scores[:, -1], floor)
        live = np.take_along_axis(bounds, wave, 1) >= kth[:, None]
        if not live.any():  # bounds only fall from here
            break
        rows, columns = np.nonzero(live)
        taken = wave[rows, columns]
        sort = np.argsort(taken, kind="stable")
        rows, taken = rows[sort], taken[sort]
        edges = np.flatnonzero(np.diff(taken, prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(taken)], strict=True):
            block, at = blocks[taken[a]], rows[a:z]
            found = scores(asked[at], block.values)
            found[(own[at][:, None] == block.ids) & block.known] = NONE
            least = np.maximum(best.scores[at, -1], floor[at])
            good = ((found >= least[:, None]) & (found > NONE)).any(1)
            if good.any():
                best.meet(at[good], found[good], block)
        began, width = began + width, width * 2
    return best


def records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in INDEX.split(", ")])


def indexed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks, and each shard's queries with what they find in it."""
    part, seq = TaskContext.get().partitionId(), 0
    blocks: list[Block] = []
    queries: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def close_block() -> None:
        if held:
            values, ids, known, asked = (np.concatenate(x) for x in zip(*held, strict=True))
            blocks.append(Block(values, ids, known))
            if asked.any():
                queries.append((values[asked], ids[asked]))
            held.clear()

    def shard() -> Iterator[pa.RecordBatch]:
        nonlocal seq
        for b in blocks:
            code, values = narrow(b.values)
            yield records([(part, seq, False, len(b.ids), b.values.shape[1], b.ids.tobytes(), b.known.tobytes(), code, values, None, None, None, None)])
        by_dim: dict[int, list] = {}
        place = 0
        for q in queries:
            by_dim.setdefault(q[0].shape[1], []).append(q)
        for dim, own in by_dim.items():
            asked, ids = (np.concatenate(x) for x in zip(*own, strict=True))
            best = search(asked, ids, blocks, k, np.full(len(ids), NONE))
            for a in range(0, len(ids), BLOCK):
                z = a + BLOCK
                code, values = narrow(asked[a:z])
                yield records([(part, seq, True, len(ids[a:z]), dim, ids[a:z].tobytes(), None, code, values, best.scores[a:z].tobytes(), best.ids[a:z].tobytes(), best.known[a:z].tobytes(), place)])
                place += len(ids[a:z])
        blocks.clear()
        queries.clear()
        seq += 1

    def size() -> tuple[int, int]:
        return sum(len(x[1]) for x in held), sum(x[0].nbytes for x in held)

    n = nbytes = 0  # of the shard
    for batch in batches:
        dims, asked = batch.column("dim").to_numpy(zero_copy_only=False), batch.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        known = ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        ids = np.where(known, batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False), MOST).astype(np.int64)
        flat, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(dims)
        at = 0
        while at < len(dims):
            dim, (rows, size_now) = int(dims[at]), size()
            if held and (held[0][0].shape[1] != dim or rows >= BLOCK or size_now + 8 * dim > BLOCK_BYTES):
                close_block()
                rows = size_now = 0
            if n and (n >= SHARD or nbytes + 8 * dim > SHARD_BYTES):
                close_block()
                yield from shard()
                n = nbytes = rows = size_now = 0
            room = max(1, min(BLOCK - rows, SHARD - n, (BLOCK_BYTES - size_now) // max(8 * dim, 1), (SHARD_BYTES - nbytes) // max(8 * dim, 1)))
            same = dims[at : at + room] == dim
            take = int(np.argmin(same)) if not same.all() else len(same)
            z = at + take
            values = flat[ends[at] - dim : ends[z - 1]].reshape(take, dim)
            held.append((values, ids[at:z], known[at:z], asked[at:z]))
            n, nbytes, at = n + take, nbytes + 8 * dim * take, z
    close_block()
    if blocks:
        yield from shard()


def matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["values"], row["code"]).astype(np.int64).reshape(row["n"], row["dim"])


RESULTS = "home int, home_seq long, at long, query_id long, vec_id long, score long"


def results(found: list[tuple]) -> pa.Table:
    """Rows of RESULTS from (home part, seq, first query's place in it, query ids, Best, floor)."""
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for part, seq, first, ids, best, floor in found:
        good = (best.scores > NONE) & (best.scores >= floor[:, None])
        rows, places = np.nonzero(good)
        own = (np.full(len(rows), part), np.full(len(rows), seq), first + rows, ids[rows], best.ids[rows, places], best.scores[rows, places], best.known[rows, places])
        for c, x in zip(columns, own, strict=True):
            c.append(x)
    part, seq, at, asked, ids, score, known = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    arrays = [pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(at, pa.int64()), pa.array(asked, pa.int64()), pa.array(ids, pa.int64(), mask=~known.astype(bool)), pa.array(score, pa.int64())]
    return pa.Table.from_arrays(arrays, [x.split()[0] for x in RESULTS.split(", ")])


def best_of(row: dict, k: int) -> Best:
    best = Best(row["n"], k)
    best.scores, best.ids = (np.frombuffer(row[c], np.int64).reshape(row["n"], k) for c in ("scores", "best"))
    best.known = np.frombuffer(row["best_known"], bool).reshape(row["n"], k)
    return best


def top_k(df: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """For each row of which `asked` holds, the k other rows of greatest inner product.

    df has vec_id (long) and embedding (array of numbers); other columns don't
    matter.  Components x count as floor(256 * x).  Returns query_id, rank
    (from 1), vec_id and score, ties to the smaller vec_id.  Rows whose vector
    is null, or holds null or what isn't finite (after scaling too), take no
    part.  Vectors of different lengths meet in the components that both have;
    empty ones score 0.  Every row is a candidate, repeated ones as often as
    they come, but those with the query's own id; rows without an id are
    candidates, after others of equal score, and never queries.  A repeated
    query row has its results once for each row.  Numbers and scores beyond a
    long's range stand at its ends.  No rows, or no other rows, give no rows.
    """
    rows = scaled(df, asked & F.col("vec_id").isNotNull())
    order = ["dim", "up", "down", "vec_id", F.monotonically_increasing_id()]
    ranged = rows.withColumn("row", order.pop()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    index = stored(ranged.select("asked", "vec_id", "dim", "v").mapInArrow(lambda batches: indexed(batches, k), INDEX))
    size = index.agg(F.max("part").alias("part"), F.max("seq").alias("seq"), F.sum(F.when(F.col("queries"), F.col("n"))).alias("n")).first()
    slots = -(-(size["n"] or 0) // SLOT)
    asking = index.where("queries").withColumn("slot", F.pmod(F.xxhash64("part", "seq", "place"), F.lit(max(slots, 1))).cast("int"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                yield from results([(r["part"], r["seq"], r["place"], ids, best_of(r, k), np.full(len(ids), NONE))]).to_batches()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [Block(matrix(r), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)) for r in right.to_pylist()]
        found = []
        for r in left.to_pylist() if blocks else ():
            ids, floor = np.frombuffer(r["ids"], np.int64), best_of(r, k).scores[:, -1]
            found.append((r["home"], r["home_seq"], r["place"], ids, search(matrix(r), ids, blocks, k, floor), floor))
        return results(found)

    home = asking.mapInArrow(own, RESULTS)
    if slots:
        shards = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size["part"])), lambda p: F.transform(F.sequence(F.lit(0), F.lit(size["seq"]).cast("int")), lambda s: F.struct(p.alias("p"), s.alias("s")))))
        sent = asking.withColumn("to", F.explode(shards)).where((F.col("to.p") != F.col("part")) | (F.col("to.s") != F.col("seq")))
        sent = sent.select(F.col("to.p").alias("part"), F.col("to.s").cast("long").alias("seq"), "slot", F.col("part").alias("home"), F.col("seq").alias("home_seq"), "place", "n", "dim", "ids", "code", "values", "scores", "best", "best_known")
        there = index.where("NOT queries").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        cells = sent.groupby("part", "seq", "slot").cogroup(there.select("part", "seq", "slot", "n", "dim", "ids", "known", "code", "values").groupby("part", "seq", "slot"))
        home = home.unionByName(cells.applyInArrow(cell, RESULTS))
    each = Window.partitionBy("home", "home_seq", "at", "query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return home.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
