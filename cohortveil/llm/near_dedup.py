"""MinHash near-duplicate groups, with odd sketches to judge candidates.

Documents with equal shingle sets form a class, and classes are compared.
Banded MinHash buckets propose candidates.  MinHash samples folded into parity
bitmaps (odd sketches) estimate a candidate's similarity from the population
count of an XOR; what is clearly below the threshold goes no further.  The
rest is confirmed on the full shingle sets.

No bucket is turned into all its pairs.  First every class meets two hubs of
each of its buckets, the one with the fewest shingles and the one with the least hash
(mostly the same in all buckets of a group, so a class meets few), and what links becomes one component.  Then only classes outside a bucket's
commonest component have anything left to meet in it.  They meet its other
classes in cells of bounded size, whatever the bucket's.  A cell of sketches
gives out the classes that may have links in it, never their pairs; their full
sets meet in the same cell, which gives out no more than a spanning forest of
confirmed links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import NO_ID, as_bytes, map_batches, stored
from .components import components
from .repeats import whole
from .rolling import Roller, mix, word_bounds, word_values

U = np.uint64
SIZE, SHARE = 5, 75
BANDS, ROWS = 32, 4
#: MinHash values in a sketch (the first BANDS * ROWS also make the bands), and bits of a sketch.
SAMPLES, BITS = 256, 2048
#: A bucket's classes meet in cells of about so many outsiders and so many others at most.
CELL = (512, 4096)
#: Shingles that the sets of a cell's one side hold at most, about.
HELD = 1 << 21
#: Members that one task takes for a hub; hubs with more get several tasks.  Salts that hubs are counted by.
MEMBERS, SALTS = 400, 64


#: Numbers from NO_ID on, so many, stand for rows without an id, told apart by their texts.
NAMELESS = 1 << 60


def ided(docs: DataFrame) -> DataFrame:
    """doc_id, text and did: the id to compare by, smaller than all others and a text's own for a null doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = F.pmod(F.xxhash64("text"), F.lit(NAMELESS)) + F.lit(NO_ID)
    return own.withColumn("did", F.coalesce("doc_id", nameless))


class Shingler:
    """Sorted distinct shingle fingerprints of texts."""

    def __init__(self, size: int):
        self.size, self.words = size, Roller()

    def sets(self, texts: list[bytes]):
        """For each text its shingle set; words are lower-cased (A-Z)."""
        for group in whole(np.array([len(t) for t in texts], np.int64)):
            a = np.frombuffer(b"".join(texts[d].lower() + b" " for d, _, _ in group), np.uint8)
            cuts = np.cumsum([e + 1 for _, _, e in group])
            starts, stops = word_bounds(a)
            self.words.load(word_values(a, starts, stops))
            at = np.concatenate(([0], np.searchsorted(starts, cuts)))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if lo == hi:
                    yield np.zeros(0, U)
                    continue
                first = np.arange(lo, max(hi - self.size, lo) + 1)
                yield np.unique(self.words.span(first, np.minimum(first + self.size, hi)))


def features(docs: DataFrame, size: int, bands: int, rows: int, samples: int, bits: int) -> DataFrame:
    """doc_id, did, n, the set's 128-bit fingerprint (key_a, key_b), band keys and odd sketch of every text."""

    def work():
        shingler, k = Shingler(size), max(samples, bands * rows)
        rng = np.random.default_rng(11)
        multiply, flip = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)
        place = np.arange(k).astype(U) << U(32)
        weight = mix(np.arange(rows).astype(U) + U(17)) | U(1)

        def sample(shingles: np.ndarray) -> np.ndarray:
            least = np.full(k, 2**32 - 1, np.uint32)
            folded = (shingles >> U(32)).astype(np.uint32)
            for at in range(0, len(folded), 256):
                np.minimum(least, ((folded[at : at + 256, None] ^ flip) * multiply).min(axis=0), out=least)
            return least

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column("text"))
            n, a, b, keys, sketches = [], [], [], [], []
            for shingles in shingler.sets(texts):
                n.append(len(shingles))
                if not len(shingles):
                    a.append(0), b.append(0), keys.append(None), sketches.append(None)
                    continue
                a.append(int(mix(shingles + U(1)).sum().view(np.int64)))
                b.append(int(mix(shingles ^ U(0x5555555555555555)).sum().view(np.int64)))
                least = sample(shingles).astype(U)
                keys.append(mix((least[: bands * rows].reshape(bands, rows) * weight).sum(axis=1) + mix(np.arange(bands).astype(U))).view(np.int64))
                odd = np.bincount((mix(least[:samples] | place[:samples]) % U(bits)).astype(np.int64), minlength=bits) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            lists = [pa.array([x if x is None else x.tolist() for x in column], pa.list_(pa.int64())) for column in (keys, sketches)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("did"), *(pa.array(x, pa.int64()) for x in (n, a, b)), *lists], ["doc_id", "did", "n", "key_a", "key_b", "bands", "sketch"])

        return step

    return map_batches(ided(docs).select("doc_id", "did", "text"), work, "doc_id long, did long, n long, key_a long, key_b long, bands array<long>, sketch array<long>")


def apart(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def most_apart(samples: int, bits: int, similarity: float) -> float:
    """The population count that sets of this similarity are expected to have."""
    return bits / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / bits))


def limit(share: int, samples: int, bits: int) -> float:
    """The population count up to which two sketches may belong to a link.

    MinHash values and their folding both scatter; four and a half standard
    deviations of the two together are left below the threshold.
    """
    j = share / 100
    folded = samples * (1 - j) / (bits / 2) ** 0.5 / samples
    sure = j - 4.5 * (j * (1 - j) / samples + folded**2) ** 0.5
    return float(most_apart(samples, bits, max(sure, 0.05)))


def sketched(pairs: DataFrame, classes: DataFrame, share: int, samples: int, bits: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    one = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    sized = pairs.join(one("b"), "b").join(one("a"), "a").where(100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b"))
    return sized.where(apart(F.col("sketch_a"), F.col("sketch_b")) <= limit(share, samples, bits)).select("a", "b").distinct()


def grid(inside: DataFrame, most: tuple[int, int], weight: int) -> DataFrame:
    """Deal buckets into cells: `inside` once a cell that it takes part in, with o, m and role.

    `inside` has band, node, component, main (the bucket's commonest component)
    and n.  A bucket's outsiders make the one side (role 0), all its classes
    the other (role 1); each side is cut into parts of about `most` classes and
    `weight` shingles.
    """
    outside = F.col("component") != F.col("main")
    parts = lambda count, total, k: F.ceil(F.greatest(count / most[k], total / weight)).cast("int")
    sizes = inside.groupBy("band").agg(parts(F.count_if(outside), F.sum(F.when(outside, F.col("n")).otherwise(0)), 0).alias("os"), parts(F.count("*"), F.sum("n"), 1).alias("ms"))
    own = inside.join(sizes, "band")
    place = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    kept = ["band", "node", "component", "n"]
    rows = own.where(outside).select(*kept, place("os").alias("o"), every("ms").alias("m"), F.lit(0).alias("role"))
    return rows.unionByName(own.select(*kept, every("os").alias("o"), place("ms").alias("m"), F.lit(1).alias("role")))


def cells(dealt: DataFrame, columns: Sequence[str], solve: Callable, fields: Sequence[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """solve(key, outsiders, members) for each cell (band, o, m); it gives tuples of the named fields."""

    def table(found: Iterable[tuple]) -> pa.RecordBatch:
        found = list(found)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, (_, t) in enumerate(fields)], [c for c, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])
        for batch in batches:
            found: list[tuple] = []
            for band, o, m, role, *row in zip(*(batch.column(c).to_pylist() for c in ("band", "o", "m", "role", *columns)), strict=True):
                if key != (band, o, m):
                    if held[0] and held[1]:
                        found += solve(key, *held)
                    key, held = (band, o, m), ([], [])
                held[role].append(row)
            yield table(found)
        if held[0] and held[1]:
            yield table(solve(key, *held))

    return dealt.select("band", "o", "m", "role", *columns).repartition("band", "o", "m").sortWithinPartitions("band", "o", "m", "role").mapInArrow(run, schema)


def worth_comparing(inside: DataFrame, classes: DataFrame, share: int, samples: int, bits: int) -> DataFrame:
    """The classes of each cell that sizes and sketches allow a link in it: band, o, m, node, component and role.

    A pair is looked at in one bucket only, that with the least key of all that
    it shares.  What a cell gives out are its classes, not their pairs.
    """
    most = limit(share, samples, bits)
    meets = inside.groupBy("node").agg(F.collect_list("band").alias("meets"))
    dealt = grid(inside, CELL, HELD).join(meets, "node").join(classes.select("node", "sketch"), "node")

    def solve(key, outsiders, members):
        a, b = ([np.array([r[k] for r in side], np.int64) for k in range(3)] for side in (outsiders, members))
        sketch_a, sketch_b = (np.array([r[3] for r in side], np.int64).view(U) for side in (outsiders, members))
        earlier = sorted((x, k) for k, r in enumerate(members) for x in r[4] if x < key[0])
        values, owners = (np.array([x[k] for x in earlier], np.int64) for k in range(2))
        wanted = [np.zeros(len(side), bool) for side in (outsiders, members)]
        for k, row in enumerate(outsiders):
            fits = (b[1] != a[1][k]) & (100 * np.minimum(b[2], a[2][k]) >= share * np.maximum(b[2], a[2][k]))
            own = np.array([x for x in row[4] if x < key[0]], np.int64)
            for low, high in zip(np.searchsorted(values, own).tolist(), np.searchsorted(values, own, "right").tolist(), strict=True):
                fits[owners[low:high]] = False
            at = np.flatnonzero(fits)
            near = at[np.bitwise_count(sketch_b[at] ^ sketch_a[k]).sum(axis=1) <= most]
            wanted[0][k] = len(near) > 0
            wanted[1][near] = True
        for role, side in enumerate((outsiders, members)):
            yield from ((*key, side[k][0], side[k][1], role) for k in np.flatnonzero(wanted[role]).tolist())

    fields = [("band", pa.int64()), ("o", pa.int32()), ("m", pa.int32()), ("node", pa.int64()), ("component", pa.int64()), ("role", pa.int32())]
    return cells(dealt, ("node", "component", "n", "sketch", "meets"), solve, fields, "band long, o int, m int, node long, component long, role int")


def forests(wanted: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Links (a, b) between components, confirmed on full shingle sets: of each cell no more than a spanning forest."""
    sent = wanted.groupBy(F.col("node").alias("did")).agg(F.collect_list(F.struct("band", "o", "m", "role", "component")).alias("sent"))
    fields = [("band", pa.int64()), ("o", pa.int32()), ("m", pa.int32()), ("role", pa.int32()), ("component", pa.int64())]

    def solve(key, outsiders, members):
        sets = [np.frombuffer(r[1], U) for r in members]
        sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        names, inverse = np.unique([r[0] for r in (*outsiders, *members)], return_inverse=True)
        group = inverse.copy()  # by row: the first row number of what is joined so far, as a label
        for k, (component, data) in enumerate(outsiders):
            own, theirs = np.frombuffer(data, U), group[len(outsiders) :]
            low, high = np.searchsorted(every, own), np.searchsorted(every, own, "right")
            counts = high - low
            at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero((theirs != group[k]) & (100 * both >= share * (sizes + len(own) - both))).tolist():
                if theirs[j] != group[k]:
                    yield component, members[j][0]
                    group[group == theirs[j]] = group[k]

    return cells(shipped(texts, sent, size, fields), ("component", "shingles"), solve, [("a", pa.int64()), ("b", pa.int64())], "a long, b long").distinct()


def shipped(texts: DataFrame, sent: DataFrame, size: int, fields: Sequence[tuple[str, pa.DataType]]) -> DataFrame:
    """The shingle sets of texts, once for each place in `sent` (did, sent: structs of the named fields), with did."""
    names = [c for c, _ in fields]
    kinds = {pa.int64(): "long", pa.int32(): "int"}

    def ship():
        shingler = Shingler(size)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, to = batch.column("did").to_pylist(), batch.column("sent").to_pylist()
            out: list[list] = [[] for _ in range(len(names) + 2)]
            for did, targets, shingles in zip(ids, to, shingler.sets(as_bytes(batch.column("text"))), strict=True):
                data = shingles.tobytes()
                for t in targets:
                    for column, value in zip(out, (*(t[c] for c in names), did, data), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*(t for _, t in fields), pa.int64(), pa.binary()), strict=True)], [*names, "did", "shingles"])

        return step

    schema = ", ".join([*(f"{c} {kinds[t]}" for c, t in fields), "did long", "shingles binary"])
    return map_batches(texts.join(sent.hint("shuffle_hash"), "did").select("did", "text", "sent"), ship, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Sets go to their hubs a; a hub with many members is dealt to several tasks.
    Members are counted and looked up by hub and salt, so no task gets a hub's whole.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    counted = stored(salted.groupBy("a", "salt").agg(F.count("*").alias("held")))
    hubs = counted.groupBy("a").agg(F.ceil(F.sum("held") / MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b", F.lit(1)), F.col("parts")).cast("int")
    members = salted.join(counted.join(hubs, "a").select("a", "salt", "parts"), ["a", "salt"]).select(F.col("b").alias("did"), F.col("a").alias("hub"), part.alias("part"), F.lit(1).alias("role"))
    own = hubs.select(F.col("a").alias("did"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    sent = members.unionByName(own).groupBy("did").agg(F.collect_list(F.struct("hub", "part", "role")).alias("sent"))

    def judge(batches):
        key, own_sets = None, []
        for batch in batches:
            found = []
            for hub, part, role, did, data in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "role", "did", "shingles")), strict=True):
                if key != (hub, part):
                    key, own_sets = (hub, part), []
                shingles = np.frombuffer(data, U)
                if role == 0:
                    own_sets.append(shingles)
                elif any(linked(shingles, x, share) for x in own_sets):
                    found.append((hub, did))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    sets = shipped(texts, sent, size, [("hub", pa.int64()), ("part", pa.int32()), ("role", pa.int32())])
    return sets.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(judge, "a long, b long").distinct()


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def near_groups(docs: DataFrame, size: int = SIZE, share: int = SHARE, bands: int = BANDS, rows: int = ROWS, samples: int = SAMPLES, bits: int = BITS) -> DataFrame:
    """The near-duplicate group of every document.

    A document's set holds its distinct shingles of `size` lower-cased words;
    with fewer words, the whole sequence is the one shingle.  Documents whose
    sets have share % or more of their union in common are linked.  Returns
    doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept
    (it is the document's own).

    Null texts and texts without words have no shingles and are linked with
    nothing.  Rows that repeat a doc_id are one document, so what is linked
    with one is linked with all.  Rows without a doc_id are documents by their
    text; a null doc_id is smaller than the others (but for ids in the lowest
    sixteenth of all longs) and comes back as a null component_id.  Clashing other columns change nothing; no rows give no rows.  The bands miss a pair at the threshold with
    probability (1 - share**rows)**bands, 5e-6 by default, and more similar
    ones with less.
    """
    own = ided(docs)
    texts = own.repartition("did")
    rows_ = stored(features(docs, size, bands, rows, samples, bits))
    full = rows_.where("n > 0")
    classes = stored(full.groupBy("key_a", "key_b").agg(F.min(F.struct("did", "n", "bands", "sketch")).alias("least")).select("key_a", "key_b", F.col("least.did").alias("node"), "least.n", "least.bands", "least.sketch"))
    placed = classes.select("node", "n", F.explode("bands").alias("band"))

    hub = placed.groupBy("band").agg(F.count("*").alias("held"), F.min(F.struct("n", "node")).alias("small"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("any")).where("held > 1")
    met = placed.join(hub, "band").select("node", F.explode(F.array("small.node", "any.node")).alias("a")).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    repeated = rows_.groupBy("did").agg(F.count("*").alias("times")).where("times > 1").select("did")
    same = full.join(repeated, "did", "left_semi").join(classes.select("key_a", "key_b", "node"), ["key_a", "key_b"]).select(F.col("did").alias("a"), F.col("node").alias("b"))
    links = stored(confirmed(stored(sketched(met, classes, share, samples, bits)), texts, size, share).unionByName(same))
    found = components(links)

    owned = placed.join(found, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    # Each mixed bucket's commonest component, by counts of counts: a group of any size is a few partial rows.
    shares = owned.groupBy("band", "component").agg(F.count("*").alias("members"))
    mixed = shares.groupBy("band").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("members", "component")).alias("main")).where("kinds > 1").select("band", "main")
    inside = stored(owned.join(mixed, "band"))
    wanted = stored(worth_comparing(inside, classes, share, samples, bits))
    # Links between components, then what each component becomes.
    joined = components(stored(forests(wanted, texts, size, share)))
    first = classes.join(found, "node", "left").select("key_a", "key_b", F.coalesce("component", "node").alias("label"))
    final = first.join(joined.select(F.col("node").alias("label"), "component"), "label", "left").select("key_a", "key_b", F.coalesce("component", "label").alias("group"))
    some = full.select("doc_id", "did", "n", "key_a", "key_b").join(final, ["key_a", "key_b"])
    none = rows_.where("n = 0").select("doc_id", "did", "n", F.col("did").alias("group"))
    every = some.select("doc_id", "did", "n", "group").unionByName(none)
    component = F.col("group")
    nameless = rows_.where("doc_id IS NULL").select(F.col("did").alias("group"), F.lit(True).alias("nameless")).distinct()
    if not nameless.isEmpty():
        every, component = every.join(nameless, "group", "left"), F.when(F.col("nameless").isNull(), F.col("group"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("group") == F.col("did")).alias("kept"))
