"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles over a universe; a second one, shifted
circularly by k, gives the k-th signature coordinate. A shingle's values for all
coordinates are then one contiguous window of the second permutation, so a document's
signature is the element-wise minimum of as many windows as it has shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, unused
from .graph import connected_components, contracted
from .kernels import U64, mix, ngrams, release, text_slices, tidy, unique_per_row, words

UNIVERSE_BITS = 20
#: Buckets of at most so many members are compared pair by pair, larger ones by way of a centre: of equal bands, and of (centre, difference), where most pairs fall to a bound first.
PAIRWISE, PAIRWISE_LATER = 8, 256
SKETCH_BITS = 22
MOST_LEVELS = 3
#: Tasks' counts that one task sums; pairs with a centre that one copy of its set serves.
FAN_IN, PAIRS_A_COPY = 64, 512


@dataclass(frozen=True)
class NearOptions:
    """Shingle length in words; similarity as a percentage; bands of rows of signature coordinates.

    With 45 bands of 6 rows a pair at 0.8 is missed with probability 1e-6; for 0.85,
    48 bands of 8 rows miss one with 2e-7. Long bands keep texts that share a passage
    only from meeting at all.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 45
    rows: int = 6
    seed: int = 11

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def permutations(options: NearOptions) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all windows of the circulant one (a view, a row for each start)."""
    key = (options.seed, options.coordinates)
    if key not in _tables:
        rng = np.random.default_rng(options.seed)
        size = 1 << UNIVERSE_BITS
        scatter = rng.permutation(size).astype(np.int32)
        circle = rng.permutation(size).astype(np.int32)
        circle = np.concatenate([circle, circle[: options.coordinates - 1]])
        _tables[key] = scatter, np.lib.stride_tricks.sliding_window_view(circle, options.coordinates)
    return _tables[key]


def signature(shingles: np.ndarray, options: NearOptions) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of shingle hashes."""
    scatter, windows = permutations(options)
    start = scatter[(shingles >> U64(64 - UNIVERSE_BITS)).astype(np.int64)]
    low = windows[start[:512]].min(axis=0)
    for at in range(512, len(start), 512):
        np.minimum(low, windows[start[at : at + 512]].min(axis=0), out=low)
    return low


def band_keys(signatures: np.ndarray, options: NearOptions) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), options.bands, options.rows).astype(U64)
    keys = np.arange(options.bands, dtype=U64)[None, :] + U64(options.bands)
    for r in range(options.rows):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, bounds) over the texts of a batch."""
    for first, data, offsets in text_slices(column):
        hashes, bounds = words(data, offsets)
        yield first, *unique_per_row(*ngrams(hashes, bounds, n))


def _signer(options: NearOptions, carried: tuple[str, ...] = ("doc_id",)):
    def sign(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in arrow:
            others = [batch.column(c) for c in carried]
            for first, sets, bounds in shingle_sets(batch.column("text"), options.shingle):
                count = np.diff(bounds)
                low = np.zeros((len(count), options.coordinates), np.int32)
                nodes: list[bytes | None] = []
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if a < b:
                        low[i] = signature(sets[a:b], options)
                        nodes.append(xxhash.xxh3_128_digest(sets[a:b].tobytes()))
                    else:
                        nodes.append(None)
                keys = band_keys(low, options)
                offsets = np.arange(len(count) + 1, dtype=np.int32) * options.bands
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, len(count)) for c in others], pa.array(count.astype(np.int64)), pa.array(nodes, pa.binary()), bands], [*carried, "n_shingles", "node", "bands"]
                )
        release()

    return sign


def _set_maker(n: int):
    def make(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in arrow:
            for first, sets, bounds in shingle_sets(batch.column("text"), n):
                blobs = [sets[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                nodes = [xxhash.xxh3_128_digest(b) for b in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(blobs, pa.binary())], ["node", "shingles"])
        release()

    return make


def _compare(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in y; x and y are sorted and distinct."""
    at = np.searchsorted(y, x)
    return y[np.minimum(at, len(y) - 1)] == x, at


def _verifier(percent: int):
    def verify(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in arrow:
            keep = []
            for x, y in zip(batch.column("left_set"), batch.column("right_set"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = int(_compare(x, y)[0].sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return verify


def _count_blocks(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sets: (block, task, places in the block, counts), for places that occur."""
    found, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    for batch in arrow:
        for begin in range(0, batch.num_rows, 1000):
            column = batch.column("shingles").slice(begin, 1000)
            at = np.concatenate([np.frombuffer(v.as_buffer(), U64) >> U64(64 - SKETCH_BITS) for v in column]).astype(np.int32)
            places, inverse = np.unique(np.concatenate([found, at]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(at), np.int64)]), len(places)).astype(np.int64)
            found = places
    block = found >> (SKETCH_BITS - 6)
    edges = np.searchsorted(block, np.arange(65))
    task = TaskContext.get().partitionId()
    parts = [(i, task, found[a:z].tobytes(), counts[a:z].tobytes()) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if a < z]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "task", "at", "counts"])


def _summer(fan_in: int):
    def sum_blocks(table: pa.Table) -> pa.Table:
        """Of up to ``fan_in`` tasks' counts of a block: one row with their sums."""
        total = np.zeros(1 << (SKETCH_BITS - 6), np.int64)
        block, task = table.column("block")[0].as_py(), min(table.column("task").to_pylist())
        for at, counts in zip(table.column("at"), table.column("counts"), strict=True):
            total[np.frombuffer(at.as_py(), np.int32) & (len(total) - 1)] += np.frombuffer(counts.as_py(), np.int64)
        at = np.flatnonzero(total).astype(np.int32) + np.int32(block << (SKETCH_BITS - 6))
        rows = {"block": [block], "task": [task // fan_in], "at": [at.tobytes()], "counts": [total[total > 0].tobytes()]}
        return pa.table({k: pa.array(v, pa.int32() if k in ("block", "task") else pa.binary()) for k, v in rows.items()})

    return sum_blocks


def _cap_counts(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        counts = [np.minimum(np.frombuffer(c, np.int64), (1 << 16) - 1).astype(np.uint16).tobytes() for c in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(counts, pa.binary())], ["at", "counts"])


def shingle_counts(sets: DataFrame, scratch: Scratch, fan_in: int = FAN_IN) -> np.ndarray:
    """How many sets hold a shingle, by its leading bits, so never too few: a table of 8 MB whatever the input. A count of 65535 stands for more.

    Tasks' counts are summed on executors, ``fan_in`` at a time and in as many rounds as that takes.
    """
    schema = "block int, task int, at binary, counts binary"
    rows = scratch.table(sets.select("shingles").mapInArrow(_count_blocks, schema), "blocks")
    most = rows.agg(F.max("task")).first()[0] or 0
    while True:
        rows = rows.groupBy("block", F.expr(f"task div {fan_in}")).applyInArrow(_summer(fan_in), schema)
        if most < fan_in:
            break
        most //= fan_in
        rows = scratch.table(rows, f"blocks-{most}")
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for r in rows.select("at", "counts").mapInArrow(_cap_counts, "at binary, counts binary").collect():
        out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.uint16)
    return out


def _star_comparer(percent: int, counts: np.ndarray):
    """Compare sets with their centres: whether they are linked, and keys for what sets in which they differ from it.

    Of n elements, D differ. They are put in an order that depends on the element
    and the centre alone, those first that few others should differ in: extra ones
    by how many sets hold them, missing ones by how many of the centre's sets lack
    them, as far as ``counts`` tells. Let
    beta be (1 - t) / (1 + t), so that linked sets x, y differ in beta (n_x + n_y)
    elements at most. With any set that isn't linked to the centre, a set linked to
    it shares over (D + beta (missing - extra)) / 2 of its differences; with any set
    at all, D - beta n (1 + 1 / t) at least. To share k of D, one of the first
    D - k + 1 in a common order must be shared. ``half`` keys follow from the better
    of both bounds; the rest, for partners that are linked to the centre, from the
    second alone.
    """
    beta = (100 - percent) / (100 + percent)

    def compare(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in arrow:
            linked, halves, keys, spots, differ = [], [], [], [], []
            for x, y, centre, alone in zip(batch.column("left_set"), batch.column("right_set"), batch.column("b").to_pylist(), batch.column("met").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                in_y = _compare(x, y)[0]
                both = int(in_y.sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                differ.append(len(x) + len(y) - 2 * both)
                if alone == 1:
                    halves.append(0)
                    keys.append(np.empty(0, np.int64))
                    spots.append(np.empty(0, np.int32))
                    continue
                salt = np.frombuffer(centre[:8], U64)
                extra, missing = x[~in_y], y[~_compare(y, x)[0]]
                shift = U64(64 - SKETCH_BITS)
                holders, lacking = counts[(extra >> shift).astype(np.int64)].astype(np.int64), np.maximum(alone - counts[(missing >> shift).astype(np.int64)].astype(np.int64), alone // 8)
                change = mix(np.concatenate([extra, ~missing]) + salt)
                order = np.lexsort((change, np.floor(np.log2(np.concatenate([holders, lacking]) + 1.0))))
                shared = np.concatenate([holders > 1, np.ones(len(missing), bool)])[order]
                change = change[order]
                far = max(int(np.ceil(len(change) - beta * len(x) * (1 + 100 / percent) - 1e-6)), 1)
                near = int(np.floor((len(change) + beta * (len(missing) - len(extra))) / 2 - 1e-6)) + 1
                half = len(change) - max(far, near) + 1
                halves.append(half)
                at = np.flatnonzero(shared[: half if linked[-1] else len(change) - far + 1])
                keys.append(change[at].view(np.int64))
                spots.append(at.astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(spots) if spots else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(halves, pa.int32()), pa.array(differ, pa.int32()), lists, places],
                ["a", "b", "linked", "half", "differ", "keys", "spots"],
            )

    return compare


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")


def _with_centres(stars: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a set and its centre with both sets. A centre that many meet has a copy of its set for every ``PAIRS_A_COPY`` of them, so that no key is hot."""
    copies = F.expr(f"(met - 1) div {PAIRS_A_COPY}")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set")).join(met.hint("merge"), "b")
    right = right.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("met")
    pairs = stars.withColumn("copy", F.pmod(F.xxhash64("a"), copies + 1))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "copy"]).drop("copy")


#: Rounds of the components between levels, where one in several parts costs comparisons only.
ROUNDS = 2


def _union(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, links)


def linked_components(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(node, root) of the components of similar sets among members (bucket, node) of common buckets; None without a bucket of two.

    In each bucket a centre is chosen, the member that meets most others in all its
    buckets, and every member is compared with it. Two members that are linked to
    each other, but not both to the centre, must differ from it in common, and
    ``_star_comparer`` knows in how much; so members regroup in buckets by (centre,
    difference), as N (linked to the centre), F (not), and X (not, by differences
    that only an N of the bucket can share). Buckets inside one component or
    without a pair that counts are done, and in those of ``PAIRWISE`` members at
    most, members of different components are compared pair by pair, unless what
    can still be shared is too little; so
    comparisons follow the number of members, also in a group of any number of near
    copies, and no link is lost. Buckets that are still large after ``MOST_LEVELS``
    such divisions are compared pair by pair too.
    """
    counts: np.ndarray | None = None
    edges: list[DataFrame] = []  # links so far, contracted after each level
    level = 0

    def whole(links: list[DataFrame], name: str) -> DataFrame:
        return scratch.table(connected_components(_union(links), scratch, name), f"{name}-roots")

    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("F", "far"), ("N", "near"), ("X", "only"))]
    while True:
        name = f"level-{level}"
        if edges:
            roots = edges[0].groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            members = members.join(roots.hint("merge"), "node", "left").select("bucket", "node", "kind", "left", "differ", F.coalesce("root", "node").alias("root"))
        else:
            members = members.select("bucket", "node", F.lit("F").alias("kind"), F.lit(0).alias("left"), F.lit(0).alias("differ"), F.col("node").alias("root"))
        members = scratch.table(members, f"{name}-placed")
        buckets = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), *kinds)
        buckets = buckets.where("low <> high AND (far > 0 AND far + near > 1 OR only > 0 AND near > 0)")
        buckets = scratch.table(buckets.select("bucket", "members"), f"{name}-buckets")
        rows, largest = buckets.agg(F.sum("members"), F.max("members")).first()
        if not rows:
            return whole(edges, name) if edges else None
        open_ = scratch.table(join_groups(members, buckets, ["bucket"], "members", int(rows)), f"{name}-open")
        most = PAIRWISE_LATER if level else PAIRWISE
        few = open_ if level >= MOST_LEVELS else open_.where(F.col("members") <= most)
        one = few.join(sizes.hint("merge"), "node").select("bucket", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("kind").alias("kind_a"), F.col("left").alias("left_a"), F.col("differ").alias("differ_a"))
        two = one.select("bucket", F.col("a").alias("b"), F.col("root_a").alias("root_b"), F.col("n_a").alias("n_b"), F.col("kind_a").alias("kind_b"), F.col("left_a").alias("left_b"), F.col("differ_a").alias("differ_b"))
        fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        # a bucket of the first difference in common: no more can be shared than what is left from there on
        shared = f"2 * least(left_a, left_b) >= differ_a + differ_b - {(100 - percent) / (100 + percent)!r}D * (n_a + n_b) - 1e-6" if level else "true"
        cross = one.join(two.hint("merge"), "bucket").where("root_a < root_b").where(fits).where(shared).where("concat(kind_a, kind_b) IN ('FF', 'FN', 'NF', 'XN', 'NX')").select("a", "b").distinct()
        links = [scratch.table(_with_sets(cross, sets).mapInArrow(_verifier(percent), "a binary, b binary"), f"{name}-links")]
        if largest <= most or level >= MOST_LEVELS:
            return whole(links + edges, name)
        open_ = open_.where(F.col("members") > most)
        fame = open_.groupBy("node").agg(F.sum("members").alias("fame"))
        famous = open_.select("bucket", "node").join(fame.hint("merge"), "node")
        centres = scratch.table(famous.groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("best"), F.count(F.lit(1)).alias("members")), f"{name}-centres")
        stars = join_groups(open_.select("bucket", "node"), centres, ["bucket"], "members", int(rows))
        stars = stars.select(F.col("node").alias("a"), F.col("best.node").alias("b")).where("a <> b").distinct()
        stars = scratch.table(stars, f"{name}-stars")
        met = scratch.table(stars.groupBy("b").agg(F.count(F.lit(1)).alias("met")), f"{name}-met")
        stars = join_groups(stars, met, ["b"], "met", int(rows))
        stars = scratch.table(stars, f"{name}-met-stars")
        counts = shingle_counts(sets, scratch) if counts is None else counts
        compared = _with_centres(stars, met, sets).mapInArrow(tidy(_star_comparer(percent, counts)), "a binary, b binary, linked boolean, half int, differ int, keys array<long>, spots array<int>")
        compared = scratch.table(compared, f"{name}-compared")
        links.append(compared.where("linked").select("a", "b"))
        edges = [contracted(_union(links + edges), scratch, f"{name}-parts", ROUNDS)]
        scratch.release()
        spread = compared.select("a", "linked", "half", "differ", F.explode(F.arrays_zip("keys", "spots")).alias("k"))
        spread = spread.select("a", "linked", "half", "differ", F.col("k.keys").alias("bucket"), F.col("k.spots").alias("at"))
        members = spread.select("bucket", F.col("a").alias("node"), F.when(F.col("linked"), "N").when(F.col("at") < F.col("half"), "F").otherwise("X").alias("kind"), (F.col("differ") - F.col("at")).alias("left"), "differ")
        level += 1


def near_duplicates(docs: DataFrame, options: NearOptions | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets is at
    least ``percent``; a component is what links reach, and its id its smallest
    doc_id, which is kept. Texts of fewer words than a shingle have their whole
    sequence as one; null, empty and white-space texts have none and stand alone.

    Equal sets are one class from the start, so copies are never compared.
    Classes that meet in buckets of equal bands are compared as in
    ``linked_components``, which loses no link between them. Rows that repeat a doc_id are documents of their own,
    and all those of a component's smallest doc_id are kept. Rows with a null
    doc_id join the rows of equal sets; those that no row with an id equals have a
    null component_id, are kept and aren't linked further. An empty table gives no
    rows; columns other than doc_id and text are not read.
    """
    return _classified(docs, options or NearOptions()).select("doc_id", "n_shingles", "component_id", "kept")


def _classified(docs: DataFrame, options: NearOptions) -> DataFrame:
    """The rows of ``near_duplicates`` with a hash of the text and, for texts that have shingles, the root of their component."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = scratch.table(texts.mapInArrow(_signer(options, ("doc_id", "mark")), "doc_id long, mark long, n_shingles long, node binary, bands array<long>"), "signed")
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = scratch.table(classes, "classes")

    in_bands = classes.select("node", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members"))
    buckets = scratch.table(buckets.where("low <> high").select("band", "members"), "buckets")
    total = int(buckets.agg(F.sum("members")).first()[0] or 0)
    members = scratch.table(join_groups(in_bands, buckets, ["band"], "members", total).select(F.col("band").alias("bucket"), "node"), "members")

    candidates = members.select("node").distinct()
    wanted = classes.join(candidates, "node", "left_semi").select(F.col("class_id").alias("doc_id")).distinct()
    sets = texts.join(wanted.hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_set_maker(options.shingle), "node binary, shingles binary")
    sets = scratch.table(sets.dropDuplicates(["node"]), "sets")
    scratch.release()
    roots = linked_components(members, sets, classes.select("node", "n"), options.percent, scratch)
    if roots is None:
        roots = members.select("node", F.col("node").alias("root"))
    named = classes.join(roots.hint("merge"), "node", "left").select("node", "class_id", "rows", F.coalesce("root", "node").alias("root"))
    named = scratch.table(named, "named")
    smallest = scratch.table(named.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("classes")), "smallest")
    total = named.count()
    named = scratch.table(join_groups(named, smallest, ["root"], "classes", total).select("node", "rows", "root", "component_id"), "components")
    total = signed.count()
    linked = join_groups(signed.where("node IS NOT NULL").select("doc_id", "mark", "n_shingles", "node"), named, ["node"], "rows", total)
    alone = signed.where("node IS NULL").select("doc_id", "mark", "n_shingles", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "mark", "n_shingles", "root", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, options: NearOptions | None = None) -> DataFrame:
    """One document of each component, with all columns of ``docs`` whatever their names.

    It has the component's smallest doc_id; where several of its rows have that, one
    text of them stays, once. Of texts without shingles one stays for each doc_id,
    null ids counting as one. A text with a null doc_id stays, once, if no row with
    an id has its shingles. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    id_, mark = unused(docs, "id"), unused(docs, "mark")
    plain = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = _classified(docs, options or NearOptions()).where("kept").groupBy("doc_id", "root").agg(F.min("mark").alias(mark))
    kept = scratch.table(kept.select(plain.alias(id_), mark).distinct(), "kept")
    marked = docs.withColumns({id_: plain, mark: F.xxhash64(F.col("text").cast("string"))})
    return marked.join(kept.hint("merge"), [id_, mark], "left_semi").dropDuplicates([id_, mark]).select(*docs.columns)
