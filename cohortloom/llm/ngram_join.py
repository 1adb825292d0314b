"""N-gram Jaccard join: MinHash banding finds pairs, full shingle sets verify them.

Documents with one set of word shingles form a class and travel as one. ``BANDS`` x ``ROWS`` MinHash
values per class are hashed band by band; classes that share a band hash form a bucket. With 40 bands
of 8 rows a pair at similarity s meets with probability 1 - (1 - s**8)**40: 0.9994 at 0.8, above
0.99999 from 0.85 on. Buckets with the same members count once. Members of a bucket bring their full
shingle sets and all pairs are verified inside the tile they meet in, never written out: a tile gives
link counts per class and enough edges to connect what is linked.

A bucket above ``TILE_BYTES`` or ``TILE_MEMBERS`` is dense. Dense buckets that share members form a
cluster, and the cluster a pivot: the shingles that most of a few of its members hold. From |x & y| >=
|x & P| + |y & P| - |P| it follows that any two members close enough to the pivot (its core) are linked. Their
links are one sum over the core, without a pair looked at, and no set of theirs moves for the sake of
another's. Only members outside the core are cut into blocks, and every two of these blocks, and each with
every block of the core, meet in a tile of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import checkpointed
from . import text as T
from .shared import (
    arrow_map,
    components,
    join_documents,
    keyed,
    release,
    small_batches,
    whole_groups,
)

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 8
TILE_BYTES, TILE_MEMBERS = 4 << 20, 2048
# members whose shingles make a cluster's pivot; it decides about work, never about links
PIVOT_MEMBERS = 9
ROWS_BYTES = 2 << 20
_SEED = 20_240_607

SIGNED = "doc_id long, text_key long, set_a long, set_b long, shingles int, bands array<long>"
MEMBERS = (
    "bucket long, one int, two int, block int, class long, copies long, home long, core boolean, "
    "buckets binary, shingles binary"
)
LINKS = "class long, other long, links long"


def _hashers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    n = bands * rows
    factor = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return factor, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def band_hashes(values: np.ndarray, border: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty sets ``values[border[i]:border[i + 1]]``."""
    factor, shift = _hashers(bands, rows)
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(border) - 1, bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(border) - 1, b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            # two 32-bit halves keep the 64-bit hash's randomness in a 32-bit product
            hashed = (low * factor[r] + shift[r]) ^ (high * factor[-1 - r])
            acc = T.mix(acc ^ np.minimum.reduceat(hashed, border[:-1]).astype(np.uint64))
        out[:, b] = acc
    return out


def signatures(own: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Set hash, set size and band hashes of every text that has a word."""

    def of_batch(batch):
        for group in T.groups(batch.column("text")):
            found = T.words(group)
            values, texts = T.shingles(found, width)
            values, border = T.distinct_per_text(values, texts, group.hi - group.lo)
            has = np.flatnonzero(np.diff(border))
            if not len(has):
                continue
            edges = np.concatenate((border[has], [len(values)]))
            # order-free set hashes: sums of two independent mixes
            set_a = np.add.reduceat(T.mix(values), edges[:-1])
            set_b = np.add.reduceat(T.mix(values ^ np.uint64(0x5851F42D4C957F2D)), edges[:-1])
            hashed = T.signed(band_hashes(values, edges, bands, rows))
            rows_ = pa.array(has + group.lo)
            yield pa.table(
                {
                    "doc_id": batch.column("doc_id").take(rows_),
                    "text_key": batch.column("text_key").take(rows_),
                    "set_a": T.signed(set_a),
                    "set_b": T.signed(set_b),
                    "shingles": np.diff(edges).astype(np.int32),
                    "bands": pa.ListArray.from_arrays(
                        np.arange(0, hashed.size + 1, bands, dtype=np.int32), hashed.ravel()
                    ),
                }
            )

    return arrow_map(own, of_batch, SIGNED)


def _buckets(classes: DataFrame, tile_bytes: int) -> DataFrame:
    """(bucket, class, shingles, dense): buckets of two or more classes, one of those with equal members."""
    rows = checkpointed(
        classes.select("class", "shingles", F.explode("bands").alias("bucket"))
    )
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        # cannot overflow, however many members a bucket has
        F.bit_xor(F.xxhash64("class")).alias("who"),
        F.sum(F.col("shingles").cast("long") * 8).alias("bytes"),
    )
    sizes = sizes.where("members > 1").groupBy("who", "members").agg(
        F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes")
    )
    dense = (F.col("bytes") > tile_bytes) | (F.col("members") > TILE_MEMBERS)
    return checkpointed(rows.join(sizes.select("bucket", dense.alias("dense")), "bucket"))


def _sets(batch: pa.RecordBatch, width: int):
    """(row, shingle set) of every text of a batch."""
    for group in T.groups(batch.column("text")):
        values, texts = T.shingles(T.words(group), width)
        values, border = T.distinct_per_text(values, texts, group.hi - group.lo)
        for i in range(group.lo, group.hi):
            yield i, values[border[i - group.lo] : border[i - group.lo + 1]]


def _texts(own: DataFrame, chosen: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts of the documents that stand for the ``chosen`` classes, with the columns of ``chosen``."""
    who = classes.select("class", F.col("who.doc_id").alias("doc_id"), F.col("who.text_key").alias("text_key"))
    # texts are dealt by document at every size; a small list must not be broadcast on one day only
    return join_documents(own, checkpointed(chosen.join(who, "class")).hint("merge"), "inner")


def _clusters(dense: DataFrame) -> DataFrame:
    """(class, home): the members of dense buckets that are connected through members have one home."""
    low = checkpointed(dense.groupBy("class").agg(F.min("bucket").alias("low")))
    edges = dense.join(low, "class").where("bucket <> low").select(F.col("bucket").alias("a"), F.col("low").alias("b"))
    joined = components(edges.distinct()).withColumnsRenamed({"node": "low", "label": "home"})
    return checkpointed(low.join(joined, "low", "left").select("class", F.coalesce("home", "low").alias("home")))


def _core(own: DataFrame, homes: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(class, home, core): whether a member is so close to its cluster's pivot that all such are linked."""
    few = homes.groupBy("home", F.pmod(F.xxhash64("class"), F.lit(PIVOT_MEMBERS))).agg(F.min("class").alias("class"))
    few = checkpointed(few.select("home", "class"))

    def spread(batch):
        rows, values = zip(*_sets(batch, width), strict=True) if batch.num_rows else ((), ())
        if rows:
            take = pa.array(np.repeat(rows, [len(v) for v in values]), pa.int64())
            yield pa.table({"home": batch.column("home").take(take), "value": T.signed(np.concatenate(values))})

    held = arrow_map(_texts(own, few, classes), spread, "home long, value long")
    most = few.groupBy("home").agg(F.count(F.lit(1)).alias("asked"))
    pivots = held.groupBy("home", "value").count().join(most, "home").where("2 * count > asked")
    pivots = checkpointed(pivots.groupBy("home").agg(F.sort_array(F.collect_list("value")).alias("pivot")))

    def near(batch):
        out = []
        pivot = batch.column("pivot")
        for i, mine in _sets(batch, width):
            known = pivot[i].values.to_numpy() if pivot[i].is_valid else np.zeros(0, np.int64)
            both = len(np.intersect1d(T.signed(mine), known, assume_unique=True))
            # sure of x and y if their sum reaches (1 + threshold) * |P|
            reach = (1 + threshold) * both - threshold * len(mine)
            out.append(len(known) > 0 and reach >= (1 + threshold) * len(known) / 2 + 1e-6)
        yield pa.table({"class": batch.column("class"), "home": batch.column("home"), "core": pa.array(out, pa.bool_())})

    asked = homes.join(pivots, "home", "left")
    return checkpointed(arrow_map(_texts(own, asked, classes), near, "class long, home long, core boolean"))


def _placed(buckets: DataFrame, cores: DataFrame | None, tile_bytes: int) -> DataFrame:
    """(class, home, core, buckets): per class the buckets it is in and their blocks outside and inside the core."""
    if cores is None:
        core, home = F.lit(False), F.lit(0).cast("long")
        rows = buckets.withColumns({"home": home, "core": core})
    else:
        rows = buckets.join(cores, "class", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    inside = F.col("dense") & F.col("core")
    size = F.col("shingles").cast("long") * 8

    def blocks(of):
        n, data = F.count(F.when(of, 1)), F.coalesce(F.sum(F.when(of, size)), F.lit(0))
        return F.ceil(F.greatest(n / TILE_MEMBERS, data / tile_bytes)).cast("int")

    sizes = rows.groupBy("bucket").agg(blocks(~inside).alias("outer"), blocks(inside).alias("inner"))
    rows = rows.join(sizes, "bucket").where("outer > 0")
    return rows.groupBy("class").agg(
        F.first("home").alias("home"),
        F.first("core").alias("core"),
        F.collect_list(F.struct("bucket", inside.alias("inside"), "outer", "inner")).alias("buckets"),
    )


def _tiles_of(name: int, inside: bool, outer: int, inner: int) -> tuple[int, list[int]]:
    """The block of a member, and the blocks it meets: all outer ones, and from outside the inner ones."""
    if inside:
        return outer + hash_block(name, inner), list(range(outer))
    return hash_block(name, outer), list(range(outer + inner))


def _members(docs: DataFrame, width: int) -> DataFrame:
    """One row per class and tile it takes part in, with its shingle set."""
    tile = ("bucket", "one", "two", "block", "row", "buckets", "shingles")

    def table(batch, out):
        take = pa.array(out.pop("row"), pa.int64())
        return pa.table(
            {
                "bucket": pa.array(out["bucket"], pa.int64()),
                **{n: pa.array(out[n], pa.int32()) for n in ("one", "two", "block")},
                **{n: batch.column(n).take(take) for n in ("class", "copies", "home", "core")},
                "buckets": pa.array(out["buckets"], pa.binary()),
                "shingles": pa.array(out["shingles"], pa.binary()),
            }
        )

    def of_batch(batch):
        out, held = {n: [] for n in tile}, 0
        for i, values in _sets(batch, width):
            data, name = values.tobytes(), batch.column("class")[i].as_py()
            mine = batch.column("buckets")[i].as_py()
            known = np.sort(np.array([b["bucket"] for b in mine], np.int64)).tobytes()
            for b in mine:
                block, others = _tiles_of(name, b["inside"], b["outer"], b["inner"])
                for other in others:
                    row = (b["bucket"], min(block, other), max(block, other), block, i, known, data)
                    for n, x in zip(tile, row, strict=True):
                        out[n].append(x)
                    held += len(data) + len(known)
                    if held >= ROWS_BYTES:
                        yield table(batch, out)
                        out, held = {n: [] for n in tile}, 0
        if held:
            yield table(batch, out)

    return arrow_map(docs, of_batch, MEMBERS)


def hash_block(name: int, blocks: int) -> int:
    return int(T.mix(np.array([name], np.int64).view(np.uint64))[0] % np.uint64(blocks))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the shingles that two sets or more share."""
    n = len(sets)
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    common = counts[place] > 1
    owner, place = owner[common], column[place[common]]
    found = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    step = max(1, (8 << 20) // n)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        part = slice(*np.searchsorted(place, [lo, lo + step]))
        dense = np.zeros((n, min(step, int(place[-1]) + 1 - lo)), np.float32)
        dense[owner[part], place[part] - lo] = 1
        found += dense @ dense.T
    return found


def forest(linked: np.ndarray) -> np.ndarray:
    """Least reachable index of each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(bucket: int, across: bool, block, names, copies, cores, known, sets, threshold):
    """Links of one tile: (class, a class it is connected to, weight of links first met here)."""
    size = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    # a tile of two blocks counts the pairs across, that of one block the pairs within
    mine = linked & (block[:, None] != block[None, :]) if across else linked.copy()
    # the links inside a core are counted all at once
    for home in np.unique(cores[cores >= 0]):
        part = np.flatnonzero(cores == home)
        mine[np.ix_(part, part)] = False
    # a pair that shares a smaller bucket is counted there
    earlier = [k[k < bucket] for k in known]
    owner = np.repeat(np.arange(len(known)), [len(e) for e in earlier])
    values = np.concatenate(earlier)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for part in np.split(owner, np.flatnonzero(values[1:] != values[:-1]) + 1) if len(values) else []:
        if len(part) > 1:
            mine[np.ix_(part, part)] = False
    links = mine @ copies
    root = names[forest(linked)]
    use = (links > 0) | (root != names)
    return names[use], root[use], links[use]


def _tiles(members: DataFrame, threshold: float) -> DataFrame:
    keys = ["bucket", "one", "two"]

    def run(batches):
        for table in whole_groups(batches, keys):
            bucket, one, two = (table[k].to_numpy() for k in keys)
            cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
            cut = np.concatenate(([0], cut, [len(bucket)]))
            name, copies, block, home = (table[k].to_numpy() for k in ("class", "copies", "block", "home"))
            # a number per home of the table, or none outside a core
            homes = np.where(table["core"].to_numpy(), np.unique(home, return_inverse=True)[1], -1)
            known, sets = table["buckets"].to_pylist(), table["shingles"].to_pylist()
            found = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                names, pick = np.unique(name[lo:hi], return_index=True)
                pick = pick + lo
                if len(pick) > 1:
                    found.append(
                        _verified(
                            bucket[lo],
                            one[lo] != two[lo],
                            block[pick],
                            names,
                            copies[pick],
                            homes[pick],
                            [np.frombuffer(known[i], np.int64) for i in pick],
                            [np.frombuffer(sets[i], np.uint64) for i in pick],
                            threshold,
                        )
                    )
            found = [f for f in found if f is not None]
            if found:
                a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch({"class": a, "other": b, "links": n.astype(np.int64)})
            del table
            release()

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return small_batches(dealt).mapInArrow(run, LINKS)


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, copy_of, n_links.

    Shingles are ``width`` consecutive words, unchanged; a text with fewer words has one shingle of all
    its words. Two documents are linked if their shingle sets have a Jaccard similarity of at least
    ``threshold``. ``class_id`` is the least doc_id connected through links, ``copy_of`` the least
    doc_id with the same shingle set, ``n_links`` the number of other documents linked (copies
    included). Texts without a word (null, empty, white space) link to nothing and are their own class;
    so is a class whose ids are all null (null class_id). Repeated rows are copies. Other columns of
    ``docs`` are ignored.
    """
    own = keyed(docs)
    signed = checkpointed(signatures(own, width, bands, rows))
    # every member has the same bands; the least (id, text) stands for the class
    classes = checkpointed(
        signed.groupBy("set_a", "set_b").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("doc_id").alias("copy_of"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("who"),
            F.first("bands").alias("bands"),
            F.first("shingles").alias("shingles"),
        ).withColumn("class", F.xxhash64("set_a", "set_b"))
    )
    buckets = _buckets(classes, tile_bytes)
    dense = buckets.where("dense").select("bucket", "class")
    cores = None
    if not dense.isEmpty():
        cores = _core(own, _clusters(checkpointed(dense)), classes, width, threshold)
    placed = _placed(buckets, cores, tile_bytes).join(classes.select("class", "copies"), "class")
    links = _tiles(_members(_texts(own, placed, classes), width), threshold)
    if cores is not None:
        inside = cores.where("core").join(classes.select("class", "copies"), "class")
        whole = inside.groupBy("home").agg(F.sum("copies").alias("all"), F.min("class").alias("other"))
        linked = inside.join(whole, "home").select("class", "other", (F.col("all") - F.col("copies")).alias("links"))
        links = links.unionByName(linked)
    links = checkpointed(links)
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    connected = components(links.select(F.col("class").alias("a"), F.col("other").alias("b")))
    grouped = counts.join(connected.withColumnRenamed("node", "class"), "class", "left")
    slim = classes.select("set_a", "set_b", "class", "copies", "copy_of")
    slim = slim.join(grouped, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = slim.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    slim = slim.join(least, "label").select(
        "set_a",
        "set_b",
        "class_id",
        "copy_of",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "label",
    )
    out = signed.select("doc_id", "text_key", "set_a", "set_b").join(slim, ["set_a", "set_b"])
    out = out.select("doc_id", "text_key", "class_id", "copy_of", "n_links", F.col("label").alias("group"))
    wordless = join_documents(
        own.select("doc_id", "text_key"), signed.select("doc_id", "text_key").distinct(), "left_anti"
    )
    return out.unionByName(
        wordless.select(
            "doc_id",
            "text_key",
            F.col("doc_id").alias("class_id"),
            F.col("doc_id").alias("copy_of"),
            F.lit(0).cast("long").alias("n_links"),
            F.lit(None).cast("long").alias("group"),
        )
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each linked group: the least (doc_id, text), nulls last.

    Texts without a word belong to no group and all stay. Of rows equal in id and text one stays.
    """
    found = near_duplicates(docs, **options)
    # one small row per group decides; a group of copies is reduced before it is shuffled
    best = found.where("group is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("who")
    )
    stay = best.select("who.doc_id", "who.text_key")
    stay = stay.unionByName(found.where("group is null").select("doc_id", "text_key").distinct())
    rows = docs.withColumns(
        {"__d": F.col("doc_id").cast("long"), "__k": F.xxhash64(F.col("text"))}
    )
    stay = checkpointed(stay.withColumnsRenamed({"doc_id": "__sd", "text_key": "__sk"}))
    rows = rows.join(stay, F.col("__d").eqNullSafe(F.col("__sd")) & (F.col("__k") == F.col("__sk")), "left_semi")
    worded = rows.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    wordless = rows.where(~F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return worded.dropDuplicates(["__d", "__k"]).unionByName(wordless).drop("__d", "__k")
