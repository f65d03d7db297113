"""SimHash near-duplicate detection with Burkhard-Keller trees.

Every text gets a 64-bit fingerprint.  Equal fingerprints are one point, so
copies cost nothing further.  Points are dealt to shards, and every shard has
its own BK-tree, which is built where the shard's rows are; trees are not
collected for a broadcast, as together they hold all fingerprints.  A shard
reports a spanning forest of its links, never its pairs, and the forests are
joined by :func:`connected_components`.

Shards are cut in two ways.  :func:`simhash_components` links fingerprints within
a few bits and deals by exact agreement of bit blocks: with ``blocks`` blocks, two
fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of them, so
each such choice of blocks is a shard key and no pair within the radius is missed.

Texts that share 0.8 of their shingles differ in some ten bits, more than a
selective choice of blocks allows.  :func:`similar_components` deals by agreement of
least shingle hashes instead: a key is two of them, two texts of similarity s share
one with probability s squared, and there are ``keys`` independent ones.  Keys of one
point alone are dropped before anything else moves.  The trees are searched to
``reach`` bits, and every candidate is compared on the shingle sets, which travel to
the shards with the points.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohesion.llm import _text
from kohesion.llm._components import connected_components
from kohesion.llm._store import parallelism, save
from kohesion.llm.bktree import Forest

SEED = 42


def fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    """The SimHash fingerprint of each text over its shingles, repeats included.

    A-Z are folded; a shingle is ``words`` words joined by a space; a text with
    fewer words has its whole sequence as its shingle; with none, the
    fingerprint is zero.  A bit is set if over half the hashes have it.
    """
    out = np.zeros(len(texts), np.uint64)
    for start, hashes, sizes in _shingles(texts, words):
        out[start : start + len(sizes)] = _majority(hashes, sizes)
    return out


def _shingles(texts: list[str | None], words: int):
    """Yields (index of the first text, shingle hashes of some texts one after another, the count of each text's)."""
    for start, part in _text.chunks(texts):
        found = _text.find_words(part)
        counts = found.counts
        flat = b" ".join(found.data.split())
        sizes = found.ends - found.starts
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        doc = np.repeat(np.arange(len(part)), shingles)
        if not len(doc):
            continue
        begin = np.repeat(np.cumsum(shingles) - shingles, shingles)
        a = found.first[doc] + np.arange(len(doc)) - begin
        z = np.minimum(a + words, found.first[doc + 1]) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(flat[i:j], SEED) for i, j in zip(starts[a].tolist(), ends[z].tolist(), strict=True)), np.uint64, len(a)
        )
        yield start, hashes, shingles


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text without words."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for start, hashes, sizes in _shingles(texts, words):
        for i, own in enumerate(np.split(hashes, np.cumsum(sizes)[:-1])):
            out[start + i] = np.unique(own)
    return out


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of hashes; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(sizes)
    sums = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
    most = (2 * sums > sizes[some, None]).astype(np.uint8)
    out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fingerprint_table(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer, one row per row of ``docs``."""

    def run(batches):
        for batch in _text.pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist(), words).view(np.int64))], ["id", "fp"])

    return _own(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def _shards(blocks: int, radius: int) -> list[tuple[int, ...]]:
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks, at most 64")
    return list(combinations(range(blocks), blocks - radius))


def _masks(blocks: int, radius: int) -> list[int]:
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    return [reduce(int.__or__, (block[i] for i in chosen)) for chosen in _shards(blocks, radius)]


def _shard_points(batches, masks: list[int]):
    """(values, rep, which mask, tree) of the shards of two or more points that one task holds; None without rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    rows = pa.Table.from_batches(held)
    which, values, rep = rows.column("mask").to_numpy(), rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
    key = values & np.array(masks, np.uint64)[which]
    # By id inside a shard, so that forests of different shards have the same roots and their links coincide.
    order = np.lexsort((rep, key, which))
    new = np.ones(len(order), bool)
    new[1:] = (which[order[1:]] != which[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    tree = np.cumsum(new) - 1
    # Most shards hold one point; the others go on.
    shared = np.bincount(tree)[tree] > 1
    tree, order = tree[shared], order[shared]
    return values[order], rep[order], which[order], tree


def shard_forest(batches, radius: int, masks: list[int]):
    """Links of the shards that one task holds, as (a, b) rows of spanning forests."""
    held = _shard_points(batches, masks)
    if held is None:
        return
    values, rep, _, tree = held
    label = Forest(values, tree).connect(radius)
    moved = label != np.arange(len(label))
    pairs = np.unique(np.stack([rep[moved], rep[label[moved]]]), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def link_fingerprints(points: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) between the ``rep`` ids of ``points(fp, rep)`` within ``radius`` bits, enough to connect all that are linked; fingerprints differ."""
    masks = _masks(blocks, radius)
    keyed = points.withColumn("mask", F.explode(F.array(*[F.lit(i) for i in range(len(masks))])))
    bits = F.element_at(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]), F.col("mask") + 1)
    shard: Column = F.xxhash64("mask", F.col("fp").bitwiseAND(bits))
    # A shard stays whole in a task; a task holds an even share of the shards.  Its key is not shuffled.
    dealt = keyed.repartition(parallelism(points.sparkSession), shard).select("mask", "fp", "rep")
    return dealt.mapInArrow(lambda batches: shard_forest(batches, radius, masks), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for each row of ``docs``; fingerprints link within ``radius`` bits.

    ``component`` is the smallest id that links reach, itself included.  Null
    and empty texts have fingerprint zero and link like any other.  A row with
    a null id gets its fingerprint, links with nothing and has a null
    component.  Rows that repeat an id are kept, each with its fingerprint;
    their links are those of the id.  An empty table gives an empty result.
    """
    prints = save(fingerprint_table(docs, words, id_col, text_col), "simhash")
    known = prints.filter("id is not null")
    points = save(known.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-points")
    classes = _classes(known, points, ["fp"], link_fingerprints(points, radius, blocks))
    joined = prints.join(classes.withColumnRenamed("fp", "point"), F.col("fp") == F.col("point"), "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def _classes(known: DataFrame, points: DataFrame, point: list[str], links: DataFrame) -> DataFrame:
    """(point, component) of the ``points``, from ``links`` between their ``rep`` ids; ``known`` has an id and its point per row."""
    # An id with several texts joins the points of all of them.
    several = known.distinct().groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    own = known.join(several, "id").join(points, point).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.union(own), "simhash-links")
    of_point = points.join(found, points["rep"] == found["node"], "left")
    return save(of_point.select(*point, F.coalesce("component", "rep").alias("component")), "simhash-classes")


# ---------------------------------------------------------------- similarity of shingle sets


def _least(hashes: np.ndarray, sizes: np.ndarray, keys: int) -> np.ndarray:
    """``keys`` columns, each a hash of two least values of the shingles under hash functions of its own; of no shingles, the same for all."""
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((len(sizes), keys), np.uint64)
    for k in range(keys):
        for half in (2 * k, 2 * k + 1) if len(some) else ():
            least = np.minimum.reduceat(_text.mix(hashes + np.uint64((half + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), starts)
            out[some, k] = out[some, k] * np.uint64(0x9E3779B97F4A7C15) + least
        out[:, k] = _text.mix(out[:, k] + np.uint64(k))
    return out


def _digest(shingles: np.ndarray) -> int:
    """A hash of sorted distinct shingle hashes; zero for none."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0


def similarity_points(docs: DataFrame, words: int, keys: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, fp, keys): a 64-bit hash of the shingle set, the fingerprint and the shard keys of each row."""

    def run(batches):
        for batch in _text.pieces(batches):
            texts = batch.column(1).to_pylist()
            fp, least, digest = np.zeros(len(texts), np.uint64), np.zeros((len(texts), keys), np.uint64), np.zeros(len(texts), np.uint64)
            least[:] = _least(np.zeros(0, np.uint64), np.zeros(1, np.int64), keys)
            for start, hashes, sizes in _shingles(texts, words):
                own = slice(start, start + len(sizes))
                fp[own], least[own] = _majority(hashes, sizes), _least(hashes, sizes, keys)
                digest[own] = [_digest(np.unique(part)) for part in np.split(hashes, np.cumsum(sizes)[:-1])]
            lists = pa.ListArray.from_arrays(np.arange(0, least.size + 1, keys, dtype=np.int32), pa.array(least.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest.view(np.int64)), pa.array(fp.view(np.int64)), lists], ["id", "digest", "fp", "keys"])

    return _own(docs, id_col, text_col).mapInArrow(run, "id long, digest long, fp long, keys array<long>")


def _set_table(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, digest, shingles) of the texts of the ids ``wanted(rep)``: the sorted distinct shingle hashes as bytes."""

    def run(batches):
        for batch in _text.pieces(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            digest = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "digest", "shingles"])

    texts = _own(docs, id_col, text_col).withColumnRenamed("id", "rep").join(wanted, "rep", "left_semi")
    return texts.mapInArrow(run, "rep long, digest long, shingles binary")


def similar_enough(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted distinct arrays have at least this Jaccard similarity; two empty ones are equal."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(large):
        return True
    if len(small) < similarity * len(large) - 1e-9:
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


#: Bytes of points that a task holds at once, unless one shard has more.
SHARD_BYTES = 32 << 20


def _whole_shards(batches):
    """Tables of some whole shards from rows that come sorted by their first column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < SHARD_BYTES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column(0).to_numpy()
        # The last shard may go on in the next batch.
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = pa.Table.from_batches(rows.slice(cut).to_batches()).to_batches()
        size = sum(b.nbytes for b in held) if cut else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _trees(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of the tree of each row) of rows sorted by shard."""
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def shard_classes(batches, reach: int):
    """(shard, rep, digest, fp) of the points of (key, rep, digest, fp) rows that have another within ``reach`` bits in their shard.

    What such steps connect is a shard of its own, called by a hash of its points, so
    shards of several keys that hold the same points have the same name.
    """
    for rows in _whole_shards(batches):
        rep, values = rows.column("rep").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        _, tree = _trees(rows.column("key").to_numpy())
        label = Forest(values, tree).connect(reach)
        own = _text.mix(rep.view(np.uint64) ^ _text.mix(rows.column("digest").to_numpy().view(np.uint64)))
        name = np.zeros(len(label), np.uint64)
        np.add.at(name, label, own)
        several = np.bincount(label, minlength=len(label))[label] > 1
        shard = pa.array(_text.mix(name)[label][several].view(np.int64))
        rest = rows.filter(pa.array(several)).select(["rep", "digest", "fp"]).combine_chunks()
        yield pa.RecordBatch.from_arrays([shard, *[c.combine_chunks() for c in rest.columns]], ["shard", "rep", "digest", "fp"])


def shard_similar(batches, reach: int, similarity: float):
    """Links (a, b) of spanning forests of the shards of (shard, rep, fp, shingles) rows, which come sorted by shard."""
    for rows in _whole_shards(batches):
        yield _link_shards(rows, reach, similarity)


def _link_shards(rows: pa.Table, reach: int, similarity: float) -> pa.RecordBatch:
    key, rep, values = rows.column(0).to_numpy(), rows.column("rep").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
    new, tree = _trees(key)
    # A tree's points by their distance to its majority, so that what a dense group has in common comes first and joins it at once.
    centre = _majority(values, np.diff(np.append(new, len(key))))
    order = np.lexsort((rep, np.bitwise_count(values ^ centre[tree]), tree))
    blob = rows.column("shingles").combine_chunks()
    # A binary array's own buffers, cut where rows are.
    sets = [np.frombuffer(blob[int(i)].as_buffer(), np.uint64) for i in order]
    forest = Forest(values[order], tree[order])
    label = forest.connect(reach, lambda a, b: similar_enough(sets[a], sets[b], similarity))
    own = rep[order]
    moved = label != np.arange(len(label))
    pairs = np.unique(np.stack([own[moved], own[label[moved]]]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, keys: int = 6, reach: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) for each row of ``docs``; texts link if their shingle sets have at least this Jaccard similarity.

    ``component`` is the smallest id that links reach, itself included.  A pair of
    similarity s is missed if it shares none of the keys, (1 - s * s) ** keys, or its
    fingerprints differ in over ``reach`` bits.  Null and empty texts are equal to each
    other.  A row with a null id links with nothing and has a null component.  Rows
    that repeat an id have the links of the id.  An empty table gives an empty result.
    """
    prints = save(similarity_points(docs, words, keys, id_col, text_col), "similar")
    known = prints.filter("id is not null").select("id", "digest", "fp")
    points = save(prints.filter("id is not null").groupBy("digest", "fp").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "similar-points")
    keyed = points.select("rep", "digest", "fp", F.posexplode("keys").alias("place", "key")).withColumn("key", F.xxhash64("place", "key")).drop("place")
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    parts = parallelism(docs.sparkSession)
    near = shared.repartition(parts, "key").sortWithinPartitions("key").select("key", "rep", "digest", "fp").mapInArrow(lambda batches: shard_classes(batches, reach), "shard long, rep long, digest long, fp long")
    shards = save(near.distinct(), "similar-shards")
    # Written, so that its size is known before the texts are joined: they are shuffled only if it is too large to broadcast.
    wanted = save(shards.select("rep").distinct(), "similar-wanted")
    sets = _set_table(docs, wanted, words, id_col, text_col)
    if not known.groupBy("id", "digest").count().filter("count > 1").isEmpty():
        # Rows that repeat an id with the same shingles are one.
        sets = sets.groupBy("rep", "digest").agg(F.min("shingles").alias("shingles"))
    dealt = shards.join(sets, ["rep", "digest"]).repartition(parts, "shard").sortWithinPartitions("shard").select("shard", "rep", "fp", "shingles")
    links = dealt.mapInArrow(lambda batches: shard_similar(batches, reach, similarity), "a long, b long")
    classes = _classes(known, points.drop("keys"), ["digest", "fp"], links)
    joined = prints.select("id", "digest", "fp").join(classes, ["digest", "fp"], "left")
    return joined.select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def hex_fingerprint(fp: str = "fp") -> Column:
    """A signed 64-bit integer as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, keys: int = 6, reach: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component of :func:`similar_components` the row with the smallest id stays.

    Columns are those of ``docs``.  Rows with a null id all stay.  Of rows that
    repeat the id that stays, the least by its columns stays.
    """
    classes = save(similar_components(docs, words, similarity, keys, reach, id_col, text_col), "similar-components")
    free = _free_names(docs.columns, 2)
    dropped = classes.filter("id <> component").select(F.col("id").alias(free[1]))
    repeated = save(classes.filter("id = component").groupBy(F.col("id").alias(free[1])).count().filter("count > 1").select(free[1]), "simhash-repeats")
    gone = save(dropped.union(repeated).distinct(), "simhash-dropped")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(free[0]), F.col(f"`{id_col}`").cast("long").alias("id"))
    same = F.col("id") == F.col(free[1])
    kept = packed.join(gone, same, "left_anti").select(free[0])
    if not repeated.isEmpty():
        one = packed.join(repeated, same, "left_semi").groupBy("id").agg(F.min(free[0]).alias(free[0]))
        kept = kept.union(one.select(free[0]))
    return kept.select(f"{free[0]}.*")


def _free_names(columns: list[str], n: int) -> list[str]:
    """Names that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    return [name for name in (f"__own{i}" for i in range(len(columns) + n)) if name not in taken][:n]
