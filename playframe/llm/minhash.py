"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters the shingles, the
second, shifted circularly by k, orders them for coordinate k, whose value is the
least place it gives to a shingle of the document.

Documents with one set of shingles are one vertex. Vertices meet in buckets: one
for each band and each value of its coordinates. Links are found in two rounds and
always confirmed on the full sets:

* every member of a bucket against the bucket's smallest, one pair a member;
* in buckets whose members aren't all connected yet, members outside the largest
  component against all others. They are cut into blocks of ``BLOCK``, and the
  bucket's members pass by each block, so that a large bucket is many tasks and its
  pairs stay inside them. They pass with their sketches first; full sets are
  fetched for the rows of a block that may be linked to another there.

No bucket is capped. A pair at the threshold shares a bucket with probability
1 - (1 - 0.75 ** 4) ** 32, all but 5 in a million.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, text_or_empty, whole_row, worker_state, written
from .components import components
from .slots import marked, slot, slot_bits

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Rows of a bucket in one block, and rows that pass by a block in one task.
BLOCK, STRIPE = 512, 4096
#: Of the signature's low bytes, how many must agree before the full sets are compared:
#: at the threshold 96 of 128 are expected with a deviation of 5, so 56 is beyond eight deviations.
LEAST_AGREEING = 56
#: Bit tables of rows to come back to have this many times the slots that ``slots`` has at least, so that few other rows come along.
SPARSE = 4
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Word hashes a Python worker keeps, some 150 bytes each, and the longest word kept.
MEMO_WORDS, MEMO_BYTES = 200_000, 64
CHUNK_BYTES = 1 << 20
#: Odd multipliers that combine the words of a shingle, and seeds of the two permutations.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
SCATTER, ORDER = 0x51ED270B, 0x2545F491


def _place(x: np.ndarray) -> np.ndarray:
    """A permutation of the unsigned 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; a shorter text is one shingle, an empty one has none."""
    words = WORDS.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    memo = worker_state("shingles").setdefault("word_hashes", {})
    if len(memo) > MEMO_WORDS:
        memo.clear()
    try:
        codes = [memo[w] for w in words]
    except KeyError:
        new = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in set(words) if w not in memo}
        codes = [new[w] if w in new else memo[w] for w in words]
        memo.update((w, h) for w, h in new.items() if len(w) <= MEMO_BYTES)
    h = np.array(codes, np.uint64)
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = (s ^ h[i : i + len(s)]) * np.uint64(MULTIPLIERS[i % len(MULTIPLIERS)])
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``coordinates`` unsigned 32-bit numbers for each non-empty set."""
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.intp)
    scattered = _place((every ^ (every >> np.uint64(32))).astype(np.uint32) ^ np.uint32(SCATTER))
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_place(scattered + np.uint32((ORDER + k) & 0xFFFFFFFF)), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each row and band; equal keys mean one band and equal coordinates."""
    rows = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ rows[:, :, i]) * np.uint64(MULTIPLIERS[i])
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets, in chunks of about ``CHUNK_BYTES`` of text."""
    for b in slices(batches):
        ids, sets, held = [], [], 0
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(row)
            sets.append(shingle_set(text))
            held += len(text or "")
            if held >= CHUNK_BYTES:
                yield ids, sets
                ids, sets, held = [], [], 0
        if ids:
            yield ids, sets


def _binary(array: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in array], pa.binary())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its set's size and key, and its band keys (none for an empty set)."""
    for ids, sets in _chunks(batches):
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [[]] * len(ids)
        if full:
            for i, own in zip(full, band_keys(signatures([sets[i] for i in full])).tolist(), strict=True):
                keys[i] = own
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "n_shingles", "set_key", "bands"])


def _detailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row with shingles its set's key and size, the full set, the low bytes of its signature and its band keys, as bytes."""
    for _, sets in _chunks(batches):
        own = [s for s in sets if len(s)]
        if not own:
            continue
        signature = signatures(own)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
        columns = [pa.array(digests, pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary()), _binary(signature.astype(np.uint8)), _binary(band_keys(signature))]
        yield pa.RecordBatch.from_arrays(columns, names=["set_key", "n_shingles", "shingles", "sketch", "keys"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, set of a, set of b) that are linked."""
    for b in slices(batches):
        yield _links([(x, y) for x, y, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64))])


def _meetings(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with the rows of their block that they may be linked to, by falling agreement, from rows (bucket, i, stripe, block, node, label, n_shingles, sketch, keys, ...), those of block i first.

    Block i holds members outside the bucket's largest component; the bucket's members
    pass by them once, in stripes of about ``STRIPE``, a chunk of rows at a time. Two
    members of small components meet where the block of the one with the smaller block
    number is, and a pair in several buckets belongs to the first band.
    """
    own: list[tuple] = []

    def arrays(part: list[tuple]) -> tuple:
        nodes, labels, sizes = np.array([r[4:7] for r in part]).T
        sketch = np.frombuffer(b"".join(r[7] for r in part), np.uint8).reshape(len(part), -1)
        keys = np.frombuffer(b"".join(r[8] for r in part), np.int64).reshape(len(part), -1)
        return nodes, labels, sizes, sketch, keys

    def meet(part: list[tuple], base: tuple) -> Iterator[tuple[tuple, list[tuple]]]:
        if not part:
            return
        nodes, labels, sizes, sketch, keys = base
        *_, sketches, every_key = arrays(part)
        for r, one, k in zip(part, sketches, every_key, strict=True):
            bucket, i, _, block, node, label, size = r[:7]
            band = int(np.flatnonzero(k == bucket)[0])
            able = (100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size)) & (labels != label)
            if block == i:
                able &= nodes > node
            elif 0 <= block < i:
                continue
            other = np.flatnonzero(able)
            agreeing = np.count_nonzero(sketch[other] == one, axis=1)
            other, agreeing = other[agreeing >= LEAST_AGREEING], agreeing[agreeing >= LEAST_AGREEING]
            first = np.argmax(keys[other] == k, axis=1) == band
            other, agreeing = other[first], agreeing[first]
            if len(other):
                yield r, [own[y] for y in other[np.argsort(-agreeing, kind="stable")].tolist()]

    part: list[tuple] = []
    base = None
    for r in rows:
        if r[1] == r[3]:
            own.append(r)
            continue
        if not own:  # the hash has dealt nothing to this block
            return
        base = base or arrays(own)
        part.append(r)
        if len(part) == BLOCK:
            yield from meet(part, base)
            part = []
    base = base or arrays(own)
    if own[0][2] == 0:
        yield from meet(own, base)
    yield from meet(part, base)


def _block_members(rows: Iterator[tuple]) -> list[tuple]:
    """The rows of a block and stripe that may be linked to another, without their sketches: only these need their full sets."""
    found = {}
    for r, others in _meetings(rows):
        found |= {x[4]: x[:6] for x in (r, *others)}
    return list(found.values())


def _block_links(rows: Iterator[tuple]) -> list[tuple[int, int]]:
    """Links that join components, from rows as ``_meetings`` takes them and the full set.

    A found link joins its two components, so further pairs of these are not compared.
    """
    joined: dict[int, int] = {}
    found = []

    def root(label: int) -> int:
        while joined.get(label, label) != label:
            label = joined[label]
        return label

    for r, others in _meetings(rows):
        s = np.frombuffer(r[9], np.uint64)
        for o in others:
            a, b = root(r[5]), root(o[5])
            if a != b and linked(s, np.frombuffer(o[9], np.uint64)):
                joined[max(a, b)] = min(a, b)
                found.append((r[4], o[4]))
    return found


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in slices(batches))
    for _, own in itertools.groupby(rows, key=lambda r: r[:3]):
        yield own


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _by_block(batches):
        found = _block_members(own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["bucket", "i", "stripe", "block", "node", "label"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _by_block(batches):
        found = _block_links(own)
        if found:
            yield _links(found)


def _marks(ids: DataFrame, bits: int) -> DataFrame:
    """The slots of the ids given, as a bit table of bounded size (see ``slots``)."""
    at = ids.select(slot(bits, F.col("doc")).alias("slot")).distinct()
    return at.groupBy(F.shiftright("slot", 6).alias("wanted_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63L))")).alias("wanted_mask"))


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles``, ``component_id``, ``kept`` and ``first`` (true for one row of each component).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set
    holds the distinct runs of five, or the whole text where it is shorter. Texts
    without words, null texts included, are linked with nothing. ``component_id`` is
    the smallest id reachable over links (null ids are passed over; null where all
    are null), ``kept`` says whether the row's id is that one. Rows repeated whole
    are all ``kept`` but only one is ``first``. An empty table gives no rows. Only the
    id and the text are read.
    """
    docs = df.select(F.col(f"`{row_id}`").cast("long").alias("doc"), text_or_empty(text).alias("text"))
    signed = docs.mapInArrow(_signed, "doc long, n_shingles long, set_key binary, bands array<long>")
    signed = written(signed.withColumn("uid", F.monotonically_increasing_id()))
    full = signed.where("n_shingles > 0")
    vertices = full.groupBy("set_key").agg(F.min_by(F.struct("uid", "doc", "bands"), "uid").alias("v"))
    vertices = written(vertices.select("set_key", F.col("v.uid").alias("node"), F.col("v.doc").alias("doc"), F.col("v.bands").alias("bands")))

    placed = vertices.select("node", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    buckets = written(buckets.withColumnRenamed("bucket", "_bucket"))
    members = written(placed.join(buckets, F.col("bucket") == F.col("_bucket")).drop("_bucket"))

    several = members.select("node").distinct()
    wanted = written(vertices.join(several, "node").select("node", "doc", "set_key"))
    bits = slot_bits(SPARSE * wanted.count())
    marks = written(_marks(wanted, bits))
    again = marked(docs, slot(bits, F.col("doc")), marks, "wanted").where("wanted").select("doc", "text")
    # Equal keys mean equal sets, so any row of a set will do; the join finds its rows where the exchange before has put them.
    detail = again.mapInArrow(_detailed, "set_key binary, n_shingles long, shingles binary, sketch binary, keys binary").withColumnRenamed("set_key", "_set").dropDuplicates(["_set"])
    sets = written(wanted.join(detail, F.col("set_key") == F.col("_set")).select("node", "n_shingles", "shingles", "sketch", "keys"))
    drop(wanted, marks)

    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    of = lambda end: sets.select(F.col("node").alias(f"_{end}"), F.col("shingles").alias(f"set_{end}"))
    pairs = pairs.join(of("b"), F.col("b") == F.col("_b")).join(of("a"), F.col("a") == F.col("_a")).select("a", "b", "set_a", "set_b")
    first = written(pairs.mapInArrow(_confirmed, "a long, b long"))
    labels = components(first)

    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    known = members.join(own, F.col("node") == F.col("_node"), "left").select("bucket", "node", "n", F.coalesce("_label", "node").alias("label"))
    known = written(known)
    parts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("_n"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("_n", "label")).alias("_top"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    largest = largest.select(F.col("bucket").alias("_bucket"), F.col("_top.label").alias("_largest"), F.ceil((F.col("_all") - F.col("_top._n")) / BLOCK).cast("long").alias("blocks"), F.ceil(F.col("_all") / STRIPE).cast("long").alias("stripes"))
    largest = written(largest)
    rows = known.join(largest, F.col("bucket") == F.col("_bucket")).withColumn("small", F.col("label") != F.col("_largest"))
    rows = rows.withColumn("block", F.when(F.col("small"), F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(-1))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every, one = F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1), F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("stripes")))
    rows = rows.withColumn("stripe", F.explode(F.when(F.col("block") == F.col("i"), every).otherwise(one)))
    place = ["bucket", "i", "stripe", "block", "node", "label"]

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """The rows with these columns of their sets, each block and stripe together, rows of the block first."""
        rows = rows.withColumnRenamed("node", "_node").join(sets.select("node", *columns), F.col("_node") == F.col("node")).select(*place, *columns)
        return rows.repartition("bucket", "i", "stripe").sortWithinPartitions("bucket", "i", "stripe", F.col("block") != F.col("i"))

    sketched = ("n_shingles", "sketch", "keys")
    near = written(dealt(rows.select(*place), *sketched).mapInArrow(_narrowed, ", ".join(f"{c} long" for c in place)))
    second = dealt(near, *sketched, "shingles").mapInArrow(_grouped, "a long, b long")
    links = written(first.union(second))
    drop(members, known, sets, labels, buckets, largest, first, near)

    labels = components(links)
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    of_set = vertices.join(own, F.col("node") == F.col("_node"), "left").select(F.col("set_key").alias("_set"), F.coalesce("_label", "node").alias("label"))
    rows = written(full.select("uid", "doc", "n_shingles", "set_key").join(of_set, F.col("set_key") == F.col("_set")).select("uid", "doc", "n_shingles", "label"))
    drop(vertices, links, labels)
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("uid").alias("uid"))
    # Grouped by one column more than joined on, so that both sides have an exchange that Spark can split.
    tops = rows.groupBy("label", F.lit(0).alias("_all")).agg(F.min(order).alias("top")).select(F.col("label").alias("_label"), F.col("top.doc").alias("component_id"), F.col("top.uid").alias("_uid"))
    rows = rows.join(tops, F.col("label") == F.col("_label"))
    out = rows.select(F.col("doc").alias(row_id), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("uid") == F.col("_uid")).alias("first"))
    alone = signed.where("n_shingles = 0").select(F.col("doc").alias(row_id), "n_shingles", F.col("doc").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def drop_near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, less those of a component that aren't its smallest id.

    Rows without words all stay, as they are linked with nothing. Of rows repeated
    whole one stays; rows of one id with unlinked texts all stay. A null id comes
    after all others. An empty table gives no rows.
    """
    own = F.col(f"_row.`{row_id}`")
    keyed = written(df.select(whole_row(df)).withColumn("_uid", F.monotonically_increasing_id()))
    found = near_duplicates(keyed.select("_uid", F.col(f"_row.`{text}`").alias("_text")), "_uid", "_text").select(F.col("_uid").alias("_at"), "component_id")
    grouped = written(keyed.select("_uid", own.alias("_id")).join(found, F.col("_uid") == F.col("_at")).select("_uid", "_id", "component_id"))
    stay = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_uid")).alias("top")).select(F.col("top._uid").alias("_stays"))
    gone = written(grouped.select(F.col("_uid").alias("doc")).join(stay, F.col("doc") == F.col("_stays"), "left_anti"))
    drop(grouped)
    # Whole rows stay where they are, but for those that go and the few that share a slot with one.
    bits = slot_bits(SPARSE * gone.count())
    rows = marked(keyed, slot(bits, F.col("_uid")), written(_marks(gone, bits)), "wanted")
    left = rows.where("wanted").join(gone, F.col("_uid") == F.col("doc"), "left_anti")
    return rows.where("not wanted").select("_row.*").union(left.select("_row.*"))
