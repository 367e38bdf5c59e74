"""Near duplicates by SimHash fingerprints, compared on bit planes.

Documents with one fingerprint are one vertex. Fingerprints within ``RADIUS`` bits are
equal in at least ``parts - RADIUS`` of any ``parts`` parts of their bits, so each goes
to one bucket for every choice of that many parts; with more fingerprints there are
more parts, so that buckets stay near ``TARGET`` rows where bits are even. No bucket is
capped: one of more than ``BLOCK`` rows is cut into blocks, and every two blocks meet
in a task of their own.

Within a bucket fingerprints are stored by bit planes: word w of plane j holds bit j of
64 fingerprints. A fingerprint is compared with 64 others at once: its differing bits
are added, plane by plane, to counters that are themselves bit planes, by carry-save
adders; words in which all 64 counts exceed the radius are abandoned after every eight
planes. Links found join the rows of a block into components on the spot, so a dense
bucket sends on one row a member, not its pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, text_or_empty, whole_row, written
from .components import components

WIDTH, SEED = 4, 42
BITS, RADIUS = 64, 4
#: Rows that a bucket is expected to have at most, and rows of one block.
TARGET, BLOCK = 4096, 16_384
#: Words of 64 comparisons held at once; rows whose planes are made at once.
WORDS_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 1 << 15
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACES = re.compile(rb"[\x20\x09-\x0D]")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space, into pieces of about ``PIECE`` bytes."""
    start = 0
    while start < len(text):
        cut = SPACES.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; fewer words are one run."""
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(width, len(words))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The bits that over half of the text's shingle hashes have; 0 without words."""
    counts, total, before = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces((text or "").encode().lower()):  # bytes.lower changes A-Z only
        words = before + piece.split()  # bytes.split() parts at the same six bytes
        if len(words) >= width:
            h = shingle_hashes(words, width)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
            words = words[len(words) - width + 1 :]
        before = words
    if not total and before:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc", "fp"])


def masks(fingerprints: int, target: int = TARGET) -> list[int]:
    """One mask for each choice of ``parts - RADIUS`` parts, for the fewest parts that leave at most ``target`` rows a bucket."""
    parts = RADIUS + 1
    while fingerprints >> (BITS * (parts - RADIUS) // parts) > target and parts < BITS // 4:
        parts += 1
    edges = [BITS * i // parts for i in range(parts + 1)]
    one = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(parts)]
    return [sum(chosen) for chosen in itertools.combinations(one, parts - RADIUS)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane j is bit j of fingerprint 64 w + i."""
    bits = np.zeros((-(-len(fps) // BITS) * BITS, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder on bit planes: (sum, carry)."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def exceeding(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, more: np.ndarray, radius: int) -> np.ndarray:
    """Which of the counts ones + 2 twos + 4 fours, or any with ``more``, exceed the radius (at most 7)."""
    over, equal = more.copy(), ~more
    for plane, weight in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & weight:
            equal &= plane
        else:
            over |= equal & plane
            equal &= ~plane
    return over


def close_pairs(planes: np.ndarray, fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, k) of rows with low[i] <= k < high[i] whose fingerprints differ in at most ``radius`` bits, in chunks."""
    asking = np.flatnonzero(high > low)
    first, last = low[asking] // BITS, (high[asking] - 1) // BITS
    ends = np.cumsum(last - first + 1)
    done = 0
    while done < len(asking):
        # Whole rows, as many as fit, but one at least.
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + WORDS_AT_ONCE, "right")))
        rows, n = asking[done:until], (last - first + 1)[done:until]
        of = np.repeat(rows, n)
        word = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[done:until], n)
        done = until
        shift = np.clip(low[of] - word * BITS, 0, BITS - 1).astype(np.uint64)
        beyond = np.clip((word + 1) * BITS - high[of], 0, BITS - 1).astype(np.uint64)
        valid = (FULL << shift) & (FULL >> beyond)
        ones, twos, fours, more = (np.zeros(len(of), np.uint64) for _ in range(4))
        for j in range(0, BITS, 8):
            x = [planes[k, word] ^ (FULL * ((fps[of] >> np.uint64(k)) & np.uint64(1))) for k in range(j, j + 8)]
            fourth = []
            for half in (x[:4], x[4:]):
                ones, a = _added(ones, half[0], half[1])
                ones, b = _added(ones, half[2], half[3])
                twos, c = _added(twos, a, b)
                fourth.append(c)
            fours, eights = _added(fours, *fourth)
            more |= eights
            within = ~exceeding(ones, twos, fours, more, radius) & valid
            alive = np.flatnonzero(within)
            if len(alive) < len(within):
                of, word, valid, ones, twos, fours, more, within = (y[alive] for y in (of, word, valid, ones, twos, fours, more, within))
        if len(of):
            at, bit = np.nonzero(np.unpackbits(within.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield of[at], word[at] * BITS + bit


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the pairs (a, b); ``label`` holds each row's smallest known member and is changed in place."""
    while True:
        x, y = label[a], label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _block_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by group and side: rows of one side meet each other, rows of two sides those of the other one."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [len(group)]])
    of = np.repeat(np.arange(len(starts)), ends - starts)
    second = np.add.reduceat((side == 0).astype(np.int64), starts) + starts  # where the second side begins
    split = np.maximum.reduceat(side, starts) > 0
    low = np.where(split[of], second[of], np.arange(len(fps)) + 1)
    high = np.where(split[of] & (side > 0), 0, ends[of])
    label = np.arange(len(fps))
    for a, b in close_pairs(bit_planes(fps), fps, low, high):
        join_labels(label, a, b)
    joined = np.flatnonzero(label != np.arange(len(fps)))
    if len(joined):
        signed = fps.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[joined], pa.int64()), pa.array(signed[label[joined]], pa.int64())], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of rows (bucket, group, side, fp), which come sorted; whole groups are compared, many small ones at once."""
    held: list[np.ndarray] = []
    rows = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        every = np.concatenate(held, axis=1)
        until = every.shape[1]
        if not final:  # the last group may go on
            last = np.flatnonzero((every[:2] != every[:2, -1:]).any(axis=0))
            until = int(last[-1]) + 1 if len(last) else 0
        if until:
            own = every[:, :until]
            new = np.concatenate([[True], (own[:2, 1:] != own[:2, :-1]).any(axis=0)])
            yield from _block_links(np.ascontiguousarray(own[3]).view(np.uint64), np.cumsum(new), own[2])
        held, rows = [every[:, until:]], every.shape[1] - until

    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        rows += b.num_rows
        if rows >= ROWS_AT_ONCE:
            yield from flush(False)
    if rows:
        yield from flush(True)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) that join exactly the components of the fingerprints (``fp``, each once) within ``RADIUS`` bits."""
    choices = masks(distinct.count())
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    # The bits a choice keeps are a bucket's key; as choices differ, its number is part of it.
    buckets = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(choices)])
    placed = distinct.select("fp", F.explode(buckets).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > BLOCK).select(F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")))
    rows = placed.join(large, F.col("bucket") == F.col("_bucket"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    rows = rows.select("bucket", group.alias("group"), (F.col("block") > F.col("other")).cast("long").alias("side"), "fp")
    found = rows.repartition("bucket", "group").sortWithinPartitions("bucket", "group", "side").mapInArrow(_compared, "a long, b long")
    out = written(found.distinct())
    drop(large)
    return out


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``fingerprint`` (16 hex digits), ``component_id``, and ``first`` (true for one row of each component).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is
    four of them, repeats count, and a shorter text is one shingle. Null and empty texts
    have fingerprint zero and are linked like any other. ``component_id`` is the smallest
    id reachable (null ids are passed over; null where all are null). Rows repeated whole
    are linked. An empty table gives no rows. Only the id and the text are read.
    """
    docs = df.select(F.col(f"`{row_id}`").cast("long").alias("doc"), text_or_empty(text).alias("text"))
    rows = written(docs.mapInArrow(_fingerprinted, "doc long, fp long").withColumn("uid", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("uid").alias("uid"))
    distinct = written(rows.groupBy("fp").agg(F.min(order).alias("top")))
    found = links(distinct.select("fp"))
    labels = components(found)
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    of_fp = written(distinct.join(own, F.col("fp") == F.col("_node"), "left").select("fp", "top", F.coalesce("_label", "fp").alias("label")))
    tops = of_fp.groupBy("label").agg(F.min("top").alias("least")).select(F.col("label").alias("_label"), "least")
    whole = written(of_fp.join(tops, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), F.col("least.doc").alias("component_id"), F.col("least.uid").alias("_uid")))
    drop(distinct, found, labels, of_fp)
    out = rows.join(whole, F.col("fp") == F.col("_fp"))
    return out.select(F.col("doc").alias(row_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("uid") == F.col("_uid")).alias("first"))


def drop_near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each component, with all columns of ``df``, whatever their names; rows without words are one component."""
    keyed = written(df.select(whole_row(df)).withColumn("_uid", F.monotonically_increasing_id()))
    docs = keyed.select(F.col(f"_row.`{row_id}`").cast("long").alias("_id"), F.col(f"_row.`{text}`").alias("_text"), "_uid")
    found = near_duplicates(docs.select("_uid", "_text"), "_uid", "_text").select(F.col("_uid").alias("_at"), "component_id")
    grouped = docs.select("_id", "_uid").join(found, F.col("_uid") == F.col("_at"))
    stay = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_uid")).alias("top")).select(F.col("top._uid").alias("_stays"))
    return keyed.join(written(stay), F.col("_uid") == F.col("_stays"), "left_semi").select("_row.*")
