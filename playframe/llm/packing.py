"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every scan partition is tokenised and packed in the task that reads it. What is left
at its end, less than a block, is handed on as rows of pieces and packed together
with the remainders of the ``TOGETHER`` partitions next to it, so that padding doesn't
depend on the number of partitions. Texts and tokens are never shuffled.

A document longer than the window gives full windows of its own; what is
left of it joins a block of ``BLOCK`` windows in pieces of half a window at most. A
block is partitioned into windows by multiway differencing: of the partial
partitions, the two with the largest spread are merged, the large sums of one onto
the small sums of the other. The window count starts at total over capacity and
rises whenever the largest window exceeds the capacity. A block is closed with small
pieces and a little below its windows' capacity, so the count seldom has to rise.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, worker_state, written

CAPACITY = 2048
#: Windows packed together; bounds a task's memory and the work of differencing.
BLOCK = 64
#: A block is filled to capacity less capacity / SLACK a window, and per window its last
#: pieces are cut to capacity / d tokens for each d in FINE: small items level the windows.
SLACK = 128
FINE = (32, 128)
END = (1).to_bytes(4, "little")
#: Distinct words whose ids a Python worker keeps before it starts anew, some 200 bytes each, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: Characters of the documents encoded together, about.
CHUNK_CHARS = 3 << 20
#: New words encoded as one text.
JOINED = 1000
#: Partitions whose remainders are packed together.
TOGETHER = 16
#: Ids of partitions and sequences share one long: the partition in the high bits.
SEQUENCE_BITS = 36
#: Set in the ids of sequences made of remainders, which have their group in place of a partition.
REMAINDERS = 1 << 62

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Byte-level BPE ids of whole texts, encoding a word once for all its places in a chunk of texts.

    The pre-tokeniser always ends a piece between a non-space and a following space
    or line feed that itself precedes a non-space, so a text may be cut there and its
    ids joined. Texts with any other white space are cut by ``CUT``. Words that are new
    but come several times in a chunk are kept for later ones; words that come once
    seldom come again.
    """

    #: A cut: before one space, or around one line feed, with no white space on either side.
    CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
    ASCII_ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
    WIDE_ODD = tuple(c for c in map(chr, range(128, 0x3001)) if c.isspace())

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids as little-endian bytes: of words as they stand, and of words after a space.
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        #: Whether a token begins with the space of the byte alphabet.
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.line_feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space, ``JOINED`` to a text. No piece crosses a space, so each token that begins with one begins a word."""
        texts = [" " + " ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        out = []
        for encoded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(encoded.ids, "<u4")
            raw = ids.tobytes()
            cuts = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), len(raw)]
            out += [raw[x:y] for x, y in zip(cuts, cuts[1:])]
        return out

    def _plain(self, text: str) -> bool:
        if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in self.ASCII_ODD):
            return False
        return text.isascii() or not any(x in text for x in self.WIDE_ODD)

    def _lookup(self, text: str) -> tuple[list[bytes | None], list[tuple[int, bool, str]]]:
        """The ids of the text's words in order, and of each unknown one its place, whether it stands bare, and the word."""
        if not self._plain(text):
            words = self.CUT.split(text)
            found = list(map(self.bare.get, words))
            return found, [(i, True, words[i]) for i, x in enumerate(found) if x is None]
        found, gaps = [], []
        for line in text.split("\n"):
            words = line.split(" ")
            got = list(map(self.spaced.get, words))
            got[0] = self.bare.get(words[0])
            if None in got:
                at = len(found)
                gaps += [(at + i, i == 0, words[i]) for i, x in enumerate(got) if x is None]
            found += got
            found.append(self.line_feed)
        found.pop()
        return found, gaps

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids, four little-endian bytes each."""
        parts = [self._lookup(t) if t else ([], []) for t in texts]
        if len(self.bare) + len(self.spaced) > CACHE_WORDS:
            self.bare.clear()
            self.spaced.clear()
        for is_bare, known, ids in ((True, self.bare, self._ids), (False, self.spaced, self._spaced_ids)):
            times = Counter(w for _, gaps in parts for _, b, w in gaps if b is is_bare)
            if times:
                new = dict(zip(times, ids(list(times)), strict=True))
                known.update((w, new[w]) for w, n in times.items() if n > 1 and len(w) <= CACHE_CHARS)
                for found, gaps in parts:
                    for i, b, w in gaps:
                        if b is is_bare:
                            found[i] = new[w]
        return [b"".join(found) for found, _ in parts]


class _Partial:
    """Windows of a partial partition that hold something: sums in descending order and what each holds."""

    __slots__ = ("held", "sums")

    def __init__(self, sums: np.ndarray, held: list):
        self.sums, self.held = sums, held


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``windows`` lists of near-equal sums, by the largest-differencing method."""

    def spread(p: _Partial) -> int:
        return int(p.sums[0]) - (int(p.sums[windows - 1]) if len(p.sums) >= windows else 0)

    parts = [_Partial(np.array([s], np.int64), [(i,)]) for i, s in enumerate(sizes)]
    heap = [(-spread(p), n, p) for n, p in enumerate(parts)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a.sums) + len(b.sums) - windows)
        if over:  # the smallest windows of a meet the smallest of b in opposite order
            sums = np.concatenate([a.sums, b.sums[: len(b.sums) - over]])
            met = slice(len(a.sums) - over, len(a.sums))
            sums[met] += b.sums[len(b.sums) - over :][::-1]
            joined = [(x, y) for x, y in zip(a.held[met], reversed(b.held[len(b.sums) - over :]), strict=True)]
            held = a.held[: met.start] + joined + b.held[: len(b.sums) - over]
        else:
            sums, held = np.concatenate([a.sums, b.sums]), a.held + b.held
        order = np.argsort(-sums, kind="stable")
        n += 1
        merged = _Partial(sums[order], [held[i] for i in order.tolist()])
        heapq.heappush(heap, (-spread(merged), n, merged))
    return [sorted(_leaves(x)) for x in heap[0][2].held] if heap else []


def _leaves(tree: tuple) -> Iterator[int]:
    todo = [tree]
    while todo:
        for x in todo.pop():
            if isinstance(x, tuple):
                todo.append(x)
            else:
                yield x


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Differencing into as few windows as the capacity allows, trying counts upward from total over capacity."""
    if not sizes:
        return []
    count = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, count)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        count += 1


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _fine(windows: int, capacity: int) -> list[int]:
    return [max(1, capacity // d) for d in FINE for _ in range(windows)]


def _placed(pieces: list[tuple], capacity: int, sequence: int) -> tuple[list[tuple], int]:
    """Pieces with the sequence and offset they get, and the next free sequence."""
    rows = []
    for window in windows_of([p[2] for p in pieces], capacity):
        at = 0
        for i in window:
            rows.append((*pieces[i], sequence, at))
            at += pieces[i][2]
        sequence += 1
    return rows, sequence


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, capacity: int, block: int, partition: int) -> Iterator[pa.RecordBatch]:
    """The partition's pieces. Those that fill less than a block have no offset and, for a sequence, the partition."""
    encoders = worker_state("packing").setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    encoder = encoders[path]
    sequence = partition << SEQUENCE_BITS
    fine, full = _fine(block, capacity), block * (capacity - capacity // SLACK)
    rest: list[tuple] = []  # document, its tokens, start, length
    held = fines = 0

    def piece(doc, tokens: bytes, start: int, length: int) -> tuple:
        return doc, start, length, zlib.crc32(memoryview(tokens)[4 * start : 4 * (start + length)]), len(tokens) // 4

    for ids, texts in _chunks(batches):
        rows: list[tuple] = []
        for doc, tokens in zip(ids, encoder.encode(texts), strict=True):
            tokens += END
            total = len(tokens) // 4
            start = 0
            while total - start >= capacity:
                rows.append((*piece(doc, tokens, start, capacity), sequence, 0))
                sequence += 1
                start += capacity
            tokens_left = tokens[4 * start :]
            first = start
            while start < total:
                coarse = full - sum(fine) - held
                length = min(total - start, capacity // 2, coarse) if coarse > 0 else min(total - start, fine[fines])
                fines += coarse <= 0
                rest.append((doc, tokens_left, first, total, start, length))
                start += length
                held += length
                if fines == len(fine):
                    done, sequence = _placed([_rest_piece(*r) for r in rest], capacity, sequence)
                    rows += done
                    rest.clear()
                    held = fines = 0
        if rows:
            yield _batch(rows)
    yield _batch([(*_rest_piece(*r), partition, None) for r in _levelled(rest, capacity)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``CHUNK_CHARS``; a null text is empty."""
    ids, texts, held = [], [], 0
    for b in slices(batches, 64):
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(row)
            texts.append(text or "")
            held += len(text or "")
            if held >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _rest_piece(doc, tokens_left: bytes, first: int, total: int, start: int, length: int) -> tuple:
    at = 4 * (start - first)
    return doc, start, length, zlib.crc32(memoryview(tokens_left)[at : at + 4 * length]), total


def _levelled(rest: list[tuple], capacity: int) -> list[tuple]:
    """The pieces with the last ones cut small, as a full block has them."""
    fine = _fine(-(-sum(r[5] for r in rest) // capacity), capacity)
    out, small, wanted = list(rest), [], sum(fine)
    while out and wanted > 0:
        *r, start, length = out.pop()
        part = min(length, wanted)
        if part < length:
            out.append((*r, start, length - part))
        small.append((*r, start + length - part, part))
        wanted -= part
    for *r, start, length in reversed(small):
        end = start + length
        while start < end:
            step = min(end - start, fine.pop(0) if fine else end - start)
            out.append((*r, start, step))
            start += step
    return out


def _pack_remainders(batches: Iterator[pa.RecordBatch], capacity: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, partition, piece), in this order: whole remainders of a group are packed as soon as they fill a block."""
    pieces: list[tuple] = []
    held, group, last, sequence = 0, None, None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, sequence
        if pieces:
            rows, sequence = _placed(pieces, capacity, sequence)
            pieces.clear()
            held = 0
            yield _batch(rows)

    for b in batches:
        for own, partition, *piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != group or partition != last and held >= block * (capacity - capacity // SLACK):
                yield from flush()
            if own != group:
                group, sequence = own, REMAINDERS | own << SEQUENCE_BITS
            last = partition
            pieces.append(tuple(piece))
            held += piece[2]
    yield from flush()


def pack(df: DataFrame, tokenizer_path: str, row_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and the end id, so null and empty texts give one piece of
    length 1. Every id is in exactly one piece. Rows with one id, a null one included,
    are separate documents. An empty table gives no rows. Only the id and the text are
    read, so further columns of any name do no harm. ``sequence_id`` is unique over the
    table and the same on every rerun over the same input splits; it isn't gapless.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _pack_partition(batches, tokenizer_path, capacity, block, TaskContext.get().partitionId())

    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(rows.mapInArrow(task, SCHEMA))
    left = rows.where("offset is null").withColumnRenamed("sequence_id", "_partition").withColumn("_group", F.expr(f"_partition div {TOGETHER}"))
    left = left.repartition("_group").sortWithinPartitions("_group", "_partition", F.desc("length"), "doc_id", "start")
    left = left.select("_group", "_partition", *NAMES[:5]).mapInArrow(lambda batches: _pack_remainders(batches, capacity, block), SCHEMA)
    return rows.where("offset is not null").unionByName(left)
