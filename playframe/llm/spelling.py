"""Spelling variants: words one insertion, deletion or replacement apart, grouped under their most frequent form.

Every word emits a key for itself and for each of its distinct single deletions. Two
words that differ by one insertion share the shorter word, two that differ by one
replacement share what is left without it, so an equi-join on keys finds every near
pair; what it finds beyond them, words at distance two and equal hashes, goes when
distance one is verified on the words. A key is shared by at most one word and the
words that one letter more makes of it, some ninety for each place.

Keys are 64-bit hashes of the letters. A deletion's hash comes from the running sums of
the word's own, so a word of any length costs time and space in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, slices, written

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form occurs at least this many times as often as its variant.
RATIO = 10
LETTER = r"A-Za-zÀ-ÿ"
#: Of the runs of a document, one in so many has a letter deleted.
NOISE = 31
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, row_id: str = "doc_id", text: str = "text", noise: int | None = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many letters and occurrences, over whole texts.

    A word is a maximal run of letters with A-Z lower-cased. With ``noise``, runs whose
    seeded hash with the document's id it divides lose one letter, as typing errors do;
    None counts the texts as they are. Null texts have no words, a null id hashes as an
    empty one.
    """
    # A maximal run that is too short stays too short: only the others are taken out.
    runs = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(f"[{LETTER}]{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run")
    if noise:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run"))).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
        word = F.when(F.col("h") % noise == 0, F.expr("concat(left(run, at), substr(run, at + 2))")).otherwise(word)
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.char_length("word") >= least_letters))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, key, whether the key is the word's own) for every word and each of its distinct single deletions."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - first[of]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(int(sizes.max(initial=0)), 1), _BASE, np.uint64)]))
    term = (codes + np.uint64(1)) * powers[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    whole = sums[first + sizes] - sums[first]
    # Letters behind the deleted one move one place to the front: their terms lose one factor.
    before = sums[:-1] - sums[first][of]
    left = before + (whole[of] - before - term) * np.uint64(_INVERSE)
    # Deleting any letter of a run of equal ones gives one word: its first stands for it.
    starts = (place == 0) | (codes != np.concatenate([[np.uint64(0)], codes[:-1]]))
    key = np.concatenate([whole, left[starts]])
    letters = np.concatenate([sizes, (sizes - 1)[of][starts]]).astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(_BASE) + letters
    return np.concatenate([np.arange(len(words)), of[starts]]), key.view(np.int64), np.arange(len(key)) < len(words)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        of, key, own = deletion_keys(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(ids[of], pa.int64()), pa.array(key, pa.int64()), pa.array(own)], names=["id", "key", "own"])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b) ids of distinct words at distance one, each pair once, from (id, word, n)."""
    keys = written(vocabulary.select("id", "word").mapInArrow(_keyed, "id long, key long, own boolean"))
    a, b = keys.select(F.col("id").alias("a"), "key"), keys.select(F.col("id").alias("b"), "key")
    shared = a.join(b, "key").where("a < b").select("a", "b").distinct()
    of = lambda end: vocabulary.select(F.col("id").alias(f"_{end}"), F.col("word").alias(f"word_{end}"), F.col("n").alias(f"n_{end}"))
    both = shared.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
    found = written(both.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b", "word_a", "n_a", "word_b", "n_b"))
    drop(keys)
    return found


def _roots(pointers: DataFrame) -> DataFrame:
    """(word, root) of every word of ``pointers`` (word, form), by following pointers of pointers until none moves."""
    roots = written(pointers.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("_at"), F.col("root").alias("_up"))
        moved = written(roots.join(up, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")))
        drop(roots)
        roots = moved
        if not roots.where("moved").limit(1).count():
            return roots.drop("moved")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``counts`` (word, n; each word once): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Near words differ by one inserted, deleted or replaced letter. A word's form is its
    near word of the largest n (ties: the smallest in code-point order), if that is at
    least ``ratio`` times its own. Forms have larger counts, so following them ends;
    the last is the root, the word itself where it has no form. Null words are left
    out; an empty table gives no rows.
    """
    vocabulary = written(counts.where("word is not null").select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(vocabulary)
    side = lambda x, y: F.struct(F.col(x).alias("id"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(f"word_{y}").alias("word")).alias("near"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.id", "x.near")
    best = both.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("top"))
    formed = (-F.col("top.less")) >= ratio * F.col("n")
    rows = written(vocabulary.join(best, F.col("id") == F.col("_id"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("top.word")).alias("form"), F.when(formed, -F.col("top.less")).alias("form_n")))
    drop(vocabulary, pairs)
    roots = _roots(rows.where("form is not null")).select(F.col("word").alias("_word"), "root")
    return rows.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
