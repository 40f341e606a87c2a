"""Packing by lexical retrieval: a window holds a seed text and its BM25 neighbours.

Every text is tokenized once. What fills whole windows of its own becomes sequences at once; the
rest, a tail shorter than a window, is packed with others. Tails are sorted by content and cut
into shards of about ``SHARD_TAILS``, each with an inverted index of its own. In a shard a seed is taken, the index
ranks the unused tails by BM25 against it, and they fill the seed's window in that order; the
last one is cut, and what is left of it is the next seed. When no unused tail shares a token
with the seed, the longest unused one goes on. Document frequencies and mean length come from
all tails and whole windows of the corpus (one count per token id), not from the shard.

The order is by weighted min-hash: each token id has one random rank, drawn so that ids of high
inverse document frequency come early, and a tail is sorted by the three first ranks it holds. Two
tails share the first one with the probability of their weighted overlap, so copies and near copies
lie side by side in a corpus of any size. A neighbour with less overlap may lie in another shard,
and is not asked: the README has measured shares.

Only the last window of a shard is not full. It is cut into sequences whose lengths are powers
of two, which need no padding. So each id lies in exactly one piece, and nothing is padded.

Bounds: a shard holds about ``SHARD_TAILS`` tails of less than a window each, whatever the texts
or keys; the broadcasts are one number per token id each. Tails of equal content are ordered by a
hash of their place in the stored table, so a large group of copies is cut like anything else.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each for
itself; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.llm.common import begin_task, bound_batches, give_back
from quietgrove.llm.word_bpe import vocabulary
from quietgrove.scratch import Scratch

WINDOW = 2_048
END_ID = 1
SHARD_TAILS = 512
#: Most shards in a task.
TASK_SHARDS = 16
K1, B = 1.2, 0.75
#: Bytes of text that are tokenized at a time.
SLICE_BYTES = 1 << 20
_TERMS = 1 << 16
_CODED = pa.schema([("key", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def content_ranks(frequency: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A rank per token id: ids come in the order of exponential clocks that run as fast as their
    inverse document frequency, those that nothing shares last."""
    draw = np.random.default_rng(0).exponential(size=len(idf))
    clock = np.where(frequency >= 2, draw / np.maximum(idf, 1e-12), np.inf)
    ranks = np.empty(len(idf), dtype=np.uint16)
    ranks[np.argsort(clock, kind="stable")] = np.arange(len(idf))
    return ranks


def content_keys(ids: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The three first ranks of each tail as one number; tails hold at least one id each."""
    if not len(counts):
        return np.empty(0, dtype=np.int64)
    none = 1 << 16
    held = ranks[ids].astype(np.int32)
    starts = np.cumsum(counts) - counts
    out, last = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    for _ in range(3):
        least = np.minimum.reduceat(held, starts)
        last = np.where(least < none, least, last)
        out = out << 16 | last
        held[held <= np.repeat(least, counts)] = none
    return out


def as_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of numbers as one binary array, without a copy for each."""
    ends = np.concatenate(([0], np.cumsum(counts) * values.itemsize))
    return pa.Array.from_buffers(pa.binary(), len(counts), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column one after another, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.empty(0, np.uint8)
    return np.frombuffer(whole.tobytes(), np.uint16), np.diff(ends) // 2


def split_ids(column: pa.Array) -> list[np.ndarray]:
    ids, counts = flat_ids(column)
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


def text_slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about ``SLICE_BYTES`` of text; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
                     .astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class ShardIndex:
    """Inverted index of one shard: for each token id, the tails that hold it with weights."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, owner, weight = [], [], []
        self.distinct = []
        for i, ids in enumerate(tails):
            t, tf = np.unique(ids, return_counts=True)
            self.distinct.append(t)
            terms.append(t)
            owner.append(np.full(len(t), i, dtype=np.int32))
            weight.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length)))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.size = len(tails)
        self._owner = np.concatenate(owner)[order]
        self._weight = np.concatenate(weight)[order]
        self._begin = np.searchsorted(term[order], np.arange(_TERMS + 1))

    def scores(self, query: int) -> np.ndarray:
        """BM25 of all tails for the token ids of one of them."""
        t = self.distinct[query].astype(np.int64)
        begin, count = self._begin[t], self._begin[t + 1] - self._begin[t]
        total = count.sum()
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
        return np.bincount(self._owner[at], weights=self._weight[at], minlength=self.size)


def fill_windows(tails: list[np.ndarray], index: ShardIndex, window: int
                 ) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, first id, number of ids); all but the last are full."""
    left = np.array([len(t) for t in tails])
    longest = np.argsort(-left, kind="stable")
    at, cut, out = 0, -1, []
    while True:
        while at < len(longest) and left[longest[at]] == 0:
            at += 1
        if at == len(longest):
            return out
        seed = cut if cut >= 0 and left[cut] else longest[at]
        pieces, room, cut = [], window, -1

        def take(i: int) -> None:
            nonlocal room, cut
            n = min(room, left[i])
            pieces.append((int(i), len(tails[i]) - int(left[i]), int(n)))
            left[i] -= n
            room -= n
            cut = int(i) if left[i] else -1

        take(seed)
        if room:
            scores = index.scores(seed)
            near = np.nonzero((left > 0) & (scores > 0))[0]
            for i in near[np.argsort(-scores[near], kind="stable")]:
                take(i)
                if not room:
                    break
        if room:
            for i in longest[at:]:
                if left[i]:
                    take(i)
                    if not room:
                        break
        out.append(pieces)


def power_of_two_cuts(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A partly filled window as sequences whose lengths are powers of two, longest first."""
    out: list[list[tuple[int, int, int]]] = []
    rest = list(pieces)
    total = sum(n for *_, n in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        sequence = []
        while room:
            i, start, n = rest.pop(0)
            sequence.append((i, start, min(n, room)))
            if n > room:
                rest.insert(0, (i, start + room, n - room))
            room -= min(n, room)
        out.append(sequence)
    return out


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW,
         end_id: int = END_ID, shard_tails: int = SHARD_TAILS) -> DataFrame:
    """One row per piece: ``key``, start, length, ids (little-endian uint32 bytes), doc_tokens,
    sequence_id, offset (place of the piece in its sequence)."""
    spark = df.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    kind = dict(df.dtypes)[key]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("word_bpe")
        words = vocabulary(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, tokens = words.encode_array(part.column("text"), end_id)
                per = -(-tokens // window)
                doc = np.repeat(np.arange(len(tokens)), per)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * window
                length = np.minimum(window, tokens[doc] - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc)), pa.array(start), pa.array(length),
                     pa.array(tokens[doc]), as_binary(ids, length)], schema=_CODED)
        # the process lives on into later stages, its spare memory need not
        give_back()

    body = df.select(F.col(f"`{key}`").cast("string").alias("key"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    coded = body.mapInArrow(tokenize, "key string, start long, length long, doc_tokens long, ids binary")
    stored = scratch.save(coded.withColumn("place", F.monotonically_increasing_id()))

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("packing")
        total = np.zeros(_TERMS, dtype=np.int64)
        for batch in batches:
            for ids in split_ids(batch.column("ids")):
                total[np.unique(ids)] += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    found = stored.select("ids").mapInArrow(count_terms, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toPandas()
    size = stored.agg(F.count("*").alias("n"), F.avg("length").alias("mean"),
                      F.count_if(F.col("length") < window).alias("tails")).first()
    n, mean_length = size["n"], size["mean"] or 1.0
    frequency = np.zeros(_TERMS)
    frequency[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
    shared = spark.sparkContext.broadcast(idf)
    ranks = spark.sparkContext.broadcast(content_ranks(frequency, idf))
    shards = max(1, -(-size["tails"] // shard_tails))
    tasks = max(-(-shards // TASK_SHARDS), min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        tails = [np.frombuffer(b, dtype=np.uint16) for b in rows["ids"]]
        windows = fill_windows(tails, ShardIndex(tails, shared.value, mean_length), window)
        if windows and sum(x for *_, x in windows[-1]) < window:
            windows += power_of_two_cuts(windows.pop())
        out = []
        base = int(rows["at"].iloc[0]) << 4  # at most 11 sequences more than tails
        for number, pieces in enumerate(windows):
            offset = 0
            for i, begin, length in pieces:
                out.append((rows["key"].iat[i], rows["start"].iat[i] + begin, length,
                            rows["doc_tokens"].iat[i], tails[i][begin:begin + length]
                            .astype("<u4").tobytes(), 2 * (base + number) + 1, offset))
                offset += length
        return pd.DataFrame(out, columns=["key", "start", "length", "doc_tokens", "ids",
                                          "sequence_id", "offset"])

    def pack_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task("packing")
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 2 * shard_tails:
                rows = pd.concat(held, ignore_index=True)
                while len(rows) >= 2 * shard_tails:
                    yield pack_shard(rows[:shard_tails].reset_index(drop=True))
                    rows = rows[shard_tails:].reset_index(drop=True)
                held = [rows]
        if rest := sum(map(len, held)):
            rows = pd.concat(held, ignore_index=True)
            cut = rest // 2 if rest > 1.5 * shard_tails else rest
            for part in (rows[:cut], rows[cut:]):
                if len(part):
                    yield pack_shard(part.reset_index(drop=True))

    @F.pandas_udf("long")
    def by_content(rows: pd.Series) -> pd.Series:
        counts = rows.map(len).to_numpy() // 2
        return pd.Series(content_keys(np.frombuffer(b"".join(rows), np.uint16), counts, ranks.value))

    pieces = "key string, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    packed = stored.where(F.col("length") < window).withColumns(
        {"content": by_content("ids"), "salt": F.xxhash64("place")}).repartitionByRange(
        tasks, "content", "salt").sortWithinPartitions("content", "salt").select(
        "key", "start", "doc_tokens", "ids", F.monotonically_increasing_id().alias("at")).mapInPandas(
        pack_range, pieces)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = flat_ids(batch.column("ids"))
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", as_binary(ids.astype("<u4"), counts))

    whole = stored.where(F.col("length") == window).select(
        "key", "start", "length", "doc_tokens", "ids", (F.col("place") * 2).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset")).mapInArrow(widen, pieces)
    return whole.unionByName(packed).select(
        F.col("key").cast(kind).alias(key), "start", "length", "ids", "doc_tokens", "sequence_id",
        "offset")
