"""Exact Jaccard join of texts over word n-grams in metric regions around pivots.

Jaccard distance is a metric, so texts can be dealt to regions around pivots and each region
joined by itself, if every text near a border is also handed to the regions it may have links
in. Texts that have little in common are all at distance one, though: a pivot drawn at random
tells none of them apart, and its border window would hold everything. So pivots come from what
texts share. Linked texts have one of their smallest shingle hashes in common (the prefix of a
text: of ``a`` shingles the ``a - ceil(t a) + 1`` smallest, up to the next of 64 fixed marks on
the hash range). Texts with a prefix shingle in common make a cell, its text of lowest rank is
the pivot, and the region of a pivot is the union of its cells. Two linked texts always meet in
a region.

1. Texts with equal shingle sets become one representative.
2. Prefix shingles that representatives share make cells, pivots and regions.
3. Border windows: a text stays in a region only if some other text there can be near it. The
   bound is exact: shingles up to a common mark are known, above it at most all can agree. A
   text that shares too few prefix shingles with all others together is dropped before.
4. Regions are joined on whole sets. A text taken as pivot gets its distances to the region at
   once; its ball is one component. Texts of the component that is the largest just then wait,
   until all texts that wait lie in one and the same component. A text needs no turn if the
   distances to earlier pivots differ by more than the radius (triangle inequality) from those
   of every text outside its component.
5. Links make the components.

Steps 3 and 4 cut large regions into blocks and join all pairs of blocks, so a task holds two
blocks at most. Ranks and block sizes decide how much work is saved, never the result. Sets are
compared as hashes of shingles, equal sets by 64 bits and others by 56.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; with
fewer words than the shingle width the whole word sequence is one shingle; equal sets are
linked; every input row gives a row, repeated ids included; a null id never becomes a component
id, and its text has its links like any other; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
from typing import Iterator, Optional, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.llm.common import begin_task, bound_batches, give_back, keeps
from quietgrove.llm.components import connected_components
from quietgrove.scratch import Scratch

WIDTH = 5
#: Similarity of links as a fraction.
SIMILARITY = (75, 100)
MARKS = 64
#: No prefix ends below this mark, so every two texts are known up to it at least.
LEAST_MARK = 18
#: Ratio of the size classes in which the least number of needed shingles is looked up.
CLASS_RATIO = 1.15
BLOCK_ROWS = 4_096
BLOCK_SHINGLES = 1 << 22
#: Pivots of a region whose distances are kept for the triangle inequality.
PIVOTS = 16
#: Ids that may be broadcast to pick out rows (16 MB); more are joined by an exchange.
BROADCAST_IDS = 1_000_000
_REMEMBERED = 1_000_000
#: Words whose hashes a Python process keeps; processes live on into later stages.
_REMEMBERED_WORDS = 250_000
#: Low bits of a hash that cells ignore. Chance cells are only looked at, and narrow ids travel lighter.
_CELL_BITS = np.uint64(16)
#: Prefix shingles of a task that are dealt to buckets at a time, and those of a bucket on average.
DEALT_SHINGLES = 1 << 19
BUCKET_SHINGLES = 1 << 20
#: So many texts with one shingle, among those dealt at a time, are few enough to be held by a bucket.
FEW_TEXTS = 64
#: Regions up to this size are searched for their borders many at a time.
SMALL_REGION = 64
#: Low bits of a hash that whole sets are compared without.
_PACKED_BITS = np.uint64(8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _WordHashes()
keeps("jaccard_join", _hashes.clear)


def shingle_set(text: Optional[str], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    wide = min(width, len(h))
    n = len(h) - wide + 1
    code = np.full(n, wide, dtype=np.uint64)
    for k in range(wide):
        code = (code ^ (code >> np.uint64(31))) * _MIX + h[k:k + n]
    code ^= code >> np.uint64(29)
    code *= _MIX
    code ^= code >> np.uint64(32)
    return np.unique(code)


def packed(codes: np.ndarray) -> bytes:
    """A sorted set by the upper 56 bits of its hashes: gaps, their bytes of equal rank together, so
    that the leading ones, nearly all zero, vanish in compression."""
    gaps = np.diff(codes >> _PACKED_BITS, prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(7, -1)
    gaps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    gaps[:, :7] = planes.T
    return np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64)


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers by as many of their low bytes as any of them has, bytes of equal rank together."""
    planes = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([planes]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8")[:, 0]


def _fingerprint(codes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).view(np.int64))


def overlap_needed(a, b):
    """Common shingles that sets of sizes ``a`` and ``b`` need to be linked."""
    part, whole = SIMILARITY
    return -(-(part * (a + b)) // (part + whole))


def prefix_of(codes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Prefix of a set, its mark (1 to MARKS), and set elements below each mark up to it."""
    part, whole = SIMILARITY
    a = len(codes)
    below = np.searchsorted(codes, np.arange(1, MARKS, dtype=np.uint64) << np.uint64(58))
    below = np.append(below, a)
    least = a - -(-part * a // whole) + 1
    mark = max(LEAST_MARK, int(np.searchsorted(below, min(least, a))) + 1)
    return codes[:below[mark - 1]], mark, below[:mark].astype(np.int32)


def linked_components(sets: list[np.ndarray]) -> np.ndarray:
    """Component numbers of sets under links."""
    m = len(sets)
    comp = np.arange(m)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        both = np.sort(np.concatenate(sets))
        common = np.count_nonzero(both[1:] == both[:-1])
        return comp * int(common == 0 or common < overlap_needed(size[0], size[1]))
    code, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting = np.repeat(np.arange(m), size)[order]
    begin = np.searchsorted(token[order], np.arange(len(code) + 1))
    first = np.concatenate(([0], np.cumsum(size)))
    radius = 1 - SIMILARITY[0] / SIMILARITY[1] + 1e-9
    distances: list[np.ndarray] = []
    waiting = np.argsort(-size, kind="stable")
    while (comp[waiting] != comp[waiting[0]]).any():
        passed = []
        for x in waiting:
            counts = np.bincount(comp)
            if counts.max() == m:
                return comp
            if comp[x] == counts.argmax() and counts.max() > 1:
                passed.append(x)
                continue
            others = comp != comp[x]
            for d in distances:
                others = others & (np.abs(d - d[x]) <= radius)
            if not others.any():
                continue
            t = token[first[x]:first[x + 1]]
            n = begin[t + 1] - begin[t]
            at = np.repeat(begin[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(posting[at], minlength=m)
            near = np.unique(comp[(common > 0) & (common >= overlap_needed(size[x], size))])
            comp[np.isin(comp, near)] = near[0]
            if len(distances) < PIVOTS:
                distances.append(1 - common / (size[x] + size - common))
        if not passed:
            break
        # the largest component may have been another one when they were passed over
        waiting = np.array(passed)
    return comp


def smaller_needs(size: int, below: int) -> int:
    """Prefix shingles that a set shares at least with a linked one that is not smaller;
    ``below`` of its elements lie below the least mark."""
    return int(overlap_needed(size, size)) - (size - below)


def _sharing_enough(records: DataFrame) -> DataFrame:
    """Texts that share enough with all others together to be linked with any.

    The smaller of two linked texts shares at least its ``need``; the larger one shares as much,
    so at least the least need of a text that is up to a quarter smaller. The least needs are a
    table of size classes, a few hundred rows at most.
    """
    place = F.floor(F.log(F.col("size").cast("double")) / math.log(CLASS_RATIO)).cast("int")
    held = records.withColumns({"held": F.size("shared"), "class": place})
    least = {r["class"]: r["need"] for r in held.where("held >= need").groupBy("class").agg(
        F.min("need").alias("need")).collect()}
    if not least:
        return records.limit(0)
    back = math.ceil(math.log(SIMILARITY[1] / SIMILARITY[0]) / math.log(CLASS_RATIO)) + 1
    table = {c: min((least[k] for k in range(c - back, c + 1) if k in least), default=None)
             for c in range(min(least), max(least) + back + 1)}
    needs = F.create_map(*[F.lit(x) for c, n in table.items() if n is not None for x in (c, n)])
    as_larger = F.coalesce(F.col("held") >= F.try_element_at(needs, F.col("class")), F.lit(False))
    return held.where((F.col("held") >= F.col("need")) | as_larger).drop("held", "class", "need")


def possible(c, a, b, below_a, below_b) -> np.ndarray:
    """Whether sets can be linked that share ``c`` elements up to a common mark."""
    return (c > 0) & (c + np.minimum(a - below_a, b - below_b) >= overlap_needed(a, b))


def _places(rep: np.ndarray) -> np.ndarray:
    """Ranks that decide which text of a cell is its pivot; different for different texts."""
    code = rep.view(np.uint64) * _MIX
    return (code ^ (code >> np.uint64(32))) * _MIX


def _deal_cells(buckets: int):
    """Prefix shingles of texts dealt to buckets: a row holds those of many texts in one bucket, as
    gaps, with the texts by their distance from the lowest one.

    Of a shingle that many of the texts have, only the two texts of lowest rank go to the rows that
    a bucket holds together; the others follow in rows with ``later``, which it takes one by one.
    """
    def rows(bucket: np.ndarray, code: np.ndarray, rep: np.ndarray, later: bool) -> Iterator[tuple]:
        ends = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *ends], [*ends, len(bucket)]):
            base = int(rep[a:b].min())
            yield (int(bucket[a]), later, base, packed_numbers(np.diff(code[a:b], prepend=np.uint64(0))),
                   packed_numbers((rep[a:b] - base).view(np.uint64)))

    def dealt(lists: list[np.ndarray], reps: list[int]) -> pa.RecordBatch:
        token = np.concatenate(lists)
        rep = np.repeat(np.array(reps, dtype=np.int64), [len(t) for t in lists])
        bucket, code = (token % np.uint64(buckets)).astype(np.int64), token // np.uint64(buckets)
        order = np.lexsort((code, bucket))
        bucket, code, rep = bucket[order], code[order], rep[order]
        start = np.flatnonzero(np.concatenate(([True], (np.diff(code) != 0) | (np.diff(bucket) != 0))))
        count = np.diff(np.append(start, len(code)))
        many = np.flatnonzero(np.repeat(count > FEW_TEXTS, count))
        if len(many):
            run = np.repeat(np.arange(len(start)), count)[many]
            rep[many] = rep[many[np.lexsort((_places(rep[many]), run))]]
        later = np.zeros(len(code), dtype=bool)
        later[many] = True
        first = start[count > FEW_TEXTS]
        later[first] = later[first + 1] = False
        out = list(rows(bucket[~later], code[~later], rep[~later], False))
        if later.any():
            out += rows(bucket[later], code[later], rep[later], True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
            pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))],
            names=["bucket", "later", "base", "codes", "reps"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("jaccard_join")
        lists, reps, size = [], [], 0
        for batch in batches:
            for rep, prefix in zip(batch.column("rep").to_pylist(), batch.column("prefix").to_pylist()):
                lists.append(np.cumsum(unpacked_numbers(prefix), dtype=np.uint64))
                reps.append(rep)
                size += len(lists[-1])
                if size > DEALT_SHINGLES:
                    yield dealt(lists, reps)
                    lists, reps, size = [], [], 0
        if size:
            yield dealt(lists, reps)
        give_back()

    return deal


def _find_cells(buckets: int):
    """``rep, token, pivot`` for the prefix shingles that more than one text has, from the rows of
    ``_deal_cells`` in the order of buckets and ``later``. Tokens are 32 bits of the shingle: two that
    are equal by chance make borders wider, nothing else.

    Together a bucket holds its shingles that few texts have, and two texts per dealt lot of the
    others; these already contain the pivot, so the texts that come later only look it up.
    """
    def entries(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return (np.cumsum(unpacked_numbers(row["codes"]), dtype=np.uint64),
                unpacked_numbers(row["reps"]).view(np.int64) + row["base"])

    def told(rep: np.ndarray, code: np.ndarray, pivot: np.ndarray, bucket: int) -> pa.RecordBatch:
        token = code * np.uint64(buckets) + np.uint64(bucket)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(token.astype(np.uint32).view(np.int32)),
                                           pa.array(pivot)], names=["rep", "token", "pivot"])

    def settled(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        code, rep = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(code, kind="stable")
        code, rep = code[order], rep[order]
        twin = code[1:] == code[:-1]
        shared = np.append(twin, False) | np.append(False, twin)
        code, rep = code[shared], rep[shared]
        order = np.lexsort((_places(rep), code))
        code, rep = code[order], rep[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
        return rep, code, np.repeat(rep[start], np.diff(np.append(start, len(code)))), start

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("jaccard_join")
        bucket, held = None, []
        names, pivots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["later"] or row["bucket"] != bucket):
                    rep, code, pivot, start = settled(held)
                    yield told(rep, code, pivot, bucket)
                    names, pivots, held = code[start], pivot[start], []
                bucket = row["bucket"]
                if not row["later"]:
                    held.append(entries(row))
                    continue
                code, rep = entries(row)
                yield told(rep, code, pivots[np.searchsorted(names, code)], bucket)
        if held:
            yield told(*settled(held)[:3], bucket)
        give_back()

    return find


def _groups_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come in the order of ``keys``, whole groups only, and where their groups start."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return rows, np.append(0, changes(rows))

    def changes(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
        for k in keys:
            new |= np.diff(rows.column(k).to_numpy()) != 0
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(k)[0] != held[-1].column(k)[0] for k in keys):
            yield whole(held)
            held = []
        ends = changes(batch)
        if len(ends):
            yield whole([*held, batch.slice(0, ends[-1])])
            held = [batch.slice(ends[-1])]
        else:
            held.append(batch)
    if held:
        yield whole(held)


def _list_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and where those of each row begin and end."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0]


def _numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of a binary column one after another, and where those of each row begin and end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return np.frombuffer(data.tobytes(), np.int32), (ends - ends[0]) // 4


def _small_borders(rows: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
    """Which rows of small regions another text of their region can be linked with: what ``_Records``
    tells of one region, for many. ``group`` numbers the regions in the order of the rows."""
    size, mark = rows.column("size").to_numpy(), rows.column("mark").to_numpy() - 1
    below, at = _numbers_of(rows.column("below"))
    token, bounds = _list_of(rows.column("shared"))
    held = np.diff(bounds)
    start = np.flatnonzero(np.append(True, np.diff(group) != 0))
    count = np.diff(np.append(start, len(group)))
    number = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(group)) - start[number]
    owner = np.repeat(np.arange(len(group)), held)
    order = np.lexsort((token, number[owner]))
    owner, token = owner[order], token[order]
    run = np.cumsum(np.append(True, (np.diff(token) != 0) | (np.diff(number[owner]) != 0))[:len(token)])
    length = np.bincount(run)[run]
    rich = np.bincount(owner[length > 1], minlength=len(group))
    least = np.minimum.reduceat(mark, start)[number]
    small = rich >= overlap_needed(size, size) - (size - below[at[:-1] + least])
    base = np.cumsum(count ** 2) - count ** 2
    common = np.zeros(int((count ** 2).sum()), dtype=np.int64)
    left = np.flatnonzero(length > 1)
    step = 1
    while True:
        left = left[left + step < len(run)]
        left = left[run[left] == run[left + step]]
        if not len(left):
            break
        a, b = owner[left], owner[left + step]
        common += np.bincount(base[number[a]] + place[a] * count[number[a]] + place[b], minlength=len(common))
        step += 1
    pair = np.flatnonzero(common)
    of = np.searchsorted(base, pair, "right") - 1
    a, b = (start[of] + x for x in np.divmod(pair - base[of], count[of]))
    to = np.minimum(mark[a], mark[b])
    near = possible(common[pair], size[a], size[b], below[at[a] + to], below[at[b] + to])
    near &= (small[a] | small[b]) & (a != b)
    keep = np.zeros(len(group), dtype=bool)
    keep[a[near]] = keep[b[near]] = True
    return keep


class _Records:
    """Prefix records of some texts as arrays, with an inverted index over shared shingles."""

    def __init__(self, rows: pd.DataFrame):
        self.size = rows["size"].to_numpy()
        self.mark = rows["mark"].to_numpy()
        self.below = np.zeros((len(rows), MARKS), dtype=np.int64)
        for i, b in enumerate(rows["below"]):
            known = np.frombuffer(b, dtype=np.int32)
            self.below[i, :len(known)] = known
        lists = [np.asarray(t, dtype=np.int64) for t in rows["shared"]]
        self.held = np.array([len(t) for t in lists])
        code, self.token = np.unique(np.concatenate(lists), return_inverse=True)
        order = np.argsort(self.token, kind="stable")
        self.posting = np.repeat(np.arange(len(rows)), self.held)[order]
        self.begin = np.searchsorted(self.token[order], np.arange(len(code) + 1))
        self.first = np.concatenate(([0], np.cumsum(self.held)))

    def possible_with(self, x: int) -> np.ndarray:
        """Which texts can be linked with text ``x``."""
        t = self.token[self.first[x]:self.first[x + 1]]
        n = self.begin[t + 1] - self.begin[t]
        at = np.repeat(self.begin[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        c = np.bincount(self.posting[at], minlength=len(self.size))
        mark = np.minimum(self.mark, self.mark[x]) - 1
        ok = possible(c, self.size[x], self.size, self.below[x, mark],
                      self.below[np.arange(len(mark)), mark])
        ok[x] = False
        return ok

    def small_enough(self) -> np.ndarray:
        """Texts that share enough here to be the smaller side of a link with anything."""
        df = self.begin[1:] - self.begin[:-1]
        rich = np.concatenate(([0], np.cumsum(df[self.token] > 1)))
        shared = rich[self.first[1:]] - rich[self.first[:-1]]
        mark = self.mark.min() - 1
        return shared >= overlap_needed(self.size, self.size) - (self.size - self.below[:, mark])


def _semi(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted; the wanted keys are broadcast if they are few."""
    small = wanted.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(wanted) if small else wanted, key, "left_semi")


def _blocked(members: DataFrame, region: str, row: str, size: str) -> DataFrame:
    """``members`` dealt to pairs of blocks of their region: columns ``i`` and ``j``, i <= j."""
    large = members.groupBy(region).agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(size) / BLOCK_SHINGLES)).cast("int").alias("blocks")
        ).where("blocks > 1")
    if large.count() <= BROADCAST_IDS:
        large = F.broadcast(large)
    dealt = members.join(large, region, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64(row, F.lit("block")), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, block).alias("i"), F.greatest(o, block).alias("j")))
    return dealt.withColumn("pair", F.explode(pairs)).select(
        *members.columns, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))


def _large_border(region: pd.DataFrame) -> np.ndarray:
    """Which texts of a region (or pair of blocks) another text there can be linked with."""
    keep = np.zeros(len(region), dtype=bool)
    records = _Records(region)
    for x in np.nonzero(records.small_enough())[0]:
        found = records.possible_with(x)
        if found.any():
            keep |= found
            keep[x] = True
    return keep


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of regions (or pairs of blocks) that another text there can be linked with.

    They are named by their own hash instead of the pivot's id, so regions that come down to
    the same texts are one.
    """
    begin_task("jaccard_join")
    for rows, start in _groups_of(batches, ("pivot", "i", "j")):
        count = np.diff(np.append(start, rows.num_rows))
        group = np.repeat(np.arange(len(start)), count)
        keep = np.zeros(rows.num_rows, dtype=bool)
        some = np.flatnonzero(((count > 1) & (count <= SMALL_REGION))[group])
        if len(some):
            keep[some] = _small_borders(rows.take(pa.array(some)), group[some])
        for g in np.flatnonzero(count > SMALL_REGION):
            a, b = start[g], start[g] + count[g]
            keep[a:b] = _large_border(rows.slice(a, count[g]).to_pandas())
        rep, size = rows.column("rep").to_numpy()[keep], rows.column("size").to_numpy()[keep]
        kept = np.bincount(group[keep], minlength=len(start))
        kept = kept[kept > 0]
        names = [xxhash.xxh3_64_intdigest(np.sort(r).tobytes()) for r in np.split(rep, np.cumsum(kept)[:-1])] \
            if len(kept) else []
        region = np.repeat(np.array(names, dtype=np.uint64), kept).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(size), pa.array(region)],
                                         names=["rep", "size", "region"])
    give_back()


def _without_nested(border: DataFrame) -> DataFrame:
    """``border`` without regions whose texts all lie in one and the same larger region.

    Each text names the largest of its regions; a region whose texts agree on another one is
    part of it, and all its pairs are joined there.
    """
    sizes = border.groupBy("region").agg(F.count("*").alias("n"))
    largest = border.join(sizes, "region").groupBy("rep").agg(
        F.max_by("region", F.struct("n", "region")).alias("largest"))
    named = border.join(largest, "rep").groupBy("region").agg(
        F.min("largest").alias("first"), F.max("largest").alias("last"))
    nested = named.where("first = last AND first <> region").select("region")
    return border.join(nested, "region", "left_anti")


def _region_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each text of a component inside a region to one of its texts."""
    begin_task("jaccard_join")
    for rows, start in _groups_of(batches, ("region", "i", "j")):
        reps = rows.column("rep").to_numpy()
        u, v = [reps[:0]], [reps[:0]]
        for a, b in zip(start, np.append(start[1:], rows.num_rows)):
            names, first = np.unique(reps[a:b], return_index=True)
            if len(names) < 2:
                continue
            codes = rows.column("codes").take(pa.array(a + first)).to_pylist()
            comp = linked_components([unpacked(c) for c in codes])
            _, first = np.unique(comp, return_index=True)
            root = names[first][np.unique(comp, return_inverse=True)[1]]
            u.append(names[root != names])
            v.append(root[root != names])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))],
                                         names=["u", "v"])
    give_back()


def row_key(text: str = "text", key: str = "doc_id") -> Column:
    """64-bit hash by which rows of different id or text are told apart; null ids included."""
    return F.xxhash64(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`").cast("string"))


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``df``.

    ``component_id`` is the smallest id reachable by links, the row's own included.
    """
    return grouped_rows(df, text, key).select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("head.id")).otherwise(F.col("id")).alias("component_id"))


def grouped_rows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, size, row, head`` for every row of ``df``: number of shingles, ``row_key``, and the
    first row of the component by id (nulls last) and place, with its ``id`` and ``row``.

    ``head`` is null for a text without words.
    """
    bound_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").cast("bigint").alias("id"),
                     F.col(f"`{text}`").cast("string").alias("text"), row_key(text, key).alias("row"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task("jaccard_join")
        seen: set[int] = set()
        for batch in batches:
            out = {c: [] for c in ("id", "row", "size", "fp", "mark", "below", "need", "prefix", "shingles")}
            for i, row, body in zip(batch["id"], batch["row"], batch["text"]):
                codes = shingle_set(body)
                fp = _fingerprint(codes)
                new = fp not in seen and len(codes) > 0
                if len(seen) < _REMEMBERED:
                    seen.add(fp)
                prefix, mark, below = prefix_of(codes) if new else (None, None, None)
                out["id"].append(i)
                out["row"].append(row)
                out["size"].append(len(codes))
                out["fp"].append(fp)
                out["mark"].append(mark)
                out["below"].append(below.tobytes() if new else None)
                out["need"].append(smaller_needs(len(codes), int(below[LEAST_MARK - 1])) if new else None)
                out["prefix"].append(packed_numbers(np.diff(prefix >> _CELL_BITS, prepend=np.uint64(0)))
                                     if new else None)
                out["shingles"].append(len(prefix) if new else 0)
            yield pd.DataFrame(out).astype({"id": "Int64", "mark": "Int32", "need": "Int64"})
        _hashes.clear()
        give_back()

    stored = scratch.save(docs.mapInPandas(
        read, "id long, row long, size long, fp long, mark int, below binary, need long, prefix binary, shingles long").withColumn(
        "place", F.monotonically_increasing_id()))
    # one representative per shingle set, with one row that knows its prefix; up to the whole sets
    # it goes by its place, whose numbers lie close together and so travel compressed
    first = F.when(F.col("prefix").isNotNull(), F.col("place"))
    classes = scratch.save(stored.where("size > 0").groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("unnumbered"), "id", "place", "row")).alias("head"),
        F.min_by("row", first).alias("row"), F.min(first).alias("place")))
    reps = _semi(stored, classes.select("place"), "place").withColumnRenamed("place", "rep")

    shingles = stored.agg(F.sum("shingles")).first()[0] or 0
    buckets = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))
    shared = scratch.save(reps.select("rep", "prefix").mapInArrow(
        _deal_cells(buckets), "bucket int, later boolean, base long, codes binary, reps binary").repartition(
        "bucket").sortWithinPartitions("bucket", "later").mapInArrow(
        _find_cells(buckets), "rep long, token int, pivot long"))
    lists = shared.groupBy("rep").agg(F.collect_list("token").alias("shared"))
    known = scratch.save(lists.join(reps.select("rep", "size", "mark", "below", "need"), "rep"))
    records = scratch.save(_sharing_enough(known))
    scratch.release(known)
    keys = scratch.save(stored.select("id", "row", "size", "fp"))
    scratch.release(stored)
    pairs = scratch.save(shared.join(records.select("rep", "size"), "rep").select(
        "rep", "pivot", "size").distinct())
    scratch.release(shared)
    crowded = pairs.groupBy("pivot").count().where("count > 1").select("pivot")
    members = scratch.save(pairs.join(crowded, "pivot", "left_semi"))
    scratch.release(pairs)
    dealt = _blocked(members, "pivot", "rep", "size").drop("size").join(records, "rep")
    kept = scratch.save(dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(
        _borders, "rep long, size long, region long").distinct())
    scratch.release(members)
    scratch.release(records)
    places = classes.select(F.col("place").alias("rep"), "fp")
    border = scratch.save(_without_nested(kept).join(places, "rep").select(
        F.col("fp").alias("rep"), "size", "region"))
    scratch.release(kept)

    def whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task("jaccard_join")
        seen: set[int] = set()
        for batch in batches:
            out = {"rep": [], "codes": []}
            for body in batch["text"]:
                codes = shingle_set(body)
                fp = _fingerprint(codes)
                if fp not in seen:
                    if len(seen) < _REMEMBERED:
                        seen.add(fp)
                    out["rep"].append(fp)
                    out["codes"].append(packed(codes))
            yield pd.DataFrame(out)
        _hashes.clear()
        give_back()

    wanted = border.select(F.col("rep").alias("fp")).distinct().join(classes, "fp").select("row").distinct()
    sets = _semi(docs, wanted, "row").select("text").mapInPandas(whole_sets, "rep long, codes binary")
    members = scratch.save(_blocked(border, "region", "rep", "size").select("rep", "region", "i", "j"))
    few = members.count() <= BROADCAST_IDS
    links = scratch.save(sets.join(F.broadcast(members) if few else members, "rep").repartition(
        "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(_region_links, "u long, v long"))
    scratch.release(members)
    scratch.release(border)
    found = scratch.save(connected_components(links))
    scratch.release(links)
    joined = scratch.save(classes.select("fp", "head").join(
        found.select(F.col("id").alias("fp"), "component"), "fp", "left").select(
        "fp", "head", F.coalesce("component", "fp").alias("component")))
    firsts = joined.groupBy("component").agg(F.min("head").alias("head"))
    by_set = joined.select("fp", "component").join(firsts, "component").select(
        "fp", F.struct("head.id", "head.row").alias("head"))
    if joined.count() <= BROADCAST_IDS:
        by_set = F.broadcast(by_set)
    return keys.join(by_set, "fp", "left").select("id", "size", "row", "head")
