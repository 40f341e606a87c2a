"""Operators that move rows: sharding, packing, neighbours, Jaccard join, pipeline."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgrove.llm import components, jaccard_join, neighbours, packing, partitions, sharding

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_communication_matrix_is_exact_and_uniform():
    rows = np.array([5, 0, 17, 30])
    sizes = sharding.shard_sizes(52, 5)
    assert sizes.tolist() == [11, 11, 10, 10, 10]
    drawn = [sharding.communication_matrix(rows, sizes, s) for s in range(600)]
    assert all((m.sum(1) == rows).all() and (m.sum(0) == sizes).all() for m in drawn)
    assert np.allclose(np.mean(drawn, axis=0), np.outer(rows, sizes) / 52, atol=0.3)


def test_sharding(spark):
    df = spark.createDataFrame([(i % 3, None if i % 7 == 0 else "x", i) for i in range(101)],
                               "doc_id long, shard string, slot int").repartition(6)
    out = sharding.shuffle_into_shards(df, 4, block_rows=10)
    assert out.columns == ["doc_id", "shard", "slot"]
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [25, 25, 25, 26]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(r["doc_id"] for r in rows) == Counter(i % 3 for i in range(101))
    assert sharding.shuffle_into_shards(df.limit(0), 4).count() == 0
    assert sharding.shuffle_into_shards(df.limit(2), 4).count() == 2
    other = sharding.shuffle_into_shards(spark.range(400), 2, seed=1)
    places = {r["id"]: r["slot"] for r in other.collect()}
    assert abs(np.corrcoef(list(places), list(places.values()))[0, 1]) < 0.2


def test_word_ids_match_the_library():
    from quietgrove.llm.word_bpe import WordBpe
    library, own = tokenizers.Tokenizer.from_file(WORD_BPE), WordBpe(WORD_BPE)
    rng = random.Random(5)
    signs = ["abcdefghijklmnop", "aabAB", "éèaüßÉÏİ", "!?#$%&'", "0123456789", "ab cd  e\n\n'st<|endoftext|>",
             "  \n\t x\x1c\x85\xa0", "中文字日本ΣσáÅ", "don't we'll '"]
    for _ in range(600):
        a = rng.choice(signs) + rng.choice(signs)
        text = "".join(rng.choice(a) for _ in range(rng.randint(0, 400)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 3, 50, 90]))) for _ in range(120)] + [None, "", "long " * 700]
    df = spark.createDataFrame([(i % 118, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    out = packing.pack(df, WORD_BPE, window=128, shard_tails=40).toPandas()
    want = Counter((i % 118, tuple(library.encode(t or "", add_special_tokens=False).ids + [1]))
                   for i, t in enumerate(texts))
    pieces = defaultdict(lambda: defaultdict(list))
    for r in out.itertuples():
        ids = tuple(np.frombuffer(r.ids, dtype="<u4").tolist())
        assert len(ids) == r.length
        pieces[r.doc_id, r.doc_tokens][r.start].append(ids)
    assert sum(out.length) == sum(len(k[1]) * n for k, n in want.items())
    for (doc, ids), n in want.items():
        if n == 1 and sum(k[0] == doc for k in want) == 1:
            got = pieces[doc, len(ids)]
            assert sum((list(got[s][0]) for s in sorted(got)), []) == list(ids)
    sequences = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (sequences.length.cumsum() - out.length == out.offset).all()
    sizes = sequences.length.sum()
    assert all(n == 128 or n & (n - 1) == 0 for n in sizes) and sizes.max() == 128
    assert packing.pack(df.limit(0), WORD_BPE).count() == 0


def test_packing_brings_copies_together_in_many_shards(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocab, k=14)
        texts += [" ".join(base[:-1] + [rng.choice(vocab)]) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    out = packing.pack(df, WORD_BPE, window=128, shard_tails=20).toPandas()
    near = {i for _, s in out.groupby("sequence_id") for i in s.doc_id
            if sum(j // 4 == i // 4 for j in set(s.doc_id)) > 1}
    assert len(near) > 0.7 * len(texts), len(near)
    assert out.groupby("sequence_id").offset.apply(lambda o: o.is_unique).all()


def test_packing_takes_the_nearest_tail_first():
    tails = [np.array(x, dtype=np.uint16) for x in ([5, 6, 7, 8], [50, 51, 52], [5, 6, 9], [5, 60, 61])]
    index = packing.ShardIndex(tails, np.ones(1 << 16), 3.0)
    windows = packing.fill_windows(tails, index, 8)
    assert windows[0] == [(0, 0, 4), (2, 0, 3), (3, 0, 1)]
    assert windows[1] == [(3, 1, 2), (1, 0, 3)]
    assert packing.power_of_two_cuts(windows[1]) == [[(3, 1, 2), (1, 0, 2)], [(1, 2, 1)]]


def brute_neighbours(rows, k):
    rows = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            hits = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in hits]
    return out


def test_neighbours_small_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(150)]
    rows += [(i, rows[5][1]) for i in range(200, 290)] + [rows[7], rows[7]]
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(301, None), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [1.0, 2.0]),
           (None, rows[0][1]), (320, [None] * 8)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, score double")
    out = neighbours.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_neighbours(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    few = neighbours.search(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0, 20)
    assert few.count() == 2
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((30, 16)) * 3
    rows = [(i, (centers[i % 30] + rng.standard_normal(16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.learn_index(np.array([v for _, v in rows]), 20)
    assert 1 < index.router.n_parts and index.probes < index.router.n_parts
    out = neighbours.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    got = defaultdict(set)
    for r in out:
        got[r["query_id"]].add(r["vec_id"])
    want = brute_neighbours(rows, 20)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "sphere", "lengths"])
def test_neighbours_in_parts_that_are_split_again(spark, monkeypatch, kind):
    """Crowded parts get routers of their own; recall stays, and queries go to their parts only."""
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", 300)
    monkeypatch.setattr(neighbours, "SAMPLE", 1024)
    monkeypatch.setattr(neighbours, "SLICE", 150)
    monkeypatch.setattr(neighbours, "QUERY_SLICE", 40)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 12))
    if kind == "clusters":
        x = rng.standard_normal((60, 12))[np.arange(4000) % 60] * 4 + 0.5 * x
    elif kind == "lengths":
        x *= np.exp(rng.standard_normal(4000))[:, None]
    else:
        x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(neighbours, "grow", lambda *a, f=neighbours.grow: seen.append(f(*a)) or seen[-1])
    got = defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20, max_parts=8).collect():
        got[r["query_id"]].add(r["vec_id"])
    index, leaves = seen[0], seen[0].n_parts - len(seen[0].inner)
    assert index.inner and leaves > 8
    own = index.own_part(x)
    assert len(set(own)) > 8 and not set(own) & set(index.inner)
    order = index.order(x[:50], leaves)
    assert all(sorted(o) == sorted(set(range(index.n_parts)) - set(index.inner)) for o in order)
    want = brute_neighbours(rows, 20)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9
    if kind == "clusters":
        assert index.probes <= leaves / 3


def test_balanced_parts():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.standard_normal((100, 8)) + 8 * c for c in np.eye(8)[:4]])
    part = partitions.balanced_parts(partitions.neighbour_graph(vectors), 4, rng)
    assert np.bincount(part).tolist() == [100] * 4


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 5), (20, 21), (7, 20), (-4, 7)] + [(100 + i, 101 + i) for i in range(40)]
    out = {r["id"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(out[i] == 1 for i in (1, 2, 3, 9)) and all(out[i] == -4 for i in (-4, 7, 20, 21))
    assert all(out[100 + i] == 100 for i in range(41)) and len(out) == 49


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copies(rng, n, length):
    """Chains and groups of copies whose similarity lies around the threshold."""
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    while len(texts) < n:
        base = rng.choices(vocab, k=rng.choice(length))
        for _ in range(rng.choice([1, 1, 4, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words[rng.randint(0, 2):]))
            if rng.random() < 0.3:
                base = words
    return texts[:n]


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_jaccard_join(spark, monkeypatch, block_rows):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block_rows)
    rng = random.Random(block_rows)
    passage = " " + " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng, 150, [3, 5, 6, 8, 20, 60, 200])
    texts = [t + passage if rng.random() < 0.3 else t for t in texts]
    texts += [None, "", " \n\t", "one", "ONE", "Two Words", "two words", "a b c d e", "A B C D E", texts[0], texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, "nobody else says so")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, size int")
    got = Counter(map(tuple, jaccard_join.jaccard_components(df).collect()))
    assert got == plain_components(rows)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_links_between_texts_that_waited_in_different_components():
    """Two growing components overtake each other, and one link joins them; in every order."""
    starts = [0, 1, 13, 39, 40, 41, 26]
    sets = [np.arange(s, s + 100, dtype=np.uint64) for s in starts]
    for order in itertools.permutations(range(len(sets))):
        assert len(set(jaccard_join.linked_components([sets[i] for i in order]))) == 1, order


def test_jaccard_join_null_ids_come_first(spark):
    """Copies held by null-id rows alone, or first by one, keep their links."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1])
    rows = [(None, " ".join(words)), (7, " ".join(words)), (4, near), (None, "x " + near), (None, "lone " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter(map(tuple, jaccard_join.jaccard_components(df).collect()))
    assert got == plain_components(rows)
    assert {c for *_, c in got} == {4, None}


def test_border_bound_never_loses_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2)
        a = np.unique(base)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.15], rng.integers(
            0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        (pa, ma, ba), (pb, mb, bb) = jaccard_join.prefix_of(a), jaccard_join.prefix_of(b)
        if 100 * common >= 75 * len(np.union1d(a, b)):
            assert common >= jaccard_join.overlap_needed(len(a), len(b))
            m = min(ma, mb) - 1
            c = len(np.intersect1d(pa, pb))
            assert jaccard_join.possible(c, len(a), len(b), ba[m], bb[m])
            small, below = min((len(a), ba), (len(b), bb), key=lambda x: x[0])
            assert c >= jaccard_join.smaller_needs(small, below[jaccard_join.LEAST_MARK - 1])


def test_pipeline(spark, sf):
    """Against a plain version of each stage."""
    import corpus_pipeline as pipeline
    from test_text_operators import plain_measures
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "packing"]
    kept = pipeline.keep_languages(spark, docs, sf)
    assert kept.columns == docs.columns
    lettered = {i for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in kept.collect()} == lettered
    good = pipeline.keep_quality(spark, kept, sf)
    want = set()
    for i in lettered:
        words, chars, symbols, dup, rep = plain_measures(rows[i])
        lines = [x for x in rows[i].split("\n") if x.strip(" \t\n\v\f\r")]
        letters = sum(any(c.isalpha() for c in w) for w in rows[i].split())
        if not (words < 10 or 100 * rep > 20 * words or 5 * symbols > words or chars < 2 * words
                or chars > 15 * words or 10 * dup > 3 * len(lines) or 10 * letters < 7 * words):
            want.add(i)
    assert {r["doc_id"] for r in good.collect()} == want
    single = pipeline.drop_near_duplicates(spark, good, sf)
    groups = plain_components([(i, rows[i]) for i in sorted(want)])
    first = {d for d, _, c in groups if d == c}
    assert {r["doc_id"] for r in single.collect()} == first and single.columns == docs.columns
    out = pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) == first
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    for i in sorted(first)[:20]:
        ids = np.array(library.encode(rows[i], add_special_tokens=False).ids + [1], dtype="<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert zlib.crc32(b"".join(mine.ids)) == zlib.crc32(ids.tobytes())
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    twice = docs.limit(30).unionByName(docs.limit(30))
    assert pipeline.drop_near_duplicates(spark, twice, sf).count() <= 30


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """Null and repeated ids never decide whether different texts stay."""
    import corpus_pipeline as pipeline
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(7)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]),
            (3, texts[3]), (5, texts[4]), (5, texts[3] + " x"),     # 5 has a text of its own and a copy of 3's
            (9, texts[5]), (None, texts[5]), (9, texts[5]), (6, texts[6]), (6, texts[6] + " y"), (8, "")]
    want = Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (5, texts[4]),
                    (9, texts[5]), (6, texts[6]), (8, "")])
    for seed in range(2):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 3 * seed)
        out = pipeline.drop_near_duplicates(spark, df, "")
        got = Counter((d, t.removesuffix(" y")) for d, t in map(tuple, out.collect()))
        assert got == want and out.columns == df.columns


def test_pipeline_rejects_texts_of_no_learned_language(spark, sf):
    """Another script, another language of the same script and random letters go; clean texts stay."""
    import corpus_pipeline as pipeline
    rng = random.Random(9)
    strange = ["Съешь же ещё этих мягких французских булок да выпей чаю. Все счастливые семьи похожи.",
               "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
               "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on "
               "annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
               " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = {r["doc_id"] for r in pipeline.keep_languages(spark, docs.unionByName(extra), sf).collect()}
    assert not {i for i in kept if i < 0}
    assert kept == {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}


def test_packed_sets_come_back():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        codes = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        back = jaccard_join.unpacked(jaccard_join.packed(codes))
        assert back.dtype == np.uint64 and (back == codes >> np.uint64(8)).all()
    edge = np.array([0, 2 ** 64 - 1], dtype=np.uint64)
    assert jaccard_join.unpacked(jaccard_join.packed(edge)).tolist() == [0, 2 ** 56 - 1]


@pytest.mark.parametrize("few", [2, 64])
def test_cells_are_whole_and_a_bucket_holds_few_texts_of_a_shingle(monkeypatch, few):
    """Shingles travel as gaps, and of a frequent one a bucket holds two texts per dealt lot at once."""
    import pyarrow as pa
    monkeypatch.setattr(jaccard_join, "FEW_TEXTS", few)
    monkeypatch.setattr(jaccard_join, "DEALT_SHINGLES", 2_000)
    rng = np.random.default_rng(few)
    sets = {int(r): np.unique(np.concatenate([rng.integers(0, 1 << 46, 60), rng.integers(0, 40, 3), [5]])).astype(np.uint64)
            for r in rng.choice(1 << 35, 200, replace=False)}
    rows = pa.RecordBatch.from_pydict({
        "rep": list(sets), "prefix": [jaccard_join.packed_numbers(np.diff(s, prepend=np.uint64(0))) for s in sets.values()]})
    dealt = pa.Table.from_batches(jaccard_join._deal_cells(7)(iter([rows]))).sort_by([("bucket", "ascending"), ("later", "ascending")])
    assert dealt.nbytes < 12 * sum(map(len, sets.values()))
    assert any(dealt["later"].to_pylist()) == (few == 2)
    lots = Counter()
    for row in dealt.to_pylist():
        codes = np.cumsum(jaccard_join.unpacked_numbers(row["codes"]), dtype=np.uint64)
        if not row["later"]:
            assert max(Counter(codes.tolist()).values()) <= max(few, 2)
        lots[row["bucket"], row["later"]] += 1
    found = defaultdict(set)
    for batch in jaccard_join._find_cells(7)(iter(dealt.to_batches(max_chunksize=3))):
        for row in batch.to_pylist():
            found[row["token"]].add((row["rep"], row["pivot"]))
    holders = defaultdict(list)
    for rep, s in sets.items():
        for token in s.tolist():
            holders[token].append(rep)
    wanted = defaultdict(set)
    for token, reps in holders.items():
        if len(reps) > 1:
            pivot = min(reps, key=lambda r: int(jaccard_join._places(np.array([r]))[0]))
            wanted[int(np.uint32(token & 0xFFFFFFFF).view(np.int32))] |= {(r, pivot) for r in reps}
    assert found == wanted


def test_borders_of_many_regions_are_those_of_each(monkeypatch):
    import pandas as pd
    import pyarrow as pa
    rng = np.random.default_rng(4)
    rows = []
    for pivot, n in enumerate([1, 2, 2, 3, 9, 40, 2, 70, 5, 1, 30]):
        base = rng.integers(0, 1 << 63, 80).astype(np.uint64) * np.uint64(2)
        for rep in range(n):
            codes = np.unique(np.concatenate([base[rng.random(80) > rng.choice([0.05, 0.2, 0.6])], rng.integers(
                0, 1 << 63, rng.integers(1, 30)).astype(np.uint64)]))
            prefix, mark, below = jaccard_join.prefix_of(codes)
            rows.append((pivot, 0, 0, 1000 * pivot + rep, len(codes), mark, below.tobytes(),
                         (prefix >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()))
    names = ["pivot", "i", "j", "rep", "size", "mark", "below", "shared"]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
        pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())))], names=names)
    wanted = Counter()
    for _, region in pd.DataFrame(rows, columns=names).groupby("pivot"):
        if len(region) > 1:
            wanted[frozenset(region["rep"][jaccard_join._large_border(region)])] += 1
    for rows_at_once in (1, 7, 1000):
        got = defaultdict(set)
        for batch in jaccard_join._borders(iter(table.to_batches(max_chunksize=rows_at_once))):
            for row in batch.to_pylist():
                got[row["region"]].add(row["rep"])
        assert set(map(frozenset, got.values())) == set(wanted) - {frozenset()}
    assert 1 < len(got) < 9
