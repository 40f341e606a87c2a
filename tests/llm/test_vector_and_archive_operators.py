"""Hard negatives, whitening and WARC archives against plain versions and odd inputs."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgrove.llm import hard_negatives, warc, whitening

NAN, INF = float("nan"), float("inf")


# -- hard negatives ------------------------------------------------------------------------


def plain_negatives(rows, asks, positives=5, negatives=10, low=30, high=90, scale=256):
    """Row by row, in whole numbers of any size."""
    usable = {(i, str(lab), tuple(int(np.floor(scale * c)) for c in v)) for i, lab, v in rows
              if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    sizes = [len(v) for _, _, v in usable]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    usable = [r for r in usable if len(r[2]) == size]
    out = set()
    for i, label, v in usable:
        if not asks(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, lab) for j, lab, w in usable if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            band = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(band[:negatives], 1)}
    return out


def mined(spark, rows, asks, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    out = hard_negatives.mine(df, asks(F.col("vec_id")), **more)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(kind, n, rng):
    x = rng.standard_normal((n, 12))
    if kind == "clusters":
        x = rng.standard_normal((8, 12))[rng.integers(0, 8, n)] * 2 + 0.1 * x
    elif kind == "lengths":
        x *= np.exp(rng.standard_normal(n) * 1.5)[:, None]
    elif kind == "whole":
        x = rng.integers(-1, 2, (n, 12)).astype(float)
    return x


@pytest.mark.parametrize("kind", ["clusters", "lengths", "sphere", "whole"])
def test_hard_negatives_equal_a_plain_search(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 5)
    rng = np.random.default_rng(3)
    x = vectors(kind, 400, rng)
    rows = [(int(i), int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]
    asks = lambda i: i % 20 == 0
    got = mined(spark, rows, asks)
    assert got == plain_negatives(rows, asks) and got


def test_pruning_keeps_everything_that_reaches_the_bound():
    rng = np.random.default_rng(5)
    p = rng.standard_normal((4000, 6))
    p /= np.linalg.norm(p, axis=1)[:, None]
    for q in p[:20]:
        for cosine in (-0.5, 0.0, 0.3, 0.9, 1.0):
            low, high = hard_negatives.feasible(q, cosine)
            near = p[p @ q >= cosine - 1e-12]
            assert (near >= low).all() and (near <= high).all()
    tight = hard_negatives.feasible(np.array([1.0, 0, 0]), 0.9)
    assert tight[0][0] > 0.89 and tight[1][1] < 0.45


def test_sorted_lists_narrow_a_bucket():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.standard_normal((4, 8))[rng.integers(0, 4, 500)] + rng.standard_normal((500, 8)))
    import pyarrow as pa
    from unittest import mock
    table = pa.table({"id": pa.array(range(500), pa.int64()), "label": ["a"] * 500,
                      "vector": pa.array([list(map(int, r)) for r in x], pa.list_(pa.int64()))})
    with mock.patch("pyspark.TaskContext.get") as context:
        context.return_value.partitionId.return_value = 0
        packed = list(hard_negatives._packer(4096, 1)(iter(table.to_batches())))
    bucket = hard_negatives._Bucket(pa.Table.from_batches(packed))
    q = bucket.x[7].astype(np.int64)
    length = float(np.sqrt((q ** 2).sum()))
    scores = bucket.x.astype(np.int64) @ q
    floor = int(np.sort(scores)[-5])
    found = bucket.candidates(q, length, floor)
    assert found is not None and len(found) <= 125 and set(np.nonzero(scores >= floor)[0]) <= set(found)
    assert len(bucket.candidates(q, length, 10 * floor)) == 0


def test_hard_negatives_on_odd_rows(spark):
    v = [1.0, 0.0]
    rows = [(0, 1, v), (0, 1, v), (5, 1, v), (5, 1, v), (7, None, v), (None, 1, v), (9, 2, None), (10, 2, []),
            (11, 2, [NAN, 1.0]), (12, 2, [INF, 1.0]), (13, 2, [None, 1.0]), (14, 2, [1.0, 0.0, 3.0]),
            (20, 2, [0.5, 1.0]), (21, 2, [0.5, -1.0]), (22, 3, [0.0, 0.0]), (40, 4, [1e300, 1.0]), (60, 1, [-1.0, 0.0])]
    asks = lambda i: i % 20 == 0
    want = {r for r in plain_negatives([r for r in rows if r[0] != 40], asks)}
    got = mined(spark, rows, asks)
    assert {r for r in got if r[0] != 40} == want
    assert (0, 5, 1, 20, 65536, 32768) in got and (0, 5, 2, 21, 65536, 32768) in got
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>, vector string, id int")
    out = hard_negatives.mine(empty, F.col("vec_id") % 20 == 0)
    assert out.count() == 0 and len(out.columns) == 6
    clash = spark.createDataFrame([(*r, "x", 1) for r in rows[:3] + rows[12:14]],
                                  "vec_id long, label int, embedding array<float>, vector string, id int")
    assert hard_negatives.mine(clash, F.col("vec_id") % 20 == 0).count() > 0
    # more positives of one score than places, and a third of all rows equal
    many = [(i, i % 2, [1.0, 0.5] if i % 3 == 0 else [1.0, i / 100]) for i in range(90)]
    assert mined(spark, many, asks) == plain_negatives(many, asks)


def test_products_of_any_size_are_exact():
    rng = np.random.default_rng(1)
    for top in (2 ** 8, 2 ** 26, 2 ** 30, 2 ** 62):
        a, b = (rng.integers(-top, top, (3, 5)) for _ in range(2))
        want = [[max(-2 ** 63, min(2 ** 63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert hard_negatives.products(a, b).tolist() == want


# -- whitening -----------------------------------------------------------------------------


def embedded(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>").repartition(3)


def exact_parts(x, scale=64, shift=1_000_000):
    whole = np.floor(scale * x).astype(np.int64) + shift
    n, sums = len(x), whole.sum(axis=0)
    difference = n * whole - sums
    return difference, difference / n


@pytest.mark.parametrize("kind", ["plain", "steep", "low rank"])
def test_whitening_equals_dense_eigenvectors(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((240, 10))
    if kind == "steep":
        x *= 10.0 ** -np.linspace(0, 1.5, 10) * 50
    elif kind == "low rank":
        x = np.hstack([x[:, :6] * 20, x[:, :2] * 20, np.ones((240, 2))])
    out = whitening.whiten(embedded(spark, x), 8).toPandas()
    difference, centred = exact_parts(x)
    n, rank = len(x), 6 if kind == "low rank" else 8
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    wide = out.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.columns) == list(range(1, rank + 1)) and len(out) == n * rank
    want = centred @ vectors / np.sqrt(values)
    got = wide.to_numpy()
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    first = out.drop_duplicates("vec_id").sort_values("vec_id")
    assert first.deviation.tolist() == (difference ** 2).sum(axis=1).tolist() and set(out.n) == {n}
    share = out.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(share, values / np.trace(centred.T @ centred / n), rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9


def test_whitening_with_equal_eigenvalues_and_odd_rows(spark):
    cross = np.vstack([np.eye(5), -np.eye(5)] * 3)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(cross)]
    odd = [(90, None, "x"), (91, [], "x"), (92, [NAN] * 5, "x"), (93, [INF] * 5, "x"), (94, [None] * 5, "x"),
           (95, [1.0] * 4, "x"), (None, [1.0, 0.0, 0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, x string")
    out = whitening.whiten(df, 32).toPandas()
    assert len(out) == 31 * 5 and set(out.n) == {31} and out.identity_error[0] < 1e-9
    assert out.vec_id.isna().sum() == 5
    empty = whitening.whiten(df.limit(0))
    assert empty.count() == 0 and len(empty.columns) == 7
    assert whitening.whiten(embedded(spark, np.ones((4, 3)))).count() == 0
    assert whitening.fit_whitening(embedded(spark, np.ones((1, 3)))) is None
    huge = whitening.whiten(embedded(spark, np.array([[1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]])), 1).toPandas()
    assert len(huge) == 3 and huge.deviation.max() == 2 ** 63 - 1


def test_whitening_of_other_rows_and_early_end(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24)) * np.r_[40.0, 20.0, 10.0, np.full(21, 1.0)]
    model = whitening.fit_whitening(embedded(spark, x), 3)
    other = model.transform(embedded(spark, x[:7])).toPandas()
    whole = whitening.whiten(embedded(spark, x), 3).toPandas()
    both = other.merge(whole, on=["vec_id", "component"])
    assert len(both) == 21 and np.allclose(both.whitened_x, both.whitened_y)

    class Dense:
        dim, calls = 24, 0

        def product(self, w):
            self.calls += 1
            t = centred @ w
            return centred.T @ t, float(t @ t)

    centred = exact_parts(x)[1]
    rows = Dense()
    values, vectors = whitening.bidiagonalise(rows, 3, full=4)
    u, s, vt = np.linalg.svd(centred)
    assert np.allclose(values[:3], s[:3], rtol=1e-11)
    assert np.allclose(np.abs((vectors[:, :3] * vt[:3].T).sum(axis=0)), 1.0, atol=1e-10)


# -- WARC ----------------------------------------------------------------------------------


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_round_trip_and_revisits(spark, tmp_path):
    rng = random.Random(4)
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n"
    texts = ["", None, "x", "x\r\n\r\n", tricky, "é中😀" * 50, "long " * 300_000] + [f"page {i % 40}" for i in range(200)]
    pages = [(i if i != 9 else None, None if i == 3 else f"http://a.b/{i}\r\nX: y", t, "z") for i, t in enumerate(texts)]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(4)
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_pages(df, source, date="2024-05-06T07:08:09Z")
    raw = warc.read_archives(spark, source, True).collect()
    assert sorted(r["payload"] for r in raw) == sorted((t or "").encode() for t in texts)
    assert {r["record_type"] for r in raw} == {"response"} and len({r["record_id"] for r in raw}) == len(texts)
    by_key = {r["key"]: r for r in raw}
    assert by_key["3"]["target_uri"] is None and by_key["5"]["target_uri"] == "http://a.b/5%0D%0AX: y"

    warc.deduplicate(spark, source, target)
    first: dict = {}
    for key, _, text, _ in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault((text or "").encode(), key)
    want = []
    for key, _, text, _ in pages:
        payload = (text or "").encode()
        head = first[payload]
        want.append((key, len(payload), sha(payload), "response" if head == key else "revisit",
                     None if head == key else head))
    got = warc.resolved(warc.read_archives(spark, target)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = warc.read_archives(spark, target, True).where("record_type = 'response'").collect()
    assert {r["payload"] for r in kept} == set(first) and len(kept) == len(first)
    assert not {r["record_id"] for r in kept} & {r["record_id"] for r in raw}
    # a second pass changes nothing but the record ids
    again = str(tmp_path / "c")
    warc.deduplicate(spark, target, again)
    assert sorted(map(str, warc.resolved(warc.read_archives(spark, again)).collect())) == sorted(map(str, got))
    # short payloads may be left alone
    short = str(tmp_path / "d")
    warc.deduplicate(spark, source, short, min_bytes=2)
    left = {r["key"]: r["record_type"] for r in warc.resolved(warc.read_archives(spark, short)).collect()}
    assert left[0] == left[1] == "response" and left[100] == "revisit"


def test_plain_parser_agrees(spark, tmp_path):
    """Read the archives byte by byte as the format says, and feed the reader foreign ones."""
    path = str(tmp_path / "a")
    warc.write_pages(spark.createDataFrame([(1, "u", "abc"), (2, "v", "abc")], "page_id int, url string, html string")
                     .coalesce(1), path)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("*.gz"))
    seen = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        block, end = rest[:size], rest[size:size + 4]
        assert head.startswith(b"WARC/1.1\r\n") and end == b"\r\n\r\n" and block.endswith(b"\r\n\r\nabc")
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + sha(b"abc").encode()
        data, seen = rest[size + 4:], seen + 1
    assert seen == 2

    def record(kind, block, **more):
        lines = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()],
                 f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    foreign = tmp_path / "f"
    foreign.mkdir()
    http = b"HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\n"
    kinds = "application/http; msgtype=response"
    records = [record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:i>"),
               record("response", http + b"abc", WARC_Record_ID="<urn:uuid:r>", Content_Type=kinds),
               record("revisit", http, WARC_Record_ID="<urn:uuid:s>", Content_Type=kinds,
                      WARC_Payload_Digest="sha1:" + sha(b"abc")),
               record("revisit", b"", WARC_Record_ID="<urn:uuid:t>", WARC_Payload_Digest="sha1:" + sha(b"gone"),
                      WARC_Refers_To="<urn:uuid:lost>")]
    (foreign / "one.warc").write_bytes(b"".join(records[:2]))
    (foreign / "two.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[2:]))
    out = str(tmp_path / "g")
    warc.deduplicate(spark, str(foreign), out)
    back = {r["record_type"] + str(i): r for i, r in enumerate(sorted(
        warc.read_archives(spark, out, True).collect(), key=lambda r: (r["record_type"], r["payload_digest"] or "")))}
    info = next(r for r in back.values() if r["record_type"] == "warcinfo")
    assert info["payload"] == b"software: x\r\n"
    response = next(r for r in back.values() if r["record_type"] == "response")
    assert response["http"] == http and response["payload"] == b"abc"
    named = {r["payload_digest"]: r["refers_to_id"] for r in back.values() if r["record_type"] == "revisit"}
    assert named == {sha(b"abc"): response["record_id"], sha(b"gone"): "lost"}
    for broken in (b"nonsense\r\n", records[1][:-20]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(broken)))


def test_empty_table_to_archives(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(empty, str(tmp_path / "a"))
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "b"))).count() == 0
