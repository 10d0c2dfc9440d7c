"""Properties that the SQL comparison does not show."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.operators import allpoints, cluster, codec, wavelet
from loadlens.sources import binary
from loadlens.sources.regiondb import RegionDB


@pytest.mark.parametrize("n", [2**k for k in range(1, 12)])
def test_lifting_equals_convolution(n):
    x = np.array([((i * 7919) % 1000) / 1000 + i + 0.4 * i - 0.02 * i * i for i in range(n)])
    span = max(np.ptp(x), 1e-9)
    lift = wavelet.forward_once(x)
    assert np.sqrt(np.mean((lift - wavelet.direct_once(x)) ** 2)) / span <= 1e-8
    assert np.sqrt(np.mean((x - wavelet.inverse_once(lift)) ** 2)) / span <= 1e-12
    assert np.sqrt(np.mean((x - wavelet.direct_inverse_once(lift)) ** 2)) / span <= 1e-8


@pytest.mark.parametrize(("rows", "cols"), [(2, 2), (4, 16), (16, 64), (64, 32), (1, 8)])
def test_matrix_round_trip(rows, cols):
    i, j = np.mgrid[:rows, :cols]
    m = i + 0.4 * i**2 - 0.02 * i**2 * j
    for level in range(int(math.log2(max(min(rows, cols), 1))) + 1):
        assert np.allclose(wavelet.inverse2(wavelet.forward2(m, level), level), m)


def test_reassembled_rows_are_a_permutation(spark):
    for blocks, per, level in ((4, 8, 2), (2, 16, 3), (8, 4, 1), (1, 8, 2)):
        rows = spark.range(blocks * per).withColumn("place", wavelet.reassembled_row("id", blocks, per, level))
        block, own = wavelet.block_row("place", blocks, per, level)
        found = rows.select("id", "place", block.alias("block"), own.alias("own")).collect()
        assert sorted(r.place for r in found) == list(range(blocks * per))
        assert all((r.block, r.own) == divmod(r.id, per) for r in found)


@pytest.mark.parametrize(("shape", "level"), [((16, 32), 3), ((8, 8), 3), ((32, 4), 1)])
def test_distributed_pyramid(spark, shape, level):
    r = np.random.default_rng(2)
    mats = {k: r.normal(size=shape) for k in "ab"}
    rows = spark.createDataFrame([(k, i, m[i].tolist()) for k, m in mats.items() for i in range(shape[0])], "region string, rank long, vals array<double>")
    collect = lambda df: {k: np.stack([x.vals for x in sorted((x for x in df.collect() if x.region == k), key=lambda x: x["rank"])]) for k in mats}
    made = wavelet.dwt2_large(rows, ["region"], level, shape)
    assert all(np.allclose(collect(made)[k], wavelet.forward2(m, level)) for k, m in mats.items())
    for undo in range(level + 1):
        back = collect(wavelet.idwt2_large(made, ["region"], level, shape, undo))
        assert all(np.allclose(back[k], wavelet.inverse2(wavelet.forward2(m, level), level, undo)) for k, m in mats.items())


def test_guides_keep_equal_keys(spark):
    from loadlens.functions import paths

    path = "array<struct<module:string,off:long>>"
    f = lambda *names: [(n, 1) for n in names]
    keys = spark.createDataFrame([(1, f("leaf", "mid", "main"), f("main")), (1, f("leaf", "mid", "main"), f("main")), (2, [], f("main")), (3, None, None), (4, f("main"), f("x", "main")), (5, f("other"), f("main"))], f"id long, start {path}, end {path}")
    guides = spark.createDataFrame([(f("mid", "main"), f("main")), (f("main"), f("x", "main"))], f"start {path}, end {path}")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(paths.keep_guided(keys, guides, {"start": "start", "end": "end"})) == [1, 1, 4]
    assert ids(paths.keep_guided(keys, guides.limit(1), {"start": "start"})) == [1, 1]
    assert ids(paths.keep_guided(keys, spark.createDataFrame([([],)], f"guide {path}"), {"start": "guide"})) == [1, 1, 2, 4, 5]
    assert ids(paths.keep_guided(keys, None)) == [1, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_nearest_symbol_over_ranges(spark, monkeypatch, bits):
    from loadlens.functions import paths

    monkeypatch.setattr(paths, "RANGE_BITS", bits)
    table = [(m, a, f"{m}{a}") for m in "ab" for a in (3, 4, 40, 41, 200)]
    asked = [(m, o) for m in "abc" for o in (0, 3, 39, 40, 100, 199, 200, 5000)]
    found = paths.nearest_symbol(spark.createDataFrame(asked, "module string, off long"), spark.createDataFrame(table, "module string, addr long, symbol string")).collect()
    want = {(m, o): max(((a, s) for n, a, s in table if n == m and a <= o), default=(None, None)) for m, o in asked}
    assert {(r.module, r.off): (r.addr, r.symbol) for r in found} == want


def test_numbers_without_gaps(spark):
    from pyspark.sql import functions as F

    from loadlens.operators.checkpoints import numbered

    rows = spark.range(997).select((F.col("id") * 7919 % 997).alias("x"), F.concat(F.lit("k"), F.col("id") % 10).alias("y"))
    found = numbered(rows.repartition(5), [F.desc("y"), "x"]).collect()
    order = sorted(found, key=lambda r: (-int(r.y[1:]), r.x))
    assert [r.id for r in order] == list(range(997))
    assert numbered(rows.limit(0), ["x"]).count() == 0


def test_log_of_zeros_and_refused_shapes(spark):
    from loadlens.operators import effortlog

    rows = spark.createDataFrame([("z", i, [0.0] * 8) for i in range(8)] + [("one", i, [float(i == 3)] * 8) for i in range(8)], "region string, rank long, vals array<double>")
    for encoding in codec.ENCODERS:
        made = effortlog.compress(rows, ["region"], (8, 8), scale=1024, blocks=2, encoding=encoding).cache()
        back = {(r.region, r["rank"]): r.vals for r in effortlog.reconstruct(made, ["region"]).collect()}
        assert all(np.allclose(back[r.region, r["rank"]], r.vals, atol=0.01) for r in rows.collect()) and len(back) == 16
        assert {r.region: r.passes for r in made.collect()}["z"] == 0
    with pytest.raises(ValueError, match="powers of two"):
        effortlog.compress(rows, ["region"], (8, 6))
    with pytest.raises(ValueError, match="powers of two"):
        effortlog.compress(rows, ["region"], (8, 8), blocks=8)


def test_summary_and_trace(spark, tmp_path):
    from loadlens.operators import sampling
    from loadlens.streaming import steps

    long = spark.createDataFrame([("a", r, s, float(r * s % 7)) for r in range(8) for s in range(8)], "region string, rank long, step long, v double")
    updated = sampling.updates(long, ["region"], 4).cache()
    assert sorted((r.update, r["size"]) for r in updated.collect()) == [(1, 8), (2, 8)]
    for _ in range(2):
        sampling.write_summary(updated, 4, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 4
    for n in (0, 1, 1):  # a batch that runs again replaces its own
        steps.append_trace(long.where(f"step = {n}"), str(tmp_path / "t"), n)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 16


def plain_sizes(q, level, passes):
    """Bits of each pass by a walk cell by cell: values leave when they are found, a zerotree ends its branch below the low band."""
    rows, cols = q.shape
    low_r, low_c = rows >> level, cols >> level
    lead = lambda v: 1 << (abs(int(v)).bit_length() - 1) if v else 0

    def children(r, c):
        if r < low_r and c < low_c:
            return [(r, c + low_c), (r + low_r, c), (r + low_r, c + low_c)]
        return [(2 * r + i, 2 * c + j) for i in (0, 1) for j in (0, 1)] if 2 * r < rows and 2 * c < cols else []

    def tree(r, c):
        out = lead(q[r, c])
        for x, y in children(r, c):
            out |= tree(x, y)
        return out

    trees = {(r, c): tree(r, c) for r in range(rows) for c in range(cols)}
    t, found, out = lead(np.abs(q).max()), 0, []
    while t and (not passes or len(out) < passes):
        todo, visits = [(r, c) for r in range(low_r) for c in range(low_c)], 0
        while todo:
            r, c = todo.pop()
            visits += 1
            found += lead(q[r, c]) == t
            if trees[r, c] & t or (r < low_r and c < low_c):
                todo += children(r, c)
        t >>= 1
        out.append((2 * visits, found if t else 0))
    return out


@pytest.mark.parametrize(("rows", "cols", "level"), [(8, 8, 3), (16, 64, 3), (16, 4, 2), (4, 32, 1)])
def test_visiting_order(rows, cols, level):
    order, tree = codec.visit_order(rows, cols, level), codec.Tree(rows, cols, level)
    assert [(int(a) // cols, int(a) % cols) for a in tree.at] == [(r, c) for r, c, _ in order]
    assert [int(e) - i for i, e in enumerate(tree.end)] == [n for *_, n in order]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-2000, 2000), min_size=64, max_size=64), st.integers(0, 12))
def test_bit_planes_equal_the_coder(values, passes):
    q = np.array(values).reshape(8, 8)
    data, sizes = codec.ezw_encode(q, 3, passes)
    top = 1 << (int(np.abs(q).max()).bit_length() - 1) if q.any() else 0
    back, used = codec.ezw_decode(data, 8, 8, 3, top, passes)
    assert used == len(data) == -(-sum(map(sum, sizes)) // 8)
    assert sizes == plain_sizes(q, 3, passes)
    if passes == 0 or top >> (passes - 1) == 0:
        assert (back == q).all()
    else:
        low, step = top >> (passes - 1), top >> passes
        size = np.abs(q)
        assert (back == np.where(size < low, 0, np.sign(q) * (size - size % max(step, 1)))).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(0, 40000))
def test_byte_codecs(data, run):
    data += b"\0" * (run if run % 5 == 0 else run % 9)
    assert codec.rle_decode(codec.rle_encode(data)) == data
    parts = [codec.rle_encode(data[:50]), b"", codec.rle_encode(data[50:])]
    assert codec.rle_merge(parts) == codec.rle_encode(data)
    assert codec.rle_histogram(parts) == dict(Counter(data))
    assert codec.huffman_decode(codec.huffman_encode(data), len(data)) == data
    assert codec.arithmetic_decode(codec.arithmetic_encode(data[:300])) == data[:300]
    frames = codec.framed_encode(data[:300], 64)
    assert codec.framed_decode(frames) == data[:300]
    assert data[:300].startswith(codec.framed_decode(frames, len(frames) // 2))


@pytest.mark.parametrize("encoding", ["rle", "huffman", "arithmetic"])
def test_payload(encoding):
    q = (np.arange(256).reshape(16, 16) * 37 % 101 - 50) * (np.arange(256).reshape(16, 16) % 3 == 0)
    data, size = codec.encode_payload(q, 2, 0, encoding)
    assert size["enc_size"] == len(data)
    assert (codec.decode_payload(data, 16, 16, 2, 32, 0, size["rle_size"], encoding)[0] == q).all()
    halves = [codec.encode_block(x, 2, 32) for x in (q[:8], q[8:])]
    both, rle_size = codec.finish([x[0] for x in halves], encoding)
    assert (np.concatenate(codec.decode_payload(both, 16, 16, 2, 32, 0, rle_size, encoding, blocks=2)) == q).all()
    with pytest.raises(ValueError):
        codec.encode_payload(q, 2, 0, "none")
    with pytest.raises(ValueError):
        codec.resolve_level(1, 1, 8)


@given(st.integers(0, 2**60))
def test_varints(n):
    assert binary.Reader(binary.put_varint(n)).varint() == n


def test_keys_and_headers():
    path = [("main", 16), ("lib", 3), ("main", 2**33)]
    for start, end in ((path, None), (None, None), (path, path[:1])):
        assert binary.get_key(binary.Reader(binary.put_key("time", -3, start, end))) == ("time", -3, start, end)
    for threshold in (0, 1, 4096):
        head = dict(zip(binary.HEADER, (16, 64, 3, -77, 1024, threshold, 2, 1, 9, 800, 700, 600), strict=True))
        assert binary.get_header(binary.Reader(binary.put_header(head))) == head


def test_medoids_and_linkage():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.1, (12, 4)) for c in (0, 5, 9)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    medoids, cost = cluster.pam(d, 3)
    assert {m // 12 for m in medoids} == {0, 1, 2}
    assert cost <= cluster.pam(d, 2)[1]
    assert len(cluster.xpam(d, 6, 4)[0]) == 3
    merges = cluster.complete_linkage(list(range(36)), d)
    assert [m[3] for m in merges] == sorted(m[3] for m in merges)
    assert len(set(cluster.flatten(merges, 36, 3))) == 3
    assert cluster.depth(merges, 36) >= 4


def test_listeners_and_state(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from loadlens.streaming import comm, steps

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = steps.event_stream(spark, str(tmp_path / "in"), schema)
    q = steps.with_listeners(steps.step_totals(stream), {"a": (1, lambda batch, n: seen.append((n, batch.count()))), "b": (99, lambda batch, n: seen.append("never"))}, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen and "never" not in seen
    marked = stream.select(F.expr("user_id % 16").alias("rank"), "ts", "event_id", F.col("event_type").alias("path"))
    found = steps.run_to_table(steps.elapsed_stream(marked), "elapsed", str(tmp_path / "d"), "append")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("user_id % 16").alias("rank"), "ts", "event_id", F.col("event_type").alias("path"))
    batch = comm.comm_regions(events).select("rank", "event_id", "elapsed", "start_path", "end_path")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, batch.collect()))


def test_clusterings_of_all_signatures(spark, sf_dir):
    from loadlens import plans
    from loadlens.plans.transforms import signatures

    points = {r["id"]: np.array(r["vals"]) for r in signatures(spark, sf_dir).collect()}
    ids = sorted(points)
    d = np.array([[np.linalg.norm(points[a] - points[b]) for b in ids] for a in ids])
    linked = {r["id"]: r["cluster"] for r in plans.QUERIES["o07_flatten_clusters"](spark, sf_dir).collect()}
    assert sorted(linked) == ids and len(set(linked.values())) == 10
    assigned = {r["id"]: r for r in plans.QUERIES["k05_pam"](spark, sf_dir).collect()}
    own = sorted({r["medoid"] for r in assigned.values()})
    assert sorted(assigned) == ids and len(own) == 10
    at = [ids.index(m) for m in own]
    assert np.allclose([assigned[i]["d"] for i in ids], d[:, at].min(1))
    cost = d[:, at].min(1).sum()
    for k in range(10):  # no swap of a medoid for any signature is better
        rest = d[:, at[:k] + at[k + 1 :]].min(1)
        assert np.minimum(rest[:, None], d).sum(0).min() > cost - 1e-6
    medoids = plans.QUERIES["k06_xpam_bic"](spark, sf_dir).collect()
    assert {round(r["bic"], 4) for r in medoids} == {round(max(cluster.bic(d, cluster.pam(d, k)[0], 16) for k in range(1, 13)), 4)}


def test_pairs_of_many_points(spark):
    """More points than a matrix on the driver may have, odd ones among them: every pair once, rounded half up."""
    from pyspark.sql import functions as F

    n = 5_100
    x = np.random.default_rng(2).normal(size=(n, 3))
    x[7] = x[4_000]
    points = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, vals array<double>")
    found = cluster.pair_distances(points, ["euclidean", "manhattan"], digits=6)
    ends = found.agg(F.count("*").alias("n"), F.sum("manhattan").alias("s"), F.min(F.col("b") - F.col("a")).alias("least"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    assert ends["n"] == n * (n - 1) // 2 and ends["least"] == 3
    ranks = np.arange(n)
    sums = sum(float((np.sort(v) * (2 * ranks - n + 1)).sum()) for v in x.T)  # of |difference| over all pairs
    assert math.isclose(ends["s"], sums, rel_tol=1e-7)
    own = spark.range(n).select((F.col("id") * 3).alias("a"))
    assert ends["h"] == own.crossJoin(own.withColumnRenamed("a", "b")).where("a < b").agg(F.bit_xor(F.xxhash64("a", "b"))).first()[0]
    near = {(r.a, r.b): r.euclidean for r in found.where("b = 12000 and a in (21, 24)").collect()}
    assert near[21, 12_000] == 0 and near[24, 12_000] == round(float(np.linalg.norm(x[8] - x[4_000])), 6)
    assert cluster.pair_distances(points.where("id < 1"), ["euclidean"]).count() == 0


def grid(n: int, seed: int = 4) -> np.ndarray:
    """Points with whole coordinates: many copies, and equal distances between others."""
    return np.random.default_rng(seed).integers(0, 6, (n, 3)).astype(float)


def test_medoids_of_many_points(spark):
    """More points than a matrix on the driver may have: the medoids that the matrix gives, ties to the least index."""
    x = np.random.default_rng(5).normal(size=(5_100, 2))
    x[-1] = x[0]
    points = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, vals array<double>")
    assert allpoints.pam(spark, points, 3) == [i * 2 for i in cluster.pam(cluster.matrix(x), 3)[0]]
    few = grid(300)
    d = cluster.matrix(few)
    for k, (own, cost) in allpoints.medoids_of(spark, few, [1, 4, 7]).items():
        assert own == cluster.pam(d, k)[0] and math.isclose(cost, d[:, own].min(1).sum())
    assert allpoints.pam(spark, points.where("id = 1"), 3) == []


def test_number_of_medoids_of_many_points(spark, monkeypatch):
    """The query itself on more points than a matrix may have, and the number that the matrix gives."""
    from loadlens import plans
    from loadlens.plans import transforms

    x = np.concatenate([np.random.default_rng(6).normal(c, 0.2, (1_700, 2)) for c in (0, 3, 7)])
    points = spark.createDataFrame([(i + 5, v.tolist()) for i, v in enumerate(x)], "id long, vals array<double>")
    own, score = cluster.xpam(cluster.matrix(x), 4, 2)
    found, best = allpoints.xpam(spark, points, 4)
    assert found == [i + 5 for i in own] and math.isclose(best, score)
    monkeypatch.setattr(transforms, "signatures", lambda spark, d: points)
    rows = plans.QUERIES["k06_xpam_bic"](spark, "").collect()
    assert len(rows) >= 3 and len({r.bic for r in rows}) == 1 and {r.medoid for r in rows} <= set(range(5, 5_105))


def one_by_one(x: np.ndarray) -> list[tuple]:
    names, out = list(range(len(x))), []
    for _, i, j, height, _ in cluster.complete_linkage(names, cluster.matrix(x)):
        i, j = sorted((names[i], names[j]))
        names.append(i)
        out.append((round(height, 9), i, j))
    return out


def test_linkage_of_many_points(spark, monkeypatch):
    """Merges by rounds are those of one at a time, ties and copies among them, by jobs and on the driver; then ten far groups."""
    monkeypatch.setattr(allpoints, "COLUMNS", 50)
    for x in (grid(250), np.random.default_rng(8).normal(size=(150, 4)), np.zeros((90, 2)), 2.0 ** np.arange(40)[:, None]):
        assert [(round(h, 9), i, j) for h, i, j in allpoints.merges_of(spark, x, tail=1)] == one_by_one(x)
    monkeypatch.setattr(allpoints, "SMALL", 0)
    x = grid(80)
    assert [(round(h, 9), i, j) for h, i, j in allpoints.merges_of(spark, x, tail=50)] == one_by_one(x)
    monkeypatch.undo()
    x = np.random.default_rng(9).normal(size=(5_100, 2)) + 100 * (np.arange(5_100) % 10)[:, None]
    points = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, vals array<double>")
    assert allpoints.linked(spark, points, 10) == [(i * 2, i % 10) for i in range(5_100)]
    assert allpoints.linked(spark, points.where("id = 1"), 10) == []


def test_parsed_keys_are_made_once(spark, sf_dir):
    """The optimizer must not parse a second time to see whether there are keys, nor leave all rows to the tasks of a file."""
    from loadlens import plans
    from loadlens.functions import paths

    for name, times in (("f19_parse_keys", 4), ("f18_parse_paths", 2)):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == times and "RepartitionByExpression" in plan
    odd = spark.createDataFrame([(1, "a(0x1) : b(0x2)=>c(0x3),,x"), (2, ""), (3, None), (4, " , ")], "i long, t string")
    rows = paths.each(odd.select("i", paths.parse_keys("t").alias("k")), "k", "place", "x").orderBy("i", "place").collect()
    path = lambda x: [tuple(f) for f in x]
    assert [(r.i, r.place, r.x.metric, r.x.type) for r in rows] == [(1, 0, "time", 0), (1, 1, "time", 0)]
    assert (path(rows[0].x.start), path(rows[0].x.end)) == ([("b", 2), ("a", 1)], [("c", 3)])
    assert path(rows[1].x.start) == path(rows[1].x.end) and [f.module for f in rows[1].x.start] == [""]


def test_region_db(spark, tmp_path):
    """Sparse cells, regions of two columns, a store and back, clusters."""
    rows = [("time", "a", 0, r, s, float(r + s)) for r in range(4) for s in range(4)] + [("time", "a", 1, 0, 0, 1.0), ("time", "b", 0, 0, 0, 1.5), ("work", "b", 0, 3, 3, 2.0)]
    cells = spark.createDataFrame(rows, "metric string, start string, type int, rank long, step long, v double")
    db = RegionDB(cells, (4, 4), ("start", "type"))
    db.save(str(tmp_path / "log"))
    for found in (db, RegionDB.load(spark, str(tmp_path / "log"), (4, 4), ("start", "type"))):
        assert [r.metric for r in found.metrics().collect()] == ["time", "work"]
        assert {(r.start, r.type): r.metrics for r in found.regions().collect()} == {("a", 0): ["time"], ("a", 1): ["time"], ("b", 0): ["time", "work"]}
        assert [(r.start, r.type, r.total, round(r.percent, 4)) for r in found.totals("time").collect()][:2] == [("a", 0, 48.0, 95.0495), ("b", 0, 1.5, 2.9703)]
        surface = {(r.rank, r.step): r.v for r in found.where("type = 0").surface("time").collect()}
        assert len(surface) == 16 and surface[0, 0] == 1.5 and surface[3, 3] == 6.0
        near = {(tuple(r.a), tuple(r.b)): r.rmse for r in found.distances("time").collect()}
        assert len(near) == 3 and math.isclose(near[("a", 1), ("b", 0)], 0.125)
        assert math.isclose(near[("a", 0), ("a", 1)], math.sqrt((sum((r + s) ** 2 for r in range(4) for s in range(4)) + 1) / 16))
        assert [c for _, c in found.clusters("time", 2)] == [0, 1, 1]
    assert {tuple(r.a) for r in db.distances("time", level=1).collect()} == {("a", 0), ("a", 1)}
    assert db.where("false").regions().isEmpty() and db.where("false").clusters("time", 2) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(0, n - 1), max_size=300))), st.sampled_from([0, 1, 32, 5000]))
def test_arithmetic_models(case, step):
    """Bits and other alphabets, static and adaptive, counts of 0 among them."""
    n, symbols = case
    counts = [symbols.count(s) if step == 0 else 1 for s in range(n)]
    if not any(counts):
        counts[0] = 1
    coded = codec.encode_symbols(symbols, codec.Model(counts, step))
    assert list(itertools.islice(codec.decode_symbols(coded, codec.Model(counts, step)), len(symbols))) == symbols
    if step == 0 and symbols:
        entropy = sum(-c * math.log2(c / len(symbols)) for c in counts if c)
        assert len(coded) * 8 <= entropy + 0.01 * len(symbols) + 16


def test_models_refuse_what_they_cannot_code():
    for counts in ([], [0, 0], [1, -1], [1 << 30]):
        with pytest.raises(ValueError):
            codec.Model(counts)
    with pytest.raises(ValueError):
        codec.encode_symbols([1], codec.Model([1, 0]))
