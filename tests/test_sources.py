import struct

import pytest
from graphs import dijkstra, frame, random_graph

from pathloom.operators import sssp
from pathloom.sources import gr, mtx, sidecars
from pathloom.streaming import updates


def ordered(edges):
    return sorted(edges, key=lambda e: e[0])


@pytest.mark.parametrize("m", [120, 121])
def test_gr_round_trip(spark, tmp_path, m):
    edges = ordered(random_graph(8, m=m))
    df, path = frame(spark, edges), str(tmp_path / "g.gr")
    gr.write_gr(df, 41, path)
    assert gr.header(path) == {"version": 1, "width": 4, "n": 41, "m": len(edges), "size": 32 + 8 * 41 + 4 * (2 * len(edges) + len(edges) % 2)}
    vertices, back = gr.read_gr(spark, path, rows_per_task=7)
    assert vertices.count() == 41 and gr.same_edges(df, back)
    with open(path, "ab") as f:
        f.write(b"\0" * 8)  # trailing bytes are accepted
    assert gr.same_edges(df, gr.read_gr(spark, path)[1])
    assert not gr.same_edges(df, back.limit(3))
    with pytest.raises(FileExistsError):
        gr.write_gr(df, 41, path)
    with pytest.raises(ValueError):
        gr.write_gr(df, 3, str(tmp_path / "small.gr"))


def test_gr_strictness(spark, tmp_path):
    def write(name, version=1, width=4, ends=(1, 2), dst=(1, 0), weights=(3, 4)):
        path = tmp_path / name
        path.write_bytes(struct.pack("<4Q", version, width, len(ends), len(dst)) + struct.pack(f"<{len(ends)}Q", *ends) + struct.pack(f"<{len(dst)}I", *dst) + struct.pack(f"<{len(weights)}i", *weights))
        return str(path)

    assert gr.read_gr(spark, write("ok"))[1].count() == 2
    for bad in (write("v", version=2), write("w", width=8), write("nw", width=0, weights=()), write("short", weights=())):
        with pytest.raises(ValueError):
            gr.read_gr(spark, bad)
    assert [r["weight"] for r in gr.read_gr(spark, write("nw", width=0, weights=()), strict=False)[1].collect()] == [0, 0]
    assert [r["weight"] for r in gr.read_gr(spark, write("nw", width=0, weights=()), default_weight=7)[1].collect()] == [7, 7]
    for bad in (write("range", dst=(1, 5)), write("neg", weights=(3, -4)), write("rows", ends=(2, 1))):
        with pytest.raises(Exception, match="range|negative|ascend"):
            gr.read_gr(spark, bad)[1].collect()


@pytest.mark.parametrize(
    "banner,lines,want",
    [
        ("real general", ["1 2 2.7", "3 1 1e1"], [(0, 1, 2.7), (2, 0, 10.0)]),
        ("integer symmetric", ["1 1 5", "2 1 3"], [(0, 0, 5), (0, 1, 3), (1, 0, 3)]),
        ("pattern general", ["1 3", "1 2"], [(0, 2, 1), (0, 1, 1)]),
        ("integer skew-symmetric", ["2 1 4"], [(1, 0, 4)]),
    ],
)
def test_mtx(spark, tmp_path, banner, lines, want):
    path = tmp_path / "a.mtx"
    path.write_text("\n".join([f"%%MatrixMarket matrix coordinate {banner}", "% remark", f"3 3 {len(lines)}", *lines, ""]))
    vertices, edges, _ = mtx.read_mtx(spark, str(path))
    assert vertices.count() == 3 and [(r["src"], r["dst"], r["weight"]) for r in edges.orderBy("eid").collect()] == want
    target = str(tmp_path / "a.gr")
    mtx.mtx_to_gr(spark, str(path), target)
    assert [(r["src"], r["dst"], r["weight"]) for r in gr.read_gr(spark, target)[1].orderBy("eid").collect()] == [(s, d, int(w)) for s, d, w in want]


@pytest.mark.parametrize("text", ["", "x", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "%%MatrixMarket matrix array real general\n1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n"])
def test_bad_mtx_raises(spark, tmp_path, text):
    path = tmp_path / "b.mtx"
    path.write_text(text)
    with pytest.raises(ValueError):
        mtx.read_mtx(spark, str(path))


def test_sidecars(spark, tmp_path):
    mapping = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "new_id long, old_id long")
    sidecars.write_permutation(mapping, 3, str(tmp_path / "p"))
    assert sorted(map(tuple, sidecars.read_permutation(spark, str(tmp_path / "p")).collect())) == [(0, 2), (1, 0), (2, 1)]
    assert (tmp_path / "p.invperm.u32").read_bytes() == struct.pack("<3I", 1, 2, 0)
    with pytest.raises(FileExistsError):
        sidecars.write_permutation(mapping, 3, str(tmp_path / "p"))
    found = spark.createDataFrame([(0, 0), (1, None), (2, 7)], "v long, dist long")
    sidecars.write_oracle(found, 3, str(tmp_path / "o.i32"))
    assert sorted(map(tuple, sidecars.read_oracle(spark, str(tmp_path / "o.i32"), 3).collect())) == [(0, 0), (1, None), (2, 7)]
    with pytest.raises(ValueError):
        sidecars.read_oracle(spark, str(tmp_path / "o.i32"), 4)
    sidecars.write_distances_text(found, str(tmp_path / "d"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()) == ["0 0", "1 INF", "2 7"]
    assert sorted(map(tuple, sidecars.read_distances_text(spark, str(tmp_path / "d")).collect())) == [(0, 0), (1, None), (2, 7)]
    lines = spark.createDataFrame([(sidecars.bench_line(algorithm="owner", solve_ms=1.5, correct=1),), ("noise",), ("BENCH solve_ms=0 correct=1",)], "value string")
    rows = sidecars.read_bench_lines(lines)
    assert rows.first()["fields"]["algorithm"] == "owner" and sidecars.check_bench(rows).count() == 1


def test_stream_of_edges(spark, tmp_path):
    edges = random_graph(9)
    df = frame(spark, edges)
    seeds = sssp.sources_frame(df, [0])
    for part in range(2):
        df.where(f"eid % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    followed = updates.Followed(spark, seeds)
    followed.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["v"]: r["dist"] for r in followed.distances().collect()}
    assert len(followed.kept) == 2 and got == {v: d for v, (d, _) in dijkstra(edges, [(0, 0)]).items()}
    # A heavier repeat changes no state, a lighter one does.
    for w in (1000, 0):
        spark.createDataFrame([(0, edges[0][0], edges[0][1], w)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        followed.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["v"]: r["dist"] for r in followed.distances().collect()}
    assert got == {v: d for v, (d, _) in dijkstra([*edges, (*edges[0][:2], 0)], [(0, 0)]).items()}


def test_gr_data_source(spark, tmp_path):
    edges = random_graph(3)
    path = str(tmp_path / "g.gr")
    gr.write_gr(frame(spark, sorted(edges)), 40, path)
    gr.register(spark)
    read = spark.read.format("gr").option("path", path).option("rowsPerTask", "7")
    want = sorted(edges)
    assert [(r["src"], r["dst"], r["weight"]) for r in read.load().orderBy("eid").collect()] == want
    for condition, holds in (("src = 5", lambda s: s == 5), ("src > 3 AND src <= 21", lambda s: 3 < s <= 21), ("src IN (2, 30, 31)", lambda s: s in (2, 30, 31)), ("src < 0", lambda s: False), ("src >= 8 AND dst > 4", lambda s: s >= 8)):
        got = read.load().where(condition)
        assert sorted(r["src"] for r in got.collect()) == sorted(s for s, d, _ in want if holds(s) and ("dst" not in condition or d > 4))
    options = {"path": path, "rowsPerTask": "7"}
    reader = gr.GrReader(options, ("src", "weight"))
    assert not list(reader.pushFilters([gr.In(("src",), (30, 2)), gr.GreaterThan(("src",), 4)])) and [(p.lo, p.hi) for p in reader.partitions()] == [(30, 31)]
    assert sorted(tuple(r) for r in read.schema("weight long, src long").load().collect()) == sorted((w, s) for s, _, w in want)
    with pytest.raises(Exception, match="no column"):
        read.schema("colour string").load().collect()
