import struct

import numpy as np
import pytest

from sparkvane.functions.config import RuntimeConfig, cached_nodes, number_list, tile_policy
from sparkvane.sources import binary, files


def test_vector_files_round_trip(spark, tmp_path):
    files.register(spark)
    (tmp_path / "a.bvecs").write_bytes(binary.bvecs_bytes([(1, 2, 3), (4, 5, 6), (7, 8, 9)]))
    assert binary.bvecs_metadata(str(tmp_path / "a.bvecs")) == (3, 7, 3)
    d = spark.read.format("bvecs").option("path", str(tmp_path / "a.bvecs")).option("start", 1).option("count", 2).load()
    assert sorted((r["row"], list(r["vec"])) for r in d.collect()) == [(1, [4, 5, 6]), (2, [7, 8, 9])]
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "a.fbin").write_bytes(binary.fbin_bytes(m))
    assert spark.read.format("fbin").option("path", str(tmp_path / "a.fbin")).load().count() == 4
    (tmp_path / "a.raw").write_bytes(m.tobytes())
    assert spark.read.format("rawfloat").option("path", str(tmp_path / "a.raw")).option("dim", 3).load().count() == 4
    for dists in (None, np.zeros((2, 2))):
        (tmp_path / "gt").write_bytes(binary.truth_bytes(np.array([[1, 2], [3, 4]]), dists))
        d = spark.read.format("ann_truth").option("path", str(tmp_path / "gt")).load()
        assert sorted(list(r["vec"]) for r in d.collect()) == [[1, 2], [3, 4]]
    (tmp_path / "bad").write_bytes(b"\x03\0\0\0ab")
    with pytest.raises(ValueError):
        binary.bvecs_metadata(str(tmp_path / "bad"))


FORMATS = {"fbin": ("vec array<float>", {}), "rawfloat": ("vec array<float>", {"dim": 3}), "bvecs": ("vec array<float>", {}), "vector_store": ("vec array<float>", {}), "pq_codes": ("code array<int>", {}),
           "topology": ("neighbors array<long>", {}), "selectors": ("use_outlier array<boolean>", {"chunks": 3}), "page_trace": ("page long", {}), "stop_trace": ("stop_prefix long", {}),
           "ann_truth": ("vec array<int>, dists array<float>", {}), "disk_graph": ("vec array<float>, neighbors array<long>", {}), "combined_nodes": ("vec array<float>, neighbors array<long>", {"dim": 3})}


@pytest.mark.parametrize("form", FORMATS)
def test_file_sets_are_written_and_read_in_tasks(spark, tmp_path, form):
    files.register(spark)
    columns, options = FORMATS[form]
    value = {"vec array<float>": lambda i: [float(i % 200), 1.0, 2.0], "code array<int>": lambda i: [i % 256, 0, 255], "neighbors array<long>": lambda i: list(range(i % 5)), "use_outlier array<boolean>": lambda i: [i % 2 == 0, False, True],
             "page long": lambda i: 2**40 + i, "stop_prefix long": lambda i: i, "vec array<int>": lambda i: [i, i + 1], "dists array<float>": lambda i: [0.5, i / 2]}
    rows = [(3 * i, *[value[c](i) for c in columns.split(", ")]) for i in range(50)]
    d = spark.createDataFrame(rows, f"vec_id long, {columns}").repartition(4)
    path = str(tmp_path / "set")
    files.write(d, form, path, partitions=3, file_rows=7, **options)
    r = spark.read.format(form).option("path", path)
    for k, v in options.items():
        r = r.option(k, v)
    got = sorted(tuple(x) for x in r.load().collect())
    assert got == [(i, *x[1:]) for i, x in enumerate(rows)]
    assert sorted(x[0] for x in r.option("start", 13).option("count", 20).load().collect()) == list(range(13, 33))
    with pytest.raises(Exception, match="rows 40"):
        r.option("start", 40).option("count", 20).load().collect()
    files.write(d.where("vec_id < 6"), form, path, mode="append", partitions=1, **options)
    again = spark.read.format(form).option("path", path)
    for k, v in options.items():
        again = again.option(k, v)
    assert again.load().count() == 52


def test_codebook_file_set(spark, tmp_path):
    files.register(spark)
    rows = [(c * 256 + k, c, k, [float(c), k / 2]) for c in range(3) for k in range(256)]
    files.write(spark.createDataFrame(rows, "vec_id long, chunk long, center long, pivot array<float>"), "pq_pivots", str(tmp_path / "b"), partitions=1)
    assert sorted(tuple(x) for x in spark.read.format("pq_pivots").option("path", str(tmp_path / "b")).load().collect()) == rows


def test_page_ids_are_whole_numbers_of_64_bits(spark, tmp_path):
    files.register(spark)
    ids = [2147483653, 2**40 + 7, 5]
    (tmp_path / "t").write_bytes(struct.pack("<3Q", *ids))
    assert [r["page"] for r in spark.read.format("page_trace").option("path", str(tmp_path / "t")).load().orderBy("row").collect()] == ids


def test_codebook_and_selectors():
    p = np.random.default_rng(0).normal(size=(256, 4)).astype(np.float32)
    got = binary.pq_pivots(binary.pq_pivots_bytes(p, np.zeros(4), np.array([0, 2, 4])))
    assert (got["pivots"] == p).all() and got["chunk_offsets"].tolist() == [0, 2, 4]
    sel = np.random.default_rng(1).random((5, 11)) < 0.5
    assert (binary.read_selector_bits(binary.selector_bits(sel), 5, 11) == sel).all()
    with pytest.raises(ValueError):
        binary.pq_pivots(binary.pq_pivots_bytes(p[:9], np.zeros(4), np.array([0, 4])))


def test_adjacency_and_disk_layout():
    assert binary.padded([1, 2])[:3] == [1, 2, binary.NO_NEIGHBOR] and len(binary.padded([])) == 64
    with pytest.raises(ValueError):
        binary.padded(list(range(65)))
    assert binary.unpadded([1, 9, binary.NO_NEIGHBOR], 5) == ([1], 1)
    d = binary.DiskIndex.parse(struct.pack("<II", 9, 1) + struct.pack("<9Q", 3, 2, 1, 28, 2, 0, 0, 0, 0))
    assert [d.node_offset(i) for i in range(3)] == [4096, 4124, 8192] and d.capacity(8) == 4


def test_settings():
    assert RuntimeConfig.parse("# x\nqueue_depth = 4 # y\n").queue_depth == 4
    with pytest.raises(ValueError):
        RuntimeConfig.parse("nonsense=1")
    assert number_list("8, 4,8") == [4, 8] and tile_policy("64:8,128:16") == {64: 8, 128: 16}
    assert cached_nodes(100, ratio=0.5) == 50 and cached_nodes(100, gib=1, node_bytes=1 << 29) == 2


def test_page_packed_files():
    from sparkvane.sources import pages

    lay = pages.StoreLayout(0, 128, 17)
    assert (lay.per_page, lay.pages, lay.address(8)) == (8, 3, (1, 0, 8192))
    assert pages.StoreLayout(1, 100, 1).per_page == 40
    with pytest.raises(ValueError):
        _ = pages.StoreLayout(0, 2048, 1).per_page
    m = ((17 * np.arange(5)[:, None] + np.arange(1200)) % 251).astype(np.uint8)
    data = pages.store_bytes(m)
    assert len(data) == 3 * 4096 and data[4096 + 3600 : 8192] == b"\0" * 496
    assert all((pages.store_vector(data, i) == m[i]).all() for i in range(5))
    with pytest.raises(ValueError):
        pages.store_vector(data[:-1], 0)
    adj = [[1, 2, 3], [0, 2], [1]]
    assert pages.topology_rows(pages.topology_bytes(adj)) == adj and [pages.node_offset(i) for i in (0, 2)] == [4096, 4608]
    assert list(pages.trace_batches(pages.trace_bytes([[1, 2], [], [7]]))) == [[1, 2], [], [7]]
    with pytest.raises(ValueError):
        list(pages.trace_batches(b"\0" * 8))
