"""Array files and scene folders: round trips, aliases, broken files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.sources import arrays as A
from vantage.sources.tables import resolve


def test_round_trip_of_every_kind(spark, tmp_path):
    where = str(tmp_path / "out")
    df = spark.createDataFrame(
        [(i, i / 4 if i % 5 else float("nan"), i % 2 == 0, f"näme {i}", [float(i), i + 0.5], [[i, 1], [2, 3], [4, i]]) for i in range(1000)],
        "n long, x double, b boolean, s string, v array<float>, m array<array<long>>",
    ).repartition(3)
    A.write_arrays(df, where, {"model": "m1", "dim": 2}, rows_per_file=150)
    back = A.read_arrays(spark, where)
    assert dict(back.dtypes) == dict(df.dtypes) | {"file": "string"}
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".npz"]
    assert len(files) == back.rdd.getNumPartitions() >= 7
    assert max(r["count"] for r in back.groupBy("file").count().collect()) == 150
    key = lambda r: r["n"]
    plain = lambda r: [None if x != x else x for x in r]
    assert [plain(r) for r in sorted(back.drop("file").select(*df.columns).collect(), key=key)] == [plain(r) for r in sorted(df.collect(), key=key)]
    assert A.read_array_metadata(where) == {"model": "m1", "dim": 2}
    A.write_arrays(df.filter("n < 10"), where, mode="overwrite")
    assert A.read_arrays(spark, where).count() == 10 and A.read_array_metadata(where) == {}


def test_features_as_arrays(spark, tmp_path):
    where = str(tmp_path / "feats")
    feats = spark.createDataFrame([(f"img_{i}.jpg", [float(i), -1.0]) for i in range(20)], "image_name string, feat array<double>")
    A.write_feature_arrays(feats, where, {"backbone": "vit"})
    assert sorted(map(tuple, A.read_feature_arrays(spark, where).select("image_name", "feat").collect())) == sorted(map(tuple, feats.collect()))
    with np.load(next((tmp_path / "feats").glob("*.npz"))) as data:
        assert data["features"].shape[1] == 2 and str(data["backbone"]) == "vit"


def test_files_of_others(spark, tmp_path, monkeypatch):
    """Either spelling of a field, arrays of other lengths, column order, small integers, in bounded batches."""
    np.savez(tmp_path / "a.npz", row=np.arange(5, dtype=np.int16), cols=np.arange(5)[::-1], vals=np.linspace(0, 1, 5, dtype=np.float16), other=np.arange(3), name=np.array("x"))
    np.savez_compressed(tmp_path / "b.npz", rows=np.array([7]), col=np.array([8]), weight=np.array([0.5]))
    monkeypatch.setattr(A, "_BATCH_BYTES", 40)
    e = A.read_arrays(spark, str(tmp_path), A.EDGE_FIELDS)
    assert sorted((r.u, r.v, round(r.w, 3)) for r in e.collect()) == [(0, 4, 0.0), (1, 3, 0.25), (2, 2, 0.5), (3, 1, 0.75), (4, 0, 1.0), (7, 8, 0.5)]
    turned = np.asfortranarray(np.arange(12.0).reshape(4, 3))
    np.savez(tmp_path / "c.npz", m=turned, z=np.zeros((4, 0)))
    found = A.read_arrays(spark, str(tmp_path / "c.npz")).collect()
    assert [r["m"] for r in found] == turned.tolist() and [r["z"] for r in found] == [[]] * 4


def test_what_is_missing_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        A.read_arrays(spark, str(tmp_path / "nowhere"))
    with pytest.raises(Exception, match="no array files"):
        A.read_arrays(spark, str(tmp_path))
    np.savez(tmp_path / "a.npz", row=np.arange(5), col=np.arange(5))
    with pytest.raises(Exception, match="none of the fields weight, val, vals"):
        A.read_arrays(spark, str(tmp_path), A.EDGE_FIELDS)
    np.savez(tmp_path / "b.npz", row=np.arange(5))
    with pytest.raises(Exception, match="no array for col"):
        A.read_arrays(spark, str(tmp_path)).collect()
    np.savez(tmp_path / "o.npz", row=np.array([{}, {}], object))
    with pytest.raises(Exception, match="object"):
        A.read_arrays(spark, str(tmp_path / "o.npz")).collect()


def test_failed_writes_leave_nothing(spark, tmp_path):
    where = str(tmp_path / "bad")
    for rows, text in (([([1.0],), ([1.0, 2.0],)], "different lengths"), ([(None,), ([1.0],)], "null rows")):
        with pytest.raises(Exception, match=text):
            A.write_arrays(spark.createDataFrame(rows, "v array<double>").coalesce(1), where)
    assert not list((tmp_path / "bad").glob("part*"))


def scene(root, name, index=None, arrays=None, images=(), raw=None):
    folder = root / name
    (folder / "images").mkdir(parents=True)
    for i in images:
        (folder / "images" / i).write_bytes(b"x")
    if index is not None:
        (folder / "image_index.json").write_text(index)
    if arrays is not None:
        np.savez(folder / "gt.npz", **arrays)
    if raw is not None:
        (folder / "gt.npz").write_bytes(raw)


def test_scan_of_good_and_bad_scenes(spark, tmp_path):
    edges = {"rows": np.array([0, 1]), "cols": np.array([1, 2]), "vals": np.array([0.5, 2.0])}
    scene(tmp_path, "s1 listed", json.dumps(["b.jpg", "a.jpg", "c.jpg"]), edges, ["a.jpg"])
    scene(tmp_path, "s2", json.dumps({"name_to_id": {"x": 1, "y": 0}}), {"row": edges["rows"], "col": edges["cols"], "weight": edges["vals"]})
    scene(tmp_path, "s3", json.dumps({"id_to_name": ["p", "q"]}), edges)
    scene(tmp_path, "s4", None, edges | {"images": np.array(["m", "n"])}, ["z.png"])
    scene(tmp_path, "s5+%20", None, edges, ["b.PNG", "a.jpg", "notes.txt"])
    scene(tmp_path, "s6", "[]", edges)
    scene(tmp_path, "s7", None, None, ["a.jpg"])
    scene(tmp_path, "s8", None, None, [], b"this is no archive")
    scene(tmp_path, "s9", "{broken", edges)
    scene(tmp_path, "t1", "[1]", {"row": edges["rows"], "vals": edges["vals"]})
    scene(tmp_path, "t2", None, edges)
    scene(tmp_path, "t3", None, {"row": np.array([{}], object), "col": np.array([0]), "val": np.array([0.0])}, ["a.jpg"])
    scene(tmp_path, "t4", "[1]", edges | {"vals": np.array([0.5])})
    (tmp_path / "nothing").mkdir()
    (tmp_path / "a file").write_text("x")
    status, nodes, found = A.scene_tables(A.scan_scenes(spark, str(tmp_path)).cache())
    by_scene = {r.scene: (r.n, r.status) for r in status.collect()}
    assert {s: v for s, v in by_scene.items() if v[1] == "ok"} == {"s1 listed": (3, "ok"), "s2": (2, "ok"), "s3": (2, "ok"), "s4": (2, "ok"), "s5+%20": (2, "ok")}
    assert by_scene["s6"] == (0, "no images") and by_scene["s7"] == by_scene["nothing"] == (0, "no gt.npz")
    assert by_scene["s8"][1].startswith("unreadable: BadZipFile") or by_scene["s8"][1].startswith("unreadable: ValueError")
    assert by_scene["s9"][1].startswith("unreadable: JSONDecodeError") and by_scene["t3"][1].startswith("unreadable: ValueError")
    assert by_scene["t1"][1] == "none of the fields col, cols" and by_scene["t2"][1] == "no image order" and by_scene["t4"][1] == "fields differ in length"
    assert len(by_scene) == 14
    names = {s: [r["name"] for r in sorted(rows, key=lambda r: r.idx)] for s in by_scene if (rows := nodes.filter(F.col("scene") == s).collect())}
    assert names == {"s1 listed": ["b.jpg", "a.jpg", "c.jpg"], "s2": ["y", "x"], "s3": ["p", "q"], "s4": ["m", "n"], "s5+%20": ["a.jpg", "b.PNG"]}
    assert sorted(map(tuple, found.filter("scene = 's2'").collect())) == [("s2", 0, 1, 0.5), ("s2", 1, 2, 2.0)] and found.count() == 10


def test_scan_of_missing_and_empty_roots(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        A.scan_scenes(spark, str(tmp_path / "nowhere"))
    assert A.scan_scenes(spark, str(tmp_path)).collect() == []


def test_resolving_by_suffix(spark):
    files = spark.createDataFrame([("d/feat_dino.h5",), ("d/dino.txt",), ("d/my_dino_large.h5",), ("d/vlad",), ("d/vlad.h5",), ("d/x.h5",)], "path string")
    assert [resolve(files, n, ".h5").first()["path"] for n in ("dino", "vlad", "x", "none")] == ["d/feat_dino.h5", "d/vlad", "d/x.h5", None]
    assert resolve(files, "dino").first()["path"] == "d/dino.txt"
