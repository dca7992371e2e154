"""Readers and writers on small files of each kind."""

import struct
import zlib

import numpy as np
import pytest

from cohortgraph.sources import readers


def matlab_file(name: str, m: np.ndarray, packed: bool) -> bytes:
    """A MATLAB level 5 file with one double matrix."""
    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *m.shape)) + element(1, name.encode()) + element(9, m.astype("<f8").tobytes(order="F"))
    matrix = element(14, body)
    held = zlib.compress(matrix)
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + (struct.pack("<II", 15, len(held)) + held if packed else matrix)


@pytest.mark.parametrize("packed", [False, True])
def test_matlab_edges(spark, tmp_path, packed):
    m = np.array([[0, 2, 0], [2, 1, 5], [0, 5, 0]])
    (tmp_path / "lgp_01_fiber_number.mat").write_bytes(matlab_file("Measure", m, packed))
    (tmp_path / "dep_02_fiber_number.mat").write_bytes(matlab_file("Measure", m.T * 3, packed))
    (tmp_path / "notes.txt").write_text("not a matrix")
    got = sorted(tuple(r) for r in readers.matlab_edges(spark, str(tmp_path)).collect())
    assert got == [(s, i, j, float(w * f)) for s, f in (("dep_02", 3), ("lgp_01", 1)) for i, j, w in ((1, 2, 2), (2, 2, 1), (2, 3, 5))]
    with pytest.raises(KeyError):
        readers.matlab_matrix(matlab_file("Other", m, packed), "Measure")
    with pytest.raises(ValueError):
        readers.matlab_matrix(b"short", "Measure")


def test_text_volumes(spark, tmp_path):
    (tmp_path / "volume_ROI_a1.txt").write_text("10 100 x\r\n\r\n  20.5\t200\n")
    (tmp_path / "volume_ROI_b2.txt").write_text("")
    (tmp_path / "volume_ROI_c3.txt").write_text("7 70\n\n\n8 80\n? 90\n\n")
    got = sorted(tuple(r) for r in readers.text_volumes(spark, str(tmp_path)).collect())
    assert got == [("a1", 1, 10.0, 100.0), ("a1", 2, 20.5, 200.0), ("c3", 1, 7.0, 70.0), ("c3", 2, 8.0, 80.0), ("c3", 3, None, 90.0)]


def test_tables_of_subjects(spark, tmp_path):
    (tmp_path / "table.csv").write_text("Subject,Age,Gender,Duree_maladie\nlgp_1,44,1,3\ndep_2,,2,\n")
    (tmp_path / "rep.csv").write_text("ID,Rep_M6_MADRS,duree_ma_M0\nx,1,2.5\ny,0,NaN\n")
    (tmp_path / "med.csv").write_text("ID,Medication load,A antidepresseur,B Mood stabilizeur,C antipsycho,D Bzd\nx,3,1,0,1,0\ny,,0,0,0,1\n")
    assert sorted(tuple(r) for r in readers.metadata(spark, str(tmp_path / "table.csv")).collect()) == [("dep_2", None, 2), ("lgp_1", 44, 1)]
    found = {r.id: (r.responder, r.duration) for r in readers.response(spark, str(tmp_path / "rep.csv")).collect()}
    assert found["x"] == (1, 2.5) and found["y"][0] == 0 and found["y"][1] != found["y"][1]
    assert sorted(tuple(r) for r in readers.medication(spark, str(tmp_path / "med.csv")).collect()) == [("x", 3.0, 1, 0, 1, 0), ("y", None, 0, 0, 0, 1)]


def test_atlas_may_end_in_a_newline(spark, tmp_path):
    (tmp_path / "atlas.txt").write_text("-38.65\t-5.68\t50.94\n41.37\t-8.21\t52.09\r\n\n")
    assert [tuple(r) for r in readers.atlas(spark, str(tmp_path / "atlas.txt")).orderBy("node").collect()] == [(1, -38.65, -5.68, 50.94), (2, 41.37, -8.21, 52.09)]


@pytest.mark.parametrize("by", [None, "cohort"])
def test_bundles_are_read_back(spark, tmp_path, by):
    rows = [(1, "patient", 2.0), (2, "control", 3.0)]
    readers.write_table(spark.createDataFrame(rows, "subject long, cohort string, w double"), str(tmp_path), "edges", by)
    readers.write_table(spark.createDataFrame(rows, "subject long, cohort string, w double"), str(tmp_path), "edges", by)  # written over
    assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path), "edges").select("subject", "cohort", "w").collect()) == rows


def test_feature_table(spark):
    values = spark.createDataFrame([(s, i, j, float(10 * s + i + j)) for s in (1, 2) for i, j in ((1, 2), (1, 3), (2, 3))], "subject long, i int, j int, value double")
    hits = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "i int, j int")
    got = {r.subject: (r["1_2"], r["2_3"]) for r in readers.feature_table(values, hits, ["i", "j"]).collect()}
    assert got == {1: (13.0, 15.0), 2: (23.0, 25.0)}
