"""Curves from arrays, FITS by suffix, and a session outside the repository."""

import os
import subprocess
import sys
import zipfile

import numpy as np
import pytest

import lumenfold
from lumenfold.sources import observations


def test_curves_from_arrays(spark):
    t = np.arange(4.0)
    curves = [("a", t, t * 2, np.full(4, 0.1)), ("a", t, t), (7, t, np.ma.masked_equal(t, 2.0), None if False else np.full(4, np.nan), "g"), ("d", np.array(["2024-01-01", "2024-01-02T12:00"], dtype="datetime64[s]"), [1.0, 2.0])]
    rows = observations.from_curves(spark, curves).collect()
    keys = {}
    for r in rows:
        keys.setdefault(r.object_id, []).append(r)
    assert {k: len(v) for k, v in keys.items()} == {"a": 4, "a#2": 4, "7": 4, "d": 2}
    assert keys["a"][1].dy == 0.1 and keys["a#2"][1].dy is None and keys["7"][2].y is None and keys["7"][0].band == "g"
    assert [r.t for r in keys["d"]] == [60310.0, 60311.5] and len({r.rid for r in rows}) == len(rows)
    assert observations.from_curves(spark, []).count() == 0
    with pytest.raises(ValueError, match="differ in length"):
        observations.from_curves(spark, [("x", [1.0], [1.0, 2.0])])


def test_fits_by_suffix(spark, tmp_path):
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    pad = lambda b, fill: b + fill * (-len(b) % 2880)
    head = pad("".join([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), "END".ljust(80)]).encode(), b" ")
    data = np.array([(1.0, 2.0), (3.0, 4.0)], dtype=">f8").tobytes()
    table = pad("".join([card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 16), card("NAXIS2", 2), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 2), card("TTYPE1", "'TIME'"), card("TFORM1", "'D'"), card("TTYPE2", "'FLUX'"), card("TFORM2", "'D'"), "END".ljust(80)]).encode(), b" ")
    (tmp_path / "star.fits").write_bytes(head + table + pad(data, b"\0"))
    rows = observations.read_inputs(spark, f"file://{tmp_path}/star.fits").orderBy("t").collect()
    assert [(r.object_id, r.t, r.y) for r in rows] == [("star", 1.0, 2.0), ("star", 3.0, 4.0)]


def test_shipped_archive(spark):
    names = zipfile.ZipFile(lumenfold.ship(spark)).namelist()
    assert "lumenfold/operators/kernels.py" in names and "lumenfold/__init__.py" in names


def test_package_imports_alone(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(lumenfold.__file__)))
    done = subprocess.run([sys.executable, "-c", "import lumenfold.operators.methods as m; print(len(m.names()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "8", done.stderr[-500:]
