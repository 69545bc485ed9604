import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessella.functions.types import Descriptor, EncodeOptions, Limits, RasterError, Region, to_array
from tessella.functions.weights import FILTERS, ONE, Kernel, fit, weights
from tessella.operators import kernels, tiles
from tessella.plans import Raster
from tessella.sources.sniff import scan


@pytest.mark.parametrize("name", FILTERS)
@settings(max_examples=25, deadline=None)
@given(size=st.integers(1, 60), out=st.integers(1, 60))
def test_weights_sum_to_one_and_stay_inside(name, size, out):
    w = weights(name, size, out)
    assert (w.fixed.sum(axis=1) == ONE).all()
    assert (w.start >= 0).all() and (w.start + w.length <= size).all()


@pytest.mark.parametrize("name", FILTERS)
def test_flat_images_stay_flat(name):
    assert (kernels.resize(np.full((1, 7, 5, 3), 200, np.uint8), 3, 11, name) == 200).all()


@given(st.integers(-8, 8), st.integers(1, 6), st.integers(1, 6))
def test_four_turns(q, w, h):
    a = np.arange(w * h).reshape(1, h, w, 1).astype(np.uint8)
    assert (kernels.rotate(kernels.rotate(a, 90 * q), -90 * q) == a).all()
    assert (kernels.rotate(a, 180) == kernels.flip(kernels.flop(a))).all()


def test_errors_have_codes():
    for make, code in (
        (lambda: Kernel.box(2), "invalid_argument"), (lambda: Kernel.box(65), "invalid_argument"), (lambda: Kernel.gaussian(0), "invalid_argument"), (lambda: kernels.rotate(np.zeros((1, 1, 1, 1)), 45), "invalid_argument"),
        (lambda: kernels.Modulate(float("nan")), "invalid_argument"), (lambda: EncodeOptions(0), "invalid_argument"), (lambda: EncodeOptions(101), "invalid_argument"), (lambda: Descriptor(0, 1, "gray8"), "invalid_argument"),
        (lambda: Descriptor(1, 1, "gray64"), "unsupported"), (lambda: Limits(10).check(4, 4), "limit_exceeded"), (lambda: to_array(b"123", Descriptor(2, 2, "gray8")), "invalid_argument"),
        (lambda: kernels.extract_channel(np.zeros((1, 1, 1, 3), np.float32), 0), "unsupported"), (lambda: kernels.crop(np.zeros((1, 4, 4, 1), np.uint8), 1, 1, 4, 1), "invalid_argument"),
    ):
        with pytest.raises(RasterError) as e:
            make()
        assert e.value.code == code


def test_regions_and_fit():
    a = Region(2, 3, 4, 5)
    assert a.intersect(Region(5, 7, 9, 9)) == Region(5, 7, 1, 1) and a.intersect(Region(6, 3, 1, 1)) is None
    assert a.union(Region(0, 0, 1, 1)) == Region(0, 0, 6, 8) and a.translate(-9, 1) == Region(0, 4, 4, 5) and str(a) == "4x5+2+3"
    assert fit(100, 50, 40, 40, "inside") == (40, 20) and fit(10, 10, 40, 40, "inside", False) == (10, 10)


def test_first_error_of_a_chain_wins(spark):
    rows = spark.createDataFrame([(1, 2, 2, "gray8", bytearray([1, 2, 3, 4]))], tiles.IMAGE)
    chain = Raster(rows).rotate(45).resize(0, 1)
    assert "45" in chain.error.detail
    with pytest.raises(RasterError):
        chain.images()
    assert [tuple(r) for r in Raster(rows).rotate(90).samples().orderBy("y", "x").select("v").collect()] == [(3,), (1,), (4,), (2,)]


def test_files_are_known_by_content(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(bytes.fromhex("89504e470d0a1a0a00"))
    (tmp_path / "b.png").write_bytes(b"GIF89a..")
    (tmp_path / "c").write_bytes(b"\0\0")
    assert sorted(str(r["format"]) for r in scan(spark, str(tmp_path)).select("format").collect()) == ["None", "gif", "png"]
