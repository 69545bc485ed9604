"""File formats: round trips, damaged files, and the decoders of another maker."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessella import codecs
from tessella.codecs import bits, gif, jpeg, png, raw, tiff
from tessella.functions.types import Descriptor, EncodeOptions, Limits, RasterError, Region
from tessella.functions.weights import Kernel
from tessella.operators import kernels, relational, tiles
from tessella.plans import Raster


def noise(h: int, w: int, n: int, dtype=np.uint8, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(dtype).max + 1, (h, w, n)).astype(dtype)


def smooth(h: int, w: int) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 2, y * 3, x + y], axis=2).clip(0, 255).astype(np.uint8)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.booleans())
def test_dictionary_and_run_length_streams(data, high_first):
    assert bits.lzw_decode(bits.lzw_encode(data, 8, high_first), 8, len(data), high_first) == data
    assert bits.packbits_decode(bits.packbits_encode(data), len(data)) == data


def test_long_dictionary_streams_start_over():
    data = noise(1, 60_000, 1).tobytes()
    for high_first in (False, True):
        assert bits.lzw_decode(bits.lzw_encode(data, 8, high_first), 8, len(data), high_first) == data


@pytest.mark.parametrize("dtype,n", [(np.uint8, 1), (np.uint8, 2), (np.uint8, 3), (np.uint8, 4), (np.uint16, 1), (np.uint16, 3), (np.uint16, 4)])
def test_png_and_tiff_keep_every_sample(dtype, n):
    for h, w in ((1, 1), (7, 5), (33, 70)):
        a = noise(h, w, n, dtype)
        assert (codecs.decode(png.encode(a)) == a).all()
        for f in range(5):
            assert (codecs.decode(png.encode(a, filters=[f] * h)) == a).all()
        for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            for p, order, tile in ((1, "<", None), (2, ">", None), (2, "<", 16), (1, ">", 16)):
                b = codecs.decode(tiff.encode(a, tile=tile, compression=c, predictor=p, order=order))
                assert b.dtype == a.dtype and (b == a).all()


def png_of(width, height, depth, kind, rows: list[bytes], interlace=0, extra=()) -> bytes:
    import struct

    head = png.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlace))
    return png.SIGNATURE + head + b"".join(png.chunk(*e) for e in extra) + png.chunk(b"IDAT", bits.deflate(b"".join(b"\0" + r for r in rows), 6)) + png.chunk(b"IEND", b"")


def test_png_depths_palettes_keys_and_passes():
    assert codecs.decode(png_of(4, 1, 2, 0, [b"\x1b"]))[0, :, 0].tolist() == [0, 85, 170, 255]
    got = codecs.decode(png_of(3, 1, 8, 3, [b"\0\1\2"], extra=[(b"PLTE", bytes(range(9))), (b"tRNS", b"\x07\x09")]))
    assert got[0].tolist() == [[0, 1, 2, 7], [3, 4, 5, 9], [6, 7, 8, 255]]
    assert codecs.decode(png_of(2, 1, 8, 0, [b"\x05\x06"], extra=[(b"tRNS", b"\0\x05")]))[0].tolist() == [[5, 0], [6, 255]]
    a = noise(9, 11, 1)
    rows = []
    for x, y, dx, dy in png.ADAM7:
        part = a[y::dy, x::dx, 0]
        rows += [r.tobytes() for r in part] if part.size else []
    assert (codecs.decode(png_of(11, 9, 8, 0, rows, interlace=1)) == a).all()


def test_damaged_files_have_codes():
    good = png.encode(noise(4, 4, 3))
    cases = [
        (good[:-20], "malformed"), (good[:40] + b"\xff" + good[41:], "malformed"), (b"", "unsupported"), (b"RIFF\0\0\0\0WEBPVP8 ", "unsupported"), (b"\0\0\0\x18ftypavif\0\0\0\0mif1avif", "unsupported"),
        (b"\0\1\2\3", "unsupported"), (png_of(1, 1, 8, 3, [b"\5"], extra=[(b"PLTE", b"\0\0\0")]), "malformed"), (png_of(1, 1, 3, 0, [b"\0"]), "malformed"), (gif.encode(noise(3, 3, 1))[:20], "malformed"),
        (tiff.encode(noise(3, 3, 1))[:30], "malformed"), (jpeg.encode(smooth(16, 16))[:-30], "malformed"), (b"\xff\xd8\xff\xc2\0\x0b\x08\0\1\0\1\1\1\x11\0", "malformed"), (b"\xff\xd8\xff\xc9\0\x0b\x08\0\1\0\1\1\1\x11\0", "unsupported"),
    ]
    for data, code in cases:
        with pytest.raises(RasterError) as e:
            codecs.decode(data)
        assert e.value.code == code, (data[:12], e.value)
    with pytest.raises(RasterError) as e:
        codecs.decode(good, Limits(15))
    assert e.value.code == "limit_exceeded"
    assert "00010203" in str(pytest.raises(RasterError, codecs.decode, b"\0\1\2\3").value)


def test_tiff_regions_read_only_their_tiles():
    a = noise(100, 90, 3)
    data = tiff.encode(a, tile=16)
    assert (tiff.decode(data, region=Region(20, 30, 41, 17)) == a[30:47, 20:61]).all()
    assert [k for k, _ in tiff.chunks_covering(Region(20, 30, 41, 17), 90, 100, 16, 16)] == [7, 8, 9, 13, 14, 15]


def gif_of(width, height, frames, table=bytes(range(12)), ground=0) -> bytes:
    import struct

    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, ground, 0) + table
    for x, y, index, disposal, clear in frames:
        h, w = np.shape(index)
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        body = bits.lzw_encode(np.array(index, np.uint8).tobytes(), 2)
        out += b"," + struct.pack("<HHHHB", x, y, w, h, 0) + b"\2" + bytes([len(body)]) + body + b"\0"
    return out + b";"


def test_gif_frames_and_disposals():
    one = [[1]]
    base = (0, 0, [[3, 3], [3, 3]], gif.KEEP, None)
    color = lambda k: [3 * k, 3 * k + 1, 3 * k + 2, 255]
    for disposal, clear, want in ((0, None, color(1)), (gif.KEEP, None, color(1)), (gif.BACKGROUND, None, color(2)), (gif.BACKGROUND, 0, [0, 0, 0, 0]), (gif.PREVIOUS, None, color(3))):
        drawn = list(gif.canvases(gif_of(2, 2, [base, (1, 1, one, disposal, clear), (0, 0, one, 0, None)], ground=2)))
        assert drawn[1][1, 1].tolist() == color(1) and drawn[2][1, 1].tolist() == want
    clipped = list(gif.canvases(gif_of(2, 2, [(1, 1, [[1, 2], [2, 1]], 0, 1)])))[0]
    assert clipped[1, 1].tolist() == [0, 0, 0, 0]
    assert gif.interlaced(9).tolist() == [0, 8, 4, 2, 6, 1, 3, 5, 7]


def test_gif_palettes():
    a = noise(20, 30, 1)
    assert (codecs.decode(gif.encode(a, EncodeOptions(100)))[..., :1] == a).all()
    rgb = noise(16, 16, 3)
    assert len(gif.median_cut(rgb, 8)) <= 8 and (gif.median_cut(rgb[:1, :4], 256) == np.unique(rgb[0, :4], axis=0)).all()
    two = np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
    gray = np.full((16, 16, 3), 128, np.uint8)
    assert 0.4 < gif.diffused(gray, two).mean() < 0.6 and gif.nearest(gray, two).min() == 1


def test_jpeg_transforms_and_scales():
    a = smooth(75, 101)
    for quality, most in ((50, 2.5), (80, 1.6), (95, 0.8)):
        assert np.abs(codecs.decode(jpeg.encode(a, EncodeOptions(quality))).astype(int) - a).mean() < most
    data = jpeg.encode(a, EncodeOptions(95))
    whole = jpeg.decode(data).astype(float)
    for scale in (2, 4, 8):
        small = jpeg.decode(data, scale=scale)
        assert small.shape == (-(-75 // scale), -(-101 // scale), 3)
        box = whole[: 75 // scale * scale, : 101 // scale * scale].reshape(75 // scale, scale, 101 // scale, scale, 3).mean(axis=(1, 3))
        assert np.abs(small[: 75 // scale, : 101 // scale] - box).max() < 4
    flat = np.random.default_rng(0).normal(size=(5, 8, 8))
    assert np.allclose(jpeg.idct(jpeg.fdct(flat)), flat) and jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    assert jpeg.fitting(100, 80, 14, 10) == 4 and jpeg.fitting(100, 80, 13, 10) == 8


def test_another_maker_reads_the_same(spark, tmp_path):
    """Spark's image source decodes by the JVM's own readers."""
    a = smooth(40, 51)
    files = {"a.png": png.encode(a), "b.gif": gif.encode(noise(20, 30, 1), EncodeOptions(100)), "c.jpg": jpeg.encode(a, EncodeOptions(92)), "d.jpg": jpeg.encode(a, EncodeOptions(60)), "e.jpg": jpeg.encode(a[..., :1], EncodeOptions(90))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    seen = {r["origin"].rsplit("/", 1)[1]: r for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    assert set(seen) == set(files)
    for name, r in seen.items():
        theirs = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], r["nChannels"])
        theirs = theirs[..., [2, 1, 0][: r["nChannels"]]] if r["nChannels"] > 1 else theirs
        mine = codecs.decode(files[name])[..., : theirs.shape[2]].astype(int)
        assert mine.shape == theirs.shape and np.abs(mine - theirs).max() <= {"d.jpg": 40}.get(name, 4 if name.endswith("jpg") else 0), name


def jvm_jpeg(spark, a, quality=0.9, progressive=False, restart=0, sampling=(2, 2)):
    """A JPEG by the JVM's own writer, and its samples by the JVM's own reader."""
    jvm = spark._jvm
    io, meta = jvm.javax.imageio, jvm.javax.imageio.metadata
    image = io.ImageIO.read(jvm.java.io.ByteArrayInputStream(png.encode(a)))
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)
    data = writer.getDefaultImageMetadata(io.ImageTypeSpecifier(image), param)
    tree = data.getAsTree(data.getNativeMetadataFormatName())
    markers = tree.getElementsByTagName("markerSequence").item(0)
    if restart:
        node = meta.IIOMetadataNode("dri")
        node.setAttribute("interval", str(restart))
        markers.insertBefore(node, markers.getFirstChild())
    if a.shape[2] > 1:
        part = tree.getElementsByTagName("componentSpec").item(0)
        part.setAttribute("HsamplingFactor", str(sampling[0]))
        part.setAttribute("VsamplingFactor", str(sampling[1]))
    data.setFromTree(data.getNativeMetadataFormatName(), tree)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(image, None, data), param)
    stream.close()
    made = bytes(out.toByteArray())
    again = jvm.java.io.ByteArrayOutputStream()
    io.ImageIO.write(io.ImageIO.read(jvm.java.io.ByteArrayInputStream(made)), "png", again)
    return made, codecs.decode(bytes(again.toByteArray()))


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("channels,sampling", [(1, (1, 1)), (3, (1, 1)), (3, (2, 1)), (3, (1, 2)), (3, (2, 2))])
@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_of_another_maker(spark, progressive, channels, sampling, restart):
    """Sizes that fill no unit; a gradient under noise, so that no coefficient is spared."""
    rng = np.random.default_rng(3)
    grid = np.add.outer(np.arange(45) * 2, np.arange(61))
    a = np.clip(grid[..., None] + np.array([0, 30, 60])[:channels] + rng.integers(0, 25, (45, 61, 1)), 0, 255).astype(np.uint8)
    data, theirs = jvm_jpeg(spark, a, 0.95, progressive, restart, sampling)
    assert jpeg.is_progressive(data) == progressive and (data.count(b"\xff\xdd") == 1) == (restart > 0)
    mine = codecs.decode(data)
    apart = np.abs(mine.astype(int) - theirs[..., :channels].astype(int))
    # The JVM smooths halved chroma between its samples; luma agrees
    whole = channels == 1 or sampling == (1, 1)
    assert mine.shape == a.shape and (apart.max() <= 4 if whole else apart.mean() < 4)


def test_progressive_jpeg_holds_the_same_coefficients(spark):
    a = noise(33, 50, 3)
    found = []
    for progressive in (False, True):
        data, _ = jvm_jpeg(spark, a, 0.8, progressive)
        f = jpeg.header(data)
        jpeg.coefficients(data, f)
        found.append(f.parts)
    for p, q in zip(*found):
        rows, columns = -(-33 * p.v // 16), -(-50 * p.h // 16)  # blocks that hold samples; the others are padding
        assert (p.blocks[:rows, :columns] == q.blocks[:rows, :columns]).all() and (p.quant == q.quant).all()


@pytest.mark.parametrize("order,start", [("<", b"II*\0"), (">", b"MM\0*")])
def test_jpeg_orientation_is_read_and_not_applied(order, start):
    a = smooth(24, 16)
    plain = jpeg.encode(a)

    def with_exif(*entries):
        ifd = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHIHH", tag, kind, 1, value, 0) for tag, kind, value in entries)
        body = b"Exif\0\0" + start + struct.pack(order + "I", 8) + ifd
        return plain[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + plain[2:]

    for value, found in ((1, 1), (6, 6), (8, 8), (0, 1), (9, 1)):
        data = with_exif((0x10F, 3, 7), (0x112, 3, value))
        assert jpeg.header(data).orientation == found and (jpeg.decode(data) == jpeg.decode(plain)).all()
    assert jpeg.header(plain).orientation == jpeg.header(with_exif((0x112, 4, 6))).orientation == 1
    assert jpeg.header(with_exif((0x112, 3, 6)).replace(start + struct.pack(order + "I", 8), start + struct.pack(order + "I", 9999))).orientation == 1


def test_jpeg_without_color_transform():
    """An Adobe segment of transform 0: the components are red, green and blue."""
    a = smooth(24, 16)
    data = jpeg.encode(a, EncodeOptions(95))
    adobe = data[:2] + b"\xff\xee\0\x0eAdobe\0\x64\0\0\0\0\0" + data[2:]
    plain, mine = jpeg.decode(data).astype(float), jpeg.decode(adobe).astype(float)
    back = np.stack([mine[..., 0] + 1.402 * (mine[..., 2] - 128), mine[..., 0] - 0.344136 * (mine[..., 1] - 128) - 0.714136 * (mine[..., 2] - 128), mine[..., 0] + 1.772 * (mine[..., 1] - 128)], axis=2)
    assert np.abs(np.clip(back, 0, 255) - plain).max() <= 1


def test_progressive_jpeg_damaged_or_too_large(spark, monkeypatch):
    data, _ = jvm_jpeg(spark, smooth(40, 40), 0.9, True)
    scans = [k for k in range(len(data) - 1) if data[k : k + 2] == b"\xff\xda"]
    assert len(scans) > 3
    for cut in (scans[1], scans[-1], scans[2] + 12, len(data) - 2):
        with pytest.raises(RasterError) as e:
            jpeg.decode(data[:cut])
        assert e.value.code == "malformed"
    for k in range(scans[0] + 2, scans[0] + 14):  # scan headers that make no sense have codes, too
        try:
            jpeg.decode(data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :])
        except RasterError as e:
            assert e.code == "malformed"
    monkeypatch.setattr(jpeg, "PROGRESSIVE", 40 * 40 * 3 - 1)
    with pytest.raises(RasterError) as e:
        jpeg.decode(data)
    assert e.value.code == "limit_exceeded"


def test_open_run_and_write(spark, tmp_path):
    a, b = smooth(40, 51), noise(64, 48, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_bytes(png.encode(a))
    (tmp_path / "in" / "two").write_bytes(tiff.encode(b, tile=16))
    images = Raster.open(spark, str(tmp_path / "in"))
    assert sorted((r["width"], r["height"]) for r in images.metadata().collect()) == [(48, 64), (51, 40)]
    stats = images.crop(3, 5, 20, 30).flip().output("png").write_with_stats(str(tmp_path / "out"))
    assert stats.images == 2 and stats.bytes == sum(f.stat().st_size for f in (tmp_path / "out").iterdir())
    back = [codecs.decode(f.read_bytes()) for f in (tmp_path / "out").iterdir()]
    assert {x.tobytes() for x in back} == {x[5:35, 3:23][::-1].tobytes() for x in (a, b)}
    for wrong in (lambda: images.output("avif").bytes(), lambda: images.crop(0, 0, 0, 1).output("png").bytes()):
        with pytest.raises(RasterError):
            wrong()
    (tmp_path / "in" / "three").write_bytes(b"\0\1\2")
    with pytest.raises(Exception, match="three: no known format starts with 000102"):
        Raster.open(spark, str(tmp_path / "in")).images().collect()


def test_jpeg_shrinks_as_it_loads(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(jpeg.encode(smooth(80, 160), EncodeOptions(95)))
    small, whole = (Raster.open(spark, str(tmp_path), shrink=s).thumbnail(20, 20).images().first() for s in (True, False))
    assert (small.width, small.height) == (whole.width, whole.height) == (20, 10)
    assert np.abs(np.frombuffer(bytes(small.data), np.uint8).astype(int) - np.frombuffer(bytes(whole.data), np.uint8)).mean() < 6


def test_both_lowerings_give_the_same_bytes(spark):
    a = noise(9, 7, 4)
    rows = spark.createDataFrame([(1, 7, 9, "rgba8", bytearray(a.tobytes()))], tiles.IMAGE)
    chain = Raster(rows).resize(6, 5, "mitchell").modulate(1.2, 0.8, 30.0).rotate(90).flatten(1, 2, 3).blur(0.8).flop()
    out = chain.output("png")
    assert bytes(out.bytes().first().data) == bytes(out.bytes_via_reference().first().data)
    assert chain.node_count() == 7


def test_raw_layouts(spark):
    a = noise(3, 5, 3, np.uint16)
    d = Descriptor(5, 3, "rgb16")
    assert (raw.decode(raw.encode(a, stride=40), d, 40) == a).all()
    for data, stride, code in ((raw.encode(a)[:-1], None, "malformed"), (raw.encode(a), 3, "invalid_argument")):
        assert pytest.raises(RasterError, raw.decode, data, d, stride).value.code == code
    rows = spark.createDataFrame([(1, bytearray(raw.encode(a)))], "image_id long, data binary")
    assert bytes(Raster.from_raw(rows, d).images().first().data) == a.tobytes()
    with pytest.raises(Exception, match="which needs 90"):
        Raster.from_raw(spark.createDataFrame([(1, bytearray(b"123"))], "image_id long, data binary"), d).images().collect()


def test_user_steps_and_pairs(spark):
    a, b = noise(4, 4, 4, seed=1), noise(2, 3, 4, seed=2)
    one = Raster(spark.createDataFrame([(1, 4, 4, "rgba8", bytearray(a.tobytes())), (2, 4, 4, "rgba8", bytearray(a.tobytes()))], tiles.IMAGE))
    two = Raster(spark.createDataFrame([(1, 3, 2, "rgba8", bytearray(b.tobytes()))], tiles.IMAGE))
    (got,) = one.composite(two, 2, -1).apply(lambda s: 255 - s).images().collect()
    assert bytes(got.data) == (255 - kernels.composite(a[None], b[None], 2, -1)[0]).tobytes()


def test_demanded_regions_are_enough():
    a = noise(60, 80, 1)[None]
    chain = Raster(None).crop(5, 7, 60, 40).rotate(90).resize(20, 30, "lanczos3").blur(0.7).flip().rotate(270)
    region = Region(4, 3, 6, 5)
    steps = chain.demand(80, 60, region)
    read = steps[-1][1]
    hidden = np.zeros_like(a)
    hidden[:, read.y : read.bottom, read.x : read.right] = a[:, read.y : read.bottom, read.x : read.right]

    def result(x):
        x = kernels.rotate(kernels.crop(x, 5, 7, 60, 40), 90)
        x = kernels.convolve(kernels.resize(x, 20, 30, "lanczos3"), Kernel.gaussian(0.7))
        return kernels.rotate(kernels.flip(x), 270)[:, region.y : region.bottom, region.x : region.right]

    assert (result(a) == result(hidden)).all() and read.width * read.height < 80 * 60
    assert chain.explain_regions(80, 60, region).startswith("result: 6x5+4+3")


def test_relation_of_wide_samples_and_unlisted_sizes(spark):
    a = noise(5, 4, 3, np.uint16)
    rows = spark.createDataFrame([(1, 4, 5, "rgb16", bytearray(a.tobytes())), (2, 2, 5, "rgb16", bytearray(a[:, :2].tobytes()))], tiles.IMAGE)
    df = tiles.to_relation(rows)
    got = {(r.y, r.x): r.px for r in relational.resize(df, 3, 2, "bilinear", 3, full=65535).filter("image_id = 1").collect()}
    want = kernels.resize(a[None], 3, 2, "bilinear")[0]
    assert all(np.abs(np.array(got[y, x]) - want[y, x]).max() <= 1 for y in range(2) for x in range(3))
    assert relational.resize(df, 3, 2, "box", 3, full=65535).select("image_id").distinct().count() == 2
    with pytest.raises(Exception, match="width 2 is not among the sizes"):
        relational.resize(df, 3, 2, "box", 3, ([4], [5]), full=65535).collect()
    for wrong in (lambda: relational.flatten(df, (0, 0, 0), 4, 65535), lambda: relational.composite(df, df, 0, 0, "over", 4, 65535)):
        assert pytest.raises(RasterError, wrong).value.code == "unsupported"


def test_weights_of_known_sizes():
    """Worked out by hand from the filters' formulae."""
    from tessella.functions.weights import weights

    half = weights("box", 4, 2)
    assert [r[1:3] for r in half.rows() if r[2]] == [(0, 8192), (1, 8192), (2, 8192), (3, 8192)]
    assert [r[1:3] for r in weights("bilinear", 2, 4).rows() if r[2]] == [(0, 16384), (0, 12288), (1, 4096), (0, 4096), (1, 12288), (1, 16384)]
    # halving by Catmull-Rom: places at distances 1/4, 3/4, 5/4, 7/4 of the stretched filter, inside the line
    inner = weights("catmull-rom", 16, 8)
    w = [inner.exact[4, k] for k in range(inner.length[4]) if inner.fixed[4, k]]
    near = lambda t: 1.5 * t**3 - 2.5 * t**2 + 1
    far = lambda t: -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2
    expect = [far(1.75), far(1.25), near(0.75), near(0.25), near(0.25), near(0.75), far(1.25), far(1.75)]
    assert np.allclose(w, np.array(expect) / sum(expect), atol=1e-6)
    sinc = lambda t: np.sin(np.pi * t) / (np.pi * t)
    l2 = weights("lanczos2", 4, 8).exact[4]
    used = [sinc(t) * sinc(t / 2) for t in (1.75, 0.75, 0.25, 1.25)]
    assert np.allclose(sorted(x for x in l2 if x), sorted(np.array(used) / sum(used)), atol=1e-5)
