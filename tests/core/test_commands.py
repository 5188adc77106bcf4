"""Commands over a document that they have made themselves, and the formats of their options."""

import json
import struct
import zlib

import numpy as np
import pytest

from tessel import commands
from tessel.functions import parsing
from tessel.functions.png import png
from tessel.operators import painter


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('made')}"
    tiles = commands.create(spark, folder, "mosaic", "C0:2T0:1", "2x3;10%", (20, 10), "zstd1:ExplicitLevel=3")
    return f"{folder}/*.tiles", tiles.collect()


def _image(windows):
    rows = windows.collect()
    w, h = max(r["x"] + r["w"] for r in rows), max(r["y"] + r["h"] for r in rows)
    out = np.zeros((h, w), np.uint8)
    for r in rows:
        out[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])
    return out


def test_pictures_of_a_made_document(spark, made, tmp_path):
    path, tiles = made
    got = _image(commands.tile(spark, path, "C1T0"))
    want = np.zeros_like(got)
    for t in sorted((t for t in tiles if t["dim_c"] == 1), key=lambda t: t["m_index"]):
        want[t["y"] : t["y"] + 10, t["x"] : t["x"] + 20] = t["sb_index"] % 256
    assert (got == want).all() and got.shape == (19, 56)
    assert (_image(commands.scan(spark, path, "C1T0", None, (16, 8))) == want).all()
    assert (_image(commands.scaled(spark, path, "C1T0", None, 1.0)) == want).all()
    assert (_image(commands.tile(spark, path, "C1T0", "rel(5, 3, 12, 9)")) == want[3:12, 5:17]).all()
    shown = json.dumps({"channels": [{"ch": 0, "tinting": "#FF0000"}, {"ch": 1, "tinting": "none", "black-point": 0, "white-point": 1}]})
    rows = commands.composed(spark, path, "T0", shown=shown, fmt="bgra32(0x80)").collect()
    first = _image(commands.tile(spark, path, "C0T0"))
    assert all((r["b"], r["g"], r["a"]) == (want[r["py"], r["px"]],) * 2 + (128,) and r["r"] == min(255, int(want[r["py"], r["px"]]) + first[r["py"], r["px"]]) for r in rows)
    files = commands.save(commands.scan(spark, path, "C1T0", None, (16, 8)), f"file://{tmp_path}/out", "Gray8").collect()
    assert len(files) == 4 * 3 and (tmp_path / "out" / "window_0_0.png").read_bytes().startswith(b"\x89PNG")


def test_every_level_of_information(spark, made):
    path, tiles = made
    for level in commands.LEVELS:
        commands.info(spark, path, level).collect()
    with pytest.raises(ValueError, match="no level"):
        commands.info(spark, path, "Else")
    one = commands.subblock(spark, path, 3).first()
    assert bytes(one["data"]) == bytes([3] * 200)
    from tessel.sources import container

    held = json.loads(commands.statistics_json(container.opened(spark, path)).first()["json"])
    assert held["subBlockCount"] == len(tiles) == 12 and held["boundingBox"] == {"x": 0, "y": 0, "w": 56, "h": 19} and held["dimBounds"] == {"C": {"start": 0, "size": 2}, "T": {"start": 0, "size": 1}}
    assert commands.dimensions_json(spark, path).count() == 0
    assert len(commands.version()) == 3


def test_png_reads_back():
    rng = np.random.default_rng(2)
    for kind, dtype, n in (("Gray8", "u1", 1), ("Gray16", "<u2", 1), ("Bgr24", "u1", 3), ("Bgr48", "<u2", 3), ("Bgra32", "u1", 4)):
        v = rng.integers(0, 256 if dtype == "u1" else 65536, (5, 7, n)).astype(dtype)
        data = png(v.tobytes(), 7, 5, kind)
        at, chunks = 8, {}
        while at < len(data):
            (size,) = struct.unpack_from(">I", data, at)
            name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
            assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(name + body)
            chunks[name], at = body, at + 12 + size
        assert struct.unpack(">IIBB", chunks[b"IHDR"][:10]) == (7, 5, 8 * v.itemsize, {1: 0, 3: 2, 4: 6}[n])
        lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(5, -1)
        back = lines[:, 1:].copy().view(f">u{v.itemsize}").reshape(5, 7, n)
        assert (lines[:, 0] == 0).all() and (back == v[:, :, [2, 1, 0, 3][:n] if n > 1 else [0]]).all()
    with pytest.raises(ValueError):
        png(b"", 0, 0, "Gray32Float")


def test_option_formats():
    assert [parsing.mosaic(t) for t in ("3x4", "3*4", "2X5;10%", "2 x 5 , 10 %", "2x5-7%")] == [(3, 4, 0.0), (3, 4, 0.0), (2, 5, 0.1), (2, 5, 0.1), (2, 5, 0.07)]
    for bad in ("", "x", "0x4", "3x", "3x4;", "3x4;a%"):
        with pytest.raises(ValueError):
            parsing.mosaic(bad + ("" if bad != "3x4;" else "?"))
    assert [parsing.channel_format(t) for t in ("bgr24", "BGRA32", "bgra32(7)", "bgra32(0xfF)")] == [("bgr24", 255), ("bgra32", 255), ("bgra32", 7), ("bgra32", 255)]
    for bad in ("bgr24(3)", "bgra32(256)", "bgra32(0x100)", "bgra32(", "rgb", "bgra32(a)"):
        with pytest.raises(ValueError):
            parsing.channel_format(bad)
    assert parsing.xml_time("2020-01-02T03:04:05+24:00") is None
    assert parsing.typed("1_000", "int") is None and parsing.typed("\u0663", "int") is None
    assert painter.background(1.0, 0.5, 0.25, "Bgr24") == [64, 128, 255]
    got = commands.settings('{"channels": [{"ch": 2, "gamma": 0.45, "weight": 0.5}, {"ch": 0, "splinelut": [0.3, 0.6, 0.7, 0.8]}]}')
    assert [c.index for c in got] == [2, 0] and got[0].weight == 0.5 and len(got[0].lut) == len(got[1].lut) == 256
    for bad in ("{}", '{"channels": [{}]}', '{"channels": [{"ch": 1, "tinting": "#12"}]}'):
        with pytest.raises(ValueError):
            commands.settings(bad)
