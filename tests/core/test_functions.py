"""Parsers, look-up tables, splines, codecs, masks: literal expectations and properties."""

import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.functions import codecs, luts, metadata, parsing
from tessel.functions.codecs import Bitonal
from tessel.functions.metadata_build import Builder
from tessel.operators import channels, painter
from tessel.schema import Rect


@pytest.mark.parametrize(("text", "want"), [("C0", {"c": 0}), ("C0Z3T-1", {"c": 0, "z": 3, "t": -1}), ("  c 1 , T +2;z 0003", {"c": 1, "t": 2, "z": 3}), ("S2147483647", {"s": 2147483647})])
def test_coordinates(text, want):
    assert parsing.coordinate(text) == want
    assert parsing.coordinate(parsing.coordinate_text(want)) == want


@pytest.mark.parametrize("text", ["C", "X1", "C0C1", "C2147483648", "C1.5", "C0 ?", "C--1"])
def test_bad_coordinates(text):
    assert parsing.try_coordinate(text) is None


def test_bounds():
    assert parsing.bounds("C0:2T-1:4") == {"c": (0, 2), "t": (-1, 4)}
    assert parsing.bounds_text({"t": (0, 4), "c": (0, 2)}) == "C0:2T0:4"
    for bad in ("C0:0", "C0", "C0:2C1:1"):
        with pytest.raises(ValueError):
            parsing.bounds(bad)


@pytest.mark.parametrize(("text", "inside", "outside"), [("4-9", [4, 9], [3, 10]), ("4-9,11-13", [5, 12], [10, 14]), ("-inf-3", [-(10**9), 3], [4]), ("7 -inf", [7, 10**9], [6]), (" 1 , +2", [1, 2], [3]), ("-4--2", [-3], [-1])])
def test_index_sets(text, inside, outside):
    s = parsing.IndexSet(text)
    assert all(i in s for i in inside) and not any(i in s for i in outside)


@pytest.mark.parametrize("text", ["9-4", "a", "1-2-3", "1;2"])
def test_bad_index_sets(text):
    with pytest.raises(ValueError):
        parsing.IndexSet(text)


def test_uri_tokens():
    assert parsing.uri_tokens(r"a=b\;c;d=e\=f=g") == {"a": "b;c", "d": "e=f=g"}
    for bad in ("", "abc", "=x", "a=", "a=b;c"):
        with pytest.raises(ValueError):
            parsing.uri_tokens(bad)


def test_compression_options():
    assert parsing.compression_options("ZSTD1: ExplicitLevel = -3 ;PreProcess=hilobyteunpack;x=y") == (6, {"level": -3, "hi_lo": True})
    assert parsing.compression_options("uncompressed:") == (0, {})
    for bad in ("nope:", "zstd0:ExplicitLevel=abc"):
        with pytest.raises(ValueError):
            parsing.compression_options(bad)


def test_small_parsers():
    assert parsing.colour("#FF102030") == (16, 32, 48) and parsing.colour("#102030") is None and parsing.colour_text(16, 32, 48) == "#FF102030"
    assert parsing.roi("rel(1,2,3,4)", (10, 20)) == Rect(11, 22, 3, 4) and parsing.roi("abs(1,-2,3,4)") == Rect(1, -2, 3, 4)
    assert parsing.size_with_unit("2 MiB") == 2 * 1024**2 and parsing.size_with_unit("10k") == 10_000
    assert parsing.channel_format("bgra32(7)") == ("bgra32", 7) and parsing.channel_format("Bgr24") == ("bgr24", 255)
    assert parsing.mosaic("3x4;10%") == (3, 4, 0.1)
    assert parsing.typed("yes", "bool") is True and parsing.typed("-1", "uint") is None and parsing.typed("1.5", "int") is None
    assert parsing.xml_time("2020-02-30T00:00:00Z") is None
    assert parsing.xml_time_text(parsing.xml_time("2020-02-29T01:02:03.456Z")) == "2020-02-29T01:02:03Z"
    assert parsing.guid("{CBE3EA67-5BFC-492B-A16A-ECE378031448}") == str(codecs.VALID_PIXELS) and parsing.guid("{x") is None


def test_gamma_tables():
    straight = luts.from_gamma(256, 0, 1, 1.0)
    assert straight == list(range(256))
    for gamma in (0.3, 0.45, 0.5, 2.2):
        t = luts.from_gamma(256, 0.25, 0.75, gamma)
        assert len(t) == 256 and t == sorted(t) and t[:64] == [0] * 64 and t[192:] == [255] * 64
    assert luts.from_gamma(65536, 0, 1, 1.0, 16)[-1] == 65535


def test_splines_pass_through_their_points():
    points = [(0.2, 0.5), (0.6, 0.7)]
    pieces = luts.spline(points)
    for (x0, a, b, c, d), (x, y) in zip(pieces, [*points, (1.0, 1.0)], strict=True):
        t = x - x0
        assert ((a * t + b) * t + c) * t + d == pytest.approx(y)
    assert luts.from_spline(256, 0, 1, luts.spline([(0.5, 0.5)])) == pytest.approx(list(range(256)), abs=1)


@settings(deadline=None, max_examples=60)
@given(st.binary(min_size=0, max_size=200), st.sampled_from(["UnCompressed", "Zstd0", "Zstd1"]), st.booleans(), st.sampled_from(["Gray8", "Gray16", "Bgr24", "Bgr48"]))
def test_codecs_round_trip(data, method, hi_lo, kind):
    from tessel.schema import BYTES_PER_PIXEL

    n = BYTES_PER_PIXEL[kind]
    data = data[: len(data) // n * n]
    if data:
        assert codecs.decode(codecs.encode(data, method, kind, 3, hi_lo), method, len(data) // n, 1, kind, strict=True) == data


def test_short_and_long_payloads():
    assert codecs.decode(b"ab", "UnCompressed", 2, 2) == b"ab\0\0"
    assert codecs.decode(b"abcdef", "UnCompressed", 2, 2) == b"abcd"
    assert codecs.decode(codecs.encode(b"ab", "Zstd0"), "Zstd0", 2, 2) == b"ab\0\0"
    for method in ("UnCompressed", "Zstd0"):
        with pytest.raises(ValueError):
            codecs.decode(codecs.encode(b"ab", method), method, 2, 2, strict=True)
    for method in ("JpgXr", "Jpg"):
        with pytest.raises(NotImplementedError):
            codecs.decode(b"", method, 1, 1)
    with pytest.raises(ValueError):
        codecs.decode(b"\x07", "Zstd1", 1, 1)


def test_chunks_and_masks():
    other = uuid.uuid4()
    mask = codecs.mask_chunk(9, 2, 2, b"\xff\x80\x00\x00")
    data = codecs.write_chunks([(other, b"x"), (codecs.VALID_PIXELS, mask)])
    assert [(g, s) for g, _, s in codecs.chunks_of(data)] == [(other, 1), (codecs.VALID_PIXELS, 20)]
    assert codecs.mask_of(data) == (9, 2, 2, b"\xff\x80\x00\x00")
    assert codecs.mask_of(data[:-3]) is None and codecs.mask_of(b"") is None
    assert codecs.mask_of(codecs.write_chunks([(codecs.VALID_PIXELS, codecs.mask_chunk(9, 2, 1, b"\xff\xff"))])) is None
    with pytest.raises(ValueError):
        codecs.chunks_of(data[:45])


def test_bitonal():
    b = Bitonal(10, 6)
    b.fill(2, 1, 100, 3, True)
    assert b.get(9, 3) and not b.get(1, 1) and not b.get(2, 4)
    with pytest.raises(IndexError):
        b.set(10, 0, True)
    assert np.array_equal(Bitonal.unpacked(10, 6, 2, b.packed()).bits, b.bits)
    c = Bitonal(4, 4)
    c.copy_at(b, -2, -1)
    assert c.bits.tolist() == [[True] * 4] * 3 + [[False] * 4]


def test_decimation_needs_the_whole_neighbourhood():
    rng = random.Random(3)
    b = Bitonal(13, 9, np.array([[rng.random() < 0.8 for _ in range(13)] for _ in range(9)]))
    for n in range(4):
        got = b.decimated(n)
        for y in range(4):
            for x in range(6):
                want = all(b.bits[v, u] for v in range(max(0, 2 * y - n), min(9, 2 * y + n + 1)) for u in range(max(0, 2 * x - n), min(13, 2 * x + n + 1)))
                assert got.get(x, y) == want


def test_weights():
    c = channels.Channel
    assert channels.effective_weights([c(0, 1.0), c(1, 1.0)]) is None
    assert channels.effective_weights([c(0, float("nan")), c(1, 1.0)]) is None
    assert channels.effective_weights([c(0, -1.0), c(1, 1.0)]) is None
    assert channels.effective_weights([c(0, 0.0), c(1, 0.0)]) is None
    assert channels.effective_weights([c(0, 1.0), c(1, 3.0)]) == {0: 0.5, 1: 1.5}


def test_conversions_are_a_closed_list(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        channels.converted(F.col("v"), "Gray8", "Bgra32")
    row = spark.range(1).select(channels.converted(F.array(F.lit(1), F.lit(1), F.lit(0)), "Bgr24", "Gray8").alias("a"), channels.converted(F.array(F.lit(7)), "Gray8", "Bgr48").alias("b")).first()
    assert row["a"] == [1] and row["b"] == [7, 7, 7]


def test_background():
    assert painter.background(0.5, 0.5, 0.5) == 128 and painter.background(float("nan"), 0, 0) is None and painter.background(2, 2, 2) == 255


def test_paths():
    assert metadata.xpath_of("A/B[Id=ab,Name=xy]/C[1]") == "A[1]/B[@Id='ab'][@Name='xy'][1]/C[2]"
    for bad in ("A//B", "A[x]", "A[=1]", "A]"):
        with pytest.raises(ValueError):
            metadata.xpath_of(bad)


def test_builder(spark):
    b = Builder()
    b.document(name="x & y", rating=3, creation_date=parsing.xml_time("2020-01-02T03:04:05Z"))
    b.scaling(x=(1e-6, "um"), z=2e-6)
    b.axis("T", interval=(0.0, 1.5))
    b.display([channels.Channel(0, 0.5, (1, 2, 3), 0.1, 0.9), channels.Channel(1, enabled=False)], gamma={0: 0.45}, names={1: "b"})
    b.custom("Key", True)
    with pytest.raises(ValueError):
        b.custom("no name", 1)
    b.set("Metadata/Gone", 1)
    b.remove("Metadata", "Gone")
    docs = spark.createDataFrame([(1, b.serialised())], "doc_id long, xml string")
    info = metadata.document_info(docs).first()
    assert (info["name"], info["rating"], info["creation_date"]) == ("x & y", 3, "2020-01-02T03:04:05Z")
    s = metadata.scaling(docs).first()
    assert s["scale_x"] == 1e-6 and s["unit_x"] == "um" and s["scale_y"] != s["scale_y"] and s["scale_z"] == 2e-6
    assert metadata.axis_info(docs, "T").first()["increment"] == 1.5
    shown = metadata.active_channels(metadata.display_settings(docs))
    assert len(shown) == 1 and shown[0].tint == (1, 2, 3) and len(shown[0].lut) == 256
    assert metadata.is_valid_xml(b.serialised()) and not metadata.is_valid_xml("<a>")


def test_spline_goes_before_gamma(spark):
    xml = "<ImageDocument><Metadata><DisplaySetting><Channels><Channel><Gamma>0.5</Gamma><Mode>Spline</Mode><Points>0.3 0.4</Points></Channel><Channel><Color>#123456</Color></Channel></Channels></DisplaySetting></Metadata></ImageDocument>"
    a, b = metadata.display_settings(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).orderBy("channel").collect()
    assert a["mode"] == "Spline" and a["points"] == [0.3, 0.4]
    assert (b["mode"], b["tint_r"], b["black"], b["white"], b["enabled"]) == ("Linear", 255, 0.0, 1.0, True)


def test_paths_are_read_as_by_xpath(spark):
    """Odd documents, against the engine's own XPath."""
    from pyspark.sql import functions as F

    texts = [
        "<R><A k='1'>x<!-- no --><B>y</B><![CDATA[<z>]]></A><A k='2'> t&amp;&#65; <B/></A></R>",
        "<R xmlns='u:v'><A k='2'><B>in a namespace</B></A></R>",
        "<R xmlns:p='u:v'><p:A>other</p:A><A><B p:k='3'>line\r\nend</B></A></R>",
        "<!DOCTYPE R [<!ENTITY e 'entity'>]><R><A>&e;</A></R>",
        "<?xml version='1.0' encoding='utf-16'?><R><A k=''>é\U0001f600</A></R>",
        "<Q/>",
        "",
        None,
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "xml string").coalesce(1)
    xml = F.col("xml")
    for path in ("A", "A[1]", "A[k=2]", "A[k=2]/B", "A/B[0]", "A[7]"):
        at = "/*/" + metadata.xpath_of(path)
        want = F.when(F.xpath_boolean(xml, F.lit(at)), F.xpath_string(xml, F.lit(at)))
        mark = F.when(F.xpath_boolean(xml, F.lit(at + "/@k")), F.xpath_string(xml, F.lit(at + "/@k")))
        rows = docs.select(metadata.node_text(xml, path), want, metadata.attribute(xml, path, "k"), mark, metadata.child_count(xml, path), F.xpath_int(xml, F.lit(f"count({at}/*)"))).collect()
        for r in rows:
            assert (r[0], r[2], r[4]) == (r[1], r[3], r[5]), (path, r)
    with pytest.raises(Exception, match="invalid XML|ParseError"):
        spark.createDataFrame([("<R>",)], "xml string").select(metadata.node_text(xml, "A")).collect()


@pytest.mark.parametrize("name", ["z_axis", "t_axis", "xml_axis", "xml_scaling", "xml_document", "xml_path", "xml_channels", "subblock_tags"])
def test_documents_are_read_on_all_cores_and_once(spark, data, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, data)
    assert df.rdd.getNumPartitions() > 1
    assert "xpath" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_long_bitmaps_are_decimated_as_packed_words(spark):
    """Wide, odd and holed bitmaps with unknown pixels, against every neighbourhood by hand."""
    rng = random.Random(21)
    pixels = {}
    for i, (w, h) in enumerate([(1, 1), (31, 3), (33, 4), (70, 9), (129, 6)]):
        for x in range(-1, w):
            for y in range(h):
                if rng.random() < 0.9:
                    pixels[i, x, y] = (w, h, rng.choice([True] * 40 + [False, None]))
    frame = spark.createDataFrame([(i, w, h, x, y, on) for (i, x, y), (w, h, on) in pixels.items()], "id long, w int, h int, x int, y int, on boolean")
    for n in (0, 1, 3, 7):
        want = {}
        for (i, x, y), (w, h, _) in pixels.items():
            if x % 2 == 0 and y % 2 == 0 and x // 2 < w // 2 and y // 2 < h // 2:
                near = [pixels[i, a, b][2] for a in range(x - n, x + n + 1) for b in range(y - n, y + n + 1) if (i, a, b) in pixels and pixels[i, a, b][2] is not None]
                want[i, x // 2, y // 2] = all(near) if near else None
        rows = codecs.decimated(frame, n).collect()
        assert {(r["id"], r["x"], r["y"]): r["on"] for r in rows} == want and len(rows) == len(want)
    assert "bit_or" in codecs.decimated(frame, 2)._jdf.queryExecution().optimizedPlan().toString()
