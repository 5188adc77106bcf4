"""Directory, painter, mutations, container files and the stream, on small documents with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.functions.parsing import IndexSet
from tessel.operators import directory, mutations, painter
from tessel.schema import DIM_COLUMNS, SUBBLOCKS, Rect
from tessel.sources import container
from tessel.streaming import directory_stream


def tile(i, x=0, y=0, w=8, h=6, m=None, sw=None, sh=None, **dims):
    row = {"sb_index": i, **{c: dims.get(c[-1]) for c in DIM_COLUMNS}, "m_index": m, "x": x, "y": y, "w": w, "h": h, "stored_w": sw or w, "stored_h": sh or h, "pixel_type": 0, "compression_raw": 0, "pyramid_type": 0, "file_position": i * 100}
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SUBBLOCKS)


def flat(tiles, values):
    """Payloads that are one value for each tile."""
    rows = [(r["sb_index"], bytearray([values[r["sb_index"]]] * (r["stored_w"] * r["stored_h"]))) for r in tiles.collect()]
    return tiles.sparkSession.createDataFrame(rows, "sb_index long, data binary")


def line(image, y=0):
    return [r["v"] for r in painter.pixels(image).where(F.col("py") == y).orderBy("px").collect()]


@pytest.mark.parametrize(("m", "want"), [((0, 1, 2), [42, 45, 47, 47]), ((2, 1, 0), [42, 42, 45, 47]), ((0, 2, 1), [42, 45, 45, 47]), ((2, 0, 1), [42, 42, 47, 47]), ((1, 0, 2), [42, 42, 47, 47]), ((1, 2, 0), [42, 45, 45, 47])])
def test_tiles_lie_in_the_order_of_m(spark, m, want):
    tiles = frame(spark, [tile(i, x=i, w=2, h=1, m=m[i], c=0) for i in range(3)])
    assert line(painter.tile_composite(tiles, flat(tiles, {0: 42, 1: 45, 2: 47}), {"c": 0}, Rect(0, 0, 4, 1))) == want


@pytest.mark.parametrize(
    ("rects", "area"),
    [([(0, 0, 100, 12)], 1200), ([(0, 0, 10, 100), (0, 0, 100, 10)], 1900), ([(-10, -10, 40, 40)], 900), ([(100, 0, 5, 5), (0, -5, 100, 5)], 0), ([(0, 0, 10, 10), (50, 50, 40, 25)], 1100), ([(0, 0, 100, 30), (10, 5, 20, 20), (0, 0, 100, 30)], 3000)],
)
def test_union_areas(spark, rects, area):
    df = spark.createDataFrame([(0, *r) for r in rects], "g int, x int, y int, w int, h int")
    row = directory.union_area(df, Rect(0, 0, 100, 100), "g").first()
    assert (row["area"] if row else 0) == area


def test_random_unions_and_cover(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        own = [(rng.randint(-20, 60), rng.randint(-20, 60), rng.randint(0, 50), rng.randint(0, 50)) for _ in range(rng.randint(1, 8))]
        rows += [(k, *r) for r in own]
        want[k] = len({(x, y) for x in range(40) for y in range(50) for a, b, w, h in own if a <= x < a + w and b <= y < b + h})
    df = spark.createDataFrame(rows, "g int, x int, y int, w int, h int")
    got = {r["g"]: r["area"] for r in directory.union_area(df, Rect(0, 0, 40, 50), "g").collect()}
    assert {k: v for k, v in want.items() if v} == got
    assert directory.is_covered(df, Rect(5, 5, 0, 3)) and not directory.is_covered(df, Rect(0, 0, 4000, 10))


def test_visible_tiles_give_the_same_picture(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [tile(i, rng.randint(-20, 99), rng.randint(-20, 99), rng.randint(1, 60), rng.randint(1, 60), m=rng.choice([None, *range(5)]), c=0, t=0) for i in range(rng.randint(1, 60))]
        tiles, roi, plane = frame(spark, rows), Rect(0, 0, 80, 80), {"c": 0, "t": 0}
        values = flat(tiles, {r[0]: r[0] % 251 for r in rows})
        seen = painter.visible_tiles(tiles, plane, roi)
        everything = painter.pixels(painter.tile_composite(tiles, values, plane, roi))
        pruned = painter.pixels(painter.tile_composite(tiles.join(seen.select("sb_index"), "sb_index", "left_semi"), values, plane, roi, window=(17, 23)))
        assert everything.exceptAll(pruned).isEmpty() and seen.count() <= len(rows)


def test_masks_hide_tiles(spark):
    tiles = frame(spark, [tile(0, 0, 0, 4, 2, m=0, c=0), tile(1, 0, 0, 4, 2, m=1, c=0)])
    masks = spark.createDataFrame([(1, 3, 2, 1, bytearray([0b10100000, 0b01000000]))], "sb_index long, mask_w int, mask_h int, stride int, bits binary")
    got = painter.tile_composite(tiles, flat(tiles, {0: 5, 1: 9}), {"c": 0}, Rect(0, 0, 4, 2), masks=masks)
    assert line(got) + line(got, 1) == [9, 5, 9, 5, 5, 9, 5, 5]
    wholly = spark.createDataFrame([(1, 4, 2, 1, bytearray([0, 0]))], masks.schema)
    assert [r[0] for r in painter.visible_tiles(tiles, {"c": 0}, Rect(0, 0, 4, 2), wholly).collect()] == [0]


def test_pyramid_and_scaling(spark):
    rows = [tile(0, 0, 0, 8, 8, m=0, c=0), tile(1, 8, 0, 8, 8, m=1, c=0), tile(2, 0, 0, 16, 8, sw=8, sh=4, c=0)]
    tiles = frame(spark, rows)
    values = flat(tiles, {0: 10, 1: 20, 2: 30})
    layer = painter.pixels(painter.pyramid_composite(tiles, values, {"c": 0}, Rect(0, 0, 16, 8), 2, 1))
    assert layer.count() == 32 and {r["v"] for r in layer.collect()} == {30}
    half = painter.pixels(painter.scaling_composite(tiles, values, {"c": 0}, Rect(0, 0, 16, 8), 0.5))
    assert half.count() == 32 and {r["v"] for r in half.collect()} == {30}
    assert line(painter.scaling_composite(tiles, values, {"c": 0}, Rect(0, 0, 16, 8), 1.0)) == [10] * 8 + [20] * 8
    with pytest.raises(LookupError):
        painter.pyramid_composite(tiles, values, {"c": 0}, Rect(0, 0, 16, 8), 2, 2, strict=True)
    with pytest.raises(ValueError):
        painter.pyramid_layer_number(1)


def test_several_scenes_leave_out_tiles_without_one(spark):
    rows = [tile(0, 0, 0, 4, 4, s=0, c=0), tile(1, 2, 0, 4, 4, s=1, c=0), tile(2, 0, 0, 8, 4, c=0)]
    tiles, roi = frame(spark, rows), Rect(0, 0, 8, 4)
    values = flat(tiles, {0: 1, 1: 2, 2: 3})
    top = lambda **k: line(painter.scaling_composite(tiles, values, {"c": 0}, roi, 1.0, **k))
    assert top() == [1, 1, 2, 2, 2, 2, 0, 0]
    assert top(scenes=IndexSet("1")) == [3] * 8  # one scene: the later tile, which has no scene, is on top


def test_scan_equals_whole(spark):
    rng = random.Random(6)
    rows = [tile(i, rng.randint(-10, 50), rng.randint(-10, 40), m=rng.randint(0, 3), c=0) for i in range(30)]
    tiles, roi = frame(spark, rows), Rect(-5, -5, 61, 43)
    values = flat(tiles, {i: i for i in range(30)})
    scan = painter.pixels(painter.plane_scan(tiles, values, {"c": 0}, roi, (16, 10)), bare=True, inside=True).selectExpr("wx * 16 + px as px", "wy * 10 + py as py", "v")
    whole = painter.pixels(painter.tile_composite(tiles, values, {"c": 0}, roi, ground=None), bare=True)
    assert scan.exceptAll(whole.selectExpr("px", "py", "v")).isEmpty() and scan.count() == whole.count()


def test_painting_any_type_as_in_numpy(spark):
    """Random tiles of four pixel types, painted one by one into an array of the target type."""
    import numpy as np

    from tessel.functions.bitmaps import ARRAYS, bitmap, convert
    from tessel.schema import BYTES_PER_PIXEL, PIXEL_TYPES

    rng = random.Random(11)
    for target in ("Gray8", "Gray16", "Gray32Float", "Bgr24", "Bgr48"):
        rows, data = [], {}
        for i in range(25):
            kind = rng.choice(["Gray8", "Gray16", "Bgr24", "Bgr48"])
            t = tile(i, rng.randint(-20, 70), rng.randint(-20, 60), rng.randint(1, 30), rng.randint(1, 30), m=rng.choice([None, 0, 1, 2]), c=0)
            rows.append((*t[:-4], PIXEL_TYPES[kind], *t[-3:]))
            data[i] = (kind, bytes(rng.randrange(256) for _ in range(t[-6] * t[-5] * BYTES_PER_PIXEL[kind])))
        tiles = frame(spark, rows)
        values = spark.createDataFrame([(i, bytearray(b)) for i, (_, b) in data.items()], "sb_index long, data binary")
        kind, samples = ARRAYS[target]
        want = np.zeros((64, 90, samples), kind)
        want[:] = painter.background(0.25, 0.5, 1, target)
        for r in sorted(rows, key=lambda r: (-1 if r[10] is None else r[10], r[0])):
            x, y, w, h = r[11:15]
            piece = convert(bitmap(data[r[0]][1], data[r[0]][0], w, h), data[r[0]][0], target)
            for py in range(max(0, y + 10), min(64, y + 10 + h)):
                for px in range(max(0, x + 10), min(90, x + 10 + w)):
                    want[py, px] = piece[py - y - 10, px - x - 10]
        image = painter.tile_composite(tiles, values, {"c": 0}, Rect(-10, -10, 90, 64), painter.background(0.25, 0.5, 1, target), target=target, window=(40, 24))
        got = np.zeros_like(want)
        for r in image.collect():
            got[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], kind).reshape(r["h"], r["w"], samples)
        assert (got == want).all(), target


def test_large_tiles_cost_what_their_pixels_cost(spark):
    import time

    tiles = frame(spark, [tile(i, 0, 0, n, n, m=i, c=0) for i, n in enumerate((512, 2048))])
    values = flat(tiles, {0: 1, 1: 2})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = time.time()
        image = painter.tile_composite(tiles, values, {"c": 0}, Rect(0, 0, 2048, 2048))
        assert sum(set(bytes(r["data"])) == {2} for r in image.collect()) == 64
        assert time.time() - began < 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_planes_are_checked(spark):
    tiles = frame(spark, [tile(i, c=i % 2, t=0, s=i % 3) for i in range(6)])
    directory.check_plane(tiles, {"C": 1})
    for bad in ({"c": 0, "s": 0}, {}, {"c": 2}, {"c": 0, "z": 0}):
        with pytest.raises(ValueError):
            directory.check_plane(tiles, bad)


def test_scene_boxes_and_missing_layer0(spark):
    rows = [tile(0, 5, 5, s=0), tile(1, 0, 0, 16, 12, sw=8, sh=6, s=1), tile(2, -3, 9)]
    got = {r["dim_s"]: r for r in directory.scene_boxes(frame(spark, rows)).collect()}
    assert got[1]["layer0_x"] is None and got[1]["box_w"] == 16 and set(got) == {0, 1}
    s = directory.statistics(frame(spark, [*rows, tile(3, m=99)])).first()
    assert s["n"] == 4 and s["m_max"] is None  # M counts only where some dimension is there


def test_arbitrary_tile(spark):
    assert directory.arbitrary_in_channel(frame(spark, [tile(4, c=1), tile(2, c=1)]), 1).first()["sb_index"] == 2
    assert directory.arbitrary_in_channel(frame(spark, [tile(4, c=1)]), 2).count() == 0
    assert directory.arbitrary_in_channel(frame(spark, [tile(4), tile(3)]), 2).first()["sb_index"] == 3


def test_writers_refuse_duplicates(spark):
    rows = [tile(0, m=1, c=0), tile(1, x=50, m=1, c=0), tile(2, x=1, c=0), tile(3, x=1, c=0), tile(4, x=2, c=0)]
    assert sorted(map(tuple, mutations.writer_duplicates(frame(spark, rows)).collect())) == [(1, 0), (3, 2)]
    assert [r[0] for r in mutations.updater_clashes(frame(spark, rows[:1]), frame(spark, [*rows[1:]])).collect()] == [1]
    held = frame(spark, rows[:1])
    assert mutations.add_tiles(held, frame(spark, [tile(7, m=2, c=0)]), {"c": (0, 1)}).count() == 2
    for bad, bounds in ((tile(8, m=1, c=0), None), (tile(8, m=3, c=5), {"c": (0, 1)}), (tile(8, m=3), {"c": (0, 1)}), (tile(8, m=3, c=0, t=0), {"c": (0, 1)})):
        with pytest.raises(Exception, match="Duplicate|OutOfBounds|Insufficient|Unexpected"):
            mutations.add_tiles(held, frame(spark, [bad]), bounds).collect()
    assert [r[0] for r in mutations.unknown_keys(held, frame(spark, [tile(0), tile(9)])).collect()] == [9]


def test_reconciliation_raises_unless_told(spark):
    a, b = frame(spark, [tile(0, c=0), tile(1, c=0)]), frame(spark, [tile(0, c=0), tile(1, c=1)])
    assert [r["dim_c"] for r in directory.reconciled(a, b, "header", ignore=True).orderBy("sb_index").collect()] == [0, 1]
    with pytest.raises(Exception, match="differ"):
        directory.reconciled(a, b).collect()


def test_container_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [tile(i, rng.randint(-50, 50), 3, 4, 2, m=i if i % 2 else None, c=i % 3, s=None if i == 3 else 0) for i in range(10)]
    names = [c.split(" ")[0] for c in SUBBLOCKS.split(", ")]
    tiles = [container.Tile(dict(zip(names, r, strict=True)), bytes([r[0]] * 8), f"<METADATA><Tags><A>{r[0]}</A></Tags></METADATA>", b"att" * r[0]) for r in rows]
    doc = container.Document(tiles, [("cbe3ea67-5bfc-492b-a16a-ece378031448", "JPG", "Thumbnail", b"pic")], "<ImageDocument/>", "00112233-4455-6677-8899-aabbccddeeff")
    path = str(tmp_path / "one.tiles")
    container.write_document(doc, path)
    spark.dataSource.register(container.ContainerSource)
    load = lambda t, **o: spark.read.format("tile_container").option("table", t).options(**o).load(path)
    got = load("subblocks", strict="true").drop("doc", "file_position").orderBy("sb_index").collect()
    assert [tuple(r) for r in got] == [r[:-1] for r in rows]
    pay = load("payloads", tiles_per_partition="3").orderBy("sb_index").collect()
    assert [(bytes(r["data"]), bytes(r["sb_attachment"])) for r in pay] == [(bytes([i] * 8), b"att" * i) for i in range(10)]
    heads = load("headers").drop("doc")
    assert directory.reconciled(load("subblocks").drop("doc", "file_position"), heads).count() == 10
    a = load("attachments").first()
    assert (a["name"], a["content_file_type"], bytes(a["data"])) == ("Thumbnail", "JPG", b"pic")
    assert load("metadata").first()["xml"] == "<ImageDocument/>" and load("files").first()["file_guid"] == doc.guid
    assert load("segments").groupBy("id").count().where("id = 'ZISRAWSUBBLOCK'").first()["count"] == 10
    with open(path, "r+b") as f:
        f.write(b"XXXX")
    with pytest.raises(Exception, match="FormatError|segment"):
        load("subblocks").collect()


def test_strict_entries():
    row = dict.fromkeys((*DIM_COLUMNS, "m_index")) | {"x": 0, "y": 0, "w": 4, "h": 4, "stored_w": 4, "stored_h": 4, "pixel_type": 0, "compression_raw": 0, "pyramid_type": 0}
    good = container._entry(row | {"dim_c": 2}, 5)
    assert container.entry_of(good, 0, strict=True)[0]["dim_c"] == 2
    wide = bytearray(good)
    container.DIMENSION.pack_into(wide, container.ENTRY.size + 40, b"C", 2, 3, 2.0, 1)
    assert container.entry_of(bytes(wide), 0)[0]["dim_c"] == 2
    with pytest.raises(container.FormatError):
        container.entry_of(bytes(wide), 0, strict=True)
    with pytest.raises(container.FormatError):
        container.entry_of(b"DE" + good[2:], 0)


def test_stream_folds_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [tile(i, rng.randint(0, 99), rng.randint(0, 99), s=i % 2) for i in range(40)]
    at, out = str(tmp_path / "tiles"), str(tmp_path / "out")
    for k in range(2):
        frame(spark, rows[20 * k : 20 * k + 20]).write.mode("append").parquet(at)
        directory_stream.follow(spark, at, out, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(f"{out}/batch=1")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in directory_stream.partial(frame(spark, rows)).collect()}


def test_generated_mosaics(spark):
    d = mutations.synthetic_document(spark, {"c": (0, 2)}, 2, 3, (10, 8), 0.15)
    assert d.count() == 12 and {tuple(r) for r in d.where("dim_c = 0 and m_index = 5").select("x", "y").collect()} == {(20 - 3, 8 - 1)}
    assert mutations.all_coordinates(spark, {}).count() == 0


def test_payloads_are_made_on_all_cores(spark):
    """By the rule, for each pixel type and size, though the tiles come in one partition."""
    from tessel.sources import tables

    rows = [(i * 40503, (0, 1, 3, 4)[i % 4], 3 + i % 2, 2) for i in range(16)]
    tiles = spark.createDataFrame(rows, "sb_index long, pixel_type int, stored_w int, stored_h int").coalesce(1)
    made = tables.payloads(tiles)
    assert made.rdd.getNumPartitions() > 1
    got = {r["sb_index"]: bytes(r["data"]) for r in made.collect()}
    for i, kind, w, h in rows:
        want = b""
        for sy in range(h):
            for sx in range(w):
                for k in range(3 if kind >= 3 else 1):
                    want += ((i * 131 + sx * 1009 + sy * 2003 + k * 4001) % 65536).to_bytes(2, "little") if kind in (1, 4) else bytes([(i * 31 + sx * 7 + sy * 13 + k * 17) % 256])
        assert got[i] == want
    beside = tables.payloads(tiles, beside=True)
    assert beside.columns == [*tiles.columns, "data"] and {(r["sb_index"], r["pixel_type"], bytes(r["data"])) for r in beside.collect()} == {(i, k, got[i]) for i, k, *_ in rows}


def _entries(rng, n):
    """Directory entries, some of them unusual."""
    out = []
    for i in range(n):
        row = dict.fromkeys((*DIM_COLUMNS, "m_index")) | {"x": rng.randint(-9, 9), "y": i, "w": 4, "h": 3, "stored_w": 4, "stored_h": 3, "pixel_type": i % 5, "compression_raw": 0, "pyramid_type": i % 3}
        row |= {c: rng.randint(-5, 5) for c in (*DIM_COLUMNS, "m_index") if rng.random() < 0.5}
        entry = bytearray(container._entry(row, i * 1000))
        if i % 7 == 0:  # a letter in lower case, a name of two letters, a size
            container.DIMENSION.pack_into(entry, container.ENTRY.size, *((b"x ", 3, 8, 3.0, 4), (b"XQ", 1, 2, 1.0, 2), (b"X", 1, 5, 1.0, 5))[i // 7 % 3])
        out.append(bytes(entry))
    return out


def test_entries_by_column_are_those_by_row():
    entries = _entries(random.Random(4), 200)
    starts = [sum(map(len, entries[:k])) for k in range(len(entries))]
    got = container.columns_of(b"".join(entries), starts)
    for k, at in enumerate(starts):
        row, size = container.entry_of(b"".join(entries), at)
        assert size == len(entries[k]) and row == {c: None if v.mask[k] else int(v[k]) for c, v in got.items()}
    with pytest.raises(container.FormatError):
        container.columns_of(b"".join(entries), starts, strict=True)
    with pytest.raises(container.FormatError):
        container.columns_of(b"DE" + entries[0][2:], [0])


def test_a_run_reads_its_own_part_of_the_directory(tmp_path, monkeypatch):
    """What all partitions read, and what a document under construction holds, is in proportion to the tiles."""
    rng, path = random.Random(3), str(tmp_path / "many.tiles")
    names = [c.split(" ")[0] for c in SUBBLOCKS.split(", ")]
    rows = [tile(i, i, 0, 1, 1, m=i if rng.random() < 0.5 else None, c=0) for i in range(3000)]
    new = container.Appender()
    for r in rows:
        new.add(container.Tile(dict(zip(names, r, strict=True)), b"d"))
    assert new.n == 3000 and not any(isinstance(v, (list, bytes)) and len(v) > 100 for v in vars(new).values())
    new.finish()
    new.f.seek(0)
    (tmp_path / "many.tiles").write_bytes(new.f.read())
    read = [0]
    at = container.File.at
    monkeypatch.setattr(container.File, "at", lambda self, offset, size: read.__setitem__(0, read[0] + len(out := at(self, offset, size))) or out)
    monkeypatch.setattr(container, "PIECE", 6000)
    for table in ("headers", "tiles", "subblocks"):
        reader = container._Reader({"path": path, "table": table, "tiles_per_partition": "30", "roi": "0,0,9,1"})
        parts = reader.partitions()
        read[0], got = 0, [i for p in parts for b in reader.read(p) for i in b.column("sb_index").to_pylist()]
        assert len(parts) == 100 and got == list(range(9))
        assert read[0] < 3000 * 120 + len(parts) * 7000
    everything = container._Reader({"path": path, "table": "headers", "tiles_per_partition": "30"})
    assert [i for p in everything.partitions() for b in everything.read(p) for i in b.column("m_index").to_pylist()] == [r[10] for r in rows]


def test_regions_alike_are_compared_once(spark):
    """Pairs as by hand, with equal rectangles, empty ones and a null name; the join has a row for each distinct rectangle."""
    rng = random.Random(12)
    rows = [tile(i, rng.randint(-300, 300), rng.randint(-300, 300), rng.randint(0, 200), rng.randint(1, 90), sw=8, sh=6) for i in range(60)]
    spots = [(rng.randint(-300, 300), rng.randint(-300, 300), rng.randint(0, 150), 40) for _ in range(10)]
    rois = [(None if i == 7 else i, *spots[i % 10]) for i in range(200)]
    got = painter.tiles_of_regions(frame(spark, rows), spark.createDataFrame(rois, "roi_id long, rx int, ry int, rw int, rh int").coalesce(1))
    want = [(i, t[0]) for i, x, y, w, h in rois for t in rows if w > 0 and t[13] > 0 and min(x + w, t[11] + t[13]) > max(x, t[11]) and min(y + h, t[12] + t[14]) > max(y, t[12])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()


def test_paint_order_keeps_all_digits(spark):
    """Tiles of a high scene whose numbers differ by less than a double of their rank can hold."""
    rows = [tile(i, 0, 0, 16, 12, sw=8, sh=6, c=0, s=s) for i, s in ((526445, 3), (526333, 3), (9, 0))]
    tiles = frame(spark, rows)
    image = painter.scaling_composite(tiles, flat(tiles, {526445: 1, 526333: 2, 9: 3}), {"c": 0}, Rect(0, 0, 16, 12), 0.5)
    assert {r["v"] for r in painter.pixels(image).collect()} == {1}
