"""Metadata, extents and layouts to and from JSON."""

import json

import pytest

from gridseries.model import CellType, Extent, GridMetadata, TileLayout
from gridseries.sources import metadata as md

# fixed values: records as stored catalogs hold them
EXTENTS = [(-13.13, 23.2323, 600.6006, 44.0), (-3.13, 23.0, 6.6, 41.0), (-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 1e-9, 1e15)]
LAYOUTS = [(2, 4, 7, 6), (1, 1, 1, 1), (360, 180, 512, 512)]
RECORDS = [
    GridMetadata(1000, (100, 200, 400, 600), Extent(*EXTENTS[1]), TileLayout(*LAYOUTS[0]), CellType("int32")),
    GridMetadata(0, (), Extent(*EXTENTS[2]), TileLayout(*LAYOUTS[1]), CellType("float64")),
    GridMetadata(7, (-5, 0, 2147483646), Extent(*EXTENTS[3]), TileLayout(*LAYOUTS[2]), CellType("int8")),
]


def as_dict(m: GridMetadata) -> dict:
    e, lay = m.extent, m.layout
    return {"timeCount": m.time_count, "splits": list(m.splits),
            "extent": {"xmin": e.xmin, "ymin": e.ymin, "xmax": e.xmax, "ymax": e.ymax},
            "tileLayout": {"tileCols": lay.tile_cols, "tileRows": lay.tile_rows, "pixelCols": lay.pixel_cols, "pixelRows": lay.pixel_rows},
            "cellType": m.cell_type.code}


def parsed(spark, value: dict) -> GridMetadata:
    df = spark.createDataFrame([(json.dumps(value, indent=1),)], "value string")
    return md.to_record(df.select(md.metadata_from_json("value").alias("metadata")).first()["metadata"])


def without(value: dict, *path: str) -> dict:
    out = json.loads(json.dumps(value))
    inner = out
    for key in path[:-1]:
        inner = inner[key]
    del inner[path[-1]]
    return out


@pytest.mark.parametrize("values", EXTENTS)
def test_extent_both_ways(spark, values):
    text = json.dumps(dict(zip(("xmin", "ymin", "xmax", "ymax"), values)))
    df = spark.createDataFrame([(text,)], "j string").select(md.extent_from_json("j").alias("e"))
    assert tuple(df.first()["e"]) == values
    assert json.loads(df.select(md.extent_to_json("e")).first()[0]) == json.loads(text)


@pytest.mark.parametrize("values", LAYOUTS)
def test_layout_both_ways(spark, values):
    text = json.dumps(dict(zip(("tileCols", "tileRows", "pixelCols", "pixelRows"), values)))
    df = spark.createDataFrame([(text,)], "j string").select(md.layout_from_json("j").alias("t"))
    assert tuple(df.first()["t"]) == values
    assert json.loads(df.select(md.layout_to_json("t")).first()[0]) == json.loads(text)


@pytest.mark.parametrize("record", RECORDS)
def test_record_parsed_and_stored(spark, out_dir, record):
    assert parsed(spark, as_dict(record)) == record
    md.write_metadata(md.metadata_frame(spark, record), out_dir)
    assert md.load_metadata(spark, out_dir) == record
    assert json.loads(spark.read.text(f"{out_dir}/metadata.json").first()[0]) == as_dict(record)


@pytest.mark.parametrize("path", [("splits",), ("timeCount",), ("cellType",), ("extent",), ("extent", "ymax"), ("tileLayout", "pixelRows")])
def test_missing_key_is_an_error(spark, path):
    with pytest.raises(Exception, match=path[-1]):
        parsed(spark, without(as_dict(RECORDS[0]), *path))


def test_other_keys_are_ignored_and_counts_cut(spark):
    value = as_dict(RECORDS[0]) | {"comment": "x", "timeCount": 1000.7}
    assert parsed(spark, value).time_count == 1000


def test_equality_is_by_every_value(spark):
    frames = [md.metadata_frame(spark, r) for r in RECORDS]
    frames.append(md.metadata_frame(spark, GridMetadata(1000, (200, 100, 400, 600), RECORDS[0].extent, RECORDS[0].layout, RECORDS[0].cell_type)))
    for i, a in enumerate(frames):
        for k, b in enumerate(frames):
            assert a.select(md.metadata_equal("metadata", b.select("metadata").scalar())).first()[0] is (i == k)


def test_no_record_and_no_second_record(spark, out_dir):
    with pytest.raises(FileNotFoundError):
        md.read_metadata(spark, out_dir)
    frame = md.metadata_frame(spark, RECORDS[0])
    md.write_metadata(frame, out_dir)
    for mode in ("append", "ignore"):
        with pytest.raises(ValueError, match="one metadata record"):
            md.write_metadata(frame, out_dir, mode)


def test_cell_type_codes():
    assert [CellType(n).code for n in ("int8", "int16", "int32", "float32", "float64")] == [0, 2, 3, 4, 5]
    assert CellType.from_code(4).name == "float32"
