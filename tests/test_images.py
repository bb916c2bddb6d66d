import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quire.catalog import image_files
from quire.operators import images
from quire.rules import DEFAULT
from quire.sources.binary_files import write_files
from quire.sources.pages import folders_for, read_image_folders, read_images


def png(width, height):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    rows = b"".join(b"\0" + b"\x80\x80\x80" * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def webp(kind, width, height):
    if kind == b"VP8 ":
        body = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height)
    elif kind == b"VP8L":
        body = b"\x2f" + struct.pack("<I", width - 1 | height - 1 << 14)
    else:
        body = b"\0\0\0\0" + struct.pack("<I", width - 1)[:3] + struct.pack("<I", height - 1)[:3]
    return b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(body)) + body


def test_image_files(spark, tmp_path):
    files = {"a.png": png(49, 60), "b.png": png(50, 50), "c.png": png(200, 20), "d.png": b"garbage", "e.webp": webp(b"VP8 ", 64, 70), "f.webp": webp(b"VP8L", 300, 49), "g.webp": webp(b"VP8X", 70_000, 51)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in read_images(spark, str(tmp_path)).collect()}
    assert found == {"a.png": (49, 60), "b.png": (50, 50), "c.png": (200, 20), "e.webp": (64, 70), "f.webp": (300, 49), "g.webp": (70_000, 51)}
    large = images.usable_images(read_images(spark, str(tmp_path))).select("path").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in large) == ["b.png", "e.webp", "g.webp"]


HTML = """<p><img src="pic.gif" alt="chart"><img><img src=""><IMG SRC='http://o.example/x.PNG'><img src="spacer.gif">
<img src="pic.gif"><img src="nav.gif" alt="Home"></p>"""


def test_references_and_rewriting(spark):
    pages = spark.createDataFrame([(1, "http://s.example/d/", HTML), (2, "http://s.example/d/", HTML)], "page_id bigint, url string, html string")
    refs = images.image_refs(pages)
    first = [r.url for r in refs.filter("page_id = 1").orderBy("pos").collect()]
    pic, other = "http://s.example/d/pic.gif", "http://o.example/x.PNG"
    assert first == [pic, other, "http://s.example/d/spacer.gif", pic]
    assert {r.url for r in images.wanted_urls(refs).collect()} == {pic, other}
    sizes = spark.createDataFrame([(pic, 60, 60), (other, 10, 90)], "url string, width int, height int")
    shown = images.document_images(refs, sizes)
    assert [(r.page_id, r.url, r.media_type) for r in shown.orderBy("page_id").collect()] == [(1, pic, "image/gif"), (2, pic, "image/gif")]
    spine = spark.createDataFrame([("c", 2, 1), ("c", 1, 2)], "collection string, ordinal bigint, doc_id bigint")
    once = images.collection_images(shown.withColumnRenamed("page_id", "doc_id"), spine).collect()
    assert [(r.ordinal, r.doc_id) for r in once] == [(1, 2)]
    rewritten = images.with_rewritten_refs(pages, shown, refs).filter("page_id = 1").first().html
    name = once[0].file_name
    assert rewritten == f'<p><img src="images/{name}" alt="chart">\n<img src="images/{name}"></p>'


def test_base64(spark):
    df = spark.createDataFrame([(bytes(range(256)),)], "data binary")
    coded = images.to_base64(df)
    assert "\n" not in coded.first().data
    assert bytes(images.from_base64(coded).first().data) == bytes(range(256))


def test_navigation_images(spark):
    df = spark.createDataFrame([("/x/HOME.gif", None), ("q.gif", "RSS feed"), ("q.gif", None)], "s string, a string")
    flags = df.select(images.is_navigation_image(F.col("s"), F.col("a"), DEFAULT).alias("f")).collect()
    assert [r.f for r in flags] == [True, True, False]


def test_binary_files_are_put_down_by_tasks(spark, tmp_path):
    rows = [(f"{i}.bin", bytes([i]) * (i + 1)) for i in range(40)] + [(None, b"x"), ("none.bin", None), ("7.bin", b"\7" * 8)]
    df = spark.createDataFrame(rows, "name string, data binary").repartition(5)
    for _ in range(2):  # a repeated job writes the same files
        write_files(df, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names == sorted(["_SUCCESS", *[f"{i}.bin" for i in range(40)]])
    read = spark.read.format("binaryFile").load(str(tmp_path / "out")).select("path", "content").collect()
    assert {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in read} == {n: d for n, d in rows if n and d is not None}
    write_files(df.limit(0), f"file://{tmp_path}/empty")
    assert [p.name for p in (tmp_path / "empty").iterdir()] == ["_SUCCESS"]


@pytest.mark.parametrize("name", ["../up", ".hidden", "_meta"])
def test_binary_files_need_plain_names(spark, tmp_path, name):
    with pytest.raises(Exception, match="not the name of a data file"):
        write_files(spark.createDataFrame([(name, b"x")], "name string, data binary"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def test_written_images_are_read_back(spark, tmp_path):
    sizes = [(k, w, h) for k in image_files.KINDS for w, h in ((1, 1), (2, 3), (50, 51), (300, 49), (255, 256))]
    df = spark.createDataFrame([(f"{w}x{h}.{k if k != 'bad' else 'jpg'}", k, w, h) for k, w, h in sizes], "name string, kind string, width int, height int")
    write_files(df.mapInPandas(image_files.encode, "name string, data binary"), str(tmp_path / "out"))
    found = read_images(spark, str(tmp_path / "out")).select("path", "suffix", "width", "height").collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.suffix[1:], r.width, r.height) for r in found) == sorted(
        (f"{w}x{h}.{k}", k, w, h) for k, w, h in sizes if k != "bad"
    )


def test_folders_are_listed_one_at_a_time(spark, tmp_path, monkeypatch):
    """1,300 files in 13 folders: no listing has more than a folder's share, and all are read."""
    from quire.sources import pages

    monkeypatch.setattr(pages, "FILES_A_FOLDER", 100)
    sizes = [(f"{i}.{image_files.KINDS[i % 4] if i % 4 < 3 else 'jpg'}", image_files.KINDS[i % 4], 1 + i % 7, 2 + i % 5) for i in range(1300)]
    df = spark.createDataFrame(sizes, "name string, kind string, width int, height int").repartition(5)
    listed, plain = [], pages.read_images

    def watched(session, path):
        found = plain(session, path)
        listed.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(pages, "read_images", watched)
    folders = folders_for(len(sizes))
    write_files(df.mapInPandas(image_files.encode, "name string, data binary"), str(tmp_path / "out"), folders)
    found = read_image_folders(spark, str(tmp_path / "out"), folders, str(tmp_path / "sizes")).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.suffix[1:], r.width, r.height) for r in found) == sorted(
        (n, k, w, h) for n, k, w, h in sizes if k != "bad"
    )
    assert folders == len(listed) == 13 and max(listed) < 1300 / 4 and (tmp_path / "out" / "_SUCCESS").exists()


def test_folders_are_read_at_the_same_time_without_compiling_a_row_encoder_for_each_file(spark, tmp_path, monkeypatch):
    import threading

    from quire.sources import pages

    monkeypatch.setattr(pages, "FILES_A_FOLDER", 10)
    sizes = [(f"{i}.{image_files.KINDS[i % 4] if i % 4 < 3 else 'jpg'}", image_files.KINDS[i % 4], 1 + i, 2 + i) for i in range(40)]
    df = spark.createDataFrame(sizes, "name string, kind string, width int, height int")
    together, modes, plain = threading.Barrier(2, timeout=60), [], pages.read_images

    def watched(session, path):
        modes.append(session.conf.get("spark.sql.codegen.factoryMode"))
        together.wait()  # breaks where a folder is read after the other
        return plain(session, path)

    monkeypatch.setattr(pages, "read_images", watched)
    write_files(df.mapInPandas(image_files.encode, "name string, data binary"), str(tmp_path / "out"), 4)
    found = read_image_folders(spark, str(tmp_path / "out"), 4, str(tmp_path / "sizes")).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.width, r.height) for r in found) == sorted((n, w, h) for n, k, w, h in sizes if k != "bad")
    assert modes == ["NO_CODEGEN"] * 4 and spark.conf.get("spark.sql.codegen.factoryMode") == "FALLBACK"


def test_a_folder_that_cannot_be_read_is_an_error(spark, tmp_path):
    write_files(spark.createDataFrame([], "name string, data binary"), str(tmp_path / "out"), 1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_image_folders(spark, str(tmp_path / "out"), 3, str(tmp_path / "sizes"))


def test_gif_table_is_cleared_only_when_full(spark, tmp_path):
    """A table cleared at every second pixel takes the decoder 2 ms for 50 x 75 pixels."""
    assert len(image_files.gif(100, 150)) < 400
    for w, h in ((1, 1), (2, 1), (3, 1), (4, 1), (7, 3), (50, 75), (3000, 3000)):  # the last fills the table
        (tmp_path / f"{w}x{h}.gif").write_bytes(image_files.gif(w, h))
    rows = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).select("image.*").collect()
    assert sorted((r.width, r.height) for r in rows) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 3), (50, 75), (3000, 3000)]
    assert all(set(r.data) == {0x80} for r in rows if r.width < 100)


def test_no_files_in_a_folder(spark, tmp_path):
    write_files(spark.createDataFrame([], "name string, data binary"), str(tmp_path / "out"), folders_for(0))
    assert read_image_folders(spark, str(tmp_path / "out"), 1, str(tmp_path / "sizes")).count() == 0


def test_bytes_of_files_do_not_travel_for_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(5, 6))
    plan = read_images(spark, str(tmp_path)).drop("data")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[0]
    assert "data#" not in above and "content#" not in above
