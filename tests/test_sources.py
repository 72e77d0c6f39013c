"""Files: what they hold, what damage does, and that nothing masked is left in them."""

import io
import os
import random
import zipfile

import pytest

from inkveil.plans import samples
from inkveil.plans.samples import CARD, MAIL, PHONE
from inkveil.sources import files, legacy, packages, pdf, pictures, raster, xml
from inkveil.sources.compound import Broken, Compound, compound

FILE = "path string, ext string, content binary"


def rows(spark, *files_):
    return spark.createDataFrame([(f"/{k}.{ext}", ext, bytearray(content) if content is not None else None) for k, (ext, content) in enumerate(files_)], FILE)


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


# --- packages ---------------------------------------------------------------------------------------------------------------


def test_encodings():
    assert packages.decoded(b"\xef\xbb\xbfa\xc3\xa9") == ("UTF-8", "aé")
    assert packages.decoded("﻿é".encode("utf-16le")) == ("UTF-16LE", "é")
    assert packages.decoded("<?xml encoding='euc-kr'?>한".encode("euc-kr")) == ("EUC-KR", "<?xml encoding='euc-kr'?>한")
    assert packages.decoded(b"<?xml encoding='none-such'?>\xffa")[1].endswith("a")
    assert packages.decoded(b"a\xff\xfeb") == ("UTF-8", "ab") and packages.decoded(b"") == ("UTF-8", "")
    for name, raw in (("UTF-16LE", "﻿<a>é</a>".encode("utf-16le")), ("EUC-KR", "<?xml encoding='euc-kr'?>한".encode("euc-kr"))):
        assert packages.encoded(packages.decoded(raw)[1], name, raw) == raw


def test_damaged_packages(spark, monkeypatch):
    good = zipped({"word/document.xml": "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>", "word/a.xml": b"\xff\xfe\xfd<a>", "b.xml": ""})
    locked = bytearray(good)
    for sign, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the first member says that it is encrypted
        locked[locked.find(sign) + at] |= 1
    torn = bytearray(zipped({"word/document.xml": "<w:t>" + "abc" * 500}))
    torn[60:70] = b"\0" * 10
    odd = bytearray(good)
    odd[odd.find(b"PK\x03\x04") + 8] = odd[odd.find(b"PK\x01\x02") + 10] = 99  # no such method
    df = rows(spark, ("docx", good), ("docx", bytes(locked)), ("docx", bytes(torn)), ("docx", bytes(odd)), ("docx", good[:100]), ("docx", b""), ("docx", None), ("docx", b"PK"))
    out = packages.members(df).collect()
    by = {}
    for r in out:
        by.setdefault(int(r.path[1]), []).append(r)
    assert [r.error for r in by[0]] == [None] * 3 and by[0][1].xml is not None
    assert "encrypted" in by[1][0].error and by[1][0].data is None and by[1][1].error is None
    assert all(by[k][0].error for k in (2, 3, 4, 5, 6, 7)) and by[4][0].member is None
    done = {r.path: r for r in packages.redact_packages(df).collect()}
    assert done["/1.docx"].errors == 1 and done["/1.docx"].n_members == 2 and "/5.docx" not in done
    assert {r.path: r.text for r in packages.texts(packages.members(df)).collect()}["/0.docx"] == "x"


def test_no_entity_bombs():
    bomb = b'<!DOCTYPE a [<!ENTITY x "y"><!ENTITY z "&x;&x;">]><a>&z;</a>'
    assert xml.read_xml(bomb)[0].startswith("<!DOCTYPE") and xml.read_xml(b"\xff<a") == ("<a", "<a")
    assert xml.read_xml("<a><tbl><tr><tc><p>x</p><p>y</p></tc><tc>z&amp;</tc></tr></tbl></a>".encode())[1] == "<table>\n<tbody>\n<tr>\n<td>x<br/>y</td>\n<td>z&amp;</td>\n</tr>\n</tbody>\n</table>"


def test_masked_package_keeps_its_encoding(spark):
    raw = f"<?xml version='1.0' encoding='euc-kr'?><s><t>한글 {MAIL}</t></s>".encode("euc-kr")
    done = packages.redact_packages(rows(spark, ("hwpx", zipped({"Contents/section0.xml": raw, "Preview/PrvImage.png": b"x", "other.bin": b"y"})))).first()
    with zipfile.ZipFile(io.BytesIO(bytes(done.content))) as z:
        assert z.read("Contents/section0.xml").decode("euc-kr") == f"<?xml version='1.0' encoding='euc-kr'?><s><t>한글 {'*' * 3}@{'*' * 4}</t></s>"
        assert z.read("Preview/PrvImage.png") == packages.blank_png() and z.read("other.bin") == b"y"
    assert (done.hits, done.kept, done.modified) == (1, 1, 2)


# --- older files ------------------------------------------------------------------------------------------------------------


def test_compound_files():
    rng = random.Random(3)
    for _ in range(40):
        streams = {"/".join([rng.choice(["A", "Bb"])] * rng.randint(0, 2) + [f"s{k}"]): os.urandom(rng.choice([0, 1, 63, 64, 65, 4095, 4096, 9000])) for k in range(rng.randint(1, 20))}
        file = Compound(compound(streams))
        assert {p: file.read(p) for p in file.streams} == streams
        changes = {p: os.urandom(len(v)) for p, v in streams.items() if rng.random() < 0.5}
        again = Compound(file.written(changes))
        assert {p: again.read(p) for p in again.streams} == streams | changes
        longer = Compound(file.rebuilt({"s0": b"longer" * 999}))
        assert all(longer.read(p) == (b"longer" * 999 if p == "s0" else v) for p, v in streams.items())


@pytest.mark.parametrize("ext", ["doc", "xls", "ppt", "hwp"])
def test_hostile_bytes_end_with_an_error(spark, ext):
    """Files with bytes changed at random are read, or have a reason; none raises."""
    rng = random.Random(5)
    good = samples.of_name("Name")[ext]
    broken = []
    for _ in range(60):
        raw = bytearray(good)
        for _ in range(rng.randint(1, 12)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        broken.append((ext, bytes(raw[: rng.randint(1, len(raw))] if rng.random() < 0.3 else raw)))
    out = legacy.redact(rows(spark, *broken)).collect()
    assert len(out) == 60 and all((r.content is None) == (r.error is not None) for r in out)


def test_encrypted_files(spark):
    df = rows(spark, ("doc", samples.doc([("cp1252", "x")], flags=0x0300)), ("hwp", samples.hwp(["x"], flags=3)), ("xls", compound({"Workbook": samples.record(0x809, bytes(16)) + samples.record(0x2F, b"x" * 6)})), ("ppt", compound({"x": b"y"})))
    assert all(r.error and r.text is None for r in legacy.runs(df).collect())


def test_nothing_masked_is_left(spark):
    of = samples.of_name("Name")
    for r in legacy.redact(rows(spark, *of.items())).collect():
        raw = bytes(r.content)
        if r.ext == "hwp":
            file = Compound(raw)
            raw = b"".join(legacy.inflated(file.read(p))[0] for p in file.streams)
            assert "Name" in file.read("PrvText").decode("utf-16le") and set(file.read("PrvImage")) == {0}
        for value in (CARD, MAIL, PHONE):
            for codec in ("utf-16le", "latin-1"):
                assert value.encode(codec) not in raw, (r.ext, value)


def test_text_objects():
    assert legacy.is_text_object(3, 16) and legacy.is_text_object(1, 24)
    assert not any(legacy.is_text_object(*x) for x in ((0, 0), (3, 8), (3, 20), (0, 16)))


def test_bytes_masked():
    data = f"x {MAIL} y".encode() + f"x {MAIL} y".encode("utf-16le") + "한글 값".encode("cp949")
    out = legacy.without_addresses(data)
    assert len(out) == len(data) and b"***@****" in out and "***@****".encode("utf-16le") in out and b"a.b" not in out
    assert legacy.without_values("한글 값".encode("cp949"), ["한글"]) == b"**** " + "값".encode("cp949")
    assert legacy.section_order("BodyText/Section10") > legacy.section_order("BodyText/Section2") and legacy.section_order("x") > legacy.section_order("BodyText/Section99")


def test_hwp_that_grows_is_built_anew():
    """A section that packs worse than before doesn't fit its place; the rest of the file is as it was."""
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0xAC00, 0xD7A3)) for _ in range(3000))
    raw = samples.hwp(["a" * 4000, "끝"])
    runs = list(legacy.hangul(Compound(raw)))
    change = {"text": runs[0][4], "new": text + runs[0][4][3000:], "segments": [dict(zip(("stream", "at", "n", "codec"), s)) for s in runs[0][5]], "values": []}
    again = list(legacy.hangul(Compound(legacy.written(raw, "hwp", [change]))))
    assert again[0][4] == change["new"] and again[1][4] == "끝"


# --- PDF --------------------------------------------------------------------------------------------------------------------


def test_pdf_values():
    parse = lambda raw: pdf.Parser(raw).value()
    assert parse(rb"<</A 1/B[1 0 R (a\(b\)\051\n(c))<48>true null]/C#20D -.5>>") == {"A": 1, "B": [pdf.Ref(1), b"a(b))\n(c)", b"H", True, None], "C D": -0.5}
    assert pdf._unpredicted(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])


def test_pdf_objects_in_streams():
    import zlib

    inner = b"1 0 2 36 <</Type/Catalog/Pages 2 0 R>>           <</Type/Pages/Kids[3 0 R]/MediaBox[0 0 99 99]>>"
    first = 9
    packed = zlib.compress(inner)
    raw = b"%PDF-1.5\n9 0 obj\n<</Type/ObjStm/N 2/First " + str(first).encode() + b"/Filter/FlateDecode/Length %d>>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R>>\nendobj\n"
    document = pdf.Document(raw)
    assert [n for n, _ in document.pages()] == [3] and pdf._page_box(document, next(document.pages())[1]) == (0, 0, 99, 99)


def test_pdf_hostile_bytes(spark):
    rng = random.Random(9)
    good = samples.pdf_of_name("Name")
    broken = []
    for _ in range(60):
        raw = bytearray(good)
        for _ in range(rng.randint(1, 30)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        broken.append(("pdf", bytes(raw)))
    out = pdf.redact(rows(spark, *broken, ("pdf", b""), ("pdf", None), ("pdf", good.replace(b"/Root", b"/Encrypt 1 0 R/Root")))).collect()
    assert len(out) == 63 and all((r.content is None) == (r.error is not None) for r in out) and sum(r.error is not None for r in out) >= 3


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_leaves_no_trace(packed):
    raw = samples.pdf([[(50, 700, "keep"), (90, 700, CARD), (50, 650, "한글 123")]], packed)
    out, n = pdf.redacted(raw, [{"page": 1, "x0": 89, "y0": 90, "x1": 200, "y1": 104}, {"page": 1, "x0": 0, "y0": 140, "x1": 60, "y1": 160}])
    document = pdf.Document(out)
    (number, page), = document.pages()
    reader, _ = pdf.page_chars(document, number, page)
    assert [w[4] for w in pdf.page_words(reader.chars, pdf._page_box(document, page))] == ["keep", "123"] and n == len(CARD) + 2
    every = out + b"".join(document.content(o) for o in document.objects.values() if isinstance(o, pdf.Stream))
    assert b"4111" not in every and b"34313131" not in every


# --- any file ---------------------------------------------------------------------------------------------------------------


def test_router(spark):
    df = rows(spark, ("exe", b"x"), ("xml", b"<a>x</a>"), ("pdf", samples.pdf([[(1, 1, "t")]])), ("doc", b"no"), ("docx", b"no"))
    out = {r.ext: (r.text, r.error is not None) for r in files.texts(df).collect()}
    assert out == {"exe": (None, True), "xml": ("x", False), "pdf": ("t", False), "doc": (None, True), "docx": (None, True)}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.XML").write_bytes(b"<a>x</a>")
    (tmp_path / "y.txt").write_bytes(b"y")
    assert sorted((r.ext, bytes(r.content)) for r in files.read(spark, str(tmp_path)).collect()) == [("txt", b"y"), ("xml", b"<a>x</a>")]


def test_pictures():
    png = packages.blank_png()
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(8) + b"\1\0\x18\0" + bytes(28)
    data = b"BMxx" + png + b"\x89PNG\r\n\x1a\n" + bmp + b"GIF89a" + bytes(20) + b";\xff\xd8\xffabc\xff\xd9"
    found = pictures.carved(data)
    assert [k for k, _, _ in found] == ["png", "bmp", "gif", "jpg"] and all(pictures.kind_of(data[a : a + n]) == k for k, a, n in found)
    assert data[found[0][1] : found[0][1] + found[0][2]] == png and found[1][2] == 58


def test_broken_is_a_value_error():
    with pytest.raises(Broken):
        Compound(b"x" * 600)


def test_points_of_pictures():
    """Each way that lines of a PNG are stored, palettes, and BMP from below; a covered picture keeps no trace of its points."""
    import struct
    import zlib

    import numpy as np

    rng = np.random.default_rng(2)
    for colour, n in raster.CHANNELS.items():
        points = rng.integers(0, 256, (7, 5, n), np.uint8)
        plain = raster.write(points, {"kind": "png", "chunks": [(b"PLTE", bytes(range(1, 256)) * 3 + b"\0" * 3), (b"tEXt", b"secret")], "colour": colour})
        assert (raster.read(plain)[0] == points).all() and b"secret" not in plain
        rows = b""
        before = np.zeros(5 * n, int)
        for y in range(7):
            row, kind = points[y].reshape(-1).astype(int), y % 5
            left, corner = np.concatenate([np.zeros(n, int), row[:-n]]), np.concatenate([np.zeros(n, int), before[:-n]])
            paeth = [min(((abs(u - c), 0, a), (abs(a - c), 1, u), (abs(a + u - 2 * c), 2, c)))[2] for a, u, c in zip(left, before, corner, strict=True)]
            guess = [np.zeros(5 * n, int), left, before, (left + before) // 2, np.array(paeth)][kind]
            rows += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
            before = row
        start = plain.index(b"IDAT") - 4
        size = struct.unpack_from(">I", plain, start)[0]
        packed = zlib.compress(rows)
        filtered = plain[:start] + struct.pack(">I", len(packed)) + b"IDAT" + packed + bytes(4) + plain[start + 12 + size :]
        assert (raster.read(filtered)[0] == points).all()
        out = raster.read(raster.covered(plain, [{"x0": 1.2, "y0": 2.0, "x1": 2.9, "y1": 99.0}]))[0]
        assert len({tuple(p) for p in out[2:, 1:3].reshape(-1, n)}) == 1 and (out[:2] == points[:2]).all() and (out[:, 3:] == points[:, 3:]).all()
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + 3 * 8, 0, 54, 40, 2, 3, 1, 24, 0, 24, 0, 0, 0, 0) + bytes(range(24))
    points, how = raster.read(bmp)
    assert points.shape == (3, 2, 3) and points[0, 0].tolist() == [16, 17, 18] and raster.write(points, how)[:54] == bmp[:54]
    assert raster.read(raster.smaller(bmp, 2))[0].shape == (2, 1, 3)
    for bad in (b"", b"GIF89a", raster.PNG + b"x" * 40, bmp[:60]):
        with pytest.raises(raster.FAULTS):
            raster.read(bad)


def test_drawings_of_charts(spark):
    import struct

    text = f"tel {PHONE}".encode("utf-16le")
    record = struct.pack("<II", 0x54, 76 + len(text)) + bytes(36) + struct.pack("<II", len(text) // 2, 76) + bytes(24) + text
    raw = Compound(samples.doc([("cp1252", "x")]))
    file = compound({p: raw.read(p) for p in raw.streams} | {"ObjectPool/_1/\x03EPRINT": struct.pack("<II", 1, 8) + record})
    done = legacy.redact(rows(spark, ("doc", file))).first()
    assert done.hits == 1 and Compound(bytes(done.content)).read("ObjectPool/_1/\x03EPRINT").endswith(("*" * (len(text) // 2)).encode("utf-16le"))
