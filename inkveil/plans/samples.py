"""Small files of the older office formats, made from their published descriptions, for queries and tests."""

from __future__ import annotations

import struct
import zlib

from inkveil.sources.compound import compound

CARD, MAIL, PHONE = "4111 1111 1111 1111", "a.b@c.kr", "010-1234-5678"


def record(kind: int, payload: bytes) -> bytes:
    return struct.pack("<HH", kind, len(payload)) + payload


def _wide(text: str) -> bytes:
    return text.encode("utf-16le")


def doc(pieces: list[tuple[str, str]], series: list[str] = (), flags: int = 0x0200) -> bytes:
    """Pieces of (codec, text); series of a chart inside."""
    main = bytearray(0x400)
    places, ends = [], [0]
    for codec, text in pieces:
        raw = text.encode(codec)
        at = len(main)
        main += raw + b"\0" * (len(raw) % 2)
        places.append((at * 2) | 0x40000000 if codec == "cp1252" else at)
        ends.append(ends[-1] + len(text))
    plc = struct.pack(f"<{len(ends)}I", *ends) + b"".join(struct.pack("<HIH", 0, fc, 0) for fc in places)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, flags)
    struct.pack_into("<II", main, 0x1A2, 16, len(clx))
    streams = {"WordDocument": bytes(main), "1Table": bytes(16) + clx}
    if series:
        streams["ObjectPool/_1/Workbook"] = record(0x809, bytes(16)) + b"".join(record(0x100D, b"\0\0" + struct.pack("<BB", len(t), 1) + _wide(t)) for t in series) + record(0x0A, b"")
    return compound(streams)


def xls(strings: list[str], cells: list[tuple[int, int, int]], numbers: list[tuple[int, int, float]], header: str, box: str, name: str = "Sheet") -> bytes:
    """Shared strings, of which the last goes on in another record, in characters of the other width; cells (row, col, string)."""
    head = struct.pack("<II", len(cells), len(strings))
    body = b"".join(struct.pack("<HB", len(t), 1) + _wide(t) for t in strings[:-1])
    last, cut = strings[-1], len(strings[-1]) // 2
    shared = record(0xFC, head + body + struct.pack("<HBH", len(last), 9, 1) + _wide(last[:cut])) + record(0x3C, b"\x00" + last[cut:].encode("latin-1") + bytes(4))
    start = record(0x809, struct.pack("<HH", 0x600, 5) + bytes(12))
    sheet = record(0x809, struct.pack("<HH", 0x600, 0x10) + bytes(12))
    sheet += record(0x14, struct.pack("<HB", len(header), 0) + header.encode("latin-1"))
    sheet += b"".join(record(0xFD, struct.pack("<HHHI", r, c, 0, k)) for r, c, k in cells)
    sheet += b"".join(record(0x203, struct.pack("<HHHd", r, c, 0, v)) for r, c, v in numbers)
    sheet += record(0xBD, struct.pack("<HH", 9, 0) + struct.pack("<HI", 0, (7 << 2) | 2) + struct.pack("<HI", 0, (150 << 2) | 3) + struct.pack("<H", 1))
    sheet += record(0x1B6, bytes(10) + struct.pack("<HH", len(box), 16) + bytes(4)) + record(0x3C, b"\x01" + _wide(box)) + record(0x3C, bytes(16)) + record(0x0A, b"")
    bound = lambda at: record(0x85, struct.pack("<IHBB", at, 0, len(name), 1) + _wide(name))
    at = len(start) + len(bound(0)) + len(shared) + len(record(0x0A, b""))
    return compound({"Workbook": start + bound(at) + shared + record(0x0A, b"") + sheet})


def ppt(atoms: list[tuple[int, bytes]]) -> bytes:
    inner = b"".join(struct.pack("<HHI", 0, kind, len(data)) + data for kind, data in atoms)
    slide = struct.pack("<HHI", 0x0F, 0x03EE, len(inner)) + inner
    return compound({"PowerPoint Document": slide, "Current User": b"x" * 20})


def hwp(paragraphs: list[str], flags: int = 1, preview: str = "") -> bytes:
    """Paragraphs, the last one and long ones with their size in a number of its own."""
    body = b""
    for k, text in enumerate(paragraphs):
        raw = _wide(text)
        body += struct.pack("<I", 66) + (struct.pack("<II", 67 | (1 << 10) | (0xFFF << 20), len(raw)) if k == len(paragraphs) - 1 or len(raw) >= 0xFFF else struct.pack("<I", 67 | (1 << 10) | (len(raw) << 20))) + raw
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = pack.compress(body) + pack.flush() if flags & 1 else body
    return compound({"FileHeader": b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", flags) + bytes(216), "BodyText/Section0": data, "PrvText": _wide(preview), "PrvImage": b"GIF89a" + bytes(30)})


def of_name(name: str) -> dict[str, bytes]:
    """A file of each kind that tells a name, a card, an address and a telephone number."""
    return {
        "doc": doc([("cp1252", f"{name}  a\r"), ("utf-16le", f"한글 {CARD}\rmail {MAIL}")], [f"Title {PHONE}"]),
        "xls": xls([name, "한글 " + MAIL, f"no {CARD} x"], [(0, 0, 0), (1, 2, 1), (2, 1, 2), (3, 1, 2)], [(0, 3, 12.0), (4, 0, 0.5)], f"&C{PHONE}", f"box {MAIL}"),
        "ppt": ppt([(0x0FA0, _wide(f"{name}\r마스터 텍스트 스타일을 편집합니다\r{CARD}")), (0x0FA8, f"한글 {PHONE}".encode("cp949")), (0x0FA9, b"zz")]),
        "hwp": hwp([f"{name}\x02漢 a", f"카드 {CARD}\r", f"{MAIL} 끝"], preview=f"{name} {CARD}"),
    }


def pdf(pages: list[list[tuple[float, float, str]]], packed: bool = True) -> bytes:
    """Pages of (x, y from below, text) in ten points: ASCII texts in a simple font, half as wide as high, others by 16-bit codes
    with a map to Unicode; the last text of a page stands in a form."""
    objects: list[bytes] = []

    def put(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(info: bytes, data: bytes) -> int:
        data = zlib.compress(data) if packed else data
        return put(b"<<" + info + (b"/Filter/FlateDecode" if packed else b"") + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream")

    used = sorted({c for page in pages for _, _, t in page for c in t if not c.isascii()} | set(" 0123456789"))
    code = {c: k + 1 for k, c in enumerate(used)}
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n" % len(used) + b"".join(b"<%04X> <%s>\n" % (k, c.encode("utf-16be").hex().encode()) for c, k in code.items()) + b"endbfchar"
    unicode_map = stream(b"", table)
    simple = put(b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding/FirstChar 32/LastChar 126/Widths[" + b"500 " * 95 + b"]>>")
    under = put(b"<</Type/Font/Subtype/CIDFontType2/BaseFont/X/DW 500>>")
    wide = put(b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H/DescendantFonts[%d 0 R]/ToUnicode %d 0 R>>" % (under, unicode_map))
    fonts = b"/Font<</F1 %d 0 R/F2 %d 0 R>>" % (simple, wide)

    def shown(x: float, y: float, text: str) -> bytes:
        if text.isascii():
            half = len(text) // 2
            escape = lambda t: t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode()
            return b"BT /F1 10 Tf 1 0 0 1 %g %g Tm [(%s) 0 (%s)] TJ ET\n" % (x, y, escape(text[:half]), escape(text[half:]))
        return b"BT /F2 10 Tf %g %g Td <%s> Tj ET\n" % (x, y, b"".join(b"%04X" % code[c] for c in text))

    kids = []
    parent = len(objects) + 1 + 3 * len(pages)
    for texts in pages:
        form = stream(b"/Type/XObject/Subtype/Form/BBox[0 0 600 800]/Resources<<%s>>" % fonts, shown(*texts[-1]))
        content = stream(b"", b"".join(shown(*t) for t in texts[:-1]) + b"q 1 0 0 1 0 0 cm /X1 Do Q\n")
        kids.append(put(b"<</Type/Page/Parent %d 0 R/Contents %d 0 R/Resources<<%s/XObject<</X1 %d 0 R>>>>>>" % (parent, content, fonts, form)))
    put(b"<</Type/Pages/MediaBox[0 0 600 800]/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids)))
    root = put(b"<</Type/Catalog/Pages %d 0 R>>" % parent)
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(objects))
    return body + b"trailer\n<</Root %d 0 R/Size %d>>\nstartxref\n0\n%%%%EOF\n" % (root, len(objects) + 1)


def pdf_of_name(name: str) -> bytes:
    """Two pages that tell what the other samples do."""
    return pdf([[(50, 700, f"{name} (a)"), (50, 680, f"card {CARD}"), (50, 660, "한글 123")], [(50, 700, f"mail {MAIL} end"), (150, 640, "끝"), (50, 640, f"tel {PHONE}")]])
