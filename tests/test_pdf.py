"""Codecs and the document source, on files made here."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkquarry.sources import codecs, crypt, pdf


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.lists(st.sampled_from(["FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"]), max_size=3))
def test_round_trip(data, filters):
    assert codecs.decode(codecs.encode(data, filters), filters) == (data, False)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=500), st.sampled_from(["FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"]))
def test_noise_never_raises(data, f):
    out, _ = codecs.decode(data, [f])
    assert isinstance(out, bytes)


def test_long_lzw():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(60000))
    assert codecs.decode(codecs.encode(data, ["LZW"]), ["LZW"]) == (data, False)


def test_predictors():
    rows = [bytes([10, 20, 30, 40]), bytes([11, 21, 31, 41])]
    up = b"\x00" + rows[0] + b"\x02" + bytes((a - b) & 255 for a, b in zip(rows[1], rows[0], strict=True))
    assert codecs.predict(up, 12, columns=4) == (b"".join(rows), False)
    assert codecs.predict(bytes([1, 1, 1, 5, 0, 0]), 2, columns=3) == (bytes([1, 2, 3, 5, 5, 5]), False)


def make(objects: dict[int, bytes], trailer: bytes = b"<</Root 1 0 R/Info 9 0 R>>") -> bytes:
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return body + b"trailer\n" + trailer + b"\nstartxref\n0\n%%EOF\n"


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), extra, data)


CONTENT = b"BT /F1 12 Tf 10 180 Td (Page \\(one\\)) Tj 0 -14 Td [(sec) -300 (ond)] TJ ET"
FILE = {
    1: b"<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[6 0 R]>>/Outlines 20 0 R/PageLabels<</Nums[0<</S/r>>1<</S/D/P(A-)>>]>>/MarkInfo<</Marked true>>/Names<</JavaScript<</Names[(s)<</S/JavaScript/JS(app.beep\\(\\))>>]>>/EmbeddedFiles<</Names[(a.txt)<</F(a.txt)/EF<</F 30 0 R>>>>]>>>>>>",
    2: b"<</Type/Pages/Count 2/Kids[3 0 R]/MediaBox[0 0 200 300]/Rotate 90>>",
    3: b"<</Type/Pages/Kids[4 0 R 5 0 R]>>",
    4: b"<</Type/Page/Contents 10 0 R/Annots[7 0 R 8 0 R 11 0 R]/CropBox[0 0 100 100]>>",
    5: b"<</Type/Page/Contents 12 0 R/MediaBox[0 0 50 60]/Rotate 0>>",
    6: b"<</T(form)/Kids[<</T(name)/FT/Tx/V(\xfe\xff\x00A\x00\xe9)/TU(Your name)/P 4 0 R/Rect[1 2 3 4]>><</T(pick)/FT/Ch/Ff 131072/Opt[[(x)(Ex)](y)]/V(x)>>]>>",
    7: b"<</Type/Annot/Subtype/Link/Rect[1 1 2 2]/A<</S/URI/URI(http://a.example)>>>>",
    8: b"<</Type/Annot/Subtype/Link/Rect[1 1 2 2]/Dest[5 0 R/Fit]>>",
    9: b"<</Title(T#1)/Author<FEFF00E9>>>",
    10: stream(codecs.encode(CONTENT, ["FlateDecode"]), b"/Filter/FlateDecode"),
    11: b"<</Type/Annot/Subtype/Highlight/Rect[0 0 9 9]/T(Ann)/Contents(see)/QuadPoints[1 2 3 4 5 6 7 8]/NM(n1)/F 128>>",
    12: stream(b"BT (two) Tj ET"),
    20: b"<</First 21 0 R>>",
    21: b"<</Title(Top)/Dest[4 0 R/Fit]/First 22 0 R/Count 1>>",
    22: b"<</Title(Sub)/A<</S/GoTo/D[5 0 R/Fit]>>>>",
    30: stream(b"hello"),
    40: b"<</Type/Font/BaseFont/ABCDEF+Some/Subtype/TrueType/Encoding/WinAnsiEncoding>>",
}


def test_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make(FILE))
    (tmp_path / "broken.pdf").write_bytes(make(FILE)[200:900])
    (tmp_path / "empty.pdf").write_bytes(b"")
    spark.dataSource.register(pdf.PdfDataSource)

    def read(table):
        return [r.asDict() for r in spark.read.format("pdf").option("table", table).option("path", str(tmp_path)).load().where("path like '%a.pdf'").collect()]

    d = read("documents")[0]
    assert (d["title"], d["author"], d["pdf_version"], d["tagged"], d["has_javascript"], d["encrypted"], d["repairs"]) == ("T#1", "é", "1.7", True, True, False, [])
    assert [(p["page"], p["label"], p["width"], p["height"], p["rotation"], p["crop"]) for p in read("pages")] == [(1, "i", 200.0, 300.0, 90, [0.0, 0.0, 100.0, 100.0]), (2, "A-1", 50.0, 60.0, 0, None)]
    assert [t["text"] for t in read("text")] == ["Page (one)\nsec ond", "two"]
    assert [(x["kind"], x["target_page"], x["uri"]) for x in read("links")] == [("uri", None, "http://a.example"), ("page", 2, None)]
    f = {x["name"]: x for x in read("fields")}
    assert f["form.name"]["value"] == ["Aé"] and f["form.name"]["page"] == 1 and f["form.pick"]["kind"] == "combo" and f["form.pick"]["options"][0]["display_text"] == "Ex"
    assert [(x["at"], x["title"], x["page"]) for x in read("outline")] == [([0], "Top", 1), ([0, 0], "Sub", 2)]
    a = read("annotations")[0]
    assert (a["subtype"], a["author"], a["quads"], a["locked"]) == ("Highlight", "Ann", [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]], True)
    assert [(x["name"], bytes(x["content"])) for x in read("attachments")] == [("a.txt", b"hello")]
    assert [(x["subset"], x["embedded"], x["encoding"]) for x in read("fonts")] == [(True, False, "WinAnsiEncoding")]
    assert read("scripts")[0]["script"] == "app.beep()" and len(read("content_ops")) == 10 and len(read("objects")) == len(FILE) and read("revisions")[0]["n"] == 1
    every = spark.read.format("pdf").option("path", str(tmp_path)).load()
    assert every.count() == 3 and every.where("size(repairs) > 0").count() == 2


def test_object_streams_and_repairs():
    inner = {4: b"<</Type/Page/Contents 12 0 R>>", 9: b"<</Title(packed)>>"}
    heads, body = b"", b""
    for n, o in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = {k: v for k, v in FILE.items() if k not in inner} | {50: stream(codecs.encode(heads + body, ["FlateDecode"]), b"/Type/ObjStm/N 2/First %d/Filter/FlateDecode" % len(heads))}
    assert next(iter(pdf.rows("x", make(packed), "documents")))[3] == "packed"
    wrong = make(FILE | {12: b"<</Length 3>>\nstream\nBT (two) Tj ET\nendstream"})
    assert [r[2] for r in pdf.rows("x", wrong, "text")] == ["Page (one)\nsec ond", "two"]
    noroot = make(FILE, b"<<>>")
    assert len(list(pdf.rows("x", noroot, "pages"))) == 2


@pytest.mark.parametrize("seed", range(20))
def test_mutations_never_raise(seed):
    rng = random.Random(seed)
    data = bytearray(make(FILE))
    for _ in range(30):
        data[rng.randrange(len(data))] = rng.randrange(256)
    for table in pdf.SCHEMAS:
        try:
            list(pdf.rows("x", bytes(data), table))
        except (RecursionError, MemoryError):
            raise
        except Exception as e:  # noqa: BLE001 - the reader turns it into a status row
            assert table != "documents", e


def test_stream_of_files(spark, tmp_path):
    from inkquarry.streaming.files import newest, pdf_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(make(FILE))
    q = pdf_stream(spark, str(tmp_path / "in"), "pages").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and newest(spark, str(tmp_path / "in")).count() == 1


def one(data: bytes, table: str, **options) -> list[tuple]:
    return list(pdf.rows("x.pdf", data, table, **options))


def test_objects_in_streams_follow_the_order_of_the_file():
    old = make({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[]>>", 9: b"<</Title(old)>>"})
    packed = b"9 0 <</Title(new)>>"
    newer = old + b"12 0 obj\n" + stream(packed, b"/Type/ObjStm/N 1/First 4") + b"\nendobj\n%%EOF\n"
    newest = newer + b"9 0 obj\n<</Title(newest)>>\nendobj\n%%EOF\n"
    assert [one(d, "documents")[0][3] for d in (old, newer, newest)] == ["old", "new", "newest"]
    assert [one(newest, "documents", revision=r)[0][3] for r in (1, 2, 3)] == ["old", "new", "newest"]


def test_text_strings():
    assert pdf.text(b"a\x84b\xa0\x92\xe9") == "a—b€™é" and pdf.text(b"\xfe\xff\x00e\x03\x01") == "é"


def page_file(content: bytes, fonts: dict[str, bytes], extra: dict[int, bytes] | None = None, page: bytes = b"") -> bytes:
    refs = b"".join(b"/%s %d 0 R" % (k.encode(), 50 + i) for i, k in enumerate(fonts))
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R]/MediaBox[0 0 400 500]>>", 4: b"<</Type/Page/Contents 10 0 R/Resources<</Font<<" + refs + b">>/XObject<</Fx 60 0 R>>>>" + page + b">>", 10: stream(content)}
    return make(objects | {50 + i: v for i, v in enumerate(fonts.values())} | (extra or {}))


PLAIN_FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[" + b"500 " * 95 + b"]>>"


def test_glyphs_and_words():
    body = b"BT /F1 10 Tf 20 400 Td (One two) Tj 0 -14 Td [(th) -100 (ree) -600 (four)] TJ ET"
    data = page_file(body, {"F1": PLAIN_FONT})
    words = [(r[3], r[5]) for r in one(data, "words")]
    assert words == [("One", 0), ("two", 0), ("three", 1), ("four", 1)]
    glyphs = one(data, "glyphs")
    assert glyphs[0][3] == "O" and glyphs[0][4] == pytest.approx([20, 92, 25, 102]) and glyphs[3][6] is True
    # the same page turned: the view's left is the page's top
    turned = one(page_file(body, {"F1": PLAIN_FONT}, page=b"/Rotate 180"), "glyphs")
    assert {g[3] for g in turned} == {g[3] for g in glyphs} and turned[0][4][2] <= 380.1


def test_columns_forms_and_right_to_left():
    lines = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % (x, 400 - 14 * y, w) for y, ws in enumerate([(b"left one here", b"right one here"), (b"left two here", b"right two here"), (b"left three", b"right three")]) for x, w in zip((20, 200), ws, strict=True))
    words = [r[3] for r in one(page_file(lines, {"F1": PLAIN_FONT}), "words")]
    assert words == "left one here left two here left three right one here right two here right three".split()
    form = stream(b"BT /F1 10 Tf 20 40 Td (inner) Tj ET", b"/Subtype/Form/Matrix[1 0 0 1 0 100]")
    assert [r[3] for r in one(page_file(b"q 1 0 0 1 5 5 cm /Fx Do Q", {"F1": PLAIN_FONT}, {60: form}), "words")] == ["inner"]
    cmap = stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0004> <05D0> endbfrange")
    font = b"<</Type/Font/Subtype/Type0/ToUnicode 61 0 R/DescendantFonts[<</DW 600>>]>>"
    assert [r[3] for r in one(page_file(b"BT /F1 10 Tf 20 400 Td <0001000200030004> Tj ET", {"F1": font}, {61: cmap}), "words")] == ["דגבא"]
    named = b"<</Type/Font/Subtype/Type1/Encoding<</Differences[1/eacute/Scaron/uni20AC/alpha/fi]>>/FirstChar 1/Widths[500 500 500 500 500]>>"
    assert [r[3] for r in one(page_file(b"BT /F1 10 Tf 20 400 Td <0102030405> Tj ET", {"F1": named}), "words")] == ["éŠ€αfi"]


def test_structure_boxes_metadata_and_signatures():
    meta = b"<rdf:Description xmlns:pdf='p' pdf:Producer='Me &amp; you'><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>A &lt;title&gt;</rdf:li></rdf:Alt></dc:title><pdfaid:part>2</pdfaid:part></rdf:Description>"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R/Metadata 11 0 R/StructTreeRoot<</RoleMap<</Chart/Figure>>/K[12 0 R]>>/AcroForm<</Fields[<</T(sig)/FT/Sig/V<</SubFilter/adbe.pkcs7.detached/Name(Ann)/ByteRange[0 10 20 30]>>>>]>>>>",
        2: b"<</Type/Pages/Kids[4 0 R]/MediaBox[0 0 10 20]>>", 4: b"<</Type/Page/TrimBox[1 1 9 19]>>", 11: stream(meta, b"/Type/Metadata"),
        12: b"<</S/Document/Pg 4 0 R/K[<</S/Chart/Alt(a plan)/K 3>><</S/Table/A<</Summary(about)>>/K<</S/TD/A<</ColSpan 2>>/K<</Type/OBJR>>>>>>]>>",
    }
    data = make(objects)
    assert one(data, "boxes") == [("x.pdf", 1, [0, 0, 10, 20], None, None, [1, 1, 9, 19], None)]
    s = one(data, "structure")
    assert [(r[1], r[2], r[4], r[5], r[9], r[10], r[11], r[13], r[14]) for r in s] == [
        (0, None, "Document", None, 1, None, None, False, False), (1, 0, "Figure", "a plan", 1, None, None, True, False), (2, 0, "Table", None, 1, "about", None, False, False), (3, 2, "TD", None, 1, None, 2, False, True)]
    assert dict(r[1:] for r in one(data, "xmp")) == {"dc:title": "A <title>", "pdfaid:part": "2", "pdf:Producer": "Me & you"}
    assert one(data, "signatures") == [("x.pdf", "sig", True, "adbe.pkcs7.detached", "Ann", None, None, [0, 10, 20, 30], False)]
    assert one(data, "permissions") == [("x.pdf", False, True, None, None)] and one(data, "errors") == []


def locked(kind: str, user: bytes) -> bytes:
    """A file with its title and content encrypted, made by the rules of the handler."""
    file_id, p = b"0123456789abcdef", -44
    pad = lambda x: (x + crypt._PAD)[:32]
    iv = bytes(range(16))
    if kind == "aes256":
        key = bytes(range(32))
        u = crypt._hash_r6(user, b"validate", b"") + b"validate" + b"keysalt!"
        ue = crypt.cbc_encrypt(crypt._hash_r6(user, b"keysalt!", b""), key, bytes(16))
        encrypt = b"<</Filter/Standard/V 5/R 6/Length 256/P -44/O<%s>/U<%s>/OE<%s>/UE<%s>/CF<</StdCF<</CFM/AESV3>>>>/StmF/StdCF/StrF/StdCF>>" % ((b"00" * 48), u.hex().encode(), b"00" * 32, ue.hex().encode())
    else:
        owner = hashlib.md5(pad(b"owner")).digest()
        for _ in range(50):
            owner = hashlib.md5(owner).digest()
        o = pad(user)
        for i in range(20):
            o = crypt.rc4(bytes(b ^ i for b in owner), o)
        key = hashlib.md5(pad(user) + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        u = crypt.rc4(key, hashlib.md5(crypt._PAD + file_id).digest())
        for i in range(1, 20):
            u = crypt.rc4(bytes(b ^ i for b in key), u)
        form = b"/V 2/R 3" if kind == "rc4" else b"/V 4/R 4/CF<</StdCF<</CFM/AESV2>>>>/StmF/StdCF/StrF/StdCF"
        encrypt = b"<</Filter/Standard%s/Length 128/P -44/O<%s>/U<%s>>>" % (form, o.hex().encode(), (u + bytes(16)).hex().encode())

    def lock(data: bytes, num: int) -> bytes:
        if kind == "rc4":
            return crypt.rc4(hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[:16], data)
        k = key if kind == "aes256" else hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0sAlT").digest()[:16]
        n = 16 - len(data) % 16
        return iv + crypt.cbc_encrypt(k, data + bytes([n]) * n, iv)

    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R]/MediaBox[0 0 400 500]>>", 4: b"<</Type/Page/Contents 10 0 R/Resources<</Font<</F1 50 0 R>>>>>>",
        9: b"<</Title<%s>>>" % lock(b"secret", 9).hex().encode(), 10: stream(lock(b"BT /F1 10 Tf 20 400 Td (hidden words) Tj ET", 10)), 50: PLAIN_FONT, 70: encrypt,
    }
    return make(objects, b"<</Root 1 0 R/Info 9 0 R/Encrypt 70 0 R/ID[<%s><%s>]>>" % (file_id.hex().encode(), file_id.hex().encode()))


@pytest.mark.parametrize("kind", ["rc4", "aes128", "aes256"])
@pytest.mark.parametrize("user", [b"", b"open sesame"])
def test_encrypted_files(kind, user):
    data = locked(kind, user)
    opened = one(data, "documents", password=user.decode())[0]
    assert opened[3] == "secret" and opened[9] is True
    assert [r[3] for r in one(data, "words", password=user.decode())] == ["hidden", "words"]
    assert one(data, "permissions", password=user.decode())[0][1:] == (True, True, 6 if kind == "aes256" else 3 if kind == "rc4" else 4, -44)
    assert one(data, "words", password="wrong") == [] and one(data, "documents", password="wrong")[0][3] is None
    if kind != "aes256":
        assert one(data, "documents", password="owner")[0][3] == "secret"


def test_block_cipher():
    # the examples of the published standard
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = crypt.Aes(bytes(range(n)))
        assert aes.encrypt(block).hex() == want and aes.decrypt(aes.encrypt(block)) == block
    data = bytes(range(200))
    assert crypt.rc4(b"key", crypt.rc4(b"key", data)) == data
