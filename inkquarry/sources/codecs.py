"""Stream filters of document files: Flate, LZW, ASCIIHex, ASCII85, RunLength, with predictors. Tolerant and bounded.

``decode`` returns ``(bytes, truncated)``: what could be decoded, and whether something was cut off or broken.
"""

from __future__ import annotations

import zlib

LIMIT = 256 << 20


def flate(data: bytes, limit: int = LIMIT) -> tuple[bytes, bool]:
    for wbits in (15, -15):
        d = zlib.decompressobj(wbits)
        try:
            out = d.decompress(data, limit)
            return out, not d.eof
        except zlib.error:
            # what decodes before the fault
            d, out = zlib.decompressobj(wbits), bytearray()
            try:
                for i in range(0, len(data), 256):
                    out += d.decompress(data[i : i + 256], limit - len(out) or 1)
            except zlib.error:
                pass
            if out:
                return bytes(out), True
    return b"", True


def lzw(data: bytes, early: int = 1, limit: int = LIMIT) -> tuple[bytes, bool]:
    table, width, out = [bytes([i]) for i in range(256)] + [b"", b""], 9, bytearray()
    acc = bits = 0
    last: bytes | None = None
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        while bits >= width:
            code = acc >> (bits - width) & ((1 << width) - 1)
            bits -= width
            acc &= (1 << bits) - 1
            if code == 256:
                table, width, last = table[:258], 9, None
                continue
            if code == 257:
                return bytes(out), False
            if last is None:
                entry = table[code] if code < 256 else b""
            elif code < len(table):
                entry = table[code]
                table.append(last + entry[:1])
            elif code == len(table):
                entry = last + last[:1]
                table.append(entry)
            else:
                return bytes(out), True
            out += entry
            if len(out) >= limit:
                return bytes(out[:limit]), True
            last = entry
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return bytes(out), True


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}
    size = 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            out.append(acc >> (bits - 8) & 255)
            bits -= 8
            acc &= (1 << bits) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if run + c in table:
            run += c
            continue
        put(table[run])
        table[run + c] = size
        size += 1
        if size + early > 1 << width and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        run = c
    if run:
        put(table[run])
        size += 1
        if size + early > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def ascii_hex(data: bytes) -> tuple[bytes, bool]:
    body, end, _ = data.partition(b">")
    digits = bytes(c for c in body if c in b"0123456789abcdefABCDEF")
    bad = any(c not in b"0123456789abcdefABCDEF \t\r\n\f\0" for c in body)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), bad or not end


def ascii85(data: bytes) -> tuple[bytes, bool]:
    body = data[2:] if data[:2] == b"<~" else data
    body, end, _ = body.partition(b"~")
    out, group = bytearray(), []
    for c in body:
        if c in b" \t\r\n\f\0":
            continue
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                v = 0
                for d in group:
                    v = v * 85 + d
                if v >> 32:
                    return bytes(out), True
                out += v.to_bytes(4, "big")
                group = []
        else:
            return bytes(out), True
    if len(group) > 1:
        n = len(group)
        v = 0
        for d in group + [84] * (5 - n):
            v = v * 85 + d
        out += (v & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out), not end


def run_length(data: bytes, limit: int = LIMIT) -> tuple[bytes, bool]:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n == 128:
            return bytes(out), False
        if n < 128:
            part = data[i + 1 : i + 2 + n]
            out += part
            if len(part) < n + 1:
                return bytes(out), True
            i += n + 2
        else:
            if i + 1 >= len(data):
                break
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) >= limit:
            return bytes(out[:limit]), True
    return bytes(out), True


def run_length_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            while n < 128 and i + n < len(data) and (i + n + 1 >= len(data) or data[i + n] != data[i + n + 1]):
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out + b"\x80")


def ascii85_encode(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        v = int.from_bytes(part.ljust(4, b"\0"), "big")
        if v == 0 and len(part) == 4:
            out += b"z"
            continue
        digits = []
        for _ in range(5):
            v, d = divmod(v, 85)
            digits.append(d + 0x21)
        out += bytes(digits[::-1][: len(part) + 1])
    return bytes(out + b"~>")


def predict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> tuple[bytes, bool]:
    """Undoes the predictor of a Flate or LZW stream: 2 is horizontal difference, 10 to 15 carry a tag for each row."""
    if predictor < 2:
        return data, False
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        out = bytearray(data)
        if bits == 8:
            for r in range(0, len(out), width):
                for i in range(r + step, min(r + width, len(out))):
                    out[i] = (out[i] + out[i - step]) & 255
        return bytes(out), len(data) % width != 0
    out, above = bytearray(), bytearray(width)
    for r in range(0, len(data), width + 1):
        tag, row = data[r], bytearray(data[r + 1 : r + 1 + width])
        for i in range(len(row)):
            a = row[i - step] if i >= step else 0
            b = above[i]
            c = above[i - step] if i >= step else 0
            if tag == 1:
                add = a
            elif tag == 2:
                add = b
            elif tag == 3:
                add = (a + b) // 2
            elif tag == 4:
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
                add = near[2]
            else:
                add = 0
            row[i] = (row[i] + add) & 255
        out += row
        above = row.ljust(width, b"\0")
    return bytes(out), len(data) % (width + 1) != 0


_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode"}
#: Image codecs are handed on as they are.
PASSED = ("DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode", "Crypt")


def decode(data: bytes, filters: list[str], parms: list[dict] | None = None) -> tuple[bytes, bool]:
    truncated = False
    for i, f in enumerate(filters):
        f = _SHORT.get(f, f)
        p = (parms[i] if parms and i < len(parms) else None) or {}
        if f == "FlateDecode":
            data, bad = flate(data)
        elif f == "LZWDecode":
            data, bad = lzw(data, int(p.get("EarlyChange", 1)))
        elif f == "ASCIIHexDecode":
            data, bad = ascii_hex(data)
        elif f == "ASCII85Decode":
            data, bad = ascii85(data)
        elif f == "RunLengthDecode":
            data, bad = run_length(data)
        else:
            return data, truncated or f not in PASSED
        truncated |= bad
        if f in ("FlateDecode", "LZWDecode") and int(p.get("Predictor", 1)) > 1:
            data, bad = predict(data, int(p["Predictor"]), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8)), int(p.get("Columns", 1)))
            truncated |= bad
    return data, truncated


def encode(data: bytes, filters: list[str]) -> bytes:
    for f in reversed([_SHORT.get(f, f) for f in filters]):
        data = {"FlateDecode": zlib.compress, "LZWDecode": lzw_encode, "ASCIIHexDecode": lambda d: d.hex().upper().encode() + b">", "ASCII85Decode": ascii85_encode, "RunLengthDecode": run_length_encode}[f](data)
    return data
