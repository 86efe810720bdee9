"""Decryption of PDF files by the standard security handler, revisions 2 to 6: RC4 and AES, user or owner password.

The cipher tables are computed from their definitions (multiplicative inverse in the field of AES, affine map).
"""

from __future__ import annotations

import hashlib

_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray(len(data))
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    r = 0
    while b:
        if b & 1:
            r ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return r


def _boxes() -> tuple[list[int], list[int]]:
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x = _times(x, 3)
    box = [0] * 256
    for a in range(256):
        v = power[(255 - log[a]) % 255] if a else 0
        r = 0x63
        for s in range(5):
            r ^= ((v << s) | (v >> (8 - s))) & 255
        box[a] = r
    back = [0] * 256
    for a, b in enumerate(box):
        back[b] = a
    return box, back


_S, _INV = _boxes()
_MUL = {k: [_times(a, k) for a in range(256)] for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    def __init__(self, key: bytes) -> None:
        n = len(key) // 4
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        self.rounds, rcon = n + 6, 1
        while len(words) < 4 * (self.rounds + 1):
            t = list(words[-1])
            if len(words) % n == 0:
                t = [_S[b] for b in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and len(words) % n == 4:
                t = [_S[b] for b in t]
            words.append([a ^ b for a, b in zip(words[-n], t, strict=True)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def decrypt(self, block: bytes) -> bytes:
        m9, m11, m13, m14 = (_MUL[k] for k in (9, 11, 13, 14))
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for r in range(self.rounds - 1, -1, -1):
            s = [_INV[s[(i - 4 * (i % 4)) % 16]] ^ k for i, k in enumerate(self.keys[r])]
            if r:
                t = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    t += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
                s = t
        return bytes(s)

    def encrypt(self, block: bytes) -> bytes:
        m2, m3 = _MUL[2], _MUL[3]
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            s = [_S[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                t = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    t += [m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e]]
                s = t
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
        return bytes(s)


def cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, pad: bool = True) -> bytes:
    """Without ``iv`` it is the first block. Damaged padding is kept as it is."""
    if iv is None:
        iv, data = data[:16], data[16:]
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(aes.decrypt(block), iv, strict=True))
        iv = block
    if pad and out and 1 <= out[-1] <= 16 and out[-out[-1] :] == bytes([out[-1]]) * out[-1]:
        del out[-out[-1] :]
    return bytes(out)


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        iv = aes.encrypt(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)))
        out += iv
    return bytes(out)


def _hash_r6(password: bytes, salt: bytes, owner: bytes) -> bytes:
    k, i = hashlib.sha256(password + salt + owner).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], (password + k + owner) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """Decrypts the strings and streams of one file; ``key`` is None if the password doesn't open it."""

    def __init__(self, encrypt: dict, file_id: bytes, password: str = "") -> None:
        self.v, self.r = int(encrypt.get("V") or 0), int(encrypt.get("R") or 0)
        self.bits = int(encrypt.get("Length") or 40)
        self.o, self.u, self.oe, self.ue = (encrypt.get(k) or b"" for k in ("O", "U", "OE", "UE"))
        self.p = int(encrypt.get("P") or 0) & 0xFFFFFFFF
        self.meta = encrypt.get("EncryptMetadata") is not False
        filters = encrypt.get("CF") or {}
        self.method = {}
        for kind, name in (("stream", "StmF"), ("string", "StrF")):
            f = str(encrypt.get(name) or "Identity")
            cfm = str((filters.get(f) or {}).get("CFM") or "None") if f != "Identity" else "None"
            self.method[kind] = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes256"}.get(cfm, "none") if self.v >= 4 else "rc4"
        if self.v >= 4:
            self.bits = 128 if self.v == 4 else 256
        self.id = file_id
        self.key = self._open(password) if str(encrypt.get("Filter")) == "Standard" else None

    def _open(self, password: str) -> bytes | None:
        if self.r >= 5:
            return self._open_256(password.encode()[:127])
        pw = password.encode("latin-1", "replace")
        for user in (pw, self._user_from_owner(pw)):
            key = self._key(user)
            if self._check(key):
                return key
        return None

    def _key(self, password: bytes) -> bytes:
        n = self.bits // 8 if self.r >= 3 else 5
        h = hashlib.md5((password + _PAD)[:32] + self.o[:32] + self.p.to_bytes(4, "little") + self.id + (b"\xff\xff\xff\xff" if self.r >= 4 and not self.meta else b""))
        d = h.digest()
        for _ in range(50 if self.r >= 3 else 0):
            d = hashlib.md5(d[:n]).digest()
        return d[:n]

    def _check(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, _PAD) == self.u[:32]
        x = rc4(key, hashlib.md5(_PAD + self.id).digest())
        for i in range(1, 20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x[:16] == self.u[:16]

    def _user_from_owner(self, password: bytes) -> bytes:
        n = self.bits // 8 if self.r >= 3 else 5
        d = hashlib.md5((password + _PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            d = hashlib.md5(d).digest()
        x = self.o[:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            x = rc4(bytes(b ^ i for b in d[:n]), x)
        # the user password, padded: padding again changes nothing
        return x

    def _open_256(self, password: bytes) -> bytes | None:
        for text, wrapped, owner in ((self.u, self.ue, b""), (self.o, self.oe, self.u[:48])):
            hashed = (lambda salt: _hash_r6(password, salt, owner)) if self.r >= 6 else (lambda salt: hashlib.sha256(password + salt + owner).digest())  # noqa: B023
            if hashed(text[32:40]) == text[:32]:
                return cbc_decrypt(hashed(text[40:48]), wrapped[:32], bytes(16), pad=False)
        return None

    def decrypt(self, data: bytes, num: int, gen: int, kind: str) -> bytes:
        method = self.method[kind]
        if self.key is None or method == "none":
            return data
        if method == "aes256":
            return cbc_decrypt(self.key, data) if len(data) >= 16 else b""
        salt = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if method == "aes" else b"")
        key = hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]
        if method == "aes":
            return cbc_decrypt(key, data) if len(data) >= 16 else b""
        return rc4(key, data)
