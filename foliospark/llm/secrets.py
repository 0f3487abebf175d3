"""Secret scans with structural confirmation.

Base findings are the three patterns below. Beyond them, base64, base64url and hex characters are
decoded from wherever a key may begin, over line breaks, and reported only if the bytes have the structure
of a secret: a DER private key, encrypted or not, whose nested lengths fit exactly, an OpenSSH private key
whose fields and inner fields fit to the end, or a token whose header and claims are JSON with an algorithm,
and which is signed. What is before a key (a name and an
equals sign, 0x, a path) does not matter, and its own lengths say where it ends. PEM private key blocks,
with headers or without, are confirmed in the same way; where headers say that the body is encrypted, by
the cipher, its initial vector and whole cipher blocks. A key that is cut off is not reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: How a key may begin: SEQUENCE and its length in base64 or hex, or the OpenSSH magic.
_START = re.compile(r"M[A-P][A-Za-z0-9+/_-]{2}|b3BlbnNzaC1rZXktdjEA|30[0-9a-fA-F]{4}|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100")
_PIECE = {4: re.compile(r"[A-Za-z0-9+/_-]+"), 2: re.compile(r"[0-9a-fA-F]+")}
_BREAK = re.compile(r"[\x20\t]*(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)((?:\.[A-Za-z0-9_-]+)*)")
#: The cipher and the initial vector of a PEM block whose body is encrypted.
_DEK = re.compile(r"Proc-Type:\x20?4,ENCRYPTED\b.*?DEK-Info:\x20?[A-Z0-9-]+,([0-9A-Fa-f]{16}(?:[0-9A-Fa-f]{16})?)(?![0-9A-Fa-f])", re.S)
_HEADERS = r"(?>(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info):\x20?[^\s\\]*+|[A-Z][A-Za-z0-9-]*+:\x20(?:(?!-----)[^\r\n\\])*+))*+"
_PEM = re.compile(rf"-----BEGIN ([A-Z ]*PRIVATE KEY)-----({_HEADERS})([A-Za-z0-9+/=\s\\]{{16,}}?)-----END \1-----")


def der_length(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at at, if its length is well formed and inside b."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n > 127:
        size = n & 127
        if not 1 <= size <= 4 or at + size > len(b):
            return None
        n, at = int.from_bytes(b[at : at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= len(b) else None


def der_fields(b: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill b[start:end] exactly."""
    found = []
    while start < end:
        x = der_length(b[:end], start)
        if x is None:
            return None
        found.append(x)
        start = x[2]
    return found


def private_key(b: bytes) -> str | None:
    """The kind of private key that b encodes, if its whole structure fits."""
    if b.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(b) else None
    top = der_length(b, 0)
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return None
    fields = der_fields(b, top[1], top[2])
    if fields and [t for t, _, _ in fields] == [0x30, 0x04] and fields[1][2] > fields[1][1]:  # EncryptedPrivateKeyInfo
        inner = der_fields(b, *fields[0][1:])
        return "pkcs8-encrypted" if inner and [t for t, _, _ in inner] == [0x06, 0x30] and der_fields(b, *inner[1][1:]) else None
    if not fields or fields[0][0] != 0x02 or fields[0][2] - fields[0][1] != 1:
        return None
    tags = [t for t, _, _ in fields]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return "pkcs1"
    if tags[:3] == [0x02, 0x30, 0x04] and (inner := der_fields(b, *fields[1][1:])) and inner[0][0] == 0x06:
        return "pkcs8"
    if tags[:2] == [0x02, 0x04] and fields[1][2] - fields[1][1] in range(16, 73):
        return "sec1"
    return None


def _strings(b: bytes, at: int, n: int) -> list[bytes] | None:
    """n strings, each after its length in four bytes, that fill b from at on, or n + 1 with what is left."""
    found = []
    for _ in range(n):
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + size > len(b):
            return None
        found.append(b[at + 4 : at + 4 + size])
        at += 4 + size
    return [*found, b[at:]]


def _openssh(b: bytes) -> bool:
    """Cipher, derivation and its options, one key, the public key beginning with its kind, the private part
    in whole blocks; where there is no cipher, the private part begins with a number twice and the kind."""
    top = _strings(b, 15, 3)
    if top is None or top[3][:4] != b"\0\0\0\1" or not top[0] or not top[1]:
        return False
    keys = _strings(top[3], 4, 2)
    if keys is None or keys[2] or not keys[1] or len(keys[1]) % 8:
        return False
    public = _strings(keys[0], 0, 1)
    if public is None or not re.fullmatch(rb"[A-Za-z0-9@.-]{3,}", public[0]):
        return False
    if top[0] != b"none":
        return True
    private = _strings(keys[1], 8, 1)
    return private is not None and keys[1][:4] == keys[1][4:8] and private[0] == public[0]


def _base64(s: str) -> bytes | None:
    try:
        s = s.rstrip("=").replace("-", "+").replace("_", "/")
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(s: str) -> dict | None:
    try:
        x = json.loads(_base64(s) or b"")
        return x if isinstance(x, dict) else None
    except (ValueError, RecursionError):
        return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class _Reader:
    """Bytes of text from a position on, as base64 (4 characters for 3 bytes) or hex (2 for 1). Line
    breaks between lines of characters are passed over; no more is read than was asked for."""

    def __init__(self, text: str, at: int, base64_: bool):
        self.text, self.size, self.full = text, 4 if base64_ else 2, 3 if base64_ else 1
        self.chars, self.count, self.end, self.wrapped = [], 0, at, False

    def chars_for(self, n: int) -> int:
        return -(-n * self.size // self.full)

    def take(self, n: int) -> bytes | None:
        """The first n bytes, if the text has so many."""
        need = self.chars_for(n)
        if need - self.count > len(self.text) - self.end:
            return None
        while self.count < need:
            at = self.end
            if self.count and (gap := _BREAK.match(self.text, at)):
                at = gap.end()
            m = _PIECE[self.size].match(self.text, at, at + need - self.count)
            if m is None:
                return None
            self.wrapped = self.wrapped or at > self.end
            self.chars.append(m[0])
            self.count, self.end = self.count + len(m[0]), m.end()
        s = "".join(self.chars)[:need]
        b = bytes.fromhex(s) if self.size == 2 else _base64(s)
        return b if b and len(b) == n else None


def _der_size(r: _Reader) -> int | None:
    """The size that a DER value beginning here says it has, if a version number follows as in private keys,
    or the algorithm of an encrypted one."""
    b = r.take(2)
    if b is None or b[0] != 0x30:
        return None
    size = b[1] & 127 if b[1] > 127 else 0
    if b[1] == 128 or size > 4:
        return None
    n = b[1]
    if size:
        if (b := r.take(2 + size)) is None:
            return None
        n = int.from_bytes(b[2:], "big")
    start = 2 + size
    b = r.take(start + 2)
    if b is None or n < 3:
        return None
    return start + n if b[start] == 0x02 and (b[start + 1] == 1 or b[start + 1] > 127) or b[start] == 0x30 else None


def _openssh_size(r: _Reader) -> int | None:
    """The size of the OpenSSH private key that begins here: three strings, the number of keys, which is
    one, a public key, the private part."""
    at = 15
    for field in range(6):
        b = r.take(at + 4)
        if b is None:
            return None
        n, at = int.from_bytes(b[at:], "big"), at + 4
        if field != 3:
            at += n
        elif n != 1:
            return None
    return at


def key_at(text: str, at: int) -> tuple[str, int] | None:
    """(kind, end) of a private key that begins in text at at."""
    r = _Reader(text, at, text[at] in "Mb")
    size = _openssh_size(r) if text[at] in "b6" else _der_size(r)
    if size is None or r.chars_for(size) < 40:
        return None
    b = r.take(size)
    kind = private_key(b) if b else None
    if kind is None:
        return None
    more = _PIECE[r.size].match(text, r.end)
    if more and r.wrapped:  # lines that happen to follow a cut key seldom fit to their end
        return None
    end = r.end
    for _ in range(2 if r.size == 4 else 0):
        end += text[end : end + 1] == "="
    return kind, end


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            body = _base64(re.sub(r"\s|\\n|\\r", "", m[3]))
            cipher = _DEK.search(m[2])
            if body and (len(body) % (len(cipher[1]) // 2) == 0 if cipher else private_key(body)):
                found.append(("pem", *m.span()))
    if "eyJ" in text:
        for m in _TOKEN.finditer(text):
            head = _json(m[1])
            if head and isinstance(head.get("alg"), str) and (not m[4] and _json(m[2]) is not None or m[4].count(".") == 2 and "enc" in head):
                found.append(("jwt", *m.span()))
    at = 0
    while m := _START.search(text, at):
        key = key_at(text, m.start())
        if key is None:
            at = m.start() + 1
            continue
        kind, at = key
        if not any(b < at and m.start() < e for _, b, e in found):
            found.append((kind, m.start(), at))
    return found


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed) for each row of docs.

    A null text is empty; ids may be null or repeated; an empty table gives an empty one; other
    columns are ignored.
    """
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                text = text or ""
                base, more = base_spans(text), confirmed_spans(text)
                names = [k for k, _, _ in base]
                order = {k: i for i, k in enumerate(KINDS)}
                spans = sorted(base + more, key=lambda x: (x[1], order.get(x[0], len(order)), x[0]))
                row = (*(names.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(more))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select(id_col, text_col).mapInArrow(find, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
