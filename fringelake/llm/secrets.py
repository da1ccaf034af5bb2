"""Secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy from the left: the maximal runs of 32 and more
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
HEADER = re.compile(r"\s*([A-Za-z][A-Za-z0-9-]*):\x20*([^\n]*)\n")
BREAK = re.compile(r"(?:\s|\\[rnt])+")
#: Where the base64 of a DER sequence or of an OpenSSH key can begin, and its characters.
START = re.compile(r"M[A-I](?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjEA")
CODE = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!-))+")
#: Elements in one sequence of a key at most: the ten of an RSA key of many primes.
MOST = 10
#: A sequence in hex whose first element is the version 0 or 1.
HEX_START = re.compile(r"30(?:82[0-9a-f]{4}|81[0-9a-f]{2}|[0-7][0-9a-f])0201(?:00|01)", re.I)
HEX_RUN = re.compile(r"[0-9a-f]+", re.I)
#: Three parts, of which the first begins as the base64 of a brace does, or of white space, which may come before it.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Order of kinds that start at one place; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")


def decoded(coded: str) -> bytes | None:
    """The bytes of a base64 text, of either alphabet; None if it isn't one."""
    body = coded.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(b: bytes | Coded, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the element at `at`, if its length is well formed and fits before end."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or b[at] == 0:
            return None
        n, at = int.from_bytes(b[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


class Coded:
    """The bytes that a text stands for, decoded where they are read: so a length that is claimed costs nothing."""

    def __init__(self, text: str, at: int, size: int | None = None, hexadecimal: bool = False):
        self.text, self.at, self.hexadecimal = text, at, hexadecimal
        self.size = (len(text) - at) * (2 if hexadecimal else 3) // 4 if size is None else size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i):
        if not isinstance(i, slice):
            return self[i : i + 1][0]
        start, stop, _ = i.indices(self.size)
        if self.hexadecimal:
            return bytes.fromhex(self.text[self.at + 2 * start : self.at + 2 * stop])
        first, last = start // 3 * 4, -(-stop * 4 // 3)
        part = self.text[self.at + first : self.at + last]
        return base64.b64decode(part + "=" * (-len(part) % 4))[start % 3 : start % 3 + stop - start]

    def startswith(self, head: bytes) -> bool:
        return self[: len(head)] == head


def _elements(b: bytes | Coded, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill b[at:end] exactly; None if they don't, or if they are more than any key has."""
    out = []
    while at < end:
        if len(out) == MOST or (e := _element(b, at, end)) is None:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(b: bytes | Coded | None) -> bool:
    """A private key in DER: an outer sequence that fills the bytes, and in it a small version, then either the integers of
    an RSA or DSA key, an elliptic key's octets, or an algorithm identifier followed by octets (PKCS #8). Or the encrypted
    form of PKCS #8: an algorithm identifier with parameters and octets, and nothing else."""
    if not b or b[0] != 0x30 or not (top := _element(b, 0, len(b))) or top[2] != len(b):
        return False
    parts = _elements(b, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]

    def algorithm(part) -> list | None:
        inner = _elements(b, part[1], part[2]) if part[0] == 0x30 else None
        return inner if inner and inner[0][0] == 0x06 and inner[0][2] > inner[0][1] else None

    if tags == [0x30, 0x04]:
        inner = algorithm(parts[0])
        return bool(inner) and len(inner) == 2 and inner[1][0] == 0x30 and _elements(b, inner[1][1], inner[1][2]) is not None and parts[1][2] - parts[1][1] >= 16
    if len(parts) < 3 or tags[0] != 2 or parts[0][2] - parts[0][1] != 1 or b[parts[0][1]] > 1:
        return False
    if all(t == 2 for t in tags):
        return len(tags) in (6, 9)  # DSA, RSA
    if tags[1] == 0x04:
        return tags[2] in (0xA0, 0xA1) and parts[1][2] - parts[1][1] >= 16  # elliptic
    return bool(algorithm(parts[1])) and tags[2] == 0x04  # PKCS #8


def ssh_key_size(b: bytes | Coded | None) -> int:
    """The bytes of a private key in OpenSSH's format at the beginning of b: its magic, three strings, the number of keys, as
    many public keys, each of which begins with the name of its kind, and the private part, whose size is a multiple of
    eight; 0 if the nested lengths do not fit."""
    magic = b"openssh-key-v1\0"
    if not b or not b.startswith(magic):
        return 0
    at = len(magic)

    def skipped(at: int) -> int:
        end = at + 4 + int.from_bytes(b[at : at + 4], "big") if at + 4 <= len(b) else len(b) + 1
        return end if end <= len(b) else -1

    for _ in range(3):
        if (at := skipped(at)) < 0:
            return 0
    keys, at = int.from_bytes(b[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys):
        end = skipped(at)
        name = skipped(at + 4)
        if end < 0 or not at + 8 < name <= end:
            return 0
        at = end
    end = skipped(at)
    return end if end > at + 4 and (end - at - 4) % 8 == 0 else 0


def _header_size(b: bytes) -> int:
    """The bytes of the sequence that begins like b does, if it then has a version or an algorithm identifier; else 0."""
    n, at = b[1], 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 3 or len(b) < 2 + size + 3:
            return 0
        n, at = int.from_bytes(b[2 : 2 + size], "big"), 2 + size
    if b[at] == 0x02 and b[at + 1] == 1 and b[at + 2] <= 1 or b[at] == 0x30:
        return at + n
    return 0


class Stretch:
    """The base64 characters from a place of a text on, over line breaks, also escaped ones, put together once for all keys that may
    begin in them."""

    def __init__(self, text: str, at: int):
        parts, self.starts, self.places, size = [], [], [], 0
        self.end = at
        while m := CODE.match(text, at):
            parts.append(m[0])
            self.starts.append(size)
            self.places.append(m.start())
            size += len(m[0])
            self.end = m.end()
            gap = BREAK.match(text, m.end())
            if gap is None:
                break
            at = gap.end()
        self.code = "".join(parts).replace("-", "+").replace("_", "/")

    def offset(self, place: int) -> int:
        i = bisect.bisect_right(self.places, place) - 1
        return self.starts[i] + place - self.places[i]

    def place_after(self, offset: int) -> int:
        """Where in the text the characters before the offset end."""
        i = bisect.bisect_left(self.starts, offset) - 1
        return self.places[i] + offset - self.starts[i]


def _padded(text: str, end: int) -> int:
    """The end with the padding that follows."""
    while text.startswith("=", end) and end < len(text):
        end += 1
    return end


def is_pem_key(body: str) -> bool:
    """What stands between the marks: base64 of a key in DER or in OpenSSH's format; or with the headers of the old encrypted
    form, whose cipher, initial value and number of bytes must fit. Line breaks may be escaped."""
    body = body.replace("\\r", "").replace("\\n", "\n").lstrip()
    headers, at = {}, 0
    while m := HEADER.match(body, at):
        headers[m[1].lower()] = m[2].strip()
        at = m.end()
    b = decoded("".join(body[at:].split()))
    if headers.get("proc-type", "").replace(" ", "") == "4,ENCRYPTED":
        cipher, _, start = headers.get("dek-info", "").partition(",")
        block = 16 if cipher.startswith("AES") else 8
        return bool(b) and bool(cipher) and len(b) % block == 0 and len(start.strip()) == 2 * block and HEX_RUN.fullmatch(start.strip()) is not None
    return is_der_key(b) or bool(b) and ssh_key_size(b) == len(b)


def is_signed_token(head: str, body: str) -> bool:
    """A JSON Web Token: the header is a JSON object with a string alg, the payload decodes."""
    try:
        header = json.loads(decoded(head) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and decoded(body) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if KEYWORD.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decodes to a key or token: only candidates whose structure parses are reported."""
    out = []
    if "-----BEGIN " in text:
        began = None
        for m in MARK.finditer(text):
            if m[1] == "BEGIN":
                began = m
            elif began is not None and began[2] == m[2]:
                if is_pem_key(text[began.end() : m.start()]):
                    out.append(("pem", began.start(), m.end()))
                began = None
    if "." in text:
        out += [("jwt", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    upto, inside = 0, iter(sorted((s, e) for k, s, e in out if k == "pem"))
    around = next(inside, None)
    stretch = None
    for m in START.finditer(text):
        while around and around[1] <= m.start():
            around = next(inside, None)
        if m.start() < upto or around and around[0] <= m.start():
            continue
        if stretch is None or m.start() >= stretch.end:
            stretch = Stretch(text, m.start())
        at = stretch.offset(m.start())
        n = 0
        if m[0][0] == "M":
            head = decoded(stretch.code[at : at + 12])
            n = _header_size(head) if head else 0
            n = n if n >= 30 and -(-n * 4 // 3) <= len(stretch.code) - at and is_der_key(Coded(stretch.code, at, n)) else 0
        else:
            n = ssh_key_size(Coded(stretch.code, at))
        if n:
            upto = _padded(text, stretch.place_after(at + -(-n * 4 // 3)))
            out.append(("der" if m[0][0] == "M" else "ssh", m.start(), upto))
    upto, run_end = 0, 0
    for m in HEX_START.finditer(text) if "0201" in text else ():
        if m.start() < upto:
            continue
        if m.start() >= run_end:
            run_end = HEX_RUN.match(text, m.start()).end()
        n = _header_size(bytes.fromhex(m[0]) + b"\0\0\0")
        if n >= 30 and m.start() + 2 * n <= run_end and is_der_key(Coded(text, m.start(), n, True)):
            upto = m.start() + 2 * n
            out.append(("der", m.start(), upto))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, spans (array of kind, start, end in code points, end exclusive, in
    order) and base (the same, base kinds only), both as text too. Null and empty texts have none. Rows are judged one by
    one, so repeated rows come out as often as they are there; an empty table gives an empty result; other columns are
    ignored."""

    def run(batches):
        for b in batches:
            base, spans, counts = [], [], {k: [] for k in KINDS[:3]}
            for text in b.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append(_joined(own))
                spans.append(_joined(own + confirmed_spans(text)))
                for k, n in counts.items():
                    n.append(sum(x[0] == k for x in own))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
