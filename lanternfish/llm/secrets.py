"""Secret scans with structural confirmation.

Plain patterns give the base spans: assignments of a secret, access key ids and long hex runs. Beside them, candidates in
base64 or hex are decoded and parsed, and reported only if what they hold has the structure of a secret:

* private_key: DER of a private key whose nested lengths add up (RSA, DSA, EC, PKCS #8, plain or encrypted), or the
  OpenSSH format; as PEM block, base64 of either alphabet (in one run, or wrapped in lines of one width) or hex;
* signed_token: three base64url parts of which the first is a JSON object with an "alg", the second a JSON object;
* encoded: base64 or hex of printable text that itself holds a secret (up to three layers).

Defined results: a null text counts as empty and gives no spans. Offsets count code points, end exclusive. Whole texts
of any length are scanned. Repeated rows give repeated results; other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

#: Kinds in the order in which spans of one start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "private_key", "signed_token", "encoded")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is every run of that length
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.DOTALL)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")  # whole runs; which alphabet is told when they are decoded
ONE_ALPHABET = re.compile(r"(?:[A-Za-z0-9+/]*|[A-Za-z0-9_-]*)\Z")
PARTS = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
LINE_END, LINE = re.compile(r"[\x20\t]*(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t>#]*"), re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
DER_START = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{6})")  # 0x30 and a length
OPENSSH, OPENSSH_START = b"openssh-key-v1\0", "b3BlbnNzaC1rZXktdj"
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")

#: What a text must hold for a pattern to be tried: searches for fixed bytes are far quicker than patterns.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN_STARTS = (b"eyJ", b"eyA", b"ewo", b"ewk", b"ew0")  # base64 of {" or { and white space
_HEX_RUN = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_ANY_HEX_RUN = bytes(0x68 if chr(c) in "0123456789abcdefABCDEF" else 0x20 for c in range(256))
_BASE64_RUN = bytes(0x62 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 0x20 for c in range(256))

LAYERS = 3
#: Values in the sequence of a key, and bytes of a constructed one (an algorithm, parameters, attributes), at most.
VALUES, CONSTRUCTED = 16, 4096

Content = list | bytes
#: Bytes (at, n) of something.
Read = Callable[[int, int], bytes]


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def pem_body(block: str) -> str:
    """What is between the marks of a PEM block without its headers, of which those of encryption may share a line."""
    lines = re.sub(r"(?:\\[nr])+", "\n", block)  # line ends of string literals
    lines = re.sub(r"(?:Proc-Type|DEK-Info):[ \t]*\S+", "", lines)
    return re.sub(r"(?m)^[ \t]*[A-Za-z0-9-]+:.*$|\s", "", lines)


def der(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, list | bytes]] | None:
    """(tag, content) of the values that fill a range exactly, or None if a length doesn't fit."""
    out: list = []
    at = start
    while at < end:
        if at + 2 > end or depth > 16:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def _is_key(values: list[tuple[int, Content]]) -> bool:
    """Whether these values, in one sequence, are those of a private key."""
    tags = [tag for tag, _ in values]
    algorithm = lambda value: value[0] == 0x30 and value[1] and value[1][0][0] == 0x06
    if tags[:1] == [0x02] and values[0][1] in (b"\0", b"\1"):
        if tags.count(0x02) == len(tags) and len(tags) in (6, 9):
            return True  # DSA, RSA
        if tags[:2] == [0x02, 0x04]:
            return len(values[1][1]) >= 16  # EC
        return tags[:3] == [0x02, 0x30, 0x04] and bool(algorithm(values[1]))
    return tags == [0x30, 0x04] and bool(algorithm(values[0])) and len(values[1][1]) >= 16


def is_private_key(data: bytes) -> bool:
    if data.startswith(OPENSSH):
        return _openssh_fits(lambda at, n: data[at : at + n], len(data))
    if len(data) < 16 or data[0] != 0x30:
        return False
    values = der(data, 0, len(data))
    return values is not None and len(values) == 1 and _is_key(values[0][1])


def _openssh_fits(read: Read, size: int) -> bool:
    """Three strings after the magic, each after its length (cipher, kdf, its options), and a number of keys."""
    at = len(OPENSSH)
    if read(0, at) != OPENSSH:
        return False
    for _ in range(3):
        if at + 4 > size:
            return False
        at += 4 + int.from_bytes(read(at, 4), "big")
    return at + 4 <= size


def _der_fits(read: Read, size: int) -> bool:
    """is_private_key() of DER, from the heads of the values in its sequence and what the short constructed ones hold: the work
    doesn't grow with the size. No key has long ones or more values than VALUES."""
    start, end = _head(read(0, 6))
    values: list[tuple[int, Content]] = []
    if end != size:
        return False
    while start < end:
        if len(values) == VALUES or start + 2 > end:
            return False
        tag = read(start, 1)[0]
        first, after = (start + x for x in _head(read(start, min(6, end - start))))
        if not start < first <= after <= end or tag & 0x20 and after - first > CONSTRUCTED:
            return False
        if tag & 0x20:
            inner = der(read(first, after - first), 0, after - first, 2)
            if inner is None:
                return False
            values.append((tag, inner))
        else:
            values.append((tag, read(first, min(after - first, 16))))
        start = after
    return _is_key(values)


def _head(data: bytes) -> tuple[int, int]:
    """Where a DER value's content begins and ends, from its first bytes; (0, 0) if that is no length."""
    if len(data) < 2:
        return 0, 0
    head, size = 2, data[1]
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or 2 + n > len(data):
            return 0, 0
        head, size = 2 + n, int.from_bytes(data[2 : 2 + n], "big")
    return head, head + size


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head = json.loads(unbase64(header) or b"")
        body = json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):  # neither is JSON nested a thousand deep a header
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return head["alg"].lower() == "none" or bool(signature and unbase64(signature))


def _decoded(data: bytes | None, layer: int) -> str | None:
    if not data:
        return None
    if is_private_key(data):
        return "private_key"
    if layer < LAYERS and len(data) >= 16:
        try:
            text = data.decode("ascii")
        except UnicodeDecodeError:
            return None
        if text.isprintable() or not re.search(r"[^\t\n\r\x20-\x7e]", text):
            inner = scan(text, data, layer + 1)
            if any(kind != "hex" for kind, *_ in inner):
                return "encoded"
    return None


def _block(text: str, first: re.Match) -> list[tuple[int, int]]:
    """Lines of base64 from a run on: as long as the first one, then one that may be shorter or padded."""
    lines, width = [first.span()], len(first[0])
    while not text[lines[-1][1] - 1] == "=" and (end := LINE_END.match(text, lines[-1][1])) and (m := LINE.match(text, end.end())) and len(m[0].rstrip("=")) <= width:
        lines.append(m.span())
        if len(m[0]) != width:
            break
    return lines


def _reader(joined: str, start: int) -> Read:
    """Bytes (at, n) of what base64 from a place on decodes to, without decoding what is before or after."""
    def read(at: int, n: int) -> bytes:
        first = start + at // 3 * 4
        return (unbase64(joined[first : first + (at % 3 + n + 2) // 3 * 4]) or b"")[at % 3 : at % 3 + n]

    return read


def _keys(joined: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of DER private keys in lines put together: from the start of a line or after a sign, over as many characters
    as the value declares, to the end of a line or before a sign. Only what has a key's structure is decoded as a whole."""
    edges, done = {*starts, len(joined)}, 0
    plus, minus = ([m.start() for m in re.finditer(signs, joined)] for signs in ("[+/]", "[-_]"))
    has = lambda places, a, b: bisect_left(places, a) < bisect_left(places, b)
    for m in DER_START.finditer(joined):
        a = m.start()
        if a < done or not (a in edges or joined[a - 1] in "+/_-"):
            continue
        read = _reader(joined, a)
        size = _head(read(0, 6))[1]
        b = a + (4 * size + 2) // 3
        if not (a + 20 < b <= len(joined) and (b in edges or joined[b] in "+/_-")) or has(plus, a, b) and has(minus, a, b):
            continue
        if _der_fits(read, size) and (data := unbase64(joined[a:b])) and is_private_key(data):
            yield a, b
            done = b


def _wrapped(text: str, lines: list[tuple[int, int]], layer: int) -> list[tuple[str, int, int]]:
    """What lines of base64 hold together: DER keys by their declared length, an OpenSSH key from the line that starts it,
    or text, of all lines or of those side by side that decode to text."""
    parts = [text[a:b].rstrip("=") for a, b in lines]
    starts = [0]
    for part in parts:
        starts.append(starts[-1] + len(part))
    joined, found = "".join(parts), []

    def add(kind: str, a: int, b: int) -> None:
        """From and to a place in what is joined; padding counts to the span."""
        i, j = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1
        end = lines[j][1] if b == starts[j + 1] else lines[j][0] + b - starts[j]
        found.append((kind, lines[i][0] + a - starts[i], end))

    for a, b in _keys(joined, starts):
        add("private_key", a, b)
    if len(lines) == 1 or found:
        return found
    for i, part in enumerate(parts):
        if part.startswith(OPENSSH_START):
            for b in (len(joined), starts[-2]):
                size = b - starts[i]
                if size % 4 != 1 and _openssh_fits(_reader(joined, starts[i]), size * 3 // 4) and (data := unbase64(joined[starts[i] : b])) and is_private_key(data):
                    add("private_key", starts[i], b)
                    return found
    whole = len(parts[0]) % 4 == 0  # lines decode one by one
    plain = [whole and (data := unbase64(part)) is not None and not re.search(rb"[^\t\n\r\x20-\x7e]", data) for part in parts]
    i = 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and (plain[j] == plain[i] or not whole):
            j += 1
        for end in (j, j - 1) if j == len(parts) else (j,):
            if (plain[i] or not whole) and end - i > 1 and ONE_ALPHABET.match(joined[starts[i] : starts[end]]) and (kind := _decoded(unbase64(joined[starts[i] : starts[end]]), layer)):
                add(kind, starts[i], starts[end])
                break
        i = j
    return found


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a range meets one of some spans, which lie one after the other."""
    i = bisect_left(spans, (end, 0))
    return i > 0 and spans[i - 1][1] > start


def _base64(text: str, layer: int, skip: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Secrets in base64: in lines together, then in runs by themselves, outside the spans to skip."""
    found: list[tuple[str, int, int]] = []
    at = 0
    while m := BASE64.search(text, at):
        lines = _block(text, m)
        at = lines[-1][0] if len(lines) > 1 and lines[-1][1] - lines[-1][0] >= 40 else lines[-1][1]
        if lines := [(x, y) for x, y in lines if not _meets(skip, x, y)]:
            found += _wrapped(text, lines, layer)
    known = sorted([*skip, *((a, b) for _, a, b in found)])
    begins, reach = [a for a, _ in known], list(accumulate((b for _, b in known), max))
    within = lambda a, b: (i := bisect_right(begins, a)) > 0 and reach[i - 1] >= b
    for m in BASE64.finditer(text):
        if within(*m.span()):
            continue
        if ONE_ALPHABET.match(m[0].rstrip("=")) and (kind := _decoded(unbase64(m[0]), layer)):
            found.append((kind, *m.span()))
            continue
        for pattern in PARTS:  # a sign of the other alphabet may only part it from what is beside it
            for part in pattern.finditer(text, *m.span()):
                if part.span() != m.span() and not within(*part.span()) and (kind := _decoded(unbase64(part[0]), layer)):
                    found.append((kind, *part.span()))
    return found


def scan(text: str, raw: bytes | None = None, layer: int = 0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, by start, then by kind."""
    raw = text.encode("utf-8") if raw is None else raw
    lower = raw.lower()
    found: list[tuple[str, int, int]] = []
    if any(word in lower for word in KEYWORDS):
        found += (("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    if b"AKIA" in raw:
        found += (("access", *m.span()) for m in ACCESS.finditer(text))
    if b"h" * 24 in raw.translate(_HEX_RUN):
        found += (("hex", *m.span()) for m in HEX.finditer(text))
    pem: list[tuple[int, int]] = []
    if b"-----BEGIN" in raw:
        for m in PEM.finditer(text):
            data = unbase64(pem_body(m[2]))
            if data and (is_private_key(data) or "ENCRYPTED" in m[2] and len(data) >= 16):
                found.append(("private_key", *m.span()))
                pem.append(m.span())
    if any(start in raw for start in TOKEN_STARTS):
        found += (("signed_token", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3]))
    if b"b" * 40 in raw.translate(_BASE64_RUN):
        found += _base64(text, layer, pem)
    if b"h" * 48 in raw.translate(_ANY_HEX_RUN):
        found += ((kind, *m.span()) for m in LONG_HEX.finditer(text) if len(m[0]) % 2 == 0 and (kind := _decoded(bytes.fromhex(m[0]), layer)))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and spans: an array of (kind, start, end) in order."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for raw in texts(batch.column(1)):
                raw = raw or b""
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in scan(raw.decode("utf-8"), raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], [id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with `<kind>` in place of each run of overlapping spans; the kind is that of its first span."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += (text[at:start], f"<{kind}>")
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, secrets in text_col masked; a null text stays null."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for raw in texts(batch.column(place)):
                text = None if raw is None else raw.decode("utf-8")
                out.append(masked(text, found) if text and (found := scan(text, raw)) else text)
            yield batch.set_column(place, batch.schema.names[place], pa.array(out, batch.column(place).type))

    return df.mapInArrow(run, df.schema)
