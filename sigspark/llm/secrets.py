"""Secret scan: base patterns, and structural confirmation of encoded candidates.

Base spans come from three patterns over the whole text. The method looks at every run of
base64 or hex letters, at base64 wrapped to lines of one width and at every armoured block, with
real or escaped line breaks, decodes it and reports a span of its own only if the decoded bytes hold together: nested DER lengths that add up to the whole, a
length-prefixed key blob, or a signed token whose header is JSON with an algorithm.

Defined cases: null text is the empty text and has no span; a null doc_id is passed on;
repeated rows give repeated results; two spans with one start are ordered by kind as listed
in ``KINDS``; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from sigspark.llm.common import text_slices

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Base kinds first, then the method's.
KINDS = ("assign", "access", "hex", "pem_key", "signed_token", "der_key", "key_blob")

#: Candidates of the method: long runs, their decoded form decides.
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
#: A run is entered at its start only and never given back, so that long runs cost linear time.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{16,}")
OPENED, CLOSED = (re.compile(rf"-----{word} ([A-Z0-9 ]{{0,40}}KEY)-----") for word in ("BEGIN", "END"))
ARMOURED = re.compile(r"(?:[A-Za-z0-9+/=\s:,.-]|\\{1,2}[nr/])*+")
LEAST_ARMOURED = re.compile(r"(?:[A-Za-z0-9+/=\s:,.-]|\\{1,2}[nr/]){40,}+")
#: A line break, real or escaped; a first long line and those that follow it; armour of something else.
BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\{1,2}r)?\\{1,2}n)[ \t]*")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]+={{0,2}})+")
OTHER_ARMOUR = re.compile(rf"-----BEGIN (?![A-Z0-9 ]*KEY-----)[A-Z0-9 ]+-----(?:{BREAK.pattern})?\Z")
#: The first field of length-prefixed key blobs.
BLOB_KINDS = {b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521"}
OPENSSH = b"openssh-key-v1\x00"


def unbase64(text: str) -> bytes | None:
    """Decode either alphabet, padded or not; None if the length can't be base64."""
    plain = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> int | None:
    """Number of primitive values if the bytes are exactly a row of DER values, else None."""
    at, found = 0, 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
            if size < 0x80:
                return None
        if tag == 0 or at + size > len(data):
            return None
        if tag & 0x20:
            inner = der_items(data[at : at + size], depth + 1)
            if inner is None:
                return None
            found += inner
        elif tag not in (1, 2, 3, 4, 5, 6, 12, 19, 20, 22, 23, 24) and tag < 0x80:
            return None
        else:
            found += 1
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """One outer sequence that fills the bytes, with at least two values inside."""
    return len(data) >= 24 and data[0] == 0x30 and (der_items(data) or 0) >= 2


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed fields that fill the bytes, the first of them a key type."""
    if data.startswith(OPENSSH):
        return len(data) > len(OPENSSH) + 4 and int.from_bytes(data[15:19], "big") <= 32
    at, fields = 0, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or (fields == 0 and data[at + 4 : at + 4 + size] not in BLOB_KINDS):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 2


def is_signed_token(text: str) -> bool:
    """Header and payload decode to JSON objects, the header names an algorithm."""
    head, body, _ = text.split(".", 2)
    try:
        header, payload = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def der_size(head: bytes) -> int:
    """Bytes of the DER sequence that begins here, its header included; 0 if none does."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    more = head[1] & 0x7F if head[1] >= 0x80 else 0
    return 0 if more > 4 else 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])


def armoured(text: str):
    """(start, end, body) of each block from a BEGIN line to the next END line of its label, body characters only between."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in CLOSED.finditer(text):
        ends.setdefault(m[1], []).append(m.span())
    done = reach = 0
    for m in OPENED.finditer(text):
        if m.start() < done:
            continue
        if reach <= m.end():  # else this line lies in the run of body characters already measured
            reach = ARMOURED.match(text, m.end()).end()
        closing = ends.get(m[1], [])
        for start, end in closing[bisect_left(closing, (m.end(), 0)) :]:
            if start > reach:
                break
            if LEAST_ARMOURED.fullmatch(text, m.end(), start):
                yield m.start(), end, text[m.end() : start]
                done = end
                break


def wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 over two lines or more, all of one width but for a shorter last one."""
    found = []
    for m in WRAPPED.finditer(text):
        if OTHER_ARMOUR.search(text, max(0, m.start() - 80), m.start()):
            continue
        cuts = [(b.start(), b.end()) for b in BREAK.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *(b for _, b in cuts)], [*(a for a, _ in cuts), m.end()], strict=True))
        at = 0
        while at + 1 < len(lines):
            first, width = lines[at][0], lines[at][1] - lines[at][0]
            head = unbase64(text[first : first + 40]) if width >= 40 else None
            size, ends = der_size(head or b""), []
            if size:  # a sequence says how many lines it takes
                ends = [at - (-((4 * size + 2) // 3) // width)]
            elif head and (head.startswith(OPENSSH) or head[4:].startswith((b"ssh-", b"ecdsa-"))):
                end = at + 1
                while end < len(lines) and lines[end][1] - lines[end][0] == width:
                    end += 1
                ends = [end + 1, end]
            for end in ends:
                if at + 2 <= end <= len(lines) and all(b - a == width for a, b in lines[at : end - 1]) and lines[end - 1][1] - lines[end - 1][0] <= width:
                    data = unbase64("".join(text[a:b] for a, b in lines[at:end]))
                    if data and (is_der_key(data) or is_key_blob(data)):
                        found.append((first, lines[end - 1][1], "der_key" if is_der_key(data) else "key_blob"))
                        at = end - 1
                        break
            at += 1
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]  # a maximal run: the same as HEX, then the length


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded structure says key or token, outermost first, none inside another."""
    found = []
    if "-----BEGIN" in text:
        for start, end, inside in armoured(text):
            body = re.sub(r"\\+[nr]", "\n", inside).replace("\\", "")
            lines = [x for x in body.split("\n") if ":" not in x]  # without armour headers
            data = unbase64(re.sub(r"\s", "", "".join(lines)))
            if data and (is_der_key(data) or is_key_blob(data) or ":" in inside):
                found.append((start, end, "pem_key"))
    if "." in text:
        found += [(m.start(), m.end(), "signed_token") for m in TOKEN.finditer(text) if m[0].startswith(("ey", "ew")) and is_signed_token(m[0])]
    for m in HEX_ANY.finditer(text):
        data = bytes.fromhex(m[0])
        if is_der_key(data) or is_key_blob(data):
            found.append((m.start(), m.end(), "der_key" if is_der_key(data) else "key_blob"))
    for m in ENCODED.finditer(text):
        data = unbase64(m[0])
        if data and (is_der_key(data) or is_key_blob(data)):
            found.append((m.start(), m.end(), "der_key" if is_der_key(data) else "key_blob"))
    found += wrapped_spans(text)
    outer: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if not outer or span[0] >= outer[-1][1]:
            outer.append(span)
    return outer


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed; code points, end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    schema = docs.select("doc_id").schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(name, kind)

    def work(batches):
        for (ids,), texts in text_slices(batches, ("doc_id",)):
            rows = []
            for text in texts:
                base = base_spans(text or "")
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(text or ""))))
            columns = [list(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def redact(docs: DataFrame, length: str | None = None) -> DataFrame:
    """The same rows and columns with every span replaced in the text; a null text stays null.
    The ``length`` column, if named, gets the new number of code points of changed rows."""
    names = docs.columns

    def work(batches):
        for own, texts in text_slices(batches, tuple(names)):
            own, found = list(own), [base_spans(t or "") + confirmed_spans(t or "") for t in texts]
            clean = [redacted(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
            own[names.index("text")] = pa.array(clean, own[names.index("text")].type)
            if length:
                at = names.index(length)
                sizes = [len(t) if spans else n for t, spans, n in zip(clean, found, own[at].to_pylist(), strict=True)]
                own[at] = pa.array(sizes, own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=names)

    return docs.mapInArrow(work, docs.schema)
