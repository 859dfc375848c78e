"""Secret spans in texts: keyword automaton, anchored patterns at its hits, checksums.

Only places where the automaton reports a keyword (or where every fourth
character of a stretch is a hexadecimal digit) are looked at by a pattern, and
only anchored there. Kinds with an embedded checksum are kept if it fits.

Defined results: offsets are code points, ends exclusive; a null text is
empty; every row gives one row, repeated rows too.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import slices

# fixed values of the contract: kinds in order, keywords, patterns, least lengths
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
# kinds with a checksum: prefix, 30 characters, and the CRC-32 of these in six base-62 digits; card numbers end in a Luhn digit
CHECKED_KINDS = ("github", "npm", "card")
CHECKED = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = BASE_KINDS + CHECKED_KINDS
_QUARTER = re.compile(r"[0-9a-f]{4,}")


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def luhn(number: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(number)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@lru_cache(maxsize=1)
def keywords():
    """Automaton over every spelling of the keywords, so that the text need not be folded."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for spelt in itertools.product(*[(c.lower(), c.upper()) if c.isalpha() else (c,) for c in word]):
            a.add_word("".join(spelt), ("assign", len(word)))
    a.add_word("AKIA", ("access", 4))
    for p in CHECKED_PREFIXES:
        a.add_word(p, ("checked", 4))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 16 or more: each has four hexadecimal digits in a row among the characters 3, 7, 11, ..."""
    out, done = [], 0
    for m in _QUARTER.finditer(text[3::4]):
        at, last = 4 * m.start() + 3, 4 * m.end() - 1
        while at <= last:
            if at >= done:
                low = at
                while low > done and text[low - 1] in "0123456789abcdef":
                    low -= 1
                done = HEX.match(text, low).end()
                if done - low >= MIN_HEX:
                    out.append((low, done))
            at += 4
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans by start, then in the order of the kinds."""
    found: list[tuple[str, int, int]] = []
    ends = {"assign": 0, "access": 0}
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords().iter(text))
    for start, kind in hits:
        if kind == "checked":
            m = CHECKED.match(text, start)
            if m and base62_crc(m[2]) == m[3] and not text[max(0, start - 1):start].isalnum():
                found.append((CHECKED_PREFIXES[m[1]], start, m.end()))
        elif start >= ends[kind]:
            m = (ASSIGN if kind == "assign" else ACCESS).match(text, start)
            if m:
                ends[kind] = m.end()
                if (len(m[2]) >= MIN_VALUE) if kind == "assign" else (m.end() - start >= MIN_ACCESS):
                    found.append((kind, start, m.end()))
    for start, end in hex_runs(text):
        found.append(("hex", start, end))
        run = text[start:end]
        if end - start <= 19 and run.isdigit() and luhn(run):
            found.append(("card", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans) per row; spans are (kind, start, end). Map-only."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(SPAN))], names=[key, "spans"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def contract(docs: DataFrame) -> DataFrame:
    """The op2 contract: counts and digests derived from the spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return secret_spans(docs).select(
        "doc_id", *[of(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
