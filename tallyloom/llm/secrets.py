"""Secret scan: a keyword automaton finds places worth a look, anchored expressions run only there, and tokens that carry a checksum must satisfy it.

Kinds found by shape alone: assign, access, hex. Kinds that need their embedded checksum: github, npm (CRC-32 in base 62 behind the token) and wif (a wallet key in base 58 with a double SHA-256 tag).

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; other columns of the input, whatever their names, are ignored; a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.rowwise import bound_batches, row_udf
from tallyloom.llm.common import arrow_rows, text_or_empty

KINDS = ("assign", "access", "hex", "github", "npm", "wif")
BASE = KINDS[:3]
#: Shapes of the tokens.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
WIF = re.compile(r"5[HJK][1-9A-HJ-NP-Za-km-z]{49}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "wif": ("5h", "5j", "5k"),
}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Every run of MIN_HEX characters has three of the characters that stand STRIDE apart.
STRIDE = MIN_HEX // 3
HEX_PROBE, HEX_RUN = re.compile(r"[0-9a-f]{3,}"), re.compile(r"[0-9a-f]+")
HEX_DIGITS = frozenset("0123456789abcdef")
ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}

_automaton = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def crc62(body: str) -> str:
    """The six characters that follow such a token's random part."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def wif_valid(key: str) -> bool:
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    if value >> 296:
        return False
    raw = value.to_bytes(37, "big")
    return raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:33]).digest()).digest()[:4] == raw[33:]


def keyword_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of every kind but hex. A match that fails its length or checksum still takes its characters from later matches of its kind."""
    low = text.lower()
    if len(low) != len(text):  # a capital with a dot above becomes two characters
        low = text.translate(ASCII_LOWER)
    free, out = dict.fromkeys(KEYWORDS, 0), []
    for last, (kind, size) in automaton().iter(low):
        start = last - size + 1
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                free[kind] = m.end()
                if m.end(2) - m.start(2) >= MIN_VALUE:
                    out.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= MIN_ACCESS:
                    out.append((start, m.end(), kind))
        elif kind in ("github", "npm"):
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            if m and crc62(m[1]) == m[2]:
                free[kind] = m.end()
                out.append((start, m.end(), kind))
        elif (m := WIF.match(text, start)) and wif_valid(m[0]):
            free[kind] = m.end()
            out.append((start, m.end(), kind))
    return out


def hex_spans(text: str) -> list[tuple[int, int, str]]:
    """Runs of hex digits, from probes STRIDE characters apart."""
    out, free = [], 0
    for probe in HEX_PROBE.finditer(text[::STRIDE]):
        start = probe.start() * STRIDE
        if start < free:
            continue
        # the three probes may belong to different runs: look at each run that holds one
        stop = (probe.end() - 1) * STRIDE
        at = start
        while at <= stop:
            if at >= free:
                first = at
                while first > free and text[first - 1] in HEX_DIGITS:
                    first -= 1
                end = HEX_RUN.match(text, first).end()
                if end - first >= MIN_HEX:
                    out.append((first, end, "hex"))
                free = end
            at += STRIDE
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), in code points, by start and then kind as listed in KINDS."""
    if not text:
        return []
    return sorted(keyword_spans(text) + hex_spans(text), key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, counts of the base kinds, the digest of the base spans, all spans. No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind_of_id = source.schema["id"].dataType.simpleString()
    out = f"{id_col} {kind_of_id}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column(1):
                spans = scan(text.as_py())
                base = [x for x in spans if x[2] in BASE]
                for kind in BASE:
                    cols[f"n_{kind}"].append(sum(x[2] == kind for x in base))
                cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols["spans"].append(joined(spans))
            schema = pa.schema([pa.field(id_col, batch.schema.field(0).type)] + [pa.field(k, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k in cols])
            yield arrow_rows(cols | {id_col: batch.column(0)}, schema)

    return source.mapInArrow(run, out)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of docs with every span of the text replaced by a mark; null texts stay null."""

    bound_batches(docs.sparkSession)

    @row_udf(T.StringType())
    def cut(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, end, _ in scan(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]

    return docs.withColumn(text_col, cut(F.col(text_col)))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    return secret_spans(table(spark, sf_dir, "documents"))
