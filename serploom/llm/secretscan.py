"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

The base finds three kinds by pattern (BASE). The method then looks at strings near a sensitive word, those joined to it by
an equals sign, an underscore or a hyphen included (NAME=value, sk_secret_value), and measures their marginal compressed bytes: the compressed size of the surrounding code with the string, less that
without it, both primed with a dictionary of code identifiers. Random keys don't compress; identifiers, words, paths and
repeats do. A string whose marginal bytes are at least NOVEL of its length is reported as kind ``novel``. It only adds
spans: base spans stay, and a novel span never overlaps a base span.

Defined results: null text is empty text and has no span; repeated rows are scanned alike; other columns are ignored by
``scan`` and kept by ``redact``. Texts are scanned whole, offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame

from serploom.llm.common import arrow_map, check_columns, columns_of

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

#: Words near which a string may be a secret, and how far behind them it may start.
SENSITIVE = re.compile(r"(?ai)passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|signature|client.?id")
REACH = 128
#: A run is cut at its equals signs, but for the padding at its end.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
LEAST = 16
#: What a candidate doesn't start with: signs that join it to a name, and further words of the name.
JOINED = re.compile(rf"[_=+/-]*(?:(?:{SENSITIVE.pattern[5:]})[_=+/-]+)*", SENSITIVE.flags)
#: Code points of surrounding text on either side.
AROUND = 256
#: Least marginal compressed bytes per byte of a candidate: hexadecimal digits cost about 0.5, base64 about 0.75.
NOVEL = 0.42

# Identifiers and words common in source code and settings, the raw dictionary.
IDENTIFIERS = (
    "password passwd passphrase secret secret_key client_secret client_id token access_token refresh_token id_token auth_token "
    "bearer authorization credential credentials api_key apikey api-key access_key access_key_id private_key public_key signature "
    "config configuration settings environment production development staging default example placeholder changeme your_token_here "
    "import export return function class public private static const final void string integer boolean number object array list "
    "username user_name email address host hostname server port database connection timeout request response header content-type "
    "application/json text/plain text/html utf-8 http:// https:// localhost 127.0.0.1 true false null none undefined begin end "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 xxxxxxxx -------- ======== "
)

Span = tuple[int, int, int]


class Novelty:
    """Marginal compressed bytes against a dictionary of identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6) -> None:
        self.tool = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(identifiers.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def ratio(self, before: str, candidate: str, after: str) -> float:
        a, c, b = (x.encode("utf-8", "surrogatepass") for x in (before, candidate, after))
        return (len(self.tool.compress(a + c + b)) - len(self.tool.compress(a + b))) / len(c)


@lru_cache(maxsize=1)
def _novelty() -> Novelty:
    return Novelty()


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end): leftmost non-overlapping per kind, matches that fail a length bound dropped after matching."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans (by start) cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novel_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates near sensitive words. Both are walked through once, side by side, never back: the work grows with the text, whatever it says."""
    out: list[Span] = []
    starts, ends = _covered(base)
    words = (w.end() for w in SENSITIVE.finditer(text))
    coming = next(words, None)
    while coming is not None:
        at = last = coming  # what comes before the next word is near none
        for m in CANDIDATE.finditer(text, at):
            start, end = m.span()
            while coming is not None and coming <= start:
                last, coming = coming, next(words, None)
            if start > last + REACH:
                break
            if start == at:  # the rest of the run that the word is in
                start = JOINED.match(text, start, end).end()
            if end - start < LEAST:
                continue
            k = bisect.bisect_left(starts, end) - 1
            if k >= 0 and ends[k] > start:
                continue
            if _novelty().ratio(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]) >= NOVEL:
                out.append((start, 3, end))
        else:
            break
    return out


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, the digest of the base spans, and all spans, for every row of ``docs``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = columns_of(batch)
        counts: list[list[int]] = [[], [], []]
        digest, spans = [], []
        for t in cols["text"]:
            base, every = spans_of(t.as_py())
            for kind, n in enumerate(counts):
                n.append(sum(s[1] == kind for s in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return pa.RecordBatch.from_arrays([cols["doc_id"], *(pa.array(n, pa.int64()) for n in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = check_columns(docs, "doc_id", "text")
    return arrow_map(rows, step, f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in spans_of(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``, and n_chars, where there is such a column, counted anew for
    the rows that change. Null texts stay null; no row goes."""
    names = docs.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = columns_of(batch)
        old = cols["text"].to_pylist()
        new = [t if t is None else redacted(t, mark) for t in old]
        put = {"text": pa.array(new, cols["text"].type)}
        if "n_chars" in cols:
            put["n_chars"] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(cols["n_chars"].to_pylist(), old, new, strict=True)], cols["n_chars"].type)
        return pa.RecordBatch.from_arrays([put.get(n, cols[n]) for n in names], names)

    kinds = dict(docs.dtypes)
    return arrow_map(docs, step, ", ".join(f"`{n}` {kinds[n]}" for n in names))
