"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

Where a word such as ``password`` stands shortly before a run of secret-like
characters, the run's marginal size is measured: how many bytes zstandard needs for
the surrounding text and the run after it, less those of the surrounding text alone, primed
with a dictionary of identifiers and of the corpus's most frequent words.  Names, placeholders and numbers
that resemble their surroundings cost little; what costs nearly a byte a character
is random and reported.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of the patterns, in the order of their report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are as long as can be, so shorter ones needn't be matched to be dropped
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")
#: What a text with a match of ASSIGN has, in lower case.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make a context sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "credential", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "accesskey", "private key", "private_key", "privatekey", "bearer", "authorization")
#: Common names in code, which prime the compressor beside the corpus's own words.
IDENTIFIERS = (
    "password", "secret", "token", "username", "client", "server", "config", "settings", "example", "your", "here", "placeholder", "changeme", "default", "environment", "variable", "database", "connection",
    "string", "value", "number", "number1234567890", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "function", "return", "import", "self", "request", "response", "header", "account", "access",
    "private", "public", "signature", "session", "cookie", "service", "https://www.", "http://", "localhost", "index", "encode", "decode", "base64", "sha256", "certificate", "user_name", "api_key", "API_KEY", "SECRET_KEY", "ACCESS_TOKEN",
)
LEAD = " ".join(IDENTIFIERS[:24]) + " "
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
#: Characters between a sensitive word and a candidate, and of the surroundings on either side.
REACH, AROUND = 64, 128
#: Least bytes a character of a reported string: random letters and digits take 0.9 to 1.4, compounds of known words mostly 0.5 to 0.9.
RATE = 0.9
DICTIONARY_BYTES = 32_768
LEVEL = 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGNED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def mixed(s: str) -> bool:
    """Whether a string has digits and letters, or small letters before capital ones: words and numbers don't."""
    digits = sum(map(str.isdigit, s))
    return 0 < digits < sum(map(str.isalnum, s)) or re.search("[a-z][A-Z]", s) is not None


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, words: list[str], level: int = LEVEL):
        # the nearest to the text are the cheapest to refer to
        content = " ".join([*reversed(words), *IDENTIFIERS]).encode()
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        """Compressed bytes of a text behind one that the dictionary holds, as a block that gains little would be kept plain."""
        return len(self.compressor.compress((LEAD + text).encode("utf-8", "surrogatepass")))

    def marginal(self, text: str, start: int, end: int) -> int:
        """Bytes that ``text[start:end]`` adds to its surroundings; other occurrences there don't make it cheaper."""
        own = text[start:end]
        before, after = (s.replace(own, "") for s in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        return self.size(f"{before} {after} {own}") - self.size(f"{before} {after} ")


def candidates(text: str, sensitive: re.Pattern) -> Iterator[tuple[int, int]]:
    """Runs of secret-like characters that begin at most REACH after a sensitive word."""
    seen = 0
    for m in sensitive.finditer(text):
        at = max(m.end(), seen)
        while (c := CANDIDATE.search(text, at)) and c.start() <= m.end() + REACH:
            seen = at = c.end()
            yield c.span()


def novel_spans(text: str, taken: list[tuple[int, int, int]], sensitive: re.Pattern, novelty: Novelty, rate: float) -> Iterator[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return
    for a, b in candidates(text, sensitive):
        if not any(s < b and a < e for s, _, e in taken) and mixed(text[a:b]) and novelty.marginal(text, a, b) >= rate * (b - a):
            yield a, 3, b


def frequent_words(docs: DataFrame, most_bytes: int = DICTIONARY_BYTES) -> list[str]:
    """The most frequent words of letters (capital only in front) in all texts, ties in byte order, until they fill ``most_bytes``.

    Words with digits or with capitals inside stay out, so that a secret that is
    copied often doesn't become ordinary.
    """
    words = docs.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where(F.length("word").between(4, 20))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("word").rlike("^[A-Z]?[a-z]+$"))
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most_bytes // 5).collect()]
    sizes = itertools.accumulate(len(w) + 1 for w in top)
    return [w for w, size in zip(top, sizes, strict=True) if size <= most_bytes]


def find(docs: DataFrame, *, words: list[str] | None = None, rate: float = RATE) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of the secrets of each row of ``docs``.

    Spans are sorted by start, then kind.  Kinds: assign, access, hex (fixed patterns,
    each leftmost and without overlaps of its own kind) and novel, which never overlaps
    the others.  ``words`` prime the compressor; by default the corpus's most frequent.
    Null and empty texts have no spans; each row counts, whether its id is repeated or
    null; other columns take no part.
    """
    primer = frequent_words(docs) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer)
        sensitive = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
        for b in batches:
            out = []
            for text in b.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                found = sorted([*base, *novel_spans(text, base, sensitive, novelty, rate)])
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (text) of each document."""
    spans = F.col("spans")
    is_a = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(spans, is_a(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = listed(F.filter(spans, lambda s: s["kind"] != KINDS[3]))
    return find(docs).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(spans).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """doc_id and text, with ``mark`` for each stretch that spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    # spans go with the texts by place, as ids may be repeated
    placed = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("at")).alias("doc_id"), "text")
    found = find(placed, words=options.pop("words", None) or frequent_words(docs), **options)
    rows = placed.join(found, "doc_id").select(F.col("doc_id.doc_id").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
