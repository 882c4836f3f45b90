"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in every slot, so one probe
returns all languages that contain an n-gram (here: four bytes of lower-cased
UTF-8).  A document's hits per language are a popcount over its n-grams, less the
expected false positives of that language's slice; the greatest share decides.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import fold_of, held_out, segment_sum, slices, string_buffers

N = 4
#: Documents that are learnt from, for each language at most (the bound of the fit).
DOCUMENTS_PER_LANGUAGE = 400
SHARES = 16
#: An n-gram belongs to each language that has it this often at least, as a share of the language that has it most.
LEAST_SHARE = 0.2
#: Documents of a language that an n-gram must occur in (1 while there are under 20).
LEAST_DOCUMENTS = 2
HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SLOTS_PER_ENTRY = 8
FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256)], np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each byte but the last three, as an integer; bytes that aren't letters count as blanks."""
    x = FOLD[data].astype(np.uint32)
    if len(x) < N:
        return np.zeros(0, np.uint32)
    return x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)


def slots(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    wide = g.astype(np.uint64)
    for h in HASHES:
        yield (wide * h) >> np.uint64(64 - bits)


@dataclasses.dataclass
class Filters:
    """languages in order of their number of learnt documents; planes: slot masks of up to 64 languages each."""

    languages: list[str]
    bits: int
    planes: list[np.ndarray]
    false_rate: np.ndarray

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams of each language, a row for each document; number of n-grams."""
        g = grams(data)
        ends = np.maximum(off[:-1], off[1:] - (N - 1))
        ranges = np.minimum(np.stack([off[:-1], ends], axis=1), len(g))
        n = ranges[:, 1] - ranges[:, 0]
        share = np.zeros((len(n), len(self.languages)))
        probe = list(slots(g, self.bits))
        for p, plane in enumerate(self.planes):
            mask = plane[probe[0]] & plane[probe[1]] & plane[probe[2]]
            for k in range(min(64, len(self.languages) - 64 * p)):
                one = np.concatenate([[0], np.cumsum((mask >> plane.dtype.type(k)) & plane.dtype.type(1), dtype=np.int64)])
                share[:, 64 * p + k] = one[ranges[:, 1]] - one[ranges[:, 0]]
        n_ = np.maximum(n, 1)[:, None]
        f = self.false_rate[None, :]
        return np.clip((share - f * n_) / ((1 - f) * n_), 0, 1), n


def learn(texts: dict[str, list[str]]) -> Filters:
    """Filters from texts of each language."""
    languages = sorted(texts, key=lambda k: (-len(texts[k]), k))
    keys, rates = [], []
    for lang in languages:
        each = [grams(np.frombuffer((t or "").encode(), np.uint8)) for t in texts[lang]]
        seen, documents = np.unique(np.concatenate([np.unique(x) for x in each] or [np.zeros(0, np.uint32)]), return_counts=True)
        all_, counts = np.unique(np.concatenate(each or [np.zeros(0, np.uint32)]), return_counts=True)
        enough = documents >= (LEAST_DOCUMENTS if len(each) >= 20 else 1)
        keys.append(seen[enough])
        rates.append(counts[enough] / max(1, counts.sum()))
    union = np.unique(np.concatenate(keys or [np.zeros(0, np.uint32)]))
    rate = np.zeros((len(languages), len(union)))
    for k in range(len(languages)):
        rate[k, np.searchsorted(union, keys[k])] = rates[k]
    member = (rate > 0) & (rate >= LEAST_SHARE * rate.max(axis=0, initial=0))
    most = int(member.sum(axis=1).max(initial=1))
    bits = max(10, int(np.ceil(np.log2(SLOTS_PER_ENTRY * max(1, most)))))
    planes, false_rate = [], []
    for p in range(0, len(languages), 64):
        group = member[p : p + 64]
        kind = next(t for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(group) <= w)
        plane = np.zeros(1 << bits, kind)
        for k, own in enumerate(group):
            for s in slots(union[own], bits):
                plane[s] |= kind(1 << k)
            false_rate.append(float(((plane >> kind(k)) & kind(1)).mean()) ** len(HASHES))
        planes.append(plane)
    return Filters(languages, bits, planes, np.array(false_rate))


def fit(docs: DataFrame, *, most: int = DOCUMENTS_PER_LANGUAGE) -> Filters:
    """Learn from documents (doc_id, text, lang) outside the held-out fold; rows with a null among text, lang and doc_id are left out.

    At most ``most`` documents of a language are used, chosen by a hash of the id, whole.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 1)).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # first within shares of a language, so that what meets in one task doesn't grow with the table
    for keys in (["lang", F.pmod("h", F.lit(SHARES))], ["lang"]):
        by = Window.partitionBy(*keys).orderBy("h", "doc_id")
        rows = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).drop("r")
    chosen = [r["doc_id"] for r in rows.select("doc_id").collect()]
    texts: dict[str, list[str]] = {}
    if chosen:
        for r in docs.where(F.col("doc_id").isin(chosen) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text").toLocalIterator():
            if len(own := texts.setdefault(r["lang"], [])) < most:  # repeated rows don't break the bound
                own.append(r["text"])
    return learn(texts)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns ``keep`` of every document.

    ``und`` with score 0 for a text that is null or has no letter, and for all texts
    if nothing was learnt.  A text without an n-gram of any language gets the
    language with most learnt documents, score 1 / languages.  Ties go to it, too.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        names = np.array([*f.languages, "und"], object)
        for whole in batches:
            for b in slices(whole, "text"):
                off, data = string_buffers(b.column("text"))
                letters = segment_sum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128), off) > 0
                texts = b.column("text")
                for k in np.flatnonzero(~letters):
                    letters[k] = has_letter(texts[int(k)].as_py() or "")
                pred, score = np.full(b.num_rows, len(f.languages)), np.zeros(b.num_rows)
                if f.languages:
                    share, _ = f.hits(data, off)
                    best, total = share.argmax(axis=1), share.sum(axis=1)
                    value = np.where(total > 0, share.max(axis=1) / np.where(total > 0, total, 1), 1 / len(f.languages))
                    pred, score = np.where(letters, best, pred), np.where(letters, value, 0.0)
                columns = [b.column(c) for c in ("doc_id", "held_out", *keep)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "held_out", *keep, "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[c for c in keep if c != "text"], "text")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "held_out", *keep))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, *, most: int = DOCUMENTS_PER_LANGUAGE) -> DataFrame:
    return predict(docs, fit(docs, most=most))


#: Least score, as a multiple of an even share among the languages, of a document that stays.
LEAST_OVER_EVEN = 1.2


def keep_known(docs: DataFrame, *, least: float = LEAST_OVER_EVEN) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with its columns; a null lang becomes the one recognised.

    Rows go if they have no letter or if no language stands out.  With fewer than two
    learnt languages nothing can stand out, and only rows without a letter go.
    """
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    filters = fit(docs)
    few = len(filters.languages) < 2
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(v) for c, v in names.items()])
    rows = predict(renamed, filters, ("text", *names.values()))
    good = F.col("lang_pred") != "und" if filters.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not few:
        good = good & (F.col("score") * len(filters.languages) >= least)
    out = {c: F.col(names.get(c, c)) for c in docs.columns}
    if filters.languages:
        out["lang"] = F.coalesce(out["lang"], F.col("lang_pred"))
    return rows.where(good).select(*[v.alias(c) for c, v in out.items()])
