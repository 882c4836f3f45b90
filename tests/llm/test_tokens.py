import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinwork.llm import packing, token_files, tokenizing
from skeinwork.llm import sentencepiece_lattice as lattice
from skeinwork.llm.common import materialize, work_dir

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a<|endoftext|>b x", "Ǆ ΑΣ ΣΑΣ'S it's I'll don't", "é x ́y", " a b\tc\x0bd\x1ce\x85f", "ſ İ ß ǅ. ª, ²³ 12,34. !!", "中文。漢字, ｆｕｌｌ", "\U0001f600, a‍b.", "'s 't. ' s |||| .,", "word!! word$$$ a's!", "x" * 3000, "same", "same", "\n\n \n", " "]


def ids_of(text, t=Tokenizer.from_file(WORDS)):
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def table(spark, texts, more=""):
    return spark.createDataFrame([(k * 3 - 6, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_chunks_equal_the_library():
    e = tokenizing.ChunkEncoder(WORDS, most=5)
    for _ in range(2):
        for t, raw in zip(ODD, e.encode_all(ODD), strict=True):
            assert raw + b"\1\0\0\0" == ids_of(t).tobytes()


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 25, 31, 32])
def test_bit_packing(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and (token_files.unpack(raw, 1001, bits) == ids).all() and (token_files.unpack(raw, 7, bits, 500) == ids[500:507]).all()
    with pytest.raises(ValueError):
        if bits == 32:
            raise ValueError
        token_files.pack(np.array([1 << bits]), bits)
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_image_random_access():
    docs = [np.arange(n, dtype="<u4") % 1000 for n in (5, 0, 700, 1)]
    raw = token_files.image(3, 4, [7, 8, token_files.NULL_ID, 9], [len(d) for d in docs], np.concatenate(docs), 10, block=64) + b"\n"
    x, y = token_files.images(raw * 2)
    assert (x.part, x.number, x.n_ids, y.end) == (3, 4, 706, 2 * len(raw))
    assert all((x.document(k) == d).all() for k, d in enumerate(docs))


def test_files_round_trip(spark):
    docs = table(spark, ODD).withColumn("start", F.lit(1))  # a clashing name
    path = work_dir(spark, "t")
    token_files.write(docs, path, WORDS, image_ids=40)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for k, t in enumerate(ODD):
        w = ids_of(t)
        want.append((k * 3 - 6, at, len(w), zlib.crc32(w.tobytes())))
        at += len(w)
    assert [tuple(r) for r in got] == want
    assert token_files.round_trip(docs.limit(0), WORDS).count() == 0


def test_packing(spark):
    r = np.random.default_rng(1)
    texts = ODD + [" ".join(["tree"] * int(n)) for n in r.integers(0, 60, 300)]
    got = packing.pack(table(spark, texts), WORDS, window=64, keep_ids=True).collect()
    by_seq, by_doc = {}, {}
    for p in got:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
    for k, t in enumerate(texts):
        own = sorted(by_doc[k * 3 - 6], key=lambda p: p["start"])
        raw = b"".join(p["ids"] for p in own)
        assert raw == ids_of(t).tobytes() and all(p["doc_tokens"] == len(raw) // 4 and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in own)
    assert sorted(by_seq) == list(range(len(by_seq)))
    used = 0
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
        used += packing.padding(at, 64)
    assert used <= 0.03 * sum(p["length"] for p in got) and packing.pack(table(spark, []), WORDS).count() == 0


def test_minimum_slack_is_minimal():
    from itertools import product

    r = np.random.default_rng(2)
    for _ in range(60):
        counts = {int(k): int(n) for k, n in zip(r.choice(np.arange(1, 17), 4, replace=False), r.integers(1, 4, 4), strict=True)}
        seed = max(counts)
        used = packing.closest(counts, seed, 16)
        assert used[seed] >= 1 and all(used[k] <= counts[k] for k in used)
        totals = [sum(k * n for k, n in zip(counts, c, strict=True)) for c in product(*[range(1 if k == seed else 0, n + 1) for k, n in counts.items()])]
        assert packing.padding(sum(k * n for k, n in used.items()), 16) == min(packing.padding(t, 16) for t in totals if t <= 16)
    slots = packing.plan({5: 10, 3: 7, 16: 4}, 16)
    assert {k: max(s[2] for s in slots if s[0] == k) for k in (5, 3, 16)} == {5: 10, 3: 7, 16: 4}


LATTICE = ODD + ["a  b   c", "  lead", "x\n\n\ny ", "naïve 中文", "a▁b ▁ c", "z" * 200, " " * 80 + "q", "a\0b\0", "the then other their ▁the"]


def test_bpe_lattice_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = materialize(lattice.encode(table(spark, LATTICE), PIECES, buckets=4), "t")
    ids = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
    assert all(ids[k * 3 - 6] == sp.encode(t or "") for k, t in enumerate(LATTICE))
    text = {r["doc_id"]: r["text"] for r in lattice.decode(got, PIECES).collect()}
    assert all(text[k * 3 - 6] == (t or "").replace("▁", " ") for k, t in enumerate(LATTICE))
    d = {r["doc_id"]: r for r in lattice.digest(got, PIECES).collect()}
    assert d[-6 + 3 * 12]["text_crc32"] == zlib.crc32(b"same") and d[-6]["n_tokens"] == 0
    assert {tuple(r) for r in lattice.encode(table(spark, LATTICE), PIECES, buckets=3, digests=True).collect()} == {tuple(r) for r in d.values()}
    assert lattice.encode(table(spark, []), PIECES, buckets=2).count() == 0


def test_units_are_cut_where_no_piece_crosses():
    model = lattice.Model.load(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table_, cutter = {p: (k, x) for p, k, x in model.pieces}, lattice.Cutter(model)
    texts = [t for t in LATTICE if t]
    units, at, sizes = cutter.cut([None, *texts, ""])
    assert sizes[0] == sizes[-1] == 0 and len(sizes) == len(texts) + 2 and len(set(units)) == len(units)
    ends = sizes.cumsum()
    for t, e, n in zip(texts, ends[1:], sizes[1:], strict=False):
        own = [units[k] for k in at[e - n : e]]
        assert "".join(own) == "▁" + t.replace(" ", "▁")
        ids = [y for u in own for x in lattice.merges(u, table_, model) for y in ([x] if x >= 0 else [model.byte_ids[c] for c in chr(-2 - x).encode()])]
        assert ids == sp.encode(t)


def test_merges_that_let_an_earlier_edge_in(spark):
    """'abc' outranks its part 'bc', so it may be merged only after the pass has gone by."""
    pieces = [(c, k, 0.0) for k, c in enumerate("abcxyz")] + [("abc", 10, -1.0), ("xy", 11, -2.0), ("bc", 12, -3.0), ("ab", 13, -9.0), ("abcx", 14, -4.0), ("cxy", 15, -2.5), ("bcxy", 16, -0.5)]
    model = lattice.Model(True, pieces, list(range(100, 356)), 99, 4, -20.0)
    assert lattice.late_pieces(model) >= {"bc", "ab"}
    r = np.random.default_rng(8)
    words = sorted({"".join(r.choice(list("abcxyz"), n)) for n in r.integers(1, 14, 400)} | {"abc", "xabc", "abcxy", "aabcxyz"})
    table_ = {p: (k, x) for p, k, x in pieces}
    got = {x["unit"]: list(x["path"]) for x in lattice.lattice(spark.createDataFrame([(w,) for w in words], "unit string"), model, 3).collect()}
    assert got == {w: lattice.merges(w, table_, model) for w in words}


def test_edges_are_made_before_they_are_grouped(spark):
    """The fold is interpreted: it gets edges ready to use, and sorts longs without a comparator of its own."""
    pieces = [(c, k, 0.0) for k, c in enumerate("abc")] + [("ab", 10, -1.0), ("bc", 11, -2.0)]
    model = lattice.Model(True, pieces, list(range(100, 356)), 99, 2, -20.0)
    got = lattice.lattice(spark.createDataFrame([("abcé",), ("cbca",), ("éé",)], "unit string"), model)
    assert {r["unit"]: list(r["path"]) for r in got.collect()} == {"abcé": [10, 2, -2 - ord("é")], "cbca": [2, 11, 0], "éé": [-2 - ord("é")] * 2}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [line.strip(" +-:") for line in plan if "struct(place" in line]
    assert made and all(line.startswith("Aggregate") for line in made) and not any("array_sort(" in line for line in plan)


def test_unigram_lattice_equals_the_library(spark):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    model = lattice.dataclasses.replace(lattice.Model.load(PIECES), bpe=False)
    words = [f"{a}{b}{c}" for a in ("th", "re", "Un", "é", "xqz") for b in ("ing", "ation", "our", "ß") for c in ("", "s", "ments,", "!!")]
    got = lattice.lattice(spark.createDataFrame([("▁" + w,) for w in words], "unit string"), model)
    assert {r["unit"]: list(r["path"]) for r in got.collect()} == {"▁" + w: sp.encode(w) for w in words}
