import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loamwatch.llm import sentencepieces as SP
from loamwatch.llm import token_counts as TC
from loamwatch.llm import token_store as TS
from loamwatch.llm import vocab

PARTS = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "\r", "é", "É", "漢", "字", "<s>", "<|endoftext|>", "<0x0A>", "▁", ".", ",", "();", "www", "\x00", "\x1c", "\x85", " ", "😀", "ing", "tion", "==", "        ", "'s", "1", "23", "İ", "ß", "é", "œ", "ʰ."]


def texts(n=3000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)] + ["", "x" * 3000, " " * 2000, "ab" * 2000]


def test_counts_equal_the_library():
    path = vocab.default_path("byte_bpe_50k.json")
    t = texts()
    ids = pa.array(range(len(t)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(t)], names=["doc_id", "n_bytes", "text"])
    got = [n for b in TC._count(path, 512)(iter([batch])) for n in b.column(2).to_pylist()]
    assert got == [len(vocab.tokenizer(path).encode(x, add_special_tokens=False)) for x in t]


def test_store_ids_equal_the_library():
    path = vocab.default_path("word_bpe_49k.json")
    t = texts(seed=2)
    ids, ends = TS.encode_texts(pa.array(t), path, 1)
    got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert got == [[*vocab.tokenizer(path).encode(x, add_special_tokens=False).ids, 1] for x in t]


def test_store_round_trip(spark, odd, none, tmp_path):
    store = str(tmp_path / "store")
    TS.write_store(odd, store)
    got = sorted(TS.read_digests(spark, store).collect(), key=lambda r: r.start)
    library = vocab.tokenizer(vocab.default_path("word_bpe_49k.json"))
    want = {}
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(1)
    assert sorted((str(k), len(v)) for k, v in want.items()) == sorted((str(k), sum((r.doc_id, r.n_tokens, r.ids_crc32) == k for r in got)) for k in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    assert TS.verify_manifest(spark, store).count() == 0
    full = {(r.doc_id, r.start): r.ids for r in TS.read_ids(spark, store).collect()}
    assert len(full) == len(got) and all(zlib.crc32(np.array(full[r.doc_id, r.start], "<u4").tobytes()) == r.ids_crc32 and len(full[r.doc_id, r.start]) == r.n_tokens for r in got)
    assert sorted(map(tuple, full.values())) == sorted((*library.encode(r.text or "", add_special_tokens=False).ids, 1) for r in odd.collect())
    TS.write_store(none, str(tmp_path / "none"))
    assert TS.read_digests(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("parts", [7, 37])
def test_recipe_files_are_in_order_of_documents(spark, tmp_path, parts):
    rng = random.Random(parts)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 400)) for i in rng.sample(range(10_000), 600)], "doc_id long, text string").repartition(5)
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        TS.write_store(docs, str(tmp_path / "s"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = sorted((tmp_path / "s" / "recipes").glob("part-*.parquet"))
    assert len(files) > parts // 2
    rows = [r for f in files for r in pq.read_table(f, columns=["doc_id", "start", "n_tokens"]).to_pylist()]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and len(rows) == 600
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows][:-1]]).tolist()


def test_damage_is_noticed(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    store = str(tmp_path / "a")
    TS.write_store(odd, store)
    bad = spark.read.parquet(f"{store}/chunks").withColumn("address", F.unhex(F.md5("address")))
    bad.write.parquet(str(tmp_path / "b" / "chunks"))
    spark.read.parquet(f"{store}/recipes").write.parquet(str(tmp_path / "b" / "recipes"))
    with pytest.raises(Exception, match="address|missing"):
        TS.read_digests(spark, str(tmp_path / "b")).collect()
    with pytest.raises(Exception, match="address|missing"):
        TS.read_ids(spark, str(tmp_path / "b")).collect()


def test_latin_words_equal_the_library():
    words = TS.word_ids(vocab.default_path("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = [chr(c) for c in range(97, 0x250) if chr(c).isalpha()]
    t = list(dict.fromkeys("".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", ".", ",", ".."]) for _ in range(5000)))
    assert words.of(t) == [words.encode(w) for w in t]


def test_crc_of_parts():
    data = random.Random(1).randbytes(5000)
    cuts = [0, 7, 7, 300, 4096, 5000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    crc = TS.shifted_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([5000 - b for b in cuts[1:]]))
    assert int(np.bitwise_xor.reduce(crc)) == zlib.crc32(data)


def test_equal_streams_share_chunks():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 40000, 20000).astype("<u2")
    b = np.r_[a[:5000], np.uint16(7), a[5000:]].astype("<u2")
    pieces = lambda x: {x[i:j].tobytes() for i, j in zip([0, *TS.cuts(x, np.array([len(x)]))[:-1]], TS.cuts(x, np.array([len(x)])), strict=True)}
    assert len(pieces(a) & pieces(b)) >= len(pieces(a)) - 3


def test_pieces_equal_the_library_and_round_trip():
    path = vocab.default_path("piece_bpe_32k.model")
    t = texts(6000, 3)
    ids = SP.encode_block(t, path)
    model = vocab.pieces(path)
    assert SP.table(path).exact
    assert [x.tolist() for x in ids] == [list(x) for x in model.encode(t)]
    assert [SP.decode(x, path) for x in ids] == [x.replace(SP.MARK, " ") for x in t]


def test_piece_jobs(odd, none):
    encoded = SP.encode_texts(odd)
    assert encoded.count() == 11 and encoded.where("round_trip").count() == 11
    assert SP.decode_ids(encoded).count() == 11
    assert SP.encode_texts(none).count() == 0 and TC.token_counts(none).count() == 0
    assert TC.token_counts(odd).count() == 11
