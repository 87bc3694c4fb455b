"""Fill-in-middle, vector codes, and BPE by a queue of merges."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loamwatch.llm import fill_middle as FM
from loamwatch.llm import merges as MG
from loamwatch.llm import vector_codes as VC
from loamwatch.llm import vocab

from .test_tokens import texts

PATH = vocab.default_path("word_bpe_49k.json")


def plain_cut(doc_id, text, plain_from=90, spm_below=20):
    """Fill-in-middle by hand: (n, form, prefix, middle, suffix, output)."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= plain_from:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_below else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_equal_plain_ones_and_are_restored(spark, odd, none):
    rng = random.Random(7)
    marks = ["<", "<P", "<P>", "S>", "<S", ">", "$1", "\\", "{2}", "é", "漢", "😀", "\n", "\r\n", "\x00", "ab", "Zz", " "]
    rows = [(i, "".join(rng.choices(marks, k=rng.randint(0, 40)))) for i in range(2000)] + [(i, "".join(rng.choices(marks[4:], k=30))) for i in range(2000, 4000)]
    rows += [(5000 + i, ("abc de, " * 150_000)[: 1_000_000 + i] + "漢") for i in range(4)]  # very long ones
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (table, odd):
        got = FM.restore(FM.fill_in_middle(docs)).collect()
        want = sorted((str(r.doc_id), r.text or "", *map(str, plain_cut(r.doc_id, r.text))) for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.restored, *map(str, (r.n, r.form, r.prefix, r.middle, r.suffix, r.output))) for r in got) == want
    assert {r.form for r in FM.fill_in_middle(table).collect()} == {"plain", "psm", "spm"}
    assert FM.restore(FM.fill_in_middle(none)).count() == 0


def plain_codes(vectors, parts, entries, rounds, scale):
    """k-means of every part against every entry: (codes, errors, codebook). Vectors in order of id."""
    x = np.floor(np.asarray(vectors, float) * scale).astype(np.int64)
    width = x.shape[1]
    cuts = [p * width // parts for p in range(parts + 1)]
    book = x[:entries].copy()
    for k in range(rounds + 1):
        codes, error = np.zeros((len(x), parts), int), np.zeros(len(x), np.int64)
        for p in range(parts):
            part, entry = x[:, cuts[p] : cuts[p + 1]], book[:, cuts[p] : cuts[p + 1]]
            d = ((part[:, None, :] - entry[None]) ** 2).sum(axis=2)
            codes[:, p] = d.argmin(axis=1)
            error += d.min(axis=1)
            if k < rounds:
                for i in range(len(entry)):
                    if (codes[:, p] == i).any():
                        entry[i] = part[codes[:, p] == i].sum(axis=0) // (codes[:, p] == i).sum()
    return codes, error, book


@pytest.mark.parametrize("kind", ["groups", "noise", "ties", "long", "short"])
def test_ball_codes_equal_plain_ones(spark, kind):
    rng = np.random.default_rng(5)
    n, width = 400, {"long": 200, "short": 5}.get(kind, 16)
    if kind == "groups":  # far apart and tight: cores and resting balls
        v = rng.normal(size=(20, width))[rng.integers(0, 20, n)] * 10 + rng.normal(size=(n, width)) * 0.01
    elif kind == "ties":
        v = rng.integers(-1, 2, (n, width)) / 4096
    else:
        v = rng.normal(size=(n, width))
    v = v.astype(np.float32)
    order = rng.permutation(n)
    table = spark.createDataFrame([(int(i), v[i].tolist(), int(i) % 3) for i in order], "vec_id long, embedding array<float>, label int").repartition(7)
    codes, error, book = plain_codes(v, 8, 16, 6, 4096)
    made = VC.compress(table)
    got = sorted(made.rows.collect(), key=lambda r: r.vec_id)
    assert [list(r.code) for r in got] == codes.tolist()
    assert [r.error for r in got] == error.tolist()
    assert (made.book.entries == book).all()
    if kind == "groups":  # distances that balls save
        assert max(made.measured[3:]) < 0.3 * n * 8 * 16


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0], None), (None, [1.0, 2.0], None), (1, [0.5, -1.0], 4), (1, [0.5, -1.0], 4), (2, None, 4), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1e30, -1e30], 9), (8, [1.0, 2.0, 3.0], 1), (9, [], 1)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, label int, code string, error string, v string")
    made = VC.compress(table)
    got = sorted(((r.vec_id, r.label, r.error) for r in VC.label_errors(made.rows).collect()), key=str)
    assert got == sorted([(3, None, 0), (None, None, 0), (1, "4", 0), (1, "4", 0), (7, "9", 0)], key=str)  # as many entries as rows
    assert len(made.book.entries) == 5 and made.book.entries.max() == VC.MOST
    assert VC.compress(table.where("vec_id = 2")).rows.count() == 0 and VC.label_errors(VC.compress(table.limit(0)).rows).count() == 0


def test_label_errors(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 2 else f"l{i % 1500}", b"", i) for i in range(6000)]
    got = VC.label_errors(spark.createDataFrame(rows, "vec_id long, label string, code binary, error long")).collect()
    sums = {}
    for _, label, _, e in rows:
        sums[label] = sums.get(label, 0) + e
    assert len(got) == len(rows) and all(r.label_error == sums[r.label] for r in got)


def test_ids_and_decoded_texts_equal_the_library():
    rng = random.Random(9)
    points = [*range(0x500), *range(0x1E00, 0x2100), *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610)]
    t = texts(4000, 11) + ["".join(map(chr, rng.choices(points, k=25))) for _ in range(3000)]
    t += ["a<|endoftext|>B <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "don't we'll I'M 'S", "ab" * 50_000, "x" * 200_001, "漢字" * 20_000]
    library = vocab.tokenizer(PATH)
    want = [e.ids for e in library.encode_batch(t, add_special_tokens=False)]
    ids = MG.encode_block(pa.array(t), PATH)
    assert ids.to_pylist() == want
    assert MG.decode_block(ids, PATH).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]


def test_remembered_words_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(MG, "REMEMBERED", 50)
    m, library = MG.Merges(PATH), vocab.tokenizer(PATH)
    for seed in range(8):
        words = list({w.lower() for t in texts(60, seed) for w in t.split() if "<|" not in w and w.lower().isascii()})
        assert m.of(words) == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_bpe_jobs(spark, odd, none):
    library = vocab.tokenizer(PATH)
    encoded = MG.encode_texts(odd, keep=("text",))
    rows = MG.decode_ids(encoded).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    strange = spark.createDataFrame([([320, None, 999_999, -1, 49407],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded for r in MG.decode_ids(strange).collect()] == ["a</w> <|endoftext|>", "", ""]
    assert MG.encode_texts(none, decoded=True).count() == 0
