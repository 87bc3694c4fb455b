import random

import numpy as np
import pytest
import xxhash

from loamwatch.llm import simhash as S


def close_groups(codes, radius):
    parent = list(range(len(codes)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u = np.asarray(codes, np.int64).view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius) + i + 1:
            a, b = top(i), top(int(j))
            parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(u))]


@pytest.mark.parametrize("radius,rotations", [(2, 1), (3, 1), (7, 4), (11, 4)])
def test_index_finds_every_link(spark, radius, rotations):
    rng = random.Random(radius)
    codes = [rng.getrandbits(64) for _ in range(1500)]
    base = rng.getrandbits(64)
    for _ in range(1500):  # a dense region, and pairs just inside and outside the radius
        codes.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        codes.append(rng.choice(codes[:1500]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(radius - 1, radius + 1))))
    codes = sorted({c - (1 << 64) if c >> 63 else c for c in codes} | {0, -1})
    links = S.close_codes(spark.createDataFrame([(c,) for c in codes], "code long"), radius, rotations).collect()
    place = {c: i for i, c in enumerate(codes)}
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") == r.distance <= radius for r in links)
    parent = list(range(len(codes)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for r in links:
        a, b = top(place[r.u]), top(place[r.v])
        parent[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(codes))] == close_groups(codes, radius)


def test_deep_tree(spark, monkeypatch):
    """More nodes than one root holds: another level."""
    monkeypatch.setattr(S, "ROOT", 4)
    rng = random.Random(1)
    codes = [(rng.getrandbits(63),) for _ in range(30_000)]
    codes += [(c[0] ^ 1,) for c in codes[:50]]
    links = S.close_codes(spark.createDataFrame(codes, "code long"), 2).collect()
    assert {frozenset((r.u, r.v)) for r in links} >= {frozenset((c[0], c[0] ^ 1)) for c in codes[:50]}


def test_a_partner_goes_to_a_group_of_branches_once(spark, monkeypatch):
    """Branches of few codes, groups of several branches and tasks: each pair of branches meets once, and fewer branches than pairs are sent."""
    from pyspark.sql import functions as F

    for name, value in (("LEAF", 8), ("LEAVES", 4), ("TOGETHER", 8), ("MEETINGS", 60)):
        monkeypatch.setattr(S, name, value)
    sent = {}
    whole = S._dealt

    def dealt(branches, pairs):
        rows = whole(branches, pairs)
        met = rows.select(F.explode("whom").alias("a"), F.col("node").alias("b"))
        sent["met"] = sorted(map(tuple, met.collect())) == sorted(map(tuple, pairs.where("a != b").collect()))
        sent["rows"], sent["pairs"], sent["salts"] = rows.count(), pairs.count(), rows.agg(F.max("salt")).first()[0]
        return rows

    monkeypatch.setattr(S, "_dealt", dealt)
    rng = random.Random(4)
    codes = [(rng.getrandbits(63),) for _ in range(2000)]
    codes += [(c[0] ^ 1025,) for c in codes[:100]]
    links = S.close_codes(spark.createDataFrame(codes, "code long"), 7, 4).collect()
    assert {frozenset((r.u, r.v)) for r in links} >= {frozenset((c[0], c[0] ^ 1025)) for c in codes[:100]}
    assert sent["met"] and sent["salts"] > 0 and sent["rows"] < sent["pairs"], sent


def test_gray_rank_orders_codes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 256).select(F.shiftleft("id", 56).alias("code")).select("code", S.gray_rank(F.col("code")).alias("r")).orderBy("r").collect()
    assert all(bin((a.code ^ b.code) & (2**64 - 1)).count("1") == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_fingerprint_by_hand():
    text = "Ab c d Ab c d e"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert S.fingerprint(text.encode(), 3) & (2**64 - 1) == want
    assert S.fingerprint(b" \n", 3) == 0
    assert S.fingerprint(b"A b", 3) & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)


def test_odd_rows(odd, none):
    codes = S.fingerprints(odd)
    assert codes.count() == 11 and codes.where("code = 0").count() == 4
    found = S.near_components(codes, S.close_codes(codes, 2)).collect()
    assert len(found) == 11 and {r.component_id for r in found if r.doc_id in (4, 5)} == {4} and {r.component_id for r in found if r.code == 0} == {2}
    empty = S.fingerprints(none)
    assert S.near_components(empty, S.close_codes(empty, 2)).count() == 0
    assert S.near_duplicates(none).count() == 0


def test_near_duplicates_keep_one(spark):
    rng = random.Random(2)
    text = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows, groups = [], []
    for g in range(30):
        words = text()
        ids = []
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(120)] = f"edit{rng.random()}"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(copy)))
        groups.append(ids)
    rows += [(len(rows) + k, " ".join(text())) for k in range(40)]
    got = {r.doc_id: (r.group_id, r["first"]) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # copies of similarity 0.84 differ in 9 of 64 bits on average, so one or two of thirty groups may lack a link
    assert sum(all(got[i] == (ids[0], i == ids[0]) for i in ids) for ids in groups) >= 27
    assert all(got[i] == (i, True) for i in range(90, 130))


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def likeness(s, t):
    return len(s & t) / len(s | t)


def edited(rng, words, n):
    """The words with ``n`` of them, 5 or more apart, replaced: about 5 n shingles change."""
    copy = list(words)
    for at in rng.sample(range(5, len(words) - 5, 6), n):
        copy[at] = f"edit{rng.random()}"
    return copy


@pytest.mark.parametrize("dense", [32, 2])
def test_groups_are_those_of_all_candidates(spark, monkeypatch, dense):
    """Copies of templates around the threshold: every pair within the radius in a code counts, not a forest of them."""
    monkeypatch.setattr(S, "DENSE", dense)
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = random.Random(5)
    texts = []
    for size in (150, 40, 40, 10):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(244)]
        texts += [" ".join(edited(rng, words, rng.choice((2, 5, 6, 7)))) for _ in range(size)]
    sets = [shingle_set(t) for t in texts]
    codes = np.asarray([S._codes(S.shingle_set(t.encode(), 5), 2) for t in texts], np.int64).view(np.uint64)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in np.flatnonzero((np.bitwise_count(codes ^ codes[i]) <= 11).any(axis=1)):
            if j > i and likeness(sets[i], sets[j]) >= 0.8:
                a, b = top(i), top(int(j))
                parent[max(a, b)] = min(a, b)
    got = S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), codes=2).collect()
    assert {r.doc_id: r.group_id for r in got} == {i: top(i) for i in range(len(texts))}


def test_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(6)
    rows, pairs = [], 0
    while pairs < 300:
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(229)]
        two = [" ".join(edited(rng, words, 5)), " ".join(words)]
        assert 0.8 <= likeness(*map(shingle_set, two)) < 0.81
        rows += [(2 * pairs, two[0]), (2 * pairs + 1, two[1])]
        pairs += 1
    got = {r.doc_id: r.group_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= 295


def test_candidates_are_those_of_the_plain_rules():
    """Codes with either sign bit, groups of one's own, sizes at the bound."""
    rng = np.random.default_rng(3)
    near = lambda base: base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False))
    bases = [int(x) for x in rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2)]
    rows = [[int(rng.integers(0, 3)), k, int(rng.choice([79, 80, 100])), *[near(b) for b in bases]] for k in range(60)]
    table = np.array([r[:3] + [c - (1 << 64) if c >> 63 else c for c in r[3:]] for r in rows], np.int64)
    bits = S._candidates(table[:20], table, 11, 0.8)
    for i, a in enumerate(rows[:20]):
        for j, b in enumerate(rows):
            gaps = [(x ^ y).bit_count() for x, y in zip(a[3:], b[3:], strict=True)]
            ok = (a[0] != b[0] or a[0] == 0) and min(a[2], b[2]) >= 0.8 * max(a[2], b[2]) and min(gaps) <= 11 and sum(gaps) <= S.MOST_BITS
            assert bits[i, j] == (sum(gaps) if ok else -1)
    assert (bits >= 0).sum() > 50
