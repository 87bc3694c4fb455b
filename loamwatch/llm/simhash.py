"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank over range partitions, so neighbours share most leading bits. Runs of up to
128 become leaves, runs of up to 128 leaves branches; every node keeps the bits that all its codes share (a mask
and a pattern). The index joins with itself from the top: pairs of nodes whose shared bits already differ in more
than ``radius`` places are dropped as a whole, and only codes of the surviving leaf pairs are compared. Leaves and
branches are cut by count, so a dense region makes more nodes, not larger ones. Some neighbouring branches are held
together in a task and meet their partners one by one, so a partner goes to a group of branches once, not to each of
them; a group with many partners is dealt to several tasks.

For a radius above 3 the leading bits alone prune little. Then the index is made for several rotations of the
code; two codes within the radius agree, in at least one of them, on the leading block up to radius // rotations
bits, so that bound is used too and every pair is still found. All rotations and codes are one table, told apart by
the column ``turn``, so their number adds rows, not jobs.

A pair of branches returns a spanning forest of its links, nearest first, which keeps all components of codes. A
branch knows the dense regions inside it, so that two branches of one region return a link, not all their pairs.
Components of verified texts need more than a forest: ``near_duplicates`` tests the other pairs too, in tasks that hold
both texts; only links leave them.

Null texts have no words; texts without words have fingerprint zero and link like any other. Repeated rows link.
Very long texts are hashed whole, in blocks of their own. Component ids ignore null document ids; a component of
null ids alone has a null id. Ties of distance are settled by code. Other columns aren't read, so they can't clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwatch.llm.common import AT_ONCE, BUCKETS, blocks, keyed, pairs_with_texts, raw, run_hashes, word_hashes
from loamwatch.operators.components import connected_components
from loamwatch.staging import discard, staged

LEAF, LEAVES, DENSE = 128, 128, 32
#: Up to so many nodes are searched from the root; more get another level. Bits that number the branches of a partition.
ROOT, NUMBERS = 4096, 20
#: Branches held together, by count of partitions or less, and comparisons of branches that a task makes, each on average.
TOGETHER, MEETINGS = 32, 512
#: Bits that the four codes of two texts may differ in: 0.8 similar texts differ in 39 on average (deviation 6), unlike ones in 128.
MOST_BITS = 72
#: Texts of a chunk of a region, at most AT_ONCE shingles.
CHUNK = 1024


def _codes(hashes: np.ndarray, codes: int) -> list[int]:
    """A bit is set if it is in over half of the hashes; further codes are made in the same way from a mix of the same hashes."""
    out = []
    for k in range(codes):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(27)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprint(text: bytes, size: int) -> int:
    """A-Z lower-cased words, shingles of ``size`` words, repeats included; from their XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return _codes(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64), 1)[0]


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, code): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([fingerprint(t, size) for t in raw(block)], pa.int64())], names=["doc_id", "row_key", "code"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_key long, code long")


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z lower-cased words; of the whole sequence if there are fewer words."""
    words = word_hashes(text)
    return np.unique(run_hashes(words, min(size, len(words)))) if len(words) else np.zeros(1, np.uint64)


def text_codes(docs: DataFrame, size: int, codes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n, code0, ...): the number of distinct shingles of every row, and independent codes of them."""
    names = [f"code{k}" for k in range(codes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = [shingle_set(t, size) for t in raw(block)]
            found = np.asarray([_codes(s, codes) for s in sets], np.int64).reshape(-1, codes)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(found[:, k].copy()) for k in range(codes)]], names=["doc_id", "row_key", "n", *names])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_key long, n long, " + ", ".join(f"{n} long" for n in names))


def rotated(code: str, by: str) -> Column:
    """SQL: the code turned left by so many bits of 0 to 64."""
    return F.expr(f"shiftleft({code}, {by}) | shiftrightunsigned({code}, 64 - ({by}))")


def gray_rank(code: Column) -> Column:
    """Place of a code in the binary-reflected Gray sequence; the sign bit is flipped so that signed order is the unsigned one."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


#: Nodes of the index. ``turn`` numbers the indexes of a table; ``own`` has the links inside a branch, ``hidden`` says that labels left close pairs out.
_PARTS = ("sizes", "patterns", "masks", "codes", "labels")
_BRANCH = "turn int, node long, pattern long, mask long, sizes binary, patterns binary, masks binary, codes binary, labels binary, own binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in schema.split(", "))])


def _build(prefix_bits: int, how: tuple[int, int, int], mark: Callable):
    """Sorted (turn, code, group) of a partition -> branches. Leaves also end where the leading bits change, so none spans a coarse boundary.

    ``mark`` makes the labels and own links of a branch from its arrays.
    """
    schema = arrow(_BRANCH)

    def branch(turn: int, node: int, codes: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> dict:
        first = codes[starts]
        sizes = np.diff(np.r_[starts, len(codes)])
        free = np.bitwise_or.reduceat(codes ^ np.repeat(first, sizes), starts)
        masks = ~free
        all_free = np.bitwise_or.reduce(free | (first ^ first[0]))
        i64 = lambda x: int(np.uint64(x).astype(np.int64))
        labels, own = mark(Branch(sizes, first & masks, masks, codes), groups, how)
        parts = (sizes.astype("<i4"), first & masks, masks, codes, labels)
        return {"turn": turn, "node": node, "pattern": i64(first[0] & ~all_free), "mask": i64(~all_free), "own": own.astype("<i4").tobytes()} | {n: x.tobytes() for n, x in zip(_PARTS, parts, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << NUMBERS, 0
        shift = np.uint64(64 - prefix_bits) if prefix_bits else None

        def cut(turn: int, codes: np.ndarray, groups: np.ndarray, last: bool) -> tuple[list[dict], int]:
            """Branches of the codes, and where the rest begins that is held back unless these are the last of their turn."""
            nonlocal made
            rows, starts, at, begin, c = [], [0], 0, 0, 0
            lead = codes >> shift if shift is not None else np.zeros(len(codes), np.uint64)
            changes = np.flatnonzero(np.r_[False, lead[1:] != lead[:-1]]).tolist() + [len(codes)]
            while at < len(codes):
                while changes[c] <= at:
                    c += 1
                at = min(at + LEAF, changes[c])
                if len(starts) == LEAVES or at == len(codes):
                    if at == len(codes) and not last:
                        break
                    rows.append(branch(turn, base + made, codes[begin:at], np.asarray(starts) - begin, groups[begin:at]))
                    made += 1
                    begin, starts = at, [at]
                else:
                    starts.append(at)
            return rows, begin

        held: tuple | None = None
        for batch in batches:
            turns, codes, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero(turns[1:] != turns[:-1]) + 1, len(turns)] if len(turns) else []
            lo = 0
            for hi in ends:
                turn = int(turns[lo])
                if held is not None and held[0] != turn:
                    yield pa.RecordBatch.from_pylist(cut(*held, True)[0], schema=schema)
                    held = None
                now = [x[lo:hi] for x in (codes, groups)]
                if held is not None:
                    now = [np.r_[x, y] for x, y in zip(held[1:], now, strict=True)]
                rows, begin = cut(turn, *now, False)
                held = (turn, *[x[begin:] for x in now])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                lo = hi
        if held is not None and len(held[1]):
            yield pa.RecordBatch.from_pylist(cut(*held, True)[0], schema=schema)

    return run


def _near(pattern_a, mask_a, pattern_b, mask_b, radius: int, top: int, top_radius: int) -> np.ndarray:
    """Which node pairs can hold codes within the radius: differences in the bits that both share."""
    diff = (pattern_a[:, None] ^ pattern_b[None, :]) & (mask_a[:, None] & mask_b[None, :])
    near = np.bitwise_count(diff) <= radius
    if top_radius < radius:
        near &= np.bitwise_count(diff & np.uint64(top)) <= top_radius
    return near


def _node_pairs(nodes: DataFrame, how: tuple[int, int, int], shift: int = 0) -> DataFrame:
    """(a, b), a <= b: nodes (turn, node, pattern, mask) that can hold codes within the radius of each other, found from the top of the tree.

    ``shift``: so many low bits of the numbers tell nodes of one parent apart; 64 neighbours get a parent, first
    within a partition, then across partitions.
    """
    u64 = lambda c: c.to_numpy().view(np.uint64)
    count, most = nodes.agg(F.count("*"), F.max(F.col("node").bitwiseAND(F.lit((1 << NUMBERS) - 1)))).first()
    if count <= ROOT:
        # the root has at most ROOT entries; every task gets it by value
        root = nodes.orderBy("turn", "node").toArrow().combine_chunks()
        turns, keys, patterns, masks = root.column(0).to_numpy(), root.column(1).to_numpy(), u64(root.column(2)), u64(root.column(3))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    turn, mine = part.column(0).to_numpy(), part.column(1).to_numpy()
                    at = slice(np.searchsorted(turns, turn.min(), "left"), np.searchsorted(turns, turn.max(), "right"))
                    near = _near(u64(part.column(2)), u64(part.column(3)), patterns[at], masks[at], *how)
                    i, j = np.nonzero(near & (mine[:, None] <= keys[None, at]) & (turn[:, None] == turns[None, at]))
                    yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(keys[at][j])], names=["a", "b"])

        return nodes.mapInArrow(search, "a long, b long")

    up = shift + 6 if most >> shift and shift + 6 < NUMBERS else max(shift, NUMBERS) + 6
    children = nodes.groupBy("turn", F.shiftright("node", up).alias("q")).agg(
        F.array_sort(F.collect_list(F.struct("node", "pattern", "mask"))).alias("entries"), F.min("node").alias("node"),
        F.bit_and("pattern").alias("low"), F.bit_or("pattern").alias("high"), F.bit_and("mask").alias("shared"),
    )
    mask = F.col("shared").bitwiseAND(F.bitwise_not(F.col("low").bitwiseXOR(F.col("high"))))
    parents = staged(children.select("turn", "node", F.col("low").bitwiseAND(mask).alias("pattern"), mask.alias("mask"), "entries"), "gray-parents")
    above = _node_pairs(parents.select("turn", "node", "pattern", "mask"), how, up)
    kids = parents.select("node", "entries")
    pairs = above.join(kids.select(F.col("node").alias("a"), F.col("entries").alias("ea")), "a").join(kids.select(F.col("node").alias("b"), F.col("entries").alias("eb")), "b").select("ea", "eb")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ea, eb = batch.column(0)[k].values, batch.column(1)[k].values
                na, nb = ea.field("node").to_numpy(), eb.field("node").to_numpy()
                i, j = np.nonzero(_near(u64(ea.field("pattern")), u64(ea.field("mask")), u64(eb.field("pattern")), u64(eb.field("mask")), *how) & (na[:, None] <= nb[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(na[i]), pa.array(nb[j])], names=["a", "b"])

    return pairs.mapInArrow(descend, "a long, b long")


class Branch:
    """A branch as arrays: leaf bounds, patterns and masks, codes, and labels of the dense regions inside it."""

    def __init__(self, sizes: np.ndarray, patterns: np.ndarray, masks: np.ndarray, codes: np.ndarray, labels: np.ndarray | None = None):
        self.bounds = np.r_[0, np.cumsum(sizes)]
        self.patterns, self.masks, self.codes = patterns, masks, codes
        self.labels = np.arange(len(codes)) if labels is None else labels.astype(np.int64)


class Labels:
    """Which codes are connected: a union-find over labels, and the label of each code."""

    def __init__(self, label: np.ndarray):
        self.label, self.parent = label.copy(), np.arange(len(label))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Positions of the links, in order, that connect what wasn't connected."""
        taken = []
        for k, (x, y) in enumerate(zip(self.label[u].tolist(), self.label[v].tolist(), strict=True)):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                taken.append(k)
        roots = self.parent[self.parent]
        while (again := roots[roots]).tolist() != roots.tolist():
            roots = again
        self.label = roots[self.label]
        return np.asarray(taken, np.int64)


def _links(a: Branch, b: Branch, radius: int, top: int, top_radius: int) -> tuple[list, list, Labels, bool]:
    """Close places (u, v, distance) of two branches: links of dense regions; all other close pairs; dense labels; and whether labels left close pairs out."""
    same = a is b
    shift = 0 if same else len(a.codes)
    dense = Labels(a.labels if same else np.r_[a.labels, b.labels + shift])
    links: list[tuple] = []
    loose: list[tuple] = []
    left_out = False
    near = _near(a.patterns, a.masks, b.patterns, b.masks, radius, top, top_radius)
    if same:
        near = np.triu(near)
    for i in np.flatnonzero(near.any(axis=1)):
        lo, hi = a.bounds[i], a.bounds[i + 1]
        at = np.concatenate([np.arange(b.bounds[j], b.bounds[j + 1]) for j in np.flatnonzero(near[i])])
        mine = dense.label[lo:hi]
        if hi - lo > 1 and (mine == mine[0]).all():
            left_out = True
            at = at[dense.label[shift + at] != mine[0]]
        if not len(at):
            continue
        gap = np.bitwise_count(a.codes[lo:hi, None] ^ b.codes[at][None, :])
        close = gap <= radius
        count = int(close.sum())
        if count <= DENSE * (hi - lo):
            x, y = np.nonzero(close)
            u, v = lo + x, shift + at[y]
            once = u < v if same else np.ones(len(u), bool)
            ok = once & (dense.label[u] != dense.label[v])
            left_out |= bool(ok.sum() < once.sum())
            loose.append((u[ok], v[ok], gap[x, y][ok]))
            continue
        left_out = True
        for r in range(radius + 1):
            while True:
                open_ = (gap <= r) & (dense.label[lo:hi][:, None] != dense.label[shift + at][None, :])
                columns = np.flatnonzero(open_.any(axis=0))
                if not len(columns):
                    break
                rows = np.where(open_[:, columns], gap[:, columns], 255).argmin(axis=0)
                u, v = lo + rows, shift + at[columns]
                taken = dense.join(u, v)
                links.append((u[taken], v[taken], gap[rows, columns][taken]))
    return links, loose, dense, left_out


def _every(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, distance) of all parts."""
    return tuple(np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.int32)))


def _forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Places of a spanning forest of least distances."""
    order = np.argsort(d, kind="stable")
    return order[Labels(labels).join(u[order], v[order])]


def connect(a: Branch, b: Branch, radius: int, top: int, top_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v, distance) of places in two branches (a may be b; places of b follow those of a), nearest first, that join codes not connected yet; and the labels of dense regions.

    Where a leaf's codes have more than DENSE partners each on average, links are made at once, by nearest partner,
    and what they connect isn't compared again: a dense region costs about as much as its codes, not its pairs. All
    other close pairs are gathered, and a spanning forest of least distances is kept.
    """
    links, loose, dense, _ = _links(a, b, radius, top, top_radius)
    if loose:
        u, v, d = _every(loose)
        taken = _forest(u, v, d, dense.label)
        links.append((u[taken], v[taken], d[taken]))
    return *_every(links), dense.label


def _mark_forest(own: Branch, groups: np.ndarray, how: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the dense regions of a branch, and its own forest."""
    u, v, d, labels = connect(own, own, *how)
    plain = (labels == np.arange(len(labels))).all()
    return np.zeros(0, "<i4") if plain else labels.astype("<i4"), np.column_stack([u, v, d])


def _candidates(a: np.ndarray, b: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Which texts of two tables (FACTS) to test: in different groups, close in a code, sizes and all codes allow the similarity."""
    size, other = a[:, None, 2], b[None, :, 2]
    ok = ((a[:, None, 0] != b[None, :, 0]) | (a[:, None, 0] == 0)) & (np.minimum(size, other) >= least * np.maximum(size, other))
    bits, close = np.zeros(ok.shape, np.int64), np.zeros(ok.shape, bool)
    for k in range(3, a.shape[1]):
        gap = np.bitwise_count((a[:, None, k] ^ b[None, :, k]).view(np.uint64))
        bits += gap
        close |= gap <= radius
    bits[~(ok & close & (bits <= MOST_BITS * (a.shape[1] - 3) // 4))] = -1
    return bits


def _across(a: Branch, b: Branch, facts: int, least: float, radius: int, top: int, top_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places u of a, v of b, distance) of the pairs of two branches to test that, with the forest inside each, make a spanning forest of both.

    Labels are tables of FACTS, then the place that stands for a text's tree in its branch. Trees of a that meet
    through b are one from then on, so the partners that follow don't link them again.
    """
    same, shift = a is b, 0 if a is b else len(a.codes)
    ta, tb = a.labels.reshape(-1, facts + 1), b.labels.reshape(-1, facts + 1)
    forest = Labels(tb[:, facts] if same else np.r_[ta[:, facts], tb[:, facts] + shift])
    found: list[tuple] = []
    near = _near(a.patterns, a.masks, b.patterns, b.masks, radius, top, top_radius)
    for i in np.flatnonzero(near.any(axis=1)):
        lo, hi = a.bounds[i], a.bounds[i + 1]
        at = np.concatenate([np.arange(b.bounds[j], b.bounds[j + 1]) for j in np.flatnonzero(near[i])])
        tree = forest.label[lo]
        if (forest.label[lo:hi] == tree).all():
            at = at[forest.label[shift + at] != tree]
        if not len(at):
            continue
        x, y = np.nonzero(np.bitwise_count(a.codes[lo:hi, None] ^ b.codes[at][None, :]) <= radius)
        once = (lo + x < at[y]) if same else np.ones(len(x), bool)
        x, y = np.unique(x[once]), np.unique(y[once])
        if not len(x):
            continue
        bits = _candidates(ta[lo + x, :facts], tb[at[y], :facts], radius, least)
        p, q = np.nonzero(bits >= 0)
        u, v, d = lo + x[p], at[y[q]], bits[p, q]
        ok = np.flatnonzero(u != v) if same else np.arange(len(u))
        ok = ok[forest.label[u[ok]] != forest.label[shift + v[ok]]]
        ok = ok[np.argsort(d[ok], kind="stable")]
        ok = ok[forest.join(u[ok], shift + v[ok])]
        found.append((u[ok], v[ok], d[ok]))
    ta[:, facts] = forest.label[: len(ta)]
    return _every(found)


#: Links of codes or texts.
_FOUND = "turn int, a long, b long, distance int"


def _compare(find: Callable, label: str, key: Callable):
    """Rows sorted by (group, salt, partner, node): the branches of a group, which are held, and its partners, each against those that it names in ``whom``. ``key`` names the codes of a branch."""
    schema = arrow(_FOUND)

    def load(batch: pa.RecordBatch, k: int) -> Branch:
        part = lambda i, t: np.frombuffer(batch.column(i)[k].as_py(), t)
        labels = part(9, label)
        return Branch(part(5, "<i4"), part(6, np.uint64), part(7, np.uint64), part(8, np.uint64), labels if len(labels) else None)

    def rows(turn: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), turn, np.int32)), pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                group, salt, partner, turn, node = (batch.column(i)[k].as_py() for i in range(5))
                if now != (group, salt):
                    now, held = (group, salt), {}
                b = load(batch, k)
                keys = key(b)
                if not partner:
                    held[node] = b, keys
                    m = np.frombuffer(batch.column(10)[k].as_py() or b"", "<i4").reshape(-1, 3)  # one of the salts has it
                    if len(m):
                        yield rows(turn, keys[m[:, 0]], keys[m[:, 1]], m[:, 2])
                for a in batch.column(11)[k].as_py():
                    own, names = held[a]
                    u, v, d = find(own, b)
                    if len(u):
                        yield rows(turn, names[u], keys[v], d)

    return run


def _dealt(branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups of neighbouring branches, dealt by (group, salt): the branches of a group, then each partner once, with those that it meets (``whom``)."""
    spark = branches.sparkSession
    count, parts, most = branches.agg(F.count("*"), F.count_distinct(F.shiftright("node", NUMBERS)), F.max(F.col("node").bitwiseAND(F.lit((1 << NUMBERS) - 1)))).first()
    if (most or 0) < TOGETHER:  # a group is some partitions, else a part of one
        shift = NUMBERS + max(0, (TOGETHER * parts // max(count, 1)).bit_length() - 1)
    else:
        shift = TOGETHER.bit_length() - 1
    group = lambda c: F.shiftright(c, shift).alias("group")
    # a group with many meetings is dealt to several tasks, each of which gets its branches
    salts = staged(pairs.groupBy(group("a")).agg(F.ceil(F.count("*") / MEETINGS).cast("int").alias("salts")), "gray-groups")
    meet = pairs.where("a != b").select(group("a"), "a", "b").join(salts, "group").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = branches.select(group("node"), F.lit(None).cast("long").alias("a"), F.col("node").alias("b")).join(salts, "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    columns = ["group", "salt", "a", "b"]
    rows = meet.select(*columns).unionByName(members.select(*columns)).groupBy("group", "salt", F.col("b").alias("node")).agg(F.sort_array(F.collect_list("a")).alias("whom"))
    partner = group("node") != F.col("group")
    own = F.when(~partner & (F.col("salt") == 0), F.col("own")).alias("own")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), salts.agg(F.coalesce(F.sum("salts"), F.lit(0))).first()[0])
    joined = rows.join(branches, "node").select("group", "salt", partner.alias("partner"), "turn", "node", *_PARTS, own, "whom")
    return joined.repartition(tasks, "group", "salt").sortWithinPartitions("group", "salt", "partner", "node")


def _searched(rows: DataFrame, n: int, how: tuple[int, int, int], mark: Callable, find: Callable, label: str, key: Callable) -> DataFrame:
    """The index of ``rows`` (turn, code, key, group), n a turn, joined with itself: what ``find`` finds."""
    prefix = min(16, max(0, (n // LEAF).bit_length() - 1))
    order = ["turn", "rank", "key"]
    ordered = rows.withColumn("rank", gray_rank(F.col("code"))).repartitionByRange(*order).sortWithinPartitions(*order).select("turn", "code", "group")
    branches = staged(ordered.mapInArrow(_build(prefix, how, mark), _BRANCH), "gray-branches")
    pairs = staged(_node_pairs(branches.select("turn", "node", "pattern", "mask"), how), "gray-pairs")
    found = staged(_dealt(branches, pairs).mapInArrow(_compare(find, label, key), _FOUND), "gray-links")
    discard(branches)  # the largest table of the index
    discard(pairs)
    return found


def _how(radius: int, rotations: int) -> tuple[int, int, int]:
    """The radius, the leading block, and in how many of its bits two codes may differ in one of the rotations."""
    width = 64 // rotations
    return radius, ((1 << width) - 1) << (64 - width), radius // rotations


def close_codes(codes: DataFrame, radius: int, rotations: int = 1) -> DataFrame:
    """(u, v, distance): links between distinct codes within the radius that keep all components."""
    distinct = staged(codes.select("code").distinct(), "codes")
    how, width = _how(radius, rotations), 64 // rotations
    turns = distinct.select("code", F.explode(F.array(*[F.lit(t) for t in range(rotations)])).alias("turn"))
    rows = turns.select("turn", rotated("code", f"turn * {width}").alias("code")).withColumns({"key": F.col("code"), "group": F.lit(0).cast("long")})

    def find(a: Branch, b: Branch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, d, _ = connect(a, b, *how)
        return u, v - len(a.codes), d

    found = _searched(rows, distinct.count(), how, _mark_forest, find, "<i4", lambda branch: branch.codes.view(np.int64))
    back = f"64 - turn * {width}"
    return found.select(rotated("a", back).alias("u"), rotated("b", back).alias("v"), "distance")


def near_components(codes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, row_key, code, component_id) from (doc_id, row_key, code) and links between codes."""
    labels = connected_components(links)
    least = codes.groupBy("code").agg(F.min("doc_id").alias("least"))
    placed = least.join(labels.withColumnRenamed("node", "code"), "code", "left").select("code", F.coalesce("component", "code").alias("component"), "least")
    owner = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_code = placed.select("code", "component").join(owner, "component").select("code", "component_id")
    return codes.join(by_code, "code").select("doc_id", "row_key", "code", "component_id")


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes = staged(fingerprints(docs, 3), "fingerprints")
    found = near_components(codes, close_codes(codes, 2))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def _test(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: sets of texts (b is null), then the pairs to test."""
        now, sets = None, {}
        for batch in batches:
            block, a, b, data = (batch.column(i) for i in range(4))
            out = []
            for k, (n, x, y) in enumerate(zip(block.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)):
                if n != now:
                    now, sets = n, {}
                if y is None:
                    sets[x] = np.frombuffer(data[k].as_py(), np.uint64)
                    continue
                s, t = sorted((sets[x], sets[y]), key=len)
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                shared = int((t[at] == s).sum())
                if shared >= least * (len(s) + len(t) - shared):
                    out.append(k)
            take = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    return run


def similar_texts(pairs: DataFrame, docs: DataFrame, size: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of pairs (a, b, n) of row keys, those whose texts share at least ``least`` of their distinct shingles (Jaccard); n weighs a pair by its shingles.

    Pairs are cut into blocks, and a text's set goes to each block once, not to each pair.
    """
    dealt = pairs_with_texts(pairs, docs, lambda t: shingle_set(t, size).tobytes(), id_col, text_col)
    return dealt.mapInArrow(_test(least), "a long, b long")


def _plausible(pairs: DataFrame, texts: DataFrame, names: list[str], least: float) -> DataFrame:
    """(a, b, n) of the pairs (a, b) whose sizes and codes allow the similarity."""
    side = lambda x: texts.select(F.col("row_key").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}{x}") for c in names])
    bits = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in names), F.lit(0))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((F.least("na", "nb") >= least * F.greatest("na", "nb")) & (bits <= MOST_BITS * len(names) // 4))
    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _test_blocks(radius: int, least: float, facts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (region, i, j, chunk, facts, data) sorted by block: links that connect groups of chunks i and j, most alike codes first."""
        names = ["a", "b"]

        def links(i: int, j: int, chunk: list, table: list, sets: list) -> pa.RecordBatch:
            table, chunk = np.stack(table), np.asarray(chunk)
            one, two = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            groups, label = np.unique(table[:, 0], return_inverse=True)
            alone = table[:, 0] == 0
            label[alone] = len(groups) + np.flatnonzero(alone)
            joined = Labels(np.arange(len(groups) + len(table)))
            found = []
            for lo in range(0, len(one), 256):
                part = one[lo : lo + 256]
                bits = _candidates(table[part], table[two], radius, least)
                x, y = np.nonzero(bits >= 0)
                found.append((part[x], two[y], bits[x, y]))
            u, v, d = _every(found)
            once = u < v if i == j else np.ones(len(u), bool)
            u, v, d = u[once], v[once], d[once]
            out = []
            for k in np.argsort(d, kind="stable"):
                p, q = joined.root(int(label[u[k]])), joined.root(int(label[v[k]]))
                if p == q:
                    continue
                s, t = sorted((sets[u[k]], sets[v[k]]), key=len)
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                shared = int((t[at] == s).sum())
                if shared >= least * (len(s) + len(t) - shared):
                    joined.parent[max(p, q)] = min(p, q)
                    out.append(k)
            key = table[:, 1]
            return pa.RecordBatch.from_arrays([pa.array(key[u[out]]), pa.array(key[v[out]])], names=names)

        now, held = None, ([], [], [])
        for batch in batches:
            for region, i, j, chunk, fact, data in zip(*(batch.column(k) for k in range(6)), strict=True):
                block = (region.as_py(), i.as_py(), j.as_py())
                if block != now:
                    if now is not None:
                        yield links(*now[1:], *held)
                    now, held = block, ([], [], [])
                for part, x in zip(held, (chunk.as_py(), fact.values.to_numpy(), np.frombuffer(data.as_py(), np.uint64)), strict=True):
                    part.append(x)
        if now is not None:
            yield links(*now[1:], *held)

    return run


def _links_of_regions(regions: DataFrame, known: DataFrame, docs: DataFrame, size: int, radius: int, least: float, facts: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between texts of a region (node, component) in different groups, found where the texts are.

    A region is cut into chunks of about CHUNK texts or AT_ONCE shingles; a task gets two chunks and returns links only.
    """
    spark = docs.sparkSession
    rows = staged(regions.select(F.col("node").alias("row_key"), F.col("component").alias("region")).join(known.select("row_key", "facts"), "row_key"), "near-regions")
    sizes = rows.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.col("facts")[2]) / AT_ONCE)).cast("int").alias("chunks"))
    dealt = rows.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("row_key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = dealt.select("region", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "facts", "row_key")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            sets = [shingle_set(t, size).tobytes() for t in raw(part)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("row_key")), pa.array(sets, pa.binary())], names=["row_key", "data"])

    # texts in no region mostly stay where they are: a table of BUCKETS rows at most tells them
    bucket = F.pmod("row_key", F.lit(BUCKETS)).alias("bucket")
    wanted = F.broadcast(rows.select(bucket).distinct())
    texts = keyed(docs, id_col, text_col).withColumn("bucket", bucket).join(wanted, "bucket", "left_semi").drop("bucket")
    texts = texts.join(rows.select("row_key"), "row_key", "left_semi").groupBy("row_key").agg(F.first("text").alias("text"))
    data = texts.select("row_key", "text").mapInArrow(made, "row_key long, data binary")
    full = block.hint("merge").join(data, "row_key").select("region", "i", "j", "chunk", "facts", "data")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(_test_blocks(radius, least, facts), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, radius: int = 11, rotations: int = 4, least: float = 0.8, codes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, group_id, group_key, first): groups of near-duplicate texts; first marks the one to keep.

    Candidates are all pairs of texts whose codes are within the radius in one of ``codes`` independent codes of
    distinct shingles (texts of similarity 0.8 differ in 10 of 64 bits on average); a pair is a link if the texts'
    shingle sets have a Jaccard similarity of at least ``least``. First a forest is tested: each text with the first
    text of its code, and links that connect the close codes. Then one index of all codes and rotations, which
    knows the components so far, gives a forest of the candidate pairs between different components. Its trees are
    regions: every candidate pair left lies in one. A region is cut into chunks, two chunks with their shingle sets
    meet in a task, and each candidate pair is tested there unless tested links connect it already.
    """
    names = [f"code{k}" for k in range(codes)]
    coded = staged(text_codes(docs, size, codes, id_col, text_col), "near-codes")
    texts = staged(coded.groupBy("row_key").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in names]), "near-texts")
    n, how, width = texts.count(), _how(radius, rotations), 64 // rotations

    by_code = texts.select(F.col("code0").alias("code"), "row_key")
    heads = staged(by_code.groupBy("code").agg(F.min("row_key").alias("head")), "near-heads")
    side = lambda x, y: heads.select(F.col("code").alias(x), F.col("head").alias(y))
    forest = close_codes(heads, radius, rotations).join(side("u", "a"), "u").join(side("v", "b"), "v").select("a", "b")
    pairs = _unordered(forest.unionByName(by_code.join(heads, "code").select(F.col("row_key").alias("a"), F.col("head").alias("b"))))
    tested = staged(_plausible(pairs, texts, names, least), "near-tested")
    links = staged(similar_texts(tested, docs, size, least, id_col, text_col), "near-links")
    labels = staged(connected_components(links, "a", "b"), "near-labels")

    facts = 3 + codes
    known = texts.join(labels.withColumnRenamed("node", "row_key"), "row_key", "left").withColumn("facts", F.array(F.coalesce("component", F.lit(0)), "row_key", "n", *names))
    known = staged(known.select("row_key", "facts", *names), "near-facts")
    turned = F.explode(F.array(*[F.struct(F.lit(c * rotations + t).alias("turn"), rotated(name, f"{t * width}").alias("code")) for c, name in enumerate(names) for t in range(rotations)]))
    rows = known.select("row_key", "facts", turned.alias("t")).select("t.turn", "t.code", F.col("row_key").alias("key"), F.col("facts").alias("group"))

    def find(a: Branch, b: Branch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _across(a, b, facts, least, *how)

    def mark(own: Branch, groups: np.ndarray, how: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        table = np.concatenate(groups).reshape(-1, facts)
        own.labels = np.column_stack([table, np.arange(len(table))]).ravel()
        links = np.column_stack(find(own, own))
        return own.labels, links

    found = _searched(rows, n, how, mark, find, "<i8", lambda branch: branch.labels.reshape(-1, facts + 1)[:, 1])
    regions = staged(connected_components(found, "a", "b"), "near-regions")
    fresh = staged(_links_of_regions(regions, known, docs, size, radius, least, facts, id_col, text_col), "near-links")
    if not fresh.isEmpty():
        labels = staged(connected_components(links.unionByName(fresh), "a", "b"), "near-labels")

    rows = coded.select("doc_id", "row_key").distinct().join(labels.withColumnRenamed("node", "row_key"), "row_key", "left")
    rows = staged(rows.select("doc_id", "row_key", F.coalesce("component", "row_key").alias("component")), "near-rows")
    owner = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("o"))
    joined = rows.join(owner, "component")
    first = F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("row_key") == F.col("o.row_key"))
    return joined.select("doc_id", "row_key", F.col("o.doc_id").alias("group_id"), F.col("o.row_key").alias("group_key"), first.alias("first"))
