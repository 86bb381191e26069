"""N-gram Jaccard join on signature trees.

A pass over the texts counts shingles (five words, 64-bit hashes) inside windows of each task; the FREQUENT most frequent ones
are put last in the order of all shingles. A second pass makes, per document, its number of distinct shingles, a digest of the
set, a bitmap of it (two to four bits a shingle) and the branches of the tree that it hangs on. Then:

1. Equal sets are one node (a partial aggregate, so thousands of copies cost one row a partition).
2. The root of the index branches by shingle. A node hangs on the first n - ceil(3n/4) + 1 shingles of its set in the common
   order: two sets with a Jaccard of 0.75 share one of those, so node pairs that share no branch have too small an overlap, by
   construction. That is exact: it is the largest possible overlap without a common branch. Which shingles come last is a matter
   of speed only, any fixed order gives the same links. The smaller of two such sets has one of them even among its first
   n - ceil(6n/7) + 1, so branches where no node has the shingle there are dropped. Branches with the same nodes are one.
3. Below a branch, nodes are sorted and stacked into a tree whose inner nodes hold OR-combined bitmaps, size ranges and ranges
   of components. A dual traversal drops pairs of tree nodes whose largest possible overlap, sizes or single component rule out
   a new link. A branch over CAP nodes is split by size class and hash into parts with a tree each; pairs of parts whose size
   or component ranges rule out a new link are dropped before their rows are sent.
4. The traversal of a branch makes ties first: pairs that are likely to link by the bitmaps, siblings in the leaves before
   others, and of those that tie groups of nodes a forest. All pairs that are left between two tied groups come
   later, each in the first branch that both ends share, as far as they carry them along. Parts of
   a large branch are traversed by themselves, then across. Ties are verified on the whole sets, 100 * intersection >= 75 * union,
   in pieces of PIECE shingles at most; branches that hold a tie that failed are traversed again on the components found so
   far, without ties; and of all later pairs those between two components are verified.

Pairs whose link can't change the components are not made: the result is the components, and no link between components is
lost. Shingles and sets are told apart by 64-bit hashes.

Defined results: null, empty or blank texts have no shingles and link with nothing; texts under 5 words are one shingle; a
null doc_id has a null component; a repeated doc_id is one document that links by any of its rows; empty table: no rows.
Extra columns are not read. Ties: the smaller doc_id leads. A long text is hashed CHUNK bytes at a time: 20 bytes a word are held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, maybe_among, slices, small_batches
from .components import connected_components, union_find

WORDS, CAP, LEAF, FAN = 5, 2048, 8, 4
FREQUENT, WINDOW, OFTEN, MARGIN = 1 << 17, 2_000_000, 4, 0.85
CHUNK, PIECE, MOST_BITS, FIRST = 1 << 20, 1 << 15, 1 << 13, 16
NO_BRANCH = np.int64(2**63 - 1)
BITMAP = 1 << 23
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(6).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and polynomial sum of each word, by one rolling hash over all bytes together."""
    if len(data) > len(_powers.get("up", ())):
        n = max(len(data), 1 << 16)
        _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P)]))
        _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]))
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    stop = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers["up"][: len(data)])])
    return start, (stop - start).astype(np.uint64), (total[stop] - total[start]) * _powers["down"][start]


def _set(w: np.ndarray) -> np.ndarray:
    """Distinct shingles of a text's word hashes, sorted."""
    n = len(w)
    if n < WORDS:
        return mix((w * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64), n) if n else np.zeros(0, np.uint64)
    s = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        s += w[i : n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(mix(s))


def _long(raw) -> np.ndarray:
    """The shingles of one long text, CHUNK bytes at a time; a word that chunks cut is put together from its parts."""
    words, part = [], None
    for a in range(0, len(raw), CHUNK):
        data = _LOWER[np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - a), a)]
        start, size, total = _words(data)
        if part is not None:
            if len(start) and start[0] == 0:
                total[0] = (part[0] + int(total[0]) * pow(int(_P), part[1], 2**64)) % 2**64
                size[0] += np.uint64(part[1])
            else:
                words.append(mix(np.array([(part[0] + part[1]) % 2**64], np.uint64)))
            part = None
        if a + CHUNK < len(raw) and not (data[-1] == 32 or 9 <= data[-1] <= 13):
            part = (int(total[-1]), int(size[-1]))
            total, size = total[:-1], size[:-1]
        words.append(mix(total + size))
    if part is not None:
        words.append(mix(np.array([(part[0] + part[1]) % 2**64], np.uint64)))
    return _set(np.concatenate(words)) if words else np.zeros(0, np.uint64)


def shingles(texts: list) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. Texts: strings, bytes or buffers; null counts as empty."""
    raw = [t.encode() if isinstance(t, str) else b"" if t is None else memoryview(t) for t in texts]
    out: list = [None] * len(raw)
    few = [i for i, r in enumerate(raw) if len(r) <= CHUNK]
    for i, r in enumerate(raw):
        if len(r) > CHUNK:
            out[i] = _long(r)
    if few:
        ends = np.cumsum([len(raw[i]) + 1 for i in few])
        start, size, total = _words(_LOWER[np.frombuffer(b"\n".join([*[raw[i] for i in few], b""]), np.uint8)])
        w = mix(total + size)
        cut = np.searchsorted(start, ends)
        s = np.zeros(max(len(w) - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            s += w[k : k + len(s)] * _PLACE[k]
        s, a = mix(s), 0
        for i, b in zip(few, cut.tolist(), strict=True):
            out[i] = np.unique(s[a : b - WORDS + 1]) if b - a >= WORDS else _set(w[a:b])
            a = b
    return out


def _texts(b: pa.RecordBatch) -> list:
    """The texts' bytes, in place."""
    return [x.as_buffer() for x in b.column("text")]


def signature(s: np.ndarray) -> bytes:
    """Two bitmaps of the set, whose halves fold onto each other: which hash values occur (the power of two that is at least
    its size, from 64 to MOST_BITS), and, twice as wide, which occur an odd number of times. Trees combine the first by OR;
    two of the second differ in as many bits as the sets have different shingles, at most."""
    bits = min(MOST_BITS, max(64, 1 << int(len(s) - 1).bit_length()))
    at = s * _P >> np.uint64(13)
    some = np.zeros(bits, bool)
    some[at & np.uint64(bits - 1)] = True
    odd = np.bincount((at & np.uint64(2 * bits - 1)).astype(np.int64), minlength=2 * bits) & 1
    return np.packbits(np.concatenate([some, odd.astype(bool)]), bitorder="little").tobytes()


def digest(s: np.ndarray) -> int:
    """A number that stands for the set."""
    return int(mix(mix(s, 1).sum(keepdims=True, dtype=np.uint64) ^ mix(s, 2).sum(keepdims=True, dtype=np.uint64) * _P, len(s)).view(np.int64)[0])


def branches(sets: list[np.ndarray], often: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Of each set the first n - ceil(3n/4) + 1 shingles: those not in often (sorted) by hash, then those in it by place."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(often, flat), max(len(often) - 1, 0))
    known = often[at] == flat if len(often) else np.zeros(len(flat), bool)
    out, a = [], 0
    for s in sets:
        n = len(s)
        m, need = known[a : a + n], n - (3 * n + 3) // 4 + 1 if n else 0
        first = s[~m][:need]
        if len(first) < need:
            rest = np.flatnonzero(m)
            rest = rest[np.argsort(place[at[a : a + n][rest]])][: need - len(first)]
            first = np.concatenate([first, s[rest]])
        out.append(first)
        a += n
    return out


# ---- signature trees
def _fold(bits: np.ndarray, words: int, ufunc=np.bitwise_or) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = ufunc(bits[:, :half], bits[:, half:])
    return bits


class Tree:
    """Levels from the nodes of sets (0) up; each holds OR-combined bitmaps, size ranges, hash collisions and component ranges."""

    def __init__(self, bits: np.ndarray, odd: np.ndarray, n: np.ndarray, comp: np.ndarray) -> None:
        self.odd, self.n = odd, n
        spare = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, n, n, spare, comp, comp)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp, c0, c1 = self.levels[-1]
            at = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
            fan = FAN

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, k: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, at level k, of nodes at level k + 1."""
        if k >= len(self.levels) - 1:
            return node, np.ones(len(node), np.int64)
        fan = LEAF if k == 0 else FAN
        return node * fan, np.minimum(fan, len(self.levels[k][0]) - node * fan)


def _alive(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Node pairs that may still hold a new link."""
    bx, lx, hx, sx, cx, dx = (a[i] for a in x)
    by, ly, hy, sy, cy, dy = (a[j] for a in y)
    shared = np.bitwise_count(bx & by).sum(axis=1).astype(np.int64)
    most = np.minimum(np.minimum(hx, hy), shared + np.minimum(sx, sy))
    one = (cx == dx) & (cy == dy) & (cx == cy)
    return (7 * most >= 3 * (lx + ly)) & (4 * hx >= 3 * ly) & (4 * hy >= 3 * lx) & ~one


def dual(x: Tree, y: Tree, likely: bool = False):
    """Arrays of pairs (rows of x, rows of y) that survive, or that are likely to link; once each if x is y. Depth first, a bounded number of node pairs
    at a time, so memory doesn't follow the number of pairs."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, i, j = todo.pop()
        ok = _alive(x.level(k), y.level(k), i, j)
        i, j = i[ok], j[ok]
        if k == 0:
            if same:
                i, j = i[i < j], j[i < j]
            ok = possible(x.odd, x.n, y.odd, y.n, i, j, likely)
            if ok.any():
                yield i[ok], j[ok]
            continue
        for a in range(0, len(i), 1024):
            (fi, ni), (fj, nj) = x.children(k - 1, i[a : a + 1024]), y.children(k - 1, j[a : a + 1024])
            m = ni * nj
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(nj, m)
            p, q = np.repeat(fi, m) + at // wide, np.repeat(fj, m) + at % wide
            ok = p <= q if same else slice(None)
            p, q = p[ok], q[ok]
            todo += [(k - 1, p[c : c + 16_384], q[c : c + 16_384]) for c in range(0, len(p), 16_384)]


def possible(xo, xn, yo, yn, i, j, likely: bool = False) -> np.ndarray:
    """The tightest bound on pairs: sets that link differ in a seventh of their sizes' sum at most, and so do the odd bitmaps.
    likely: instead, whether the number of different shingles that the bitmaps suggest is small enough by a margin."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 20_000):
        p, q = i[a : a + 20_000], j[a : a + 20_000]
        d = np.bitwise_count(xo[p] ^ yo[q]).sum(axis=1).astype(np.int64)
        if likely:
            m = 64.0 * xo.shape[1]
            d = -m / 2 * np.log(1 - np.minimum(2 * d / m, 0.999)) / MARGIN
        out[a : a + 20_000] = 7 * d <= xn[p] + yn[q]
    return out


def _bits(sigs: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Both bitmaps of signatures of one width, folded to `words` of the first."""
    both = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)
    w = both.shape[1] // 3
    return _fold(both[:, :w], words), _fold(both[:, w:], 2 * words, np.bitwise_xor)


def _tie(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the rows i and j are tied."""
    if not len(i):
        return label
    nodes, root = union_find(label[i], label[j])
    new = np.arange(label.max() + 1)
    new[nodes] = root
    return new[label]


def _few(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs that tie labels, a number below that of the labels that ties them as well; and the labels after it."""
    out_i, out_j = [], []
    while True:
        live = label[i] != label[j]
        i, j = i[live], j[live]
        if not len(i):
            return label, np.concatenate([*out_i, i]), np.concatenate([*out_j, j])
        # each label's first pair to a smaller label: no cycle, so a forest
        high = np.maximum(label[i], label[j])
        at = np.unique(high, return_index=True)[1]
        out_i.append(i[at])
        out_j.append(j[at])
        label = _tie(label, i[at], j[at])


def _met(first: np.ndarray, key: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows i and j share one of their first branches before this one. first: sorted keys, NO_BRANCH after the last."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 10_000):
        x, y = first[i[a : a + 10_000]], first[j[a : a + 10_000]]
        out[a : a + 10_000] = ((x[:, :, None] == y[:, None, :]) & (x < key)[:, :, None]).any(axis=(1, 2))
    return out


def block_pairs(ids, n, comp, low, sigs, side=None, ties: bool = False, first=None, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one branch, one a row, and whether they come later than the ties. side: keep only pairs across sides
    (two parts of one branch). first: each row's first branches; a later pair that shares one before this is made there."""
    words = np.array([len(s) // 24 for s in sigs])
    label = np.unique(comp, return_inverse=True)[1].ravel()
    sides = [np.ones(len(ids), bool)] if side is None else [side == 0, side == 1]
    last = len(sides) - 1
    out: list = []

    def traverse(likely: bool):
        """Pairs between two labels, some at a time; whoever takes them may tie labels meanwhile."""
        order = np.lexsort((ids, n, low, label))
        groups = [{w: order[(words[order] == w) & s[order]] for w in np.unique(words[s]).tolist()} for s in sides]
        for w in sorted(set().union(*groups)):
            trees: dict = {}
            for a, b in [(w, w), (w, 2 * w)] + ([(2 * w, w)] if side is not None else []):
                x, y = groups[0].get(a), groups[last].get(b)
                if x is None or y is None:
                    continue
                for key, rows in (((0, a), x), ((last, b), y)):
                    if key not in trees:
                        trees[key] = Tree(*_bits([sigs[r] for r in rows], w), n[rows], label[rows])
                for i, j in dual(trees[0, a], trees[last, b], likely):
                    i, j = x[i], y[j]
                    ok = label[i] != label[j]
                    yield i[ok], j[ok]

    if ties and side is None:  # siblings in the leaves
        order = np.lexsort((ids, n, low, label))
        for w in np.unique(words).tolist():
            rows = order[words[order] == w]
            odd = _bits([sigs[r] for r in rows], w)[1]
            for step in range(1, LEAF // 2):
                i, j = rows[:-step], rows[step:]
                at = np.flatnonzero(label[i] != label[j])
                at = at[possible(odd, n[rows], odd, n[rows], at, at + step, True)]
                label, i, j = _few(label, i[at], j[at])
                out.append((i, j))
    if ties:
        for i, j in traverse(True):
            label, i, j = _few(label, i, j)
            out.append((i, j))
    tied = sum(len(i) for i, _ in out)
    for i, j in traverse(False):
        new = slice(None) if first is None else ~_met(first, key, i, j)
        out.append((i[new], j[new]))
    i, j = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1), np.arange(len(i)) >= tied


# ---- stages
def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent shingles, sorted, and the place of each from the rarest on. Counts come from windows of WINDOW
    shingles, where a shingle counts from OFTEN on, so rows follow what repeats and not the corpus. They only set an order."""

    def run(batches):
        def counts(held):
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v[c >= OFTEN].view(np.int64)), pa.array(c[c >= OFTEN])], ["s", "c"])

        held, size = [], 0
        for batch in batches:
            for b in slices(batch, limit=CHUNK):
                for s in shingles(_texts(b)):
                    held.append(s)
                    size += len(s)
                if size > WINDOW:
                    yield counts(held)
                    held, size = [], 0
        if size:
            yield counts(held)

    top = small_batches(docs).select("text").mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()
    s = top.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return s[order], (len(s) - np.arange(len(s)))[order]


def sketch(docs: DataFrame, often: np.ndarray, place: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in slices(batch, limit=CHUNK):
                sets = shingles(_texts(b))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(s[:1].view(np.int64).sum()) for s in sets], pa.int64())]
                    + [pa.array([k.view(np.int64) for k in branches(sets, often, place)], pa.list_(pa.int64())), pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())],
                    ["doc_id", "node", "n", "low", "keys", "sig"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, n long, low long, keys array<long>, sig binary")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, k, p, set): the sets of the documents of ids and some more, in the pieces of each level that a partner may ask for.
    The ids go out as a bitmap of hashes of fixed size (1 MB), whatever their number: it saves work on most other documents,
    and a join follows."""
    pos = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITMAP)) + 1
    rows = ids.select(pos.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    want = np.zeros(BITMAP + 1, bool)
    for r in rows:  # bucket k holds positions (k - 1) * 32768 + 1 .. k * 32768
        want[(r.bucket - 1) * 32768 + 1 : r.bucket * 32768 + 1] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little").astype(bool)
    packed, piece = np.packbits(want), PIECE

    def run(batches):
        flags = np.unpackbits(packed).astype(bool)
        names = ["node", "k", "p", "set"]
        for batch in batches:
            batch = batch.filter(pa.array(flags[batch.column("p").to_numpy()]))
            for b in slices(batch, limit=CHUNK):
                small = []
                for s in shingles(_texts(b)):
                    node = digest(s)
                    for k in range(level(len(s), piece), level(-(-4 * len(s) // 3), piece) + 1):
                        if k == 0:
                            small.append((node, s.view(np.int64)))
                            continue
                        cut = [0, *np.searchsorted(s, np.arange(1, 1 << k, dtype=np.uint64) << np.uint64(64 - k)).tolist(), len(s)]
                        for p in range(1 << k):
                            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([k], pa.int32()), pa.array([p], pa.int32()), pa.array([s[cut[p] : cut[p + 1]].view(np.int64)], pa.list_(pa.int64()))], names)
                zero = pa.array(np.zeros(len(small), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in small], pa.int64()), zero, zero, pa.array([x for _, x in small], pa.list_(pa.int64()))], names)

    return small_batches(docs).filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text", pos.alias("p")).mapInArrow(run, "node long, k int, p int, set array<long>")


def level(n: int, piece: int) -> int:
    """How often a set of n is halved by hash, so that pieces hold about `piece` shingles."""
    return (max(n - 1, 0) // piece).bit_length()


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of nodes whose whole sets link. Long sets meet piece by piece, by ranges of the hash."""
    of = [nodes.select(F.col("node").alias(x), F.col("doc").alias(f"d{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
    asked = materialize(spark, pairs.join(of[0], "a").join(of[1], "b").distinct(), f"{name}-asked")
    sets = _sets(docs, asked.select(F.explode(F.array("da", "db")).alias("doc_id")).distinct())
    rows = asked.withColumn("k", F.expr(f"CASE WHEN greatest(na, nb) <= {PIECE} THEN 0 ELSE length(bin((greatest(na, nb) - 1) div {PIECE})) END"))
    rows = rows.withColumn("p", F.explode(F.expr("sequence(0, shiftleft(1, k) - 1)"))).select("a", "b", "na", "nb", "k", "p")
    both = rows.join(sets.select(F.col("node").alias("a"), "k", "p", F.col("set").alias("sa")), ["a", "k", "p"]).join(sets.select(F.col("node").alias("b"), "k", "p", F.col("set").alias("sb")), ["b", "k", "p"])
    part = both.select("a", "b", "na", "nb", "p", F.size(F.array_intersect("sa", "sb")).alias("i")).groupBy("a", "b", "na", "nb", "p").agg(F.max("i").alias("i"))  # a repeated row is one
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("i").alias("i")).filter(100 * F.col("i") >= 75 * (F.col("na") + F.col("nb") - F.col("i")))
    out = materialize(spark, total.select("a", "b"), name)
    drop(spark, asked)
    return out


def _trees(ties: bool):
    """Branches arrive sorted by key; one at a time is held (2 * CAP rows at most)."""
    names = ["key", "i", "j", "node", "n", "comp", "low", "side", "sig", "first"]

    def done(rows: pa.Table):
        key = np.stack([rows.column(c).to_numpy() for c in names[:3]], axis=1)
        ids, n, comp, low, side = (rows.column(c).to_numpy() for c in names[3:8])
        sigs, lists = rows.column("sig").to_pylist(), rows.column("first").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        first = np.full((len(ids), FIRST), NO_BRANCH)
        first[np.arange(FIRST) < sizes[:, None]] = lists.flatten().to_numpy()
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        out = [np.zeros((0, 3), np.int64)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                pairs, later = block_pairs(ids[a:b], n[a:b], comp[a:b], low[a:b], sigs[a:b], side[a:b] if key[a, 1] != key[a, 2] else None, ties, first[a:b], key[a, 0])
                out.append(np.column_stack([pairs, later]))
        x = np.unique(np.concatenate(out), axis=0)
        x = x[(x[:, 0] < x[:, 1]) & np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)][: len(x)]]
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2] == 1)], ["a", "b", "later"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in names[:3])
            cols = [b.column(c).to_numpy() for c in names[:3]]
            tail = np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]) | (cols[2] != last[2]))
            at = int(tail[-1]) + 1 if len(tail) else 0
            if at:
                yield done(pa.Table.from_batches([*held, b.slice(0, at)]))
                held = []
            elif held and tuple(held[-1].column(c)[0].as_py() for c in names[:3]) != last:
                yield done(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(at))
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _candidates(spark: SparkSession, blocks: DataFrame, nodes: DataFrame, ties: bool, across: bool) -> DataFrame:
    """blocks(key, node, comp, c): the pairs (a, b, later) that the trees of all branches leave over; across: those between two
    parts of a large branch too (else each part by itself)."""
    rows = blocks.join(nodes.select("node", "n", "low", "sig", "first"), "node")
    none = F.lit(0).cast("long")
    parted = rows.filter(F.col("c") <= CAP).select("key", none.alias("i"), none.alias("j"), "node", "n", "comp", "low", none.alias("side"), "sig", "first")
    large = blocks.filter(F.col("c") > CAP)
    if not large.isEmpty():
        kind = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9)  # sizes that link are at most one class apart
        plain = large.join(nodes.select("node", "n"), "node").withColumn("kind", kind)
        plain = plain.join(plain.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("m")), ["key", "kind"])
        plain = plain.withColumn("part", F.col("kind") * (1 << 24) + F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("m") / CAP))).select("key", "node", "n", "comp", "part")
        if across:
            plain = materialize(spark, plain, "parts")
            of = plain.groupBy("key", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
            p, q = (of.select("key", *[F.col(c).alias(f"{c}{x}") for c in ("part", "lo", "hi", "c0", "c1")]) for x in "pq")
            one = (F.col("c0p") == F.col("c1p")) & (F.col("c0q") == F.col("c1q")) & (F.col("c0p") == F.col("c0q"))
            pairs = p.join(q, "key").filter((F.col("partp") <= F.col("partq")) & (4 * F.col("hip") >= 3 * F.col("loq")) & (4 * F.col("hiq") >= 3 * F.col("lop")) & ~one).select("key", F.col("partp").alias("i"), F.col("partq").alias("j"))
            ends = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
            plain = plain.join(ends, ["key", "part"]).withColumn("side", F.when(F.col("part") == F.col("i"), 0).otherwise(1).cast("long"))
        else:
            plain = plain.withColumn("i", F.col("part")).withColumn("j", F.col("part")).withColumn("side", none)
        parted = parted.unionByName(plain.join(nodes.select("node", "low", "sig", "first"), "node").select("key", "i", "j", "node", "n", "comp", "low", "side", "sig", "first"))
    return parted.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_trees(ties), "a long, b long, later boolean").groupBy("a", "b").agg(F.min("later").alias("later"))


def _mixed(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Branches (key, node, c) with more than one component below them, and their nodes' components."""
    rows = blocks.join(comps.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "c", F.coalesce("component", "node").alias("comp"))
    spread = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return rows.join(spread, "key")


def _nodes(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes(node, doc): each set and its smallest doc_id; nodes: one row of the sketch for each. Only rows of sets that
    several rows have are shuffled."""
    usable = rows.filter("n > 0 and doc_id is not null")
    classes = materialize(spark, usable.groupBy("node").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("times")), "classes")
    marked = maybe_among(usable, classes.filter("times > 1"), "node", "copied")
    lone = marked.filter("not copied").drop("copied")
    first = marked.filter("copied").drop("copied").join(classes.select(F.col("doc").alias("doc_id"), "node"), ["doc_id", "node"], "left_semi")
    return classes.drop("times"), materialize(spark, lone.unionByName(first).withColumnRenamed("doc_id", "doc"), "nodes")


def _branches(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(key, node, c): the nodes below each branch that two nodes or more hang on."""
    keyed = nodes.select("node", F.posexplode("keys").alias("pos", "key"), "n").select("node", "key", (F.col("pos") <= F.col("n") - F.ceil(6 * F.col("n") / 7)).alias("core"))
    keyed = keyed.repartition("key")  # one exchange for the count and the rows
    below = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("core").alias("core"), F.sum(F.xxhash64("node") % (1 << 52)).alias("sum"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("core and lo < hi")
    below = below.groupBy("c", "sum", "lo", "hi").agg(F.min("key").alias("key")).select("key", "c")
    return materialize(spark, keyed.drop("core").join(below, "key"), "branches")


def join(spark: SparkSession, docs: DataFrame, trace: dict | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, one row a document. trace, for tests, gets each round's pairs and links."""
    docs = docs.select("doc_id", "text")
    rows = materialize(spark, sketch(docs, *frequent(docs)), "sketch")
    usable = rows.filter("n > 0 and doc_id is not null")
    classes, nodes = _nodes(spark, rows)
    blocks = _branches(spark, nodes)
    # the nodes on branches, with their first branches: two that share one of these before another don't have to meet there
    hung = blocks.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("first"))
    hung = materialize(spark, nodes.drop("keys").join(hung, "node"), "hung")
    ties: list[DataFrame] = []
    later: list[DataFrame] = []
    links: list[DataFrame] = []

    def verify(pairs: DataFrame) -> None:
        links.append(verified(spark, docs, pairs, hung, "links"))
        if trace is not None:
            trace.setdefault("rounds", []).append((pairs.count(), links[-1].count()))

    def components() -> DataFrame:
        return materialize(spark, connected_components(spark, _union(links)), "comps")

    def tie(what: DataFrame, across: bool) -> None:
        found = materialize(spark, _candidates(spark, what, hung, True, across), "pairs")
        new = found.filter("not later").select("a", "b")
        for old in ties:
            new = new.join(old, ["a", "b"], "left_anti")
        ties.append(materialize(spark, new, "ties"))
        later.append(found)
        verify(ties[-1])

    tie(blocks.withColumn("comp", F.col("node")), False)
    comps = components()
    large = blocks.filter(F.col("c") > CAP)
    if not large.isEmpty():
        tie(materialize(spark, _mixed(large, comps), "large"), True)
        comps = components()
    failed = _union(ties).join(_union(links), ["a", "b"], "left_anti")
    doubtful = failed.join(blocks.select("key", F.col("node").alias("a")), "a").join(blocks.select("key", F.col("node").alias("b")), ["key", "b"]).select("key").distinct()
    again = materialize(spark, _mixed(blocks.join(doubtful, "key", "left_semi"), comps), "again")
    later.append(materialize(spark, _candidates(spark, again, hung, False, True), "pairs"))
    of = [comps.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    rest = _union([x.filter("later").select("a", "b") for x in later]).distinct().join(_union(ties), ["a", "b"], "left_anti")
    rest = rest.join(of[0], "a", "left").join(of[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    verify(materialize(spark, rest, "rest"))
    # a repeated doc_id is one document: the classes of its texts are one component
    reps = usable.select("doc_id", "node")
    ends = reps.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    several = reps.join(ends, "doc_id").filter("node != a").select("a", F.col("node").alias("b")).distinct()
    links.append(materialize(spark, several, "several"))
    final = materialize(spark, connected_components(spark, _union(links)).withColumnRenamed("id", "node"), "final")
    least = final.join(classes, "node").groupBy("component").agg(F.min("doc").alias("least"))
    lead = classes.join(final.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "doc").alias("least"))
    full = usable.join(lead, "node").select("doc_id", "n", "least")
    # a row without shingles goes where other rows of its doc_id go
    bare = rows.filter("n = 0 or doc_id is null").select("doc_id", "n")
    twins = reps.join(bare.select("doc_id").distinct(), "doc_id").join(lead, "node").groupBy("doc_id").agg(F.min("least").alias("least"))
    out = full.unionByName(bare.join(twins, "doc_id", "left").select("doc_id", "n", F.coalesce("least", "doc_id").alias("least")))
    out = materialize(spark, out.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id")), "joined")
    drop(spark, rows, nodes, hung, blocks, comps, again, final, *ties, *later, *links)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def oracle() -> str:
    """The same by brute force in DuckDB: all pairs of documents that share a shingle, and a recursive walk over the links."""
    return r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS ra, b.r AS rb, a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.r <> b.r AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY ALL),
e AS (SELECT DISTINCT a, b FROM p JOIN n na ON na.r = ra JOIN n nb ON nb.r = rb WHERE 100 * c >= 75 * (na.n + nb.n - c) AND a <> b),
walk(a, b) AS (SELECT a, b FROM e UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
least AS (SELECT a, min(b) AS b FROM walk GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN b < doc_id THEN b ELSE doc_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least ON least.a = doc_id"""
