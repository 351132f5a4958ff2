"""N-gram Jaccard self-join with signature trees.

Two documents link when the Jaccard similarity of their sets of word n-grams is
at least a rational threshold p/q.  The work is done in three steps.

1. *Classes.*  Documents with equal sets form a class, named by its smallest
   doc_id; everything later runs on one document per class, so that exact copies
   cost one small aggregation however many there are.
2. *Buckets.*  Candidates for the trees are brought together by an exact
   pigeonhole split.  Linked sets of at most u members differ in at most
   D = 2u(q-p)/(q+p) of them, so if hash ranges cut the universe in more than D
   parts, one part is identical on both sides.  A passage that many documents
   share does not make a hot bucket, since a part also holds the document's own
   n-grams.  The universe is cut in z parts more than needed, so linked sets agree
   on z + 1; each document may then leave out its up to z parts of fewest rare
   n-grams, by a threshold on that number: of the z + 1 one stays on both sides.
   (Which n-grams are rare is read from counts in a hashed table of fixed size.
   It only decides how selective the buckets are, never what links.)  All members
   of a bucket meet in the group of the bucket's smallest document.
3. *Signature trees.*  A group is cut into blocks of bounded size.  A block's
   sets become the leaves of a tree whose nodes hold the OR of the token bitmaps
   below and the ranges of set size and bitmap weight.  A dual traversal drops
   every node pair whose largest possible overlap cannot reach the threshold.
   First only sizes and bitmaps travel (a sixteenth of the sets' bytes or so), and
   members that nobody in their group can link with go; then the sets of the others
   travel, and pairs of leaves that stay are compared exactly.  Leaves that are
   connected already are not compared again, unless every link is asked for.  In a
   group of several blocks each block is first joined with the group's smallest
   document; only documents that this leaves unconnected go on to the other blocks.

Set members are 64-bit hashes of the n-grams.  Parts are processed as packed
arrays, so a posting costs no JVM row.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing.  A text of fewer than n words is one n-gram, the whole
sequence; long texts are taken whole.  Rows that share a doc_id are one vertex.  A
row without doc_id keeps its set size and gets a null component.  Extra columns,
also ones named like a result, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.llm import id_filter
from cartoframe.llm import textkit as tk
from cartoframe.operators.graph import connected_components
from cartoframe.runtime import Scratch

#: Sets in a block and set members in a block.
BLOCK_SETS, BLOCK_MEMBERS = 2048, 2_000_000
#: Set members whose postings (about 4 bytes for each) meet in one task.
PLACE_MEMBERS = 16_000_000
#: A node of the tree has so many children; a token bitmap has at least this many bits for each member, a power of two between the bounds.
FANOUT, BITS_EACH, BITS_LEAST, BITS_MOST = 8, 2, 256, 1 << 16
#: Counters of the hashed n-gram counts, in so many rows; one above COMMON times the mean marks common n-grams.
COUNTERS, CHUNKS, COMMON = 1 << 19, 16, 3
_RATIO = 1.4


def _bands() -> np.ndarray:
    """Least set size of each size band; bands grow by _RATIO."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * _RATIO)))
    return np.array(low, np.int64)


def _distinct(words: tk.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i of the run has the sorted distinct n-gram hashes hashes[bounds[i]:bounds[i + 1]]."""
    grams = words.grams(n)
    first = words.bounds
    out, bounds = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            s = np.unique(grams[a : b - n + 1])
        elif b > a:
            s = tk.combine(words.hash[a:b], int(b - a))
        else:
            s = grams[:0]
        out.append(s)
        bounds[i + 1] = bounds[i] + len(s)
    return (np.concatenate(out) if out else grams[:0]), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    return tk.mix(_sums(tk.mix(hashes), bounds)), tk.mix(_sums(tk.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds) + np.uint64(1))


def _bits(size: np.ndarray) -> np.ndarray:
    """Bits of the token bitmap of sets of these sizes."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(1, BITS_EACH * size))).astype(np.int64), BITS_LEAST, BITS_MOST)


def _bitmap(hashes: np.ndarray, bits: int) -> bytes:
    """Bit i is set if a member's mixed hash is i modulo `bits`: the halves of a bitmap, OR-combined, are the bitmap of half as many bits."""
    flags = np.zeros(bits, bool)
    flags[(tk.mix(hashes) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2, low, bitmap: the set's size, fingerprints, least hash and token bitmap.  Rows with a `chunk` hold a task's n-gram counts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "k1", "k2", "low", "bitmap", "chunk", "counts"]
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for i, j, words in tk.runs(batch.column(1), tk.SPACE_WORDS):
                hashes, bounds = _distinct(words, n)
                counts += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                k1, k2 = _keys(hashes, bounds)
                size = np.diff(bounds)
                low = [hashes[a].view(np.int64) if k else None for a, k in zip(bounds, size, strict=False)]
                maps = [_bitmap(hashes[a : a + k], w) if k else None for a, k, w in zip(bounds, size, _bits(size), strict=False)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(low, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        if counts.any():
            none = [pa.nulls(CHUNKS, pa.int64())] * 5
            parts = [np.minimum(c, 2**16 - 1).astype(np.uint16).tobytes() for c in np.split(counts, CHUNKS)]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, low long, bitmap binary, chunk int, counts binary")


def _common(sketched: DataFrame) -> np.ndarray:
    """Which counters stand for common n-grams: COUNTERS flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(counts.as_buffer(), np.uint16).astype(np.int64)
                total[chunk] = total[chunk] + x if chunk in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([int(x.sum()) for x in total.values()], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "n", "counts"])

    summed = sketched.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(run, "chunk int, n long, counts binary")
    rows = summed.collect()  # CHUNKS rows, 8 bytes a counter
    limit = max(8, COMMON * sum(r.n for r in rows) / COUNTERS)
    flags = np.zeros((CHUNKS, COUNTERS // CHUNKS), bool)
    for r in rows:
        flags[r.chunk] = np.frombuffer(r.counts, np.int64) > limit
    return flags.reshape(-1)


def _postings(hashes: np.ndarray, bounds: np.ndarray, p: int, q: int, low: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, text numbers) of a run."""
    size = np.diff(bounds)
    keys, texts = [], []
    own = np.searchsorted(low, size, side="right") - 1
    last = np.searchsorted(low, size * q // p, side="right") - 1
    text_of = np.repeat(np.arange(len(size)), size)
    rare = ~common[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
    for step in range(int((last - own)[size > 0].max(initial=-1)) + 1):
        band = own + step
        most = low[np.minimum(band + 1, len(low) - 1)] - 1
        differ = 2 * most * (q - p) // (q + p)
        spare = 2 + -(-(differ + 1) // 8)
        parts = differ + 1 + spare
        use = (size > 0) & (band <= last) & (differ > 0)
        if not use.any():
            continue
        keep = use[text_of]
        h, t, r = hashes[keep], text_of[keep], rare[keep]
        part = ((h >> np.uint64(32)) * parts[t].astype(np.uint64)) >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (part[1:] != part[:-1])]))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(tk.mix(h ^ np.uint64(0x5851F42D4C957F2D)), cut)
            weight = 1 + np.minimum(np.add.reduceat(r.astype(np.int64), cut), 3)  # an empty part has 0
            t, part = t[cut], part[cut]
            salt = (band[t].astype(np.uint64) << np.uint64(44)) + part + np.uint64(1)
            key = tk.mix(total + tk.mix(salt))
        least = np.zeros(len(size), np.int64)  # parts of less weight are left out: at most `spare`, with the empty ones
        for w in (1, 2, 3, 4):
            heavy = np.bincount(t[weight >= w], minlength=len(size))
            least[use & (parts - heavy <= spare)] = w
        chosen = weight >= least[t]
        keys.append(key[chosen])
        texts.append(t[chosen])
        for i in np.flatnonzero(use & (least == 0)):  # more empty parts than may be left out: they count, too
            absent = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[t == i])
            with np.errstate(over="ignore"):
                keys.append(tk.mix(tk.mix((band[i : i + 1].astype(np.uint64) << np.uint64(44)) + absent + np.uint64(1))))
            texts.append(np.full(len(absent), i))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(texts)


def _bucket_edges(docs: DataFrame, n: int, p: int, q: int, common: np.ndarray, members: int) -> DataFrame:
    """(x, h): document x is in a bucket whose smallest document is h < x.  members: size of all sets."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(common))  # COUNTERS bits
    low, places = _bands(), max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), members // PLACE_MEMBERS)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed postings by target place."""
        held_k: list[np.ndarray] = []
        held_d: list[np.ndarray] = []
        held = 0
        flags = np.unpackbits(sent.value).astype(bool)

        def flush():
            key, doc = np.concatenate(held_k), np.concatenate(held_d)
            place = (key % np.uint64(places)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            key, doc, place = key[order], doc[order], place[order]
            cut = np.searchsorted(place, np.arange(places + 1))
            # five bytes of the key; the place tells more of it
            key = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, 3:]
            rows = [(i, key[a:b].tobytes(), doc[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["place", "keys", "docs"])

        for batch in batches:
            column = batch.column(0)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy()
            for i, j, words in tk.runs(batch.column(1), tk.SPACE_WORDS):
                hashes, bounds = _distinct(words, n)
                # copies inside the run are sent once, by the smallest doc_id
                k1, k2 = _keys(hashes, bounds)
                order = np.lexsort((ids[i:j], k2, k1))
                again = np.zeros(j - i, bool)
                again[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
                key, text = _postings(hashes, bounds, p, q, low, flags)
                stay = (~again & known[i:j])[text] if known.all() else known[i:j][text]
                held_k.append(key[stay])
                held_d.append(ids[i:j][text[stay]])
                held += int(stay.sum())
                if held >= 2_000_000:
                    yield flush()
                    held_k, held_d, held = [], [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for place, key, doc in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                a, b = by.setdefault(place, ([], []))
                wide = np.zeros((len(key.as_buffer()) // 5, 8), np.uint8)
                wide[:, 3:] = np.frombuffer(key.as_buffer(), np.uint8).reshape(-1, 5)
                a.append(wide.view(np.uint64).reshape(-1))
                b.append(np.frombuffer(doc.as_buffer(), np.int64).copy())
        for place in list(by):
            a, b = by.pop(place)
            key, doc = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            hub = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            edge = np.unique(np.stack([doc, hub], 1)[doc != hub], axis=0)
            target = (tk.mix(edge[:, 0].view(np.uint64)) % np.uint64(places)).astype(np.int64)
            edge = edge[np.argsort(target, kind="stable")]
            cut = np.searchsorted(np.sort(target), np.arange(places + 1))
            rows = [(i, edge[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["place", "edges"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents share many buckets: each edge once."""
        by: dict[int, list] = {}
        for batch in batches:
            for place, edges in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(place, []).append(np.frombuffer(edges.as_buffer(), np.int64).reshape(-1, 2).copy())
        for place in list(by):
            edge = np.unique(np.concatenate(by.pop(place)), axis=0)
            for i in range(0, len(edge), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(edge[i : i + 100_000, 0]), pa.array(edge[i : i + 100_000, 1])], ["x", "h"])

    packed = docs.mapInArrow(scatter, "place int, keys binary, docs binary").repartition(places, "place").mapInArrow(gather, "place int, edges binary")
    return packed.repartition(places, "place").mapInArrow(unique, "x long, h long")


class Tree:
    """Signature tree; levels[0] are the leaves, `order` tells which set each leaf is.

    size, low: the sets' sizes and least hashes; maps: their token bitmaps.  All are
    brought to the bits of the smallest by OR-combining halves.
    """

    def __init__(self, size: np.ndarray, low: np.ndarray, maps: list[np.ndarray], bits: int | None = None):
        width = (min(map(len, maps)) if bits is None else bits // 8) if maps else 8
        grid = np.zeros((len(maps), width), np.uint8)
        for k, m in enumerate(maps):
            grid[k] = np.bitwise_or.reduce(m.reshape(-1, width), 0)
        self.bits = width * 8
        self.order = np.lexsort((low, np.floor(np.log(np.maximum(size, 1)) * 8)))
        leaf, size = np.ascontiguousarray(grid[self.order]).view(np.uint64), size[self.order]
        weight = np.bitwise_count(leaf).sum(1).astype(np.int64)
        self.levels = [(leaf, size, size, weight)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, w = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.minimum.reduceat(w, cut)))

    @classmethod
    def of(cls, sets: list[np.ndarray], bits: int | None = None) -> Tree:
        size = np.array([len(s) for s in sets], np.int64)
        own = _bits(size)
        maps = [np.frombuffer(_bitmap(s, int(w)), np.uint8) for s, w in zip(sets, own, strict=True)]
        return cls(size, np.array([s[0] if len(s) else 0 for s in sets], np.uint64), maps, bits)


def trees(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[Tree, Tree]:
    """Trees of two lists of sets, with bitmaps of the same bits."""
    least = int(min(_bits(np.array([len(s) for s in (*left, *right)], np.int64)), default=BITS_LEAST))
    return Tree.of(left, least), Tree.of(right, least)


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which node pairs may hold a link.  A set below node A sets at least (least weight of A) - (bits common to both ORs) bits that no set below B sets, and each such bit is a member that cannot be shared."""
    most = max(1, 12_800_000 // max(1, a[0].shape[1] * 8))  # bytes in a piece
    if len(i) > most:
        return np.concatenate([_possible(a, b, i[k : k + most], j[k : k + most], p, q) for k in range(0, len(i), most)])
    shared = np.bitwise_count(a[0][i] & b[0][j]).sum(1).astype(np.int64)
    most = np.minimum(a[2][i] - np.maximum(0, a[3][i] - shared), b[2][j] - np.maximum(0, b[3][j] - shared))
    union = np.maximum(a[1][i], most) + np.maximum(b[1][j], most) - most
    return (most > 0) & (q * most >= p * union)


def candidates(a: Tree, b: Tree, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that a dual traversal leaves; of one tree with itself, each pair once (i < j)."""
    same = a is b
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    if not len(a.levels[0][0]) or not len(b.levels[0][0]):
        return i[:0], j[:0]
    while True:
        stay = _possible(a.levels[la], b.levels[lb], i, j, p, q)
        i, j = i[stay], j[stay]
        if not len(i) or la == lb == 0:
            break
        if la >= lb:
            i, j = np.repeat(i * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(i)), np.repeat(j, FANOUT)
            la -= 1
            ok = i < len(a.levels[la][0])
            i, j = i[ok], j[ok]
            if not same:
                continue
        if lb > la or same:
            i, j = np.repeat(i, FANOUT), np.repeat(j * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(j))
            lb -= 1
            ok = j < len(b.levels[lb][0])
            if same:
                ok &= i <= j
            i, j = i[ok], j[ok]
    if same:
        i, j = i[i < j], j[i < j]
    return a.order[i], b.order[j]


def _linked(one: np.ndarray, others: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Exact comparison of a set with several."""
    size = np.array([len(o) for o in others], np.int64)
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    total = np.concatenate([[0], np.cumsum(one[at] == every)])
    bounds = np.concatenate([[0], np.cumsum(size)])
    common = total[bounds[1:]] - total[bounds[:-1]]
    return (common > 0) & (q * common >= p * (len(one) + size - common))


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, p: int, q: int, first: int | None = None, every: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links among `left`, or between `left` and `right`, found by signature trees.

    Returns index pairs (right indices follow the left ones) and component labels.
    Without `every`, pairs that are connected already are skipped: the pairs
    returned span the same components.  `first` is compared before the others.
    """
    sets = left + (right or [])
    base = len(left) if right is not None else 0
    label = np.arange(len(sets))
    out: list[tuple[int, int]] = []

    def compare(a: int, others: np.ndarray) -> None:
        nonlocal label
        if not len(others) or not len(sets[a]):
            return
        for b in others[_linked(sets[a], [sets[o] for o in others], p, q)]:
            if every or label[a] != label[b]:
                out.append((a, int(b)))
                label = np.where(label == label[b], label[a], label)

    a, b = (Tree.of(left),) * 2 if right is None else trees(left, right)
    i, j = candidates(a, b, p, q)
    i, j = np.concatenate([i, j + base]), np.concatenate([j + base, i])  # both directions: a set's pairs stand together
    order = np.lexsort((j, i)) if first is None else np.lexsort((j, i, i != first))
    i, j = i[order], j[order]
    if not len(i):
        return out, label
    start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    done = np.zeros(len(sets), bool)
    for s, e in zip(start, [*start[1:], len(i)], strict=True):
        others = j[s:e]
        others = others[~done[others]]
        compare(int(i[s]), others if every else others[label[others] != label[i[s]]])
        done[i[s]] = True
    return out, label


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition, across batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        start = 0
        for at in range(1, len(values) + 1):
            if at == len(values) or values[at] != values[start]:
                if last is not None and values[start] != last:
                    yield pa.concat_tables(held)
                    held = []
                held.append(pa.Table.from_batches([batch.slice(start, at - start)]))
                last, start = values[start], at
    if held:
        yield pa.concat_tables(held)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _with_sets(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Each row of `places` (x, array of structs `at`) as one row per struct, with the set of document x."""
    kind = places.schema["at"].dataType.elementType
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in tk.runs(batch.column(1), tk.SPACE_WORDS):
                hashes, bounds = _distinct(words, n)
                at = batch.column(2).slice(i, j - i)
                flat = at.flatten()
                row = np.repeat(np.arange(j - i), np.diff(at.offsets.to_numpy()))
                for k in range(0, len(row), 2048):  # a document in many places does not become one large batch
                    part = row[k : k + 2048]
                    own = flat.slice(k, len(part))
                    columns = [batch.column(0).slice(i, j - i).take(pa.array(part)), pa.array([hashes[bounds[r] : bounds[r + 1]].tobytes() for r in part], pa.binary()), *(own.field(f) for f in range(len(names)))]
                    yield pa.RecordBatch.from_arrays(columns, ["x", "members", *names])

    schema = f"x long, members binary, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kind.fields)}"
    text, _ = id_filter.split(docs.select(F.col("doc_id").alias("x"), "text"), "x", id_filter.build(places.select("x")))
    # always a shuffle of the texts: what would be broadcast grows with the input
    return text.join(places.hint("merge"), "x").select("x", "text", "at").mapInArrow(run, schema)


def _groups_by(df: DataFrame, *key: str) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key)


def _with_partners(placed: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """`placed` (x, h, blocks, block) without members of which the trees of token bitmaps say that nobody in their group can link with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["h", "block"]):
            maps = [np.frombuffer(m.as_buffer(), np.uint8) for m in group.column("bitmap")]
            tree = Tree(group.column("size").to_numpy(), group.column("low").to_numpy().view(np.uint64), maps)
            i, j = candidates(tree, tree, p, q)
            stay = pa.array(np.unique(np.concatenate([i, j])))
            for batch in group.select(["x", "h", "blocks", "block"]).take(stay).combine_chunks().to_batches():
                yield batch

    one = placed.where("blocks = 1").join(sketches.select("x", "size", "low", "bitmap"), "x").select("x", "h", "blocks", "block", "size", "low", "bitmap")
    kept = _groups_by(one, "h", "block").mapInArrow(run, "x long, h long, blocks int, block int").distinct()  # rows that share an id come several times
    return kept.union(placed.where("blocks > 1").select("x", "h", "blocks", "block"))


def links(docs: DataFrame, n: int, p: int, q: int, *, sketches: DataFrame, classes: DataFrame, common: np.ndarray, scratch: Scratch, every: bool = False) -> DataFrame:
    """(u, v) between class representatives: all links (`every`), or enough of them to connect what is linked."""
    reps = classes.select(F.col("rep").alias("x"), F.col("n_shingles").alias("n"))
    members = sketches.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    edges = scratch.table(_bucket_edges(docs, n, p, q, common, members).join(reps.select("x", "n"), "x"))
    member = edges.select("h", "x", "n").union(edges.select("h", F.col("h").alias("x"), F.lit(0).alias("n")).distinct())
    blocks = edges.groupBy("h").agg(F.greatest(F.ceil((F.count(F.lit(1)) + 1) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    blocks = scratch.table(blocks)  # the join reads both sides as they are, so that Spark can split a hub's group
    member = member.join(blocks, "h").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    placed = member.where("x <> h").select("x", "h", "blocks", "block").union(
        blocks.select(F.col("h").alias("x"), "h", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    placed = scratch.table(_with_partners(scratch.table(placed), sketches, p, q))
    places = placed.groupBy("x").agg(F.collect_list(F.struct("h", "blocks", "block")).alias("at"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["h", "block"]):
            ids = group.column("x").to_pylist()
            sets, h = _sets(group.column("members")), group.column("h")[0].as_py()
            hub = ids.index(h) if h in ids else None
            found, label = tree_links(sets, None, p, q, hub, every)
            u, v, kind = [ids[a] for a, _ in found], [ids[b] for _, b in found], [0] * len(found)
            if group.column("blocks")[0].as_py() > 1:
                rest = [ids[k] for k in range(len(ids)) if (every or label[k] != label[hub]) and k != hub]
                u, v, kind = u + rest, v + [h] * len(rest), kind + [1] * len(rest)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(kind, pa.int32())], ["u", "v", "kind"])

    found = scratch.table(_groups_by(_with_sets(docs, places, n), "h", "block").mapInArrow(solve, "u long, v long, kind int"))
    out = found.where("kind = 0").select("u", "v")
    if found.where("kind = 1").limit(1).count():
        # what no hub connected, in chunks, against every other block of its group
        rest = found.where("kind = 1").select(F.col("u").alias("x"), F.col("v").alias("h"))
        chunks = rest.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("chunks"))
        again = placed.where("x <> h and blocks > 1").join(chunks, "h")  # groups with something left, their sets made anew
        own = _with_sets(docs, again.groupBy("x").agg(F.collect_list(F.struct("h", "blocks", "block", "chunks")).alias("at")), n)
        cross = own.join(rest, ["x", "h"]).select("x", "members", "h", F.pmod(F.xxhash64("x", F.lit(7)), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
        cross = cross.union(own.select("x", "members", "h", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", F.lit(1).alias("side")))

        def solve_cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, ["h", "chunk", "block"]):
                ids, side, sets = np.array(group.column("x").to_pylist()), np.array(group.column("side").to_pylist()), _sets(group.column("members"))
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                there = np.concatenate([ids[a], ids[b]])
                pairs, _ = tree_links([sets[k] for k in a], [sets[k] for k in b], p, q, None, every)
                pairs = [(there[i], there[j]) for i, j in pairs if there[i] != there[j]]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])

        out = out.union(scratch.table(_groups_by(cross, "h", "chunk", "block").mapInArrow(solve_cross, "u long, v long")))
    if every:
        out = out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return out


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _classes(sizes: DataFrame) -> DataFrame:
    return sizes.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))


def _sketches(sketched: DataFrame) -> DataFrame:
    return sketched.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("size"), "low", "bitmap")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class `rep` of every document, and all links (u, v), u < v, between class representatives."""
    docs = _prepared(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "jaccard")
    sketched = scratch.table(sketch(docs, n))
    sizes, common = sketched.where("chunk is null").drop("low", "bitmap", "chunk", "counts"), _common(sketched)
    classes = scratch.table(_classes(sizes))  # likewise, for a class of many copies
    members = sizes.join(classes, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep")
    return members, links(docs, n, p, q, sketches=_sketches(sketched), classes=classes, common=common, scratch=scratch, every=True)


def ngram_jaccard_components(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id reachable by links of similarity p/q or more."""
    docs = _prepared(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "jaccard")
    sketched = scratch.table(sketch(docs, n))
    sizes, common = sketched.where("chunk is null").drop("low", "bitmap", "chunk", "counts"), _common(sketched)
    classes = scratch.table(_classes(sizes))  # likewise, for a class of many copies
    groups = scratch.table(connected_components(links(docs, n, p, q, sketches=_sketches(sketched), classes=classes, common=common, scratch=scratch), "u", "v").where("id <> component"))
    named = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    return sizes.join(named, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of `documents` under 3-word shingles and similarity 0.9."""
    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
