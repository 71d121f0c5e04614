"""Near copies by the Jaccard similarity of word shingles, exactly.

*Universe partition.* Sizes are cut into bands. In a band whose largest set has U shingles, two sets that
link differ in at most H = 2U / 9 shingles (for a similarity of 0.8), so if the universe of
shingles is hashed into m segments, at least m - H / (v + 1) segments of the two differ by at most v.
A set is indexed by the hash of its part of each segment (its subset) and, where the band allots v = 1, by the
hashes of that part with one shingle deleted. A set also serves the next band if it is large enough for it.

*Allocation.* v and the number of segments come from a cost model per band: signatures written, against
the copies that thin segments would meet. ``spare`` segments beyond the pigeonhole's number let empty segments be left
out; a set with more empty segments than that is indexed a second time, with all of them, in a name space of
its own. Only pairs of two such sets could have been missed, so none is.

*Buckets.* Signatures travel packed and sorted; the sets of one signature are a bucket. A signature that one task meets often
sends a few of its sets to the signature's part and the others past it, so a very common one fills no part. Small buckets give their pairs, whose number is a
constant times their members. A set that must share more signatures than one with each of its partners leaves out as many of its largest buckets: of
the signatures that two sets share, the one in the smallest bucket stays with both.

*Verification.* Parity sketches, whose distance never exceeds the true difference, throw out most false pairs, and
the texts of the rest decide. First each set is tested with its closest candidate, and members that are then in one component need no further test.
In larger buckets each member meets the least one, in a few rounds the closest ones of other components, and at last every pair that is still
across components is looked at: members outside a bucket's largest component meet all others, dealt in blocks, and a bucket with very many of them is
first cut by a second universe partition of the same sets. So components are those of all links.

Defined results. A null or empty text, or one without words, has no shingles and links with nothing. Fewer
words than a shingle has are one shingle. Equal sets are one class. A row with a null id comes back with a
null component and links with nothing. Repeated rows are members like any other. An empty table gives an
empty result. Extra columns are dropped from the component table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROLL, Shelf, buffers, mix, slices, spare, words_of
from .components import components

WORDS = 5
#: Similarity as a fraction: linked where DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Signatures of a part of the index, about; parts are what a task holds in memory.
PART = 500_000
#: Texts are shingled in slices of so many bytes, for the arrays of their signatures are larger than they.
SLICE = 500_000
#: Most ids that are broadcast to pick texts; beyond, a shuffle does it.
MOST_BROADCAST = 200_000
#: Largest bucket whose pairs are written.
SMALL = 8
#: Sets of one signature that a task's batch sends to the signature's part; more go past it. More than SMALL.
HOT = 64
#: Members of a bucket that are compared with as many others at once; larger ones are dealt out in pairs of blocks.
BLOCK = 512
#: Blocks of members outside the largest component beyond which a bucket is cut by a second partition.
AGAIN = 16
#: Pairs of members that are looked at together.
TILE = 500_000
#: Bytes of sketches that are compared at once.
SKETCH_BYTES = 8_000_000
GROWTH = 1.3
#: Rounds in which each member meets so many of the closest members of other components, in so many of its buckets, before all pairs that are left;
#: the rounds end where fewer than half of the pairs link.
ROUNDS, CLOSEST, THIN = 4, 3, 4
#: Buckets of a set that are sent along, so that a pair which meets in several is taken once.
FEW = 8
#: The low bits of a signature name its band and name space.
FLAGS = np.uint64(7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts between the offsets ``at``: text and hash, by text."""
    part = _LOWER[raw[at[0] : at[-1]]]
    _, _, doc, codes = words_of(part, at - at[0])
    total = len(codes)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = ROLL.prefix(codes)
    lo = np.arange(max(0, total - words + 1))
    lo = lo[doc[lo] == doc[lo + words - 1]] if len(lo) else lo
    count = np.bincount(doc, minlength=len(at) - 1)
    short = np.flatnonzero((count > 0) & (count < words))
    first = np.searchsorted(doc, short)
    owner = np.concatenate((doc[lo], short))
    code = np.concatenate((mix(ROLL.ranges(sums, lo, lo + words)), mix(ROLL.ranges(sums, first, first + count[short]) + count[short].astype(np.uint64))))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return owner[new], code[new]


class Band:
    """Sizes from ``lo`` to ``hi`` (of the smaller set from ``reach``), and how their sets are indexed."""

    __slots__ = ("number", "lo", "hi", "reach", "spread", "deletions", "segments", "spare")

    def __init__(self, number: int, lo: int, hi: int) -> None:
        self.number, self.lo, self.hi = number, lo, hi
        self.reach = -(-lo * NUM // DEN)
        differ = (DEN - NUM) * 2 * hi // (DEN + NUM)
        best = None
        for v in (0, 1):
            need = differ // (v + 1) + 1
            for spare in sorted({0, *(math.ceil(need * x / 40) for x in range(1, 24))}):
                m = need + spare
                mean = max(1.0, (lo + hi) / 2) / m
                thin = math.exp(-mean) * (1 if v == 0 else 1 + mean)
                # Odds that a set has more thin segments than are to spare (normal approximation).
                z = (spare + 0.5 - m * thin) / math.sqrt(max(1e-9, m * thin * (1 - thin)))
                lacking = 0.5 * math.erfc(z / math.sqrt(2))
                written = m * (1 + v * mean)
                # A part of one shingle meets others by common passages; each costs like several
                # signatures, and more in a small set, most of which a passage can be.
                lone = m * (mean * math.exp(-mean) if v == 0 else mean**2 / 2 * math.exp(-mean))
                cost = written * (1 + 2 * lacking) + (6 + 2000 / hi) * lone
                if best is None or cost < best[0]:
                    best = (cost, v, m, spare)
        _, self.deletions, self.segments, self.spare = best


@functools.lru_cache(maxsize=4096)
def band(number: int) -> Band:
    lo = _low(number)
    return Band(number, lo, _low(number + 1) - 1)


@functools.lru_cache(maxsize=4096)
def _low(number: int) -> int:
    return 1 if number <= 0 else max(_low(number - 1) + 1, math.ceil(_low(number - 1) * GROWTH))


def bands_of(sizes: np.ndarray) -> list[tuple[Band, np.ndarray]]:
    """Each band with the sets (by position) that it indexes: its own, and smaller ones that could link with them."""
    out, k = [], 0
    most = int(sizes.max(initial=0))
    while _low(k) <= most or band(k).reach <= most:
        b = band(k)
        which = np.flatnonzero((sizes >= b.reach) & (sizes <= b.hi) & (sizes > 0))
        if len(which):
            out.append((b, which))
        k += 1
    return out


def signatures(owner: np.ndarray, code: np.ndarray, docs: int, partition: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets (set, signature), and how many may be left out (set, flags << 24 | number).

    The second part is by band and name space: a set shares more signatures than that number with each set it links with.
    ``partition`` numbers independent partitions of the universe.
    """
    sizes = np.bincount(owner, minlength=docs)
    start = np.concatenate(([0], np.cumsum(sizes)))
    token = mix(code ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out_set, out_sig, out_own, out_room = [], [], [], []
    for b, which in bands_of(sizes):
        m, v = b.segments, b.deletions
        own = np.repeat(np.arange(len(which)), sizes[which])
        pick = np.repeat(start[which] - np.concatenate(([0], np.cumsum(sizes[which])[:-1])), sizes[which]) + np.arange(len(own))
        t, c = token[pick], code[pick]
        segment = (mix(c + np.uint64(b.number + 1 + (partition << 32))) % np.uint64(m)).astype(np.int64)
        cell = own * m + segment
        total = np.zeros(len(which) * m, np.uint64)
        np.add.at(total, cell, t)
        filled = np.bincount(cell, minlength=len(total))
        where = mix((np.uint64(b.number) << np.uint64(32)) + np.arange(m, dtype=np.uint64))
        least = 1
        thin = (filled < least + v).reshape(len(which), m).sum(axis=1)
        lacks = thin > b.spare
        salt = np.tile(where, len(which))
        flags = np.uint64(b.number % 4 * 2)
        marked = lambda x, f: x & ~FLAGS | f
        good = np.flatnonzero(filled >= least)
        sets, sigs = [good // m], [marked(mix(total[good] + salt[good]), flags)]
        if v:
            ok = filled[cell] > least  # with one shingle deleted, something must be left
            sets.append(own[ok])
            sigs.append(marked(mix(total[cell[ok]] - t[ok] + salt[cell[ok]]), flags))
        if lacks.any():
            apart = np.uint64(0xC3C3C3C3C3C3C3C3)
            every = np.flatnonzero(np.repeat(lacks, m))
            sets.append(every // m)
            sigs.append(marked(mix(total[every] + salt[every] + apart), flags + np.uint64(1)))
            if v:
                ok = lacks[own]
                sets.append(own[ok])
                sigs.append(marked(mix(total[cell[ok]] - t[ok] + salt[cell[ok]] + apart), flags + np.uint64(1)))
        if not v:
            # Segments in which a set can differ from a partner of the band; in all others the two agree.
            n = sizes[which]
            differ = (n + np.minimum(b.hi, n * DEN // NUM)) * (DEN - NUM) // (DEN + NUM)
            for kind, room in ((0, m - differ - thin - 1), (1, np.where(lacks, m - differ - 1, 0))):
                some = np.flatnonzero(room > 0)
                out_own.append(which[some])
                out_room.append(((int(flags) + kind) << 24 | np.minimum(room[some], (1 << 24) - 1)).astype(np.int32))
        out_set += [which[s] for s in sets]
        out_sig += sigs
    none = np.zeros(0, np.int64)
    if not out_set:
        return none, np.zeros(0, np.uint64), none, np.zeros(0, np.int32)
    return np.concatenate(out_set), np.concatenate(out_sig), np.concatenate([none, *out_own]), np.concatenate([np.zeros(0, np.int32), *out_room])


def sketch_bits(n: int) -> int:
    return max(64, 1 << max(0, (n - 1)).bit_length())


def sketch(code: np.ndarray) -> bytes:
    """Parities of a set in about as many slots as it has shingles."""
    bits = sketch_bits(len(code))
    parity = np.bincount((mix(code + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(s: bytes, size: int) -> np.ndarray:
    """The sketch with ``size`` bytes, as 64-bit words."""
    x = np.frombuffer(s, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(n: int, m: int, apart: int) -> bool:
    """Whether sets of n and m shingles that differ in ``apart`` of them or more can link."""
    low, high = min(n, m), max(n, m)
    return DEN * low >= NUM * high and apart * (DEN + NUM) <= (DEN - NUM) * (n + m)


def _pack(sig: np.ndarray, node: np.ndarray) -> bytes:
    """Sorted signatures as byte planes of their steps, and the nodes by number."""
    names, number = np.unique(node, return_inverse=True)
    step = np.diff(sig, prepend=np.uint64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T.copy().tobytes() + number.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy().tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(sig), len(names)], np.uint64).tobytes() + planes + names.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
    step = np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n).T.copy().view(np.uint64).ravel()
    number = np.frombuffer(raw, np.uint8, 4 * n, 16 + 8 * n).reshape(4, n).T.copy().view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint64), np.frombuffer(raw, np.int64, k, 16 + 12 * n)[number]


def _bucket(sig: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (mix((sig & ~FLAGS) + (part << np.uint64(56))) & ~FLAGS | sig & FLAGS).view(np.int64)


#: Rows of the index: sets (doc, node, n, data: sketch, room), pairs (center, node), members of buckets (bucket, center, node).
INDEX = {"doc": pa.int64(), "node": pa.int64(), "n": pa.int64(), "data": pa.binary(), "room": pa.list_(pa.int32()), "bucket": pa.int64(), "center": pa.int64()}
INDEX_DDL = "doc long, node long, n long, data binary, room array<int>, bucket long, center long"


def _rows(number: int, **cols) -> list[pa.Array]:
    return [cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t) if c in cols else pa.nulls(number, t) for c, t in INDEX.items()]


def _emit(parts: int, words: int):
    """(id, text) -> rows of sets (part dealt in turn), packed signatures (by part), and members of common signatures (part dealt in turn)."""
    names = ["part", *INDEX]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes, waiting, turn = [], [], 0, 0

        def dealt(n: int) -> pa.Array:
            nonlocal turn
            turn += n
            return pa.array(((turn + np.arange(n)) % parts).astype(np.int32))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            part = (sig >> np.uint64(32)) % np.uint64(parts)
            sig &= np.uint64((1 << 56) - 1)
            order = np.lexsort((node, sig, part))
            part, sig, node = part[order], sig[order], node[order]
            first = np.ones(len(sig), bool)
            first[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(first)
            head = at[np.cumsum(first) - 1]
            past = np.arange(len(sig)) - head >= HOT
            if past.any():
                k = int(past.sum())
                yield pa.RecordBatch.from_arrays([dealt(k), *_rows(k, node=node[past], bucket=_bucket(sig[past], part[past]), center=node[head[past]])], names)
                part, sig, node = part[~past], sig[~past], node[~past]
            cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            full = [p for p in range(parts) if cut[p] < cut[p + 1]]
            blobs = [_pack(sig[cut[p] : cut[p + 1]], node[cut[p] : cut[p + 1]]) for p in full]
            sigs.clear()
            nodes.clear()
            waiting = 0
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *_rows(len(full), data=blobs)], names)

        for batch in batches:
            raw, at = buffers(batch.column(1))
            for i, j in slices(at, SLICE):
                owner, code = shingles(raw, at[i : j + 1], words)
                docs = j - i
                sizes = np.bincount(owner, minlength=docs)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                total = np.zeros(docs, np.uint64)
                np.add.at(total, owner, mix(code + np.uint64(0x51ED)))
                node = mix(total + sizes.astype(np.uint64)).view(np.int64)
                fresh = np.zeros(docs, bool)
                marks: list[bytes | None] = []
                for k, x in enumerate(node.tolist()):
                    if sizes[k] and x not in seen:
                        seen.add(x)
                        fresh[k] = True
                        marks.append(sketch(code[ends[k] : ends[k + 1]]))
                    else:
                        marks.append(None)
                keep = fresh[owner]
                number = np.cumsum(fresh) - 1
                sets, sig, own, room = signatures(number[owner[keep]], code[keep], int(fresh.sum()))
                sigs.append(sig)
                nodes.append(node[fresh][sets])
                waiting += len(sig)
                order = np.argsort(own, kind="stable")
                held = np.zeros(docs + 1, np.int64)
                held[1:][fresh] = np.bincount(own, minlength=int(fresh.sum()))
                rooms = pa.ListArray.from_arrays(np.cumsum(held).astype(np.int32), pa.array(room[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([dealt(docs), *_rows(docs, doc=batch.column(0).slice(i, docs), node=node, n=sizes.astype(np.int64), data=marks, room=rooms)], names)
                if waiting > PART:
                    yield from flush()
        if waiting:
            yield from flush()

    return run


def _gather(small: int):
    """All rows of a part -> its sets and members as they came, pairs of its small buckets, and members of its larger ones."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        packed = pc.and_(pc.is_null(table["n"]), pc.is_null(table["bucket"]))
        came = table.filter(pc.invert(packed)).select(list(INDEX))
        got = [_unpack(b) for b in table.filter(packed)["data"].to_pylist()]
        if not got:
            return came
        sig = np.concatenate([g[0] for g in got])
        node = np.concatenate([g[1] for g in got])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(sig)))
        group = np.cumsum(first) - 1
        few = np.flatnonzero((size[group] > 1) & (size[group] <= small))
        a, b = [node[:0]], [node[:0]]
        for step in range(1, small):
            low = few[:-step]
            ok = group[few[step:]] == group[low]
            a.append(node[low[ok]])
            b.append(node[few[step:][ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        many = size[group] > small
        part = np.full(int(many.sum()), int(key[0].as_py()), np.uint64)
        pairs = pa.Table.from_arrays(_rows(len(a), center=a, node=b), names=list(INDEX))
        members = pa.Table.from_arrays(_rows(len(part), node=node[many], bucket=_bucket(sig[many], part), center=node[at][group][many]), names=list(INDEX))
        return pa.concat_tables([came.cast(members.schema), pairs, members])

    return run


def _again(words: int):
    """(node, buckets, text) -> (bucket, node) for the parts into which a second partition cuts each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(2))
            nodes, held = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i, j in slices(at, SLICE):
                owner, code = shingles(raw, at[i : j + 1], words)
                sets, sig, _, _ = signatures(owner, code, j - i, 1)
                order = np.argsort(sets, kind="stable")
                edge = np.searchsorted(sets[order], np.arange(j - i + 1))
                for k in range(j - i):
                    own = mix(sig[order[edge[k] : edge[k + 1]]])
                    for bucket in held[i + k]:
                        grp = mix(own ^ np.array([bucket], np.int64).view(np.uint64))
                        yield pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(np.full(len(grp), nodes[i + k], np.int64))], ["bucket", "node"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, s_a, s_b) -> the pairs that may link, with the least distance that they can have."""
    for batch in batches:
        a, b, n, m, s, t = (c.to_pylist() for c in batch.columns)
        keep, apart = [], []
        for i in range(len(a)):
            size = min(len(s[i]), len(t[i]))
            d = int(np.bitwise_count(folded(s[i], size) ^ folded(t[i], size)).sum())
            if may_link(n[i], m[i], d):
                keep.append(i)
                apart.append(d)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array(apart, pa.int64())], ["a", "b", "apart"])


def _verified(words: int):
    """(a, b, text_a, text_b) -> the pairs that link."""

    def sets(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        owner, code = shingles(raw, at, words)
        return np.split(code, np.searchsorted(owner, np.arange(1, len(at) - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (raw_a, at_a), (raw_b, at_b) = buffers(batch.column(2)), buffers(batch.column(3))
            hit = []
            for i, j in slices(at_a + at_b - at_b[0], SLICE):
                for k, (x, y) in enumerate(zip(sets(raw_a, at_a[i : j + 1]), sets(raw_b, at_b[i : j + 1]), strict=True), i):
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if common and DEN * common >= NUM * (len(x) + len(y) - common):
                        hit.append(k)
            yield batch.select([0, 1]).take(pa.array(hit, pa.int64()))

    return run


def _across(nearest: bool):
    """Rows of buckets' blocks, in order of their group -> pairs across components that may link.

    A pair meets once in each bucket (``at``) that both have. ``own`` has a row's least buckets; where those of two rows have one in common, the
    pair is taken in the least such bucket alone. ``nearest`` keeps the few closest pairs of each member alone.
    """

    def tiles(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one group, of either side where it has two; at most TILE pairs at a time, of many small groups or of part of one."""
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        out_x, out_y, held = [], [], 0
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            at = np.arange(lo, hi)
            alone = side[lo] < 0
            left, right = (at, at) if alone else (at[side[lo:hi] == 0], at[side[lo:hi] == 1])
            step = max(1, TILE // max(1, len(right)))
            for k in range(0, len(left), step):
                some = left[k : k + step]
                x, y = np.repeat(some, len(right)), np.tile(right, len(some))
                if alone:
                    x, y = x[x < y], y[x < y]
                out_x.append(x)
                out_y.append(y)
                held += len(x)
                if held >= TILE:
                    yield np.concatenate(out_x), np.concatenate(out_y)
                    out_x, out_y, held = [], [], 0
        if held:
            yield np.concatenate(out_x), np.concatenate(out_y)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, node, root, n, side = (rows[c].to_numpy() for c in ("grp", "node", "root", "n", "side"))
        marks, own_, at_ = rows["data"].to_pylist(), rows["own"].combine_chunks(), rows["at"].to_numpy()
        held: dict[int, frozenset] = {}

        def once(x: int, y: int) -> bool:
            for k in (x, y):
                if node[k] not in held:
                    held[node[k]] = frozenset(own_[k].values.to_pylist())
            both = held[node[x]] & held[node[y]]
            return not both or min(both) == at_[x]

        width = np.array([len(m) for m in marks])
        found = []
        for x, y in tiles(group, side):
            ok = (root[x] != root[y]) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            # Sketches of each size class once, folded to the smaller of a pair.
            apart = np.zeros(len(x), np.int64)
            small = np.minimum(width[x], width[y])
            for size in np.unique(small):
                which = np.flatnonzero(small == size)
                used, at = np.unique(np.concatenate((x[which], y[which])), return_inverse=True)
                table = np.stack([folded(marks[k], size) for k in used])
                step = max(1, SKETCH_BYTES // int(size))
                for part in range(0, len(which), step):
                    w = which[part : part + step]
                    i, j = at[part : part + len(w)], at[len(which) + part : len(which) + part + len(w)]
                    apart[w] = np.bitwise_count(table[i] ^ table[j]).sum(axis=1)
            ok = np.flatnonzero(apart * (DEN + NUM) <= (DEN - NUM) * (n[x] + n[y]))
            x, y, apart = x[ok], y[ok], apart[ok]
            ok = np.fromiter(map(once, x.tolist(), y.tolist()), bool, len(x))
            x, y, apart = x[ok], y[ok], apart[ok]
            if nearest:
                found.append((x, y, apart))
            elif len(x):
                yield batch_of(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), apart)
        if found:
            x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
            # From either end.
            own, other, far = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((apart, apart))
            order = np.lexsort((node[other], far, node[own]))
            own, other, far = own[order], other[order], far[order]
            first = np.flatnonzero(np.concatenate(([True], node[own][1:] != node[own][:-1]))) if len(own) else np.zeros(0, np.int64)
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            keep = place < CLOSEST
            yield batch_of(node[own[keep]], node[other[keep]], far[keep])

    def batch_of(*cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            group = rows["grp"].to_numpy()
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = rows.slice(cut)
            if cut:
                yield from compare(rows.slice(0, cut))
        if held is not None and len(held):
            yield from compare(held)

    return run


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row (see the module's text), as a table in the shared folder."""
    spark = df.sparkSession
    shelf, result = Shelf(spark), Shelf(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(max(64, size // (12 * PART)))
    packed = rows.mapInArrow(_emit(parts, words), f"part int, {INDEX_DDL}")
    first = shelf.put(packed.groupBy("part").applyInArrow(_gather(SMALL), INDEX_DDL), "index")
    sets = first.where("n is not null").select("doc", "node", "n", "data", "room")
    largest = [F.max(c).alias(c) for c in ("n", "data", "room")]
    classes = shelf.put(sets.where("n > 0 and doc is not null").groupBy("node").agg(F.min("doc").alias("doc"), *largest), "classes")

    def attach(pairs: DataFrame, to: DataFrame, *cols: str) -> DataFrame:
        """``pairs`` with the columns of ``to`` for either end."""
        for x in ("a", "b"):
            pairs = pairs.join(to.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols]), x)
        return pairs.select("a", "b", *[f"{c}_{x}" for c in cols for x in ("a", "b")])

    def verify(pairs: DataFrame, name: str, count: int) -> DataFrame:
        """Those of ``count`` pairs that link. Only their texts are read again."""
        need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(classes.select("node", "doc"), "node")
        texts = shelf.put(rows.join(F.broadcast(need) if 2 * count <= MOST_BROADCAST else need, "doc").select("node", "text"), f"{name}-texts")
        return shelf.put(attach(pairs.select("a", "b"), texts, "text").mapInArrow(_verified(words), "a long, b long").distinct(), f"{name}-links")

    def with_roots(df_: DataFrame, *names: str) -> DataFrame:
        """The root of each node among ``names``, as ``root`` or ``root_<name>``; a node without links is its own."""
        for x in names:
            to = "root" if x == "node" else f"root_{x}"
            df_ = df_.join(roots.select(F.col("node").alias(x), F.col("root").alias(to)), x, "left").withColumn(to, F.coalesce(to, x))
        return df_

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")

    # Members of larger buckets, each without the largest that it can do without. The order of buckets is the same for all.
    members = first.where("bucket is not null").select("bucket", "node", "center")
    sized = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket").withColumn("flags", F.col("bucket").bitwiseAND(7).cast("int"))
    place = F.row_number().over(Window.partitionBy("node", "flags").orderBy(F.desc("size"), "bucket"))
    room = F.get(F.filter("room", lambda x: F.shiftright(x, 24) == F.col("flags")), F.lit(0)).bitwiseAND((1 << 24) - 1)
    placed = sized.withColumn("place", place).join(classes.select("node", "room"), "node")
    members = shelf.put(placed.where(F.col("place") > F.coalesce(room, F.lit(0))).select("bucket", "node", "center"), "members")

    # Pairs of small buckets, and every member of others with the least; of those that may link the closest of each set.
    pairs = first.where("bucket is null and center is not null").select(F.col("center").alias("a"), F.col("node").alias("b"))
    stars = members.where("node <> center").select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b"))
    pairs = attach(pairs.union(stars).distinct(), classes, "n", "data")
    pairs = shelf.put(pairs.mapInArrow(_sketched, "a long, b long, apart long"), "pairs")
    ends = pairs.select("a", "b", "apart").union(pairs.select("b", "a", "apart"))
    nearest = ends.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    tested = shelf.put(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nearest")
    links = verify(tested, "near", tested.count())
    roots = shelf.put(components(links, shelf), "roots")

    def crossing(dealt: DataFrame, nearest_only: bool) -> DataFrame:
        """Pairs across components that may link, within the groups of (``grp``, ``at``, ``side``, ``node``, ``root``)."""
        own = dealt.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("at")), 1, FEW).alias("own"))
        wide = dealt.join(classes.select("node", "n", "data").join(own, "node"), "node").select("grp", "at", "node", "root", "side", "n", "data", "own")
        return wide.repartition("grp").sortWithinPartitions("grp").mapInArrow(_across(nearest_only), "a long, b long, apart long")

    def several(of: DataFrame, key: str) -> DataFrame:
        """The keys under which more than one component stands."""
        return of.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")

    # Then the other pairs that are across components; and in rounds, in a few buckets of each set, the closest of other components.
    rest = with_roots(pairs, "a", "b").where("root_a <> root_b").select("a", "b")
    for turn in range(ROUNDS):
        rooted = with_roots(members, "node")
        rooted = rooted.join(several(rooted, "bucket").select("bucket", F.ceil(F.col("size") / BLOCK).alias("cells")), "bucket")
        cell = F.pmod(F.xxhash64("node"), F.col("cells"))
        thin = rooted.select("node", "root", F.xxhash64("bucket", cell).alias("grp"), F.lit(-1).alias("side")).withColumn("at", F.col("grp"))
        thin = thin.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("grp"))).where(F.col("rn") <= THIN).drop("rn")
        few = F.slice(F.array_sort(F.collect_set(F.struct("apart", "b"))), 1, CLOSEST)
        close = crossing(thin, True).groupBy("a").agg(few.alias("x")).select("a", F.explode("x.b").alias("b"))
        new = shelf.put(untested(close.union(rest) if turn == 0 else close), f"closest-{turn}")
        tried = new.count()
        if not tried:
            break
        tested = tested.union(new)
        found = verify(new, f"closest-{turn}", tried)
        links = links.union(found)
        if 2 * found.count() < tried:
            break  # what these links join is looked at once more below, which changes nothing
        roots = shelf.put(components(links, shelf), f"roots-{turn}")

    # At last every bucket that has several components, whole.
    rooted = with_roots(members, "node").select("bucket", "node", "root")
    counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
    left = shelf.put(counts.agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1"), "several")
    outside = F.col("size") - F.col("top.c")
    hot = left.where(outside > AGAIN * BLOCK)
    if not hot.isEmpty():
        # Sets that link and meet in such a bucket also meet in a part of it.
        held = rooted.join(hot.select("bucket"), "bucket").groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
        texts = held.join(classes.select("node", "doc"), "node").join(rows, "doc").select("node", "buckets", "text")
        parted = with_roots(texts.mapInArrow(_again(words), "bucket long, node long").distinct(), "node")
        parted = shelf.put(parted.select("bucket", "node", "root"), "parted")
        counts = parted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
        more = counts.agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        rooted = rooted.join(hot.select("bucket"), "bucket", "left_anti").union(parted)
        left = shelf.put(left.where(outside <= AGAIN * BLOCK).union(more), "several-parted")
    dealt = rooted.join(left.select("bucket", "size", outside.alias("outside"), F.col("top.root").alias("top")), "bucket")
    cross = shelf.put(untested(crossing(in_blocks(dealt), False)), "cross")
    if left := cross.count():
        links = links.union(verify(cross, "cross", left))
    roots = shelf.put(components(links, shelf), "all-roots")

    least = roots.join(classes.select("node", "doc"), "node").groupBy("root").agg(F.min("doc").alias("component"))
    least = roots.join(least, "root").select("node", "component")
    named = classes.select("node", F.col("doc").alias("own")).join(least, "node", "left").select("node", F.coalesce("component", "own").alias("component"))
    out = sets.select("doc", "node", "n").join(named, "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")))
    got = result.put(out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")), "near-copies")
    shelf.clear()
    return got


def in_blocks(dealt: DataFrame) -> DataFrame:
    """Rows (``bucket``, ``node``, ``root``, ``size``, ``outside``, ``top``) -> the groups in which pairs across components meet.

    A small bucket is one group. In others the members outside the largest component, in blocks, meet each other's blocks and
    the blocks of the largest component.
    """
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    own, other = blocks(F.col("outside")), blocks(F.col("size") - F.col("outside"))
    is_top = F.col("root") == F.col("top")
    rows = dealt.withColumns({"own": own, "other": other, "is_top": is_top})
    rows = rows.withColumn("k", F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("other")).otherwise(F.col("own")).cast("long")).cast("int"))
    number = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    k = F.col("k")
    among = F.transform(number("own"), lambda o: at(0, F.least(k, o), F.greatest(k, o), F.when(k == o, -1).otherwise((k > o).cast("int"))))
    to_top = F.transform(number("other"), lambda o: at(1, k, o, F.lit(0)))
    of_top = F.transform(number("own"), lambda o: at(1, o, k, F.lit(1)))
    whole = F.array(at(2, F.lit(0), F.lit(0), F.lit(-1)))
    groups = F.when(F.col("size") <= 2 * BLOCK, whole).when(F.col("is_top"), of_top).otherwise(F.concat(among, to_top))
    rows = rows.select("bucket", "node", "root", F.explode(groups).alias("g"))
    return rows.select(F.xxhash64("bucket", "g.kind", "g.i", "g.j").alias("grp"), F.col("bucket").alias("at"), "node", "root", F.col("g.side").alias("side"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document of the least id stays, and rows with a null id all stay. Columns of ``df`` alone.

    Rows that share the id that stays are that document repeated; exact duplicates are another operator's matter.
    """
    (gone_,) = spare(df, "gone")
    found = near_copies(df, id_col, text_col)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(gone_)).distinct()
    many = gone.count() > MOST_BROADCAST
    return df.join(gone if many else F.broadcast(gone), df[id_col].cast("long") == gone[gone_], "left_anti")
