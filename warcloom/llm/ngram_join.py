"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

The document by n-gram incidence matrix A is multiplied with its transpose in blocks that accumulate overlap counts, and
pairs are discarded as soon as their sizes rule them out. The result is exact (n-grams are told apart by a hash of 40
bits and those that number the blocks, which grow with the input).

1. Columns. Each task hashes its documents' n-grams and sends them, packed, to blocks of columns. A block knows how many
   documents have each of its n-grams. A column of one document adds nothing to any product and is dropped here.
2. Rows. The rest goes back to the documents. Two documents of Jaccard similarity t or more share at least t*|x|
   n-grams, so a document with fewer shared columns than that has no partner and is discarded, whatever passages it
   shares. Documents with the same set are one class of copies; the lowest of them alone goes on.
3. First product. Of |x| n-grams, ordered by how many documents have them, a partner must share one of the first
   |x| - ceil(t*|x|) + 1. Over these columns the blocks of A*A' are formed: each emits the overlap that it finds of every
   pair with t*|x| <= |y|, and the overlaps of the blocks are added up. What is left uncounted of a pair lies beyond the
   last of these columns of one of the two, which bounds it; pairs whose count and bound stay below
   t/(1+t)*(|x|+|y|) are discarded.
   A column of HEAVY documents or more lists no pairs, which would be as many as its square: its documents belong to one
   family, as do those of heavy columns that share a document. Any two of a family may be partners.
4. Second product. The pairs left, of different families, are laid out in blocks of rows; a block gets each set that it
   needs once, accumulates the whole overlaps and keeps the pairs above the bound. A family is divided into strips; any
   two of them are a block, whose overlaps are dense products of 0/1 matrices over the columns that both have.

A block of rows either lists its pairs (ngram_jaccard_join) or only counts the links of each document and joins its
documents into classes (ngram_classes): then no more rows leave it than it has documents.

Nothing is broadcast but the code; all intermediate tables are in the shared folder or in shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, gram_hashes, joined, mix, new_dir, one_row_per_id, order_of, remove, slices, text_buffers, trim, word_hashes

N_GRAM = 3
THRESHOLD = 0.6
#: Incidences that a block of columns or of rows holds about, so that it fits in a Python worker, and a flush of documents.
BLOCK, FLUSH = 500_000, 1_000_000
#: Prefix tokens that a block of them holds about: the fewer blocks, the fewer repeats of a candidate pair.
TOKENS = 1_000_000
#: Documents from which a prefix column makes a family. Columns below it list less than HEAVY/2 pairs a token.
HEAVY = 16
#: Rows and columns of a dense 0/1 matrix.
TALL, WIDE = 256, 8192
#: Of the 32 bits that name a column in its block, those of its number; the rest tell which columns belong together.
NUMBER_BITS = 21
#: Pairs up to which one task finds their connected groups.
AT_ONCE = 1_000_000

_COLS = "block long, flush long, docs binary, counts binary, hashes binary"
_SHARED = "flush long, block long, docs binary, counts binary, values binary, dfs binary"
_ROWS = "doc_id long, size long, n_shared long, anchor long, sig binary, n_prefix long, columns binary"
_TOKENS = "block long, hashes binary, docs binary, sizes binary, rest binary"


def least(size, t: float):
    """The fewest n-grams that a set of this size shares with any partner: ceil(t*size), safe against rounding."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def _flat(column) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _join(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(_flat(column)), dtype=dtype)


def _split(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, with the keys that occur and their bounds."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, k[at], np.r_[at, len(k)]


def _blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between bounds, each a binary value."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _steps(index: np.ndarray, at: np.ndarray) -> pa.Array:
    """Numbers, rising from each bound to the next, as differences: for each two bounds the bytes that a difference takes (1, 2 or 4), then those."""
    d = np.diff(index, prepend=0)
    d[at[:-1]] = index[at[:-1]]
    most, n = np.maximum.reduceat(d, at[:-1]), np.diff(at)
    width = np.where(most < 256, 1, np.where(most < 65_536, 2, 4))
    bounds = np.r_[0, np.cumsum(1 + n * width)]
    out = np.zeros(bounds[-1], np.uint8)
    out[bounds[:-1]] = width
    w = np.repeat(width, n)
    pos = np.repeat(bounds[:-1] + 1, n) + (np.arange(len(d)) - np.repeat(at[:-1], n)) * w
    for k in range(int(width.max())):
        here = slice(None) if k == 0 else np.flatnonzero(w > k)
        out[pos[here] + k] = (d[here] >> (8 * k)) & 255
    return _blobs(out, bounds)


def _unstep(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _steps, of all values one after another, and how many each has."""
    data, bounds = text_buffers(column)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = data[bounds[:-1]].astype(np.int64)
    n = (np.diff(bounds) - 1) // width
    first = np.cumsum(n) - n
    w = np.repeat(width, n)
    pos = np.repeat(bounds[:-1] + 1, n) + (np.arange(len(w)) - np.repeat(first, n)) * w
    d = data[pos].astype(np.int64)
    for k in range(1, int(width.max())):
        here = np.flatnonzero(w > k)
        d[here] |= data[pos[here] + k].astype(np.int64) << (8 * k)
    total = np.cumsum(d)
    return total - np.repeat(total[first] - d[first], n), n


def _frequency(count: np.ndarray) -> np.ndarray:
    """Document counts in a byte, in their order: as they are up to 127, then by eighths of a doubling (to 7.7 million)."""
    return np.where(count < 128, count, np.minimum(128 + np.floor(8 * np.log2(np.maximum(count, 128) / 128)), 255)).astype(np.uint8)


def _incidence(n: int, blocks: int):
    """Documents to packed columns, a flush of documents at a time; within one, a document is its number.

    A hash keeps 40 bits beside those that choose its block. A row of block -1-flush has the flush's ids, sizes and
    signatures, and goes past the columns.
    """

    def flush(key, docs, grams):
        ids, sizes = np.concatenate([d for d, _, _ in docs]), np.concatenate([c for _, c, _ in docs])
        sums, xors = (np.concatenate([s[k] for _, _, s in docs]) for k in (0, 1))
        doc = np.repeat(np.arange(len(ids)), sizes)
        h = np.concatenate(grams)
        key_of = mix(h) % np.uint64(blocks)
        order, keys, at = _split(key_of.astype(np.uint16) if blocks < 65_536 else key_of, blocks)
        h = h.view(np.uint8).reshape(-1, 8)[order, :5]
        last = np.stack([sums, xors], 1).tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array([*keys.astype(np.int64).tolist(), -1 - key], pa.int64()),
            pa.array(np.full(len(keys) + 1, key), pa.int64()),
            pa.concat_arrays([_steps(doc[order], at), pa.array([ids.tobytes()], pa.binary())]),
            pa.array([*(b"" for _ in keys), sizes.astype(np.int64).tobytes()], pa.binary()),
            pa.concat_arrays([_blobs(h, at * 5), pa.array([last], pa.binary())]),
        ], names=["block", "flush", "docs", "counts", "hashes"])

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 24
        docs, grams, held = [], [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(b.column(1))
            for i, j in slices(offsets):
                d, h = gram_hashes(*word_hashes(data, offsets[i : j + 1]), n)
                if not len(h):
                    continue
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                m = mix(h)
                docs.append((ids[i:j][d[at]], np.diff(np.r_[at, len(d)]), (np.add.reduceat(m, at), np.bitwise_xor.reduceat(m, at))))
                grams.append(h)
                held += len(h)
                if held >= FLUSH:
                    yield flush(key, docs, grams)
                    docs, grams, held, key = [], [], 0, key + 1
        if held:
            yield flush(key, docs, grams)
        trim()

    return run


def _columns(key, table):
    """A block of columns to the incidences of its columns that more than one document has, by flush of documents."""
    block = key[0].as_py()
    if block < 0:
        none = pa.array([b""] * len(table), pa.binary())
        return pa.table({"flush": table["flush"], "block": table["block"], "docs": table["docs"], "counts": table["counts"], "values": table["hashes"], "dfs": none})
    doc, n = _unstep(table["docs"])
    flush = np.repeat(table["flush"].to_numpy(), n)
    h = np.zeros((len(doc), 8), np.uint8)
    h[:, :5] = _join(table["hashes"], np.uint8).reshape(-1, 5)
    h = h.view(np.uint64)[:, 0]
    order = np.argsort(h)
    h, doc, flush = h[order], doc[order], flush[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(np.r_[at, len(h)])
    number = np.repeat(np.arange(len(at), dtype=np.uint32), count)
    if len(at) >> NUMBER_BITS:
        raise ValueError("a block holds more columns than it has numbers: choose a smaller one")
    # columns of the same first document belong together: most pairs of a family then meet in one block of the first product
    near = mix(np.minimum.reduceat((flush << 24) + doc, at).view(np.uint64)) >> np.uint64(32 + NUMBER_BITS) if len(at) else np.zeros(0, np.uint64)
    number |= np.repeat(near.astype(np.uint32) << np.uint32(NUMBER_BITS), count)
    df = np.repeat(count, count)
    keep = df > 1
    doc, flush, number, df = doc[keep], flush[keep], number[keep], _frequency(df[keep])
    order = np.argsort((flush << 24) + doc)
    doc, flush, number, df = doc[order], flush[order], number[order], df[order]
    at = np.flatnonzero(np.r_[True, flush[1:] != flush[:-1]]) if len(doc) else np.zeros(0, np.int64)
    del h, keep, order, count
    trim()
    bounds = np.r_[at, len(doc)]
    return pa.table({
        "flush": pa.array(flush[at], pa.int64()),
        "block": pa.array([block] * len(at), pa.int64()),
        "docs": _steps(doc, bounds) if len(at) else pa.array([], pa.binary()),
        "counts": pa.array([b""] * len(at), pa.binary()),
        "values": _blobs(number, bounds * 4),
        "dfs": _blobs(df, bounds),
    })


def _survivors(t: float):
    """A flush of documents: those that share enough columns, each with its shared n-grams by document count, and its prefix."""

    def run(key, table):
        import pyarrow.compute as pc

        size_rows, rest = table.filter(pc.less(table["block"], 0)), table.filter(pc.greater_equal(table["block"], 0))
        ids, sizes = _join(size_rows["docs"], np.int64), _join(size_rows["counts"], np.int64)
        sigs = _join(size_rows["values"], np.uint64).reshape(-1, 2)
        per = np.array([len(x) for x in _flat(rest["dfs"])], np.int64)
        column = (np.repeat(rest["block"].to_numpy(), per).astype(np.uint64) << np.uint64(32)) | _join(rest["values"], np.uint32)
        row, _ = _unstep(rest["docs"])
        df = _join(rest["dfs"], np.uint8)
        shared = np.bincount(row, minlength=len(ids))
        keep = (shared >= least(sizes, t)) & (shared > 0)
        mask = keep[row]
        row, column, df = row[mask], column[mask], df[mask]
        order = order_of(column, df, row)
        row, column = row[order], column[order]
        at = np.searchsorted(row, np.flatnonzero(keep))
        out = {c: [] for c in ("doc_id", "size", "n_shared", "anchor", "sig", "n_prefix", "columns")}
        for r, i, j in zip(np.flatnonzero(keep).tolist(), at.tolist(), np.r_[at[1:], len(row)].tolist()):
            size = int(sizes[r])
            x = column[i:j]
            out["doc_id"].append(int(ids[r]))
            out["size"].append(size)
            out["n_shared"].append(j - i)
            out["anchor"].append(int(x.min()))
            out["sig"].append(sigs[r].tobytes() + size.to_bytes(8, "little"))
            # what is left of the prefix after the n-grams of no other document
            out["n_prefix"].append(max(0, size - int(least(size, t)) + 1 - (size - (j - i))))
            out["columns"].append(x.tobytes())
        return pa.table({c: pa.array(v, pa.binary() if c in ("sig", "columns") else pa.int64()) for c, v in out.items()})

    return run


def _together(column: np.ndarray) -> np.ndarray:
    return (column & np.uint64(0xFFFFFFFF)) >> np.uint64(NUMBER_BITS)


def _prefix_counts(batches):
    """How many prefix columns each group of columns that belong together has."""
    n = np.zeros(1 << (32 - NUMBER_BITS), np.int64)
    for b in batches:
        parts = [np.frombuffer(c, np.uint64)[:p] for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        n += np.bincount(_together(np.concatenate([*parts, np.zeros(0, np.uint64)])).astype(np.int64), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["near", "n"])


def _layout(counts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each group of columns its first block and how many it has: small groups share one, large ones are divided."""
    first, parts = np.zeros(1 << (32 - NUMBER_BITS), np.int64), np.ones(1 << (32 - NUMBER_BITS), np.int64)
    block, held = 0, 0
    for near, n in sorted(counts):
        if held and held + n > TOKENS:
            block, held = block + 1, 0
        first[near], parts[near] = block, math.ceil(n / TOKENS)
        held += n
        if held > TOKENS:
            block, held = block + int(parts[near]), 0
    return first, parts


def _tokens(first: np.ndarray, parts_of: np.ndarray):
    """Prefixes to packed (column, document, size, n-grams beyond the prefix) by block of columns."""

    def flush(parts):
        h, d, s, r = (np.concatenate(x) for x in zip(*parts))
        near = _together(h).astype(np.int64)
        order, keys, at = _split(first[near] + (mix(h) % parts_of[near].astype(np.uint64)).astype(np.int64), 0)
        h, d, s, r = h[order], d[order], s[order], r[order]
        cuts = list(zip(at[:-1], at[1:]))
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in (h, d, s.astype(np.int32), r.astype(np.int32)))], names=["block", "hashes", "docs", "sizes", "rest"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for doc, size, columns, prefix in zip(*(b.column(k).to_pylist() for k in range(4))):
                whole = np.frombuffer(columns, np.uint64)
                h = whole[:prefix]
                if not len(h):
                    continue
                parts.append((h, np.full(len(h), doc, np.int64), np.full(len(h), size), np.full(len(h), len(whole) - prefix)))
                held += len(h)
                if held >= BLOCK:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _partial(t: float):
    """A block of A*A' over prefix columns: the pairs that their sizes allow with the overlap found in this block, and the
    overlap that they need there. Heavy columns give a row of overlap 0 for each document of a family but its lowest; pairs
    within a family aren't listed."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        h, d, s, r = (np.concatenate([_join(b.column(c), dt) for b in batches]) for c, dt in (("hashes", np.uint64), ("docs", np.int64), ("sizes", np.int32), ("rest", np.int32)))
        ids, d = np.unique(d, return_inverse=True)
        size, rest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        size[d], rest[d] = s, r
        order = np.lexsort((size[d], h))
        h, d = h[order], d[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        per = np.diff(np.r_[at, len(h)])
        heavy = np.repeat(per >= HEAVY, per)
        family = joined(len(ids), np.repeat(d[at], per)[heavy], d[heavy])
        member = np.flatnonzero(family != np.arange(len(ids)))
        if len(member):
            none = pa.array(np.zeros(len(member), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[family[member]]), pa.array(ids[member]), none, none], names=["doc_a", "doc_b", "overlap", "need"])
        column, d = np.repeat(np.arange(len(at)), per)[~heavy], d[~heavy]
        s = size[d]
        n = len(d)
        # by size within a column: partners of k are those after it with t*size <= size_k
        limit = np.minimum(np.floor(s / t + 1e-9), 2**31 - 1).astype(np.int64)
        upto = np.searchsorted((column << 32) + s, (column << 32) + limit, side="right")
        count = upto - np.arange(n) - 1
        whole = np.cumsum(np.maximum(count, 0))
        held, n_held = [], 0

        def told():
            pair, overlap = _added([x for x, _ in held], [x for _, x in held])
            a, b = pair // len(ids), pair % len(ids)
            # the overlap that these columns must show: the pair's bound without the most that can lie beyond them
            need = np.ceil((size[a] + size[b]) * t / (1 + t) - 1e-9).astype(np.int64) - np.maximum(rest[a], rest[b])
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(overlap, pa.int32()), pa.array(need, pa.int32())], names=["doc_a", "doc_b", "overlap", "need"])

        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(whole, (whole[i - 1] if i else 0) + BLOCK, side="right")))
            c = np.maximum(count[i:j], 0)
            left = np.repeat(np.arange(i, j), c)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            left, right = d[left], d[right]
            apart = family[left] != family[right]
            left, right = left[apart], right[apart]
            held.append(_added([np.minimum(left, right) * len(ids) + np.maximum(left, right)], [np.ones(len(left), np.int64)]))
            n_held += len(held[-1][0])
            if n_held > 2 * BLOCK:
                held = [_added([x for x, _ in held], [x for _, x in held])]
                n_held = len(held[0][0])
                if n_held > 2 * BLOCK:
                    yield told()
                    held, n_held = [], 0
            i = j
        if n_held:
            yield told()
        del h, d, s, r, column, limit, held, upto, count, whole
        trim()

    return run


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys, each once, with the sum of its counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order, found, at = _split(key, 0)
    return found, (np.add.reduceat(n[order], at[:-1]) if len(found) else n)


def _dense(t: float, listed: bool, square: bool, sets: pa.Table) -> pa.Table:
    """Two strips of a family, or one with itself (square): what _products returns, of all pairs of a row of each."""
    ids, sizes, copies, side = (sets[c].to_numpy() for c in ("doc_id", "size", "copies", "side"))
    order = np.lexsort((ids, sizes, side))
    blobs = sets["columns"].to_pylist()
    grams = [np.frombuffer(blobs[k], np.uint64) for k in order]
    ids, sizes, copies, side = ids[order], sizes[order], copies[order], side[order]
    start = np.r_[0, np.cumsum([len(g) for g in grams])]
    _, code = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(ids)), np.diff(start))
    del grams, blobs
    cut_at = len(ids) if square else int(np.searchsorted(side, side[-1]))
    first = [(i, min(i + TALL, cut_at)) for i in range(0, cut_at, TALL)]
    second = first if square else [(i, min(i + TALL, len(ids))) for i in range(cut_at, len(ids), TALL)]
    has = {x: np.unique(code[start[x[0]] : start[x[1]]]) for x in {*first, *second}}
    number = np.full(len(code), -1, np.int64)
    links, root, found = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

    def matrix(x, low, n):
        c = number[code[start[x[0]] : start[x[1]]]] - low
        there = (c >= 0) & (c < n)
        m = np.zeros((x[1] - x[0], n), np.float32)
        m[row[start[x[0]] : start[x[1]]][there] - x[0], c[there]] = 1
        return m

    for x in first:
        mark = np.zeros(len(code), bool)
        mark[has[x]] = True
        for y in second:
            # by size within a strip: the first row of each is its least
            most = max(sizes[x[0]], sizes[y[0]])
            if square and y < x or most * t > min(sizes[x[1] - 1], sizes[y[1] - 1]) + 1e-9:
                continue
            common = has[y][mark[has[y]]]
            if len(common) < least(most, t):
                continue
            number[common] = np.arange(len(common))
            overlap = np.zeros((x[1] - x[0], y[1] - y[0]))
            for low in range(0, len(common), WIDE):
                n = min(WIDE, len(common) - low)
                overlap += matrix(x, low, n) @ matrix(y, low, n).T
            number[common] = -1
            both = sizes[x[0] : x[1], None] + sizes[None, y[0] : y[1]]
            keep = overlap * (1 + t) >= t * both - 1e-9
            if x == y:
                keep = np.triu(keep, 1)
            a, b = np.nonzero(keep)
            if listed:
                found.append((ids[a + x[0]], ids[b + y[0]], overlap[a, b].astype(np.int64), both[a, b]))
                continue
            links[x[0] : x[1]] += keep @ copies[y[0] : y[1]]
            links[y[0] : y[1]] += copies[x[0] : x[1]] @ keep
            a, b = a + x[0], b + y[0]
            new = root[a] != root[b]
            if new.any():
                root = joined(len(ids), np.r_[np.arange(len(ids)), a[new]], np.r_[root, b[new]])
    del code, row, number
    trim()
    if listed:
        a, b, overlap, both = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(4))
        return pa.table({"doc_a": np.minimum(a, b), "doc_b": np.maximum(a, b), "overlap": overlap, "jaccard": overlap / (both - overlap)})
    linked = links > 0
    return pa.table({"doc_id": ids[linked], "root": ids[root[linked]], "links": links[linked]})


def _products(t: float, listed: bool):
    """A block of pairs with the sets that it needs: the overlaps, and of those the ones above the bound. Listed, or as
    links counted for each document (`links`: other documents, their copies included) and a forest of their classes."""

    def run(key, pairs, sets):
        if key[1].as_py() >= 0:
            return _dense(t, listed, key[1] == key[2], sets)
        ids, sizes, copies = (sets[c].to_numpy() for c in ("doc_id", "size", "copies"))
        order = np.argsort(ids)
        blobs = sets["columns"].to_pylist()
        grams = [np.frombuffer(blobs[k], np.uint64) for k in order]
        ids, sizes, copies = ids[order], sizes[order], copies[order]
        start = np.r_[0, np.cumsum([len(g) for g in grams])]
        _, code = np.unique(np.concatenate(grams), return_inverse=True) if grams else (None, np.zeros(0, np.int64))
        a, b = np.searchsorted(ids, pairs["doc_a"].to_numpy()), np.searchsorted(ids, pairs["doc_b"].to_numpy())
        o = np.argsort(a, kind="stable")
        a, b = a[o], b[o]
        at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        overlap = np.zeros(len(a), np.int64)
        mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
        for i, j in zip(at.tolist(), np.r_[at[1:], len(a)].tolist()):
            own = code[start[a[i]] : start[a[i] + 1]]
            mark[own] = True
            for p in range(i, j, 4096):
                q = min(j, p + 4096)
                n = start[b[p:q] + 1] - start[b[p:q]]
                first = np.cumsum(n) - n
                rows = np.repeat(start[b[p:q]] - first, n) + np.arange(int(n.sum()))
                overlap[p:q] = np.add.reduceat(mark[code[rows]].astype(np.int64), first)
            mark[own] = False
        both = sizes[a] + sizes[b]
        keep = overlap * (1 + t) >= t * both - 1e-9
        del code, grams, blobs, mark
        trim()
        a, b, overlap, both = a[keep], b[keep], overlap[keep], both[keep]
        if listed:
            return pa.table({"doc_a": pa.array(ids[a], pa.int64()), "doc_b": pa.array(ids[b], pa.int64()), "overlap": pa.array(overlap, pa.int64()), "jaccard": pa.array(overlap / (both - overlap), pa.float64())})
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = joined(len(ids), a, b)
        linked = links > 0
        return pa.table({"doc_id": pa.array(ids[linked], pa.int64()), "root": pa.array(ids[root[linked]], pa.int64()), "links": pa.array(links[linked].astype(np.int64))})

    return run


_PAIRS = "doc_a long, doc_b long, overlap long, jaccard double"
_LINKS = "doc_id long, root long, links long"


def _surviving(docs: DataFrame, threshold: float, n: int, block: int, at: str) -> tuple[DataFrame, DataFrame, int]:
    """The rows that may have partners, one for each set with its number of copies; the copies' leads; the number of blocks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / 6 / block))
    columns = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_incidence(n, blocks), _COLS)
    shared = columns.groupBy("block").applyInArrow(_columns, _SHARED)
    rows = cut(shared.groupBy("flush").applyInArrow(_survivors(threshold), _ROWS), f"{at}/rows", "zstd")
    # documents of the same set: an id and a count for each of them that has copies
    lead = cut(rows.groupBy("sig").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies")).where("copies > 1"), f"{at}/lead")
    same = cut(rows.select("doc_id", "size", "sig").join(lead, "sig").select("doc_id", "lead", "size", "copies"), f"{at}/same")
    known = rows.drop("sig").join(same.select("doc_id", "lead", "copies"), "doc_id", "left").where("lead IS NULL OR lead = doc_id")
    first = cut(known.drop("lead").fillna(1, ["copies"]), f"{at}/first", "zstd")
    remove(docs.sparkSession, f"{at}/rows")
    return first, same, blocks


def _multiplied(first: DataFrame, threshold: float, block: int, blocks: int, at: str, listed: bool) -> DataFrame:
    """Both products over the rows of different sets."""
    t = threshold
    counts = first.select("columns", "n_prefix").mapInArrow(_prefix_counts, "near long, n long").groupBy("near").agg(F.sum("n").alias("n")).collect()
    parts = first.select("doc_id", "size", "columns", "n_prefix").mapInArrow(_tokens(*_layout([tuple(r) for r in counts])), _TOKENS).groupBy("block").applyInArrow(_partial(t), "doc_a long, doc_b long, overlap int, need int")
    parts = cut(parts, f"{at}/parts")
    family = groups(parts.where("overlap = 0").select("doc_a", "doc_b"))
    pairs = parts.where("overlap > 0").groupBy("doc_a", "doc_b").agg(F.sum("overlap").alias("overlap"), F.first("need").alias("need")).where("overlap >= need").select("doc_a", "doc_b")
    # families of several blocks of columns are one: it has the pairs of its documents
    of = [family.select(F.col("doc_id").alias(f"doc_{x}"), F.col("group").alias(f"family_{x}")) for x in "ab"]
    pairs = pairs.join(of[0], "doc_a", "left").join(of[1], "doc_b", "left").where("NOT family_a <=> family_b OR family_a IS NULL").select("doc_a", "doc_b")
    pairs = cut(pairs.join(first.select(F.col("doc_id").alias("doc_a"), "anchor"), "doc_a"), f"{at}/pairs")
    # A block of rows: documents with the same least n-gram are near each other; large ones are divided in both directions.
    per = pairs.groupBy("anchor").agg(F.ceil(F.sqrt(F.count("*") / float(block))).cast("long").alias("parts"))
    pairs = pairs.join(per, "anchor").select("doc_a", "doc_b", F.xxhash64(F.pmod(F.xxhash64("anchor"), F.lit(64 * blocks)), F.pmod(F.xxhash64("doc_a"), "parts"), F.pmod(F.xxhash64("doc_b"), "parts")).alias("tile"))
    pairs = cut(pairs, f"{at}/tiles")
    needed = pairs.select(F.col("tile").alias("at"), F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct().select("doc_id", "at", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("side"))
    # strips of about as many incidences as a block; every two of a family's are one, and so is each with itself
    strips = family.join(first.select("doc_id", "n_shared"), "doc_id").groupBy("group").agg(F.ceil(F.sum("n_shared") / float(block)).cast("int").alias("strips"))
    side = family.join(strips, "group").withColumn("side", F.pmod(F.xxhash64("doc_id"), "strips").cast("int"))
    laid = side.select("doc_id", "group", "side", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("other"))
    laid = laid.select("doc_id", F.col("group").alias("at"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    sets = needed.unionByName(laid).join(first.select("doc_id", "size", "copies", "columns"), "doc_id")
    pairs = pairs.withColumns({"i": F.lit(-1), "j": F.lit(-1)})
    return pairs.groupBy("tile", "i", "j").cogroup(sets.groupBy("at", "i", "j")).applyInArrow(_products(t, listed), _PAIRS if listed else _LINKS)


def _prepared(docs: DataFrame, threshold: float) -> DataFrame:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    return one_row_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_GRAM, block: int = BLOCK) -> DataFrame:
    """Pairs (doc_a < doc_b, overlap, jaccard) of documents with Jaccard similarity >= threshold over their sets of word n-grams.

    Words are runs of characters other than ASCII white space, in lower case; a text of 1 to n-1 words has one n-gram.
    Documents with the same set are each paired with the lowest doc_id among them (jaccard 1), and only that one is
    compared with others, so a group of m exact copies takes m-1 rows, not m*m.

    Rows without doc_id, and null, empty or blank texts, are in no pair. Of rows with the same doc_id the greatest text
    counts. Other columns are ignored, whatever their names. No documents give no pairs.
    """
    docs = _prepared(docs, threshold)
    at = new_dir(docs.sparkSession, "ngram-join")
    first, same, blocks = _surviving(docs, threshold, n, block, at)
    copies = same.where("doc_id <> lead").select(F.col("lead").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.col("size").alias("overlap"), F.lit(1.0).alias("jaccard"))
    out = cut(_multiplied(first, threshold, block, blocks, at, True).unionByName(copies), f"{at}-pairs")
    remove(docs.sparkSession, at)
    return out


def ngram_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of the documents that have a partner at `threshold`.

    n_links is the number of other documents with Jaccard similarity >= threshold, copies included, and class_id the
    lowest doc_id of the documents that such links connect. Rows, texts and ties are taken as by ngram_jaccard_join; no
    link is left out, though pairs are nowhere listed.
    """
    docs = _prepared(docs, threshold)
    spark = docs.sparkSession
    at = new_dir(spark, "ngram-classes")
    first, same, blocks = _surviving(docs, threshold, n, block, at)
    near = cut(_multiplied(first, threshold, block, blocks, at, False), f"{at}/near")
    links = near.groupBy("doc_id").agg(F.sum("links").alias("links"))
    label = groups(near.where("doc_id <> root").select(F.col("root").alias("doc_a"), F.col("doc_id").alias("doc_b")))
    # what holds of a set's lead holds of its copies, which are linked to each other besides
    copied = same.select("doc_id", "lead", (F.col("copies") - 1).alias("others"))
    led = links.join(label, "doc_id", "left").select(F.col("doc_id").alias("lead"), "links", F.coalesce("group", "doc_id").alias("group"))
    of_copies = copied.join(led, "lead", "left").select("doc_id", F.coalesce("group", "lead").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("others")).alias("n_links"))
    alone = led.join(same.where("doc_id = lead").select("lead"), "lead", "left_anti").select(F.col("lead").alias("doc_id"), F.col("group").alias("class_id"), F.col("links").alias("n_links"))
    out = cut(of_copies.unionByName(alone), f"{at}-classes")
    remove(spark, at)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_GRAM, block: int = BLOCK) -> DataFrame:
    """ngram_classes with a row for every doc_id: a document without partner is a class of its own, with no links.

    Rows without doc_id have no row; a doc_id that repeats has one. No documents give no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    found = ngram_classes(docs, threshold, n, block)
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _components(table: pa.Table) -> pa.Table:
    """The connected components of all pairs of a table."""
    a, b = (table[c].to_numpy() for c in ("doc_a", "doc_b"))
    ids, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    return pa.table({"doc_id": ids, "group": ids[joined(len(ids), number[: len(a)], number[len(a) :])]})


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): connected components of the pairs, named by their lowest doc_id. Of more than AT_ONCE pairs they are
    found in rounds, each of which is cut into a table."""
    spark = pairs.sparkSession
    at = new_dir(spark, "groups")
    if pairs.count() <= AT_ONCE:
        return cut(pairs.select("doc_a", "doc_b").groupBy(F.lit(0).alias("all")).applyInArrow(_components, "doc_id long, group long"), f"{at}-out")
    edges = cut(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).unionByName(pairs.select(F.col("doc_b").alias("a"), F.col("doc_a").alias("b"))).distinct(), f"{at}/edges")
    label = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{at}/label-0")
    k = 0
    while True:
        k += 1
        heard = edges.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        step = label.join(heard, "a").select("a", F.least("label", "heard").alias("label"))
        # a shortcut through the label's own label halves long chains
        over = cut(step, f"{at}/step-{k}")
        far = over.select(F.col("a").alias("label"), F.col("label").alias("far"))
        after = over.join(far, "label", "left").select("a", F.least("label", F.coalesce("far", "label")).alias("label"))
        fresh = cut(after, f"{at}/label-{k}")
        changed = not fresh.join(label.withColumnRenamed("label", "old"), "a").where("label <> old").isEmpty()
        label = fresh
        if not changed:
            break
    out = cut(label.select(F.col("a").alias("doc_id"), F.col("label").alias("group")), f"{at}-out")
    remove(spark, at)
    return out


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP6_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N_GRAM} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {N_GRAM - 2}), lambda i: array_to_string(list_slice(w, i, i + {N_GRAM - 1}), ' '))) END AS g FROM words
), sets AS (SELECT doc_id, len(g) AS n, g FROM grams WHERE len(g) > 0
), item AS (SELECT doc_id, n, unnest(g) AS x FROM sets
), near AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS overlap
  FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), pair AS (SELECT doc_a, doc_b FROM near WHERE overlap * {1 + THRESHOLD} >= {THRESHOLD} * (na + nb) - 1e-9
), link AS (SELECT doc_a, doc_b FROM pair UNION ALL SELECT doc_b, doc_a FROM pair
), reach(doc_id, other) AS (SELECT doc_a, doc_b FROM link UNION SELECT r.doc_id, l.doc_b FROM reach r JOIN link l ON r.other = l.doc_a
), class AS (SELECT doc_id, least(doc_id, min(other)) AS class_id FROM reach GROUP BY doc_id
), links AS (SELECT doc_a AS doc_id, count(*) AS n_links FROM link GROUP BY 1
)
SELECT d.doc_id AS doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN class ON d.doc_id = class.doc_id LEFT JOIN links ON d.doc_id = links.doc_id
"""
