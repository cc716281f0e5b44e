"""Removing repeated strings of 100 bytes by a distributed suffix sort.

Every byte covered by a 100-byte string that also starts earlier (in a document of a smaller id, or earlier in the same one) is removed.

A suffix sort of all bytes isn't needed: only 100-byte prefixes are compared. So suffixes are dealt by content. Each
100-byte window has an anchor, its 32-byte string of least hash; equal windows have equal anchors, so they can be told apart
within one anchor's suffixes. Windows one after another that share an anchor are a run (about 35 windows), and a run's bytes
fix its windows. Runs of equal bytes are told by a hash: all but the first are repeats as a whole, and only one run of each kind
goes on, and only if its anchor has runs of several kinds. Of these the bytes are fetched, and each anchor's pieces are sorted
by the difference cover modulo 3: suffixes at places 1 and 2 modulo 3 are sorted by their triples of symbols, which get names;
where names repeat, the string of names is sorted in the same way; the remaining suffixes are sorted by their first symbol and
the rank that follows it, and merged. Equal windows are then neighbours in suffix order, where their bytes are compared.

An anchor that more than HOT kinds of runs share isn't sorted in one task: its windows are dealt by a 128-bit hash of their bytes.
A batch keeps one of its runs of equal bytes, so a passage in a third of all documents arrives once a batch.

Defined results: a null text counts as empty; a text below 100 bytes keeps all bytes; of rows with one id, the one whose text sorts
first counts as earlier (equal rows: one of them); a null id is the smallest. Texts of any length are judged whole. An empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import batches_of, materialize, ranges_for, spread, table, texts

LENGTH = 100
ANCHOR = 32
#: Bytes of the input's files for each range, in which anchors meet.
RANGE_BYTES = 4 << 20
#: Runs that a worker gathers before it sends them, kinds of runs of an anchor that are sorted in one task, and symbols sorted at once.
BATCH_RUNS = 400_000
HOT = 2000
SYMBOLS = 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 2**64, (3, 256), np.uint64)
_ODD = _rng.integers(0, 2**64, 8, np.uint64) | np.uint64(1)
RUNS, REPEATS = 0, 1  # kinds of rows from a batch
NEEDED, HOT_NEEDED = 2, 3


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash (an anchor's is small, as a least one)."""
    x = (h ^ (h >> np.uint64(31))) * _ODD[7]
    return ((x >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, list[np.ndarray]] = {}


def powers(k: int, n: int) -> list[np.ndarray]:
    """[b**i, b**-i] modulo 2**64 for i up to n."""
    if k not in _powers or len(_powers[k][0]) <= n:
        size = max(n + 1, 1 << 16)
        base = int(_ODD[k])
        _powers[k] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64))]
    return _powers[k]


def substring_hash(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of data[begin:end], k: which of several functions."""
    up, down = powers(k, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[k][data] * up[: len(data)], out=total[1:])
    return finish((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _ODD[6])


def anchors(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each place but the last 31."""
    h = _BYTE[2][data]
    for step, odd in zip((1, 2, 4, 8, 16), _ODD[1:6]):
        h = h[:-step] * odd + (h[step:] ^ (h[step:] >> np.uint64(29)))
    return finish(h)


def runs_of(held: list[bytes]) -> tuple[np.ndarray, ...]:
    """(anchor, bytes' hash, text, first window, windows) of each run of the texts."""
    sizes = np.array([len(t) for t in held], np.int64)
    empty = np.empty(0, np.int64)
    if not (sizes >= LENGTH).any():
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    data = np.frombuffer(b"".join(held), np.uint8)
    h = anchors(data)
    # The place of the first of a window's least hashes: equal windows have it at the same offset, so no two windows of a run are equal.
    low, place, width, wanted = h, np.arange(len(h), dtype=np.int32), 1, LENGTH - ANCHOR + 1
    while width < wanted:
        step = min(width, wanted - width)
        right = low[step:] < low[:-step]
        place = np.where(right, place[step:], place[:-step])
        low = np.minimum(low[:-step], low[step:])
        width += step
    begin = np.cumsum(sizes) - sizes
    last = begin + sizes - LENGTH  # of each text, the last window
    valid = np.zeros(len(low) + 1, bool)
    edge = np.zeros(len(low) + 2, np.int64)
    some = sizes >= LENGTH
    edge[begin[some]] += 1
    edge[last[some] + 1] -= 1
    valid[:] = np.cumsum(edge)[: len(low) + 1] > 0
    new = np.zeros(len(low), bool)
    new[0] = True
    new[1:] = place[1:] != place[:-1]
    new[begin[some]] = True
    new &= valid[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(low))
    text = np.searchsorted(begin, first, side="right") - 1
    stop = np.minimum(stop, last[text] + 1)
    context = substring_hash(data, first, stop + LENGTH - 1, 0)
    return h[place[first]], context, text, first - begin[text], stop - first


def pack(r: int, kind: int, columns: tuple[np.ndarray, ...]) -> tuple[int, int, bytes]:
    """Columns: 64-bit hashes or ids, then first window and number of windows."""
    *wide, first, n = columns
    return kind, r, len(first).to_bytes(8, "little") + b"".join(c.tobytes() for c in wide) + first.astype(np.uint32).tobytes() + n.astype(np.uint8).tobytes()


def unpack(blob: bytes, wide: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    out = [np.frombuffer(blob, np.int64 if k == wide - 1 else np.uint64, n, 8 + 8 * n * k) for k in range(wide)]
    return [*out, np.frombuffer(blob, np.uint32, n, 8 + 8 * n * wide).astype(np.int64), np.frombuffer(blob, np.uint8, n, 8 + 8 * n * wide + 4 * n).astype(np.int64)]


def changes(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def by_range(r: np.ndarray, kind: int, columns: tuple[np.ndarray, ...], ranges: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(r, kind="stable")
    ends = np.searchsorted(r[order], np.arange(ranges), side="right")
    begin = 0
    for k, end in enumerate(ends):
        if end > begin:
            yield pack(k, kind, tuple(c[order[begin:end]] for c in columns))
        begin = end


def rows_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["kind", "r", "data"])


def batch_runs(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (kind, r, data): RUNS with one of each kind of bytes, and REPEATS, the batch's others."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, context, doc, first, n = map(np.concatenate, zip(*held))
        order = np.lexsort((first, doc, context, anchor))
        anchor, context, doc, first, n = anchor[order], context[order], doc[order], first[order], n[order]
        one = changes(anchor, context)
        rows = list(by_range(range_of(anchor[one], ranges), RUNS, (anchor[one], context[one], doc[one], first[one], n[one]), ranges))
        rest = ~one
        rows += by_range(range_of(doc[rest].view(np.uint64), ranges), REPEATS, (doc[rest], first[rest], n[rest]), ranges)
        return rows_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        with np.errstate(over="ignore"):
            for ids, own in batches_of(batches):
                anchor, context, text, first, n = runs_of(own)
                held.append((anchor, context, np.array(ids, np.int64)[text], first, n))
                count += len(anchor)
                if count >= BATCH_RUNS:
                    yield settle(held)
                    held, count = [], 0
            if held:
                yield settle(held)

    return docs.mapInArrow(run, "kind int, r int, data binary")


def grouped(rows: DataFrame, ranges: int, settle, schema: str) -> DataFrame:
    """settle(rows (kind, data)) of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        with np.errstate(over="ignore"):
            for batch in batches:
                for kind, r, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and now != r:
                        yield from settle(held)
                        held = []
                    now = r
                    held.append((kind, data))
            if held:
                yield from settle(held)

    return rows.select("kind", "r", "data").repartitionById(ranges, F.col("r")).sortWithinPartitions("r").mapInArrow(run, schema)


BY_DOC = "doc_id long, kind int, data binary"


def docs_batches(kind: int, columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each document of columns: [hashes,] ids, first windows, numbers of windows."""
    doc = columns[-3]
    order = np.lexsort((columns[-2], doc))
    doc = doc[order]
    begins = np.flatnonzero(changes(doc))
    ends = np.append(begins[1:], len(doc))
    other = [c[order] for k, c in enumerate(columns) if k != len(columns) - 3]
    for at in range(0, len(begins), 5000):
        datas = [np.uint32(b - a).tobytes() + b"".join(c[a:b].astype(np.uint32 if k >= len(other) - 2 else np.uint64).tobytes() for k, c in enumerate(other)) for a, b in zip(begins[at : at + 5000], ends[at : at + 5000])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[begins[at : at + 5000]], pa.int64()), pa.array([kind] * len(datas), pa.int32()), pa.array(datas, pa.binary())], ["doc_id", "kind", "data"])


def of_doc(blobs: list[bytes], wide: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(wide + 2)]
    for b in blobs:
        n = int(np.frombuffer(b, np.uint32, 1)[0])
        for k in range(wide):
            out[k].append(np.frombuffer(b, np.uint64, n, 4 + 8 * n * k))
        for k in range(2):
            out[wide + k].append(np.frombuffer(b, np.uint32, n, 4 + 8 * n * wide + 4 * n * k))
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in out]


def repeated_runs(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Runs of one range: those whose bytes came earlier, by document; and one of each kind of those whose anchor has several kinds."""
    repeats = [unpack(b, 1) for kind, b in rows if kind == REPEATS]
    if repeats:
        yield from docs_batches(REPEATS, tuple(map(np.concatenate, zip(*repeats))))
    parts = [unpack(b, 3) for kind, b in rows if kind == RUNS]
    if not parts:
        return
    anchor, context, doc, first, n = map(np.concatenate, zip(*parts))
    order = np.lexsort((first, doc, context, anchor))
    anchor, context, doc, first, n = anchor[order], context[order], doc[order], first[order], n[order]
    one = changes(anchor, context)
    if not one.all():
        yield from docs_batches(REPEATS, (doc[~one], first[~one], n[~one]))
    anchor, doc, first, n = anchor[one], doc[one], first[one], n[one]
    begins = np.flatnonzero(changes(anchor))
    kinds = np.diff(np.append(begins, len(anchor)))
    kinds = np.repeat(kinds, kinds)
    for kind, some in ((NEEDED, (kinds > 1) & (kinds <= HOT)), (HOT_NEEDED, kinds > HOT)):
        if some.any():
            yield from docs_batches(kind, (anchor[some], doc[some], first[some], n[some]))


PIECES, WINDOWS = 4, 5


def cut_pieces(touched: DataFrame, ranges: int) -> DataFrame:
    """touched: (doc_id, text, needed, hot). PIECES: bytes of runs by anchor; WINDOWS: hashes of the windows of hot anchors."""

    def settle(held: list[tuple[np.ndarray, ...]], data: list[bytes], windows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes]] = []
        if held:
            anchor, doc, first, n = map(np.concatenate, zip(*held))
            r = range_of(anchor, ranges)
            order = np.argsort(r, kind="stable")
            begins = np.flatnonzero(changes(r[order]))
            for at in np.split(order, begins[1:]):
                head = pack(0, 0, (anchor[at], doc[at], first[at], n[at]))[2]
                rows.append((PIECES, int(r[at[0]]), len(head).to_bytes(8, "little") + head + b"".join(data[i] for i in at)))
        if windows:
            a, b, doc, first = map(np.concatenate, zip(*windows))
            rows += by_range(range_of(a, ranges), WINDOWS, (a, b, doc, first, np.ones(len(a))), ranges)
        return rows_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data, windows, size = [], [], [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for doc, text, needed, hot in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if needed:
                        anchor, first, n = of_doc(needed, 1)
                        held.append((anchor, np.full(len(anchor), doc, np.int64), first.astype(np.int64), n.astype(np.int64)))
                        pieces = [text[f : f + m + LENGTH - 1] for f, m in zip(first.tolist(), n.tolist())]
                        data += pieces
                        size += sum(map(len, pieces))
                    if hot:
                        _, first, n = of_doc(hot, 1)
                        own = np.repeat(first.astype(np.int64) - np.cumsum(n, dtype=np.int64) + n, n) + np.arange(int(n.sum()))
                        raw = np.frombuffer(text, np.uint8)
                        windows.append((*(substring_hash(raw, own, own + LENGTH, k) for k in (0, 1)), np.full(len(own), doc, np.int64), own))
                        size += 28 * len(own)
                    if size > 8 << 20:
                        yield settle(held, data, windows)
                        held, data, windows, size = [], [], [], 0
            if held or windows:
                yield settle(held, data, windows)

    return touched.mapInArrow(run, "kind int, r int, data binary")


def suffix_order(t: np.ndarray, length: int = LENGTH, covered: int = 1) -> np.ndarray:
    """Suffixes of t (positive integers) in order of their first length symbols, by the difference cover modulo 3.

    covered: how many symbols of the first string a symbol of t stands for. Names that stand for length symbols needn't be told apart.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    padded = np.concatenate([t, np.zeros(4, np.int64)])
    # Places 1 and 2 modulo 3; if n is 1 modulo 3, the empty suffix at n is sampled too, so that each place 0 has a sampled one after it.
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    ones = len(range(1, n + (n % 3 == 1), 3))
    if int(t.max()) < 1 << 21:
        key = padded[sampled] << 42 | padded[sampled + 1] << 21 | padded[sampled + 2]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
    else:
        order = np.lexsort((padded[sampled + 2], padded[sampled + 1], padded[sampled]))
        new = changes(*(padded[sampled[order] + k] for k in range(3)))
    rank = np.empty(len(sampled), np.int64)
    rank[order] = np.cumsum(new)
    if not new.all():
        if 3 * covered < length:
            order = suffix_order(rank, length, 3 * covered)
        rank[order] = np.arange(1, len(order) + 1)
    ranks = np.zeros(n + 4, np.int64)
    ranks[sampled] = rank
    in_order = sampled[order]
    in_order = in_order[in_order < n]
    zero = np.arange(0, n, 3)
    wide = np.int64(n + 5)
    after_one = lambda i: padded[i] * wide + ranks[i + 1]
    zero = zero[np.argsort(after_one(zero))]
    one, two = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    # Each of the remaining suffixes against both kinds of sampled ones: by a symbol and the rank after it, or two symbols and the rank after them.
    less = np.searchsorted(after_one(one), after_one(zero))
    if max(n + 4, int(t.max())) < 1 << 21:
        after_two = lambda i: padded[i] << 42 | padded[i + 1] << 21 | ranks[i + 2]
        less = less + np.searchsorted(after_two(two), after_two(zero))
    elif len(two):
        both = np.concatenate([two, zero])
        pairs = np.unique(np.stack([padded[both], padded[both + 1]]), axis=1, return_inverse=True)[1].ravel()
        key = pairs * wide + ranks[both + 2]
        less = less + np.searchsorted(key[: len(two)], key[len(two) :])
    less = np.maximum.accumulate(less)  # among suffixes that agree in all of length, any order will do
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + less
    out[at] = zero
    others = np.ones(n, bool)
    others[at] = False
    out[others] = in_order
    return out


def repeated_windows(pieces: list[bytes], n: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, windows) of the pieces' windows whose 100 bytes came earlier in one of them."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    t = np.empty(int(sizes.sum()) + len(pieces), np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    border = begin + sizes
    t[border] = 257 + np.arange(len(pieces))  # each its own, so that no match crosses it
    inside = np.ones(len(t), bool)
    inside[border] = False
    t[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(len(t)) - begin[piece]
    order = suffix_order(t)
    order = order[offset[order] < n[piece[order]]]
    same = np.zeros(len(order), bool)
    raw = np.zeros(len(t) + 8, np.uint8)
    raw[: len(t)][inside] = (t[inside] - 1).astype(np.uint8)
    eight = np.ndarray((len(t),), np.uint64, raw, strides=(1,))  # the eight bytes from each place on
    steps = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    a, b = order[:-1], order[1:]
    left = np.flatnonzero(eight[a] == eight[b])
    for step in steps[1:]:
        left = left[eight[a[left] + step] == eight[b[left] + step]]
    same[left + 1] = True
    some = same.copy()
    some[:-1] |= same[1:]
    group, order = np.cumsum(~same)[some], order[some]
    d, w = doc[piece[order]], first[piece[order]] + offset[order]
    by_place = np.lexsort((w, d, group))
    later = ~changes(group[by_place])
    return d[by_place][later], w[by_place][later]


def as_runs(doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows one after another as (doc, first, number)."""
    order = np.lexsort((window, doc))
    doc, window = doc[order], window[order]
    begins = np.flatnonzero(changes(doc, window - np.arange(len(window))))
    return doc[begins], window[begins], np.diff(np.append(begins, len(doc)))


def sorted_pieces(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The repeats among one range's pieces (by suffix order, whole anchors at a time) and windows (by hash)."""
    windows = [unpack(b, 3) for kind, b in rows if kind == WINDOWS]
    if windows:
        a, b, doc, first, _ = map(np.concatenate, zip(*windows))
        order = np.lexsort((first, doc, b, a))
        later = ~changes(a[order], b[order])
        if later.any():
            yield from docs_batches(REPEATS, as_runs(doc[order][later], first[order][later]))
    heads, data = [], []
    for kind, blob in rows:
        if kind == PIECES:
            at = 8 + int.from_bytes(blob[:8], "little")
            heads.append(unpack(blob[8:at], 2))
            sizes = heads[-1][3] + LENGTH - 1
            ends = at + np.cumsum(sizes)
            data += [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
    if not heads:
        return
    anchor, doc, first, n = map(np.concatenate, zip(*heads))
    order = np.argsort(anchor, kind="stable")
    ends = np.append(np.flatnonzero(changes(anchor[order]))[1:], len(order))
    size = np.cumsum((n + LENGTH)[order])
    begin = 0
    while begin < len(order):
        limit = (size[begin - 1] if begin else 0) + SYMBOLS
        whole = ends[(ends > begin) & (size[ends - 1] <= limit)]
        end = int(whole[-1]) if len(whole) else int(ends[ends > begin][0])
        own = order[begin:end]
        found = repeated_windows([data[i] for i in own], n[own], doc[own], first[own])
        if len(found[0]):
            yield from docs_batches(REPEATS, as_runs(*found))
        begin = end


def keep(text: bytes, blobs: list[bytes]) -> tuple[int, int, bytes]:
    """(bytes removed, spans, what is left) of a text, given its repeated windows."""
    first, n = of_doc(blobs, 0)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, first.astype(np.int64), 1)
    np.add.at(edge, first.astype(np.int64) + n.astype(np.int64) + LENGTH - 1, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n): n orders documents. Where ids are unique and not null, it's the id; else rows are sorted and numbered."""
    plain = texts(docs)
    several = plain.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not several:
        return plain.withColumn("n", F.col("doc_id"))
    return materialize(plain.orderBy("doc_id", "text").withColumn("n", F.monotonically_increasing_id()), "numbered")


def remove_repeats(docs: DataFrame, *, ranges: int | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each row of docs."""
    ranges = ranges or ranges_for(docs, RANGE_BYTES)
    own = numbered(docs)
    plain = own.select(F.col("n").alias("doc_id"), "text")
    step = materialize(grouped(batch_runs(plain, ranges), ranges, repeated_runs, BY_DOC), "runs")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("data")))
    marks = step.groupBy("doc_id").agg(of(REPEATS).alias("repeats"), of(NEEDED).alias("needed"), of(HOT_NEEDED).alias("hot"))
    touched = materialize(plain.join(marks, "doc_id"), "touched")
    pieces = cut_pieces(touched.select("doc_id", "text", "needed", "hot").where("size(needed) > 0 OR size(hot) > 0"), ranges)
    found = grouped(pieces, ranges, sorted_pieces, BY_DOC).groupBy("doc_id").agg(F.collect_list("data").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [keep(text, (some or []) + (more or [])) for text, some, more in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            arrays = [batch.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array([x[2] for x in rows], pa.binary())] if with_text else [])], ["doc_id", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    cut = touched.select("doc_id", "text", "repeats").join(found, "doc_id", "left").mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    bytes_ = F.col("text").cast("binary")
    every = own.select("doc_id", "n", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(bytes_, 256).alias("all_sha256"), *[bytes_.alias("whole")] * with_text)
    out = every.join(cut.withColumnRenamed("doc_id", "n"), "n", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), *[F.coalesce("kept", "whole").alias("kept")] * with_text)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Windows as hex, told apart by 128 bits; spans of repeated ones, and what lies between.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
lists AS (SELECT doc_id, list_transform(range(0, CAST(length(h) // 2 - 99 AS BIGINT)), lambda i: md5_number(substr(h, 2 * i + 1, 200))) AS l FROM d WHERE length(h) >= 200),
w AS MATERIALIZED (SELECT doc_id, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS pos FROM lists),
again AS (SELECT m FROM w GROUP BY 1 HAVING count(*) > 1),
later AS (SELECT doc_id, pos FROM w SEMI JOIN again USING (m) QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, pos) > 1),
gaps AS (SELECT doc_id, pos, pos > lag(pos) OVER o + 100 AS apart FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT doc_id, pos, count(*) FILTER (coalesce(apart, true)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM gaps),
spans AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS b FROM numbered GROUP BY 1, 2),
cut AS (SELECT doc_id, span, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS front FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
