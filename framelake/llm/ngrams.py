"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, counted in Spark, kept as sorted hash arrays.

Texts are words and one end each. A batch counts its own words and pairs as 64-bit hashes, and cuts them to ranges of the hash (a
pair's: that of its first word). A range's counts are added in one task, so a frequent pair arrives once a batch, not once an
occurrence. That task writes the range's sorted arrays to the shared folder: pairs and their counts, first words and the
number of their pairs of count 1, 2 and more. It tells each second word of how many different words it follows; in the same
way these numbers and the words' own counts make the sorted arrays of words.

Workers map the files into memory and look up a batch's words and pairs by sorted search. The driver gets counts of counts alone.

Probability of w after v: (max(0, c - D(c)) + (D1 n1 + D2 n2 + D3 n3) * lower) / sum of c after v, where D is from the counts of
counts (Chen and Goodman); lower is the same with the numbers of words that w follows, over all of w; below it, the V words of
training and an unknown one are alike. After a word never seen, lower alone counts.

Files have fixed names and contents, and appear under their names when they are whole: a task that is run again, on any executor,
writes the same. The number of ranges follows the input's size, so that a task holds a bounded share; counts have 32 bits where all of an
array fit, else 64.

Defined results: a null text counts as empty; an empty text is its end alone; with no training text, N and V are 0, and both scores
of any text are 0. A null id counts as text "null" where rows are held out. Texts of any length are scored whole; repeated rows are
rows of their own; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import batches_of, new_folder, ranges_for, release, spread, table, texts

#: Bytes of the input's files for each range of hash.
RANGE_BYTES = 4 << 20
#: Bytes of text whose pairs a worker counts before it sends them, and that it scores at once.
COUNTED_BYTES = 12 << 20
SCORED_BYTES = 4 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END, START = 0x1B873593CC9E2D51, 0x52DCE729DA3ED7A5
#: The arrays of a range's files, after the hashes: words (count, words before), first words (sum, pairs of count 1, 2, more), pairs (count).
WIDTH = {"words": 2, "firsts": 4, "pairs": 1}


class TokenHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = xxhash.xxh3_64_intdigest(word)
        if len(word) < 100:
            self[word] = x
        return x


_hashes = TokenHashes()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * K1 + b
    x = (x ^ (x >> np.uint64(32))) * K2
    return x ^ (x >> np.uint64(29))


def tokens_of(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, hashes of the token before each, lengths): words and an end of each text."""
    parts, known = [], _hashes
    lengths = np.empty(len(held), np.int64)
    for k, text in enumerate(held):
        words = text.lower().split()  # of bytes: ASCII letters and ASCII white space alone
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter([known[w] for w in words], np.uint64, len(words))
        h[-1] = END
        parts.append(h)
        lengths[k] = len(h)
    tokens = np.concatenate(parts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return tokens, before, lengths


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def range_ends(h: np.ndarray, ranges: int) -> np.ndarray:
    """Of sorted hashes, where each range ends."""
    step = 2**64 // ranges
    return np.append(np.searchsorted(h, np.array([step * i for i in range(1, ranges)], np.uint64)), len(h))


def narrowest(*counts: np.ndarray) -> type:
    """The type that holds all counts."""
    return np.uint64 if any(len(c) and int(c.max()) >= 1 << 32 for c in counts) else np.uint32


def words_blobs(kind: int, h: np.ndarray, count: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    begin = 0
    for r, end in enumerate(range_ends(h, ranges)):
        if end > begin:
            yield kind, r, words_blob(h[begin:end], count[begin:end])
        begin = end


def words_blob(h: np.ndarray, count: np.ndarray) -> bytes:
    """How many, the hashes, and the counts, whose width follows from the length."""
    return len(h).to_bytes(8, "little") + h.tobytes() + count.astype(narrowest(count)).tobytes()


def words_from(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b in blobs:
        n = int.from_bytes(b[:8], "little")
        hashes.append(np.frombuffer(b, np.uint64, n, 8))
        counts.append(np.frombuffer(b, np.uint32 if len(b) == 8 + 12 * n else np.uint64, n, 8 + 8 * n).astype(np.int64))
    h, count = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    begins = runs(h[order])
    return h[order][begins], sums(count[order], begins)


WORDS, FOLLOWS, PAIRS = 0, 1, 2


def count_batches(training: DataFrame, ranges: int) -> DataFrame:
    """Rows (kind, r, data) of each batch: WORDS with their counts; PAIRS as sorted first words, how many second words each has, these, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for _, held in batches_of(batches, COUNTED_BYTES):
                tokens, before, _ = tokens_of(held)
                rows = list(words_blobs(WORDS, *np.unique(tokens, return_counts=True), ranges))
                order = np.lexsort((tokens, before))
                first, second = before[order], tokens[order]
                del order, tokens, before
                begins = runs(first, second)
                count = np.diff(np.append(begins, len(first)))
                first, second = first[begins], second[begins]
                begin = 0
                for r, end in enumerate(range_ends(first, ranges)):
                    if end > begin:
                        f = first[begin:end]
                        at = runs(f)
                        head = np.array([len(at), end - begin], np.int64).tobytes()
                        rows.append((PAIRS, r, head + f[at].tobytes() + np.diff(np.append(at, len(f))).astype(np.uint32).tobytes() + second[begin:end].tobytes() + count[begin:end].astype(np.uint32).tobytes()))
                    begin = end
                yield as_batch(rows)
                del rows, first, second, count, begins
        _hashes.clear()
        release()

    return training.mapInArrow(run, "kind int, r int, data binary")


def pairs_from(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, second words, counts) of a range, sorted and added."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for b in blobs:
        n, m = np.frombuffer(b, np.int64, 2)
        at = 16
        first = np.frombuffer(b, np.uint64, n, at)
        lengths = np.frombuffer(b, np.uint32, n, at := at + 8 * n)
        parts[0].append(np.repeat(first, lengths))
        parts[1].append(np.frombuffer(b, np.uint64, m, at := at + 4 * n))
        parts[2].append(np.frombuffer(b, np.uint32, m, at + 8 * m))
    first, second, count = map(np.concatenate, parts)
    order = np.lexsort((second, first))
    first, second, count = first[order], second[order], count[order].astype(np.int64)
    begins = runs(first, second)
    return first[begins], second[begins], sums(count, begins)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["kind", "r", "data"])


def by_range(blobs: DataFrame, ranges: int, settle: Callable[[int, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """settle(r, rows (kind, data)) of each range; a task holds the rows of one range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        with np.errstate(over="ignore"):
            for batch in batches:
                for kind, r, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and now != r:
                        yield from settle(now, held)
                        held = []
                    now = r
                    held.append((kind, data))
            if held:
                yield from settle(now, held)

    return blobs.select("kind", "r", "data").repartitionById(ranges, F.col("r")).sortWithinPartitions("r", "kind").mapInArrow(run, schema)


def uri_of(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def put(folder: str, name: str, h: np.ndarray, *counts: np.ndarray) -> None:
    """Write hashes and then counts, one array after another, all of the width that the largest needs; the file appears under its name when it is whole."""
    width = narrowest(*counts)
    arrays = [np.array([np.dtype(width).itemsize], np.uint64), h, *(c.astype(width) for c in counts)]
    fs, path = pafs.FileSystem.from_uri(uri_of(folder))
    fs.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for a in arrays:
            f.write(a.tobytes())
    fs.move(part, f"{path}/{name}")


_maps: dict[tuple[str, str], list[np.ndarray]] = {}


def get(folder: str, name: str, columns: int) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory. From a store that isn't a file system, a copy is mapped; its name is removed at once, so nothing is left when the worker ends."""
    if (folder, name) not in _maps:
        if len(_maps) and next(iter(_maps))[0] != folder:
            _maps.clear()  # of a model before
        fs, path = pafs.FileSystem.from_uri(uri_of(folder))
        file = f"{path}/{name}"
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.memmap(file, np.uint8, "r")
        else:
            with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(file) as f:
                while data := f.read(1 << 20):
                    copy.write(data)
                copy.flush()
                raw = np.memmap(copy.name, np.uint8, "r")
        width = int(raw[:8].view(np.uint64)[0])
        n = (len(raw) - 8) // (8 + width * columns)
        parts = np.cumsum([8, 8 * n, *[width * n] * columns])
        _maps[folder, name] = [raw[a:b].view(np.uint64 if k == 0 or width == 8 else np.uint32) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
    return _maps[folder, name]


def counts_of_counts(kind: str, c: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, k, how many) for k from 1 to 4; k 0: the sum; k -1: how many in all; k -3: how many are 3 or more."""
    return [(kind, 0, int(c.sum())), (kind, -1, int((c > 0).sum())), (kind, -3, int((c >= 3).sum())), *((kind, k, int((c == k).sum())) for k in (1, 2, 3, 4))]


def told(rows: list[tuple[str, int, int]]) -> list[tuple[int, int, bytes]]:
    return [({"words": 10, "before": 11, "pairs": 12}[kind], k, n.to_bytes(8, "big", signed=True)) for kind, k, n in rows]


def train(training: DataFrame, *, ranges: int | None = None) -> dict:
    """Counts training (doc_id, text), writes the model, and returns its description: folder, ranges, N, V, discounts and sums."""
    spark = training.sparkSession
    ranges = ranges or ranges_for(training, RANGE_BYTES)
    folder = new_folder(spark, "model")

    def add_pairs(r: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        if own := [data for kind, data in rows if kind == WORDS]:  # added here, they go on to the next step
            h, count = words_from(own)
            out.append((WORDS, r, words_blob(h, count)))
        if blobs := [data for kind, data in rows if kind == PAIRS]:
            first, second, count = pairs_from(blobs)
            begins = runs(first)
            ones = [sums((count == k if k < 3 else count >= 3).astype(np.int64), begins) for k in (1, 2, 3)]
            put(folder, f"firsts-{r}", first[begins], sums(count, begins), *ones)
            h = pair_hash(first, second)
            order = np.argsort(h)
            put(folder, f"pairs-{r}", h[order], count[order])
            out += told(counts_of_counts("pairs", count))
            del first, h, order
            out += words_blobs(FOLLOWS, *np.unique(second, return_counts=True), ranges)
        yield as_batch(out)

    def add_words(r: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        out = [(kind, r, data) for kind, data in rows if kind >= 10]
        h, count = words_from([data for kind, data in rows if kind == WORDS])
        if len(h):
            b, before = words_from([data for kind, data in rows if kind == FOLLOWS])
            all_before = np.zeros(len(h), np.int64)
            all_before[np.searchsorted(h, b)] = before  # each second word is a word of training
            put(folder, f"words-{r}", h, count, all_before)
            out += told(counts_of_counts("words", count) + counts_of_counts("before", all_before))
        yield as_batch(out)

    schema = "kind int, r int, data binary"
    first_step = by_range(count_batches(training, ranges), ranges, add_pairs, schema)
    first_folder = new_folder(spark, "follows")
    first_step.write.option("compression", "zstd").parquet(first_folder)
    step = spark.read.schema(schema).parquet(first_folder)
    words = by_range(step.where("kind < 10"), ranges, add_words, schema).where("kind >= 10")
    totals = words.union(step.where("kind >= 10")).groupBy("kind", "r").agg(F.sum(F.conv(F.hex("data"), 16, 10).cast("long")).alias("n"))
    found = {(x["kind"], x["r"]): x["n"] for x in totals.collect()}  # three kinds of seven numbers

    def discounts(kind: int) -> tuple[float, float, float]:
        n = [found.get((kind, k), 0) for k in range(5)]
        if not n[1] or not n[2]:
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
        return tuple(min(max(x, 0.01 * k), 0.99 * k) for k, x in zip((1, 2, 3), d))

    v, before = found.get((10, -1), 0), found.get((11, 0), 0)
    d = discounts(11)
    left = sum(x * found.get((11, k), 0) for x, k in zip(d, (1, 2, -3))) / before if before else 1.0
    return {"folder": folder, "ranges": ranges, "n": found.get((10, 0), 0), "v": v, "before": before, "left": left, "lower": d, "upper": discounts(12)}


def lookup(model: dict, name: str, h: np.ndarray, by: np.ndarray, there: set[str]) -> list[np.ndarray]:
    """The columns of each of the hashes h, 0 where it isn't there; by: sorted hashes that tell the range."""
    out = [np.zeros(len(h), np.int64) for _ in range(WIDTH[name])]
    begin = 0
    for r, end in enumerate(range_ends(by, model["ranges"])):
        if end > begin and f"{name}-{r}" in there:
            keys, *columns = get(model["folder"], f"{name}-{r}", WIDTH[name])
            wanted = h[begin:end]
            order = np.argsort(wanted)
            at = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
            hit = keys[at] == wanted[order]
            for o, c in zip(out, columns):
                o[begin:end][order[hit]] = c[at[hit]]
        begin = end
    return out


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0, c - np.array([0.0, *d])[np.minimum(c, 3)])


def score_batch(model: dict, held: list[bytes], there: set[str]) -> tuple[np.ndarray, ...]:
    """(tokens, known ones, base score, score) of each text."""
    tokens, before, lengths = tokens_of(held)
    words, at = np.unique(tokens, return_inverse=True)
    count, follows = lookup(model, "words", words, words, there)
    base = np.log10((count + 1) / (model["n"] + model["v"] + 1))[at]
    known = (count > 0)[at]
    alike = model["left"] / (model["v"] + 1)
    lower = (discounted(follows, model["lower"]) / max(1, model["before"]) + alike)[at]
    del words, count, follows
    order = np.argsort(before, kind="stable")
    sorted_before = before[order]
    (c,) = lookup(model, "pairs", pair_hash(sorted_before, tokens[order]), sorted_before, there)
    begins = runs(sorted_before)
    firsts = lookup(model, "firsts", sorted_before[begins], sorted_before[begins], there)
    total, *n = (np.repeat(x, np.diff(np.append(begins, len(order)))) for x in firsts)
    d = model["upper"]
    seen = np.maximum(1, total)
    p = np.where(total > 0, discounted(c, d) / seen + (d[0] * n[0] + d[1] * n[1] + d[2] * n[2]) / seen * lower[order], lower[order])
    log = np.empty(len(order))
    log[order] = np.log10(p)
    starts = np.cumsum(lengths) - lengths
    return lengths, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(log, starts)


def score(docs: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """docs: (doc_id, text). Scores each row; held_out is told with it."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(uri_of(model["folder"]))
        there = {x.base_name for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))}
        flags: list[bool] = []

        def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                flags.extend(batch.column(2).to_pylist())
                yield batch

        with np.errstate(over="ignore"):
            for ids, held in batches_of(kept(batches), SCORED_BYTES):
                n, known, base, scored = score_batch(model, held, there)
                own, flags[: len(ids)] = flags[: len(ids)], []
                arrays = [pa.array(ids, pa.int64()), pa.array(own, pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), model["n"], np.int64)), pa.array(base), pa.array(scored), pa.array(10 ** (-scored / n))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, schema)


def op6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 7 == 2
    return score(docs, train(docs.where(~held_out)), held_out)
