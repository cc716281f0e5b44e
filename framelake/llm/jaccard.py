"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Each text is the set of its runs of five words (all its words together if it has fewer). Its signature has bands * rows minima; two
texts are candidates if all minima of a band agree. Bands and rows are chosen so that a pair at the threshold is found with
the target recall. Texts with equal sets form a class, which is compared once.

Candidates meet by a shuffle on band hashes, and their full sets are compared there. To move few sets, buckets that hold the
same members as another band's are dropped; a pair that shares several of the rest is compared in the first one alone; and only
texts that share a bucket are cut to n-grams again. A large bucket (by its members, or by their n-grams) is dealt to blocks: each
pair of blocks is a task of its own, of bounded size. So no pair is dropped, none is compared twice, and no pair is ever a row: a
task returns each member's number of links and the forest of its links.

Linked classes form a group, found by repeatedly passing on the smallest class_id.

Defined results: a null text counts as empty; texts without words (all of them) have the empty set and form one class; every row
gets a result; rows that share an id, or have none, are told apart by their sets: only texts decide classes, links and groups; a null
id is the lowest. Of several classes with the same least id, the first by set_id is called by it and each other one by a
number that is no row's id. Sets of any size are compared whole. An empty table gives an empty result. Other columns
are never read by the join; deduplicate() keeps them as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import CHUNK_BYTES, batches_of, discard, materialize, release, slices_of, spread, table, texts

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
#: Members of a bucket that a task compares with one another, n-grams of theirs, and distinct n-grams that it holds as columns of a matrix at once.
BLOCK = 512
BLOCK_GRAMS = 1_000_000
COLUMNS = 4096
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Stands for a null id: the lowest.
NO_ID = -(2**63)
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the target recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input changes half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_hashes = WordHashes()


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of words."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    known = _hashes
    h = np.fromiter([known[w] for w in words], np.uint64, len(words))
    m = max(1, len(h) - n + 1)
    x = np.full(m, len(h) if len(h) < n else n, np.uint64)
    for j in range(min(n, len(h))):
        x = mixed(x * MIX + h[j : j + m])
    return np.unique(x)


def minima(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed, the least of the set's hashes under the seed's multiplicative permutation."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 8192):
        part = s[None, at : at + 8192] * seeds[:, None]
        part ^= part >> np.uint64(32)
        least = np.minimum(least, (part * MIX).min(axis=1))
    return least


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, text_md5, set_id, n_grams, bands array<long>) of each row; set_id: 128 bits of the set, in hex; bands: empty for the empty set."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for ids, held in batches_of(batches):
                sets, sizes, signed = [], [], []
                for text in held:
                    s = shingle_set(text, n)
                    sizes.append(len(s))
                    sets.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    if len(s):
                        least = minima(s, seeds).reshape(bands, rows)
                        x = salt.copy()
                        for j in range(rows):
                            x = mixed(x * MIX + least[:, j])
                        signed.append(x.view(np.int64))
                    else:
                        signed.append(np.empty(0, np.int64))
                digests = [hashlib.md5(text).hexdigest() for text in held]
                arrays = [pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(sets, pa.string()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_md5", "set_id", "n_grams", "bands"])
            _hashes.clear()
            release()

    return texts(docs).mapInArrow(run, "doc_id long, text_md5 string, set_id string, n_grams long, bands array<long>")


def with_grams(rows: DataFrame, n: int) -> DataFrame:
    """rows (set_id, text, ...) with grams in the place of text: the text's distinct n-gram hashes, ascending. Rows whose text hasn't the set set_id go."""
    other = [f.name for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices_of(batch, "text", CHUNK_BYTES):
                    sets = [shingle_set(t, n) for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                    own = [xxhash.xxh3_128_hexdigest(s.tobytes()) == name for s, name in zip(sets, part.column("set_id").to_pylist())]
                    out = part.select(other).append_column("grams", pa.array([s.tobytes() for s in sets], pa.binary()))
                    yield out.filter(pa.array(own, pa.bool_()))
            _hashes.clear()
            release()

    return rows.select(*other, "text").mapInArrow(run, schema)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right, by products of 0/1 matrices over the values that both sides hold."""
    of_left, of_right = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))
    values = np.intersect1d(np.unique(of_left), np.unique(of_right), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    if not len(values):
        return out
    sides = []
    for sets, flat in ((left, of_left), (right, of_right)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        kept = values[at] == flat
        order = np.argsort(at[kept], kind="stable")
        sides.append((row[kept][order], at[kept][order]))
    for begin in range(0, len(values), COLUMNS):
        parts = []
        for (row, at), n in zip(sides, (len(left), len(right))):
            a, b = np.searchsorted(at, [begin, begin + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(values) - begin)), np.float32)
            m[row[a:b], at[a:b] - begin] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, given links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(ids: np.ndarray, keys: np.ndarray, grams: list[bytes], weights: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each member of a task: links to members of other sets, counting copies; root: a member it's linked with, by the tasks's links.

    keys: each member's kept buckets by band, 0 where none; the first column is the task's own bucket's band. side: 0 and 1 where blocks differ, all 2 within one.
    """
    sets = [np.frombuffer(g, np.uint64) for g in grams]
    sizes = np.array([len(s) for s in sets], float)
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    links = np.zeros(len(ids), np.int64)
    found_a, found_b = [], []
    for i in range(0, len(left), BLOCK):
        for j in range(0, len(right), BLOCK):
            a, b = left[i : i + BLOCK], right[j : j + BLOCK]
            if side[a[0]] == 2 and b[-1] < a[0]:
                continue
            both = shared_counts([sets[x] for x in a], [sets[x] for x in b])
            p, q = np.nonzero(both >= threshold * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-9)
            p, q = a[p], b[q]
            if side[a[0]] == 2:
                p, q = p[p < q], q[p < q]
            earlier = ((keys[p, 1:] == keys[q, 1:]) & (keys[p, 1:] != 0)).any(axis=1) if len(p) else np.zeros(0, bool)
            p, q = p[~earlier], q[~earlier]
            np.add.at(links, p, weights[q])
            np.add.at(links, q, weights[p])
            found_a.append(p)
            found_b.append(q)
    if not found_a:
        return links, np.arange(len(ids))
    return links, roots(len(ids), np.concatenate(found_a), np.concatenate(found_b))


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """members: (task, side, band, class_id, n_copies, kept, grams), all rows of a task in one partition, in order. Returns (class_id, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[list] = [[], [], []]

        def settle() -> None:
            if len(held) > 1:
                _, side, band, ids, weights, kept, grams = zip(*held)
                keys = np.array([[k[band[0]], *k[: band[0]]] for k in kept], np.int64)
                order = np.argsort(np.array(side), kind="stable")
                pick = lambda x: np.array(x, np.int64)[order]
                links, root = compare(pick(ids), keys[order], [grams[x] for x in order], pick(weights), pick(side), threshold)
                some = np.flatnonzero(links)
                out[0].extend(pick(ids)[some].tolist())
                out[1].extend(links[some].tolist())
                out[2].extend(pick(ids)[root[some]].tolist())
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["class_id", "links", "root"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    settle()
                if not held or held[-1][1] != row[1] or held[-1][3] != row[3]:  # rows of one class come one after another
                    held.append(row)
            if out[0]:
                yield flush()
        settle()
        yield flush()
        release()

    return members.select("task", "side", "band", "class_id", "n_copies", "kept", "grams").mapInArrow(run, "class_id long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): root is the smallest node that a path of edges reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest one; the number of rounds grows with the logarithm of a path's length.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, now = now, materialize(small.where("u <> v").distinct(), "links")
        state = now.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        discard(last)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def id_or_lowest(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def with_class_ids(classes: DataFrame) -> DataFrame:
    """classes: (set_id, rep, high, ...), a row each. Adds class_id: rep for the first class by set_id of those with this rep, for each other one a number of its own that no row has as id.

    The others are counted in the order of set_id: by its first three digits, so that no task sees all of them.
    """
    others = classes.groupBy("rep").agg(F.count("*").alias("n"), F.min("set_id").alias("first")).where("n > 1")
    others = classes.select("set_id", "rep").join(others, "rep").where("set_id <> first").select("set_id", F.substring("set_id", 1, 3).alias("digits"))
    others = materialize(others, "others")
    before = F.coalesce(F.sum("n").over(Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = others.groupBy("digits").agg(F.count("*").alias("n")).select("digits", before.alias("before"))
    lowest, highest = classes.agg(F.min(F.when(F.col("rep") > NO_ID, F.col("rep"))), F.max("high")).first()
    n = others.count()
    base = NO_ID if lowest is None or NO_ID + n < lowest else highest
    if base + n >= 2**63:
        raise ValueError("the ids leave no numbers at either end for classes with the same least id")
    numbered = others.join(starts, "digits").select("set_id", (F.lit(base) + F.col("before") + F.row_number().over(Window.partitionBy("digits").orderBy("set_id"))).alias("own"))
    return classes.join(numbered, "set_id", "left").withColumn("class_id", F.coalesce("own", "rep")).drop("own", "high")


def grouped(docs: DataFrame, threshold: float, recall: float, rows: int, n: int) -> DataFrame:
    """(doc_id, text_md5, set_id, class_id, group_id, n_copies, n_links) of each row of docs."""
    bands = bands_for(threshold, recall, rows)
    signed = materialize(signatures(docs, bands, rows, n), "signatures")
    id_ = id_or_lowest("doc_id")
    first = F.min(F.struct(id_.alias("rep"), "text_md5"))
    classes = signed.groupBy("set_id").agg(first.alias("first"), F.max(id_).alias("high"), F.count("*").alias("n_copies"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = classes.select("set_id", "first.*", "high", "n_copies", "n_grams", "bands")
    classes = materialize(with_class_ids(materialize(classes, "classes")), "classes")
    banded = classes.select("set_id", "class_id", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    # Buckets with the same members as another keep one of them.
    members = F.expr("bit_xor(xxhash64(set_id))")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_grams").alias("all_grams"), F.min("class_id").alias("low"), members.alias("who"), F.min("band").alias("band")).where("n > 1")
    kept = buckets.groupBy("n", "all_grams", "low", "who").agg(F.min(F.struct("band", "bucket")).alias("b")).select("n", "all_grams", "b.bucket")
    kept = materialize(kept, "buckets")
    of_class = banded.join(kept, "bucket").groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("by_band"), F.collect_list(F.struct("band", "bucket", "n", "all_grams")).alias("in"))
    of_class = of_class.select("set_id", F.expr(f"transform(sequence(0, {bands - 1}), i -> coalesce(element_at(by_band, i), 0L))").alias("kept"), "in")
    of_class = of_class.join(classes.select("set_id", "rep", "text_md5", "class_id", "n_copies"), "set_id")
    own_text = texts(docs).select(id_or_lowest("doc_id").alias("d"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    wanted = of_class.join(own_text, (F.col("rep") == F.col("d")) & (F.col("text_md5") == F.col("digest"))).select("set_id", "class_id", "n_copies", "kept", "in", "text")
    placed = with_grams(wanted, n).withColumn("i", F.explode("in")).select("set_id", "class_id", "n_copies", "kept", "grams", "i.*")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * BLOCK)), F.ceil(F.col("all_grams") / (2 * BLOCK_GRAMS))).cast("int")
    placed = placed.withColumn("blocks", F.least(blocks, F.col("n").cast("int"))).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    tasks = placed.withColumn("task", task).withColumn("side", side).select("task", "side", "band", "class_id", "n_copies", "kept", "grams")
    tasks = tasks.repartition(F.col("task")).sortWithinPartitions("task", "side", "class_id")
    found = materialize(verified(tasks, threshold), "found")
    groups = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("n_links"))
    of = classes.select("set_id", "rep", "class_id", "n_copies").join(links, "class_id", "left").join(groups, F.col("class_id") == F.col("node"), "left")
    of = materialize(of.withColumn("root", F.coalesce("root", "class_id")).select("set_id", "rep", "class_id", "root", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "groups")
    named = of.groupBy("root").agg(F.min(F.struct("rep", "set_id", "class_id"))["class_id"].alias("group_id"))
    return signed.select("doc_id", "text_md5", "set_id").join(of.join(named, "root"), "set_id").select("doc_id", "text_md5", "set_id", "class_id", "group_id", "n_copies", "n_links")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, set_id, class_id, group_id, n_copies, n_links) of each row of docs.

    class_id: the least id of documents with an equal set (a number of its own where another class has this id); n_copies: how many rows have the set; n_links: rows of other classes at the
    threshold or above; group_id: the class_id of the class of least id that links reach.
    """
    return grouped(docs, threshold, recall, rows, n).drop("text_md5")


def deduplicate(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """One row of docs of each group: that of the least id (of rows of one id in a group, the one whose text sorts first)."""
    found = grouped(docs, threshold, recall, rows, n).select("group_id", id_or_lowest("doc_id").alias("id"), "text_md5").distinct()
    found = materialize(found, "members")
    least = found.groupBy("group_id").agg(F.min("id").alias("id"))
    kept = found.join(least, ["group_id", "id"])
    order = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")], "doc_id"]
    whole = docs.select(id_or_lowest("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.struct(*order).alias("row"))
    first = whole.join(kept, ["id", "text_md5"]).groupBy("group_id").agg(F.min("row").alias("row"))
    return first.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "class_id", "group_id", "n_copies", "n_links")


#: All pairs of classes with a common n-gram, and the groups by all paths.
OP8_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words),
keyed AS (SELECT doc_id, g, md5(array_to_string(list_sort(g), '|')) || len(g) AS k FROM grams),
classes AS (SELECT k, min(doc_id) AS class_id, count(*) AS n_copies, any_value(g) AS g FROM keyed GROUP BY 1),
flat AS (SELECT class_id, unnest(g) AS gram FROM classes),
shared AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.gram = b.gram AND a.class_id < b.class_id GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN classes x ON x.class_id = a JOIN classes y ON y.class_id = b WHERE n >= 0.8::DOUBLE * (len(x.g) + len(y.g) - n) - 1e-9),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
groups AS (SELECT a, min(b) AS low FROM reach GROUP BY 1),
linked AS (SELECT a, CAST(sum(n_copies) AS BIGINT) AS n_links FROM links JOIN classes ON class_id = b GROUP BY 1)
SELECT doc_id, class_id, least(class_id, coalesce(low, class_id)) AS group_id, n_copies, coalesce(n_links, 0) AS n_links
FROM keyed JOIN classes USING (k) LEFT JOIN groups ON groups.a = class_id LEFT JOIN linked ON linked.a = class_id
"""
