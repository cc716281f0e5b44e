"""Mixing sources to target weights, with DataFrame functions alone.

A source's documents stand in a fixed random order (by a hash of seed and id), as one stream of words. What the mix takes of a
source, rounded down to whole words, is that many words of the stream: whole passes over it, then the beginning of one more
pass. So the sum is exact, no document is taken more often than the next full pass, and one document a source at most is cut.
With whole, none is: of up to CHOICE documents around the end of the partial pass, those are taken whose sizes bring the source nearest to its target.

The taken stream is divided into blocks of block_words words (a document belongs to the block in which it starts), and blocks are
dealt to output shards by a splitting tree: a node knows how many blocks of each source it holds; its left child gets its share
of the blocks, whose sources follow a multivariate hypergeometric draw (source by source, each given those before), its right
child the rest. A leaf's counts are the exact quota of a shard. The blocks of a source are permuted (by a keyed permutation of their
numbers, computed for each one by itself), and each shard draws the next so many: the draws are disjoint and use up each quota. Within a
shard, rows are put in the order of another hash: resampled() deals them by shard and the leading bits of that order, and sorts.

A running sum over a source never meets in one task: each source is dealt to buckets by the hash that orders it, sums are made by
bucket, and a running sum within a bucket starts at the sum of the buckets before. Tables of one row a source (or a source
and bucket) are the only ones that are gathered, and with them the number of sources is limited to some ten thousands. The number of
buckets grows with the number of rows.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are taken 0 times, as
are all documents where all sizes are 0; rows with the same id count as documents of their own; an empty table gives an empty
result. The input's columns are kept as one struct, so that no name of theirs can clash with one that is made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

SEED = 20
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all sizes
MOST = 2  # times its size that a source is taken
BLOCK_WORDS = 4096
SHARDS = 16
#: Buckets of a source: so many at least, and one for so many rows of the input.
BUCKETS = 1024
BUCKET_ROWS = 50_000
#: Documents of a source among which the end of a pass is chosen where all are taken whole: all of their 2 ** CHOICE subsets are tried.
CHOICE = 12
#: The share of its target by which a source may be moved so that the sum of all is near.
CLOSE = 0.02
#: Rounds of the permutation, and how often it is applied to come back into its range (outside of it are fewer numbers than the root of the range).
ROUNDS, WALKS = 6, 64
#: Parts of a shard, by the leading bits of its rows' order.
PARTS = 4096


def words(text: Column) -> Column:
    """The number of words of a text, 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size), a row each. Adds target: share of all sizes by weight; what is above most times a size is shared again among the rest.

    With l words a unit of weight for all sources that aren't full, a source is full if most * size < l * weight. In the order of
    size / weight, the full ones come first, so l is found where the next one isn't full any more.
    """
    by_name, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_level = Window.orderBy("_level", "_rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    level = (
        sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", weight.cast("double"))
        .withColumn("_level", most * F.col("source_size") / F.col("_weight"))
    )
    full = F.coalesce(F.sum(most * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    tried = level.withColumn("_unit", (share * F.sum("source_size").over(all_) - full) / rest)
    unit = F.min(F.when(F.col("_unit") <= F.col("_level"), F.struct("_level", "_rank", "_unit"))).over(all_)["_unit"]
    return tried.withColumn("_found", unit).select(
        "source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("_found") * F.col("_weight"), (most * F.col("source_size")).cast("double"))).alias("target")
    )


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many marked ones are among drawn of total, for u uniform on [0, 1): weights by their ratios over 8 deviations to each side, then the first whose sum passes u."""
    first = f"cast(greatest(0, {drawn} + {marked} - {total}, floor({drawn} * ({marked} / {total}) - 8 * d) - 1) AS bigint)"
    last = f"cast(least({drawn}, {marked}, ceil({drawn} * ({marked} / {total}) + 8 * d) + 1) AS bigint)"
    deviation = f"sqrt({drawn} * ({marked} / {total}) * (1 - {marked} / {total}) * ({total} - {drawn}) / greatest(1, {total} - 1))"
    ratio = f"(({marked} - k0 - s1 + 1D) * ({drawn} - k0 - s1 + 1D) / ((k0 + s1) * ({total} - {marked} - {drawn} + k0 + s1 + 0D)))"
    steps = "if(k1 > k0, sequence(1L, k1 - k0), cast(array() AS array<bigint>))"
    sums = f"aggregate({steps}, named_struct('w', 1D, 's', 1D), (b, s1) -> named_struct('w', b.w * {ratio}, 's', b.s + b.w * {ratio})).s"
    found = f"aggregate({steps}, named_struct('w', 1D, 's', 1D, 'k', k0), (b, s1) -> named_struct('w', b.w * {ratio}, 's', b.s + b.w * {ratio}, 'k', if(b.s > {u} * z, b.k, k0 + s1))).k"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    return f"if({total} <= 0 OR {marked} <= 0 OR {drawn} <= 0, 0L, {let('d', deviation, let('k0', first, let('k1', last, let('z', sums, found))))})"


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: (source, blocks). Returns (source, ends): ends[j] is how many blocks of the source the shards up to j hold.

    A node of the tree is a row with the sources' block counts; there are as many rows as shards in the end.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(F.xxhash64("source"), F.lit(0)).alias("h"), "source", "blocks")))
    nodes = quotas.agg(listed.alias("all")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), F.col("all.source").alias("source"), F.col("all.blocks").alias("q"))
    draw = hypergeometric("a.t", "q[i]", "a.m", f"((xxhash64({seed}, first, n, i) & 9007199254740991L) / 9007199254740992D)")
    split = (
        "aggregate(sequence(0, size(q) - 1), named_struct('t', aggregate(q, 0L, (s, x) -> s + x), 'm', aggregate(q, 0L, (s, x) -> s + x) * (n div 2) div n, 'x', cast(array() AS array<bigint>)),"
        f" (a, i) -> transform(array({draw}), x -> named_struct('t', a.t - q[i], 'm', a.m - x, 'x', concat(a.x, array(x))))[0]).x"
    )
    for _ in range((shards - 1).bit_length()):
        nodes = (
            nodes.withColumn("left", F.when((F.col("n") > 1) & (F.size("q") > 0), F.expr(split)).otherwise(F.col("q")))
            .withColumn(
                "child",
                F.explode(
                    F.expr(
                        "if(n = 1, array(named_struct('first', first, 'n', n, 'q', q)), array(named_struct('first', first, 'n', n div 2, 'q', left),"
                        " named_struct('first', first + n div 2, 'n', n - n div 2, 'q', zip_with(q, left, (x, y) -> x - y))))"
                    )
                ),
            )
            .select("child.first", "child.n", "source", "child.q")
        )
    by_source = nodes.select("first", F.explode(F.arrays_zip(F.col("source"), F.col("q"))).alias("z")).select("first", "z.source", "z.q")
    counts = by_source.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "q")))["q"].alias("q"))
    return counts.select("source", F.expr("transform(sequence(1, size(q)), j -> aggregate(slice(q, 1, j), 0L, (s, x) -> s + x))").alias("ends"))


def choices(keyed: DataFrame, starts: DataFrame, own: WindowSpec) -> DataFrame:
    """(_c, _near, _took) of each source whose partial pass ends within a document: the starts of up to CHOICE documents around that end, and of those among them that are taken.

    The nearest ones are found by bucket first, so that no task sees a whole source.
    """
    placed = keyed.where("_size > 0").withColumn("_start", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    ends = starts.where("_rest > 0").select("_s", "_b", "_before", "_rest", "target")
    placed = placed.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_start", F.col("_start") + F.col("_before"))
    cut = (F.col("_start") < F.col("_rest")) & (F.col("_start") + F.col("_size") > F.col("_rest"))
    placed = placed.withColumn("_far", F.when(cut, -1).otherwise(F.abs(F.col("_start") - F.col("_rest")))).select("source", "_bucket", "_rest", "target", "_start", "_size", "_far")
    for keys in (["source", "_bucket"], ["source"]):
        placed = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_far", "_start"))).where(F.col("_rank") <= CHOICE)
    near = placed.groupBy("source", "_rest", "target").agg(F.array_sort(F.collect_list(F.struct("_start", "_size"))).alias("n"), F.min(F.when(F.col("_far") == -1, F.col("_start"))).alias("fit")).where("fit IS NOT NULL")
    # fit words are in documents before the cut one; those of them that aren't near are taken in any case.
    left = "_rest - (fit - aggregate(n, 0L, (s, d) -> s + if(d._start < fit, d._size, 0L)))"
    near = near.withColumn("_left", F.expr(left)).withColumn("sums", F.expr("aggregate(n, array(0L), (s, d) -> concat(s, transform(s, x -> x + d._size)))"))
    options = "transform(sums, (x, i) -> named_struct('off', abs(x - _left), 'i', i, 'x', x))"
    near = near.withColumn("under", F.expr(f"array_min(filter({options}, o -> o.x <= _left))")).withColumn("over", F.expr(f"array_min(filter({options}, o -> o.x >= _left))")).drop("sums")
    # The nearest one; where that leaves the sum of all sources off, those go to the other side for which this changes least.
    over, gap, all_ = F.col("over.off") < F.col("under.off"), F.col("under.off") + F.col("over.off"), Window.partitionBy()
    off = F.sum(F.when(F.col("is_over"), F.col("over.off")).otherwise(-F.col("under.off"))).over(all_)
    near = near.withColumn("is_over", over).withColumn("off", off).withColumn("gap", gap)
    near = near.withColumn("may", (F.col("gap") <= CLOSE * F.col("target")) & F.when(F.col("is_over"), F.col("off") > 0).otherwise(F.col("off") < 0))
    by_gap = Window.partitionBy("may").orderBy("gap", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    other = F.col("may") & (F.sum("gap").over(by_gap) - F.col("gap") / 2 <= F.abs("off"))
    best = near.withColumn("best", F.when(F.col("is_over") != other, F.col("over.i")).otherwise(F.col("under.i")))
    return best.select(F.col("source").alias("_c"), F.expr("n._start").alias("_near"), F.expr("transform(filter(n, (d, k) -> shiftright(best, k) % 2 = 1), d -> d._start)").alias("_took"))


def permuted(j: str, n: str, key: str) -> str:
    """SQL: the place of j among the numbers below n under a permutation by key.

    j is written as two digits, of which each in turn is moved by a hash of the other; what falls beyond n is moved again.
    """
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    one = "named_struct('l', s.x div b, 'r', s.x % b)"
    for k in range(ROUNDS):
        moved = f"named_struct('l', pmod(t.l + pmod(xxhash64({key}, {k}, t.r), a), a), 'r', t.r)" if k % 2 == 0 else f"named_struct('l', t.l, 'r', pmod(t.r + pmod(xxhash64({key}, {k}, t.l), b), b))"
        one = let("t", one, moved)
    walk = let("u", one, "named_struct('x', u.l * b + u.r, 'w', s.w + 1)")
    walks = f"aggregate(sequence(1, {WALKS}), named_struct('x', {j}, 'w', 0), (s, i) -> if(s.w > 0 AND s.x < {n}, s, {walk})).x"
    return f"if({n} <= 1, 0L, {let('a', f'cast(ceil(sqrt(cast({n} AS double))) AS bigint)', let('b', f'cast(ceil({n} / cast(a AS double)) AS bigint)', walks))})"


def mix(docs: DataFrame, size: Column, *, share: float = SHARE, most: int = MOST, shards: int = SHARDS, block_words: int = BLOCK_WORDS, buckets: int | None = None, seed: int = SEED, whole: bool = False) -> DataFrame:
    """(row, size, source_size, target, draws) of each row of docs; row: a struct of its columns; draws: an array of (pass, words, shard, place) for each time that the mix takes words of it; words below size: the first so many (never with whole)."""
    tie = F.md5(F.col("text").cast("binary")) if "text" in docs.columns else F.lit("")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source"), size.alias("_size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("_hash"), F.coalesce(tie, F.lit("")).alias("_tie"))
    narrow = materialize(keyed.drop("row"), "mix") if "text" in docs.columns else keyed.drop("row")  # without texts, docs is narrow itself
    buckets = buckets or max(BUCKETS, 1 << (narrow.count() // BUCKET_ROWS).bit_length())
    bucket = F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(buckets)).cast("int")
    keyed, narrow = keyed.withColumn("_bucket", bucket), narrow.withColumn("_bucket", bucket)
    sums = materialize(narrow.groupBy("source", "_bucket").agg(F.sum("_size").alias("_sum")), "mix")
    aimed = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), share=share, most=most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    blocks = lambda n: F.ceil(n / F.lit(block_words)).cast("long")
    aimed = aimed.withColumn("_passes", passes).withColumn("_rest", F.floor("target") - F.col("_passes") * F.col("source_size"))
    aimed = aimed.withColumn("_per_pass", blocks(F.col("source_size"))).withColumn("blocks", F.col("_passes") * F.col("_per_pass") + blocks(F.col("_rest")))
    aimed = materialize(aimed, "mix")
    quotas = shard_quotas(aimed.select("source", "blocks"), shards, seed)
    both = aimed.alias("a").join(quotas.alias("q"), F.col("a.source").eqNullSafe(F.col("q.source"))).select("a.*", "q.ends")
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).alias("s").join(both.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")))
    starts = starts.select("s.source", F.col("s._bucket").alias("_b"), "_before", "source_size", "target", "_passes", "_rest", "_per_pass", "blocks", "ends")
    starts = materialize(starts.withColumnRenamed("source", "_s"), "mix")
    own = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "_tie", "_size").rowsBetween(Window.unboundedPreceding, -1)
    chosen = materialize(choices(narrow, starts, own), "mix") if whole else None
    if chosen is None:
        starts = starts.withColumn("_near", F.expr("cast(NULL AS array<bigint>)")).withColumn("_took", F.col("_near"))
    else:
        starts = starts.join(chosen, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c")
    placed = keyed.withColumn("_start", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_start", F.col("_start") + F.col("_before"))
    part = "CASE WHEN _near IS NULL THEN greatest(0L, least(_size, _rest - _start)) WHEN if(array_contains(_near, _start), array_contains(_took, _start), _start < _rest) THEN _size ELSE 0L END"
    words_of = f"filter(transform(sequence(0L, _passes), p -> named_struct('p', p, 'words', if(p < _passes, _size, {part}))), d -> d.words > 0)"
    block = f"d.p * _per_pass + if(d.p < _passes, _start, least(_start, greatest(0L, _rest - 1))) div {block_words}"
    draws = f"transform(_takes, d -> transform(array({permuted(f'({block})', 'blocks', '_key')}), r -> named_struct('pass', d.p, 'words', d.words, 'shard', size(filter(ends, e -> e <= r)), 'place', xxhash64(_hash, _tie, d.p)))[0])"
    out = placed.withColumn("_key", F.coalesce(F.xxhash64("source", F.lit(seed)), F.lit(0))).withColumn("_takes", F.expr(words_of)).withColumn("draws", F.expr(draws))
    return out.select("row", F.col("_size").alias("size"), "source_size", "target", "draws")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    narrow = materialize(narrow, "sizes")
    taken = F.expr("aggregate(draws, 0L, (s, d) -> s + d.words)")
    return mix(narrow, F.col("size")).select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), F.concat_ws(",", F.expr("transform(draws, d -> cast(d.shard AS string))")).alias("shards"))


def resampled(docs: DataFrame, *, parts: int = PARTS, **options) -> DataFrame:
    """docs as the mix takes them, a row for each draw. With whole=True, rows are as they were; without, where a draw takes a part, text is its first so many words, a space between two, and n_chars (if there) is counted anew.

    Rows are shuffled locally: those of a shard and a part of it lie in one partition, in the order of shard and place. So a shard's rows are its
    parts, one after another; there are many more parts than partitions, whose number is the session's (spark.sql.shuffle.partitions).
    """
    drawn = mix(docs, words(F.col("text")), **options).withColumn("draw", F.explode("draws"))
    cut = F.col("draw.words") < F.col("size")
    text = F.col("row.text")
    own = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(own, F.lit(1), F.col("draw.words").cast("int")), " ")
    fresh = {"text": F.when(cut, part).otherwise(text)} if not options.get("whole") else {}
    if fresh and "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(cut, F.char_length(part).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    row = F.struct(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns]).alias("row")
    dealt = drawn.select(row, F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"))
    dealt = dealt.repartition(F.col("shard"), F.shiftrightunsigned("place", 64 - (parts - 1).bit_length())).sortWithinPartitions("shard", F.col("place").bitwiseXOR(F.lit(-(2**63))))
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns])
