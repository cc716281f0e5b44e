"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions alone.

A text's shingles are its runs of five words (one shingle of all its words if it has fewer); its sketch is the k smallest distinct
hashes of them, in order. The sketch of two parts together is the k smallest of both sketches' hashes, so sketches merge. From
two sketches, the k smallest of their union are a uniform sample of the union of shingles: the share that both hold estimates
resemblance. A sketch of fewer than k hashes holds all shingles, and the estimates are then exact.

Defined results: a null text counts as empty; an empty text (or one of white space alone) has the empty sketch; two empty sketches
have resemblance 1, an empty one and another 0; equal texts have equal sketches. A text of any length is sketched whole.
An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialize, spread, table, texts

K = 128
SHINGLE = 5
#: Neighbours in the order of ids meet in groups of so many ids; of more where ids are sparse, up to so many rows.
IDS_A_GROUP = 1024
ROWS_A_GROUP = 1024


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of a text's shingles, in order, with repeats."""
    hashed = F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + j] for j in range(n)]))
        return F.when(F.size(h) >= n, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(hashed, runs)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingles(text, n))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, key: str, sketches: str, k: int = K, parts: int = 64) -> DataFrame:
    """(key, sketch) of the rows of each key together. A hot key's hashes are dealt to parts by their value, and cut to k by each part before they meet."""
    hashes = df.select(F.col(key).alias("key"), F.explode(sketches).alias("h")).distinct()
    for own in (["key", F.pmod(F.col("h"), F.lit(parts))], ["key"]):
        hashes = hashes.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("h"))).where(F.col("r") <= k).drop("r")
    return hashes.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of both sketches' shingles that both hold."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (s[k - 1].cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    j = resemblance(a, b, k)
    both = j * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def spelled(s: Column) -> Column:
    """The hashes in hex, 16 digits each."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def ids_a_group(rows: DataFrame, least: int = IDS_A_GROUP, rows_a_group: int = ROWS_A_GROUP) -> int:
    """How many neighbouring ids form a group: more where ids are sparse, so that a group has rows enough and few of its rows are sent twice; never so many that groups grow large."""
    ids = rows.where("doc_id IS NOT NULL").select("doc_id")
    width = least
    while True:
        groups = ids.groupBy(F.floor(F.col("doc_id") / width)).count()
        n, most, total = groups.agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
        if n < 2 or most >= rows_a_group or total >= n * rows_a_group // 16 or width >= 1 << 56:
            return width
        width *= 16


def with_next(rows: DataFrame, columns: list[str], group: int | None = None) -> DataFrame:
    """rows (with doc_id) with next_<column>: of the row that comes next by descending doc_id; after the last one, the first.

    Rows of neighbouring ids meet in one task. The row that follows a group's last one is the first of the next group: it is sent to
    both. A null id counts as the lowest; rows of one id stand in the descending order of a hash of the first of columns, then by columns; rows
    without id are dealt to groups by that hash.
    """
    group = group or ids_a_group(rows)
    tie = F.xxhash64(columns[0])
    own = F.coalesce(F.floor(F.col("doc_id") / group).cast("long"), F.lit(-(2**62)) + F.shiftright(tie, 54))
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), tie.alias("tie"))
    tops = rows.select(own.alias("group"), key.alias("top")).groupBy("group").agg(F.max("top").alias("top"))
    # The top of a group is also the end of the group above; that of the highest group ends the lowest.
    wide = F.floor(F.col("group") / IDS_A_GROUP)
    levels = tops.withColumn("wide", wide)
    inside = levels.withColumn("above", F.lead("group").over(Window.partitionBy("wide").orderBy("group")))
    ends = levels.groupBy("wide").agg(F.min("group").alias("low"))
    ends = ends.withColumn("next_low", F.coalesce(F.lead("low").over(Window.orderBy("wide")), F.min("low").over(Window.partitionBy())))
    above = inside.join(ends, "wide").select(F.col("top").alias("_top"), F.coalesce("above", "next_low").alias("_above"))
    above = materialize(above, "order")
    dealt = rows.withColumn("_key", key).withColumn("_group", own).join(above, F.col("_key") == F.col("_top"), "left")
    one = lambda g, copy: F.struct(g.alias("g"), F.lit(copy).alias("copy"))
    both = F.array(one(F.col("_group"), 0), one(F.col("_above"), 1))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("_above").isNull(), F.slice(both, 1, 1)).otherwise(both)))
    dealt = dealt.withColumn("_g", F.col("_to.g")).withColumn("_copy", F.col("_to.copy"))
    order = Window.partitionBy("_g").orderBy("_copy", F.col("_key").desc(), *columns)
    dealt = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(order))  # one window, so one shuffle
    return dealt.where(F.col("_copy") == 0).select(*rows.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprint_documents(docs: DataFrame, *, k: int = K) -> DataFrame:
    """Sketches of each text and of its edited text, whose last third comes from the next document."""
    base = texts(docs).withColumn("sketch", sketch(F.col("text"), k))
    both = with_next(base, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    both = both.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("sketch")).alias("fingerprint"),
        spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_within"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
