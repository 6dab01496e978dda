"""Document fingerprints: bottom-k sketches of word-shingle hashes, DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles (fewer words: the whole sequence; none: an empty sketch). Sketches of parts merge into the
sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.

Defined results: a null text is empty; two empty sketches resemble fully, an empty and a filled one
not at all; a null id sorts last; rows of equal id are ordered by their text; an empty table gives
an empty table; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import let, words

K = 128
SHINGLE = 5
#: Hashes are signed 64-bit; this is the width of their range.
RANGE = float(2**64)
#: Rows of a range of ids, and ranges at most.
RANGE_ROWS, MAX_RANGES = 1000, 16384


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text column."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(w[i + j] for j in range(SHINGLE)))))
            .when(n > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.expr("cast(array() as array<bigint>)"))
        )

    return bottom(let(words(text), hashes), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts together, from the sketches of each."""
    return bottom(F.array_union(a, b), k)


def merge_all(df: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of each group: the k smallest distinct hashes, by counting ranks and not by gathering groups.

    A hot group's hashes are first cut to k in salted parts, so no task holds more than one part's rows.
    """
    salted = df.select(*by, F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_part"), F.explode(sketch_col).alias("_h")).distinct()
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h"))).filter(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the two shingle sets, 0 to 1."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    full = (k - 1) / ((F.element_at(s, -1).cast("double") + RANGE / 2) / RANGE)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    union = distinct_count(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def packed(s: Column) -> Column:
    """A sketch as a string: base64 of the hashes, 16 hexadecimal digits each, in order."""
    hexed = F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(hexed)), "[\r\n]", "")


def _range_of(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are larger than x, by halving."""
    bounds = F.lit(cuts) if cuts else F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        above = F.get(bounds, mid) > x
        done = a["lo"] >= a["hi"]
        return F.struct(F.when(done | above, a["lo"]).otherwise(mid + 1).alias("lo"), F.when(~done & above, mid).otherwise(a["hi"]).alias("hi"))

    steps = F.lit(list(range(len(cuts).bit_length()))) if cuts else F.expr("cast(array() as array<int>)")
    return F.aggregate(steps, start, halve, lambda a: len(cuts) - a["lo"])


def next_by_id(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """(doc_id, text, edge, _part): rows in ranges of ids, each range with the first row of the next one.

    Ids fall into ranges of about ``RANGE_ROWS`` rows at quantiles, ``MAX_RANGES`` at most, and null ids into as many by the texts' hashes. The order runs from the largest id down and from the
    smallest back to the largest. A row that opens a range is written twice, the second time as
    ``edge`` behind the range before it; so each row finds its follower inside its own range, with one
    shuffle and no global window.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = base.select("doc_id").filter(F.col("doc_id").isNotNull())
    n, nulls = base.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = min(MAX_RANGES, max(4, n // RANGE_ROWS))
    cuts = sorted(set(int(x) for x in (ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) or [])))
    # Range number from the top: 0 holds the largest ids; null ids come last, in ranges of the hash that orders them.
    bits = min(MAX_RANGES, nulls // RANGE_ROWS).bit_length()
    among = F.shiftright(F.xxhash64("text"), 64 - bits) + (1 << (bits - 1)) if bits else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), (F.lit(len(cuts) + 1) + among).cast("int")).otherwise(_range_of(F.col("doc_id"), cuts).cast("int"))
    base = base.withColumn("_part", part)
    order = F.struct((-F.coalesce(F.col("doc_id"), F.lit(-(2**63) + 1))).alias("o"), F.xxhash64("text").alias("t"))
    heads = sorted((r["_part"], r["o"]["o"], r["o"]["t"]) for r in base.groupBy("_part").agg(F.min(order).alias("o")).collect())
    after = {heads[(i + 1) % len(heads)]: heads[i][0] for i in range(len(heads))}  # opening row -> the range before it
    to = spark.createDataFrame([(p, o, t, q) for (p, o, t), q in after.items()], "_p int, _o long, _t long, _to int")
    opening = (
        base.withColumn("_k", order)
        .join(F.broadcast(to), (F.col("_part") == F.col("_p")) & (F.col("_k.o") == F.col("_o")) & (F.col("_k.t") == F.col("_t")))
        .select("doc_id", "text", F.col("_to").alias("_part"), F.lit(True).alias("edge"))
        .dropDuplicates(["_part"])
    )
    rows = base.select("doc_id", "text", "_part", F.lit(False).alias("edge")).unionByName(opening)
    window = Window.partitionBy("_part").orderBy("edge", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return rows, window


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketch of each text, of its edited text, and their likenesses.

    The edited text has the last third (floor) of the code points replaced by as many first ones of
    the next document in descending id (after the last: the first), or by all of a shorter one.
    """
    rows, w = next_by_id(docs, id_col, text_col)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    follows = F.coalesce(F.lead("text").over(w), F.lit(""))
    edited = (
        rows.withColumn("_next", follows)
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("_next"), F.lit(1), third)))
        .select("doc_id", "_part", "edge", F.xxhash64("text").alias("_t"), n.cast("long").alias("n_chars"), "edited", sketch(F.col("text"), k).alias("sketch"))
    )
    w2 = Window.partitionBy("_part").orderBy("edge", F.desc_nulls_last("doc_id"), "_t")
    return (
        edited.withColumn("edited_sketch", sketch(F.col("edited"), k))
        .withColumn("next_sketch", F.lead("sketch").over(w2))
        .filter(~F.col("edge"))
        .select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
    )
