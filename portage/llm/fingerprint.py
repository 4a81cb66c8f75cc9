"""Document fingerprints: bottom-k sketches of shingle hashes, made and compared by DataFrame functions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.common import staged, table, texts

#: Words of a shingle, and hashes of a sketch: a likeness near 0.6 has a standard error of 0.04.
SHINGLE, SKETCH = 5, 128

#: White space between words.
SPACE = " \t\n\x0b\x0c\r"

#: Bytes of text of a range of documents, and the most ranges: their bounds, two longs each, go through the driver.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16

_LEAST, _ALL = float(-(1 << 63)), float(1 << 64)


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` refers to it."""
    return F.transform(F.array(value), then)[0]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The distinct hashes of all runs of ``size`` words, in lower case, sorted; a shorter text is one run, a wordless one none."""
    said = F.trim(F.lower(text), F.lit(SPACE))

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))

    hashes = _bound(F.split(said, f"[{SPACE}]+"), runs)
    return F.when(said == "", F.array().cast("array<long>")).otherwise(F.sort_array(F.array_distinct(hashes)))


def sketch(text: Column, k: int = SKETCH, size: int = SHINGLE) -> Column:
    """The ``k`` smallest shingle hashes of a text, sorted: all of them if there are fewer. Null is an empty text."""
    return F.slice(shingle_hashes(F.coalesce(text, F.lit("")), size), 1, k)


def union_sketch(one: Column, other: Column, k: int = SKETCH) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return F.slice(F.sort_array(F.array_union(one, other)), 1, k)


def distinct_shingles(one: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles behind a sketch; exact below ``k``."""
    last = (F.get(one, F.lit(k - 1)).cast("double") - F.lit(_LEAST)) / F.lit(_ALL)
    return F.when(F.size(one) < k, F.size(one).cast("double")).otherwise(F.lit(float(k - 1)) / last)


def resemblance(one: Column, other: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity of two shingle sets from their sketches: exact where both have fewer than ``k`` hashes.

    Two empty sets are alike (1), an empty and another are not (0).
    """
    shared = lambda both: F.size(F.array_intersect(F.array_intersect(both, one), other)) / F.size(both)
    met = _bound(union_sketch(one, other, k), shared)
    return F.when((F.size(one) == 0) & (F.size(other) == 0), F.lit(1.0)).otherwise(met.cast("double"))


def containment(one: Column, other: Column, k: int = SKETCH) -> Column:
    """Estimated share of the shingles of ``one`` that ``other`` holds; 1 if ``one`` has none."""
    together = resemblance(one, other, k) * distinct_shingles(union_sketch(one, other, k), k)
    return F.when(F.size(one) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), together / distinct_shingles(one, k)))


def encoded(one: Column) -> Column:
    """A sketch as text: base 64 of its hashes, eight bytes each."""
    hexadecimal = F.array_join(F.transform(one, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.translate(F.base64(F.unhex(hexadecimal)), "\r\n", "")


def merged(sketches: DataFrame, by: list[str], column: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch per group of ``by`` (null is a group): that of all its members' shingles together.

    Hashes are made distinct before they are ranked, both with a part per task, so that a group that holds most rows
    sends ``k`` hashes a task at most to the task that ranks it. A group of empty sketches has an empty one.
    """
    hashes = sketches.select(*by, F.explode_outer(column).alias("hash")).distinct()
    ranked = Window.partitionBy(*by).orderBy(F.col("hash").asc_nulls_last())
    least = hashes.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(column))


def _ranges(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The first key of each of about ``ranges`` ranges that hold about equally many keys."""
    dealt = keys.select("kid", "kh").repartitionByRange(ranges, "kid", "kh").withColumn("part", F.spark_partition_id())
    return sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min(F.struct("kid", "kh")).alias("least")).select("least.*").collect())


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of the range that a row's key lies in: a search among the groups of bounds, then within one."""
    width = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    entry = "struct<kid:bigint,kh:bigint>"
    key = F.struct("kid", "kh")

    def literal(rows: list, kind: str) -> Column:
        text = str([[{"kid": a, "kh": b} for a, b in r] if isinstance(r, list) else {"kid": r[0], "kh": r[1]} for r in rows])
        return F.from_json(F.lit(text.replace("'", '"')), kind)

    group = F.size(F.filter(literal([g[0] for g in groups], f"array<{entry}>"), lambda b: b <= key))
    within = _bound(group, lambda g: (g - 1) * width + F.size(
        F.filter(F.element_at(literal(groups, f"array<array<{entry}>>"), g), lambda b: b <= key)
    ))
    return (within - 1).cast("int")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (``doc_id``, key, ``text``, ``sketch``) with ``next_text`` and ``next_sketch`` of the next one in order.

    Order is by id, null last, then by a hash of the text; the last row is followed by the first, a lone row by itself,
    a repeated row by its copy. Rows are dealt by key ranges and sorted there; the first rows of each range are also
    sent to the range before it, so texts move once and no task sees more than a range, whatever the ids are like.
    """
    rows = texts(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    spark = docs.sparkSession
    size = F.octet_length("text").cast("long")
    keys = staged(rows.select("kid", "kh", size.alias("bytes")), "fingerprint-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(keys, min(MOST_RANGES, max(least, total // RANGE_BYTES)))
    # One row per range: at most MOST_RANGES rows of three numbers, or 1.5 MiB.
    firsts = F.broadcast(spark.createDataFrame(
        [(kid, kh, (i - 1) % len(bounds)) for i, (kid, kh) in enumerate(bounds)], "kid long, kh long, range int"
    ))
    columns = ["range", "guest", "doc_id", "kid", "kh", "text"]
    at_home = rows.withColumns({"range": _range_of(bounds), "guest": F.lit(False)}).select(columns)
    guests = rows.join(firsts, ["kid", "kh"]).withColumn("guest", F.lit(True)).dropDuplicates(["kid", "kh"]).select(columns)
    order = Window.partitionBy("range").orderBy("guest", "kid", "kh")
    # Both windows use the same exchange and sort; between them each text is sketched once.
    followed = at_home.unionByName(guests).withColumn("next_text", F.lead("text").over(order))
    followed = followed.withColumn("sketch", sketch(F.col("text"))).withColumn("next_sketch", F.lead("sketch").over(order))
    return followed.where("not guest").select("doc_id", "kid", "kh", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SKETCH, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, key, ``sketch`` and ``distinct_shingles`` of every row; rows with equal texts have equal sketches."""
    rows = texts(docs, doc_id, text).select("doc_id", "kid", "kh", sketch(F.col("text"), k, size).alias("sketch"))
    return rows.withColumn("distinct_shingles", distinct_shingles(F.col("sketch"), k))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` against an edited text of its own and against the next document.

    The edited text has the last quarter of the code points replaced by as many of the next text's first ones, or by all
    if there are fewer. A null text is empty; an empty table gives no rows; repeated rows each have a result.
    """
    rows = with_next(docs)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", F.length("text") - quarter), F.left("next_text", quarter))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    one, two, other = F.col("sketch"), F.col("next_sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encoded(one).alias("fingerprint"), encoded(other).alias("edited_fingerprint"), resemblance(one, other).alias("near_edited"),
        resemblance(one, two).alias("near_next"), containment(one, other).alias("contained_edited"),
        distinct_shingles(one).alias("distinct_shingles"),
    )


def op11_document_fingerprints(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))
