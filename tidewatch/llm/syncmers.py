"""Document fingerprints from closed syncmers of words, in native column expressions.

A k-mer is k words in a row; its inner substrings are pairs of adjacent words. It is chosen if the smallest hash of its
inner pairs stands at its first or last place. The choice looks at nothing outside the k-mer, so a passage has the same
anchors in every document. A text without a chosen k-mer has the hash of all its words as its one anchor. Documents are
compared by all their distinct anchors. A fingerprint is a digest: the smallest of them, a fixed number at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a k-mer.
K = 5
_SPACE = "[\\x20\\x09-\\x0D]+"
#: Buckets of ids that neighbours are sought in, at most; their limits are the leaves of one expression.
MAX_BUCKETS = 1024


def _with_anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the array `to`: a hash per word place, null where no chosen k-mer begins. Texts must not be null.

    Each step is a column of its own, so that nothing is computed twice.
    """
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    out = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    out = out.withColumn("_s", F.expr("transform(slice(_h, 1, greatest(size(_h) - 1, 0)), (x, i) -> xxhash64(x, get(_h, i + 1)))"))
    place = F.expr(
        """transform(_s, (x, i) -> CASE
             WHEN i + 4 < size(_h) AND (least(x, get(_s, i + 1), get(_s, i + 2), get(_s, i + 3)) = x
                  OR least(x, get(_s, i + 1), get(_s, i + 2)) >= get(_s, i + 3))
             THEN xxhash64(x, get(_s, i + 2), get(_h, i + 4)) END)"""
    )
    out = out.withColumn("_p", place)
    none = F.array().cast("array<bigint>")
    anchors = F.when(F.size("_h") == 0, none).when(F.exists("_p", lambda x: x.isNotNull()), F.col("_p")).otherwise(F.array(F.xxhash64("_h")))
    return out.withColumn(to, anchors).drop("_h", "_s", "_p")


def _with_hashes(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the array `to`: the distinct 32-bit hashes of all anchors of a text, less 2^31, ascending."""
    out = _with_anchors(df, text, "_a")
    hashes = F.expr("array_distinct(transform(filter(_a, x -> x IS NOT NULL), x -> cast((x & 4294967295) - 2147483648 AS int)))")
    return out.withColumn(to, F.sort_array(hashes)).drop("_a")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, hash): the chosen k-mers with the place of their first word, for matching by position.

    A text without a chosen k-mer has one anchor at place 0; null texts and texts without words have none.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _with_anchors(plain, "text", "_a").select("id", F.posexplode("_a").alias("place", "hash"))
    return found.where("hash IS NOT NULL")


def _text(hashes: str) -> Column:
    """The fingerprint: eight hex digits per hash, ascending."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x.cast("bigint") + 2147483648), 8, "0")), "")


def _likeness(a: str, b: str) -> Column:
    """Share of the hashes of both texts together that both hold; 1 of two texts without words."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def fingerprints(docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint: 8 hex digits per hash. Equal texts have equal ones; null texts and such without words an
    empty one. A column of docs of that name is replaced."""
    others = [c for c in docs.columns if c != to]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}_") for i, c in enumerate(others)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = _with_hashes(plain, "text", "_f")
    return out.select(*(F.col(f"_{i}_").alias(c) for i, c in enumerate(others)), _text("_f").alias(to))


def _bucket(limits: list[int], first: int = 0) -> Column:
    """Place of order_id among ascending limits, as a tree of comparisons."""
    if not limits:
        return F.lit(first)
    middle = len(limits) // 2
    return F.when(F.col("key") < limits[middle], _bucket(limits[:middle], first)).otherwise(_bucket(limits[middle + 1 :], first + middle + 1))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, hashes, next_text, next_hashes): each text beside that of the next id, the first one's beside the last.

    Ids are dealt to buckets of about equal size by their quantiles. Within a bucket the next row is the one below; the
    last one's next is the first row of the next bucket. Null ids come first, equal ids in the order of their texts.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    limits = rows.agg(F.percentile_approx("key", shares, 10 * MAX_BUCKETS)).first()[0] or []
    bucket = _bucket(sorted(set(limits)))
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r.bucket, r.key) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    # A row per bucket: whose first row is the next one of whose last row.
    turns = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    after = spark.createDataFrame(turns, "last_of long, key long")
    heads = rows.join(F.broadcast(after), "key").groupBy("last_of").agg(F.min("text").alias("head"))
    heads = _with_hashes(heads, "head", "head_hashes").select(F.col("last_of").cast("int").alias("bucket"), "head", "head_hashes")
    order = W.partitionBy("bucket").orderBy("key", "text")
    beside = _with_hashes(rows, "text", "hashes").select("bucket", "id", "text", "hashes", F.lead("text").over(order).alias("below"), F.lead("hashes").over(order).alias("below_hashes"))
    return beside.join(heads, "bucket", "left").select("id", "text", "hashes", F.coalesce("below", "head").alias("next_text"), F.coalesce("below_hashes", "head_hashes").alias("next_hashes"))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next text.
    Null texts count as empty; the likeness is that of the fingerprints, and 1 of two texts without words. One row alone is its own next one.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = _with_hashes(rows.select("id", "n_chars", "hashes", "next_hashes", edited.alias("edited_text")), "edited_text", "edited_hashes")
    return rows.select(
        "id", "n_chars", "edited_text", _text("hashes").alias("fingerprint"), _text("edited_hashes").alias("edited_fingerprint"),
        _likeness("hashes", "edited_hashes").alias("near_edited"), _likeness("hashes", "next_hashes").alias("near_next"),
    )
