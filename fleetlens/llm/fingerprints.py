"""Bottom-k sketches of five-word shingles.

A fingerprint is the k smallest 64-bit hashes of a text's distinct shingles of five
words (words as they stand; of a text of fewer words, the whole sequence). Fewer than k
hashes are the whole set. Two sketches merge into that of the union, and estimate
resemblance, containment and the number of distinct shingles; all of that is exact
while the sets are no larger than k.

Null texts are empty; an empty text, or one of spaces, has no shingle and an empty
fingerprint. Two empty fingerprints resemble each other fully, an empty and another one
not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.text import let, partitions, whole, words

SHINGLE = 5
K = 128
BUCKETS_PER_PARTITION = 6
LEAST_ACCURACY = 10_000
NO_ID = -(2**63)


def shingle_hashes(text: str | Column, size: int = SHINGLE) -> Column:
    """Distinct shingle hashes, in no order."""

    def of(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found) - (size - 1), F.lit(1)))
        hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, size)))
        return F.when(F.size(found) == 0, F.array().cast("array<long>")).otherwise(F.array_distinct(hashed))

    return let(words(text), of)


def sketch(text: str | Column, k: int = K) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""

    def of(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), union))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return let(merged(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = F.element_at(a, -1).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: |A and B| over |A|, 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def written(sketched: Column) -> Column:
    """The sketch as text: 16 hex digits a hash, ascending."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _place(doc_id: Column, ends: list[int]) -> Column:
    """How many ends are below the id: a binary search in the sorted ends."""
    held = F.array(*map(F.lit, ends))
    found = F.lit(0)
    step = 1 << max(len(ends).bit_length() - 1, 0)

    def search(ends_: Column) -> Column:
        steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])

        def probe(low: Column, jump: Column) -> Column:
            at = F.try_element_at(ends_, low + jump)
            return F.when(at < doc_id, low + jump).otherwise(low)

        return F.aggregate(steps, found, probe)

    return let(held, search)


def seats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, guest): documents seated so that neighbours by id are together.

    Documents go to buckets of neighbouring ids, so that the order is found in parallel:
    the ends of the buckets are ids at equal ranks (a fixed number per partition, the
    only thing the driver holds). The document at the end of a bucket is also a guest of
    the following bucket, to be the first one's next; the largest id is a guest of the
    first bucket. Repeated ids are ordered by text; null ids count as the smallest.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "doc_id", whole("text").alias("text"))
    wanted = partitions(docs) * BUCKETS_PER_PARTITION
    ranks = [i / wanted for i in range(1, wanted + 1)]
    accuracy = F.lit(max(LEAST_ACCURACY, 10 * wanted))
    held = keyed.agg(F.percentile_approx("key", ranks, accuracy).alias("ends"), F.max("key").alias("last")).first()
    if held["last"] is None:
        return docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(False).alias("guest"))
    ends = sorted({*held["ends"], held["last"]})
    own = _place(F.col("key"), ends)
    is_end = F.element_at(F.array(*map(F.lit, ends)), own + 1) == F.col("key")
    onward = F.pmod(own + 1, F.lit(len(ends)))
    stay, visit = (F.struct(at.cast("int").alias("bucket"), F.lit(guest).alias("guest")) for at, guest in ((own, False), (onward, True)))
    homes = F.when(is_end, F.array(stay, visit)).otherwise(F.array(stay))
    return keyed.select("doc_id", "text", F.inline(homes))


def order_by_id() -> Window:
    """Within a bucket: guests first, then ids ascending, ties by text."""
    return Window.partitionBy("bucket").orderBy(
        F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), F.col("text")
    )


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of another text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprinted(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and two likenesses.

    A table of one document has itself as the next; an empty table gives no rows.
    """
    order = order_by_id()
    seated = seats(docs)
    paired = seated.withColumn("next_text", F.lag("text").over(order))
    changed = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    sketched = paired.select(
        "doc_id", "text", "bucket", "guest", changed.alias("edited"), sketch("text", k).alias("own")
    ).withColumn("edited_own", F.when(~F.col("guest"), sketch("edited", k)))
    compared = sketched.withColumn("next_own", F.lag("own").over(order)).filter(~F.col("guest"))
    return compared.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("edited_own")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited_own"), k).alias("near_edited"),
        resemblance(F.col("own"), F.coalesce("next_own", F.array().cast("array<long>")), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles_estimate"),
    )
