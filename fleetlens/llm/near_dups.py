"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Each distinct five-word shingle is a 64-bit hash. Under each of 125 permutations of the
hashes a document keeps the smallest and the largest, so that 125 evaluations give a
signature of 250 values; bands of five are compared. Documents with equal sets are one
class, and only a class's first document goes on.

Within a bucket (equal band) nothing is paired with everything. Documents are tied to
the most central one of the bucket, the one that meets most others over all bands; of
each document's ties the one that shares most bands is confirmed first. In a second
round only buckets that still hold several components are looked at: documents outside
the most central one's component are tied to it and to the most central one outside. So
a round costs a few comparisons a document, however large a group is, and what is known
to be connected is not compared again. Comparisons are made where the first document's set is: its text goes to each part of
its group once.

These rounds only connect cheaply what is near central documents. Then all documents of
buckets that still hold several components are compared by a prefix filter: of each set
only the rarest shingles are looked at, as many as must hold one of any set that is
similar enough. So documents that are alike, but below the limit, seldom meet through a
shingle of their common part. What meets a component is compared with its documents and
among itself, in blocks of bounded size and once for all shingles; no link between
documents that share a bucket is lost.

Rows that repeat an id are one document, linked by what any of its texts is linked by.
Rows without an id are not compared: their component is null, and they are kept. Texts
without words have no shingles and are linked with nothing but rows of their id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.batches import Columns, slices, with_columns
from fleetlens.llm.components import components
from fleetlens.llm.filter_audit import met
from fleetlens.llm.stored import stored
from fleetlens.llm.text import partitions
from fleetlens.session import ensure_checkpoint_dir

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 125
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
TIES = 1_000_003
SEED = 20240607
AT_ONCE = 4096
# Bytes hashed at once, and the longest word that is hashed letter by letter.
PIECE = 250_000
LONG_WORD = 4096
WHITE = [bytes([c]) for c in (32, *range(9, 14))]
SPACE = re.compile(rb"[\x20\x09-\x0D]")
# Shingles in a block of documents to compare; every document counts as SLOT more.
BLOCK = 200_000
SLOT = 256


@lru_cache(maxsize=1)
def constants() -> dict[str, np.ndarray]:
    """Random odd factors and tables, the same in every process."""
    source = np.random.Generator(np.random.PCG64(SEED))

    def odd(n: int) -> np.ndarray:
        return source.integers(0, 2**64, n, np.uint64) | np.uint64(1)

    letters = odd(256)
    letters[65:91] = letters[97:123]
    return {
        "letters": letters,
        # Always as many draws, so what is drawn after them does not depend on LONG_WORD.
        "offsets": odd(4096)[:LONG_WORD],
        "places": odd(SHINGLE),
        "lengths": odd(SHINGLE + 1),
        "factors": odd(PERMUTATIONS),
        "terms": odd(PERMUTATIONS),
        "rows": odd(ROWS),
        "bands": odd(BANDS),
    }


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long_word(raw: bytes, start: int, end: int) -> np.ndarray:
    """The hash of a word of over LONG_WORD bytes, a piece at a time."""
    made = hashlib.blake2b(digest_size=8)
    for at in range(start, end, PIECE):
        made.update(raw[at : min(at + PIECE, end)].lower())
    return np.frombuffer(made.digest(), np.uint64)


def _hashed(raw: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a stretch that cuts none, and where they start.

    A word is the sum of its letters, each times a factor of its place in the word.
    """
    fixed = constants()
    data = np.frombuffer(raw, np.uint8, end - start, start)
    word = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = fixed["letters"][data[word]] * fixed["offsets"][np.minimum(places, LONG_WORD - 1)]
    sums = np.add.reduceat(letters, np.cumsum(lengths) - lengths)
    hashes = mixed(sums + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        hashes[i] = _long_word(raw, start + int(starts[i]), start + int(ends[i]))[0]
    return hashes, starts + start


def _stretches(raw: bytes) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of about PIECE bytes that cut no word; a longer word is one."""
    start = 0
    while len(raw) - start > PIECE:
        found = max(raw.rfind(space, start + 1, start + PIECE) for space in WHITE)
        if found < 0:
            after = SPACE.search(raw, start + PIECE)
            found = after.start() if after else len(raw)
        yield start, found
        start = found
    yield start, len(raw)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where they start."""
    found = []
    for start, end in _stretches(raw):
        if end - start > PIECE:  # one long word, perhaps after a space
            inside = start + (raw[start : start + 1] in WHITE)
            found.append((_long_word(raw, inside, end), np.array([inside])))
        else:
            found.append(_hashed(raw, start, end))
    return tuple(np.concatenate(x) for x in zip(*found))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending.

    Words are hashed a bounded number of bytes at a time, of many short texts at once;
    moving sums of word hashes give shingles.
    """
    fixed = constants()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    words, starts = word_hashes(b" ".join(raw)) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    owners = np.searchsorted(np.cumsum(sizes), starts, side="right")
    counts = np.bincount(owners, minlength=len(texts))
    firsts = np.cumsum(counts) - counts
    n = max(len(words) - SHINGLE + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for place, factor in enumerate(fixed["places"]):
        rolled += words[place : place + n] * factor
    rolled = mixed(rolled + fixed["lengths"][SHINGLE])
    out = []
    for first, count in zip(firsts.tolist(), counts.tolist()):
        if count >= SHINGLE:
            out.append(np.unique(rolled[first : first + count - SHINGLE + 1]))
        elif count:
            total = (words[first : first + count] * fixed["places"][:count]).sum(dtype=np.uint64)
            out.append(mixed(total[None] + fixed["lengths"][count : count + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest and the largest hash under each permutation."""
    fixed = constants()
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), AT_ONCE):
        moved = np.multiply.outer(fixed["factors"], hashes[i : i + AT_ONCE])
        moved += fixed["terms"][:, None]
        np.minimum(least, moved.min(axis=1), out=least)
        np.maximum(most, moved.max(axis=1), out=most)
    return np.concatenate([least, most])


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, np.int64)
    fixed = constants()
    values = mixed(signature(hashes)).reshape(ROWS, BANDS).T * fixed["rows"]
    return mixed(values.sum(axis=1, dtype=np.uint64) + fixed["bands"]).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): s1 and s2 are a 128-bit hash of the whole set."""

    def make(texts: list[str]) -> Columns:
        sets = shingle_sets(texts)
        marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
        return [[len(s) for s in sets], [int(m[0]) for m in marks], [int(m[1]) for m in marks], [band_hashes(s) for s in sets]]

    return with_columns(docs, "n_shingles long, s1 long, s2 long, bands array<long>", make, "doc_id")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; texts are (doc_id, text).

    Pairs are dealt by u and a share of their v, and the text of u leads its share.
    """
    n = partitions(pairs)
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int"))
    heads = dealt.select("u", "share").distinct().withColumn("v", F.lit(None).cast("long"))
    sides = heads.select("u", "share", "v", F.col("u").alias("doc_id")).unionByName(
        dealt.select("u", "share", "v", F.col("v").alias("doc_id"))
    )
    placed = sides.join(texts, "doc_id").select("u", "share", "v", "text")
    ordered = placed.repartition(n, "u", "share").sortWithinPartitions("u", "share", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(["" if t is None else t for t in part.column("text").to_pylist()])
                us, vs = part.column("u").to_pylist(), part.column("v").to_pylist()
                shares = part.column("share").to_pylist()
                good = []
                for u, share, v, own in zip(us, shares, vs, found):
                    if v is None:
                        if held != (u, share):
                            held, sets = (u, share), []
                        sets.append(own)
                        continue
                    for first in sets:
                        both = len(np.intersect1d(first, own, assume_unique=True))
                        if both and 100 * both >= PERCENT * (len(first) + len(own) - both):
                            good.append((u, v))
                            break
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for u, _ in good], pa.int64()), pa.array([v for _, v in good], pa.int64())], ["u", "v"]
                )

    return ordered.mapInArrow(run, "u long, v long").distinct()


def ordered_by_centrality(members: DataFrame) -> DataFrame:
    """(bucket, v, weight) of the buckets with two documents or more.

    weight orders documents by the sizes of all their buckets; a hash of the id tells
    equal ones apart.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    shared = stored(members.join(sizes, "bucket").withColumnRenamed("doc_id", "v"))
    total = shared.groupBy("v").agg(F.sum("size").alias("met"))
    weight = F.col("met") * TIES + F.pmod(F.xxhash64("v"), F.lit(TIES))
    return stored(shared.select("bucket", "v").join(total.select("v", weight.alias("weight")), "v"))


def with_component(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    known = parts.select(F.col("node").alias("v"), "component")
    return buckets.join(known, "v", "left").withColumn("component", F.coalesce("component", "v"))


def ties(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(u, v, n_bands): the pairs to compare next, u a central document of v's bucket.

    v is outside the component of the bucket's most central document; u is that
    document, and the most central one outside if v is neither it nor of its component.
    """
    placed = with_component(buckets, parts)
    spread = placed.groupBy("bucket").agg(
        F.max_by(F.struct(F.col("v").alias("u1"), F.col("component").alias("c1")), "weight").alias("top"),
        F.min("component").alias("_a"),
        F.max("component").alias("_b"),
    )
    still_open = spread.filter("_a != _b").select("bucket", "top.*")
    outside = placed.join(still_open, "bucket").filter("component != c1")
    second = outside.groupBy("bucket").agg(
        F.max_by(F.struct(F.col("v").alias("u2"), F.col("component").alias("c2")), "weight").alias("top"),
        F.min("component").alias("_a"),
        F.max("component").alias("_b"),
    )
    among = second.filter("_a != _b").select("bucket", "top.*")
    to_first = outside.select(F.col("u1").alias("u"), "v")
    to_second = outside.join(among, "bucket").filter("component != c2").select(F.col("u2").alias("u"), "v")
    return to_first.unionByName(to_second).groupBy("u", "v").agg(F.count("*").alias("n_bands"))


def exploded(texts: DataFrame) -> DataFrame:
    """(v, k, size, component, hash): a row for each shingle of each text of (v, component, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(["" if t is None else t for t in part.column("text").to_pylist()])
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                own = pa.array(np.repeat(np.arange(len(sets)), sizes))
                hashes = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                kept = [part.column(c).take(own) for c in ("v", "k", "component")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.repeat(sizes, sizes)), pa.array(hashes)], ["v", "k", "component", "size", "hash"]
                )

    chosen = texts.select("v", F.xxhash64("v", "text").alias("k"), "component", "text")
    return chosen.mapInArrow(run, "v long, k long, component long, size long, hash long")


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(hash, n, v, component, size): the rarest shingles of each text that others have too.

    Two sets of a similarity of PERCENT or more share one of the size - needed + 1 first
    shingles of each, in any order that is the same for both, where needed is PERCENT of
    the size; here the rarest come first.
    """
    counts = stored(sets.groupBy("hash").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = met(sets, counts, ["hash"], total).groupBy("v", "k", "component", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("every")
    )
    first = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1
    return found.select("v", "component", "size", F.inline(F.slice("every", F.lit(1), first.cast("int")))).filter("n > 1")


def links_across(nodes: list[int], low: list[bool], inside: bool, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different nodes some of whose sets are similar enough, without cycles.

    Each set marked low is counted against all others, through the lists of sets that have
    a shingle; against low ones only with `inside`. Others are not compared with each other.
    """
    own, sizes, first_side = np.array(nodes, np.int64), np.array([len(s) for s in sets], np.int64), np.array(low, bool)
    parent = {n: n for n in nodes}

    def top(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    if len(parent) < 2 or not first_side.any():
        return []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids)
    starts, firsts = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    out = []
    for i in np.flatnonzero(first_side).tolist():
        held = ids[firsts[i] : firsts[i] + sizes[i]]
        lengths = counts[held]
        at = np.repeat(starts[held] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        near = (both > 0) & (100 * both >= PERCENT * (sizes + sizes[i] - both)) & (own != own[i])
        if not inside:
            near &= ~first_side
        for j in np.flatnonzero(near).tolist():
            a, b = top(nodes[i]), top(nodes[j])
            if a != b:
                parent[b] = a
                out.append((nodes[i], nodes[j]))
    return out


def compared(met_in: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between components, from comparing documents that have met.

    met_in is (hash, v, component, size). Of each hash, the component with most documents
    is the main one; what any hash sets against a main component is compared with it and
    among itself, once, whatever the number of hashes. Both sides are cut into blocks of
    bounded size, and each pair of blocks is one piece of work; documents of the main
    component are never compared with each other.
    """
    per_hash = met_in.groupBy("hash", "component").agg(F.count("*").alias("n"))
    main = per_hash.groupBy("hash").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    total = met_in.count()
    main = stored(main.join(per_hash.groupBy("hash").agg(F.sum("n").alias("n")), "hash"))
    sided = met(met_in, main, ["hash"], total).select("main", "v", "component", "size").distinct()
    sided = stored(sided.withColumn("is_main", F.col("component") == F.col("main")))
    loads = sided.groupBy("main").agg(
        *[F.ceil(F.sum(F.when(side, F.col("size") + SLOT)) / block).cast("int").alias(name)
          for side, name in ((~F.col("is_main"), "n_low"), (F.col("is_main"), "n_high"))]
    )
    draw = F.xxhash64("v")
    cut = sided.join(loads, "main").withColumn(
        "at", F.when(F.col("is_main"), F.col("n_low") + F.pmod(draw, F.col("n_high"))).otherwise(F.pmod(draw, F.col("n_low"))).cast("int")
    )
    before = F.when(F.col("at") > 0, F.sequence(F.lit(0), F.least("at", "n_low") - 1)).otherwise(F.array().cast("array<int>"))
    last = F.col("n_low") + F.col("n_high") - 1
    after = F.when(F.col("is_main"), F.array().cast("array<int>")).otherwise(F.sequence(F.col("at") + 1, last))
    as_high = F.transform(before, lambda i: F.struct(i.alias("low"), F.col("at").alias("high")))
    as_low = F.transform(after, lambda i: F.struct(F.col("at").alias("low"), i.alias("high")))
    pieces = cut.select("main", "v", "component", "at", "n_low", F.inline(F.concat(as_high, as_low)))
    pieces = pieces.select(
        "main", "low", "high", "v", "component",
        (F.col("at") == F.col("low")).alias("is_low"), (F.col("high") == F.col("n_low")).alias("inside"),
    )
    rows = pieces.join(texts.select(F.col("doc_id").alias("v"), "text"), "v").drop("v")
    keys = ["main", "low", "high"]
    ordered = rows.repartition(partitions(met_in), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, ([], [], [])
        inside = False

        def record() -> pa.RecordBatch:
            links = links_across(held[0], held[1], inside, held[2])
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(["" if t is None else t for t in part.column("text").to_pylist()])
                names = [part.column(c).to_pylist() for c in (*keys, "inside", "component", "is_low")]
                for *now, own_inside, node, is_low, own in zip(*names, found):
                    if now != piece:
                        yield record()
                        piece, held, inside = now, ([], [], []), own_inside
                    for column, value in zip(held, (node, is_low, own)):
                        column.append(value)
        yield record()

    return ordered.mapInArrow(run, "u long, v long").distinct()


def missed(buckets: DataFrame, parts: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that join all components of documents that share a bucket and are
    similar enough; u and v are components. texts are (doc_id, text).

    Documents of open buckets meet in their rare shingles; a shingle that only one
    component has is left out.
    """
    placed = with_component(buckets, parts)
    spread = placed.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
    held = placed.join(spread.filter("_a != _b").select("bucket"), "bucket").select("v", "component").distinct()
    open_texts = texts.withColumnRenamed("doc_id", "v").join(held, "v").select("v", "component", "text")
    rare = stored(rare_shingles(stored(exploded(open_texts))))
    spread = rare.groupBy("hash").agg(F.count("*").alias("n"), F.min("component").alias("_a"), F.max("component").alias("_b"))
    between = stored(spread.filter("_a != _b").select("hash", "n"))
    both = stored(met(rare.drop("n"), between, ["hash"], rare.count()).drop("n"))
    return compared(both, texts, block)


def joined_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """`parts` (node, component) after more links (u, v)."""
    name = lambda side: F.coalesce(F.col(f"_{side}"), F.col(side)).alias(side)
    moved = links
    for side in ("u", "v"):
        known = parts.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        moved = moved.join(known, side, "left")
    merged = components(moved.select(name("u"), name("v")))
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = parts.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    # Nodes without a component so far are their own.
    new = merged.join(parts.select("node"), "node", "left_anti")
    return old.unionByName(new)


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs` (doc_id, text)."""
    ensure_checkpoint_dir(docs.sparkSession)
    prints = signatures(docs).checkpoint()
    named = prints.filter(F.col("doc_id").isNotNull())
    classes = (
        named.filter(F.col("n_shingles") > 0).groupBy("s1", "s2").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    )
    # Copies are linked to the first of their class; the class goes on as that document.
    several = stored(classes.filter(F.col("n") > 1))
    of_class = met(named.filter(F.col("n_shingles") > 0), several, ["s1", "s2"], named.count())
    copies = stored(in_order(of_class.select(F.col("head").alias("u"), F.col("doc_id").alias("v"))))
    heads = named.join(classes.select("s1", "s2", F.col("head").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    buckets = ordered_by_centrality(heads.select("doc_id", F.explode("bands").alias("bucket")))
    wanted = buckets.select(F.col("v").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").checkpoint()

    alone = buckets.select(F.col("v").alias("node"), F.col("v").alias("component")).limit(0)
    every = ties(buckets, alone)
    asked = every.groupBy("v").agg(F.max(F.struct("n_bands", (-F.col("u")).alias("minus_u"))).alias("best"))
    pairs = stored(in_order(asked.select((-F.col("best.minus_u")).alias("u"), "v")))
    parts = stored(components(stored(confirmed(pairs, texts))))
    pairs = stored(in_order(ties(buckets, parts)).join(pairs, ["u", "v"], "left_anti"))
    parts = stored(joined_parts(parts, stored(confirmed(pairs, texts))))

    last = missed(buckets, parts, texts)
    ends = joined_parts(parts, stored(last.unionByName(copies))).withColumnRenamed("node", "_node")
    return (
        prints.select("doc_id", "n_shingles")
        .join(ends, F.col("doc_id") == F.col("_node"), "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def in_order(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) once."""
    return pairs.select("u", "v").filter(F.col("u") != F.col("v")).distinct()


def deduped(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group, the one with the smallest id; rows without an id stay."""
    kept = grouped(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).filter("kept_id IS NOT NULL").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"))
    named = rows.join(kept, F.col("id") == F.col("kept_id"), "left_semi").dropDuplicates(["id"]).select("row")
    every = named.unionByName(rows.filter(F.col("id").isNull()).select("row"))
    return every.select(*[F.col("row")[c].alias(c) for c in docs.columns])
