"""Jaccard join of word shingles with PartEnum signatures, and the groups of documents that it links.

Two sets of sizes a <= b link if 4 |A & B| >= 3 |A | B|; then b <= 4a/3 and at most (a + b) / 7 <= a / 3 features are in one of
them only. A level, chosen by the size of the smaller set, partitions the domain of features: each differing feature spoils
one partition, so of k + 1 partitions that are not empty at least one is equal in both sets. A set therefore emits the hashes of
its first k + 1 partitions that are not empty, k being a third of its size, at its own level, and with k = 2b/7 at lower levels
that a smaller partner may have. Linked sets share a signature. On the first level a partition is a single feature.

* Partitions that very many sets have in common (found in a sample; this is about speed only) are passed over: a set emits its
  first k + 1 others. A set that has fewer lacks them: it emits them all, all its uncommon features, and, in a channel of its own,
  its first k + 1 partitions of any kind. So of two linked sets either one has k + 1 uncommon partitions and they share one of
  those, or both lack them and share an uncommon feature or, in that channel, some partition.
* A set that has fewer than k + 1 partitions in all (very unlikely) makes all sets of linkable size emit single features too.

Equal sets are one. In each group of a signature, sets are first compared with one of them, then, round by round, with one that
is not connected yet. What is still unconnected is then compared pair by pair, but in the channel of sets that lack uncommon
partitions with less: two sets that share no uncommon feature have the similarity |C & D| / (|C | D| + r + s), C and D being their
common features and r and s the numbers of their others. Of the sets with the same C in a signature the one with the least r thus
links with whatever any of them links with, and all links between them and others can be had through it; so each set is compared
with that one set of each C that may be similar enough to its own, which shares a feature of a prefix with it. A pair is first held against the parity bitmaps of
its sets: each feature flips a bit, so bits that differ are at most as many as features that do, and a pair with more of them
than linked sets may have is out. The others are compared feature by feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, documents, id_text, partitions, pool, table, tidied
from .graph import components
from .suffix import mixed

WORDS = 5
#: Sets up to this size use single features.
SINGLES = 32
#: One in how many documents is in the sample that shows which partitions are common, how many of it make one common (so about
#: the product of both in all documents), and the most that are kept.
SAMPLE_OF = 8
COMMON = 4
KEPT_COMMON = 1_000_000
#: Documents up to this many (16 MB of ids) are named to all tasks when their texts are read again; more are joined by shuffle.
SENT_IDS = 1_000_000
#: Rounds in which a signature's sets are compared with one of them before the pairs left are compared.
STAR_ROUNDS = 2
#: Marks a signature of the channel of sets that lack uncommon partitions: its lowest bit.
ANY = np.uint64(1)
#: In place of a level, for single features that such sets emit.
FEATURE_TAG = 63

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words low[start:end]: one to one for words of a length up to 8 bytes, XXH3 for longer ones."""
    size, raw = ends - starts, low.tobytes() + bytes(8)
    eight = np.ndarray(len(low) + 1, "<u8", raw, strides=(1,))[starts]  # the 8 bytes from each word's start
    eight &= np.where(size < 8, (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1), np.uint64((1 << 64) - 1))
    out = mixed(mixed(eight) + size.astype(np.uint64) * _STEP)
    long = np.flatnonzero(size > 8)
    out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its set of shingles, as ascending 64-bit hashes."""
    n_texts = len(offsets) - 1
    none = np.zeros(0, dtype=np.uint64)
    low = _FOLD[data]
    solid = ~_BLANK[low]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    if not len(starts):
        return [none] * n_texts
    hashes = word_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)  # each text's first word
    n = len(hashes) - words + 1
    rolled = none
    if n > 0:
        rolled = np.full(n, words, dtype=np.uint64)
        for k in range(words):
            rolled = mixed(rolled * _STEP + hashes[k : k + n])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = mixed(np.array([whole * _STEP + h], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(none)
    return out


def level(size: int) -> int:
    """Bits of the partition number; 0: single features."""
    if size <= SINGLES:
        return 0
    return (size - 1).bit_length() if size <= 256 else (-(-size // 2) - 1).bit_length()


def levels(size: int) -> list[tuple[int, int]]:
    """(level, k) under which a set of this size emits: its own level, and those of smaller sets that it may link with."""
    own = level(size)
    return [(own, size // 3)] + [(x, 2 * size // 7) for x in range(level(-(-3 * size // 4)), own) if x == 0 or x >= 6]


def signatures(features: np.ndarray, bits: int) -> np.ndarray:
    """A hash for each partition that is not empty, in order of partitions; that of a single feature is the same on all levels."""
    each = mixed(features)
    if not len(features) or bits == 0:
        return each
    part = features >> np.uint64(64 - bits)
    return np.add.reduceat(each, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])))


def among(common: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the ascending list."""
    if not len(common):
        return np.zeros(len(found), dtype=bool)
    return common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found


def tagged(found: np.ndarray, bits: int) -> np.ndarray:
    """Signatures as they are emitted on a level; the lowest bit is clear."""
    return mixed(found + np.uint64(bits * int(_STEP) % (1 << 64))) & ~ANY


def is_poor(features: np.ndarray) -> bool:
    """Whether a level has too few partitions that are not empty."""
    return any(len(signatures(features, bits)) < min(k + 1, len(features)) for bits, k in levels(len(features)) if bits)


def emitted(features: np.ndarray, common: np.ndarray, single_too: bool) -> np.ndarray:
    out, lacks = [], False
    for bits, k in levels(len(features)) + ([(0, len(features) // 3)] if single_too else []):
        all_of = signatures(features, bits)
        rare = all_of[~among(common, all_of)]
        out.append(tagged(rare[: k + 1], bits))
        if len(rare) <= k:
            out.append(tagged(all_of[: k + 1], bits) | ANY)
            lacks = True
    if lacks:
        singles = signatures(features, 0)
        out.append(tagged(singles[~among(common, singles)], FEATURE_TAG))
    return np.unique(np.concatenate(out))


def sketch(features: np.ndarray) -> bytes:
    """Parity bitmap: each feature flips the bit that its hash names; a power of two of bits, at least the number of features."""
    bits = 64 if len(features) <= SINGLES else 2 << level(len(features))
    at = mixed(features + _STEP) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(a: bytes, size_a: int, b: bytes, size_b: int) -> bool:
    """False only if the bitmaps prove that the sets differ in too many features. The longer bitmap is folded onto the shorter."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return 7 * (x ^ y).bit_count() <= size_a + size_b


def _steps(batch):
    """(ids, sets) of a batch, some bytes at a time."""
    data, offsets = pool(batch.column("text"))
    ids = batch.column("doc_id")
    for i, j in by_bytes(offsets):
        yield ids.slice(i, j - i).to_pylist(), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _summaries(batches):
    for batch in batches:
        for ids, sets in _steps(batch):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) > 0 and is_poor(s) for s in sets]), pa.array([sketch(s) for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "poor", "sketch"],
            )


def _all_signatures(batches):
    for batch in batches:
        for _, sets in _steps(batch):
            found = [np.unique(np.concatenate([signatures(s, bits) for bits in {0, *(x for x, _ in levels(len(s)))}])) for s in sets]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["sig"])


def _emit(common: np.ndarray, ranges: list[tuple[int, int]]):
    def run(batches):
        for batch in batches:
            seen: set[bytes] = set()
            for ids, sets in _steps(batch):
                sigs, docs, sizes = [], [], []
                for d, s in sorted(((d, s) for d, s in zip(ids, sets, strict=True) if d is not None and len(s)), key=lambda x: x[0]):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if digest in seen:
                        continue
                    seen.add(digest)
                    own = emitted(s, common, any(lo <= len(s) <= hi for lo, hi in ranges))
                    sigs.append(own)
                    docs.append(np.full(len(own), d, dtype=np.int64))
                    sizes.append(np.full(len(own), len(s), dtype=np.int32))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(sizes))], names=["sig", "doc_id", "size"])

    return run


def _classes(common: np.ndarray):
    """Of each set the number of its uncommon features, a hash of the others, and the head of those, a quarter of them and one more:
    sets of common features whose similarity is 0.75 or more share a feature of their heads."""

    def run(batches):
        for batch in batches:
            for ids, sets in _steps(batch):
                usual = [among(common, signatures(s, 0)) for s in sets]
                kept = [s[u] for s, u in zip(sets, usual, strict=True)]
                kinds = np.array([xxhash.xxh3_64_intdigest(c.tobytes()) for c in kept], dtype=np.uint64)
                heads = pa.array([c[: len(c) // 4 + 1].view(np.int64) for c in kept], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int((~u).sum()) for u in usual], pa.int32()), pa.array(kinds.view(np.int64)), heads], names=["id", "n_rare", "kind", "head"])

    return run


SHARED = "sig bigint, doc_id bigint, size int"


def _shared(batches):
    """Of rows in order of signature, those whose signature a neighbour has."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        sig = batch.column("sig").to_numpy()
        same = sig[1:] == sig[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        # the last row waits for its right neighbour; if it has a left one it goes out now and stays as a mark
        first = 1 if last is not None and sent else 0
        go = np.flatnonzero(keep[first:]) + first
        if len(go):
            yield batch.take(pa.array(go))
        sent = bool(keep[-1])
        last = batch.slice(batch.num_rows - 1, 1)


def _sets_rows(batches):
    for batch in batches:
        for ids, sets in _steps(batch):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "features"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _check(batches):
    for batch in batches:
        hit = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(hit)), batch.column("b").filter(pa.array(hit))], names=["a", "b"])


def _sift(batches):
    for batch in batches:
        hit = [may_link(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(hit, pa.bool_())), batch.column("b").filter(pa.array(hit, pa.bool_()))], names=["a", "b"])


def checked(pairs: DataFrame, sketches: DataFrame, rows: DataFrame) -> DataFrame:
    """A table of the pairs (a, b) that link. sketches: id, size and sketch of each set; only what they leave is read as text again."""
    ends = [sketches.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    left = table(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(tidied(_sift), "a bigint, b bigint"), "near-pairs")
    ids = left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()
    sets = table(of_ids(rows, ids).mapInArrow(tidied(_sets_rows), "id bigint, features binary").dropDuplicates(["id"]), "near-sets")
    fa, fb = (sets.select(F.col("id").alias(x), F.col("features").alias(f"f{x}")) for x in "ab")
    found = table(left.join(fa, "a").join(fb, "b").select("a", "b", "fa", "fb").mapInArrow(tidied(_check), "a bigint, b bigint"), "near-links")
    discard(left, sets)
    return found


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left_semi")


def pairs_left(left: DataFrame, rows: DataFrame, common: np.ndarray, fits: Column) -> DataFrame:
    """Rows (id, size, comp and the same of a partner) that are to be compared in the end."""
    sides = ["id", "size", "comp", "id_b", "size_b", "comp_b"]
    is_any = F.col("sig").bitwiseAND(1) == 1
    few = left.where(~is_any)
    other = few.select("sig", F.col("id").alias("id_b"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b"))
    tried = few.join(other, "sig").where(fits & (F.col("id") < F.col("id_b"))).select(*sides)

    many = left.where(is_any).select("id", "size", "comp").distinct()
    kinds = of_ids(rows, many.select(F.col("id").alias("doc_id"))).mapInArrow(tidied(_classes(common)), "id bigint, n_rare int, kind bigint, head array<bigint>")
    many = table(many.join(kinds.dropDuplicates(["id"]), "id"), "near-lacking")

    def can(usual: Column, n_rare: Column, usual_b: Column, n_rare_b: Column) -> Column:
        return 4 * F.least(usual, usual_b) >= 3 * (F.greatest(usual, usual_b) + n_rare + n_rare_b)

    # Kinds that may link share a feature of their heads; they meet at the first one of each run of features that they share.
    per = many.groupBy("kind").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.col("size") - F.col("n_rare")).alias("usual"), F.min("n_rare").alias("r"), F.first("head").alias("head"))
    at = F.transform("head", lambda f, i: F.struct(f.alias("f"), F.when(i > 0, F.get("head", i - 1)).alias("prev")))
    per = table(per.select("kind", "lo", "hi", "usual", "r", F.inline(at)), "near-heads")
    # All kinds but those of the component with most kinds there meet with all.
    main = per.groupBy("f", "lo").agg(F.count(F.lit(1)).alias("n")).groupBy("f").agg(F.max(F.struct("n", "lo")).alias("main"))
    outside = per.join(main, "f").where((F.col("lo") != F.col("main.lo")) | (F.col("hi") != F.col("main.lo"))).drop("main")
    per_b = per.select("f", *(F.col(c).alias(f"{c}_b") for c in ("kind", "lo", "hi", "usual", "r", "prev")))
    first_met = ~F.coalesce(F.col("prev") == F.col("prev_b"), F.lit(False))
    open_kinds = (F.least("lo", "lo_b") != F.greatest("hi", "hi_b")) & can(F.col("usual"), F.col("r"), F.col("usual_b"), F.col("r_b"))
    met = outside.join(per_b, "f").where(open_kinds & first_met).select("kind", "kind_b").distinct()
    met = table(met.unionByName(met.select(F.col("kind_b").alias("kind"), F.col("kind").alias("kind_b"))).distinct(), "near-kinds")

    best = many.groupBy("kind").agg(F.min(F.struct("n_rare", "id", "size", "comp")).alias("m"))
    best = best.select(F.col("kind").alias("kind_b"), F.col("m.id").alias("id_b"), F.col("m.size").alias("size_b"), F.col("m.comp").alias("comp_b"), F.col("m.n_rare").alias("n_rare_b"))
    members = many.drop("head")
    fit = can(F.col("size") - F.col("n_rare"), F.col("n_rare"), F.col("size_b") - F.col("n_rare_b"), F.col("n_rare_b"))
    return tried.unionByName(members.join(met.join(best, "kind_b"), "kind").where(fits & fit).select(*sides))


def near_links(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """(id, comp) of the sets that link with another; rows: doc_id and text; summaries: doc_id, n_shingles, digest, poor, sketch and rep."""
    spark = rows.sparkSession
    poor = [r["n_shingles"] for r in summaries.where("poor").select("n_shingles").distinct().collect()]
    ranges = [(3 * n // 4, 4 * n // 3 + 1) for n in poor]
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_OF)) == 0)
    often = sample.mapInArrow(tidied(_all_signatures), "sig bigint").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    common = np.sort(np.array([r["sig"] for r in often.orderBy(F.desc("n"), "sig").limit(KEPT_COMMON).select("sig").collect()], dtype=np.int64).view(np.uint64))

    dealt = rows.mapInArrow(tidied(_emit(common, ranges)), SHARED).repartition(partitions(rows), "sig").sortWithinPartitions("sig", "doc_id")
    shared = dealt.mapInArrow(tidied(_shared), SHARED)
    reps = summaries.select("doc_id", "rep").distinct()
    groups = table(shared.join(reps, "doc_id").select("sig", F.col("rep").alias("id"), "size").distinct(), "near-groups")
    sketches = summaries.where(F.col("doc_id") == F.col("rep")).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["id"])

    fits = (4 * F.least("size", "size_b") >= 3 * F.greatest("size", "size_b")) & (F.col("id") != F.col("id_b")) & (F.col("comp") != F.col("comp_b"))
    pair = [F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")]
    links = labels = None
    left = opened = groups.withColumn("comp", F.col("id"))
    for step in range(STAR_ROUNDS + 1):
        if step < STAR_ROUNDS:
            centre = left.groupBy("sig").agg((F.min if step == 0 else F.max)("comp").alias("comp"))
            centre = left.join(centre, ["sig", "comp"]).groupBy("sig").agg(F.min(F.struct("id", "size", "comp")).alias("c"))
            tried = left.join(centre, "sig").select("id", "size", "comp", F.col("c.id").alias("id_b"), F.col("c.size").alias("size_b"), F.col("c.comp").alias("comp_b"))
        else:
            tried = pairs_left(left, rows, common, fits)
        new = checked(tried.where(fits).select(*pair).distinct(), sketches, rows)
        if new.limit(1).count():
            links = new if links is None else table(links.unionByName(new), "near-links")
            labels = components(links)
            left = left.drop("comp").join(labels, "id", "left").select("sig", "id", "size", F.coalesce("comp", "id").alias("comp"))
        spread = left.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        was, left = opened, table(left.join(spread, "sig", "left_semi"), "near-open")
        discard(was)
        opened = left
        if not left.limit(1).count():
            break
    return spark.createDataFrame([], "id bigint, comp bigint") if labels is None else labels


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are what stands between white space, with A-Z in lower case; the set of a document is its distinct five-word shingles,
    or all its words as one if there are fewer. Null or empty text has an empty set and links with nothing. component_id is the
    least doc_id reachable by links. Rows that repeat an id are reported each; rows without id link with nothing and have
    component_id null. Texts of any length are read whole. Other columns are ignored.
    """
    rows = id_text(docs)
    found = table(rows.mapInArrow(tidied(_summaries), "doc_id bigint, n_shingles bigint, digest binary, poor boolean, sketch binary"), "near-sizes")
    filled = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = table(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    named = table(filled.join(classes, "digest"), "near-named")
    labels = near_links(rows, named)
    linked_rows = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    alone = found.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone)


def op6_near_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(x) AS x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), two_way AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS doc_id, b AS other FROM two_way UNION SELECT r.doc_id, t.b FROM reach r JOIN two_way t ON t.a = r.other
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
