"""Near copies by MinHash: an inverted join over the coordinates of signatures, then exact confirmation.

A set of shingles has a signature of COORDINATES values, each the least of its features under a hash of its own; two sets of
similarity s agree in a coordinate with probability s. Sets are posted under each value of a coordinate. Pairs that agree in MATCHES
coordinates or more are candidates. With 64 coordinates and 25 matches, sets of similarity 0.8 miss that with a probability of under
1e-11 (the tail of the binomial distribution, below exp(-64 KL(24/64, 0.8))), so that a link is lost in one of 10^11 cases at the very
limit and in fewer above it. Candidates are confirmed on their full sets.

* Lists. A value that one set alone has is no list. The lists of a set are ordered by length, the same way for all.
* Prefix. Sets that agree in MATCHES values share a list among those that are left to each when its MATCHES - 1 longest are taken
  away. Only these short lists are merged; a set with fewer than MATCHES lists is merged nowhere. The long lists are skipped: what
  a pair has in common there is looked up in the two signatures.
* Merging. The sets of a list all meet its most shared set, the one with most lists; the pairs that all lists give are merged and
  each counted once. Then sets are in components, and a list is skipped if it is in one of them; else its sets meet the most
  shared one that is in a component which has led none of the rounds there. After STAR_ROUNDS of them those in different components
  meet each other, in blocks of BLOCK sets: the rows of a list hold what is compared, and only pairs that pass leave the task. So no
  group of copies is compared pair by pair, and no pair of a list is left out.
* Sketches. Besides the count of coordinates that agree, pairs are held against the parities of their features in SKETCH_BITS places:
  linked sets differ in at most a ninth of their sizes' sum, and no more bits than features can differ.

Equal sets are one from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, discard, documents, id_text, partitions, pool, table, tidied
from .graph import components
from .nearjoin import of_ids, shingle_sets
from .suffix import mixed

WORDS = 4
#: In hundredths: the intersection of linked sets against their union.
LEAST = 80
COORDINATES = 64
MATCHES = 25
#: Rounds in which the sets of a list meet one of them before those left meet each other.
STAR_ROUNDS = 3
#: Sets of a list that one task holds against as many others at a time.
BLOCK = 1000
SKETCH_BITS = 2048

_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_OWN = mixed(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1 << 32))

SIGNED = "doc_id bigint, n_shingles bigint, digest binary, coords array<bigint>, brief binary"
MET = "c bigint, i int, j int, block int, node bigint, comp bigint, brief binary"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES values for each set, none of them empty. Values of different coordinates differ."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint64)
    if len(sets):
        features, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
        features, room = features ^ features >> np.uint64(31), np.empty(len(features), dtype=np.uint64)
        for k, factor in enumerate(_FACTORS):
            np.multiply(features, factor, out=room)
            out[:, k] = np.minimum.reduceat(room, starts)
    return mixed(out + _OWN)


def _steps(batch):
    """(ids, sets) of a batch, some bytes at a time."""
    data, offsets = pool(batch.column("text"))
    for i, j in by_bytes(offsets):
        yield batch.column("doc_id").slice(i, j - i), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)


def _digest(features: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(features.tobytes())


def briefs(found: np.ndarray, sets: list[np.ndarray]) -> list[bytes]:
    """What pairs are held against: 16 bits of each coordinate, the parities of the features, the size. Equal coordinates have equal
    bits, so a count of these is never too low."""
    out = []
    for row, features in zip(found.astype("<u2"), sets, strict=True):
        places = (mixed(features + np.uint64(1)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.packbits((np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8))
        out.append(row.tobytes() + odd.tobytes() + len(features).to_bytes(8, "little"))
    return out


class Briefs:
    """The columns of many briefs."""

    def __init__(self, column: pa.Array):
        rows = pool(column)[0].reshape(-1, 2 * COORDINATES + SKETCH_BITS // 8 + 8)
        part = lambda a, b, kind: np.ascontiguousarray(rows[:, a:b]).view(kind)
        ends = (0, 2 * COORDINATES, rows.shape[1] - 8, rows.shape[1])
        self.coords, self.odd, self.size = part(ends[0], ends[1], "<u2"), part(ends[1], ends[2], "<u8"), part(ends[2], ends[3], "<i8")[:, 0]

    def likely(self, mine: np.ndarray, other: Briefs, theirs: np.ndarray) -> np.ndarray:
        """Of the rows `mine` (or one row) and the rows `theirs` of another, those that may link."""
        sizes = self.size[mine], other.size[theirs]
        left = np.flatnonzero(100 * np.minimum(*sizes) >= LEAST * np.maximum(*sizes))
        at = lambda x: x[left] if len(x) > 1 else x
        left = left[(self.coords[at(mine)] == other.coords[theirs[left]]).sum(axis=1) >= MATCHES]
        bits = np.bitwise_count(self.odd[at(mine)] ^ other.odd[theirs[left]]).sum(axis=1, dtype=np.int64)
        return left[(100 - LEAST) * (self.size[at(mine)] + other.size[theirs[left]]) >= (100 + LEAST) * bits]


def _sign(batches):
    """Rows of SIGNED."""
    for batch in batches:
        for ids, sets in _steps(batch):
            full = np.array([len(s) > 0 for s in sets], dtype=bool)
            found = signatures([s for s in sets if len(s)])
            ends = np.concatenate([[0], np.cumsum(full) * COORDINATES])
            short = iter(briefs(found, [s for s in sets if len(s)]))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.reshape(-1).view(np.int64))),
                    pa.array([next(short) if x else b"" for x in full], pa.binary()),
                ],
                names=[c.split(" ")[0] for c in SIGNED.split(", ")],
            )


def _features(batches):
    for batch in batches:
        for _, sets in _steps(batch):
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "features"])


def _likely(batches):
    """Pairs that signatures and sketches let through."""
    for batch in batches:
        every = np.arange(batch.num_rows)
        if len(every):
            yield batch.select(["a", "b"]).take(pa.array(Briefs(batch.column("brief_a")).likely(every, Briefs(batch.column("brief_b")), every)))


def _groups(batches):
    """Tables of the rows of one (c, i, j) each; rows come in that order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in ("c", "i", "j")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in ("c", "i", "j")):
            cuts = np.concatenate([[0], cuts])
        at = 0
        for cut in [*cuts.tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches):
    """Of the rows of MET, the pairs in different components that signatures and sketches let through."""
    for group in _groups(batches):
        group = group.combine_chunks()
        rows, node, comp, block = Briefs(group.column("brief")), *(group.column(c).to_numpy() for c in ("node", "comp", "block"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        found = []
        for x in np.flatnonzero(block == i):
            others = np.flatnonzero((block == j) & (comp != comp[x]) & ((node > node[x]) if i == j else True))
            if len(others):
                others = others[rows.likely(np.array([x]), rows, others)]
                found.append((np.full(len(others), node[x]), node[others]))
        if any(len(a) for a, _ in found):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= LEAST * (len(a) + len(b) - common)


def _confirm(batches):
    for batch in batches:
        hit = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("features_a"), batch.column("features_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))


def _with_ends(pairs: DataFrame, ends: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with `value` of both ends (node, value) as value_a and value_b."""
    for x in "ab":
        pairs = pairs.join(ends.select(F.col("node").alias(x), F.col(value).alias(f"{value}_{x}")), x)
    return pairs.select("a", "b", f"{value}_a", f"{value}_b")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """A table of the pairs (a, b) that may link by signatures and sketches."""
    return table(_with_ends(pairs, classes, "brief").mapInArrow(tidied(_likely), "a bigint, b bigint"), "minhash-pairs")


def likely_in_lists(left: DataFrame, classes: DataFrame) -> DataFrame:
    """The same of all pairs in different components of the lists left (c, node, comp), compared where the rows of a list are. A list of
    more than BLOCK sets is divided, and every two of its blocks meet in a place of their own."""
    blocks = left.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = left.select("c", "node", "comp").join(blocks, "c").join(classes.select("node", "brief"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = rows.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "brief")
    met = met.repartition(partitions(left), "c", "i", "j").sortWithinPartitions("c", "i", "j")
    return table(met.mapInArrow(tidied(_meet), "a bigint, b bigint").distinct(), "minhash-pairs")


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """A table of the pairs (a, b) of a table that link, by their full sets; only the texts of these pairs are read."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = table(classes.join(nodes, "node").select("node", "digest", F.col("least").alias("doc_id")), "minhash-nodes")
    sets = of_ids(rows, named.select("doc_id").distinct()).mapInArrow(tidied(_features), "digest binary, features binary").dropDuplicates(["digest"])
    sets = table(named.join(sets, "digest").select("node", "features"), "minhash-sets")
    found = table(_with_ends(pairs, sets, "features").mapInArrow(tidied(_confirm), "a bigint, b bigint"), "minhash-links")
    discard(pairs, named, sets)
    return found


def postings(classes: DataFrame) -> DataFrame:
    """(c, node, size, n_lists): the sets of each list that is to be merged."""
    values = classes.select("node", F.col("n_shingles").alias("size"), F.explode("coords").alias("c"))
    lists = values.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of_node = Window.partitionBy("node")
    ranked = values.join(lists, "c").withColumn("rank", F.row_number().over(of_node.orderBy(F.desc("n"), F.desc("c")))).withColumn("n_lists", F.count(F.lit(1)).over(of_node))
    return table(ranked.where(F.col("rank") >= MATCHES).select("c", "node", "size", "n_lists"), "minhash-postings")


def linked_nodes(classes: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(id, comp) of the classes that link with another, or None; classes: node, least, digest, n_shingles, coords, brief."""
    fits = (100 * F.least("size", "size_b") >= LEAST * F.greatest("size", "size_b")) & (F.col("comp") != F.col("comp_b"))
    pair = [F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")]
    posted = postings(classes)
    opened, links, labels = posted, None, None
    left = posted.withColumn("comp", F.col("node")).withColumn("led", F.lit(False))
    for step in range(STAR_ROUNDS + 1):
        if step < STAR_ROUNDS:
            centre = left.groupBy("c").agg(F.max(F.struct((~F.col("led")).alias("fresh"), "n_lists", "node", "size", "comp")).alias("m"))
            left = left.join(centre.select("c", F.col("m.node").alias("node_b"), F.col("m.size").alias("size_b"), F.col("m.comp").alias("comp_b")), "c")
            new = likely(left.where(fits).select(*pair).distinct(), classes)
        else:
            new = likely_in_lists(left, classes)
        new = confirmed(new, classes, rows)
        if new.limit(1).count():
            links = new if links is None else table(links.unionByName(new), "minhash-links")
            labels = components(links)
        if step == STAR_ROUNDS:
            break
        if labels is not None:
            left = left.drop("comp", "comp_b").join(labels.withColumnRenamed("id", "node"), "node", "left").join(labels.select(F.col("id").alias("node_b"), F.col("comp").alias("comp_b")), "node_b", "left")
            left = left.withColumns({"comp": F.coalesce("comp", "node"), "comp_b": F.coalesce("comp_b", "node_b")})
        left = left.select("c", "node", "size", "n_lists", "comp", (F.col("led") | (F.col("comp") == F.col("comp_b"))).alias("led"))
        spread = left.groupBy("c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("c")
        left = table(left.join(spread, "c", "left_semi"), "minhash-open")
        discard(opened)
        opened = left
        if not left.limit(1).count():
            break
    discard(opened)
    return labels


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are what stands between white space, with A-Z in lower case; the set of a document is its distinct four-word shingles, or
    all its words as one if there are fewer. Null or empty text has an empty set and links with nothing. Sets link if the
    intersection is 80 hundredths of the union or more. component_id is the least doc_id reachable by links; the document that
    has it is kept. Rows that repeat an id are reported each, those with the component's id as kept; rows without id link with
    nothing, have component_id null and are kept. Texts of any length are read whole. Other columns are ignored. An empty table
    gives no rows.
    """
    rows = id_text(docs)
    signed = table(rows.mapInArrow(tidied(_sign), SIGNED), "minhash-signed")
    filled = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    per = signed.where(filled).groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("coords").alias("coords"), F.first("brief").alias("brief"))
    classes = table(per.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    labels = linked_nodes(classes, rows)
    groups = classes.select("digest", "node", "least")
    if labels is None:
        groups = groups.withColumn("component_id", F.col("least"))
    else:
        groups = groups.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        first = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
        groups = groups.join(first, "comp")
    inside = signed.where(filled).join(groups.select("digest", "component_id"), "digest").select("doc_id", "n_shingles", "component_id")
    alone = signed.where(~filled).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return inside.unionByName(alone).withColumn("kept", kept)


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(x) AS x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), two_way AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS doc_id, b AS other FROM two_way UNION SELECT r.doc_id, t.b FROM reach r JOIN two_way t ON t.a = r.other
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
