"""Removal of repeated byte strings by a suffix sort of hash-compared suffixes.

A string of `length` bytes is repeated if it also starts earlier (smaller doc_id, or same document and earlier start). To find
all of them without sorting every suffix of the corpus:

1. Each window of `length` bytes has an anchor: the leftmost of its `SEED`-byte strings with the least hash. Equal windows have
   equal anchors at equal places, so a window can only be repeated if its anchor's seed occurs elsewhere. An anchor owns a run of
   windows, whose bytes are its context.
2. Contexts that are equal from end to end are reduced to the earliest; the others are repeated whole. Those of one step of a task
   are compared byte by byte; the first of each goes on with a 128-bit cryptographic digest (BLAKE2b) of its bytes, by which they
   are compared between tasks. The earliest one of a context goes on only if its seed has other contexts.
3. Those contexts are cut out of the texts and sorted seed by seed: their windows are suffixes, compared through prefix
   polynomial hashes, with a binary search for the common extension, in a merge sort that keeps the earlier of equals in front;
   equal neighbours are compared byte by byte. All but the first of equal windows are repeated.
4. The windows of a seed with very many distinct contexts are dealt to several such sorts: by the place of the seed in the window,
   a few places each, and by the bytes that all windows with these places have in common, so that equal windows stay together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, documents, free_name, id_text, partitions, pool, table, text_steps, tidied

LENGTH = 100
SEED = 32
#: Distinct contexts of a seed beyond which its windows are dealt to several sorts, and the places of the seed that share one.
SORTED_CONTEXTS, PLACES = 2_000, 8
#: Bytes of text that are hashed at a time.
STEP_BYTES = 2 << 20

#: The odd base of the polynomial hashes.
BASE = 0x9E3779B97F4A7C15
_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2**64 to the powers 0 to n - 1; kept until `forget_powers`."""
    if BASE not in _powers_of or len(_powers_of[BASE][0]) < n:
        made = []
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(max(n, STEP_BYTES // 4), x, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers_of[BASE] = tuple(made)
    up, down = _powers_of[BASE]
    return up[:n], down[:n]


def forget_powers() -> None:
    """At the end of a task, so that idle workers hold nothing."""
    _powers_of.clear()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64, each byte times the base to its place."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.add(data, np.uint64(1), out=out[1:], dtype=np.uint64)
    out[1:] *= up[1:]
    np.cumsum(out[1:], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def substring_hashes(prefixes: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hashes of the strings of `size` from `start`, the same wherever they stand."""
    _, down = _powers(len(prefixes))
    return (prefixes[start + size] - prefixes[start]) * down[start]


def window_hashes(prefixes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size`, mixed."""
    _, down = _powers(len(prefixes))
    out = prefixes[size:] - prefixes[:-size]
    out *= down[: len(out)]
    return mixed(out)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in data: text number, place of each anchor, and the first and last window that it owns (places in data)."""
    none = (np.zeros(0, dtype=np.int64),) * 4
    n = len(data)
    if n < length:
        return none
    hashes = window_hashes(prefix_hashes(data), seed)
    keyed = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    del hashes
    width, least, span = length - seed + 1, keyed, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    owner = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(owner)), side="right") - 1
    inside = np.arange(len(owner)) + length <= offsets[text + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    change = np.flatnonzero(np.concatenate([[True], (owner[at][1:] != owner[at][:-1]) | (np.diff(at) != 1) | (text[at][1:] != text[at][:-1])]))
    last = np.concatenate([change[1:] - 1, [len(at) - 1]])
    return text[at[change]], owner[at[change]], at[change], at[last]


ANCHOR = "seed bigint, digest bigint, more bigint, doc_id bigint, packed bigint"


def _text_parts(offsets: np.ndarray, length: int):
    """(first row, places of the texts' starts and of the last one's end, bytes before it in its text) of parts of bounded size;
    a long text comes in parts that overlap by length - 1 bytes."""
    for i, j in by_bytes(offsets, STEP_BYTES):
        if offsets[j] - offsets[i] <= 2 * STEP_BYTES or j - i > 1:
            yield i, offsets[i : j + 1], 0
        else:
            for at in range(0, int(offsets[j] - offsets[i]) - length + 1, STEP_BYTES):
                yield i, offsets[i] + np.array([at, min(at + STEP_BYTES + length - 1, offsets[j] - offsets[i])]), at


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of `size` from a and from b are equal, byte by byte."""
    out, span = np.ones(len(a), dtype=bool), np.arange(size.max(initial=0))
    for k in range(0, len(a), 1 << 14):
        x, y, n = a[k : k + (1 << 14), None], b[k : k + (1 << 14), None], size[k : k + (1 << 14), None]
        inside = np.minimum(span, n - 1)
        out[k : k + (1 << 14)] = (data[x + inside] == data[y + inside]).all(axis=1)
    return out


def _anchor_rows(length: int, seed: int):
    """Anchors of all windows. A context that stands earlier in the same step too needs no comparison: it has no digest, and
    instead of its seed a number that spreads such rows over the tasks, so a passage that very many texts share burdens none."""

    def part_rows(part: np.ndarray, ends: np.ndarray, skipped: int, names_of):
        text, at, first, last = anchors(part, ends, length, seed)
        if not len(at):
            return None
        prefixes = prefix_hashes(part)
        seeds = mixed(substring_hashes(prefixes, at, seed)).view(np.int64)
        lead, size = at - first, last - first + length
        marks = mixed(substring_hashes(prefixes, first, size) + lead.astype(np.uint64))
        packed = (first - ends[text] + skipped) << 16 | lead << 8 | (last - first)
        names = names_of(text)
        order = np.lexsort((packed, names, marks, seeds))
        seeds, marks, names, packed, first, lead, size = (x[order] for x in (seeds, marks, names, packed, first, lead, size))
        known = np.concatenate([[False], (seeds[1:] == seeds[:-1]) & (marks[1:] == marks[:-1]) & (size[1:] == size[:-1]) & (lead[1:] == lead[:-1])])
        again = np.flatnonzero(known)
        known[again] = same_bytes(part, first[again - 1], first[again], size[again])
        fresh, raw = np.flatnonzero(~known), part.tobytes()
        digests = b"".join([hashlib.blake2b(raw[a : a + n], digest_size=16, salt=salt).digest() for a, n, salt in zip(first[fresh].tolist(), size[fresh].tolist(), [bytes([x]) for x in lead[fresh].tolist()], strict=True)])
        both = np.zeros((len(known), 2), dtype=np.int64)
        both[fresh] = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
        seeds[known] = mixed(names[known].view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(both[:, 0], mask=known), pa.array(both[:, 1], mask=known), pa.array(names), pa.array(packed)], names=["seed", "digest", "more", "doc_id", "packed"])

    def run(batches):
        for batch in batches:
            data, offsets = pool(batch.column("text"))
            ids = batch.column("doc_id")
            for i, ends, skipped in _text_parts(offsets, length):
                found = part_rows(data[ends[0] : ends[-1]], ends - ends[0], skipped, lambda text: ids.take(pa.array(i + text)).to_numpy())  # noqa: B023
                if found is not None:
                    yield found
        forget_powers()

    return run


PLACE = "seed bigint, doc_id bigint, packed bigint"


def _resolve(batches):
    """Anchors in order of seed, digest, place. Rows without seed: contexts that stand earlier too. Rows with seed: the earliest
    of each context, if its seed has others."""
    last = None  # seed and digest of the row before
    waiting = None  # seed, doc_id, packed and relatedness of the last earliest one
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column("digest").is_null()
        if batch.column("digest").null_count:
            done = batch.filter(known)
            yield pa.RecordBatch.from_arrays([pa.nulls(done.num_rows, pa.int64()), done.column("doc_id"), done.column("packed")], names=["seed", "doc_id", "packed"])
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
        seed, digest, more, doc, packed = (batch.column(c).to_numpy() for c in ("seed", "digest", "more", "doc_id", "packed"))
        same_seed = np.concatenate([[last is not None and seed[0] == last[0]], seed[1:] == seed[:-1]])
        same = same_seed & np.concatenate([[last is not None and (digest[0], more[0]) == last[1:]], (digest[1:] == digest[:-1]) & (more[1:] == more[:-1])])
        last = seed[-1], digest[-1], more[-1]
        head = np.flatnonzero(~same)
        h_seed, h_doc, h_packed, h_tied = seed[head], doc[head], packed[head], same_seed[head]
        if waiting is not None:
            h_seed, h_doc, h_packed, h_tied = (np.concatenate([[w], h]) for w, h in zip(waiting, (h_seed, h_doc, h_packed, h_tied), strict=True))
        if len(h_seed):
            waiting = (h_seed[-1], h_doc[-1], h_packed[-1], h_tied[-1])
            go = np.flatnonzero(h_tied[:-1] | (h_seed[:-1] == h_seed[1:]))
            if len(go):
                yield pa.RecordBatch.from_arrays([pa.array(h_seed[go]), pa.array(h_doc[go]), pa.array(h_packed[go])], names=["seed", "doc_id", "packed"])
        if same.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(same.sum()), pa.int64()), pa.array(doc[same]), pa.array(packed[same])], names=["seed", "doc_id", "packed"])
    if waiting is not None and waiting[3]:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in waiting[:3]], names=["seed", "doc_id", "packed"])


def lcp(prefixes: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common extension of the suffixes from a and b, up to `most` bytes, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = substring_hashes(prefixes, a, middle) == substring_hashes(prefixes, b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def before(data: np.ndarray, prefixes: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffix from a sorts strictly before that from b, by their first `length` bytes."""
    common = lcp(prefixes, a, b, length)
    differ = common < length
    out = np.zeros(len(a), dtype=bool)
    out[differ] = data[a[differ] + common[differ]] < data[b[differ] + common[differ]]
    return out


def merge_sort(data: np.ndarray, prefixes: np.ndarray, suffixes: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes, stable, inside each group (equal numbers stand together and ascend).

    Bottom up: runs of a group are merged pairwise, all pairs at once; an element's place is its place in its own run plus the
    number of elements of the other run that go before it, found by binary search.
    """
    n = len(suffixes)
    order = np.arange(n)
    if n < 2:
        return order
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    which = np.repeat(np.arange(len(starts)), sizes)
    base, size, within = starts[which], sizes[which], np.arange(n) - starts[which]
    width = 1
    while width < sizes.max():
        pair = within // (2 * width) * (2 * width)
        is_right = within - pair >= width
        low = base + np.where(is_right, pair, np.minimum(pair + width, size))
        high = base + np.where(is_right, pair + width, np.minimum(pair + 2 * width, size))
        other_start = low.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            mine, theirs = suffixes[order[active]], suffixes[order[middle]]
            right = is_right[active]
            # a left element goes before equal right ones; so a right one counts equal left ones as before it
            ahead = np.where(right, ~before(data, prefixes, mine, theirs, length), before(data, prefixes, theirs, mine, length))
            low[active] = np.where(ahead, middle + 1, low[active])
            high[active] = np.where(ahead, high[active], middle)
            active = active[low[active] < high[active]]
        own = within - pair - np.where(is_right, width, 0)
        place = base + pair + own + (low - other_start)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def repeated(data: np.ndarray, prefixes: np.ndarray, suffixes: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes agree in `length` bytes with one that stands before them in their group."""
    order = merge_sort(data, prefixes, suffixes, group, length)
    out = np.zeros(len(suffixes), dtype=bool)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (substring_hashes(prefixes, suffixes[a], length) == substring_hashes(prefixes, suffixes[b], length)))
    span = np.arange(length)
    for k in range(0, len(near), 1 << 16):
        part = near[k : k + (1 << 16)]
        same = (data[suffixes[a[part], None] + span] == data[suffixes[b[part], None] + span]).all(axis=1)
        if not same.all():  # different strings with one hash: decide all by their bytes
            seen: set = set()
            for i in range(len(suffixes)):
                name = (int(group[i]), data[suffixes[i] : suffixes[i] + length].tobytes())
                out[i] = name in seen
                seen.add(name)
            return out
        out[b[part]] = True
    return out


CONTEXT = "seed bigint, doc_id bigint, first bigint, n int, lead int, context binary"


def _contexts(length: int, seed: int, sorted_contexts: int):
    """Rows of (text, its places) to a row for each place with its bytes; for a seed with many contexts, to a row for each few
    places of the seed in a window, and instead of the seed a number that stands for those places and the bytes they share."""

    def rows_of(doc_id, raw: bytes, p: dict):
        first, lead, last = p["packed"] >> 16, p["packed"] >> 8 & 255, p["packed"] & 255
        if p["k"] <= sorted_contexts:
            yield p["seed"], doc_id, first, last + 1, lead, raw[first : first + last + length]
            return
        for low in range((lead - last) // PLACES * PLACES, lead + 1, PLACES):
            # windows lead - high to lead - low have the seed at places low to high; all of them hold the bytes `shared`
            high = low + PLACES - 1
            a, b = max(0, lead - high), min(last, lead - low)
            shared = raw[max(0, first + lead - low) : first + lead - high + length]
            group = xxhash.xxh3_64_intdigest(shared, seed=low + 1) ^ p["seed"] & (1 << 64) - 1
            yield group - (1 << 64 if group >> 63 else 0), doc_id, first + a, b - a + 1, lead - a, raw[first + a : first + b + length]

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                rows = []
                for doc_id, text, places in zip(step.column("doc_id").to_pylist(), step.column("text"), step.column("places").to_pylist(), strict=True):
                    raw = text.as_py().encode()
                    rows += [r for p in places for r in rows_of(doc_id, raw, p)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["seed", "doc_id", "first", "n", "lead", "context"])

    return run


SPAN = "doc_id bigint, start bigint, stop bigint"


def _sorted_windows(length: int):
    """Contexts of whole seeds, seed after seed and earliest first, to spans of repeated windows."""

    def spans(rows: list[tuple]):
        """rows: (seed, doc_id, first, n, lead, context)"""
        data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[5]) for r in rows], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        n = np.array([r[3] for r in rows], dtype=np.int64)
        lead = np.array([r[4] for r in rows], dtype=np.int64)
        seeds = np.unique([r[0] for r in rows], return_inverse=True)[1]
        row = np.repeat(np.arange(len(rows)), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        suffix = base[row] + window
        group = seeds[row] * 256 + (lead[row] - window)
        by_group = np.argsort(group, kind="stable")
        prefixes = prefix_hashes(data)
        hit = np.zeros(len(row), dtype=bool)
        hit[by_group] = repeated(data, prefixes, suffix[by_group], group[by_group], length)
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (row[at][1:] != row[at][:-1])]))
        ends = np.concatenate([cut[1:] - 1, [len(at) - 1]])
        r, lo, hi = row[at[cut]], window[at[cut]], window[at[ends]]
        first = np.array([x[2] for x in rows], dtype=np.int64)[r]
        ids = pa.array([x[1] for x in rows], pa.int64()).take(pa.array(r))
        return pa.RecordBatch.from_arrays([ids, pa.array(first + lo), pa.array(first + hi + length)], names=["doc_id", "start", "stop"])

    def run(batches):
        held, seed, mark, size = [], None, 0, 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("seed", "doc_id", "first", "n", "lead", "context")), strict=True):
                if r[0] != seed:
                    if size > 1 << 20:
                        if (out := spans(held)) is not None:
                            yield out
                        held, size = [], 0
                    seed = r[0]
                held.append(r)
                size += len(r[5])
        if held and (out := spans(held)) is not None:
            yield out
        forget_powers()

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, sorted_contexts: int = SORTED_CONTEXTS) -> DataFrame:
    """(doc_id, start, stop) of repeated byte strings, overlapping each other; docs: doc_id and text, ids distinct, no nulls."""
    n = partitions(docs)
    found = docs.mapInArrow(tidied(_anchor_rows(length, seed)), ANCHOR).repartition(n, "seed")
    places = table(found.sortWithinPartitions("seed", "digest", "more", "doc_id", "packed").mapInArrow(tidied(_resolve), PLACE), "suffix-places")
    first, more = F.shiftright("packed", 16), F.col("packed").bitwiseAND(255)
    whole = places.where(F.col("seed").isNull()).select("doc_id", first.alias("start"), (first + more + length).alias("stop"))

    heads = places.where(F.col("seed").isNotNull())
    counted = heads.join(heads.groupBy("seed").agg(F.count(F.lit(1)).alias("k")), "seed")
    of_doc = counted.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "packed", "k")).alias("places"))
    contexts = docs.join(of_doc, "doc_id").mapInArrow(tidied(_contexts(length, seed, sorted_contexts)), CONTEXT).repartition(n, "seed")
    return whole.unionByName(contexts.sortWithinPartitions("seed", "doc_id", "first").mapInArrow(tidied(_sorted_windows(length)), SPAN))


def _merge_spans(batches):
    for batch in batches:
        starts, stops = [], []
        for one in batch.column("spans").to_pylist():
            lo, hi = [], []
            for start, stop in sorted((x["start"], x["stop"]) for x in one):
                if hi and start <= hi[-1]:
                    hi[-1] = max(hi[-1], stop)
                else:
                    lo.append(start)
                    hi.append(stop)
            starts.append(lo)
            stops.append(hi)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], names=["doc_id", "starts", "stops"])


def merged_spans(spans: DataFrame) -> DataFrame:
    """doc_id and its maximal covered runs, as arrays `starts` and `stops`, in order."""
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return grouped.mapInArrow(tidied(_merge_spans), "doc_id bigint, starts array<bigint>, stops array<bigint>")


def kept_pieces(raw: bytes, starts: list[int], stops: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True))


def _digest_rows(batches):
    for batch in batches:
        out = []
        for doc_id, text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts", "stops")), strict=True):
            raw = text.encode()
            kept = kept_pieces(raw, starts or [], stops or [])
            out.append((doc_id, len(raw), len(raw) - len(kept), len(starts or []), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte goes if a string of `length` bytes over it also starts earlier; matches do not cross documents. Null text counts as
    empty; shorter texts lose nothing. Texts of any length are treated whole. Rows that repeat an id and its text are one document
    and reported each; different texts of one id are documents of their own, in the order of their SHA-256. Rows without id lose
    nothing and nothing is lost to them. An empty table gives no rows. Other columns are ignored.
    """
    rows, searched = keyed(id_text(docs))
    spans = merged_spans(repeated_spans(searched, length)).withColumnRenamed("doc_id", "key")
    return rows.join(spans, "key", "left").mapInArrow(tidied(_digest_rows), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def whole_characters(raw: bytes, starts: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    """The runs without the characters that they hold only in part; runs that hold none are gone."""
    lo, hi = [], []
    for a, b in zip(starts, stops, strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            lo.append(a)
            hi.append(b)
    return lo, hi


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with what is repeated cut out of text, in whole characters, and n_chars, if docs has it, set anew where
    something was. Documents of which nothing is left are gone. Null text stays as it is. Ids are as in `suffix_dedup`; other
    columns may have any names and are as they were."""
    key, cut = (free_name(docs.columns, n) for n in ("key", "runs"))
    rows, searched = keyed(docs.withColumn("text", F.coalesce("text", F.lit(""))) if docs.schema["text"].nullable else docs, key)
    spans = merged_spans(repeated_spans(searched, length)).select(F.col("doc_id").alias(key), F.struct("starts", "stops").alias(cut))
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), []
            counts = batch.column("n_chars").to_pylist() if "n_chars" in schema.names else None
            for k, runs in enumerate(batch.column(cut).to_pylist()):
                if runs and texts[k]:
                    texts[k] = kept_pieces(texts[k].encode(), *whole_characters(texts[k].encode(), runs["starts"], runs["stops"])).decode()
                    if counts:
                        counts[k] = len(texts[k])
                keep.append(not runs or bool(texts[k]))
            new = {"text": pa.array(texts, pa.string())}
            if counts is not None:
                new["n_chars"] = pa.array(counts, batch.column("n_chars").type)
            out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in schema.names], names=schema.names)
            yield out.filter(pa.array(keep, pa.bool_()))

    names = [F.col(f"`{c}`") for c in (*schema.names, cut)]
    return rows.join(spans, key, "left").select(*names).mapInArrow(tidied(run), schema)


def keyed(rows: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text and others) with a column `key`, a name that they do not have, and doc_id and text of the documents that are
    searched, by key, ascending in doc_id. The key is the id unless some id is repeated; rows without id have none."""
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    if not ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        with_key = rows.withColumn(key, F.col("doc_id").cast("long"))
        return with_key, with_key.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text")
    mark = free_name([*rows.columns, key], "mark")
    marked = rows.withColumn(mark, F.sha2("text", 256))
    own = marked.where(F.col("doc_id").isNotNull()).select("doc_id", mark, "text").dropDuplicates(["doc_id", mark])
    own = own.repartitionByRange(partitions(rows), "doc_id", mark).sortWithinPartitions("doc_id", mark)
    own = table(own.withColumn(key, F.monotonically_increasing_id()), "suffix-keys")
    with_key = marked.join(own.select("doc_id", mark, key), ["doc_id", mark], "left").select(*(F.col(f"`{c}`") for c in (*rows.columns, key)))
    return with_key, own.select(F.col(key).alias("doc_id"), "text")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), c AS (  -- blocks of 1000 starts, with the bytes of their windows
  SELECT doc_id, n, j AS base, substr(h, 2 * j + 1, 2198) AS block FROM (SELECT *, unnest(range(0, greatest(n - 99, 0), 1000)) AS j FROM d)
), w AS (
  SELECT doc_id, base + i AS start, md5(substr(block, 2 * i + 1, 200)) AS mark FROM (SELECT *, unnest(range(0, least(1000, n - 99 - base))) AS i FROM c)
), again AS (
  SELECT doc_id, start FROM w QUALIFY row_number() OVER (PARTITION BY mark ORDER BY doc_id, start) > 1
), edge AS (
  SELECT doc_id, start, start > lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 100 AS opens FROM again
), run AS (
  SELECT doc_id, min(start) AS lo, max(start) + 100 AS hi
  FROM (SELECT *, sum(coalesce(opens, true)::INT) OVER (PARTITION BY doc_id ORDER BY start) AS number FROM edge) GROUP BY doc_id, number
), gap AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS free FROM run
), cut AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * free + 1, 2 * (lo - free)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
