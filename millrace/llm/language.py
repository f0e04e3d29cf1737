"""Language identification: words first, shorter and shorter character n-grams for words never seen.

The model holds, per language, log frequencies of words and of character n-grams of orders 5 to 1 over words with edge marks, all
of them, of a bounded sample of the labelled rows. It is kept as sorted arrays of 64-bit hashes of the names, with a row of
frequencies each, so it is small enough for every task. A known word scores its log frequency in each language. An unseen word
scores the mean log frequency of its n-grams of the highest order of which at least one is known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, table, text_steps, tidied

#: Rows per language, about, that the model is fitted on: the one bound on what is learned.
SAMPLE_ROWS = 4_000
ORDERS = (5, 4, 3, 2, 1)
#: In place of an order, for whole words; and the least order whose n-grams count as knowing a word when documents are accepted.
WORD, TELLING = 0, 3
UNKNOWN = "und"
#: What a count of nothing is worth.
SMOOTH = 0.5
#: A task forgets the pieces it has scored when it has this many.
KEPT_PIECES = 100_000

LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _hashes(names: list[str]) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.array([one(n) for n in names], dtype=np.uint64)


def _count_words(batches):
    for batch in batches:
        for step in text_steps(batch):
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(step.column("lang").to_pylist(), step.column("text").to_pylist(), strict=True):
                for w in words_of(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            if found:
                langs, words = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])


def _count_names(batches):
    """Words, and their n-grams as often as the words, by hash."""
    for batch in (b.slice(i, 2_000) for b in batches for i in range(0, b.num_rows, 2_000)):
        found: dict[tuple[str, int, str], int] = {}
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            found[lang, WORD, word] = found.get((lang, WORD, word), 0) + n
            for order in ORDERS:
                for g in grams_of(word, order):
                    found[lang, order, g] = found.get((lang, order, g), 0) + n
        if found:
            langs, orders, names = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(orders, pa.int32()), pa.array(_hashes(names).view(np.int64)), pa.array(found.values(), pa.int64())], names=["lang", "ord", "name", "n"])


class Model:
    """vectors(words) is each word's log score in each of `langs`. tables: for WORD and each order the ascending hashes of the known
    names, and a row of log frequencies for each."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    @classmethod
    def named(cls, langs: list[str], words: dict[str, list[float]], grams: dict[int, dict[str, list[float]]]) -> Model:
        tables = {}
        for order, held in {WORD: words, **grams}.items():
            keys = _hashes(list(held))
            by_key = np.argsort(keys)
            tables[order] = keys[by_key], np.array(list(held.values()), dtype=np.float32).reshape(len(keys), len(langs))[by_key]
        return cls(langs, tables)

    def _find(self, order: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the names are known, and the rows of those."""
        keys, rows = self.tables.get(order, (np.zeros(0, dtype=np.uint64),) * 2)
        if not len(keys) or not names:
            return np.zeros(len(names), dtype=bool), np.zeros((0, len(self.langs)))
        asked = _hashes(names)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        known = keys[at] == asked
        return known, rows[at[known]].astype(np.float64)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores, and whether the word or an n-gram of a telling order is known."""
        out, telling = np.zeros((len(words), len(self.langs))), np.zeros(len(words), dtype=bool)
        known, rows = self._find(WORD, words)
        out[known], telling[known] = rows, True
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left):
                break
            grams = [grams_of(words[i], order) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            known, rows = self._find(order, [x for g in grams for x in g])
            n = np.bincount(owner[known], minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner[known], rows)
            some = n > 0
            out[left[some]] = sums[some] / n[some, None]
            telling[left[some]] = order >= TELLING
            left = left[~some]
        return out, telling


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about sample_rows rows of each language (doc_id, text, lang, none null), chosen by the hash of their ids."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {})
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))]), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    words = table(sample.mapInArrow(tidied(_count_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    names = words.mapInArrow(tidied(_count_names), "lang string, ord int, name bigint, n bigint").groupBy("lang", "ord", "name").agg(F.sum("n").alias("n"))
    counted = names.toArrow()
    discard(words)
    langs = sorted(sizes)
    lang = np.searchsorted(langs, counted["lang"].to_numpy(zero_copy_only=False).astype(str)) if counted.num_rows else np.zeros(0, dtype=np.int64)
    orders, keys, n = counted["ord"].to_numpy(), counted["name"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    tables = {}
    for order in (WORD, *ORDERS):
        of = orders == order
        known, row = np.unique(keys[of], return_inverse=True)
        counts = np.zeros((len(known), len(langs)))
        np.add.at(counts, (row, lang[of]), n[of])
        tables[order] = known, np.log((counts + SMOOTH) / (counts.sum(axis=0) + 1.0)).astype(np.float32)
    return Model(langs, tables)


class Scorer:
    """Scores texts; the sums of pieces between spaces are kept in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        """Columns: the log scores, the number of words, and how many of them tell. Row 0: no letter."""
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.model.langs) + 2))

    def _learn(self, pieces: list[str]) -> None:
        cut = [words_of(p) for p in pieces]
        sizes = np.array([len(c) for c in cut])
        vectors, telling = self.model.vectors([w for c in cut for w in c])
        each = np.hstack([vectors, np.ones((len(vectors), 1)), telling[:, None]])
        some = np.flatnonzero(sizes)
        if len(some):
            sums = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
            numbers = np.zeros(len(pieces), dtype=np.int64)
            numbers[some] = len(self.rows) + np.arange(len(some))
            self.rows = np.concatenate([self.rows, sums])
            self.known.update(zip(pieces, numbers.tolist(), strict=True))
        else:
            self.known.update(dict.fromkeys(pieces, 0))

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """For each text its language, the posterior of it among the learned ones, and the share of its words that tell."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if len(self.known) > KEPT_PIECES:
            self._forget()
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = {p for c in cut for p in c if p not in self.known}
        if new:
            self._learn(list(new))
        out, n = [], len(self.model.langs)
        for c in cut:
            total = self.rows[np.fromiter(map(self.known.__getitem__, c), dtype=np.int64, count=len(c))].sum(axis=0)
            if not total[n]:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            odds = np.exp(total[:n] - total[:n].max())
            best = int(odds.argmax())
            out.append((self.model.langs[best], float(odds[best] / odds.sum()), float(total[n + 1] / total[n])))
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (posterior of lang_pred among the learned languages) of every whole text.

    Null text, text without a letter, and any text when nothing was learned give `und` with score 0. Ties go to the first
    language by name. Repeated rows are scored each; a null doc_id is kept as null; an empty table gives no rows. Columns other than
    doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            for step in text_steps(batch):
                found = scorer.score(step.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id bigint, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, telling: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is one that was learned, with a score of at least `least`, and of
    whose words at least the share `telling` is known or has a known n-gram of three characters or more.

    Rows with null text or text without a letter go. Rows are judged one by one: null and repeated ids and clashing column names
    make no difference. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            for step in text_steps(batch):
                found = scorer.score(step.column("text").to_pylist())
                yield step.filter(pa.array([lang != UNKNOWN and score >= least and share >= telling for lang, score, share in found]))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(doc_id="doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame) -> Model:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return fit(rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
