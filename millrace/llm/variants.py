"""Spelling variants: words of a corpus that one inserted, deleted or replaced character tells apart, and the form each goes back to.

An error in a word is in its first half or in the rest. So a word is looked up in a forward automaton, the first half exactly and the
rest with one error, and, reversed, in a backward one, the second half exactly and what is before it with one error. Both are minimal
acyclic automata whose transitions count the words before them: the sum along a path numbers the words from 0 without gaps (a
perfect hash), and a word found on several ways is dropped by its number. What the backward automaton finds is dropped if the forward
one finds it too, that is, if the first halves are equal.

Words meet in shards by their halves: a word of L characters is looked up among those of L - 1 to L + 1 that begin (end) with the
same half, so it is put into the shards of the two halves that such partners have. A half that very many words have is
divided: its words go to several parts, and those who look there go to all of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, table

#: What is deleted: a character of one in so many occurrences, chosen by the CRC of document and run.
SPOILT = 199
LEAST_POINTS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as the word.
TIMES = 5
#: Words in a shard, about, and the most of one half in a part of it.
SHARD_WORDS = 20_000
HALF_WORDS = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near bigint, best_n bigint, best string"


class Automaton:
    """The minimal acyclic automaton of words in ascending order, without repeats.

    steps[state] has for each character the next state and how many of the words through `state` come before those that go that way.
    """

    def __init__(self, words: list[str]):
        self.steps: list[dict[str, tuple[int, int]] | None] = [None]
        self.final, self._count, self._known = [False], [0], {}
        arcs: list[dict[str, int] | None] = [{}]
        open_path: list[tuple[int, str, int]] = []
        last = ""

        def settle(depth: int) -> None:
            while len(open_path) > depth:
                state, c, child = open_path.pop()
                key = (self.final[child], tuple(arcs[child].items()))
                own = self._known.setdefault(key, child)
                if own == child:
                    self._close(child, arcs[child])
                arcs[child] = None
                arcs[state][c] = own

        for word in words:
            depth = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                depth += 1
            settle(depth)
            state = open_path[-1][2] if open_path else 0
            for c in word[depth:]:
                arcs.append({})
                self.steps.append(None)
                self.final.append(False)
                self._count.append(0)
                open_path.append((state, c, len(arcs) - 1))
                state = len(arcs) - 1
            self.final[state] = True
            last = word
        settle(0)
        self._close(0, arcs[0])
        self.size = len(self._known) + 1
        del self._known

    def _close(self, state: int, arcs: dict[str, int]) -> None:
        before, steps = int(self.final[state]), {}
        for c, child in arcs.items():
            steps[c] = (child, before)
            before += self._count[child]
        self.steps[state], self._count[state] = steps, before

    def __len__(self) -> int:
        return self._count[0]

    def _end(self, state: int, number: int, tail: str) -> int:
        """The number of the word that tail leads to, or -1."""
        steps = self.steps
        for c in tail:
            step = steps[state].get(c)
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def number(self, word: str) -> int:
        """The place of the word in order, or -1 if it is none."""
        return self._end(0, 0, word)

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first `exact` characters of word and differ from it by one error after them."""
        steps, end, found = self.steps, self._end, set()
        state = number = 0
        for c in word[:exact]:
            step = steps[state].get(c)
            if step is None:
                return found
            state = step[0]
            number += step[1]
        for i in range(exact, len(word) + 1):
            here, rest, tail = word[i : i + 1], word[i:], word[i + 1 :]
            if here:
                found.add(end(state, number, tail))
            for c, (child, before) in steps[state].items():
                if c != here:  # another character in place of this one, or before it
                    if here:
                        found.add(end(child, number + before, tail))
                    found.add(end(child, number + before, rest))
            step = steps[state].get(here)
            if step is None:
                break
            state = step[0]
            number += step[1]
        found.discard(-1)
        return found


def counted_words(docs: DataFrame) -> DataFrame:
    """word and n, the number of its occurrences, of the words of at least LEAST_POINTS characters that occur LEAST_COUNT times."""
    text = F.translate("text", UPPER, LOWER)
    runs = id_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_POINTS)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod("h", F.length("run")).cast("int")
    spoilt = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select("run", h.alias("h")).select(F.when(F.pmod("h", F.lit(SPOILT)) == 0, spoilt).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= LEAST_POINTS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def dealt(words: DataFrame) -> DataFrame:
    """Each word where it stands or asks: backward, key, word (reversed if backward), n, half, part (-1 if the half is not divided),
    stands, asks.

    half: the characters of the half that must be equal, key: what they are. Forward halves are the first L // 2 characters of a word
    of L, backward ones the other L - L // 2.
    """
    size = F.length("word")
    own = F.floor(size / 2).cast("int")
    fore = F.array(*(F.struct(F.lit(False).alias("backward"), k.cast("int").alias("half"), (k == own).alias("looks")) for k in (F.floor((size - 1) / 2), F.floor((size + 1) / 2))))
    rest = size - own
    back = F.array(*(F.struct(F.lit(True).alias("backward"), k.cast("int").alias("half"), (k == rest).alias("looks")) for k in (F.floor(size / 2), F.floor(size / 2) + 1)))
    rows = words.select("word", "n", F.inline(F.concat(fore, back)))
    rows = rows.where(2 * F.col("half") + 1 >= LEAST_POINTS)  # halves that no word has are no key
    rows = rows.withColumn("word", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")))
    rows = rows.withColumn("key", F.substr("word", F.lit(1), F.col("half")))
    many = rows.groupBy("backward", "key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HALF_WORDS)
    many = many.select("backward", "key", F.ceil(F.col("held") / HALF_WORDS).cast("int").alias("parts"))
    rows = rows.join(many, ["backward", "key"], "left")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    one = F.array(F.struct(F.lit(-1).alias("part"), F.lit(True).alias("stands"), F.col("looks").alias("asks")))
    places = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (p == part).alias("stands"), F.col("looks").alias("asks")))
    places = F.filter(places, lambda x: x["stands"] | x["asks"])
    return rows.select("backward", "key", "word", "n", "half", F.inline(F.when(F.col("parts").isNull(), one).otherwise(places)))


def _match(found: pa.Table) -> pa.Table:
    """Of the words of a shard that look, those that find some: how many, and the most frequent, the first in order of several."""
    backward = bool(len(found)) and found.column("backward")[0].as_py()
    columns = [found.column(c).to_pylist() for c in ("word", "n", "half", "stands", "asks")]
    count_of = {w: n for w, n, _, stands, _ in zip(*columns, strict=True) if stands}
    words = sorted(count_of)
    automaton = Automaton(words)
    out: list[tuple[str, int, int, str]] = []
    for word, half in {(w, k) for w, _, k, _, asks in zip(*columns, strict=True) if asks}:
        near = [words[i] for i in automaton.near(word, half)]
        if backward:
            other = len(word) - half
            near = [w[::-1] for w in near if w[-other:] != word[-other:]]
        if near:
            n, best = min((-count_of[w[::-1] if backward else w], w) for w in near)
            out.append((word[::-1] if backward else word, len(near), -n, best))
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near (how many words are near), best_n and best (the most frequent of them, ties: the first in order of characters) of
    the words (word, n) that have any near."""
    rows = table(dealt(words), "variant-places")
    shards = max(1, -(-rows.count() // SHARD_WORDS))
    # A part of a divided half is a shard of its own: who looks in several parts meets each word in one of them.
    shard = F.when(F.col("part") < 0, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.xxhash64("key")).alias("shard")
    found = rows.groupBy("backward", "part", shard).applyInArrow(_match, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("low"), "best")).alias("m")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("m.low")).alias("best_n"), F.col("m.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for (word, form): where following forms ends. Each round takes the root of the root, so long ways halve."""
    known = table(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("far"))
        known = table(known.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "variant-roots")
        if not known.where("moved").limit(1).count():
            return known.select("word", "root")
        known = known.select("word", "root")


def variant_groups(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words come from runs of Latin letters in whole texts, A-Z in lower case; one occurrence in SPOILT, by the CRC of document and
    run, loses a character. They have at least LEAST_POINTS characters and LEAST_COUNT occurrences. Two are near if one inserted,
    deleted or replaced character tells them apart. form: the near word that is most frequent (ties: the first in order of
    characters) if it is TIMES as frequent, else null; root: where forms lead. Null text has no words; a null doc_id counts as an
    empty one; repeated rows count each; an empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    words = table(counted_words(docs), "variant-words")
    found = table(words.join(near_words(words), "word", "left"), "variant-near")
    has = F.col("best_n") >= TIMES * F.col("n")
    rows = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(documents(spark, sf_dir))


OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), run AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc
), word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS (
  SELECT less.word AS a, word.word AS b FROM less JOIN word ON word.word = x
  UNION SELECT word.word, less.word FROM less JOIN word ON word.word = x
  UNION SELECT p.word, q.word FROM less p JOIN less q USING (x, i) WHERE p.word <> q.word
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS b_n FROM near JOIN word ON word.word = b GROUP BY a
), form AS (
  SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 5 * n THEN b END AS form, CASE WHEN b_n >= 5 * n THEN b_n END AS form_n FROM word LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root, 0 AS steps FROM form UNION ALL SELECT way.word, form.form, steps + 1 FROM way JOIN form ON form.word = root WHERE form.form IS NOT NULL
), root AS (
  SELECT word, arg_max(root, steps) AS root FROM way GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM form JOIN root USING (word)
"""
