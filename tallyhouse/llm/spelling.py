"""Spelling variants with an index of variable-length grams.

Two words are near if one inserted, deleted or replaced code point makes one of the other.

1. Grams of 2 to ``MAX_GRAM`` code points are counted over all words.  The dictionary is pruned by frequency: a gram is
   followed by its longer ones only where ``limit`` words or more go through it; ``limit`` is the least power of two for
   which the dictionary has at most ``DICTIONARY`` entries, so its size does not depend on the input.
2. A word is decomposed into variable grams: at each place the longest gram that the dictionary leads to, unless a gram
   from before covers it.
3. Each word has a bound on how many of its grams one edit anywhere can affect: those whose choice looks at the edited
   place, those behind them, and those that a gram across the edit could cover.  With m grams and a bound of a, a near word
   shares m - a at least, so the lists of the a + 1 rarest grams of both words have a common, unaffected one.
4. Lists are merged by a join.  A gram that more than ``LIST`` words have is listed with what is before it and with what is behind it,
   since the edit leaves one of the two as it is.  Words without a bound, and those of lists that are longer
   than ``LONG_LIST`` even so, are listed by what is left when one code point is deleted, whose lists the alphabet bounds.
5. Candidates are verified by the edit distance.

Nulls, empties and ties: a null or empty text has no words; a null id deletes nothing in :func:`word_counts`; of equally frequent
near words the one that sorts first by code points is the form; repeated rows count as often as they occur.  Texts are read whole.  Further columns,
of whatever name, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import materialised, written

MIN_GRAM, MAX_GRAM = 2, 4
#: Entries of the gram dictionary at most; what more than this many words have is listed with its surroundings.
DICTIONARY = 100_000
LIST = 32
#: Words of one list at most; words of longer ones are listed by deletions.
LONG_LIST = 500
#: Letters of words in :func:`word_counts`.
LETTERS = r"([A-Za-zÀ-ÿ]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, place: Column) -> Column:
    """The word without the code point at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int | None = 31) -> DataFrame:
    """``docs(doc_id, text)`` to (word, n): runs of letters, A-Z lower-cased, and how often they occur.

    Where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses one code point, chosen by the same number.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(1))).alias("run")).where(F.length("run") >= min_length)
    word = F.translate("run", _UPPER, _LOWER)
    if every:
        lowered = runs.select("doc_id", word.alias("run"))
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
        hashed = lowered.select("run", h.alias("h"))
        place = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        runs = hashed.select(F.when(F.col("h") % every == 0, without(F.col("run"), place)).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    else:
        runs = runs.select(word.alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# -- the gram dictionary ----------------------------------------------------------------------


class Grams:
    """The dictionary: grams with their frequencies, which of them are followed, and what ends a gram."""

    def __init__(self, frequency: dict[str, int], limit: int):
        self.frequency, self.limit, self.list = frequency, limit, LIST
        self.ends = {g[k:] for g in frequency if len(g) > MIN_GRAM for k in range(1, len(g) - 1)}

    def decomposed(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's variable grams, in order."""
        return self._walk(word)[0]

    def _walk(self, word: str) -> tuple[list[tuple[int, int]], list[int]]:
        """The grams, and for each place how far the choice of its gram looks."""
        size, frequency, limit = len(word), self.frequency, self.limit
        grams, looks, covered = [], [], 0
        for at in range(size - MIN_GRAM + 1):
            end = look = at + MIN_GRAM
            while frequency.get(word[at:end], 0) >= limit and end - at < MAX_GRAM:
                look = end + 1
                if end == size:
                    break
                end += 1
            looks.append(max(look, end))
            if end > covered:
                grams.append((at, end))
                covered = end
        return grams, looks

    def _reach(self, word: str, at: int) -> int:
        """The furthest end of a gram that comes from before ``at`` and goes on with the word from there."""
        for end in range(min(len(word), at + MAX_GRAM - 1), at + 1, -1):
            if word[at:end] in self.ends:
                return end
        return min(len(word), at + 1)

    def affected(self, word: str) -> tuple[list[tuple[int, int]], int]:
        """The word's grams, and the most of them that one edit can affect."""
        grams, looks = self._walk(word)
        size = len(word)
        earliest = list(range(size + 1))  # the first place whose choice looks at this one
        for at in range(len(looks) - 1, -1, -1):
            for seen in range(at, min(looks[at], size + 1)):
                earliest[seen] = at
        begun, ended = [0] * (size + 1), [0] * (size + 1)  # grams that start before, and that end at or before a place
        k = j = 0
        for at in range(size + 1):
            while k < len(grams) and grams[k][0] < at:
                k += 1
            while j < len(grams) and grams[j][1] <= at:
                j += 1
            begun[at], ended[at] = k, j
        most = 0
        for at in range(size + 1):
            ending = ended[self._reach(word, at)]
            # a code point put in before this place, and an edit of the one before it
            most = max(most, max(begun[at], ending) - begun[earliest[at]])
            if at:
                most = max(most, max(begun[at], ending) - begun[earliest[at - 1]])
        return grams, most

    def keys(self, word: str) -> tuple[list[str], int]:
        """The lists that the word is in, and how many grams a near word shares at least."""
        grams, most = self.affected(word)
        order = sorted((self.frequency.get(word[a:b], 0), word[a:b], a, b) for a, b in grams)
        lists = []
        for many, gram, a, b in order[: most + 1]:
            if many > self.list:
                lists += [f"<{word[:b]}", f">{word[a:]}"]
            else:
                lists.append(f"={gram}")
        return sorted(set(lists)), len(grams) - most


def grams_of(words: list[str], dictionary: int | None = None) -> Grams:
    """The dictionary of a few words, as :func:`gram_dictionary` builds it of many."""
    count = Counter(w[a : a + q] for w in words for q in range(MIN_GRAM, MAX_GRAM + 1) for a in range(len(w) - q + 1))
    parents = Counter(1 << (count[g[:-1]].bit_length() - 1) for g in count if len(g) > MIN_GRAM)
    limit = _limit(parents, dictionary or DICTIONARY)
    return Grams({g: n for g, n in count.items() if len(g) == MIN_GRAM or count[g[:-1]] >= limit}, limit)


def _limit(children: dict[int, int], dictionary: int) -> int:
    """The least power of two such that the grams whose parent is as frequent are at most ``dictionary``."""
    total, limit = 0, 1 << 62
    for power in sorted(children, reverse=True):
        total += children[power]
        if total > dictionary:
            break
        limit = power
    return limit


def gram_dictionary(words: DataFrame, dictionary: int | None = None) -> Grams:
    """``words(word)`` to the pruned dictionary: at most ``dictionary`` grams, and all pairs of letters."""
    places = F.explode(F.sequence(F.lit(1), F.length("word") - MIN_GRAM + 1)).alias("at")
    sized = words.where(F.length("word") >= MIN_GRAM).select("word", places).select(F.substring(F.col("word"), F.col("at"), F.lit(MAX_GRAM)).alias("longest"))
    # grams of one place are beginnings of its longest one, so the longest are counted first
    longest = sized.groupBy("longest").agg(F.count("*").alias("many"))
    every = longest.select(F.explode(F.transform(F.sequence(F.lit(MIN_GRAM), F.length("longest")), lambda q: F.substring(F.col("longest"), F.lit(1), q))).alias("gram"), "many")
    counted = materialised(every.groupBy("gram").agg(F.sum("many").alias("many")))
    parents = counted.select(F.col("gram").alias("parent"), F.col("many").alias("through"))
    longer = counted.where(F.length("gram") > MIN_GRAM).withColumn("parent", F.expr("substring(gram, 1, length(gram) - 1)")).join(parents, "parent")
    longer = materialised(longer.select("gram", "many", F.expr("shiftleft(1L, length(bin(through)) - 1)").alias("power")))
    limit = _limit({r["power"]: r["count"] for r in longer.groupBy("power").count().collect()}, dictionary or DICTIONARY)
    kept = longer.where(F.col("power") >= limit).select("gram", "many").unionByName(counted.where(F.length("gram") == MIN_GRAM))
    return Grams({r["gram"]: r["many"] for r in kept.collect()}, limit)


# -- lists and their merge --------------------------------------------------------------------


def _lister(held):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = held.value
        for frame in frames:
            found = [grams.keys(w) for w in frame["word"]]
            yield pd.DataFrame({"word": frame["word"], "n": frame["n"], "keys": [k for k, _ in found], "shared": [s for _, s in found]})

    return run


def _merged(lists: DataFrame) -> DataFrame:
    """Near pairs (word, n, other, other_n) of ``lists(key, word, n)``, the smaller word first; a pair for each list that it is in."""
    other = lists.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    close = (F.col("word") < F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1)
    return lists.join(other, "key").where(close & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, n)``, each word once, to every near pair (word, n, other, other_n) in both directions."""
    spark = words.sparkSession
    held = spark.sparkContext.broadcast(gram_dictionary(words))  # at most DICTIONARY grams of MAX_GRAM letters, and pairs of letters
    listed = written(words.select("word", "n").mapInPandas(_lister(held), "word string, n long, keys array<string>, shared int"))
    lists = listed.select(F.explode("keys").alias("list"), "word", "n").select(F.xxhash64("list").alias("key"), "word", "n")
    long_ = written(lists.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > LONG_LIST).select("key"))
    unbound = listed.where("shared <= 0").select("word", "n").unionByName(lists.join(long_, "key", "left_semi").select("word", "n")).distinct()
    left = F.concat(F.array("word"), F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: without(F.col("word"), i)))
    deletions = unbound.select(F.explode(F.array_distinct(left)).alias("left"), "word", "n").select(F.xxhash64("left").alias("key"), "word", "n")
    pairs = _merged(lists.join(long_, "key", "left_anti")).unionByName(_merged(deletions)).distinct()
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` to (word, root): each step's words are ten times as frequent, so chains are short."""
    found = materialised(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not found.where("moved").isEmpty():
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = materialised(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return found.select("word", "root")


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """``words(word, n)`` to word, form, root, n, n_near, form_n.

    The form is the most frequent near word, if it is ``times`` as frequent at least; the root is where forms lead to.
    """
    words = written(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    frequent = -F.col("best.less") >= times * F.col("n")
    rows = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
