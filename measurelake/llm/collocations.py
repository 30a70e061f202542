"""Phrases whose words keep together, per language, by best-first branch and bound.

A phrase of 2 to 4 words is scored by its weakest cut: 2,000,000 * a / (l + r), where a,
l and r count the phrase and the two parts.  A phrase is grown word by word.  What
grows out of a prefix p occurs at most f(p) times, and its cut after the first word w
has f(w) on the left and no less than itself on the right, so that

    score <= 2,000,000 * f(p) / (f(w) + f(p))

bounds every phrase below p.  All pairs of frequent words are counted.  Then a
threshold per language says which prefixes are expanded, those with a bound that
reaches it, and which phrases are looked at from the left as well, those that reach
it themselves: a phrase is dropped if one word more, on either side, keeps four
fifths of its occurrences (by induction, any longer phrase that drops it has such a
part).  All phrases that reach the threshold are then known, and which of them
survive.  Where fewer than the number wanted survive, the threshold falls and the
frontier is expanded again; at 0 it holds everything.

Each level is one pass over the texts.  A task numbers the words it meets, counts in
arrays of bounded size, and passes on sums, a row for a phrase unless it meets very
many.  What a pass has to count is told by bitmaps of bounded size; a phrase that they
let through by chance is counted whole and judged like any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import run_arrow, settle
from measurelake.llm.files import binary
from measurelake.llm.marks import broadcast_marks, mix, rows_of

LEAST, LIMIT, KEPT_SHARE = 30, 2000, 80  # occurrences, phrases of a language, percent
NO_LANGUAGE = "und"

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_ONE_END = bytes.maketrans(_PIECE_ENDS, b"." * len(_PIECE_ENDS))
_ROWS = 500  # texts that are taken from a batch at once
_SLICE = 1_000_000  # bytes of texts that are cut into words at once
_TOKENS = 1_000_000  # words that are counted at once
_PLACES = 1 << 18  # places in them that are looked up at once
_WORDS = 700_000  # words that a task keeps numbered
_SUMS = 2_000_000  # phrases that a task keeps sums of
_OUT = 50_000  # rows that are passed on at once
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                     0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``.`` between its pieces."""
    return text.lower().translate(_ONE_END).replace(b".", b" . ").split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Reader:
    """Numbers the words of batches, and gives them out by language when enough are there."""

    def __init__(self, seed: int) -> None:
        self._seed = seed
        self.start_over()

    def start_over(self) -> None:
        """Forget the numbers given so far."""
        self._numbers = _Numbers({b".": 0})
        self._hashes = np.zeros(1, np.uint64)

    def full(self) -> bool:
        return len(self._numbers) > _WORDS

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[np.ndarray]]]:
        """Numbers of words by language, in parts that end with a 0; 0 between pieces."""
        held: dict[str, list[np.ndarray]] = {}
        tokens = 0
        for lang, text in _slices(batches):
            found = words_of(text)
            found.append(b".")
            held.setdefault(lang, []).append(
                np.fromiter(map(self._numbers.__getitem__, found), np.int32, len(found)))
            tokens += len(found)
            if tokens > _TOKENS:
                del text, found
                yield held
                held, tokens = {}, 0
        yield held

    def words(self) -> list[bytes]:
        return list(self._numbers)

    def hashes(self) -> np.ndarray:
        """A hash for each number."""
        known = len(self._hashes)
        if known < len(self._numbers):
            new = islice(self._numbers, known, None)
            digests = np.fromiter((xxhash.xxh64_intdigest(w, self._seed) for w in new), np.uint64,
                                  len(self._numbers) - known)
            self._hashes = np.concatenate([self._hashes, digests])
        return self._hashes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined), of limited size unless one text is larger."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            rows = pa.Table.from_batches([batch.slice(start, _ROWS)])
            held: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), binary(rows, "text"), strict=True):
                held.setdefault(lang, []).append(text or b"")
                sizes[lang] = sizes.get(lang, 0) + len(text or b"")
                if sizes[lang] > _SLICE:
                    yield lang, b" . ".join(held.pop(lang))
                    del sizes[lang]
            for lang, parts in held.items():
                yield lang, b" . ".join(parts)


def _hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """A hash of the phrase that has these word hashes, in a language."""
    total = np.full(len(words[0]), xxhash.xxh64_intdigest(lang) + len(words) & (2**64 - 1), np.uint64)
    for word, factor in zip(words, _FACTORS, strict=False):
        total += word * factor
    return mix(total)


def _columns(length: int) -> list[str]:
    return [f"w{i + 1}" for i in range(length)]


def _marked(phrases: DataFrame, length: int):
    """A broadcast bitmap of phrases (lang, w1, ...)."""
    names = _columns(length)
    rows = settle(phrases.select("lang", *names), "marked")

    def hashes(found: pa.Table) -> np.ndarray:
        langs = np.array(found.column("lang").to_pylist(), object)
        words = [found.column(n).to_numpy().view(np.uint64) for n in names]
        out = np.empty(len(langs), np.uint64)
        for lang in set(langs.tolist()):
            here = langs == lang
            out[here] = _hash(lang, [w[here] for w in words])
        return out

    return broadcast_marks(rows, hashes, rows_of(rows))


#: A way in which a phrase may be wanted: bitmaps that its parts (from, length) have to be in.
_Way = list[tuple[object, int, int]]


def _count(base: DataFrame, length: int, ways: list[_Way], least: int, seed: int) -> DataFrame:
    """(lang, w1, ..., a) of the phrases of ``length`` words that are wanted and frequent."""
    names = _columns(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(seed)
        for lang, found, counts in _sums(
                reader, batches, length, lambda lang, ids: _wanted(ids, reader.hashes(), lang, length, ways)):
            words = [reader.hashes()[c].view(np.int64) for c in found]
            yield pa.record_batch({"lang": pa.array([lang] * len(counts), pa.string()),
                                   **dict(zip(names, words, strict=True)), "n": counts})

    schema = ", ".join(["lang string", *[f"{n} long" for n in names], "n long"])
    # Tasks pass on sums: they are dealt as they are, and not gathered by each task once more.
    dealt = run_arrow(base, run, schema).repartition("lang", *names)
    counted = dealt.groupBy("lang", *names).agg(F.sum("n").alias("a"))
    return settle(counted.where(F.col("a") >= least), f"phrases{length}")


def _wanted(ids: np.ndarray, hashes: np.ndarray, lang: str, length: int, ways: list[_Way]) -> np.ndarray:
    """Where the wanted phrases of a run of words begin."""
    out = [np.empty(0, np.int64)]
    for first in range(0, len(ids) - length + 1, _PLACES):
        here = ids[first : first + _PLACES + length - 1]
        n = len(here) - length + 1
        word = hashes[here]
        parts: dict[int, np.ndarray] = {}
        within = here != 0
        whole = reduce(np.logical_and, [within[i : i + n] for i in range(length)])
        wanted = np.zeros(n, bool)
        for way in ways:
            fits = whole.copy()
            for marks, start, size in way:
                if size not in parts:
                    m = len(here) - size + 1
                    parts[size] = _hash(lang, [word[i : i + m] for i in range(size)])
                at = np.flatnonzero(fits)
                fits[at] = marks.value.has(parts[size][at + start])
            wanted |= fits
        out.append(np.flatnonzero(wanted) + first)
    return np.concatenate(out)


#: Phrases as the numbers of their words by place, and how often each occurs.
_Counted = tuple[list[np.ndarray], np.ndarray]


def _sums(
    reader: _Reader, batches: Iterator[pa.RecordBatch], length: int,
    places: Callable[[str, np.ndarray], np.ndarray],
) -> Iterator[tuple[str, list[np.ndarray], np.ndarray]]:
    """(language, numbers of words by place, counts) of the phrases that begin at ``places``.

    A phrase is given once, unless there are more than a task keeps; a few rows at a time.
    """
    held: dict[str, list[_Counted]] = {}

    def merged() -> int:
        for lang, parts in held.items():
            if len(parts) > 1:
                words = [np.concatenate(column) for column in zip(*[w for w, _ in parts], strict=True)]
                counts = np.concatenate([c for _, c in parts])
                parts[:] = [_grouped(words, counts, reader)]
        return sum(len(counts) for parts in held.values() for _, counts in parts)

    def given() -> Iterator[tuple[str, list[np.ndarray], np.ndarray]]:
        merged()
        while held:
            lang, parts = held.popitem()
            for words, counts in parts:
                for start in range(0, len(counts), _OUT):
                    yield lang, [w[start : start + _OUT] for w in words], counts[start : start + _OUT]

    size = 0
    for run in reader.read(batches):
        while run:
            lang, parts = run.popitem()
            ids = np.concatenate(parts)
            del parts
            at = places(lang, ids)
            words, counts = _grouped([ids[at + i] for i in range(length)], None, reader)
            if len(counts):
                held.setdefault(lang, []).append((words, counts))
                size += len(counts)
        if size > _SUMS:
            size = merged()
            if size > _SUMS // 2:  # merged again and again, they would stay many
                yield from given()
                size = 0
        if reader.full():
            yield from given()
            size = 0
            reader.start_over()
    yield from given()


def _grouped(words: list[np.ndarray], counts: np.ndarray | None, reader: _Reader) -> _Counted:
    """Each phrase once, with the sum of its counts (of 1 each, if none are given)."""
    bits = max(1, (len(reader.hashes()) - 1).bit_length())
    key, used = words[0].astype(np.int64), bits
    for word in words[1:]:  # a phrase in one number, with ranks for its first words where they are too many
        if used + bits > 63:
            ranked, key = np.unique(key, return_inverse=True)
            used = len(ranked).bit_length()
        key = key << bits | word
        used += bits
    if counts is None and len(words) * bits <= 63:  # the words are read back from the number
        key, counts = np.unique(key, return_counts=True)
        last = len(words) - 1
        return [(key >> bits * (last - i) & (1 << bits) - 1).astype(np.int32) for i in range(len(words))], counts
    order = key.argsort(kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if counts is None:
        counts = np.diff(np.append(first, len(key)))
    elif len(first):
        counts = np.add.reduceat(counts[order], first)
    order = order[first]
    return [w[order] for w in words], counts


def _vocabulary(base: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, f) of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(seed)
        for lang, (used,), counts in _sums(reader, batches, 1, lambda lang, ids: np.flatnonzero(ids)):
            words = reader.words()
            yield pa.record_batch({
                "lang": pa.array([lang] * len(used), pa.string()),
                "word": pa.array([words[i] for i in used.tolist()], pa.binary()),
                "h": reader.hashes()[used].view(np.int64), "n": counts})

    counted = run_arrow(base, run, "lang string, word binary, h long, n long")
    return settle(counted.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("f")), "words")


def _clash(words: DataFrame, least: int) -> bool:
    """Whether a frequent word shares its hash with another word of its language."""
    shared = words.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("words"), F.max("f").alias("f"))
    return not shared.where((F.col("words") > 1) & (F.col("f") >= least)).isEmpty()


def _part(table: DataFrame, rows: DataFrame, places: list[int], name: str) -> DataFrame:
    """Adds to ``rows`` how often the words at ``places`` (from 1) occur as a phrase, or null."""
    given = table.select(
        F.col("lang").alias("_lang"), *[F.col(f"w{i + 1}").alias(f"_w{i + 1}") for i in range(len(places))],
        F.col("a").alias(name))
    same = F.col("lang") == F.col("_lang")
    for i, place in enumerate(places):
        same &= F.col(f"w{place}") == F.col(f"_w{i + 1}")
    return rows.join(given, same, "left").drop("_lang", *[f"_w{i + 1}" for i in range(len(places))])


def _ratio(a: Column, total: Column) -> Column:
    # Exact: whole numbers of up to 38 digits.
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000), total)


def _scored(rows: DataFrame, length: int, tables: dict[int, DataFrame]) -> DataFrame:
    """Adds cut (score, k, l, r), the lowest-scoring one of those with both parts known, and
    ``open``, whether a part is unknown."""
    cuts, unknown = [], F.lit(False)
    for k in range(1, length):
        left, right = list(range(1, k + 1)), list(range(k + 1, length + 1))
        rows = _part(tables[len(left)], rows, left, f"l{k}")
        rows = _part(tables[len(right)], rows, right, f"r{k}")
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        known = l.isNotNull() & r.isNotNull()
        score = _ratio(F.col("a"), l + r)
        cuts.append(F.when(known, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
        unknown = unknown | ~known
    bound = _ratio(F.col("a"), F.col("l1") + F.col("a"))
    lowest = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    return rows.select("lang", *_columns(length), "a", lowest.alias("cut"), bound.alias("bound"),
                       unknown.alias("open"))


def _longer(rows: DataFrame, length: int, above: DataFrame) -> DataFrame:
    """Adds ``longer``: the count of the most frequent phrase with one word more around each."""
    names = _columns(length)
    sides = [above.select("lang", *[F.col(f"w{i + 1 + s}").alias(f"w{i + 1}") for i in range(length)], "a")
             for s in (0, 1)]
    most = sides[0].union(sides[1]).groupBy("lang", *names).agg(F.max("a").alias("a"))
    return _part(most, rows, list(range(1, length + 1)), "longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
    limit: int = LIMIT, percent: int = KEPT_SHARE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``limit`` phrases of each language.

    Words are parts between blanks and tabs of the pieces that line ends and ``.,;:!?``
    cut a text into; A-Z count as a-z.  ``n`` counts a language's words.  Candidates
    are phrases of 2 to 4 words of one piece that occur ``least`` times, overlapping
    ones included.  A candidate is left out if it is part of a longer one that occurs at
    least ``percent`` % as often.  Order: score, ``a``, both falling, then the phrase by its bytes.

    Null and empty texts have no words; a null language counts as ``und``.  Ids play no
    part, repeated rows count as often as they are there, and other columns are ignored.
    Very long texts are read whole.  An empty table gives an empty result.
    """
    base = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    seed = 0
    words = _vocabulary(base, seed)
    while _clash(words, least):
        seed += 1
        words = _vocabulary(base, seed)
    totals = settle(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = settle(words.where(F.col("f") >= least).select(
        "lang", "word", F.col("h").alias("w1"), F.col("f").alias("a")), "frequent")
    marks = _marked(frequent, 1)
    pairs = _count(base, 2, [[(marks, 0, 1), (marks, 1, 1)]], least, seed)
    tables = {1: frequent.drop("word"), 2: pairs}
    pairs = settle(_scored(pairs, 2, tables), "pairs")

    reach, found, open_ = 2 * limit, [], totals.select("lang")
    while not open_.isEmpty():
        reached = settle(_thresholds(open_, pairs, reach), "thresholds")
        told = settle(_round(base, pairs, tables, reached, least, percent, seed), "survivors")
        survivors = told.groupBy("lang").agg(F.count(F.lit(1)).alias("survivors"))
        state = settle(
            reached.join(survivors, "lang", "left").select(
                "lang", (F.col("t") == 0) | (F.coalesce("survivors", F.lit(0)) >= limit)), "settled",
        ).toDF("lang", "done")
        found.append(told.join(state.where("done").select("lang"), "lang", "left_semi"))
        open_ = state.where("not done").select("lang")
        reach *= 8
    if not found:
        found = [docs.sparkSession.createDataFrame([], _SURVIVORS)]
    return _named(reduce(DataFrame.union, found), frequent, totals, limit)


_SURVIVORS = "lang string, w1 long, w2 long, w3 long, w4 long, a long, l long, r long, score long"


def _thresholds(langs: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """(lang, t): the score that ``reach`` pairs of a language reach, 0 if it has fewer."""
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc())
    best = pairs.select("lang", "cut").withColumn("_place", F.row_number().over(order)).where(
        F.col("_place") <= reach)
    t = best.groupBy("lang").agg(
        F.when(F.count(F.lit(1)) == reach, F.min("cut.score")).otherwise(0).alias("t"))
    return langs.join(t, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def _round(
    base: DataFrame, pairs: DataFrame, tables: dict[int, DataFrame], reached: DataFrame,
    least: int, percent: int, seed: int,
) -> DataFrame:
    """The surviving phrases that reach their language's threshold, as ``_SURVIVORS``."""
    def at(rows: DataFrame) -> DataFrame:
        return rows.join(reached, "lang")

    two = at(pairs)
    known, grown = _marked(two, 2), _marked(two.where("bound >= t"), 2)
    good = _marked(two.where("cut.score >= t"), 2)
    three = _count(base, 3, [[(grown, 0, 2), (known, 1, 2)], [(good, 1, 2), (known, 0, 2)]], least, seed)
    scored = settle(_scored(three, 3, tables), "triples")
    far = at(scored)
    grown3, good3 = _marked(far.where("bound >= t"), 3), _marked(far.where("cut.score >= t"), 3)
    four = _count(base, 4, [[(grown3, 0, 3)], [(good3, 1, 3)]], least, seed)
    # Parts of a phrase that may reach the threshold, but were in no frontier, are counted by name.
    half = at(_scored(four, 4, {**tables, 3: three})).where("open and bound >= t and cut.score >= t")
    wanted = settle(half.select("lang", *[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, 4)]).distinct(), "parts")
    if not wanted.isEmpty():
        more = _count(base, 3, [[(_marked(wanted, 3), 0, 3)]], least, seed)
        three = settle(three.union(more).distinct(), "phrases3")
        scored = _scored(three, 3, tables)
    last = _scored(four, 4, {**tables, 3: three})

    kept = []
    for length, rows, above in ((2, pairs, three), (3, scored, four), (4, last, None)):
        rows = at(rows).where("not open and cut.score >= t")
        if above is not None:
            rows = _longer(rows, length, above)
            small = F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent
            rows = rows.where(F.col("longer").isNull() | small)
        empty = [F.lit(None).cast("long").alias(f"w{i}") for i in range(length + 1, 5)]
        kept.append(rows.select("lang", *_columns(length), *empty, "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.union, kept)


def _named(found: DataFrame, frequent: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """The first phrases of each language, with their words."""
    score, a = F.col("score").desc(), F.col("a").desc()
    near = found.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(score, a)))
    near = settle(near.where(F.col("_place") <= limit).drop("_place"), "first")
    for i in range(1, 5):
        given = frequent.select(F.col("lang").alias("_lang"), F.col("w1").alias("_h"),
                                F.col("word").cast("string").alias(f"word{i}"))
        near = near.join(given, (F.col("lang") == F.col("_lang")) & (F.col(f"w{i}") == F.col("_h")),
                         "left").drop("_lang", "_h")
    phrase = F.concat_ws(" ", *[f"word{i}" for i in range(1, 5)])
    named = near.withColumn("phrase", phrase).join(totals, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(score, a, "phrase"))
    return named.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
