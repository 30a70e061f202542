"""Near-duplicate lines by a segment-partition join on edit distance.

A line is cut into one segment more than the threshold of edits, so a line within
that many edits holds one of its segments unchanged, at a place that differs by
few characters.  Each line is listed under its own segments (by length, number and
text), and looks itself up under the substrings at the places that the segments of
a line of each permitted length can have moved to.  Lines that meet are verified
with a bit-parallel edit distance in a band around the diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import blocked, keyed, map_arrow, map_groups, run_arrow, settle
from measurelake.llm.components import components
from measurelake.llm.files import binary

EDITS = 2  # the threshold
CHARS_AN_EDIT = 6  # of the shorter line, so that short lines may differ by one edit or none
BLOCK = 256  # lines of one side that a task compares at once

_HELD = 100_000  # rows of a key that a task waits with
_TRIM = b" \t\r"


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
    chars_an_edit: int = CHARS_AN_EDIT, key_col: str | None = None,
) -> DataFrame:
    """doc_id, line_no, n_links, class_doc, class_line and kept of every line of every text.

    Lines are the parts between line feeds, compared without blanks, tabs and
    carriage returns around them, numbered from 0; empty ones are left out.
    Lines are linked if equal, or with at most as many insertions, deletions and
    substitutions between them as :func:`allowed`: one for each ``chars_an_edit`` characters of the
    shorter line, up to ``edits``.  A class
    holds what is reachable over links; its first line, by document and number, is
    ``kept``.  ``n_links`` counts the different texts that a line's text is linked
    with, itself not included.

    Null and empty texts have no lines.  Documents with a null id come before all
    others.  Rows repeated with their id have the same lines: of these all, or
    none, are kept, unless ``key_col`` names a key of the rows: each is then a document
    of its own, in order of the keys where ids are equal or null, and the result has
    its ``row_key``.  Other columns are ignored.
    """
    keys = [F.col(key_col).alias("row_key")] if key_col else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, F.col(text_col).alias("text"))
    of = ["doc_id", "row_key"] if key_col else ["doc_id"]
    lines = settle(_lines(base, of), "lines")
    links = settle(_links(base, lines, edits, chars_an_edit), "line_links")
    near = components(links.where("b is not null").select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("n_links"))
    found = near.join(counts, F.col("node") == F.col("a"), "full").select(
        F.coalesce("node", "a").alias("node"), "component", "n_links")
    told = lines.join(found, F.col("h") == F.col("node"), "left").select(
        *of, "line_no", F.coalesce("component", "h").alias("h"),
        # Lines in no link are told apart by a second hash as well.
        F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("h2"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    place = F.struct(*of, "line_no")
    first = told.groupBy("h", "h2").agg(F.min(place).alias("first"))
    return told.join(first, ["h", "h2"]).select(
        *of, "line_no", "n_links", F.col("first.doc_id").alias("class_doc"),
        F.col("first.line_no").alias("class_line"), (place == F.col("first")).alias("kept"),
    )


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_TRIM.decode()))


def _lines(base: DataFrame, of: list[str]) -> DataFrame:
    """(doc_id, line_no, h, h2): two 64-bit hashes of each trimmed line."""
    parts = base.select(*of, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = _trimmed(F.col("line"))
    return parts.where(F.length(line) > 0).select(
        *of, "line_no", F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("h2"))


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones are longer by one."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def places(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings in which a line of ``length`` looks for the
    segments of lines of length ``other`` <= ``length``.

    Up to segment i (from 0) at most i edits lie before it, or at most edits - i behind it.
    """
    more, out = length - other, []
    for i, (start, size) in enumerate(segments(other, edits)):
        low = max(start - i, start + more - (edits - i), 0)
        high = min(start + i, start + more + (edits - i), length - size)
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


def allowed(length: int, edits: int = EDITS, chars: int = CHARS_AN_EDIT) -> int:
    """Edits by which a line may differ from one of this length that is no longer than it."""
    return min(edits, length // chars)


def _plan(length: int, edits: int, chars: int) -> list[tuple[int, int, int, int]]:
    """(seed, start, end, own) of each key of a line: its own segments, and what it looks for."""
    out = []
    for other in range(max(chars, length - edits), length + 1):
        few = allowed(other, edits, chars)
        if length - other > few:
            continue
        own = dict(enumerate(segments(other, few))) if other == length else {}
        for i, start, size in places(length, other, few):
            seed = other * (edits + 1) + i
            out.append((seed, start, start + size, int(own.get(i) == (start, size))))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _keys(rows: pa.Table, edits: int, chars: int) -> pa.RecordBatch:
    """(key, h, own) of the lines of a batch; equal lines once."""
    seen: set[bytes] = set()
    keys: list[int] = []
    hashes: list[int] = []
    owns: list[int] = []
    sizes: list[int] = []
    plans: dict[int, list] = {}
    digest = xxhash.xxh64_intdigest
    for text in binary(rows, "text"):
        for line in (text or b"").split(b"\n"):
            line = line.strip(_TRIM)
            if len(line) < chars or line in seen:
                continue
            seen.add(line)
            part = line if line.isascii() else line.decode("utf-8", "replace")
            n = len(part)
            if n < chars:
                continue
            plan = plans.get(n)
            if plan is None:
                plan = plans[n] = _plan(n, edits, chars)
            if part is line:
                keys += [digest(line[a:b], seed) for seed, a, b, _ in plan]
            else:
                keys += [digest(part[a:b].encode(), seed) for seed, a, b, _ in plan]
            owns += [p[3] for p in plan]
            hashes.append(digest(line, 42))  # what xxhash64 gives
            sizes.append(len(plan))
    h = np.repeat(np.array(hashes, np.uint64).view(np.int64), sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(h),
         pa.array(np.array(owns, bool))], ["key", "h", "own"],
    )


def _links(base: DataFrame, lines: DataFrame, edits: int, chars: int) -> DataFrame:
    """Rows (a, b, null) that connect all linked lines, and rows (a, null, n): links of a line."""
    listed = map_arrow(base.select("text"), lambda rows: _keys(rows, edits, chars),
                       "key long, h long, own boolean")
    sorted_ = listed.repartition("key").sortWithinPartitions("key")
    met = settle(run_arrow(sorted_, _meet, "key long, h long, own boolean"), "meetings")
    sized = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = met.select("h").distinct().withColumnRenamed("h", "_h")
    texts = (
        base.select(F.explode(F.split("text", "\n")).alias("_line"))
        .select(_trimmed(F.col("_line")).alias("line")).withColumn("_of", F.xxhash64("line"))
        .join(wanted, F.col("_of") == F.col("_h"), "left_semi")
        .groupBy("_of").agg(F.min("line").alias("line"))
    )
    members = met.join(sized, "key").join(texts, F.col("h") == F.col("_of"))
    dealt = blocked(members, "h", "n", BLOCK)
    keys = ["key", "block_a", "block_b"]
    return map_groups(
        dealt.select(*keys, "block_own", "h", "own", "line"), keys,
        lambda rows, starts: _verify(rows, starts, edits, chars), "a long, b long, n long",
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the keys under which different lines meet, from rows sorted by key.

    Holds the rows of one key, up to ``_HELD`` of them; of a key with more, rows
    are passed on as they come once two lines have met.
    """
    rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
    going_on = False  # the first key has had more rows than are held
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key, h, own = (np.concatenate(pair) for pair in zip(rest, now, strict=True))
        if not len(key):
            continue
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = int(starts[-1])
        if last:
            yield _different(key[:last], h[:last], own[:last], starts[:-1], going_on)
            going_on = False
        rest = [key[last:], h[last:], own[last:]]
        if len(rest[0]) > _HELD and (going_on or rest[1].min() != rest[1].max()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rest], ["key", "h", "own"])
            rest, going_on = [c[:1] for c in rest], True
        elif len(rest[0]) > _HELD:  # one line again and again
            rest = [rest[0][:1], rest[1][:1], rest[2].any(keepdims=True)]
    if len(rest[0]):
        yield _different(*rest, np.array([0]), going_on)


def _different(
    key: np.ndarray, h: np.ndarray, own: np.ndarray, starts: np.ndarray, keep_first: bool
) -> pa.RecordBatch:
    met = np.minimum.reduceat(h, starts) != np.maximum.reduceat(h, starts)
    met &= np.logical_or.reduceat(own, starts)
    met[0] |= keep_first
    rows = np.repeat(met, np.diff(np.append(starts, len(key))))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[rows]) for c in (key, h, own)], ["key", "h", "own"])


def _verify(rows: pa.Table, starts: np.ndarray, edits: int, chars: int) -> pa.RecordBatch:
    hashes, blocks = rows.column("h").to_pylist(), rows.column("block_own").to_pylist()
    owns, lines = rows.column("own").to_pylist(), rows.column("line").to_pylist()
    keys = rows.column("key").to_pylist()
    crossing = rows.column("block_a").to_numpy() != rows.column("block_b").to_numpy()
    links: list[tuple[int, int]] = []
    counts: dict[int, int] = {}
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        members: dict[int, tuple[str, int]] = {}
        listed = set()
        for i in range(at, end):
            members[hashes[i]] = lines[i], blocks[i]
            if owns[i]:
                listed.add(hashes[i])
        sides = crossing[at]  # pairs within a block are compared elsewhere
        root: dict[int, int] = {}
        for a in listed:
            line, block = members[a]
            few = allowed(len(line), edits, chars)
            for b, (other, other_block) in members.items():
                if a == b or (sides and block == other_block) or len(line) > len(other):
                    continue
                if (len(line) == len(other) and b < a) or not within(line, other, few):
                    continue
                # Pairs that meet under several keys count under the first.
                if _first_key(line, other, edits, chars) == keys[at]:
                    counts[a] = counts.get(a, 0) + 1
                    counts[b] = counts.get(b, 0) + 1
                x, y = _root(root, a), _root(root, b)
                if x != y:
                    root[x] = y
                    links.append((a, b))
    out = [(a, b, None) for a, b in links] + [(a, None, n) for a, n in counts.items()]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])


def _root(root: dict[int, int], node: int) -> int:
    while node in root:
        node = root[node]
    return node


def _first_key(line: str, other: str, edits: int, chars: int = CHARS_AN_EDIT) -> int | None:
    """The first key under which ``other`` looks up ``line`` and finds it."""
    few = allowed(len(line), edits, chars)
    parts = segments(len(line), few)
    for i, start, size in places(len(other), len(line), few):
        own = line[parts[i][0] : parts[i][0] + size]
        if other.startswith(own, start):
            return _signed(xxhash.xxh64_intdigest(own.encode(), len(line) * (edits + 1) + i))
    return None


def within(a: str, b: str, edits: int) -> bool:
    """Whether two strings are at most ``edits`` insertions, deletions and substitutions apart.

    Equal ends are left out.  Then a bit for each diagonal of the band, in a word
    for each number of edits, says whether the diagonal is reached with as many.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    start = _common(a, b)
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    n = len(a)
    if not n or not b:
        return True  # one is inside the other, and lengths differ little
    band = (1 << (2 * edits + 1)) - 1
    reached = [((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]  # deletions only
    for j, letter in enumerate(b):
        same = 0
        first = j - edits
        for d in range(max(0, -first), min(2 * edits + 1, n - first)):
            if a[first + d] == letter:
                same |= 1 << d
        before = reached[0]
        now = before & same
        reached[0] = now
        alive = now
        for e in range(1, edits + 1):
            old = reached[e]
            # a match; else a letter changed, added to a (from the diagonal above), or left out
            now = ((old & same) | before | (before >> 1) | (now << 1)) & band
            before = old
            reached[e] = now
            alive |= now
        if not alive:
            return False
    return bool(reached[edits] >> (n - len(b) + edits) & 1)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that are not the first of their class.

    Documents that lose all their lines are left out; those that had none stay as
    they are.  All columns are kept.  Rows are told apart by keys of their own, so
    ids may be null or equal.
    """
    rows = keyed(docs)
    classes = line_classes(rows, "_row.doc_id", "_row.text", key_col="_key")
    dropped = classes.where("not kept").groupBy("row_key").agg(F.collect_set("line_no").alias("_lines"))
    joined = rows.join(dropped, F.col("_key") == F.col("row_key"), "left")
    left = F.filter(F.split("_row.text", "\n"), lambda line, i: ~F.array_contains("_lines", i))
    out = joined.withColumn(
        "_text", F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n")))
    kept = out.where(F.col("_lines").isNull() | (F.length(_trimmed(F.col("_text"))) > 0))
    return kept.select(*[
        F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c)
        for c in docs.columns
    ])
