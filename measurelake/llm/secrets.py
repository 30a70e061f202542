"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is what is assigned to a credential's name, a password within a URL, a
token of parts between dots, or any long run of letters, digits and the signs of
encodings.  The forest sees its length, how its characters change between classes, how
much of it words of the corpus cover, where it stands (source, path-like surroundings)
and the words beside it.  It is trained from labelled findings.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelake.llm.common import hashed_sample, map_arrow, settle
from measurelake.llm.files import binary

SAMPLE_ROWS = 20_000  # labelled findings that the forest is fitted on, at most
#: a dictionary word is at least this share of all words, so there are 100,000 at most
DICTIONARY_SHARE = 1e-5
LONGEST_WORD = 64  # bytes; longer runs of letters are no words
TREES, DEPTH = 40, 8
LEAST_CHARS = 12  # of a run that nothing marks
PLAIN_ENTROPY, PLAIN_COVER = 3.0, 0.6  # unmarked runs below, or covered above, are no secrets
_BUCKETS = 16  # of hashed neighbouring words

# Names to which secrets are assigned, and forms that issuers give their keys.
_NAME = rb"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
_FORMS = (("aws_access_key", re.compile(rb"(?:AKIA|ASIA)[0-9A-Z]{16}")),
          ("hex", re.compile(rb"[0-9a-f]{16,}")),
          ("github_token", re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}")),
          ("stripe_key", re.compile(rb"[rs]k_(?:live|test)_[A-Za-z0-9]{10,}")),
          ("slack_token", re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}")),
          ("google_key", re.compile(rb"AIza[A-Za-z0-9_-]{35}")),
          ("json_web_token", re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")))

#: each kind of candidate, in order of precedence where they overlap; the value is a group
_KINDS = (
    ("named", re.compile(
        rb"(?i:" + _NAME + rb")[\"']?[ \t]*[=:][ \t]*(?:\"([^\"\r\n]{3,})\"|'([^'\r\n]{3,})'|([^\s\"',;<>(){}]{3,}))")),
    ("address", re.compile(rb"://[^\s/:@\"']*:([^\s/@\"']{3,})@")),
    ("dotted", re.compile(rb"([A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)")),
    ("run", re.compile(rb"([A-Za-z0-9+/_\-]{%d,}={0,2})" % LEAST_CHARS)),
)
_WORD = re.compile(rb"[a-z]{3,}")
_NEAR = 48  # bytes looked at on either side

#: identity and size of a finding, then what the forest sees
FEATURES = (
    "length", "n_lower", "n_upper", "n_digits", "n_signs", "n_changes", "entropy", "covered",
    "assigned", "quoted", "in_path", "in_address", "alone", "left_case", "source",
    *(f"beside_{i}" for i in range(_BUCKETS)),
)
_SCHEMA = ("doc_id long, start long, length long, value_crc32 long, shape string, named boolean, "
           "features array<double>")


def common_words(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """The words of ASCII letters that are at least a share of all, over all whole texts, with counts."""
    def count(rows: pa.Table) -> pa.RecordBatch:
        seen: Counter[bytes] = Counter()
        for text in binary(rows, "text"):
            seen.update(_WORD.findall((text or b"").lower()))
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["word", "n"])

    counted = map_arrow(docs.select(F.col(text_col).alias("text")), count, "word string, n long")
    total = settle(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    all_ = total.agg(F.sum("n").alias("all"))  # one row
    return total.crossJoin(F.broadcast(all_)).where(
        (F.col("n") >= F.lit(float(share)) * F.col("all")) & (F.length("word") <= LONGEST_WORD)).select("word", "n")


class Dictionary:
    """Words by which values are covered, and the lengths they have."""

    def __init__(self, words: Iterable[bytes]) -> None:
        self.words = frozenset(words)
        self.sizes = sorted({len(w) for w in self.words}, reverse=True)


def candidates(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a text, in order and apart from each other."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _KINDS:
        found = [(*m.span(m.lastindex), kind) for m in pattern.finditer(text)]
        if not taken:
            taken = found
            continue
        # Both lists are in order; what overlaps an earlier kind is left out.
        kept, at = [], 0
        for span in found:
            while at < len(taken) and taken[at][1] <= span[0]:
                at += 1
            if at == len(taken) or taken[at][0] >= span[1]:
                kept.append(span)
        taken = sorted(taken + kept)
    return taken


def findings(
    docs: DataFrame, dictionary: Dictionary, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Candidates of all whole texts: doc_id, start (in characters), length, and features."""
    def run(rows: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        for number, text, source in zip(rows.column("doc_id").to_pylist(), binary(rows, "text"),
                                        rows.column("source").to_pylist(), strict=True):
            text = text or b""
            chars = last = 0
            for start, end, kind in candidates(text):
                value = text[start:end]
                left, right = text[max(0, start - _NEAR) : start], text[end : end + _NEAR]
                shape = next((name for name, form in _FORMS if form.fullmatch(value)), "other")
                chars += len(text[last:start].decode("utf-8", "replace"))
                last = start
                out.append((number, chars, len(value), zlib.crc32(value), shape, kind in ("named", "address"),
                            describe(value, left, right, source, dictionary)))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.float64())]
        names = ["doc_id", "start", "length", "value_crc32", "shape", "named", "features"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    return map_arrow(base, run, _SCHEMA)


def describe(value: bytes, left: bytes, right: bytes, source: str | None,
             dictionary: Dictionary) -> list[float]:
    """The forest's features of a candidate between what stands left and right of it."""
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    before, after = left[-1:], right[:1]
    beside = [0.0] * _BUCKETS
    for word in (*re.findall(rb"\w+", left.lower())[-2:], *re.findall(rb"\w+", right.lower())[:2]):
        beside[zlib.crc32(word) % _BUCKETS] += 1
    return [
        float(len(value)), kinds.count(0) / len(value), kinds.count(1) / len(value),
        kinds.count(2) / len(value), kinds.count(3) / len(value),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / len(value),
        entropy, coverage(value.lower(), dictionary),
        float(before in (b"=", b":") or left[-2:] in (b"= ", b": ", b'="', b"='") or left[-3:] == b'= "'),
        float(before in (b'"', b"'") and after == before),
        float(b"/" in value or before in (b"/", b".", b"\\")), float(after == b"@" or before == b"@"),
        float(not before.strip() and not after.strip()),
        float(left.strip()[-1:].isupper()), float(zlib.crc32((source or "").encode()) % 8), *beside,
    ]


def _kind(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3


def coverage(value: bytes, dictionary: Dictionary) -> float:
    """Share of the bytes that dictionary words cover, longest word first from the left."""
    at = covered = 0
    while at < len(value):
        for size in dictionary.sizes:
            if value[at : at + size] in dictionary.words and at + size <= len(value):
                covered += size
                at += size
                break
        else:
            at += 1
    return covered / len(value) if value else 0.0


_ENTROPY, _COVERED = FEATURES.index("entropy"), FEATURES.index("covered")


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings with ``is_secret`` (0/1), for corpora without findings labelled by hand.

    Secret: an issuer's form, or marked as one (assigned to a credential's name, or the
    password of a URL) and not covered by words.  Not secret: unmarked, of no such form, and of low entropy or
    covered by words.  All others may be either and stay without a label: hexadecimal
    runs, unmarked runs of high entropy, and words assigned to a name.
    """
    entropy, covered = F.col("features")[_ENTROPY], F.col("features")[_COVERED]
    worded = covered >= PLAIN_COVER
    issued = ~F.col("shape").isin("other", "hex")
    secret = issued | (F.col("named") & ~worded)
    plain = ~F.col("named") & (F.col("shape") == "other") & (worded | (entropy < PLAIN_ENTROPY))
    return found.withColumn("is_secret", F.when(secret, 1).when(plain, 0)).where("is_secret is not null")


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 3
          ) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (features, is_secret); None without both labels.

    At most ``rows`` findings are used, those with the lowest hashes: half of
    either label, so that a rare one is not lost.
    """
    keys = ["doc_id", "start", "value_crc32"]
    parts = [
        hashed_sample(labelled.where(F.col("is_secret") == label), rows // 2, *keys)
        for label in (0, 1)
    ]
    sample = settle(
        parts[0].union(parts[1]).repartition(1).sortWithinPartitions(*keys).select(
            F.col("is_secret").cast("double").alias("label"), "features"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return forest.fit(sample.coalesce(1).withColumn("vector", array_to_vector("features")))


def secret_scan(
    docs: DataFrame, labelled: DataFrame | None = None, share: float = DICTIONARY_SHARE
) -> DataFrame:
    """doc_id, start, length, value_crc32, shape, score and is_secret of every candidate.

    ``labelled`` holds findings with ``is_secret``; without it, :func:`weak_labels`
    of the corpus's own findings.  If only one label occurs, scores are null and
    ``is_secret`` falls back on the weak rule.  The value itself is not returned.
    Null and empty texts have no candidates; candidates of repeated rows and of
    null ids are reported as they are, and very long texts are read whole.  Other columns
    are ignored; an empty table gives an empty result.
    """
    # At most 1 / share words, whatever the corpus.
    known = Dictionary(r["word"].encode() for r in common_words(docs, share=share).collect())
    found = settle(findings(docs, known), "findings")
    model = train(weak_labels(found) if labelled is None else labelled)
    columns = ["doc_id", "start", "length", "value_crc32", "shape"]
    if model is None:
        return found.select(*columns, F.lit(None).cast("double").alias("score"),
                            (F.col("named") | ~F.col("shape").isin("other", "hex")).alias("is_secret"))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*columns, score.alias("score"), (score >= 0.5).alias("is_secret"))
