"""The n-gram join, the Merkle manifest and the phrases against brute force, with odd rows."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from measurelake.llm import collocations as phrases
from measurelake.llm import jaccard_join as join
from measurelake.llm import linking, marks, merkle, near_dedup
from measurelake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, item long, label long"


def plain(rows):
    return sorted(rows, key=str)


# -- links -----------------------------------------------------------------------


def shingles(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def linked_by_brute_force(rows, words, percent):
    sets = defaultdict(set)
    for number, text in rows:
        if number is not None:
            sets[number].add(shingles(text, words))
    parent = {n: n for n in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return plain((n, len(s := shingles(t, words)), root(n) if n is not None and s else n) for n, t in rows)


def changed(text, times, rng):
    words = text.split(" ")
    for _ in range(times):
        kind, at = rng.random(), rng.randrange(len(words))
        if kind < 0.4:
            words[at] = f"z{rng.randint(0, 9999)}"
        elif kind < 0.7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"y{rng.randint(0, 9999)}")
    return " ".join(words)


def texts(seed):
    """Families of near copies of all sizes, one large, chains of subsets, and odd texts."""
    rng = random.Random(seed)

    def prose(n):
        return " ".join(f"w{rng.randrange(300)}" for _ in range(n))

    out = [None, "", "  ", "a", "a b", "a b c", "A b c", "a b c d"]
    for _ in range(40):
        base = prose(rng.choice([5, 8, 12, 14, 18, 22, 25, 30, 35, 45, 60, 120, 300, 900]))
        out += [base] + [changed(base, rng.choice([1, 1, 1, 2, 3]), rng) for _ in range(rng.choice([0, 1, 2, 6]))]
    base, short, chain = prose(200), prose(15), prose(60).split()
    out += [changed(base, rng.choice([0, 1, 2, 3, 5, 8]), rng) for _ in range(90)]
    out += [changed(short, 1, rng) for _ in range(40)] + [short, short + " tail", "long " * 20_000]
    out += [" ".join(chain[:k]) for k in range(40, 61)]
    rng.shuffle(out)
    rows = list(enumerate(out))
    return [*rows, *rows[:10], (None, base), (None, base), (5, base), (5, "q r s t u v"), (900, "q r s t u v")]


@pytest.fixture(scope="module")
def rows():
    return texts(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(n, t, "en", "s", 1, 2, 3, 4) for n, t in rows], SCHEMA)


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, value in {"SHORT": 3, "BLOCK": 8, "WHOLE": 10, "SET_BLOCK": 6}.items():
        monkeypatch.setattr(linking, name, value)


def joined(docs):
    return plain(tuple(r) for r in join.jaccard_classes(docs).collect())


def test_jaccard_classes(docs, rows):
    assert joined(docs) == linked_by_brute_force(rows, 3, 90)


def test_jaccard_classes_in_small_blocks_and_heavy_only(docs, rows, small_blocks, monkeypatch):
    monkeypatch.setattr(join, "MOST_LIGHT", 0)
    assert joined(docs) == linked_by_brute_force(rows, 3, 90)


def test_near_duplicates_in_small_blocks(docs, rows, small_blocks):
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert plain(tuple(r) for r in got) == linked_by_brute_force(rows, 5, 75)


def test_no_documents(docs):
    assert join.jaccard_classes(docs.where("false")).count() == 0


def test_sizes_and_shares():
    for percent in (60, 75, 90):
        for n in range(1, 40):
            by_size = dict(join.partners(n, percent))
            for m in range(1, 80):
                fits = [o for o in range(min(n, m) + 1) if 100 * o >= percent * (n + m - o)]
                if not fits or (n == m and fits == [n]):
                    assert m not in by_size
                else:
                    assert by_size[m] == n - fits[0]
    # The prefix is bound to hold a shared element.
    assert [join.prefix(n, 90) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]


def test_subset_keys_meet_exactly_if_a_subset_is_shared():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 24, dtype=np.uint64)
    for n, m, shared in ((20, 20, 19), (20, 20, 18), (20, 18, 18), (21, 20, 20), (21, 20, 19)):
        a = np.sort(base[:n])
        b = np.sort(np.concatenate([base[:shared], rng.integers(0, 2**63, m - shared, dtype=np.uint64)]))
        out_a, out_b = dict(join.partners(n, 90)).get(m), dict(join.partners(m, 90)).get(n)
        met = set(zip(*[k.tolist() for k in join.subset_keys(a, m, out_a)], strict=True)) & set(
            zip(*[k.tolist() for k in join.subset_keys(b, n, out_b)], strict=True))
        assert bool(met) == (shared >= join.least_shared(n, m, 90))


def test_the_boundary_follows_costs():
    sizes = {n: 100 for n in range(1, 49)}
    assert join.boundary(sizes, 1.0, 90) < join.boundary(sizes, 1e3, 90) <= join.boundary(sizes, 1e6, 90) <= 49
    assert join.boundary({}, 5.0, 90) >= 1


def test_parity_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    kind = join.Parities(90, 80)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, max(1, n // 10))) :], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12)), dtype=np.uint64)])
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        sketches, sizes = [join.parity_sketch(a), join.parity_sketch(b)], np.array([len(a), len(b)])
        near = kind.compared(sketches, sizes)(0)[1]
        assert near == kind.pairs(sketches[:1], sketches[1:], sizes.sum(keepdims=True), np.array([False]))[0]
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert near


def test_edges_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(linking, "WHOLE", 40)
    monkeypatch.setattr(linking, "SHORT", 4)
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    found = {}
    real = linking.components

    def counted(name):
        def run(edges, *args):
            edges = linking.settle(edges, "counted")
            found.setdefault(name, []).append(edges.count())
            return real(edges, *args)

        return run

    monkeypatch.setattr(linking, "components", counted("groups"))
    monkeypatch.setattr(near_dedup, "components", counted("links"))
    for n in (200, 400):
        rows = [(i, changed(base, 1 + i % 6, rng)) for i in range(n)]
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == n
        # A pair for each key, pivots included, is the most that a document adds.
        assert found["groups"][-1] <= 64 * n
    assert found["links"][1] <= 2.6 * found["links"][0]


def test_lists_of_the_same_items_are_dealt_out_once(spark, monkeypatch):
    class Firsts(linking.Sketches):
        """Sketches that are near if their first bytes are equal."""

        def compared(self, data, sizes):
            return lambda i: np.array([d[0] == data[i][0] for d in data])

        def pairs(self, a, b, sizes, relaxed):
            return np.array([x[0] == y[0] for x, y in zip(a, b, strict=True)], bool)

    dealt, real = [], linking.dealt

    def counted(*args):
        dealt.append(linking.settle(real(*args), "counted"))
        return dealt[-1]

    monkeypatch.setattr(linking, "dealt", counted)
    # Forty lists of fifty copies and five others, of which two are near each other; one list of nine pairs.
    kinds = {i: b"a" for i in range(50)} | {50: b"b", 51: b"c", 52: b"d", 53: b"e", 54: b"e"}
    kinds |= {i: b"%c" % (100 + i % 9) for i in range(60, 78)}
    lists = [(k, i, 10) for k in range(40) for i in range(55) if i != k] + [(99, i, 10) for i in range(60, 78)]
    lists = linking.settle(spark.createDataFrame(lists, "k long, item long, size long"), "lists")
    payload = linking.settle(spark.createDataFrame(
        [(i, 10, bytearray(x)) for i, x in kinds.items()], "item long, size long, data binary"), "payload")
    got = {r.node: r.component for r in linking.candidate_groups(lists, payload, Firsts(), 75).collect()}
    assert got == {i: 0 for i in range(50)} | {53: 53, 54: 53} | {i: 60 + (i - 60) % 9 for i in range(60, 78)}
    assert dealt[0].count() <= 3 * len(kinds)  # not once for each of the lists


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    want = {i: 0 for i in range(500)} | {i: 1000 for i in range(1000, 1041)}
    assert {r.node: r.component for r in got.collect()} == want


def test_marks_have_all_items_and_few_others(spark):
    items = spark.range(5000).select(F.col("id").alias("n"))

    def hashed(numbers):
        return marks.mix(numbers.astype(np.uint64) + np.uint64(1))

    found = marks.broadcast_marks(items, lambda rows: hashed(rows.column("n").to_numpy()), 5000).value
    assert found.has(hashed(np.arange(5000))).all()
    assert found.has(hashed(np.arange(10_000, 60_000))).mean() < 0.1
    none = marks.broadcast_marks(items.where("false"), lambda rows: hashed(rows.column("n").to_numpy()), 0).value
    assert not none.has(hashed(np.arange(100))).any()


# -- trees -----------------------------------------------------------------------


def joined_hash(parts):
    return sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proofs_by_brute_force(rows):
    """rows of (doc_id, text, lang, source, n_chars)"""
    def leaf(r, text):
        return joined_hash(told(v) for v in (r[0], r[3], r[2], r[4], text))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([joined_hash(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i - i % 3 : i - i % 3 + 3]
            out.append((i % 3, [x for j, x in enumerate(run) if j != i % 3]))
            i //= 3
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf_ for _, _, leaf_, _ in sorted(groups[s], key=lambda t: t[:3])]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda t: t[:3])):
            steps = path(trees[k], i) + path(top, k)
            folded = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                folded = leaf(r, r[1].replace("\n", ""))
            for place, others in steps:
                folded = joined_hash([*others[:place], folded, *others[place:]])
            out.append((r[0], h, trees[k][-1][0], top[-1][0], joined_hash(x for _, o in steps for x in o),
                        folded, folded == top[-1][0]))
    return plain(out)


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(900)]), rng.choice([None, "", "a\nb", "x y", f"t{rng.random()}\nü"]),
             rng.choice(["en", None]), rng.choice(["s1", "s1", "s1", None, "", "ü", "z", f"q{rng.randint(0, 60)}"]),
             rng.choice([None, 3, -4])) for _ in range(700)]
    return [*rows, *rows[:30], (12345, "long\n" * 50_000, "en", "s1", 9)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_proofs(spark, leaves, height, tmp_path):
    docs = spark.createDataFrame([(*r, 2, 3, 4) for r in leaves], SCHEMA)
    manifest = merkle.build(docs, kept={"claim": merkle.tampered(docs)}, height=height, folder=str(tmp_path))
    want = proofs_by_brute_force(leaves)
    assert plain(tuple(r) for r in merkle.proofs(manifest, "claim").collect()) == want
    stored = merkle.read(spark, str(tmp_path))
    assert plain(tuple(r) for r in merkle.proofs(stored, "claim").collect()) == want
    assert all(r.verified for r in merkle.proofs(stored).collect())


def test_order_of_rows_does_not_change_the_roots(spark, leaves):
    rows = [(*r, 2, 3, 4) for r in leaves]
    roots = {merkle.proofs(merkle.build(spark.createDataFrame(some, SCHEMA).repartition(n))).first().root
             for some, n in ((rows, 1), (rows[::-1], 3))}
    assert len(roots) == 1


def test_one_leaf_and_none(spark, leaves):
    docs = spark.createDataFrame([(*leaves[0], 2, 3, 4)], SCHEMA)
    row = merkle.proofs(merkle.build(docs)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == joined_hash([])
    assert merkle.proofs(merkle.build(docs.where("false"))).count() == 0


def test_places_are_a_van_emde_boas_order():
    for levels in range(1, 8):
        places = [merkle.address(d, np.arange(3**d), levels) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
        top = levels // 2
        if top:  # the upper half lies together, and so does each subtree below it
            assert max(p.max() for p in places[:top]) == merkle.tree_size(top) - 1
            size = merkle.tree_size(levels - top)
            for d in range(top, levels):
                subtree = np.arange(3**d) // 3 ** (d - top)
                assert ((places[d] - merkle.tree_size(top)) // size == subtree).all()


# -- phrases ---------------------------------------------------------------------


def phrases_by_brute_force(rows, least, limit, percent=80):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                   if j - i < len(p) and 100 * a >= percent * f[p[i:j]]}
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                     for k in range(1, len(p)))
                found.append((-score, -a, b" ".join(p), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
                for i, (s, a, p, l, r) in enumerate(sorted(found)[:limit])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    fixed = ["New York city hall", "as well as", "ÉTÉ été été", "don't\tdo", "of the", "the of the"]
    out = [(None, None), (None, ""), ("en", "a b a b a b " * 30), (None, "x\x85y x\x85y " * 30), ("de", " .,;\n\r\x0b")]
    for lang in ("en", "de", None):
        for _ in range(70):
            words = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(60)]
            out.append((lang, "".join(w + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n"]) for w in words)))
    return [*out, *out[10:14]]


@pytest.mark.parametrize("least, limit", [(30, 2000), (5, 20), (3, 150), (10, 3)])
def test_collocations(spark, spoken, least, limit):
    docs = spark.createDataFrame([(1, t, lang, "s", 1, 2, 3, 4) for lang, t in spoken], SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, limit=limit).collect())
    assert got == phrases_by_brute_force(spoken, least, limit) and got


def test_collocations_widen_the_frontier_until_enough_survive(spark, spoken, monkeypatch):
    reached = []
    real = phrases._thresholds

    def counted(langs, pairs, reach):
        reached.append(reach)
        return real(langs, pairs, 2 if len(reached) == 1 else reach)

    monkeypatch.setattr(phrases, "_thresholds", counted)
    docs = spark.createDataFrame([(1, t, lang, "s", 1, 2, 3, 4) for lang, t in spoken], SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=3, limit=60).collect())
    assert got == phrases_by_brute_force(spoken, 3, 60) and len(reached) > 1


def test_collocations_of_nothing(spark, spoken):
    docs = spark.createDataFrame([(1, None, "en", "s", 1, 2, 3, 4)], SCHEMA)
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.where("false")).count() == 0


def test_words_that_share_a_hash_are_told_apart(spark, spoken, monkeypatch):
    seeds = []
    real = phrases._vocabulary

    def clashing(base, seed):
        seeds.append(seed)
        words = real(base, seed)
        return words.withColumn("h", F.lit(5).cast("long")) if seed == 0 else words

    monkeypatch.setattr(phrases, "_vocabulary", clashing)
    docs = spark.createDataFrame([(1, t, lang, "s", 1, 2, 3, 4) for lang, t in spoken], SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=10, limit=30).collect())
    assert got == phrases_by_brute_force(spoken, 10, 30) and seeds == [0, 1]


class Everything:
    """Lets all phrases through."""

    class value:
        has = staticmethod(lambda hashes: np.ones(len(hashes), bool))


def run_of_task(monkeypatch, make):
    """What ``make`` has tasks do with their batches."""
    held = []

    def caught(df, run, schema):
        held.append(run)
        raise InterruptedError

    monkeypatch.setattr(phrases, "run_arrow", caught)
    with pytest.raises(InterruptedError):
        make()
    return held[0]


def batches_of(rows, size):
    for start in range(0, len(rows), size):
        langs, texts = zip(*rows[start : start + size], strict=True)
        yield pa.record_batch({"lang": pa.array(langs, pa.string()), "text": pa.array(texts, pa.string())})


@pytest.mark.parametrize("bounds", [
    {}, {"_TOKENS": 300, "_PLACES": 64}, {"_TOKENS": 300, "_SUMS": 200}, {"_TOKENS": 500, "_SUMS": 2000, "_WORDS": 40},
    {"_ROWS": 3, "_SLICE": 50, "_OUT": 7}])
def test_a_task_sums_phrases_whatever_its_bounds(spoken, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(phrases, name, value, raising=False)
    rows = [("und" if lang is None else lang, text) for lang, text in spoken]
    wide = [("en", " ".join(f"u{(7 * i) % 3001}" for i in range(5000))), ("xx", "")]
    for length in (1, 2, 3, 4):
        want = Counter()
        for lang, text in rows + wide:
            for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
                words = re.findall(rb"[^\x20\x09]+", piece)
                want.update((lang, *(xxhash.xxh64_intdigest(w, 3) for w in words[i : i + length]))
                            for i in range(len(words) - length + 1))
        ways = [[(Everything, 0, 1)]]
        run = run_of_task(monkeypatch, lambda n=length, w=ways: phrases._count(None, n, w, 1, 3))
        got, given = Counter(), 0
        for batch in run(batches_of(rows + wide, 40)):
            for row in batch.to_pylist():
                given += 1
                got[row["lang"], *(row[f"w{i + 1}"] % 2**64 for i in range(length))] += row["n"]
        assert got == want
        if not bounds:
            assert given == len(want)


def test_a_task_counts_in_little_memory_whatever_its_share(monkeypatch):
    rng = np.random.default_rng(5)
    names = np.array([f"w{i}" for i in range(3000)], object)
    rows = [("en", " ".join(names[(rng.pareto(0.7, 1000) * 3).astype(np.int64) % 3000])) for _ in range(3000)]
    run = run_of_task(monkeypatch, lambda: phrases._count(None, 2, [[(Everything, 0, 1), (Everything, 1, 1)]], 30, 0))
    batches = list(batches_of(rows, 1000))
    tracemalloc.start()
    try:
        total = sum(pc.sum(batch.column("n")).as_py() for batch in run(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 3000 * 999
    assert peak < 120e6, peak


def test_components_of_few_edges_are_written_by_few_tasks(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(40)] + [(7, None), (8, 8)]
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    seen = set(shared.glob("least-*"))
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}
    cores = spark.sparkContext.defaultParallelism
    rounds = set(shared.glob("least-*")) - seen
    assert rounds and all(len(list(r.glob("part-*"))) <= cores for r in rounds)
