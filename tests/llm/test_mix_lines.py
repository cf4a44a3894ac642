import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulgrid.llm.line_dedup import duplicate_lines, edit_within, near_lines, without_lines
from haulgrid.llm.mixing import mix_sources, targets

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, size int, key string, line int, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None, 1, "k", 2, "h") for i, t, s in rows], SCHEMA)


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, spare = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    open_ = set(names)
    while spare > 1e-9 and open_:
        total, over = sum(w[s] for s in open_), 0.0
        for s in open_:
            out[s] += spare * w[s] / total
        for s in list(open_):
            if out[s] >= cap * sizes[s]:
                over += out[s] - cap * sizes[s]
                out[s] = float(cap * sizes[s])
                open_.discard(s)
        spare = over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {rnd.choice(["a", "B", "é", "🙂", "z"]) + str(k): int(rnd.expovariate(0.001)) for k in range(rnd.randint(1, 12))}
    if seed % 2:
        sizes |= {None: 40, "zero": 0}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in got)


def test_mix_against_a_plain_version(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))) + rnd.choice(["", " #*", "\t\n"]), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    rows += [(700, None, "a"), (None, "null id words", "b"), (701, "twin twin", "c"), (701, "twin twin", "c"), (702, "", "empty only")]
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max([r.size for r in own]) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in own)
        k = {r.copies for r in own if r.size}
        assert len(k) <= 2 and (not k or max(k) - min(k) <= 1)
    again = mix_sources(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(frame(spark, [])).count() == 0


def test_quality_raises_the_chance(spark):
    rows = [(i, "word " * 20 + ("#" * 60 if i % 2 else ""), "ab"[i % 4 // 2]) for i in range(2000)]
    got = [r for r in mix_sources(frame(spark, rows)).collect() if r.source == "a"]
    clean, junk = [sum(r.copies for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert clean > 1.5 * junk > 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, s, n):
    for _ in range(n):
        k = rnd.randrange(len(s))
        s = rnd.choice([s[:k] + rnd.choice("abé") + s[k:], s[:k] + s[k + 1:], s[:k] + rnd.choice("ab🙂") + s[k + 1:]])
    return s


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_bit_parallel_distance(spark, t):
    rnd = random.Random(t)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(5, 90)))
        b = edited(rnd, a, rnd.randint(0, t + 2))
        if abs(len(a) - len(b)) <= t:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edit_within("a", "b", t).alias("near"))
    for r in df.collect():
        assert r.near == (lev(r.a, r.b) <= t), (r.a, r.b)


@pytest.mark.parametrize("t", [1, 2])
def test_edit_join_against_all_pairs(spark, t):
    rnd = random.Random(10 + t)
    lines = set()
    for _ in range(40):
        s = "".join(rnd.choice("ab c") for _ in range(rnd.randint(12, 30)))
        lines |= {s, *(edited(rnd, s, rnd.randint(1, t + 1)) for _ in range(4))}
    lines = sorted(x for x in lines if len(x) >= 10)
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and lev(a, b) <= t}
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line")
    got = [frozenset((r.a, r.b)) for r in near_lines(df, t, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def brute_drops(rows, t=1, least=20):
    spots = sorted((i is None, i or 0, p, line) for i, text, _ in rows for p, line in enumerate((text or "").split("\n")) if len(line) >= least)
    first = {}
    for null, i, p, line in spots:
        first.setdefault(line, (null, i, p))
    near = {b for a in first for b in first if first[a] < first[b] and abs(len(a) - len(b)) <= t and lev(a, b) <= t}
    out = defaultdict(set)
    for null, i, p, line in spots:
        if (null, i, p) != first[line] or line in near:
            out[None if null else i].add(p)
    return {i: sorted(v) for i, v in out.items()}


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(15, 40))) for _ in range(25)]
    rows = [(i, "\n".join(edited(rnd, rnd.choice(pool), rnd.choice([0, 0, 1, 2])) for _ in range(rnd.randint(0, 6))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n\n", "s"), (None, pool[0] + "\nonly here, with a null id", "s"), (103, "x" * 5000 + "\n" + "x" * 4999, "s")]
    rows += [(104, "a twin row with one line\nshort", "s")] * 2
    docs = frame(spark, rows)
    drops = duplicate_lines(docs)
    got = drops.collect()
    want = brute_drops(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.dropped == want.get(r.doc_id, []) and r.n_dropped == len(r.dropped)
    left = {(r.doc_id, r.text) for r in without_lines(docs, drops).collect()}
    for i, text, _ in rows:
        rest = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in want.get(i, [])) if text is not None else None
        stays = not want.get(i) or bool(rest.strip()) or not text.strip()
        assert ((i, rest) in left) == stays
    assert duplicate_lines(frame(spark, [])).count() == 0


def one_word(a, b, least):
    a, b = a.split(" "), b.split(" ")
    return a != b and min(len(a), len(b)) >= least and lev(a, b) <= 1


@pytest.mark.parametrize("t", [1, 2])
def test_edit_join_with_words_against_all_pairs(spark, t):
    rnd = random.Random(20 + t)
    vocabulary = ["über", "a", "", "longer🙂word", "some", "other", "words", "x" * 30]
    lines = {"x" * 40, "x" * 39, "no blanks at all", "no blanks atall"}
    for _ in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 14))]
        lines.add(" ".join(words))
        for _ in range(4):
            k, new = rnd.randrange(len(words)), rnd.choice(vocabulary)
            lines.add(" ".join(rnd.choice([words[:k] + [new] + words[k + 1:], words[:k] + words[k + 1:], words[:k] + [new] + words[k:]])))
            lines.add(edited(rnd, " ".join(words), rnd.randint(1, t + 1)))
            at = rnd.randrange(len(" ".join(words)))
            lines.add(" ".join(words)[:at] + " " + " ".join(words)[at:])
    lines = sorted(x for x in lines if len(x) >= 10)
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and (lev(a, b) <= t or one_word(a, b, 6))}
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line")
    got = [frozenset((r.a, r.b)) for r in near_lines(df, t, 10, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_a_changed_word_of_a_long_line_is_a_near_copy(spark):
    line = "the quick brown fox jumps over the lazy dog while all the others are asleep"
    docs = frame(spark, [(1, line, "s"), (2, line.replace("asleep", "wandering"), "s"), (3, line.replace("quick ", ""), "s"), (4, line.replace("quick", "sly").replace("dog", "hen"), "s")])
    assert {r.doc_id: r.n_dropped for r in duplicate_lines(docs, least_words=8).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_equal_short_lines_are_folded_and_near_ones_stay(spark):
    docs = frame(spark, [(1, "Home\n\nabc\n \nHome", "s"), (2, "\nHome\nabd\n \nabc", "s")])
    drops = duplicate_lines(docs, least_words=8, fold_short=True)
    assert {r.doc_id: r.dropped for r in drops.collect()} == {1: [4], 2: [1, 4]}
    assert {r.n_dropped for r in duplicate_lines(docs).collect()} == {0}


def later_lines(lines, t, least, least_words=None):
    """Of lines in order of place: those that have an earlier like one."""
    alike = lambda a, b: abs(len(a) - len(b)) <= t and lev(a, b) <= t or least_words and one_word(a, b, least_words)
    long = [x for x in dict.fromkeys(lines) if len(x) >= least]
    return {b for k, b in enumerate(long) if any(alike(a, b) for a in long[:k])}


@pytest.mark.parametrize("bound", [1, 3, 32])
def test_crowded_groups_drop_the_same_lines(spark, bound):
    """With a bound of 1 every pair comes from classes, none from the plain join."""
    rnd = random.Random(30)
    vocabulary = ["über", "a", "", "longer🙂word", "some", "other", "ab", "a b", "axb"]
    lines = []
    for _ in range(14):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 7, 8, 9, 12, 20, 40]))]
        for _ in range(9):
            own, k, new = list(words), rnd.randrange(len(words)), rnd.choice(vocabulary)
            for _ in range(rnd.randint(0, 2)):
                own = rnd.choice([own[:k] + [new] + own[k + 1:], own[:k] + own[k + 1:], own[:k] + [new] + own[k:], own])
            line = " ".join(own)
            if line and rnd.random() < 0.7:
                line = edited(rnd, line, rnd.randint(0, 1))
                at = rnd.randrange(len(line)) if line else 0
                line = rnd.choice([line, line[:at] + " " + line[at:], line[:at] + " " + line[at + 1:], line.replace(" ", "", 1), line.replace(" ", "x", 1)])
            lines.append(line)
    rnd.shuffle(lines)
    docs = frame(spark, [(i, "\n".join(lines[8 * i:8 * i + 8]), "s") for i in range(len(lines) // 8 + 1)])
    got = {(r.doc_id, p) for r in duplicate_lines(docs, 1, 10, least_words=6, pair_bound=bound).collect() for p in r.dropped}
    later, seen, want = later_lines(lines, 1, 10, 6), set(), set()
    for k, x in enumerate(lines):
        if len(x) >= 10 and (x in seen or x in later):
            want.add((k // 8, k % 8))
        seen.add(x)
    assert got == want and len(later) > 30


def test_thousands_of_lines_that_differ_in_one_place(spark):
    """One class of lines: pairs grow with the lines (here also in single characters), not with their square."""
    same = "the same words stand in all of these lines but for one of them"
    lines = [f"{same} number {k} and then they all end alike" for k in range(5000)]
    far = [f"{same} number {k} {k} and then they all end alike {k}" for k in range(50)]
    df = spark.createDataFrame([(x,) for x in lines + far], "line string")
    got = near_lines(df, 1, 20, 8).collect()
    assert 4999 <= len(got) < 10 * 5000
    docs = frame(spark, [(k, x, "s") for k, x in enumerate(lines + far)])
    assert {r.doc_id: r.n_dropped for r in duplicate_lines(docs, least_words=8).collect()} == {k: int(0 < k < 5000) for k in range(5050)}


@pytest.mark.parametrize("bound", [1, 32])
def test_very_long_near_lines(spark, bound):
    words = [f"w{k % 97}" for k in range(30_000)]
    one, two = list(words), list(words)
    one[20_000] = "changed"
    two[100], two[29_000] = "both", "changed"
    docs = frame(spark, [(1, " ".join(words), "s"), (2, " ".join(one), "s"), (3, " ".join(two), "s"), (4, "x" * 90_000, "s"), (5, "x" * 45_000 + "y" + "x" * 45_000, "s")])
    got = {r.doc_id: r.n_dropped for r in duplicate_lines(docs, least_words=8, pair_bound=bound).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
