"""Line deduplication by a segment-partition edit join, in SQL functions.

A pair of lines at edit distance t or less shares, when one is cut into t + 1 even segments, at
least one segment at nearly the same place (Li, Deng, Wang, Feng: Pass-Join, 2011). The same holds
for words: of the two halves of a line's words, one stays when a single word changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import drop_path, materialize, texts

#: What a line or text with a word has.
WORDS = r"[^\x20\x09-\x0D]"
#: Stretches into which a line of a crowded group is cut, one of which may differ.
CHUNKS = 16
#: Most wanted lines (their ids and places, some 60 bytes each) that go to all tasks.
BROADCAST_LINES = 200_000


def segment_starts(length: Column, t: int) -> list[tuple[Column, Column]]:
    """(start, length) of the t + 1 even segments of a line; the last ones are the longer."""
    short, long = F.floor(length / (t + 1)).cast("int"), F.pmod(length, F.lit(t + 1)).cast("int")
    out = []
    for i in range(t + 1):
        extra = F.greatest(F.lit(0), long - (t + 1 - i))
        out.append((short * i + extra, short + (F.lit(t + 1 - i) <= long).cast("int")))
    return out


def _key(length: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), piece)


def index_keys(line: Column, length: Column, t: int) -> list[Column]:
    """Keys of a line's own segments."""
    return [_key(length, i, F.substring(line, p + 1, n)) for i, (p, n) in enumerate(segment_starts(length, t))]


def probe_keys(line: Column, length: Column, t: int, least: int) -> list[Column]:
    """Keys of the substrings, other than its own segments, at which an indexed line of equal or
    smaller length may have its i-th segment: the multi-match-aware window, i steps around the
    segment's start and at most t - i edits after it. Null where there is none."""
    keys = []
    for gap in range(t + 1):
        other = length - gap
        for i, (p, n) in enumerate(segment_starts(other, t)):
            for d in range(-i, i + 1):
                if abs(d - gap) <= t - i and (gap or d):
                    fits = (other >= least) & (p + d >= 0) & (p + d + n <= length)
                    keys.append(F.when(fits, _key(other, i, F.substring(line, p + d + 1, n))))
    return keys


def word_count(line: Column) -> Column:
    """Words between single blanks; two blanks in a row have an empty one between them."""
    return (F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _half(line: Column, words: Column, i: int) -> Column:
    """The first (i = 0) or the last ``words`` words."""
    return F.call_function("substring_index", line, F.lit(" "), words if i == 0 else -words)


def word_keys(line: Column, words: Column, gap: int = 0) -> list[Column]:
    """Keys of the two halves of a line's words, apart from those of characters by their place;
    with a gap, of the halves that a line of so many words fewer may share with this one."""
    other = words - gap
    head = F.floor(other / 2).cast("int")
    return [_key(other, -1 - i, _half(line, n, i)) for i, n in enumerate((head, other - head))]


def line_keys(line: Column, n: Column, words: Column, t: int, least: int, least_words: int | None = None) -> Column:
    """Array of (key, own) of a line of ``n`` characters and so many words: own segments, and the
    places where it may hold those of another line. Two lines that are alike share a key that is
    the own of one at least.

    One edited character changes one word, or splits or joins two, so halves of words also find
    pairs within one edit: for t = 1, lines of more than ``least_words`` words need no other keys.
    """
    own, probe = index_keys(line, n, t), probe_keys(line, n, t, least)
    if least_words is not None:
        if t == 1:
            own, probe = ([F.when(words <= least_words, k) for k in keys] for keys in (own, probe))
        own += [F.when(words >= least_words, k) for k in word_keys(line, words)]
        probe += [F.when(words > least_words, k) for k in word_keys(line, words, 1)]

    def pairs(keys: list[Column], mine: bool) -> Column:
        kept = F.array_compact(F.array(*keys))
        return F.transform(kept if t == 1 else F.array_distinct(kept), lambda k: F.struct(k.alias("key"), F.lit(mine).alias("own")))

    return F.concat(pairs(own, True), pairs(probe, False))


def with_keys(lines: DataFrame, t: int, least: int, least_words: int | None = None) -> DataFrame:
    """``lines`` (line, ...) with their ``keys``; none for lines of fewer than ``least`` characters."""
    least_words = None if least_words is None else max(least_words, 2)
    sized = lines.withColumns({"n": F.char_length("line").cast("int"), "words": word_count(F.col("line"))})
    keys = line_keys(F.col("line"), F.col("n"), F.col("words"), t, least, least_words)
    return sized.withColumn("keys", F.when(F.col("n") >= least, keys)).drop("n", "words")


def word_within(a: str, b: str) -> Column:
    """Whether one word put in, left out or replaced makes line columns ``a`` and ``b`` equal:
    their common first and last words are all but one of the longer line's."""
    return F.expr(f"""
        transform(array(named_struct('p', split({a}, ' ', -1), 's', split({b}, ' ', -1))), q ->
        aggregate(array(zip_with(q.p, q.s, (x, y) -> x <=> y), zip_with(reverse(q.p), reverse(q.s), (x, y) -> x <=> y)), 0L,
            (n, same) -> n + if(array_position(same, false) = 0, size(same), array_position(same, false) - 1))
        >= greatest(size(q.p), size(q.s)) - 1)[0]
    """)


def edit_within(a: str, b: str, t: int) -> Column:
    """Whether the edit distance of line columns ``a`` and ``b`` is at most t, for t >= 1 and
    lengths that differ by at most t.

    Myers' bit-parallel recurrence on a band of 2t + 1 diagonals (Hyyro 2003): one step for each
    character of the shorter line, bit k of column i standing for position i - t + k of the
    longer one, so the work is linear in the length. The score follows the lowest diagonal of
    the band until that leaves the pattern, then the last row.
    """
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << 2 * t
    start = full & ~((1 << t) - 1)
    eq = " | ".join(f"if(get(q.p, i - {t} + {k}) <=> get(q.s, i), {1 << k}L, 0L)" for k in range(width))
    step = f"""
        transform(array(named_struct('v', st, 'x', {eq})), y ->
        transform(array(named_struct('vp', y.v.vp, 'vn', y.v.vn, 'd', y.v.d,
            'd0', ((((y.x & y.v.vp) + y.v.vp) ^ y.v.vp) | y.x | y.v.vn) & {full}L)), z ->
        transform(array(named_struct('d0', z.d0, 'd', z.d,
            'hp', (z.vn | ~(z.d0 | z.vp)) & {full}L, 'hn', z.d0 & z.vp)), w ->
        named_struct(
            'vp', (w.hn | ~(shiftright(w.d0, 1) | w.hp)) & {full}L,
            'vn', shiftright(w.d0, 1) & w.hp,
            'd', w.d + if(i < size(q.p) - {t},
                          if(w.d0 & {top}L = 0L, 1, 0),
                          if((shiftright(w.hp, {2 * t - 1} - (i - size(q.p) + {t})) & 1L) = 1L, 1, 0)
                            - if((shiftright(w.hn, {2 * t - 1} - (i - size(q.p) + {t})) & 1L) = 1L, 1, 0)))
        )[0])[0])[0]
    """
    pattern = f"if(char_length({a}) >= char_length({b}), {a}, {b})"
    text = f"if(char_length({a}) >= char_length({b}), {b}, {a})"
    return F.expr(f"""
        transform(array(named_struct('p', split({pattern}, ''), 's', split({text}, ''))), q ->
        aggregate(sequence(0, size(q.s) - 1), named_struct('vp', {start}L, 'vn', 0L, 'd', {t}), (st, i) -> {step}).d <= {t})[0]
    """)


def _grid(of: str, gap: int, words: bool) -> str:
    """Rows (class, own, mid) of table ``of``: for each of CHUNKS stretches of a line's words or
    characters, a hash of all that is outside of it, and the stretch. With a gap the grid is
    that of a line with one word or character fewer, whose stretch is shorter by that one."""
    n = "words" if words else "n"
    head, tail = "k.o * k.q div {c}".format(c=CHUNKS), "k.o - k.o * (k.q + 1) div {c}".format(c=CHUNKS)
    if words:
        before, after = f"substring_index(line, ' ', cast({head} as int))", f"substring_index(line, ' ', -cast({tail} as int))"
        cut = f"if({head} > 0, 1, 0)", f"if({tail} > 0, 1, 0)"
    else:
        before, after = f"left(line, cast({head} as int))", f"right(line, cast({tail} as int))"
        cut = "0", "0"
    open_ = f"k.o * (k.q + 1) div {CHUNKS} > k.o * k.q div {CHUNKS}"
    return f"""
        SELECT id, place, xxhash64({-1 if words else 0}, o, q, before, after) AS class, {"false" if gap else "true"} AS own, {words} AS words,
               substr(line, char_length(before) + {cut[0]} + 1, char_length(line) - char_length(before) - char_length(after) - {cut[0]} - {cut[1]}) AS mid,
               k
        FROM (SELECT id, place, line, k, k.o, k.q, {before} AS before, {after} AS after
              FROM (SELECT id, place, line, explode(transform(sequence(0, {CHUNKS - 1}), q -> named_struct('o', cast({n} - {gap} as bigint), 'q', cast(q as bigint)))) AS k
                    FROM {of})
              WHERE {open_})
    """


def _classes(lines: DataFrame, least: int, least_words: int | None) -> DataFrame:
    """(class, own, id, place, words, mid): lines that are alike share a class, as members whose
    stretches are all that differs. Two such members are alike if their stretches are."""
    n, words = F.char_length("line"), word_count(F.col("line"))
    rows = lines.select("id", "place", "line", n.cast("int").alias("n"), words.alias("words"))
    spark, out = lines.sparkSession, None
    for by_words in (False, True) if least_words is not None else (False,):
        for gap in (0, 1):
            if by_words:
                some = rows.filter(F.col("words") >= least_words + gap)
            else:
                some = rows.filter(F.col("n") >= least + gap)
                some = some if least_words is None else some.filter(F.col("words") <= least_words + gap)
            part = spark.sql(_grid("{some}", gap, by_words), some=some).drop("k")
            out = part if out is None else out.unionByName(part)
    return out


#: Of a stretch: all but one character or word of it, told apart by what is open. Own members
#: have the shorter stretch, so they also meet the others' stretches less one.
_LEAVES = """
    concat(
        transform(places, p -> xxhash64(class, 'one', left(mid, p - 1), substr(mid, p + 1))),
        if(own, array(xxhash64(class, 'less', mid)), transform(places, p -> xxhash64(class, 'less', concat(left(mid, p - 1), substr(mid, p + 1))))),
        if(words, transform(sequence(1, parts), p -> transform(array(named_struct('l', substring_index(mid, ' ', p - 1), 'r', substring_index(mid, ' ', p - parts))), z ->
            if(own, xxhash64(class, 'word', p, z.l, z.r), xxhash64(class, 'less', concat(z.l, if(p > 1 and p < parts, ' ', ''), z.r))))[0]), array()))
"""


def _class_pairs(lines: DataFrame, bound: int, least: int, least_words: int | None) -> tuple[DataFrame, str]:
    """Candidate pairs for one edit among lines of crowded groups, linear in their number; and
    the folder to delete after use.

    Lines are keyed again by all but one stretch of them. Where such a class is crowded too, by
    all but one character or word: lines that share this are alike, so each needs to meet only
    the earliest of them, and the earliest that is longer or shorter by the open one.
    """
    classes, path = materialize(_classes(lines, least, least_words), "line-classes")
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("int")).alias("owns")).filter("n > 1 AND owns > 0")
    k = F.xxhash64("class").alias("key")  # a key of its own, see duplicate_lines
    classes = classes.withColumn("key", k).join(sizes.select(k, "n"), "key")
    pairs = _pairs(classes.filter(F.col("n") <= bound))
    parts = F.size(F.split("mid", " ", -1)).alias("parts")
    places = F.expr("if(mid = '', array(), sequence(1, char_length(mid)))").alias("places")  # a word may be empty
    crowded = classes.filter(F.col("n") > bound).select("id", "place", "class", "own", "words", "mid", places, parts)
    who = F.struct("place", "id")
    leaves = crowded.select("id", "own", who.alias("who"), F.explode(F.array_distinct(F.expr(_LEAVES))).alias("leaf"))
    firsts = leaves.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("own"), F.col("who"))).alias("own"), F.min(F.when(~F.col("own"), F.col("who"))).alias("other"))
    k = F.xxhash64("leaf").alias("k")
    firsts = firsts.filter("n > 1").select(k, F.explode(F.array_compact(F.array("own.id", "other.id"))).alias("b"))
    stars = leaves.select(k, F.col("id").alias("a")).join(firsts, "k").filter("a <> b").select("a", "b")
    return pairs.unionByName(stars), path


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs of a group's members of which one has the key as its own."""
    a = members.filter("own").select("key", F.col("id").alias("a"))
    b = members.select("key", F.col("id").alias("b"), "own")
    return a.join(b, "key").filter((F.col("a") < F.col("b")) | ((F.col("a") != F.col("b")) & ~F.col("own"))).select("a", "b")


def near_pairs(lines: DataFrame, fetch: Callable[[DataFrame], DataFrame], t: int, least: int, least_words: int | None = None,
               pair_bound: int = 32) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of rows (id, place, line) of different lines within t edits, or of
    ``least_words`` words or more each and within one word; and the folders to delete after use.

    ``lines`` has (id, place, keys), each line once; ``fetch`` gives (id, place, line) for the
    (id, place) of those that share a key with another: only these travel as texts.

    For t = 1, groups of up to ``pair_bound`` lines with a common key give all their pairs, and
    larger ones the pairs of each line with the earliest of every class of lines that differ in
    the same place: a line that has an earlier like line is still paired with one such. So the
    number of pairs is linear in the size of groups. For a larger t it isn't.
    """
    keyed = lines.select("id", "place", F.explode("keys").alias("k")).select("id", "place", F.xxhash64("k.key").alias("key"), "k.own")
    sizes = lines.select(F.explode("keys").alias("k")).groupBy("k.key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("k.own").cast("int")).alias("owns")).filter("n > 1 AND owns > 0")
    members, groups = materialize(keyed.join(sizes.select(F.xxhash64("key").alias("key"), "n"), "key"), "line-groups")
    found, path = materialize(fetch(members.select("id", "place").distinct()), "lines")
    paths = [groups, path]
    if t > 1 or members.filter(F.col("n") > pair_bound).isEmpty():
        pairs = _pairs(members)
    else:
        crowded = members.filter(F.col("n") > pair_bound).select("id").distinct()
        more, path = _class_pairs(found.join(crowded, "id"), pair_bound, least, least_words)
        pairs = _pairs(members.filter(F.col("n") <= pair_bound)).unionByName(more)
        paths.append(path)
    # few bytes but much work: an explicit number of partitions isn't merged by adaptive execution
    tasks = 3 * lines.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.select(F.least("a", "b").alias("ia"), F.greatest("a", "b").alias("ib")).repartition(tasks, "ia", "ib").distinct()
    row = F.struct("id", "place", "line")
    pairs = pairs.join(found.select(F.col("id").alias("ia"), row.alias("a")), "ia").join(found.select(F.col("id").alias("ib"), row.alias("b")), "ib")
    near = (F.abs(F.char_length("a.line") - F.char_length("b.line")) <= t) & edit_within("a.line", "b.line", t)
    if least_words is not None:
        wa, wb = word_count(F.col("a.line")), word_count(F.col("b.line"))
        long = F.least(wa, wb) >= least_words
        if t == 1:  # within one character but not within one word: a word was split or two joined
            near = near & (~long | (F.abs(wa - wb) == 1))
        near = F.when(long & word_within("a.line", "b.line"), True).otherwise(near)
    return pairs.filter(F.col("a.line") != F.col("b.line")).filter(near).select("a", "b"), paths


def near_lines(distinct: DataFrame, t: int, least: int, least_words: int | None = None, pair_bound: int = 32) -> DataFrame:
    """Pairs (a, b) of the different lines of ``distinct`` (line; ``least`` characters or more,
    once each) that :func:`near_pairs` finds, each pair once."""
    rows = distinct.select(_id(F.col("line")).alias("id"), F.struct("line").alias("place"), "line")
    keyed = with_keys(rows, t, least, least_words)
    pairs, _ = near_pairs(keyed.drop("line"), lambda wanted: rows.join(wanted.select("id"), "id", "left_semi"), t, least, least_words, pair_bound)
    return pairs.select("a.line", F.col("b.line").alias("other")).toDF("a", "b")


def _id(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line.cast("binary"), 256)), 1, 16)


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, place, line) of the wanted places, out of the rows' texts. Which documents that
    concerns goes to all tasks while it is small, else both sides are dealt by document."""
    per_doc = wanted.groupBy(F.col("place.doc_id").alias("d")).agg(F.collect_list(F.struct("id", "place")).alias("wanted"))
    if wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        per_doc = F.broadcast(per_doc)
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d"))).select(F.split("text", "\n", -1).alias("all"), "wanted")
    lines = joined.select(F.explode(F.expr("transform(wanted, w -> named_struct('id', w.id, 'place', w.place, 'line', get(all, w.place.pos)))")).alias("w"))
    # rows that repeat an id may have another line at that place, or the same one
    return lines.select("w.*").filter(_id(F.col("line")) == F.col("id")).dropDuplicates(["id"])


def duplicate_lines(docs: DataFrame, threshold: int = 1, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text",
                    least_words: int | None = None, fold_short: bool = False, pair_bound: int = 32) -> DataFrame:
    """Lines to drop: a line equal to one that comes earlier, or within ``threshold`` edits of
    an earlier one, by (doc_id, line number). Lines end at \\n; shorter lines than
    ``min_chars`` characters are left alone, for few edits turn them into anything.
    With ``least_words``, a line of so many words or more also goes if one word put in, left out
    or replaced makes it an earlier one of so many words, however many characters that word has.
    With ``fold_short``, equal lines are folded whatever their length, if they have a word.

    Equal lines are folded map-side first, so a line of a third of all documents is one row to
    the join. "Earlier" is by first occurrence and does not ask whether the earlier line stays,
    so the result needs no iteration and every dropped line has a like one before it.
    ``pair_bound``, see :func:`near_pairs`, does not change the result.

    Result: doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending); one row per
    input row.

    * null text: one empty line. Null ids come last in order. Empty table: empty result.
    * rows that repeat an id count as one document and get the same ``dropped``; lines at the
      same place of two such rows are ordered by a hash.
    """
    rows = texts(docs, id_col=id_col, text_col=text_col)
    split = F.split("text", "\n", -1)
    lines = rows.select("doc_id", F.posexplode(split).alias("pos", "line"))
    long = F.char_length("line") >= min_chars
    lines = lines.filter(long | F.col("line").rlike(WORDS) if fold_short else long)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos")
    spots = with_keys(lines, threshold, min_chars, least_words).select("doc_id", "pos", _id(F.col("line")).alias("id"), "keys")
    firsts = spots.groupBy("id").agg(F.min(F.struct(place.alias("place"), "keys")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts, _ = materialize(firsts.select("id", "first.place", "first.keys", "n"), "first-lines")
    near, paths = near_pairs(firsts.drop("n"), lambda wanted: _fetch(rows, wanted), threshold, min_chars, least_words, pair_bound)
    order = [F.struct(F.col(f"{x}.place"), F.col(f"{x}.id")) for x in "ab"]
    later = near.select(F.when(order[0] < order[1], F.col("b.id")).otherwise(F.col("a.id")).alias("id")).distinct()
    later, _ = materialize(later, "near-lines")
    for path in paths:
        drop_path(docs.sparkSession, path)
    fate = firsts.select("id", "place", "n").join(later.withColumn("near", F.lit(True)), "id", "left").filter("n > 1 OR near")
    # a key of its own makes both sides plain exchanges, so adaptive execution may split a common line
    key = F.hex("id").alias("k")
    spots = lines.select(_id(F.col("line")).alias("id"), "doc_id", "pos")
    gone = spots.select(key, "doc_id", "pos").join(fate.select(key, F.col("place").alias("first"), "near"), "k").filter(F.col("near") | (place != F.col("first")))
    per_doc = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).withColumnRenamed("doc_id", "d")
    counts = rows.select("doc_id", F.size(split).alias("n_lines"))
    none = F.array().cast("array<int>")
    return counts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def without_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut from their texts; documents that had words and lose
    them all go. ``drops`` as from :func:`duplicate_lines`."""
    gone = drops.filter("n_dropped > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.first("dropped").alias("_dropped"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    kept = F.expr(f"array_join(filter(split({text_col}, '\\n', -1), (x, i) -> not array_contains(_dropped, i)), '\\n')")
    rest = F.when(F.col("_dropped").isNull(), F.col(text_col)).otherwise(kept)
    joined = joined.withColumn("_rest", rest).filter(
        F.col("_dropped").isNull() | F.col("_rest").rlike(WORDS) | ~F.col(text_col).rlike(WORDS))
    return joined.select(*[F.col("_rest").alias(c) if c == text_col else F.col(c) for c in docs.columns])
