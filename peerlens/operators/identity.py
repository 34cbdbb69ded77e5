"""Matching entities across sources: normalised names, blocking, pair scores and decisions.

Names are compared for candidate pairs only, in Python where the measure needs it: the share of matching characters is that of
``difflib`` (longest common blocks), which no built-in function gives."""

from __future__ import annotations

import difflib
import math
import unicodedata
from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

ACCEPT = 0.90
MARGIN = 0.05
MAX_BLOCK = 400
BLOCK = 2048
#: Of pairs by kind: the rows on either side of a block, the pairs of rows that a task gets, the cells that are worked on at once, and
#: the pairs of names of a block that is worked on together with others.
ROWS, SHARE, CELLS, FEW = 1024, 1 << 21, 1 << 18, 1 << 10
#: Longer words are compared one by one.
WIDE = 32

# Letters that compatibility decomposition leaves whole.
LETTERS = {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "þ": "th", "Þ": "th", "ı": "i", "ħ": "h", "Ħ": "h", "ŧ": "t", "Ŧ": "t"}
# Name scores that count as very like and like.
VERY_STRONG, STRONG = 0.92, 0.85
# Of word scores, that of an initial and the least that counts in full; of name scores, those of equal names
# and of equal words, the most of others, and the weights of their parts.
INITIAL, ALIKE = 0.85, 0.8
EQUAL, SAME_WORDS, MOST = 1.0, 0.98, 0.97
WEIGHTS = {"paired": 0.55, "last": 0.30, "share": 0.15}


def plain(name: str | None) -> str | None:
    """Letters a to z and digits in single-spaced words."""
    if name is None:
        return None
    folded = unicodedata.normalize("NFKD", "".join(LETTERS.get(c, c) for c in name))
    kept = "".join(c for c in folded if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in kept).split())


def normalised(name: Column) -> Column:
    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(plain, na_action="ignore")

    return fold(name)


def surname(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


@lru_cache(maxsize=1 << 16)
def word_score(a: str, b: str) -> float:
    """1 for equal words, INITIAL for a word and its first letter, else the share of characters that match, halved if low."""
    if a == b:
        return 1.0
    if a[0] == b[0] and 1 in (len(a), len(b)):
        return INITIAL
    r = difflib.SequenceMatcher(None, a, b).ratio()
    return r if r >= ALIKE else r / 2


def word_scores(a: Sequence[str], b: Sequence[str], i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """``word_score`` of each word with its fellow, for words of at most WIDE characters all at once. Words come once and are met by
    their numbers ``i`` and ``j``, or else one by one."""
    i, j = (np.arange(len(words)) if at is None else at for words, at in ((a, i), (b, j)))
    la, lb = (np.array([len(w) for w in words], int)[at] for words, at in ((a, i), (b, j)))
    wide = np.maximum(la, lb)
    found = np.zeros(len(i))
    for least, most in ((0, WIDE // 4), (WIDE // 4, WIDE // 2), (WIDE // 2, WIDE)):
        at = np.flatnonzero((wide > least) & (wide <= most))
        if len(at):
            x, y = (np.array(words, f"U{most}").view(np.uint32).reshape(-1, most)[own[at]] for words, own in ((a, i), (b, j)))
            r = 2.0 * _matching(x.T, y.T, la[at], lb[at]) / (la[at] + lb[at])
            score = np.where(r >= ALIKE, r, r / 2)
            score = np.where((x[:, 0] == y[:, 0]) & (np.minimum(la[at], lb[at]) == 1), INITIAL, score)
            found[at] = np.where(r == 1.0, 1.0, score)
    for k in np.flatnonzero(wide > WIDE):
        found[k] = word_score(a[i[k]], b[j[k]])
    return found


def _matching(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """How many characters of each two words match, as difflib counts them: the longest common block, the earliest of the first word
    and then of the second among equals, and so on to its left and right. Words are columns, all of them are worked on at once."""
    rows, total = np.arange(len(a))[:, None], np.zeros(a.shape[1], int)
    at, a0, a1, b0, b1 = np.arange(a.shape[1]), np.zeros_like(la), la, np.zeros_like(lb), lb
    while len(at):
        inside = (rows >= b0) & (rows < b1)
        y, x = b[:, at], a[:, at]
        run = np.zeros((len(a) + 1, len(at)), np.int8)
        size, i, j = (np.zeros(len(at), np.int64) for _ in range(3))
        for k in range(len(a)):
            run[1:] = (run[:-1] + 1) * ((y == x[k]) & inside & (k >= a0) & (k < a1))
            most = run.max(0)
            more = np.flatnonzero(most > size)
            size[more], i[more], j[more] = most[more], k, run[:, more].argmax(0) - 1
        total += np.bincount(at, size, len(total)).astype(int)
        i, j = i - size + 1, j - size + 1
        left, right = (size > 0) & (i > a0) & (j > b0), (size > 0) & (i + size < a1) & (j + size < b1)
        both = lambda x, y: np.concatenate([x[left], y[right]])  # noqa: B023, E731
        at, a0, a1, b0, b1 = both(at, at), both(a0, i + size), both(i, a1), both(b0, j + size), both(j, b1)
    return total


def name_score(a: str | None, b: str | None) -> float:
    """EQUAL for equal names, SAME_WORDS for the same words, else up to MOST from three parts: how well the words of the shorter
    name pair up with those of the longer, how alike the last words are, and how many words find one to pair up with.

    Pairs are read off the table of all word scores: row by row of the shorter name (the first name's, if both have as many
    words), the likest word that no row has taken, the earliest among equals."""
    return float(_name_scores([a or ""], [b or ""])[0])


def _name_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``name_score`` of each name with its fellow. Two words that meet again are scored once."""
    p, q = [x.split() for x in a], [x.split() for x in b]
    found, kinds = np.zeros(len(a)), defaultdict(list)
    for i, (x, y) in enumerate(zip(p, q, strict=True)):
        if a[i] and b[i]:
            if a[i] == b[i]:
                found[i] = EQUAL
            elif set(x) == set(y):
                found[i] = SAME_WORDS
            elif x and y:
                kinds[len(x), len(y)].append(i)
    codes = {w: k for k, w in enumerate({w for at in kinds.values() for i in at for w in (*p[i], *q[i])})}
    words, asked = list(codes), {}
    for (m, n), at in kinds.items():
        x, y = (np.array([[codes[w] for w in names[i]] for i in at]) for names in (p, q))
        asked[m, n] = x[:, :, None] * len(words) + y[:, None, :]
    met = np.unique(np.concatenate([x.ravel() for x in asked.values()] or [np.zeros(0, int)]))
    scored = word_scores(words, words, met // max(1, len(words)), met % max(1, len(words)))
    for (m, n), at in kinds.items():
        found[at] = _paired(scored[np.searchsorted(met, asked[m, n])])
    return found


def _paired(scores: np.ndarray) -> np.ndarray:
    """The scores of names that have no case of their own, from the tables of their words' scores: one for each two names."""
    _, m, n = scores.shape
    table = scores if m <= n else scores.transpose(0, 2, 1)
    each, paired, free = np.arange(len(scores)), np.zeros(len(scores)), np.ones((len(scores), max(m, n)), bool)
    for row in range(min(m, n)):
        k = np.where(free, table[:, row], -1.0).argmax(1)
        best = np.where(free[each, k], table[each, row, k], 0.0)
        free[each, k] &= best <= 0
        paired += best
    parts = {"paired": paired / min(m, n), "last": scores[:, -1, -1], "share": min(m, n) / max(m, n)}
    return np.minimum(MOST, sum(WEIGHTS[x] * v for x, v in parts.items()))


def _crossed_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``name_score`` of each name of ``a``, a row, with each of ``b``. Two words are scored once."""
    p, q = [x.split() for x in a], [x.split() for x in b]
    words = [{w: k for k, w in enumerate(dict.fromkeys(w for x in names for w in x))} for names in (p, q)]
    own, others = (list(w) for w in words)
    scored, step = np.zeros((len(own), len(others))), max(1, CELLS // 8 // max(1, len(others)))
    for k in range(0, len(own) * bool(others), step):
        part = own[k : k + step]
        each = np.divmod(np.arange(len(part) * len(others)), len(others))
        scored[k : k + step] = word_scores(part, others, *each).reshape(len(part), -1)
    found, lengths = np.zeros((len(a), len(b))), [defaultdict(list), defaultdict(list)]
    for side, names in enumerate((p, q)):
        for i, x in enumerate(names):
            lengths[side][len(x)].append(i)
    for m, rows in lengths[0].items():
        for n, at in lengths[1].items():
            y, step = np.array([[words[1][w] for w in q[j]] for j in at], int), max(1, CELLS // max(1, len(at) * m * n))
            for k in range(0, len(rows) * bool(m and n), step):
                x = np.array([[words[0][w] for w in p[i]] for i in rows[k : k + step]], int)
                found[np.ix_(rows[k : k + step], at)] = _paired(scored[x[:, None, :, None], y[None, :, None, :]].reshape(-1, m, n)).reshape(len(x), -1)
    same = lambda x, y: np.equal.outer(*(np.array([codes[v] for v in side], int) for codes in [{v: k for k, v in enumerate({*x, *y})}] for side in (x, y)))
    found[same([frozenset(x) for x in p], [frozenset(x) for x in q])] = SAME_WORDS
    found[same(a, b)] = EQUAL
    found[[not x for x in a]] = 0.0
    found[:, [not x for x in b]] = 0.0
    return found


def _told(scores: np.ndarray) -> np.ndarray:
    """Scores to nine decimals."""
    kinds, place = np.unique(scores, return_inverse=True)
    return np.array([round(v, 9) for v in kinds.tolist()], float)[place].reshape(scores.shape)


def name_scores(a: Column, b: Column) -> Column:
    """``name_score`` to nine decimals; in each batch a pair of names that comes again is scored once."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        (x, names), (y, others) = pd.factorize(left), pd.factorize(right)
        kinds, place = np.unique(x.astype(np.int64) * len(others) + y, return_inverse=True)
        known = _name_scores([names[k] for k in kinds // max(1, len(others))], [others[k] for k in kinds % max(1, len(others))])
        return pd.Series(np.array([round(v, 9) for v in known.tolist()])[place], dtype=float)

    return score(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def crossed_scores(a: Column, b: Column) -> Column:
    """``name_scores`` of each name of the array ``a`` with each of ``b``, as one array, in which those of a name of ``a`` follow each other."""

    @F.pandas_udf("array<double>")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        found, few, n = [None] * len(left), [[]], 0
        for k, (names, others) in enumerate(zip(left, right, strict=True)):
            if len(names) * len(others) <= FEW:
                few[-1].append(k)
                n += len(names) * len(others)
                if n > CELLS // 16:
                    few, n = [*few, []], 0
            else:
                (x, own), (y, theirs) = pd.factorize(np.asarray(names, object)), pd.factorize(np.asarray(others, object))
                found[k] = _told(_crossed_scores(list(own), list(theirs)))[np.ix_(x, y)].ravel()
        for at in few:
            scored = _told(_name_scores([x for k in at for x in left[k] for _ in right[k]], [y for k in at for _ in left[k] for y in right[k]]))
            for k, part in zip(at, np.split(scored, np.cumsum([len(left[k]) * len(right[k]) for k in at])[:-1]) if at else [], strict=True):
                found[k] = part
        return pd.Series(found)

    return score(a, b)


def contained(a: Column, b: Column) -> Column:
    """Whether the shorter of two names, of two words at least and with the same first word, is part of the longer: each of its
    words as often as it has it. False if either is unknown."""
    p, q = F.split(F.coalesce(a, F.lit("")), " "), F.split(F.coalesce(b, F.lit("")), " ")
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    within = lambda few, many: (F.size(few) >= 2) & (F.size(few) < F.size(many)) & (few[0] == many[0]) & F.forall(few, lambda w: times(few, w) <= times(many, w))
    return within(p, q) | within(q, p)


def same_club(a: Column, b: Column, stop: Sequence[str]) -> Column:
    """True for equal names or if one's words are all in the other's and one of them is distinctive; false for no common
    distinctive word; null otherwise and for unknown names."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    own = lambda c: F.array_except(words(c), F.array(*[F.lit(w) for w in stop]))
    inside = (F.size(F.array_except(words(a), words(b))) == 0) | (F.size(F.array_except(words(b), words(a))) == 0)
    common = F.arrays_overlap(own(a), own(b))
    return F.when(a.isNull() | b.isNull(), None).when((a == b) | (inside & common), True).when(~common, False)


def candidates(left: DataFrame, right: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(left_id, right_id) of rows (id, name, born) to compare: the same birth date, or surname and birth year, or the
    surname alone for a left row without a date if at most ``max_block`` right rows have it."""
    return compared(left, right, max_block).select("left_id", "right_id")


def compared(left: DataFrame, right: DataFrame, max_block: int | None = MAX_BLOCK, named: bool = True) -> DataFrame:
    """``candidates`` with all columns of both rows, as left_<column> and right_<column>. Without ``max_block`` surnames may have any
    number of rows; without ``named``, the pairs that ``named_kinds`` has are left out.

    One equality join on what a pair can have in common. A pair of one date isn't met again by its year, so that pairs need no
    shuffle to be told apart; only those of an id that several rows have are, and of these one is kept."""
    a, b = _known("left", left), _known("right", right).withColumn("_s", _surname("right"))
    a = _keyed(a, "left", F.when(F.col("left_born").isNull(), F.concat(F.lit("s"), _surname("left"))))
    if max_block is not None:
        sizes = b.groupBy("_s").agg(F.count("*").alias("_n")).where(F.col("_n") <= max_block)
        b = b.join(sizes, "_s", "left").withColumn("_s", F.when(F.col("_n").isNotNull(), F.col("_s"))).drop("_n")
    b = _keyed(b, "right", F.concat(F.lit("s"), F.col("_s"))).drop("_s")
    own = lambda df, many: df.where(F.col("_many") == many).drop("_many")
    again = _met(own(a, True), b.drop("_many")).unionByName(_met(own(a, False), own(b, True)))
    once = [own(df, False) if named else own(df, False).where(~_named()) for df in (a, b)]
    return _met(*once).unionByName(again.dropDuplicates(["left_id", "right_id"]))


def named_kinds(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of ``compared`` without ``max_block`` that have a surname in common and no date, but for ids that several rows have, by
    kind: rows of a surname, or of a surname and year, that differ in id and date only. A name is scored once with another of its block.

    (left_<column>, left_rows, right_<column>, right_rows, same_year, name_score): each of left_rows (left_id, left_born) makes a pair
    with each of right_rows, unless they are of one date. A key's kinds are dealt into parts of about ROWS rows on either side, and
    tasks get as many blocks of them as hold about SHARE pairs, so that neither a surname nor a kind of many rows is one task's work."""
    kinds, what = {}, [c for c in left.columns if c not in ("id", "born")]
    for side, df, name in (("left", left, F.when(F.col("left_born").isNull(), F.concat(F.lit("s"), _surname("left")))), ("right", right, F.concat(F.lit("s"), _surname("right")))):
        rows = _keyed(_known(side, df).where(~F.col("_many")), side, name).where(_named())
        grouped = rows.groupBy("_key", *[f"{side}_{c}" for c in what]).agg(F.sort_array(F.collect_list(F.struct(f"{side}_id", f"{side}_born"))).alias("_rows"))
        few = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / ROWS).cast("int")), lambda k: F.slice("_rows", k * ROWS + 1, F.lit(ROWS)))
        kinds[side] = written(grouped.withColumn(f"{side}_rows", F.explode(few)).drop("_rows"), "kinds")
    n = {side: df.groupBy("_key").agg(F.sum(F.size(f"{side}_rows")).alias(f"_{side}")) for side, df in kinds.items()}
    sizes = written(n["left"].join(n["right"], "_key"), "sizes")
    pairs = sizes.agg(F.sum(F.col("_left") * F.col("_right"))).first()[0] or 0
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) + math.ceil(pairs / SHARE)

    def dealt(side: str, other: str) -> DataFrame:
        columns = kinds[side].drop("_key").columns
        part = F.pmod(F.xxhash64(*columns[:-1], F.get(columns[-1], F.lit(0))), F.ceil(F.col(f"_{side}") / ROWS))
        rows = kinds[side].join(sizes, "_key").groupBy("_key", part.cast("int").alias(f"_p{side}"), F.ceil(F.col(f"_{other}") / ROWS).cast("int").alias("_n")).agg(F.collect_list(F.struct(*columns)).alias(side))
        return rows.withColumn(f"_p{other}", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").repartition(tasks, "_key", "_pleft", "_pright")

    blocks = dealt("left", "right").hint("merge").join(dealt("right", "left"), ["_key", "_pleft", "_pright"])
    scored = blocks.withColumn("_scores", crossed_scores(F.col("left")["left_name"], F.col("right")["right_name"]))
    # No array is empty. Inner generators would have Spark look for empty ones first, by scoring the names once more.
    each = scored.select("left", "right", F.col("_key").startswith("y").alias("same_year"), F.posexplode_outer("_scores").alias("_k", "name_score"))
    width = F.size("right")
    return each.select(F.get("left", (F.col("_k") / width).cast("int")).alias("_x"), F.get("right", F.col("_k") % width).alias("_y"), "same_year", "name_score").select("_x.*", "_y.*", "same_year", "name_score")


def _named() -> Column:
    """Whether a key of ``_keyed`` has a surname."""
    return ~F.col("_key").startswith("d")


def _surname(side: str) -> Column:
    return surname(F.col(f"{side}_name"))


def _known(side: str, rows: DataFrame) -> DataFrame:
    """The columns of one side, and whether several rows have the id."""
    named = rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns])
    return named.withColumn("_many", F.count("*").over(Window.partitionBy(f"{side}_id")) > 1)


def _keyed(rows: DataFrame, side: str, name: Column) -> DataFrame:
    """A row for each key that a row can be met by: its date, its year and surname, its surname alone."""
    born = F.col(f"{side}_born")
    keys = F.array(F.concat(F.lit("d"), born.cast("string")), F.concat(F.lit("y"), F.year(born).cast("string"), F.lit(" "), _surname(side)), name)
    return rows.withColumn("_key", F.explode(F.array_compact(keys)))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of one key. A key's rows are dealt into parts of about BLOCK on either side, and a task gets pairs of parts: input of a
    few MB makes many pairs, so neither side is broadcast to the few tasks that read the other."""
    n = lambda df, c: df.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    parts = n(a, "_pa").join(n(b, "_pb"), "_key")
    dealt = lambda df, side, own, other: df.join(parts, "_key").withColumn(f"_{own}", F.pmod(F.xxhash64(f"{side}_id"), F.col(f"_p{own}")).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_p{other}") - 1))).drop("_pa", "_pb")
    pairs = dealt(a, "left", "a", "b").hint("merge").join(dealt(b, "right", "b", "a"), ["_key", "_a", "_b"])
    by_year = F.col("_key").startswith("y") & (F.col("left_born") == F.col("right_born"))
    return pairs.where(~F.coalesce(by_year, F.lit(False))).drop("_key", "_a", "_b")


def pair_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` (left_name, right_name, left_born, right_born, same_nation, same_club) with confidence and method."""
    rows = pairs.withColumn("name_score", name_scores(F.col("left_name"), F.col("right_name"))).withColumn("within", contained(F.col("left_name"), F.col("right_name")))
    dated = F.coalesce(F.col("left_born") == F.col("right_born"), F.lit(False))
    both = F.col("left_born").isNotNull() & F.col("right_born").isNotNull()
    year = F.coalesce(F.year("left_born") == F.year("right_born"), F.lit(False))
    return _ruled(rows, dated, both, year, F.col("within")).drop("within")


def kind_scores(kinds: DataFrame) -> DataFrame:
    """``named_kinds`` (same_nation and same_club besides) with confidence and method. No rule gives ACCEPT without a date in common."""
    no, year = F.lit(False), F.col("same_year")
    return _ruled(kinds, no, year, year, no)


def _ruled(rows: DataFrame, dated: Column, both: Column, year: Column, within: Column) -> DataFrame:
    n = F.col("name_score")
    club, nation = (F.coalesce(F.col(c), F.lit(False)) for c in ("same_club", "same_nation"))
    # The confidence of each rule and its name scores. The first that holds decides.
    rules = [
        (dated & (n >= 1) & club, F.lit(1.00), "name, date, club"),
        (dated & (n >= 1), F.lit(0.95), "name, date"),
        (dated & (n >= VERY_STRONG), F.lit(0.98), "date, very like name"),
        (dated & (n >= STRONG) & nation & club, F.lit(0.92), "date, like name, nation, club"),
        (dated & (n >= STRONG) & (nation | club), F.lit(0.90), "date, like name, nation or club"),
        (dated & (n >= STRONG), F.lit(0.86), "date, like name"),
        (dated & within & nation & club, F.lit(0.92), "date, part of name, nation, club"),
        (dated & within & (nation | club), F.lit(0.90), "date, part of name, nation or club"),
        (dated, F.least(F.lit(0.70), 0.45 + n * 0.3), "date, weak name"),
        (both & ~year, F.least(F.lit(0.30), n * 0.3), "years differ"),
        (both & (n >= VERY_STRONG) & (nation | club), F.lit(0.88), "year, very like name, nation or club"),
        (both, F.least(F.lit(0.75), n * 0.75), "year, name"),
        ((n >= 1) & nation & club, F.lit(0.85), "name, nation, club"),
        ((n >= VERY_STRONG) & (nation | club), F.lit(0.72), "very like name, nation or club"),
    ]
    last = F.struct(F.least(F.lit(0.65), n * 0.65).alias("confidence"), F.lit("name alone").alias("method"))
    step = last
    for holds, confidence, method in reversed(rules):
        step = F.when(holds, F.struct(confidence.alias("confidence"), F.lit(method).alias("method"))).otherwise(step)
    return rows.withColumn("_s", step).select(*rows.columns, "_s.confidence", "_s.method")


def unblocked(left: DataFrame, right: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(surname, left_rows, right_rows): undated left rows that ``candidates`` compares with nobody, as more than ``max_block``
    right rows have their surname; a larger ``max_block`` compares them too."""
    a = left.where("born IS NULL").groupBy(surname(F.col("name")).alias("surname")).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(surname(F.col("name")).alias("surname")).agg(F.count("*").alias("right_rows"))
    return a.join(b, "surname").where(F.col("right_rows") > max_block)


def decide(scored: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, confidence, status) from (left_id, right_id, confidence): a manual override wins; the best under
    ACCEPT is unmatched; within MARGIN of the runner-up it is ambiguous."""
    # What is more than MARGIN under ACCEPT decides nothing but how high an unmatched row got: of it a task passes on the highest.
    weak = F.coalesce(F.col("confidence") < ACCEPT - 2 * MARGIN, F.lit(False))
    kept = scored.groupBy("left_id", F.when(~weak, F.col("right_id")).alias("right_id"), F.when(~weak, F.col("confidence")).alias("_c"), weak.alias("_weak")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("_n"))
    w = Window.partitionBy("left_id").orderBy(F.desc("confidence"), "right_id")
    best = kept.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.when(F.col("_n") > 1, F.col("confidence")).otherwise(F.lead("confidence").over(w))).where("_r = 1")
    status = F.when(F.col("confidence") < ACCEPT, "unmatched").when(F.col("confidence") - F.coalesce("_next", F.lit(0.0)) < MARGIN - 1e-9, "ambiguous").otherwise("matched")
    out = best.select("left_id", F.when(status == "matched", F.col("right_id")).alias("right_id"), "confidence", status.alias("status"))
    if overrides is None:
        return out
    o = overrides.select("left_id", F.col("right_id").alias("_o"))
    both = out.join(o, "left_id", "full")
    manual = F.col("_o").isNotNull()
    return both.select("left_id", F.when(manual, F.col("_o")).otherwise(F.col("right_id")).alias("right_id"), F.when(manual, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(manual, "manual").otherwise(F.col("status")).alias("status"))


def merges(planned: DataFrame, stats: DataFrame) -> DataFrame:
    """(source_id, target_id, refused): a merge is refused if target and source, or an earlier merge into the same target,
    share a (competition, season). Earlier means a smaller source_id; one (target, competition, season) is one window."""
    own = planned.join(stats.withColumnRenamed("entity_id", "source_id"), "source_id").select("source_id", "target_id", "competition_id", "season_id")
    held = stats.select(F.col("entity_id").alias("target_id"), "competition_id", "season_id").distinct().withColumn("_held", F.lit(True))
    w = Window.partitionBy("target_id", "competition_id", "season_id").orderBy("source_id")
    clash = own.join(held, ["target_id", "competition_id", "season_id"], "left").withColumn("_late", F.rank().over(w) > 1)
    bad = clash.groupBy("source_id", "target_id").agg(F.bool_or(F.col("_held").isNotNull() | F.col("_late")).alias("refused"))
    return planned.join(bad, ["source_id", "target_id"], "left").select("source_id", "target_id", F.coalesce("refused", F.lit(False)).alias("refused"))


def repoint(facts: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    m = merged.where(~F.col("refused")).select(F.col("source_id").alias(key), F.col("target_id").alias("_to"))
    return facts.join(m, key, "left").select(*[F.coalesce("_to", key).alias(c) if c == key else c for c in facts.columns])


def evaluate(decided: DataFrame, truth: Mapping[int, int] | DataFrame) -> DataFrame:
    """One row (found, right, precision, recall) of decisions against known pairs (left_id, true_id)."""
    pairs = truth if isinstance(truth, DataFrame) else decided.sparkSession.createDataFrame(list(truth.items()), "left_id long, true_id long")
    both = pairs.join(decided, "left_id", "left")
    return both.agg(F.count("right_id").alias("found"), F.count_if(F.col("right_id") == F.col("true_id")).alias("right"), F.count("*").alias("all")).select("found", "right", (F.col("right") / F.nullif(F.col("found"), F.lit(0))).alias("precision"), (F.col("right") / F.nullif(F.col("all"), F.lit(0))).alias("recall"))
