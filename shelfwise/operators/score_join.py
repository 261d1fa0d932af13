"""Exact best-n join by shared features, without comparing all pairs.

Rows carry *features*: name tokens, URL tokens and measures. A pair scores the
weights of the features it shares, plus a part that depends only on the class of
both rows (promo flag, which measures are present). Every left row wants its
best n right rows, earlier right rows first on a tie.

Joining on a feature that a third of the rows share would emit all pairs within
that third. The work is cut in steps that lose no pair:

1. *Copies collapse.* Rows with equal features and class score alike. Only
   distinct signatures are matched, each with its first n right ordinals.
2. *Rarest first.* A left signature is joined on its rarest feature, if no more
   than ``hot_rows`` right signatures have it. Its most frequent features that
   together cannot reach the n-th best score found need no join of their own;
   often no feature is left and the signature is settled.
3. *Cold features.* What is still open is joined on each of its features that at
   most ``hot_rows`` right signatures have.
4. *Reduction.* A pair that shares hot features only scores by these alone. So
   signatures are reduced to their hot features and collapse again (near copies
   become copies), and step 3 is repeated on the few that remain. For a pair
   that shares more, the reduced score is a lower bound and its full score came
   from an earlier step, so the maximum over all steps is exact.
5. *Blocks.* What is left are distinct sets of features that are all hot. Their
   scores are sums of products, so blocks of left and right signatures are
   multiplied as matrices; a task returns the first n of its block per left
   signature. The work is the product of two numbers of distinct hot sets, each
   far below the number of rows, and never depends on how many sets a row's
   features could form.
6. *The empty set* stands for pairs that share nothing; it is used only if such
   a score can be asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.plans.skew import HOT_ROWS, is_small, keyed_lookup, stage, stage_both, top_n

#: A feature or set with more right signatures than this is hot.
HOT_FEATURE_ROWS = 1_000
#: Rows of one feature that go to one sub-key of a salted join.
POSTINGS_PER_PART = 50_000
#: Reductions before blocks are compared. Each one is exact, so the number only
#: decides how the work is split.
REDUCTIONS = 2
#: Left and right signatures that meet in one task.
LEFT_BLOCK, RIGHT_BLOCK = 2_048, 4_096


@dataclass(frozen=True)
class Measure:
    name: str
    pattern: str
    equal: float
    unequal: float = 0.0


@dataclass(frozen=True)
class Weights:
    strong: float = 2.0
    weak: float = 0.5
    measures: tuple[Measure, ...] = ()
    promo_only_right: float = 0.0
    promo_both: float = 0.0

    def __post_init__(self) -> None:
        """The bounds of the join hold for rewards on what is shared only."""
        if not self.strong >= self.weak >= 0:
            raise ValueError("strong >= weak >= 0 expected")
        if any(m.equal <= 0 or m.unequal > 0 for m in self.measures):
            raise ValueError("a measure rewards equality and may only punish difference")
        if self.promo_only_right > 0:
            raise ValueError("a promo row on the right only may not be rewarded")

    @property
    def bonus(self) -> float:
        """The most a promo row on the left can gain beyond its features."""
        return max(0.0, self.promo_both)

    @property
    def nothing_shared(self) -> float:
        """The best score of a pair without a shared feature."""
        return self.bonus


# --- signatures: strong tokens, weak tokens, measures, presence, promo ------

_TAB, _GAP, _BAR, _BAR_RE = "\t", " ", "|", r"\|"


def _packed(strong: Column, weak: Column, ms: Column, present: Column, promo: Column) -> Column:
    lists = [F.array_join(F.array_sort(a), _GAP) for a in (strong, weak)]
    return F.concat_ws(_TAB, *lists, F.array_join(ms, _BAR), present, promo)


def _presence(ms: Column) -> Column:
    """``10`` = the first of two measures is present."""
    return F.array_join(F.transform(ms, lambda v: F.when(v != "", F.lit("1")).otherwise(F.lit("0"))), "")


def _part(i: int, sig: str = "sig") -> Column:
    return F.get(F.split(F.col(sig), _TAB), F.lit(i))


def _list(i: int) -> Column:
    return F.filter(F.split(_part(i), _GAP), lambda t: t != "")


def _unpacked(prefix: str = "") -> list[Column]:
    columns = {
        "strong": _list(0),
        "weak": _list(1),
        "ms": F.split(_part(2), _BAR_RE),
        "present": _part(3),
        "promo": _part(4) == "true",
    }
    return [c.alias(prefix + name) for name, c in columns.items()]


def _class_of(prefix: str = "") -> list[Column]:
    return [_part(3).alias(prefix + "present"), (_part(4) == "true").alias(prefix + "promo")]


def _features(w: Weights) -> Column:
    """Tagged features; a measure is one only if equality earns something."""

    def tagged(tag: str, items: Column) -> Column:
        return F.transform(items, lambda t: F.concat(F.lit(tag), t))

    values = F.split(_part(2), _BAR_RE)
    measures = [
        F.when(F.get(values, F.lit(i)) != "", F.concat(F.lit(f"m{i}:"), F.get(values, F.lit(i))))
        for i, m in enumerate(w.measures)
        if m.equal > 0
    ]
    found = [tagged("t:", _list(0)), tagged("w:", _list(1))]
    if measures:
        found.append(F.array_compact(F.array(*measures)))
    return F.concat(*found)


def _feature_weight(w: Weights) -> Column:
    by_tag = F.when(F.col("f").startswith("t:"), w.strong).when(F.col("f").startswith("w:"), w.weak)
    for i, m in enumerate(w.measures):
        by_tag = by_tag.when(F.col("f").startswith(f"m{i}:"), m.equal)
    return by_tag


def _smallest(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` smallest ``ord`` per key as an array, limited before the shuffle."""
    if n == 1:
        return df.groupBy(*keys).agg(F.array(F.min("ord")).alias("ords"))
    first = top_n(df, keys, [F.col("ord")], n)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("ord")).alias("ords"))


# --- scores -----------------------------------------------------------------


def _class_score(w: Weights, equal) -> Column:
    """Measures and promo; ``equal(i)`` tells whether measure i is equal."""
    total = (
        F.when(F.col("r_promo") & F.col("promo"), F.lit(w.promo_both))
        .when(F.col("r_promo"), F.lit(w.promo_only_right))
        .otherwise(F.lit(0.0))
    )
    for i, m in enumerate(w.measures):
        both = (F.substring("present", i + 1, 1) == "1") & (F.substring("r_present", i + 1, 1) == "1")
        total = total + F.when(equal(i), F.lit(m.equal)).when(both, F.lit(m.unequal)).otherwise(F.lit(0.0))
    return total


def _pair_score(w: Weights) -> Column:
    def shared(name: str) -> Column:
        # items are distinct; one hash set less to build than an intersection
        return F.size(name) - F.size(F.array_except(name, f"r_{name}"))

    def equal(i: int) -> Column:
        mine = F.get("ms", F.lit(i))
        return (mine != "") & (mine == F.get("r_ms", F.lit(i)))

    return shared("strong") * w.strong + shared("weak") * w.weak + _class_score(w, equal)


def _best(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """Best ``n`` of (key, ord, score); a pair may occur with several lower bounds.

    For n = 1 both steps keep only fixed-width buffers, so they hash-aggregate
    and combine before each shuffle.
    """
    if n == 1:
        return (
            pairs.groupBy(key, "score")
            .agg(F.min("ord").alias("ord"))
            .groupBy(key)
            .agg(F.max_by("ord", "score").alias("ord"), F.max("score").alias("score"))
            .withColumn("rank", F.lit(1))
        )
    exact = pairs.groupBy(key, "ord").agg(F.max("score").alias("score"))
    return top_n(exact, [key], [F.desc("score"), F.col("ord")], n, "rank")


# --- postings and joins -----------------------------------------------------


def _parts(stats: DataFrame, count: str) -> DataFrame:
    """Salting list of a side, from counts that are known anyway."""
    return (
        stats.where(F.col(count) > POSTINGS_PER_PART)
        .select("f", F.ceil(F.col(count) / POSTINGS_PER_PART).cast("int").alias("_parts"))
    )


def _postings(lrows: DataFrame, rrows: DataFrame, hot_rows: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature counts of both sides, and the postings of features both have.

    Counts are combined before they are shuffled, so a feature that a third of
    the rows have costs one row per task.
    """
    lexp = lrows.select("sig", F.explode("sets").alias("f"))
    rexp = rrows.select("sig", "ords", F.explode("sets").alias("f"))
    stats = (
        lexp.groupBy("f").agg(F.count(F.lit(1)).alias("ln"))
        .join(rexp.groupBy("f").agg(F.count(F.lit(1)).alias("rn")), "f")
        .withColumn("hot", F.col("rn") > hot_rows)
    )
    stats = stage(stats, name)
    flags = stats.select("f", "hot", "rn")
    if is_small(stats):
        return stats, lexp.join(F.broadcast(flags), "f"), rexp.join(F.broadcast(flags), "f")
    left = keyed_lookup(lexp, flags, "f", "sig", "inner", hot=_parts(stats, "ln"))
    right = keyed_lookup(rexp, flags, "f", "sig", "inner", hot=_parts(stats, "rn"))
    return stats, left, right


def _cold_pairs(lpost: DataFrame, rpost: DataFrame, stats: DataFrame, w: Weights, n: int) -> DataFrame:
    """Scores of all pairs that share one of the given cold features or sets."""
    left = lpost.select("f", "sig", *_unpacked())
    right = rpost.where("not hot").select("f", "ords", *_unpacked("r_"))
    joined = keyed_lookup(left, right, "f", "sig", "inner", hot=_parts(stats.where("not hot"), "ln"), multiplies=True)
    ord_ = F.get("ords", F.lit(0)) if n == 1 else F.explode("ords")
    return joined.select("sig", ord_.alias("ord"), _pair_score(w).alias("score"))


def _multiplied(w: Weights, n: int):
    """Best ``n`` right ordinals per left signature of one pair of blocks."""

    def parts(sig: str) -> tuple[list[str], list[str], list[str], str, bool]:
        strong, weak, ms, present, promo = sig.split(_TAB)
        return strong.split(_GAP) if strong else [], weak.split(_GAP) if weak else [], ms.split(_BAR), present, promo == "true"

    def products(group: pa.Table) -> pa.Table:
        sigs, ords = group.column("sig").to_pylist(), group.column("ords").to_pylist()
        left = [s for s, o in zip(sigs, ords) if o is None]
        right = sorted((o, s) for s, many in zip(sigs, ords) if many is not None for o in many)
        index: dict[str, int] = {}

        def number(name: str) -> int:
            return index.setdefault(name, len(index))

        at, values = ([], []), []
        for c, (_, sig) in enumerate(right):
            strong, weak, ms, present, promo = parts(sig)
            own = [(f"t:{t}", w.strong) for t in strong] + [(f"w:{t}", w.weak) for t in weak]
            for i, m in enumerate(w.measures):
                if present[i] == "1":
                    own.append((f"p{i}", m.unequal))
                if ms[i] if i < len(ms) else "":
                    own.append((f"m{i}:{ms[i]}", m.equal - m.unequal if present[i] == "1" else m.equal))
            own += [("promo", w.promo_both), ("plain", w.promo_only_right)] if promo else []
            for name, weight in own:
                at[0].append(number(name))
                at[1].append(c)
                values.append(weight)
        gains = np.zeros((len(index) + 1, max(1, len(right))))
        gains[at] = values
        asks = np.zeros((len(left), len(index) + 1))
        for r, sig in enumerate(left):
            strong, weak, ms, present, promo = parts(sig)
            names = [f"t:{t}" for t in strong] + [f"w:{t}" for t in weak] + [f"m{i}:{v}" for i, v in enumerate(ms) if v]
            names += [f"p{i}" for i, x in enumerate(present) if x == "1"] + ["promo" if promo else "plain"]
            asks[r, [index[x] for x in names if x in index]] = 1
        out = {"sig": [], "ord": [], "score": []}
        score = asks @ gains
        for _ in range(min(n, len(right))):  # rows are in order of ord, so the first of equals wins
            best = np.argmax(score, axis=1)
            out["sig"] += left
            out["ord"] += [right[c][0] for c in best]
            out["score"] += score[np.arange(len(left)), best].tolist()
            score[np.arange(len(left)), best] = -np.inf
        return pa.table(out, schema=pa.schema([("sig", pa.string()), ("ord", pa.int64()), ("score", pa.float64())]))

    return products


def _block_pairs(lrows: DataFrame, rrows: DataFrame, w: Weights, n: int) -> DataFrame:
    """Step 5. ``lrows``: sig; ``rrows``: sig, ords; both staged and without repeats."""
    cuts = [max(1, -(-side.count() // size)) for side, size in ((lrows, LEFT_BLOCK), (rrows, RIGHT_BLOCK))]
    own = [F.pmod(F.xxhash64("sig"), F.lit(c)).cast("int") for c in cuts]
    every = [F.explode(F.sequence(F.lit(0), F.lit(c - 1))) for c in cuts]
    left = lrows.select("sig", F.lit(None).cast("array<long>").alias("ords"), own[0].alias("i"), every[1].alias("j"))
    right = rrows.select("sig", F.col("ords").cast("array<long>").alias("ords"), every[0].alias("i"), own[1].alias("j"))
    return left.union(right).groupBy("i", "j").applyInArrow(_multiplied(w, n), "sig string, ord long, score double")


def _class_pairs(lsig: DataFrame, rsig: DataFrame, w: Weights, n: int) -> DataFrame:
    """Step 6. There are 2 x 2^measures right classes, known in advance, so the
    broadcast table has that many rows at most, whatever the number of rows."""
    classes = [
        F.struct(F.lit(format(bits, f"0{len(w.measures)}b") if w.measures else "").alias("r_present"), F.lit(promo).alias("r_promo"))
        for bits in range(2 ** len(w.measures))
        for promo in (False, True)
    ]
    reps = _smallest(rsig.select(*_class_of("r_"), F.explode("ords").alias("ord")), ["r_present", "r_promo"], n)
    offered = lsig.select("sig", *_class_of(), F.inline(F.array(*classes)))
    joined = offered.join(F.broadcast(reps), ["r_present", "r_promo"])
    return joined.select("sig", F.explode("ords").alias("ord"), _class_score(w, lambda i: F.lit(False)).alias("score"))


# --- steps ------------------------------------------------------------------


def _rarest_first(
    lrows: DataFrame, rrows: DataFrame, w: Weights, n: int, floor: float | None, hot_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Step 2: its pairs, and the left signatures still open with the features
    they still have to be joined on.

    All right rows with the rarest feature are seen. Of the other features, the
    most frequent ones that together, with the bonus, stay below the n-th best
    score found so far (or below ``floor``) cannot lift an unseen right row into
    the result by themselves, so no join on them is needed. A tie could, as the
    earlier right row wins, so only strictly smaller sums are dropped.
    """
    stats, lpost, rpost = _postings(lrows, rrows, hot_rows, "features-all")
    bonus = F.when(_part(4) == "true", F.lit(w.bonus)).otherwise(F.lit(0.0))
    feature = F.struct((-F.col("rn")).alias("order"), "f", "weight", "hot")
    rarest = F.min(F.when(~F.col("hot"), F.struct("rn", (-F.col("weight")).alias("less"), "f")))
    reach = (
        lpost.withColumn("weight", _feature_weight(w))
        .groupBy("sig")
        .agg(F.sum("weight").alias("total"), rarest.alias("rarest"), F.array_sort(F.collect_list(feature)).alias("items"))
        .select("sig", "items", "total", bonus.alias("bonus"), F.col("rarest.f").alias("pick"))
    )
    if floor is not None:
        reach = reach.where(F.col("total") + F.col("bonus") >= floor)
    reach = stage(reach, "reach")
    picked = reach.where("pick is not null").select("sig", F.col("pick").alias("f"))
    first = stage(_best(_cold_pairs(picked, rpost, stats, w, n), "sig", n), "rarest-best")
    bound = first.where(F.col("rank") == n).select("sig", F.col("score").alias("bound"))

    least = F.coalesce("bound", F.lit(floor).cast("double"), F.lit(float("-inf"))) - F.col("bonus")
    others = F.filter("items", lambda x: F.col("pick").isNull() | (x["f"] != F.col("pick")))
    upto = lambda i: F.aggregate(F.slice("items", 1, i + 1), F.lit(0.0), lambda sum_, x: sum_ + x["weight"])
    needed = F.filter("items", lambda x, i: upto(i) >= F.col("least"))
    kept = F.when(F.exists("needed", lambda x: x["hot"]), F.col("items")).otherwise(F.col("needed"))
    still_open = (
        reach.join(bound, "sig", "left")
        .select("sig", least.alias("least"), others.alias("items"))
        .withColumn("needed", needed)
        .select("sig", F.transform(kept, lambda x: x["f"]).alias("sets"))
        .where(F.size("sets") > 0)
    )
    return first.select("sig", "ord", "score"), stage(still_open, "open-rows")


def _reduced(postings: DataFrame, w: Weights, carried: Sequence[str] = ()) -> DataFrame:
    """Signatures with hot features only: (old, sig, carried columns)."""
    hot = postings.where("hot").groupBy("sig", *carried).agg(F.collect_list("f").alias("_fs"))

    def tagged(tag: str) -> Column:
        return F.transform(F.filter("_fs", lambda f: f.startswith(tag)), lambda f: F.substr(f, F.lit(len(tag) + 1)))

    values = [F.coalesce(F.get(tagged(f"m{i}:"), F.lit(0)), F.lit("")) for i in range(len(w.measures))]
    ms = F.array(*values) if values else F.array().cast("array<string>")
    new = _packed(tagged("t:"), tagged("w:"), ms, _part(3), _part(4))
    return hot.select(F.col("sig").alias("old"), *carried, new.alias("sig"))


def _rows(sigs: DataFrame, w: Weights, *carried: str) -> DataFrame:
    return sigs.select("sig", *carried, _features(w).alias("sets"))


def _open_pairs(lrows: DataFrame, rrows: DataFrame, w: Weights, n: int, hot_rows: int) -> list[DataFrame]:
    """Steps 3 to 5 for the left signatures that are still open."""
    found: list[DataFrame] = []
    owner = None  # (ls, sig): the original signature behind a reduced one

    def add(pairs: DataFrame) -> None:
        if owner is not None:
            best = _best(pairs, "sig", n).drop("rank")
            pairs = keyed_lookup(owner, best, "sig", "ls", "inner").select(F.col("ls").alias("sig"), "ord", "score")
        found.append(pairs)

    for step in range(REDUCTIONS + 1):
        if lrows.isEmpty():
            return found
        stats, lpost, rpost = _postings(lrows, rrows, hot_rows, f"features-{step}")
        add(_cold_pairs(lpost.where("not hot"), rpost, stats, w, n))
        if stats.where("hot").isEmpty():
            return found
        if step == REDUCTIONS:
            break
        rred = _smallest(_reduced(rpost, w, ["ords"]).select("sig", F.explode("ords").alias("ord")), ["sig"], n)
        lred, rred = stage_both((_reduced(lpost, w), f"left-reduced-{step}"), (rred, f"right-reduced-{step}"))
        if owner is None:
            owner = lred.withColumnRenamed("old", "ls")
        else:
            moved = keyed_lookup(owner.withColumnRenamed("sig", "old"), lred, "old", "ls", "inner")
            owner = stage(moved.select("ls", "sig"), f"owners-{step}")
        lrows = _rows(lred.select("sig").distinct(), w)
        rrows = _rows(rred, w, "ords")

    add(_block_pairs(lrows.select("sig"), rrows.select("sig", "ords"), w, n))
    return found


def score_join(
    left: DataFrame,
    right: DataFrame,
    w: Weights,
    n: int = 1,
    floor: float | None = None,
    hot_rows: int = HOT_FEATURE_ROWS,
) -> DataFrame:
    """(lid, ord, score, rank): the best ``n`` right rows per left row.

    ``left``: lid, tokens, ms, promo. ``right``: ord (unique), strong, weak (not
    in strong), ms, promo. ``ms`` has one text per measure, ``''`` if absent.
    With ``floor`` only scores of at least that are kept.
    """
    rows = left.select(
        "lid",
        _packed(F.col("tokens"), F.col("tokens"), F.col("ms"), _presence(F.col("ms")), F.col("promo").cast("string")).alias("sig"),
    )
    packed = right.select(
        "ord",
        _packed(F.col("strong"), F.col("weak"), F.col("ms"), _presence(F.col("ms")), F.col("promo").cast("string")).alias("sig"),
    )
    # names are tokenised once; later steps read narrow tables only
    rows, rsig = stage_both((rows, "left-rows"), (_smallest(packed, ["sig"], n), "right-signatures"))
    lsig = stage(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("copies")), "left-signatures")
    rrows = _rows(rsig, w, "ords")
    pairs, open_rows = _rarest_first(_rows(lsig, w), rrows, w, n, floor, hot_rows)
    for more in _open_pairs(open_rows, rrows, w, n, hot_rows):
        pairs = pairs.unionByName(more)
    if floor is None or floor <= w.nothing_shared:
        pairs = pairs.unionByName(_class_pairs(lsig, rsig, w, n))
    best = _best(pairs, "sig", n)
    if floor is not None:
        best = best.where(F.col("score") >= floor)
    copies = (
        lsig.where(F.col("copies") > HOT_ROWS)
        .select("sig", F.ceil(F.col("copies") / HOT_ROWS).cast("int").alias("_parts"))
    )
    return keyed_lookup(rows, best, "sig", "lid", "inner", hot=copies).select("lid", "ord", "score", "rank")
