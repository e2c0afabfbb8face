"""Mixing sources to target weights with a hypergeometric splitting tree, in DataFrame operations only.

A source's target is reached by taking each of its documents a whole number of times, the same for all but
for the first documents of a random order, which are taken once more. Where that order is cut is found by
sums over ever finer parts of the order, so no source is ever sorted or added up in one task. In the last part
documents are taken in the order too, and the last few are those that still fit; so it is for a source of any size.

Documents lie in blocks, and a block is drawn as often as its documents are taken. A tree over the output
shards splits the draws of all sources: each node gives half of its draws to its left side, and how many of
them come from each source is drawn from the multivariate hypergeometric distribution. So every shard gets
an exact quota of each source, and takes it as the next blocks of the source's permutation; the shards'
draws are disjoint and use up all. Rows are then put in a random order within each shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import discard, staged

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
UNIT = ("source", "doc_id")
# The random order has so many bits, and is refined by DIGIT bits until a part holds about LEAF documents.
BITS, DIGIT, LEAF = 40, 6, 1_024
BLOCK_DOCS, SHARD_WORDS = 128, 1 << 20
# Beyond so many standard deviations and steps from its mode a hypergeometric distribution has less than a double resolves.
SPREADS, STEPS = 10, 10
# Rounds of swaps that permute the draws of a source.
SWAPS = 128
# Nodes of the splitting tree are spread over the tasks anew after so many levels.
SPREAD_LEVELS = 5


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, place, target) from units (source, size), a row for each source.

    Sources by code point, null last, have the weights in turn and share all words; a target stops at
    ``most`` times its source, and what is over goes to the others by weight, until none is above. With the
    sources in the order of most * size / weight, a source is capped exactly if its cap is at most its share
    of what the ones before it leave.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # Windows over one row for each source.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(w) for w in weights))
    rows = rows.withColumn("place", F.row_number().over(by_name)).withColumn("w", F.get(turn, (F.col("place") - 1) % len(weights)))
    ahead = Window.orderBy(F.col("source_size") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))
    share = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0)))
    rows = rows.withColumn("share", share)
    capped = most * F.col("source_size") <= F.col("w") * F.col("share")
    # The first source that isn't capped has the largest share of those.
    level = F.max(F.when(~capped, F.col("share"))).over(everything)
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * level)
    return rows.select("source", "source_size", "n", "place", target.alias("target"))


def mixing_plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: the rows of ``docs`` by size, and the plan for each of their units.

    The first table is (doc_id, source, size), a row for each row of ``docs``. The second is (source, doc_id,
    source_size, target, copies, shards), where ``shards`` has the output shard of each copy. A unit is all
    rows of one source with one id, which are taken together; null sources and ids are a source and an id of
    their own. Null or empty texts have size 0. An empty table has an empty plan.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"))
    rows = staged(rows, "sizes")
    units = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 64 - BITS)
    units = staged(units.select("source", "doc_id", "size", order.alias("u")), "units")
    sources = targets(units)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.withColumn("base", times).withColumn("quota", F.col("target") - F.col("base") * F.col("source_size"))
    state = staged(state.withColumn("depth", F.lit(0)).withColumn("prefix", F.lit(0).cast("long")), "state")
    largest = state.agg(F.max("n")).first()[0] or 0
    depth = 0
    while largest > LEAF << DIGIT * depth and DIGIT * (depth + 1) <= BITS:
        depth += 1
        state = _refined(units, state, depth)
    extra = _in_part("<") | F.col("place_u").isNotNull()
    picked = _picked(units, state)
    met = _matched(_matched(units, state, ("source",)), picked, UNIT, "left")
    bits = F.greatest(F.floor(F.log2(F.col("n") / BLOCK_DOCS)), F.lit(0)).cast("int")
    met = met.withColumn("extra", extra & (F.col("quota") > 0)).withColumn("bits", bits)
    met = met.withColumn("place_u", F.coalesce("place_u", "u"))
    met = met.withColumns({b: _right(u, F.lit(BITS) - F.col("bits")) for b, u in (("block", "u"), ("last_block", "place_u"))})
    keep = ("source", "doc_id", "source_size", "target", "place", "base", "extra", "bits", "block", "last_block")
    met = staged(met.select(*keep, (F.col("base") + F.col("extra").cast("long")).alias("copies")), "taken")
    draws = met.groupBy("place").agg(
        (F.max(F.col("base") * _power("bits")) + F.max(F.when(F.col("extra"), F.col("last_block") + 1).otherwise(0))).alias("draws")
    )
    total = state.agg(F.sum("source_size")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(total, 1) / shard_words)))
    dealt = staged(_deal(draws, levels), "dealt")
    # Which draw of its source a copy of a document is: whole rounds of all blocks, then the blocks taken once more.
    copy = met.select("*", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy")).where("copies > 0")
    number = F.col("copy") * _power("bits") + F.when(F.col("copy") < F.col("base"), F.col("block")).otherwise(F.col("last_block"))
    copy = copy.join(draws, "place").withColumn("draw", _permuted(number, F.col("draws"), F.col("place")))
    copy = copy.join(dealt, ["place", "draw"])
    shards = copy.groupBy("source", "doc_id").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    shards = staged(shards.select("source", "doc_id", F.col("shards.shard").alias("shards")), "shards")
    plan = _matched(met, shards, UNIT, "left")
    none = F.array().cast("array<int>")
    plan = staged(plan.select("source", "doc_id", "source_size", "target", "copies", F.coalesce("shards", none).alias("shards")), "plan")
    discard(units, state, met, dealt, shards)
    return rows, plan


def _matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on equal keys, where nulls are equal to each other; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"right_{k}"))
    return left.join(named, same, how).drop(*(f"right_{k}" for k in keys))


def _right(value: str, bits: Column) -> Column:
    return F.call_function("shiftright", F.col(value), bits)


def _power(bits: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits))


def _in_part(compare: str) -> Column:
    """How the order's part of a unit compares with the part where its source is cut."""
    part = _right("u", F.lit(BITS) - DIGIT * F.col("depth"))
    return part < F.col("prefix") if compare == "<" else part == F.col("prefix")


def _refined(units: DataFrame, state: DataFrame, depth: int) -> DataFrame:
    """Cut the part of every source that still holds many documents one digit finer."""
    coarse = state.where((F.col("quota") > 0) & (F.col("n") > LEAF << DIGIT * (depth - 1))).select("source", "depth", "prefix", "quota")
    digit = F.shiftright("u", BITS - DIGIT * depth).bitwiseAND((1 << DIGIT) - 1)
    inside = _matched(units, coarse, ("source",)).where(_in_part("="))
    sums = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("size"), F.first("quota").alias("quota"))
    # At most 64 rows for each source.
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("digit"))
    sums = sums.withColumn("so_far", so_far).where("so_far > quota")
    cut = sums.groupBy("source").agg(F.min(F.struct("digit", (F.col("so_far") - F.col("size")).alias("before"))).alias("cut"))
    finer = _matched(state, cut, ("source",), "left")
    found = F.col("cut").isNotNull()
    out = staged(
        finer.select(
            *("source", "source_size", "n", "place", "target", "base"),
            F.when(found, F.col("quota") - F.col("cut.before")).otherwise(F.col("quota")).alias("quota"),
            F.when(found, F.lit(depth)).otherwise(F.col("depth")).alias("depth"),
            F.when(found, F.shiftleft("prefix", DIGIT) + F.col("cut.digit")).otherwise(F.col("prefix")).alias("prefix"),
        ),
        "state",
    )
    discard(state)
    return out


def _picked(units: DataFrame, state: DataFrame) -> DataFrame:
    """(source, doc_id, place_u): units of the part that is cut that fill its quota, in the order.

    One that is longer than what is left is passed over, so sizes decide on the last few alone. Those that are
    taken when less than a mean unit is left have the place in the order where that began, and so open no block.
    """
    cut = state.where("quota > 0").select("source", "depth", "prefix", "quota")
    inside = _matched(units, cut, ("source",)).where(_in_part("="))
    # About LEAF units for each source.
    group = inside.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("u", "size", "doc_id"))).alias("all"), F.first("quota").alias("quota"), F.avg("size").alias("mean")
    )
    begin = F.get("all", 0)
    none = F.transform(F.filter("all", lambda x: F.lit(False)), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["u"].alias("place_u")))
    start = F.struct(F.col("quota").alias("left"), begin["u"].alias("end"), none.alias("taken"))

    def take(so_far, unit):
        early = so_far["left"] >= F.col("mean")
        fits = (unit["size"] <= so_far["left"]) & ((unit["size"] > 0) | early)
        end = F.when(early, unit["u"]).otherwise(so_far["end"])
        own = F.struct(unit["doc_id"].alias("doc_id"), F.least(unit["u"], end).alias("place_u"))
        return F.struct(
            F.when(fits, so_far["left"] - unit["size"]).otherwise(so_far["left"]).alias("left"),
            end.alias("end"),
            F.when(fits, F.concat(so_far["taken"], F.array(own))).otherwise(so_far["taken"]).alias("taken"),
        )

    taken = group.select("source", F.explode(F.aggregate("all", start, take)["taken"]).alias("x"))
    return taken.select("source", F.col("x.doc_id").alias("doc_id"), F.col("x.place_u").alias("place_u"))


def _permuted(number: Column, draws: Column, place: Column) -> Column:
    """A pseudo-random permutation of 0 to draws - 1 for each source.

    Swap-or-not rounds: each pairs x with (key - x) mod draws and swaps the two or not, by a hash of the larger.
    A round is its own inverse, so all of them together are a permutation for any number of draws.
    """

    def bits(round_: Column, *of: Column) -> Column:
        return F.xxhash64(F.lit(SEED), F.lit("swap"), place, round_, *of)

    def swap(x: Column, round_: Column) -> Column:
        other = F.pmod(F.pmod(bits(round_), draws) - x, draws)
        return F.when(bits(round_, F.greatest(x, other)) < 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), number.cast("long"), swap)


def _deal(draws: DataFrame, levels: int) -> DataFrame:
    """(place, draw, shard): the draws of each source dealt to 2 ** levels shards by the splitting tree."""
    # One row for each node, with an entry for each source.
    node = draws.agg(F.sort_array(F.collect_list(F.struct("place", "draws"))).alias("all"))
    node = node.select(F.lit(1).cast("long").alias("node"), F.transform("all", lambda s: F.struct(s["place"].alias("place"), s["draws"].alias("n"), F.lit(0).cast("long").alias("first"))).alias("quota"))
    for level in range(levels):
        if level and level % SPREAD_LEVELS == 0:
            node = node.repartition("node")
        split = node.select("node", "quota", _left_counts(F.col("node"), F.col("quota")).alias("left"))
        both = F.array(F.struct((2 * F.col("node")).alias("node"), _side(True).alias("quota")), F.struct((2 * F.col("node") + 1).alias("node"), _side(False).alias("quota")))
        node = split.select(F.explode(both).alias("child")).select("child.*")
    leaf = node.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.explode("quota").alias("q")).where("q.n > 0")
    return leaf.select(F.col("q.place").alias("place"), F.explode(F.sequence(F.col("q.first"), F.col("q.first") + F.col("q.n") - 1)).alias("draw"), "shard")


def _side(left: bool) -> Column:
    def entry(quota, n):
        first = quota["first"] if left else quota["first"] + n
        return F.struct(quota["place"].alias("place"), (n if left else quota["n"] - n).alias("n"), first.alias("first"))

    return F.zip_with("quota", "left", entry)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _left_counts(node: Column, quota: Column) -> Column:
    """How many of a node's draws go left for each source: half of all, by source hypergeometric."""
    zero = F.lit(0).cast("long")
    total = F.aggregate(quota, zero, lambda n, q: n + q["n"])

    def split(whole: Column) -> Column:
        start = F.struct(whole.alias("rest"), F.floor(whole / 2).alias("left"), F.array().cast("array<bigint>").alias("out"))

        def draw(so_far, q):
            n = _hypergeometric(so_far["rest"], q["n"], so_far["left"], _uniform(node, q["place"]))
            return _bind(n, lambda x: F.struct((so_far["rest"] - q["n"]).alias("rest"), (so_far["left"] - x).alias("left"), F.concat(so_far["out"], F.array(x)).alias("out")))

        return F.aggregate(quota, start, draw)["out"]

    return _bind(total, split)


def _uniform(node: Column, place: Column) -> Column:
    """A number between 0 and 1 that depends on its arguments alone."""
    return (F.pmod(F.xxhash64(F.lit(SEED), node, place), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``marked`` among ``total`` are drawn, by inverting the distribution at ``uniform``.

    Marked and unmarked, drawn and left are swapped so that both are at most half, which makes 0 possible.
    """
    half = F.struct(
        *(total.alias("n"), marked.alias("marked"), drawn.alias("drawn"), uniform.alias("u")),
        *(F.least(marked, total - marked).alias("a"), F.least(drawn, total - drawn).alias("b")),
    )

    def small(s: Column) -> Column:
        value = F.struct(
            *(s[c].alias(c) for c in ("n", "marked", "drawn", "u", "a", "b")),
            *(F.least(s["a"], s["b"]).alias("lo"), F.greatest(s["a"], s["b"]).alias("hi")),
        )
        return _bind(value, drawn_of)

    def drawn_of(s: Column) -> Column:
        x = F.when(s["lo"] == 0, F.lit(0).cast("long")).otherwise(_inverted(s))
        return _bind(x, lambda x: _unswapped(s, x))

    return _bind(half, small)


def _unswapped(s: Column, x: Column) -> Column:
    """``x`` of the smaller kind are on the smaller side; the marked ones that are drawn."""
    on_drawn = F.when(s["drawn"] == s["b"], x).otherwise(s["a"] - x)
    return F.when(s["marked"] == s["a"], on_drawn).otherwise(s["drawn"] - on_drawn)


def _inverted(s: Column) -> Column:
    """The distribution of ``lo`` marked and ``hi`` drawn among n, inverted at u from its mode outwards.

    Weights relative to the mode's follow from each other by ratios, one step up and one down at a time. Their sum
    stands for the whole, so no factorial is needed, and steps grow with the standard deviation alone.
    """
    n, lo, hi = s["n"].cast("double"), s["lo"].cast("double"), s["hi"].cast("double")
    share = hi / n
    spread = F.sqrt(lo * share * (1 - share) * (n - lo) / F.greatest(n - 1, F.lit(1.0)))
    reach = F.least(F.ceil(SPREADS * spread) + STEPS, s["lo"])
    shape = F.struct(F.floor((lo + 1) * ((hi + 1) / (n + 2))).alias("mode"), reach.alias("reach"))

    def search(t: Column) -> Column:
        mode, steps = t["mode"].cast("double"), F.sequence(F.lit(1).cast("long"), t["reach"])

        def up(p: Column, i: Column) -> Column:
            x = mode + i
            return F.when(x <= lo, p * ((lo - x + 1) / x) * ((hi - x + 1) / (n - lo - hi + x))).otherwise(0.0)

        def down(p: Column, i: Column) -> Column:
            x = mode - i
            return F.when(x >= 0, p * ((x + 1) / (lo - x)) * ((n - lo - hi + x + 1) / (hi - x))).otherwise(0.0)

        one = F.lit(1.0)
        start = F.struct(one.alias("up"), one.alias("down"), one.alias("below"))

        def add(w: Column, i: Column) -> Column:
            return F.struct(
                up(w["up"], i).alias("up"), down(w["down"], i).alias("down"), (w["below"] + up(w["up"], i) + down(w["down"], i)).alias("below")
            )

        def find(sought: Column) -> Column:
            first = F.struct(
                one.alias("up"), one.alias("down"), one.alias("below"), F.when(sought <= 1, t["mode"]).otherwise(F.lit(-1).cast("long")).alias("x")
            )

            def step(w: Column, i: Column) -> Column:
                risen = w["below"] + up(w["up"], i)
                both = risen + down(w["down"], i)
                x = F.when(w["x"] >= 0, w["x"]).when(sought <= risen, t["mode"] + i).when(sought <= both, t["mode"] - i).otherwise(F.lit(-1).cast("long"))
                return F.struct(up(w["up"], i).alias("up"), down(w["down"], i).alias("down"), both.alias("below"), x.alias("x"))

            found = F.aggregate(steps, first, step)["x"]
            return _bind(found, lambda x: F.when(x >= 0, x).otherwise(t["mode"]))

        whole = F.aggregate(steps, start, add)["below"]
        return _bind(s["u"] * whole, find)

    return _bind(shape, search)


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, taken, copies and shards of the plan.

    ``taken`` is the size times the copies, 0 to MOST_COPIES of them. Other columns aren't read.
    """
    rows, plan = mixing_plan(docs, doc_id, text, source)
    met = _matched(rows, plan, UNIT)
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed rows themselves: the columns of ``docs`` with mix_copy, mix_shard and mix_order.

    Every row comes as often as the plan takes it, shards in partitions of their own and shuffled within.
    A column of ``docs`` that has one of the three names is replaced.
    """
    _, plan = mixing_plan(docs, doc_id, text, source, shard_words)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keyed = rows.select("row", F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{source}`").alias("source"))
    # Merged at every size: a broadcast of the plan would grow with the documents.
    met = _matched(keyed, plan.where("copies > 0").select("doc_id", "source", "shards").hint("merge"), UNIT)
    copies = met.select("row", F.posexplode("shards").alias("mix_copy", "mix_shard"))
    order = F.xxhash64(F.lit(SEED), "mix_shard", "mix_copy", f"row.`{doc_id}`")
    out = copies.withColumn("mix_order", order).repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("mix_copy", "mix_shard", "mix_order")]
    return out.select(*own, "mix_copy", "mix_shard", "mix_order")
