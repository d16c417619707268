"""Searches over store tables for targets that a customer can name without an id.

Products, option values and users can be hot, so searches keep a few extreme rows or counts per group
and never list the pairs of a group."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import calls as C
from tracemill.functions import text as X
from tracemill.operators import skew
from tracemill.session import materialise, sized

# fixed values: the order status each write needs, and word scales that have an order
NEEDS = {"return_delivered_order_items": "delivered", "exchange_delivered_order_items": "delivered", "cancel_pending_order": "pending",
         "modify_pending_order_items": "pending", "modify_pending_order_address": "pending", "modify_pending_order_payment": "pending"}
WORD_SCALES = [["small", "medium", "large"], ["low", "medium", "high"], ["basic", "professional"], ["beginner", "intermediate", "expert"],
               ["standard", "high-back"], ["half", "full"], ["S", "M", "L", "XL", "XXL"], ["1080p", "2K", "4K", "5K"], ["i3", "i5", "i7", "i9"]]
# fixed values: units of option values and their factors
UNITS = {"gb": 1, "tb": 1024, "ml": 1, "l": 1000, "liter": 1000, "liters": 1000, "cup": 1, "cups": 1, "mah": 1, "mp": 1, "inch": 1, "inches": 1, "ft": 1,
         "hours": 1, "mm": 1, "bar": 1, "x": 1, "degrees": 1, "w": 1, "lbs": 1, "": 1}


# ------------------------------------------------------------------ extremes and unique descriptions

def extremes(df: DataFrame, keys: list[str], value: str, id_col: str, n: int, largest: bool, out: str) -> DataFrame:
    """The n smallest or largest (value, id) per key. The rank filter is pushed below the shuffle, so a hot
    key sends n rows per partition."""
    order = [F.desc(value) if largest else F.asc(value), F.asc(id_col)]
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.select(*keys, value, id_col).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v"), F.col(id_col).alias("id")))).alias(out))


def option_pools(variants: DataFrame) -> DataFrame:
    """Available variants once for their whole product (k = v = '*') and once per option value."""
    every = F.array(F.struct(F.lit("*").alias("key"), F.lit("*").alias("value")))
    pools = F.concat(every, F.map_entries("options"))
    return variants.where("available").select("product", "item_id", "price", F.explode(pools).alias("p")).select(
        "product", F.col("p.key").alias("k"), F.col("p.value").alias("v"), "item_id", "price")


def _alone_at_end(tops: Column, old: Column, new: Column) -> Column:
    """``new`` is strictly first once ``old`` is left out; three entries are enough to tell."""
    rest = F.filter(tops, lambda t: t["id"] != old)
    a, b = F.try_element_at(rest, F.lit(1)), F.try_element_at(rest, F.lit(2))
    return F.coalesce((a["id"] == new) & (b.isNull() | (a["v"] != b["v"])), F.lit(False))


def vague_phrase(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """For (old, new) pairs: the first description that picks out exactly the new variant among the
    available ones other than the old: cheapest or dearest, overall or with one of its option values."""
    pools = option_pools(variants)
    ends = extremes(pools, ["product", "k", "v"], "price", "item_id", 3, False, "low").join(
        extremes(pools, ["product", "k", "v"], "price", "item_id", 3, True, "high"), ["product", "k", "v"])
    new = variants.where("available").select(F.col("item_id").alias("new_id"), "product", "options")
    q = pairs.where("old_id <> new_id").join(new, "new_id")
    tried = F.concat(F.array(F.struct(F.lit("*").alias("key"), F.lit("*").alias("value"))), F.array_sort(F.map_entries("options")))
    q = q.select("old_id", "new_id", "product", F.posexplode(tried).alias("rank", "p")).select(
        "old_id", "new_id", "product", "rank", F.col("p.key").alias("k"), F.col("p.value").alias("v"))
    j = q.join(ends, ["product", "k", "v"])
    end = (F.when(_alone_at_end(F.col("low"), F.col("old_id"), F.col("new_id")), "cheapest")
           .when(_alone_at_end(F.col("high"), F.col("old_id"), F.col("new_id")), "most expensive"))
    phrase = F.concat(F.lit("the "), F.col("end"), F.when(F.col("k") == "*", " available option").otherwise(
        F.concat(F.lit(" available one with "), F.col("k"), F.lit(" "), F.col("v"))))
    hit = j.withColumn("end", end).where("end is not null").groupBy("old_id", "new_id").agg(F.min_by(phrase, "rank").alias("phrase"))
    return pairs.join(hit, ["old_id", "new_id"], "left")


def single_option_neighbour(variants: DataFrame) -> DataFrame:
    """Per variant, the first option (by name) and smallest other value for which exactly one available
    variant equals it in everything else; with how many rivals share that value."""
    def rows(df):
        return df.select("product", "item_id", "price", "options", F.explode(F.map_entries("options")).alias("o")).select(
            "product", "item_id", "price", F.col("o.key").alias("k"), F.col("o.value").alias("v"),
            F.to_json(F.map_filter("options", lambda k, _: k != F.col("o.key"))).alias("rest"))
    unique = variants.where("available").groupBy("product", F.to_json("options").alias("sig")).agg(
        F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id"), F.min("price").alias("price"), F.first("options").alias("options")).where("n = 1")
    two = extremes(rows(unique), ["product", "k", "rest"], "v", "item_id", 2, False, "near")
    rivals = option_pools(variants).where("k <> '*'").groupBy("product", "k", "v").agg(F.count(F.lit(1)).alias("same"))
    me = rows(variants).join(two, ["product", "k", "rest"])
    pick = F.try_element_at(F.filter("near", lambda t: t["v"] != F.col("v")), F.lit(1))
    me = me.withColumn("g", pick).where("g is not null").select("product", "item_id", "k", F.col("g.v").alias("v"), F.col("g.id").alias("to_id"))
    first = me.groupBy("product", "item_id").agg(F.min(F.struct("k", "v", "to_id")).alias("m")).select("product", "item_id", "m.*")
    return first.join(rivals, ["product", "k", "v"]).select("item_id", "k", "v", "to_id", (F.col("same") - 1).alias("rivals"))


def measure(value: Column) -> Column:
    """Numeric size of an option value: number times unit factor; ranges like "10-20 lbs" by their start;
    null when the unit is unknown."""
    shape = r"(\d+(?:\.\d+)?)\s*-?\s*([a-zA-Z]*)(?: SSD)?(?:-\d+ lbs)?"
    v = F.trim(value)
    number = F.regexp_extract(v, f"^{shape}$", 1)
    unit = F.lower(F.regexp_extract(v, f"^{shape}$", 2))
    factors = F.create_map(*[F.lit(x) for unit_of, factor in UNITS.items() for x in (unit_of, float(factor))])
    pounds = F.nullif(F.regexp_extract(v, r"^(\d+)-\d+ lbs$", 1), F.lit(""))
    return F.coalesce(F.nullif(number, F.lit("")).cast("double") * F.try_element_at(factors, unit), pounds.cast("double"))


def word_rank(value: Column, scale: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(w) for w in scale]), value), F.lit(0)).cast("double")


def ordered_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of each distinct value of an option within ``keys`` (columns keys..., v), or no rows when the
    values have no order: all in one word scale, else all measurable and pairwise different."""
    d = values.select(*keys, "v").distinct()
    ranks = [word_rank(F.col("v"), s) for s in WORD_SCALES]
    d = d.select("*", F.array(*ranks).alias("w"), measure(F.col("v")).alias("m"))
    ok = d.groupBy(*keys).agg(*[F.bool_and(F.col("w")[i].isNotNull()).alias(f"s{i}") for i in range(len(WORD_SCALES))],
                              (F.bool_and(F.col("m").isNotNull()) & (F.count_distinct("m") == F.count(F.lit(1)))).alias("num"))
    pick = F.lit(None).cast("double")
    for i in reversed(range(len(WORD_SCALES))):
        pick = F.when(F.col(f"s{i}"), F.col("w")[i]).otherwise(pick)
    word = F.array(*[F.col(f"s{i}") for i in range(len(WORD_SCALES))])
    j = d.join(ok, keys).withColumn("x", F.when(F.array_contains(word, True), pick).when(F.col("num"), F.col("m"))).where("x is not null")
    w = Window.partitionBy(*keys).orderBy("x")  # distinct values of one option
    return j.select(*keys, "v", F.row_number().over(w).alias("rank"), F.lead("v").over(w).alias("up"), F.lag("v").over(w).alias("down"))


def next_rank_neighbour(variants: DataFrame, key: str) -> DataFrame:
    """The variant one step up (or, failing that, down) in an ordered option, all else equal and unique."""
    rest = F.to_json(F.map_filter("options", lambda k, _: k != key))
    flat = variants.select("product", "item_id", "available", F.col("options")[key].alias("v"), rest.alias("rest"))
    ranks = ordered_values(flat.where("v is not null"), ["product"])
    unique = flat.where("available").groupBy("product", "rest", "v").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("id")).where("n = 1").drop("n")
    me = flat.join(ranks, ["product", "v"])
    for side in ("up", "down"):
        me = me.join(unique.select("product", "rest", F.col("v").alias(side), F.col("id").alias(f"{side}_id")), ["product", "rest", side], "left")
    return me.select("item_id", F.coalesce("up_id", "down_id").alias("to_id"),
                     F.when(F.col("up_id").isNotNull(), "up").otherwise("down").alias("step")).where("to_id is not null")


# ------------------------------------------------------------------ orders

def _orders_with(items: DataFrame, rows: int | None) -> DataFrame:
    """(user_id, product, status, order_id), each once; for about ``rows`` items over as many tasks as these need."""
    keys = ["user_id", "product", "status", "order_id"]
    o = items.select(*keys)
    return (sized(o, rows, *keys) if rows else o).distinct()


def decoy_orders(items: DataFrame, statuses: list[str], rows: int | None = None) -> DataFrame:
    """Orders that are the user's only one with a product in their status although other orders of the user
    hold the product too: naming the product alone forces a status check. Status counts replace the
    self-join of a user's orders. ``rows``: about how many items there are. Orders are counted by a salt of their id first, so
    that a pair of user and product sends one row a salt and status to its task."""
    keys = ["user_id", "product", "status"]
    o = items.select(*keys, "order_id", F.pmod(F.xxhash64("order_id"), F.lit(skew.SALTS)).alias("_salt"))
    part = (sized(o, rows, *keys, "_salt") if rows else o).distinct().groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("order_id"))
    per = (sized(part, rows, *keys[:2]) if rows else part).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("order_id").alias("order_id"))
    having = per.withColumn("having", F.sum("n").over(Window.partitionBy(*keys[:2])))             # a row a status
    return having.where(F.col("user_id").isNotNull() & F.col("product").isNotNull() & F.col("status").isin(statuses) & (F.col("n") == 1) & (F.col("having") > 1)).select(
        "order_id", "product", "status", (F.col("having") - 1).alias("decoys"))


def earlier_twins(items: DataFrame, rows: int | None = None) -> DataFrame:
    """Items whose product is also in an earlier order of the same user and status; the count of such
    orders comes from a running count per (user, product, status). ``rows``: about how many items there are."""
    o = materialise(_orders_with(items, rows), "orders-with")
    r = skew.position(o, ["user_id", "product", "status"], [F.col("order_id")], skew.evenly(o, "order_id"), "_n", rows=rows)
    return r.where("_n > 1").select("order_id", "product", "status", (F.col("_n") - 1).alias("decoys"))


def twin_items(items: DataFrame) -> DataFrame:
    """Orders holding exactly two different variants of a product, with the first option that tells them
    apart."""
    per = items.groupBy("order_id", "product").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("item_id", F.to_json("options").alias("o"))).alias("a"), F.max(F.struct("item_id", F.to_json("options").alias("o"))).alias("b"))
    opts = lambda s: F.from_json(F.col(f"{s}.o"), "map<string,string>")
    t = per.where("n = 2 and a.item_id <> b.item_id").withColumn("key", F.try_element_at(C.differing_options(opts("a"), opts("b")), F.lit(1)))
    return t.where("key is not null").select("order_id", "product", F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), "key",
                                             opts("a")[F.col("key")].alias("value_a"), opts("b")[F.col("key")].alias("value_b"))


def unique_destination(orders: DataFrame) -> DataFrame:
    """Orders whose city no other order of the user has, for users with several cities."""
    per = orders.groupBy("user_id", "city").agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("order_id"))
    several = per.groupBy("user_id").agg(F.count(F.lit(1)).alias("cities")).where("cities > 1").select("user_id")
    return per.where("n = 1").join(several, "user_id", "left_semi").select("order_id", "user_id", "city")


def product_totals(items: DataFrame, blocked: Column) -> DataFrame:
    """Total price of a product over all of a user's orders, where it was bought twice or more and no such
    order is in a blocked state."""
    return items.groupBy("user_id", "product").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"), F.bool_or(blocked).alias("bad")).where(
        "n >= 2 and not bad").select("user_id", "product", "n", X.money(F.col("total")).alias("total"))


def same_as_other_order(items: DataFrame) -> DataFrame:
    """Items whose product sits, as another available variant, in exactly one item of the user's other
    orders. Per (user, product) the two smallest item rows decide, so no pairs are listed."""
    per = items.groupBy("user_id", "product").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("order_id", "pos", "item_id", "available")).alias("a"),
                                                  F.max(F.struct("order_id", "pos", "item_id", "available")).alias("b"))
    two = per.where("n = 2 and a.order_id <> b.order_id and a.item_id <> b.item_id")
    both = F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other"))))
    return two.select("product", both.alias("x")).where("x.other.available").select(
        F.col("x.me.order_id").alias("order_id"), F.col("x.me.item_id").alias("item_id"), F.col("x.other.order_id").alias("from_order"), F.col("x.other.item_id").alias("to_id"))


def conflict_requests(items: DataFrame, variants: DataFrame) -> DataFrame:
    """For delivered orders with a return (flag R): another item, of a product occurring once in the order
    and not returned, together with the cheapest available alternative when that is unique."""
    per = items.where("status = 'delivered'").groupBy("order_id", "product").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("flag") == "R").alias("returned"), F.min("pos").alias("pos"), F.min("item_id").alias("item_id"))
    cand = per.groupBy("order_id").agg(F.bool_or("returned").alias("asked"), F.min(F.when(F.expr("n = 1 and not returned"), F.struct("pos", "item_id", "product"))).alias("x")).where(
        "order_id is not null and asked and x is not null").select("order_id", "x.*")
    low = extremes(option_pools(variants).where("k = '*'"), ["product"], "price", "item_id", 3, False, "low")
    rest = F.filter("low", lambda t: t["id"] != F.col("item_id"))
    a, b = F.try_element_at(rest, F.lit(1)), F.try_element_at(rest, F.lit(2))
    return cand.join(low, "product").where(a.isNotNull() & (b.isNull() | (a["v"] != b["v"]))).select("order_id", "item_id", a["id"].alias("to_id"))


def choices(items: DataFrame, variants: DataFrame, u: Column, least: int = 2, most: int = 4) -> DataFrame:
    """List-and-choose targets: per item one option value of its product, picked by ``u`` in [0, 1), that
    2-4 available alternatives share at different prices. Pools are counted first and listed only when
    that small; an item joins its one pool by number, so items and pools are never multiplied."""
    pools = option_pools(variants).where("k <> '*'")
    small = pools.groupBy("product", "k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most + 1)).drop("n")
    small = small.withColumn("d", F.md5(F.concat_ws(":", "k", "v")))
    numbered = skew.position(small, ["product"], [F.col("d"), F.col("k")], skew.hash_chunk(F.col("d"), 3), "no").drop("d")
    sizes = numbered.groupBy("product").agg(F.max("no").alias("pools"))
    lists = pools.join(numbered, ["product", "k", "v"]).groupBy("product", "k", "v", "no").agg(F.array_sort(F.collect_list(F.struct("price", "item_id"))).alias("all"))
    once = items.groupBy("order_id", "product").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id")).where("n = 1").drop("n")
    j = once.join(sizes, "product").withColumn("no", F.floor(u * F.col("pools")).cast("bigint") + 1).join(lists, ["product", "no"])
    j = j.withColumn("rest", F.filter("all", lambda x: x["item_id"] != F.col("item_id"))).where(
        F.size("rest").between(least, most) & (F.size(F.array_distinct(F.transform("rest", lambda x: x["price"]))) == F.size("rest")))
    return j.select("order_id", "item_id", "k", "v", F.element_at("rest", 1)["item_id"].alias("cheapest"), F.element_at("rest", -1)["item_id"].alias("dearest"),
                    F.array_join(F.transform("rest", lambda x: X.trimmed_money(x["price"])), ", ").alias("prices"))


def bundles(writes: DataFrame, digest: Column, orders_per_user: int = 3, least: int = 3, most: int = 5) -> DataFrame:
    """Per user, orders among up to three hash-picked ones whose writes add up to 3-5: the largest set of at
    least two that fits, the earliest picks first. Input: user_id, order_id, n (writes of the order). The
    pick is pushed below the shuffle."""
    w = Window.partitionBy("user_id").orderBy("_d", "order_id")
    p = writes.withColumn("_d", digest).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= orders_per_user)
    picks = p.groupBy("user_id").agg(*[F.max(F.when(F.col("_r") == i, F.struct("order_id", "n"))).alias(f"_p{i}") for i in range(1, orders_per_user + 1)])
    fits = F.lit(None)
    for size in range(2, orders_per_user + 1):
        for chosen in reversed(list(combinations(range(1, orders_per_user + 1), size))):
            own = F.array(*[F.col(f"_p{i}") for i in chosen])
            writes_of = sum((F.col(f"_p{i}.n") for i in chosen[1:]), F.col(f"_p{chosen[0]}.n"))
            fits = F.when(writes_of.between(least, most), own).otherwise(fits)
    ids = F.transform("_own", lambda x: x["order_id"])
    return picks.withColumn("_own", fits).where("_own is not null").select(
        "user_id", F.size("_own").cast("bigint").alias("orders"), F.aggregate("_own", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("writes"),
        F.array_min(ids).alias("first_order"), F.array_max(ids).alias("last_order"))


def amounts(items: DataFrame) -> DataFrame:
    """What each order's request moves: everything for a cancellation, the returned items for a return, the
    price difference for a swap (charged or refunded)."""
    a = items.groupBy("order_id", "action").agg(
        F.sum("price").alias("all"), F.sum(F.when(F.col("chosen"), F.col("price"))).alias("part"), F.sum(F.when(F.col("chosen"), F.col("new_price") - F.col("price"))).alias("diff"))
    amt = F.when(F.col("action") == "cancel", F.col("all")).when(F.col("action") == "return", F.col("part")).otherwise(F.abs("diff"))
    verb = F.when((F.col("action") == "swap") & (F.col("diff") > 0), "charged").otherwise("refunded")
    return a.withColumn("amount", amt).where(F.col("amount") >= 0.01).select("order_id", "action", verb.alias("verb"), X.money(F.col("amount")).alias("amount"), "diff")


def affordable(source: Column, diff: Column, balance: Column) -> Column:
    """A gift card must cover the difference; other methods always do."""
    return ~((source == "gift_card") & (F.coalesce(diff, F.lit(0.0)) > F.coalesce(balance, F.lit(0.0))))


def variant_outcomes(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """What the agent swapped each item to against gold: exact, wrong variant, other product, not swapped;
    for wrong variants the option closeness, the closeness a random other variant would have, and the
    bonus above chance. Chance is a mean over the product's variants, taken from option-value counts (the
    variants of a product carry the same option names), not from pairs."""
    v = variants.select("item_id", "product", "options")
    gold = v.select(F.col("item_id").alias("gold_id"), F.col("product").alias("gp"), F.col("options").alias("go"))
    agent = v.select(F.col("item_id").alias("agent_id"), F.col("product").alias("ap"), F.col("options").alias("ao"))
    counts = variants.select("product", F.explode(F.map_entries("options")).alias("o")).groupBy("product", F.col("o.key").alias("k"), F.col("o.value").alias("v")).agg(F.count(F.lit(1)).alias("same"))
    size = variants.groupBy("product").agg(F.count(F.lit(1)).alias("n_variants"))
    # per gold variant: how many option values all variants of its product share with it in sum
    shared = pairs.select("gold_id").distinct().join(gold, "gold_id").select("gold_id", F.col("gp").alias("product"), F.explode(F.map_entries("go")).alias("o")).select(
        "gold_id", "product", F.col("o.key").alias("k"), F.col("o.value").alias("v")).join(counts, ["product", "k", "v"]).groupBy("gold_id", "product").agg(
        F.sum("same").alias("shared"), F.count(F.lit(1)).alias("keys")).join(size, "product").drop("product")
    j = pairs.join(gold, "gold_id").join(shared, "gold_id").join(agent, "agent_id", "left")
    cls = (F.when(F.col("agent_id").isNull(), "not swapped").when(F.col("agent_id") == F.col("gold_id"), "exact")
           .when(F.col("ap").isNull() | (F.col("ap") != F.col("gp")), "other product").otherwise("wrong variant"))
    close = C.option_closeness(F.col("ao"), F.col("go"))
    others = F.col("n_variants") - 2
    chance = F.when(others > 0, ((F.col("shared") - F.col("keys")) / F.col("keys") - close) / others).otherwise(0.0)
    j = j.withColumn("outcome", cls).withColumn("closeness", F.when(F.col("outcome") == "wrong variant", close)).withColumn(
        "chance", F.when(F.col("outcome") == "wrong variant", chance))
    bonus = F.when(F.col("chance") < 1, F.greatest(F.lit(0.0), (F.col("closeness") - F.col("chance")) / (1 - F.col("chance")))).otherwise(0.0)
    return j.select(*pairs.columns, "outcome", "closeness", "chance", F.when(F.col("outcome") == "wrong variant", bonus).alias("bonus"))


def pair_tasks(tasks: DataFrame, user: str, task: str, target: str) -> DataFrame:
    """Same-customer pairs of tasks with different targets, each task used once, taken greedily in task
    order. The choice is sequential by definition, so each user's tasks are scanned in order inside a
    sorted partition; the scan keeps only tasks still waiting, which all share one target."""
    from collections import deque

    import pandas as pd

    ordered = tasks.select(user, task, target).repartition(user).sortWithinPartitions(user, task)

    def scan(batches):
        who, waiting = None, deque()
        for pdf in batches:
            out = []
            for u, t, g in pdf.itertuples(index=False):
                if u != who:
                    who, waiting = u, deque()
                if waiting and waiting[0][1] != g:
                    out.append((u, waiting.popleft()[0], t))
                else:
                    waiting.append((t, g))
            if out:
                yield pd.DataFrame(out, columns=[user, "first", "second"])
    kind = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInPandas(scan, f"{user} {kind[user]}, first {kind[task]}, second {kind[task]}")


def replayed(items: Column, actions: Column) -> Column:
    """The items of a state after (old, new) replacements in list order; each takes the first item equal to ``old``, one
    that is not there changes nothing. Both arrays belong to one order, so this is row-local."""
    def step(state: Column, a: Column) -> Column:
        def put(at: Column) -> Column:
            rest = F.greatest(F.size(state) - at, F.lit(0))
            return F.when(at > 0, F.concat(F.slice(state, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(a["new"]), F.slice(state, at + 1, rest))).otherwise(state)
        return C.once(F.array_position(state, a["old"]).cast("int"), put)
    return F.aggregate(actions, items, step)


def state_digest(items: Column) -> Column:
    """A digest of a state that its listing order does not change: the number of items and sums of two 40-bit pieces of their md5,
    read once. Digests of parts add up, and replacing an item adds the difference of two digests (``digest_change``)."""
    def add(s: Column, h: Column) -> Column:
        return F.struct(*[(s[f"d{i}"] + F.conv(F.substring(h, 10 * i - 9, 10), 16, 10).cast("bigint")).alias(f"d{i}") for i in (1, 2)])
    zero = F.struct(F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"))
    return C.once(items, lambda own: F.aggregate(F.transform(own, lambda x: F.md5(x)), zero, add, lambda s: F.struct(
        F.size(own).cast("bigint").alias("n"), s["d1"].alias("d1"), s["d2"].alias("d2"))))


def digest_change(digest: Column, old: Column, new: Column) -> Column:
    """The digest after items of the array ``old`` were replaced by those of ``new``, without reading the state again."""
    a, b = state_digest(old), state_digest(new)
    return F.struct(*[(digest[k] - a[k] + b[k]).alias(k) for k in ("n", "d1", "d2")])
