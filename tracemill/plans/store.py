"""Store-search queries: parts are variants, orders are orders, lines are items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import hashing as H
from tracemill.functions import text as X
from tracemill.operators import skew
from tracemill.operators import store as S
from tracemill.plans.difficulty import uniform_sql
from tracemill.plans.registry import query, r6
from tracemill.session import sized
from tracemill.sources import tables as T

V = T.with_sql(T.VARIANTS_SQL)
I = T.with_sql(T.ITEMS_SQL)  # noqa: E741


def _next_pairs(spark, d):
    """Each variant paired with the next one of its product."""
    v = T.variants(spark, d).select("product", "item_id")
    n = skew.position(v, ["product"], [F.col("item_id")], skew.evenly(v, "item_id"), "n")
    nxt = n.select("product", (F.col("n") - 1).alias("n"), F.col("item_id").alias("new_id"))
    return n.select("product", "n", F.col("item_id").alias("old_id")).join(nxt, ["product", "n"]).select("old_id", "new_id")


@query("vague_targets", V + """, pairs AS (SELECT * FROM (SELECT product, item_id AS old_id, lead(item_id) OVER (PARTITION BY product ORDER BY item_id) AS new_id FROM variants) WHERE new_id IS NOT NULL),
c AS (SELECT p.old_id, p.new_id, g.name AS gn, g.size AS gs, g.price AS gp, v.* FROM pairs p JOIN variants g ON g.item_id = p.new_id AND g.available
  JOIN variants v ON v.product = p.product AND v.available AND v.item_id <> p.old_id),
s AS (SELECT old_id, new_id, any_value(gn) AS gn, any_value(gs) AS gs, any_value(gp) AS gp,
  count(*) FILTER (price <= gp) AS lo, count(*) FILTER (price >= gp) AS hi, count(*) FILTER (price <= gp AND name = gn) AS lo_n, count(*) FILTER (price >= gp AND name = gn) AS hi_n,
  count(*) FILTER (price <= gp AND size = gs) AS lo_s, count(*) FILTER (price >= gp AND size = gs) AS hi_s FROM c GROUP BY ALL)
SELECT pairs.old_id, pairs.new_id, CASE WHEN lo = 1 THEN 'the cheapest available option' WHEN hi = 1 THEN 'the most expensive available option'
  WHEN lo_n = 1 THEN 'the cheapest available one with name ' || gn WHEN hi_n = 1 THEN 'the most expensive available one with name ' || gn
  WHEN lo_s = 1 THEN 'the cheapest available one with size ' || gs WHEN hi_s = 1 THEN 'the most expensive available one with size ' || gs END AS phrase
FROM pairs LEFT JOIN s USING (old_id, new_id)""")
def vague_targets(spark, d):
    return S.vague_phrase(_next_pairs(spark, d), T.variants(spark, d))


@query("single_option_neighbours", V + """, u AS (SELECT product, name, size, min(item_id) AS item_id FROM variants WHERE available GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT m.item_id, 'name' AS k, u.name AS v, u.item_id AS to_id, m.product FROM variants m JOIN u ON u.product = m.product AND u.size = m.size AND u.name <> m.name
  UNION ALL SELECT m.item_id, 'size', u.size, u.item_id, m.product FROM variants m JOIN u ON u.product = m.product AND u.name = m.name AND u.size <> m.size),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k, v, to_id) = 1)
SELECT item_id, k, v, to_id, (SELECT count(*) FROM variants r WHERE r.product = f.product AND r.available AND ((k = 'name' AND r.name = v) OR (k = 'size' AND r.size = v))) - 1 AS rivals FROM f""")
def single_option_neighbours(spark, d):
    return S.single_option_neighbour(T.variants(spark, d))


@query("next_size_neighbours", V + """, sz AS (SELECT product, size_n, lead(size_n) OVER w AS up, lag(size_n) OVER w AS down FROM (SELECT DISTINCT product, size_n FROM variants) WINDOW w AS (PARTITION BY product ORDER BY size_n)),
u AS (SELECT product, name, size_n, min(item_id) AS id FROM variants WHERE available GROUP BY ALL HAVING count(*) = 1)
SELECT m.item_id, coalesce(a.id, b.id) AS to_id, CASE WHEN a.id IS NOT NULL THEN 'up' ELSE 'down' END AS step FROM variants m JOIN sz USING (product, size_n)
LEFT JOIN u a ON a.product = m.product AND a.name = m.name AND a.size_n = sz.up LEFT JOIN u b ON b.product = m.product AND b.name = m.name AND b.size_n = sz.down
WHERE coalesce(a.id, b.id) IS NOT NULL""")
def next_size_neighbours(spark, d):
    return S.next_rank_neighbour(T.variants(spark, d), "size")


@query("decoy_orders", I + """, o AS (SELECT DISTINCT user_id, product, status, order_id FROM items),
c0 AS (SELECT user_id, product, status, count(*) AS n, min(order_id) AS order_id FROM o GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id, product) AS having_ FROM c0)
SELECT order_id, product, status, having_ - 1 AS decoys FROM c WHERE status IN ('delivered', 'pending') AND n = 1 AND having_ > 1""")
def decoy_orders(spark, d):
    return S.decoy_orders(T.order_items(spark, d), ["delivered", "pending"], T.item_rows(spark, d))


@query("earlier_same_status_orders", I + """SELECT order_id, product, status, rn - 1 AS decoys FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product, status ORDER BY order_id) AS rn
  FROM (SELECT DISTINCT user_id, product, status, order_id FROM items)) WHERE rn > 1""")
def earlier_same_status_orders(spark, d):
    return S.earlier_twins(T.order_items(spark, d), T.item_rows(spark, d))


@query("twin_items", I + """, t AS (SELECT order_id, product, min(item_id) AS a, max(item_id) AS b FROM items GROUP BY ALL HAVING count(*) = 2 AND min(item_id) <> max(item_id))
SELECT order_id, t.product, a AS item_a, b AS item_b, CASE WHEN x.name <> y.name THEN 'name' ELSE 'size' END AS key, CASE WHEN x.name <> y.name THEN x.name ELSE x.size END AS value_a,
  CASE WHEN x.name <> y.name THEN y.name ELSE y.size END AS value_b FROM t JOIN variants x ON x.item_id = a JOIN variants y ON y.item_id = b WHERE x.name <> y.name OR x.size <> y.size""")
def twin_items(spark, d):
    return S.twin_items(T.order_items(spark, d))


@query("unique_destinations", "WITH " + T.ORDERS_SQL + """, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, city) AS n, (SELECT count(DISTINCT city) FROM ord o2 WHERE o2.user_id = ord.user_id) AS cities FROM ord)
SELECT order_id, user_id, city FROM c WHERE n = 1 AND cities > 1""")
def unique_destinations(spark, d):
    return S.unique_destination(T.orders(spark, d))


@query("product_totals", I + """SELECT user_id, product, count(*) AS n, printf('%.2f', sum(price)) AS total FROM items GROUP BY user_id, product HAVING count(*) >= 2 AND NOT bool_or(status = 'processed')""")
def product_totals(spark, d):
    return S.product_totals(T.order_items(spark, d), F.col("status") == "processed")


@query("same_as_other_order", I + """, n AS (SELECT user_id, product FROM items GROUP BY ALL HAVING count(*) = 2 AND count(DISTINCT order_id) = 2 AND count(DISTINCT item_id) = 2)
SELECT a.order_id, a.item_id, b.order_id AS from_order, b.item_id AS to_id FROM items a SEMI JOIN n USING (user_id, product) JOIN items b ON b.user_id = a.user_id AND b.product = a.product AND b.order_id <> a.order_id WHERE b.available""")
def same_as_other_order(spark, d):
    return S.same_as_other_order(T.order_items(spark, d))


@query("conflict_requests", I + """, per AS (SELECT order_id, product, count(*) AS n, bool_or(flag = 'R') AS returned, min(pos) AS pos, min(item_id) AS item_id FROM items WHERE status = 'delivered' GROUP BY ALL),
x AS (SELECT * FROM per SEMI JOIN (SELECT order_id FROM per WHERE returned) USING (order_id) WHERE n = 1 AND NOT returned QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY pos, item_id) = 1),
a AS (SELECT x.order_id, x.item_id, v.item_id AS to_id, v.price, row_number() OVER (PARTITION BY x.order_id ORDER BY v.price, v.item_id) AS rn, lead(v.price) OVER (PARTITION BY x.order_id ORDER BY v.price, v.item_id) AS nxt
  FROM x JOIN variants v ON v.product = x.product AND v.available AND v.item_id <> x.item_id)
SELECT order_id, item_id, to_id FROM a WHERE rn = 1 AND (nxt IS NULL OR nxt <> price)""")
def conflict_requests(spark, d):
    return S.conflict_requests(T.order_items(spark, d), T.variants(spark, d))


@query("list_and_choose", I + """, pools AS (SELECT product, 'name' AS k, name AS v, item_id, price FROM variants WHERE available UNION ALL SELECT product, 'size', size, item_id, price FROM variants WHERE available),
small AS (SELECT product, k, v, row_number() OVER (PARTITION BY product ORDER BY md5(k || ':' || v), k) AS no, count(*) OVER (PARTITION BY product) AS pools FROM (SELECT product, k, v FROM pools GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5)),
once AS (SELECT order_id, product, min(item_id) AS item_id FROM items GROUP BY ALL HAVING count(*) = 1),
picked AS (SELECT o.*, s.k, s.v FROM once o JOIN small s ON s.product = o.product AND s.no = CAST(floor(""" + uniform_sql(8, "choose", "(order_id || ':' || o.item_id)") + """ * s.pools) AS BIGINT) + 1),
c AS (SELECT i.order_id, i.item_id, i.k, i.v, count(*) AS n, count(DISTINCT p.price) AS np, min_by(p.item_id, p.price) AS cheapest, max_by(p.item_id, p.price) AS dearest,
  string_agg(rtrim(rtrim(printf('%.2f', p.price), '0'), '.'), ', ' ORDER BY p.price) AS prices FROM picked i JOIN pools p ON p.product = i.product AND p.k = i.k AND p.v = i.v AND p.item_id <> i.item_id GROUP BY ALL)
SELECT order_id, item_id, k, v, cheapest, dearest, prices FROM c WHERE n BETWEEN 2 AND 4 AND np = n""")
def list_and_choose(spark, d):
    return S.choices(T.order_items(spark, d), T.variants(spark, d), H.uniform(8, "choose", F.col("order_id"), F.col("item_id")))


@query("request_bundles", """WITH w AS (SELECT o_custkey AS user_id, l_orderkey AS order_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'P' GROUP BY ALL),
p AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('6:bundle:' || CAST(order_id AS VARCHAR)), order_id) <= 3),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('6:bundle:' || CAST(order_id AS VARCHAR)), order_id) AS r FROM p),
sets AS (SELECT a.user_id, 2 AS orders, a.n + b.n AS writes, least(a.order_id, b.order_id) AS first_order, greatest(a.order_id, b.order_id) AS last_order, a.r * 10 + b.r AS no
    FROM q a JOIN q b ON a.user_id = b.user_id AND a.r < b.r
  UNION ALL SELECT user_id, 3, sum(n), min(order_id), max(order_id), 0 FROM q GROUP BY user_id HAVING count(*) = 3)
SELECT user_id, CAST(orders AS BIGINT) AS orders, CAST(writes AS BIGINT) AS writes, first_order, last_order FROM sets WHERE writes BETWEEN 3 AND 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY no) = 1""")
def request_bundles(spark, d):
    n = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count(F.lit(1)).alias("n"))
    o = T.orders(spark, d).where("status <> 'processed'").select("order_id", "user_id")
    return S.bundles(n.join(o, "order_id"), H.digest(6, "bundle", F.col("order_id")))


@query("refused_requests", I + """SELECT order_id, CASE status WHEN 'delivered' THEN 'cancel' WHEN 'processed' THEN 'change address' ELSE 'return' END AS ask,
  CASE WHEN count(*) = 1 THEN 'tracking' ELSE 'total' END AS info, CASE WHEN count(*) = 1 THEN CAST(min(item_id) AS VARCHAR) ELSE printf('%.2f', sum(price)) END AS answer FROM items GROUP BY order_id, status""")
def refused_requests(spark, d):
    """A request the order's status rules out, with a fact to look up: its tracking number when there is
    exactly one parcel, else the order total."""
    it = T.order_items(spark, d)
    ask = F.when(F.col("status") == "delivered", "cancel").when(F.col("status") == "processed", "change address").otherwise("return")
    g = it.groupBy("order_id", "status").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("one"), F.sum("price").alias("total"))
    return g.select("order_id", ask.alias("ask"), F.when(F.col("n") == 1, "tracking").otherwise("total").alias("info"),
                    F.when(F.col("n") == 1, F.col("one").cast("string")).otherwise(X.money(F.col("total"))).alias("answer"))


AMOUNT_SQL = I + """, act AS (SELECT *, CASE status WHEN 'pending' THEN 'cancel' WHEN 'delivered' THEN 'return' ELSE 'swap' END AS action, flag = 'R' AS chosen, 900 + supp AS new_price FROM items),
g AS (SELECT order_id, any_value(user_id) AS user_id, action, sum(price) AS total, sum(price) FILTER (chosen) AS part, sum(new_price - price) FILTER (chosen) AS diff FROM act GROUP BY order_id, action),
h AS (SELECT *, CASE action WHEN 'cancel' THEN total WHEN 'return' THEN part ELSE abs(diff) END AS amount FROM g)
SELECT order_id, action, CASE WHEN action = 'swap' AND diff > 0 THEN 'charged' ELSE 'refunded' END AS verb, printf('%.2f', amount) AS amount,
  NOT (c_mktsegment = 'BUILDING' AND coalesce(diff, 0) > c_acctbal / 100) AS affordable FROM h JOIN customer ON c_custkey = user_id WHERE amount >= 0.01"""


@query("stated_amounts", AMOUNT_SQL)
def stated_amounts(spark, d):
    act = F.when(F.col("status") == "pending", "cancel").when(F.col("status") == "delivered", "return").otherwise("swap")
    it = T.order_items(spark, d).select("order_id", "price", act.alias("action"), (F.col("flag") == "R").alias("chosen"), (900.0 + F.col("supp")).alias("new_price"))
    a = S.amounts(it).join(T.orders(spark, d).select("order_id", "user_id"), "order_id")
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "gift_card").otherwise("card").alias("source"), (F.col("c_acctbal") / 100).alias("balance"))
    return a.join(c, "user_id").select("order_id", "action", "verb", "amount", S.affordable(F.col("source"), F.col("diff"), F.col("balance")).alias("affordable"))


OUTCOME_SQL = I + """, ends AS (SELECT product, arg_min(item_id, (price, item_id)) AS lo, arg_max(item_id, (price, -item_id)) AS hi FROM variants WHERE available GROUP BY product),
pairs AS (SELECT order_id, pos, supp, items.item_id AS old_id, lo AS gold_id, CASE WHEN flag = 'A' THEN NULL WHEN discount = 0 THEN supp WHEN flag = 'R' THEN lo ELSE hi END AS agent_id
  FROM items JOIN ends USING (product) WHERE status = 'delivered' AND items.item_id <> lo AND items.item_id <> hi),
j AS (SELECT p.*, g.name AS gn, g.size AS gs, g.product AS gp, a.product AS ap, a.name AS an, a.size AS asz FROM pairs p JOIN variants g ON g.item_id = gold_id LEFT JOIN variants a ON a.item_id = agent_id),
o AS (SELECT *, CASE WHEN agent_id IS NULL THEN 'not swapped' WHEN agent_id = gold_id THEN 'exact' WHEN ap IS NULL OR ap <> gp THEN 'other product' ELSE 'wrong variant' END AS outcome,
  (CAST(an = gn AS INTEGER) + CAST(asz = gs AS INTEGER)) / 2.0 AS c FROM j),
ch AS (SELECT gold_id, agent_id, coalesce(avg((CAST(v.name = gn AS INTEGER) + CAST(v.size = gs AS INTEGER)) / 2.0) FILTER (v.item_id <> gold_id AND v.item_id <> agent_id), 0) AS chance
  FROM (SELECT DISTINCT gold_id, agent_id, gn, gs, gp FROM o WHERE outcome = 'wrong variant') JOIN variants v ON v.product = gp GROUP BY ALL)
"""


@query("variant_outcomes", OUTCOME_SQL + """SELECT order_id, pos, supp, old_id, gold_id, agent_id, outcome, CASE WHEN outcome = 'wrong variant' THEN round(c, 6) END AS closeness,
  CASE WHEN outcome = 'wrong variant' THEN round(chance, 6) END AS chance,
  CASE WHEN outcome = 'wrong variant' THEN round(CASE WHEN chance < 1 THEN greatest(0, (c - chance) / (1 - chance)) ELSE 0 END, 6) END AS bonus FROM o LEFT JOIN ch USING (gold_id, agent_id)""")
def variant_outcomes(spark, d):
    v = T.variants(spark, d)
    whole = S.option_pools(v).where("k = '*'")
    ends = whole.groupBy("product").agg(F.min(F.struct("price", "item_id"))["item_id"].alias("lo"),
                                        (-F.max(F.struct("price", (-F.col("item_id")).alias("i")))["i"]).alias("hi"))
    it = T.order_items(spark, d).where("status = 'delivered'").select("order_id", "pos", "supp", "item_id", "product", "flag", "discount")
    p = it.join(ends, "product").where("item_id <> lo and item_id <> hi").select(
        "order_id", "pos", "supp", F.col("item_id").alias("old_id"), F.col("lo").alias("gold_id"),
        F.when(F.col("flag") == "A", None).when(F.col("discount") == 0, F.col("supp")).when(F.col("flag") == "R", F.col("lo")).otherwise(F.col("hi")).alias("agent_id"))
    o = S.variant_outcomes(p, v)
    return o.select(*[r6(F.col(c)).alias(c) if c in ("closeness", "chance", "bonus") else F.col(c) for c in o.columns])


ORDERED = "pos, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"


@query("swap_alignment", f"""WITH li AS (SELECT l_orderkey AS o, l_linenumber AS pos, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, CAST(l_partkey AS VARCHAR) AS old, CAST(l_suppkey AS VARCHAR) AS new FROM lineitem),
go AS (SELECT o, old, row_number() OVER (PARTITION BY o ORDER BY {ORDERED}) - 1 AS p FROM li), gn AS (SELECT o, new, row_number() OVER (PARTITION BY o ORDER BY {ORDERED}) - 1 AS p FROM li WHERE l_tax < 0.08),
gold AS (SELECT o, p, old, new FROM go JOIN gn USING (o, p)),
al AS (SELECT *, CASE WHEN l_discount = 0 THEN '' WHEN l_discount < 0.05 THEN old ELSE new END AS told FROM li, (VALUES (0), (1)) AS v(c) WHERE c = 0 AND pos % 2 = 1 OR c = 1 AND l_quantity > 20),
ao AS (SELECT o, c, old, row_number() OVER (PARTITION BY o, c ORDER BY {ORDERED}) AS p FROM al), an AS (SELECT o, c, told, row_number() OVER (PARTITION BY o, c ORDER BY {ORDERED}) AS p FROM al WHERE l_tax > 0),
dict AS (SELECT o, c, old, arg_max(told, p) AS told FROM ao JOIN an USING (o, c, p) GROUP BY o, c, old),
ans AS (SELECT o, old, arg_min(told, c) AS told, min(c) AS c FROM dict WHERE told <> '' GROUP BY o, old),
j AS (SELECT coalesce(g.o, a.o) AS order_id, coalesce(g.old, a.old) AS old_id, g.p AS pos, g.new AS gold_id, a.told AS agent_id, a.c AS turn_idx FROM gold g FULL JOIN ans a ON g.o = a.o AND g.old = a.old)
SELECT j.*, CASE WHEN pos IS NULL THEN 'not asked' WHEN agent_id IS NULL THEN 'not swapped' WHEN agent_id = gold_id THEN 'exact' WHEN g.p_brand = a.p_brand AND g.p_type = a.p_type THEN 'wrong variant' ELSE 'other product' END AS outcome
FROM j LEFT JOIN part g ON CAST(g.p_partkey AS VARCHAR) = gold_id LEFT JOIN part a ON CAST(a.p_partkey AS VARCHAR) = agent_id""")
def swap_alignment(spark, d):
    """Each order asks for swaps of its items; the agent makes two calls with some of them, in lists of unequal length. Wanted
    pairs meet the first answer by old item, with missing and extra ones."""
    from tracemill.functions import calls as C
    from tracemill.operators import swaps
    li = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    old, new = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    told = F.when(F.col("l_discount") == 0, "").when(F.col("l_discount") < 0.05, old).otherwise(new)

    def call(rows, given, listed, *keys):
        """The swap call of the rows of a key, as JSON text read like any other call's arguments."""
        line = F.struct(*ORDERED.split(", "), old.alias("old"), F.when(listed, given).alias("new"))
        g = rows.groupBy("episode_id", *keys).agg(F.array_sort(F.collect_list(line)).alias("x"))
        text = F.to_json(F.struct(F.col("episode_id").cast("string").alias("order_id"), F.transform("x", lambda x: x["old"]).alias("item_ids"),
                                  F.filter(F.transform("x", lambda x: x["new"]), lambda v: v.isNotNull()).alias("new_item_ids")))
        return g.select("episode_id", *keys, F.lit(C.SWAP_TOOLS[0]).alias("name"), C.parse_args(text).alias("args"))
    gold = call(li, new, F.col("l_tax") < 0.08)
    calls = F.filter(F.array(F.when(F.col("pos") % 2 == 1, 0), F.when(F.col("l_quantity") > 20, 1)), lambda c: c.isNotNull())
    done = call(li.withColumn("turn_idx", F.explode(calls)), told, F.col("l_tax") > 0, "turn_idx").withColumn("call_idx", F.lit(0))
    v = T.variants(spark, d).select(F.col("item_id").cast("string").alias("item_id"), "product")
    j = swaps.outcomes(swaps.aligned(gold, done), v)
    return j.select(F.col("order_id").cast("bigint").alias("order_id"), "old_id", F.col("pos").cast("bigint").alias("pos"), "gold_id", "agent_id", "turn_idx", "outcome")


@query("variant_bonus_by_order", OUTCOME_SQL + """SELECT order_id, count(*) AS pairs, count(*) FILTER (outcome = 'wrong variant') AS wrong, count(*) FILTER (outcome = 'wrong variant' AND c > chance) AS above_chance,
  round(least(0.3, 0.3 * sum(CASE WHEN outcome = 'wrong variant' AND chance < 1 THEN greatest(0, (c - chance) / (1 - chance)) ELSE 0 END) / count(*)), 5) AS bonus FROM o LEFT JOIN ch USING (gold_id, agent_id) GROUP BY order_id""")
def variant_bonus_by_order(spark, d):
    o = variant_outcomes(spark, d)
    return o.groupBy("order_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("outcome") == "wrong variant").alias("wrong"),
                                     F.count_if(F.col("closeness") > F.col("chance")).alias("above_chance"),
                                     F.round(F.least(F.lit(0.3), 0.3 * F.coalesce(F.sum("bonus"), F.lit(0.0)) / F.count(F.lit(1))), 5).alias("bonus"))


@query("task_pairs", """WITH RECURSIVE t AS (SELECT o_custkey AS user_id, o_orderkey AS order_id, o_orderpriority AS city, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
run(user_id, k, waiting, held, first, second) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM t UNION ALL
  SELECT user_id, k + 1, CASE WHEN hit THEN waiting[2:] ELSE list_append(waiting, order_id) END, CASE WHEN hit THEN held ELSE city END, CASE WHEN hit THEN waiting[1] END, CASE WHEN hit THEN order_id END
  FROM (SELECT run.*, t.order_id, t.city, len(waiting) > 0 AND held <> t.city AS hit FROM run JOIN t ON t.user_id = run.user_id AND t.k = run.k + 1))
SELECT user_id, first, second FROM run WHERE first IS NOT NULL""")
def task_pairs(spark, d):
    """Greedy by definition: the SQL takes each customer's tasks one by one, by recursion."""
    o = T.orders(spark, d).select("user_id", "order_id", "city")
    return S.pair_tasks(o, "user_id", "order_id", "city")


# ------------------------------------------------------------------ rewriting tasks

def mod_sql(h: str) -> str:
    acc = "0"
    for i in range(8):
        acc = f"(({acc} * 4294967296 + CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT)) % 1000)"
    return acc


def roll_sql(key: str, salt: str, p: float) -> str:
    return f"({mod_sql(f'sha256({chr(39)}{salt}:{chr(39)} || {key})')} < {p * 1000})"


COPIES = 3
# share of eligible tasks each device is applied to: fixed values
P_CONFLICT, P_ADD, P_MIND, P_FORBID, P_AMOUNT, P_DEFAULT = 0.6, 0.7, 0.5, 0.5, 0.5, 0.35
DEVICES = {"conflict": P_CONFLICT, "addconf": P_ADD, "mind": P_MIND, "forbid": P_FORBID, "amount": P_AMOUNT, "defaddr": P_DEFAULT}


def base_actions(spark, d):
    """One write per order on all its items: delivered orders return (one flag) or exchange, pending ones
    change items or cancel. An order's item list is one bounded record of the store."""
    it = T.order_items(spark, d).where("status <> 'processed'")
    g = it.groupBy("order_id", "user_id", "status").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.min("product").alias("a"), F.max("product").alias("b"), F.min("flag").alias("flag"))
    name = (F.when((F.col("status") == "delivered") & (F.col("flag") == "A"), "return_delivered_order_items").when(F.col("status") == "delivered", "exchange_delivered_order_items")
            .when(F.col("flag") == "R", "cancel_pending_order").otherwise("modify_pending_order_items"))
    return g.select(F.concat(F.lit("tb_"), F.col("order_id").cast("string")).alias("task_id"), "order_id", "user_id", name.alias("name"),
                    F.when(name != "cancel_pending_order", F.col("items")).alias("ids"), (F.col("a") != F.col("b")).alias("names_differ"))


BASE_SQL = I + """, g AS (SELECT order_id, user_id, status, list_sort(list(DISTINCT item_id)) AS its, min(product) AS pa, max(product) AS pb, min(flag) AS flag FROM items WHERE status <> 'processed' GROUP BY ALL),
base AS (SELECT 'tb_' || order_id AS task_id, order_id, CASE WHEN status = 'delivered' AND flag = 'A' THEN 'return_delivered_order_items' WHEN status = 'delivered' THEN 'exchange_delivered_order_items'
  WHEN flag = 'R' THEN 'cancel_pending_order' ELSE 'modify_pending_order_items' END AS name, its AS ids, pa <> pb AS names_differ FROM g)"""


def rewrite(t, key):
    """Devices applied in order to a one-write task, each by a hash roll on the task's id: a competing
    request, an item added at confirmation, a change of mind (exchange to return, modify to cancel, or the
    last item dropped), a forbidden first request, a stated amount, a default-address write."""
    t = t.withColumn("_rolls", H.remainders(key, list(DEVICES)))
    roll = lambda salt: H.rolled(F.col("_rolls"), list(DEVICES).index(salt), DEVICES[salt])
    name, two = F.col("name"), F.size("ids") >= 2
    is_return, is_exchange, is_modify = (name == n for n in ("return_delivered_order_items", "exchange_delivered_order_items", "modify_pending_order_items"))
    t = t.withColumn("conflict", (is_return | is_exchange) & F.coalesce(two & F.col("names_differ"), F.lit(False)) & roll("conflict"))
    t = t.withColumn("added", is_return & ~F.col("conflict") & F.coalesce(two & F.col("names_differ"), F.lit(False)) & roll("addconf"))
    free = ~F.col("conflict") & ~F.col("added")
    t = t.withColumn("mind", F.when(free & roll("mind"), F.when(is_exchange | is_modify, "switch").when(is_return & two & F.col("names_differ"), "drop")))
    t = t.withColumn("final_name", F.when(F.col("mind") == "switch", F.when(is_exchange, "return_delivered_order_items").otherwise("cancel_pending_order")).otherwise(name))
    t = t.withColumn("final_ids", F.when(F.col("mind") == "drop", F.slice("ids", F.lit(1), F.size("ids") - 1)).when((F.col("mind") == "switch") & is_modify, None).otherwise(F.col("ids")))
    t = t.withColumn("forbidden", F.when(F.col("mind").isNull() & free & roll("forbid"), F.col("final_name")))
    t = t.withColumn("amount", ~F.col("conflict") & roll("amount")).withColumn("default_address", roll("defaddr")).drop("_rolls")
    return t


def _rewrite_sql(source: str) -> str:
    k = "key"
    return f""",
r0 AS (SELECT *, name IN ('return_delivered_order_items', 'exchange_delivered_order_items') AND len(ids) >= 2 AND names_differ AND {roll_sql(k, 'conflict', P_CONFLICT)} AS conflict FROM {source}),
r1 AS (SELECT *, name = 'return_delivered_order_items' AND NOT conflict AND len(ids) >= 2 AND names_differ AND {roll_sql(k, 'addconf', P_ADD)} AS added FROM r0),
r2 AS (SELECT *, CASE WHEN NOT conflict AND NOT added AND {roll_sql(k, 'mind', P_MIND)} THEN CASE WHEN name IN ('exchange_delivered_order_items', 'modify_pending_order_items') THEN 'switch'
  WHEN name = 'return_delivered_order_items' AND len(ids) >= 2 AND names_differ THEN 'drop' END END AS mind FROM r1),
r3 AS (SELECT *, CASE WHEN mind = 'switch' AND name = 'exchange_delivered_order_items' THEN 'return_delivered_order_items' WHEN mind = 'switch' THEN 'cancel_pending_order' ELSE name END AS final_name,
  CASE WHEN mind = 'drop' THEN ids[1:len(ids) - 1] WHEN name = 'cancel_pending_order' OR (mind = 'switch' AND name = 'modify_pending_order_items') THEN NULL ELSE ids END AS final_ids FROM r2),
rw AS (SELECT *, CASE WHEN mind IS NULL AND NOT conflict AND NOT added AND {roll_sql(k, 'forbid', P_FORBID)} THEN final_name END AS forbidden,
  NOT conflict AND {roll_sql(k, 'amount', P_AMOUNT)} AS amount, {roll_sql(k, 'defaddr', P_DEFAULT)} AS default_address FROM r3)"""


OUT = "conflict, added, mind, final_name, array_to_string(final_ids, ',') AS final_ids, forbidden, amount, default_address"


def _shown(t, *keys):
    return t.select(*keys, "conflict", "added", "mind", "final_name", F.when(F.col("final_ids").isNotNull(), F.array_join("final_ids", ",")).alias("final_ids"), "forbidden", "amount", "default_address")


@query("hardened_tasks", BASE_SQL + ", k AS (SELECT *, task_id AS key FROM base)" + _rewrite_sql("k") + f" SELECT task_id, {OUT} FROM rw")
def hardened_tasks(spark, d):
    return _shown(rewrite(base_actions(spark, d), F.col("task_id")), "task_id")


@query("varied_tasks", BASE_SQL + f", k AS (SELECT *, unnest(range({COPIES + 1})) AS copy FROM base), kk AS (SELECT *, CASE WHEN copy = 0 THEN task_id ELSE task_id || '_r' || copy END AS key FROM k)" + _rewrite_sql("kk") + f""",
f AS (SELECT key AS variant_id, task_id, copy, {OUT}, row_number() OVER (PARTITION BY task_id, conflict, added, mind, final_name, final_ids, forbidden, amount, default_address ORDER BY copy) AS rn FROM rw)
SELECT variant_id, task_id, conflict, added, mind, final_name, final_ids, forbidden, amount, default_address FROM f WHERE rn = 1 AND copy > 0""")
def varied_tasks(spark, d):
    """K re-rolls of each task under new ids; a variant equal to the original or to an earlier variant is
    dropped. Copies of a task stay in one row set of K+1, so the comparison is a small window per task (its order)."""
    from pyspark.sql import Window
    b = base_actions(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES))))
    key = F.when(F.col("copy") == 0, F.col("task_id")).otherwise(F.concat(F.col("task_id"), F.lit("_r"), F.col("copy").cast("string")))
    t = rewrite(b.withColumn("variant_id", key), F.col("variant_id"))
    same = ["conflict", "added", "mind", "final_name", "final_ids", "forbidden", "amount", "default_address"]
    s = _shown(t, "variant_id", "task_id", "copy", "order_id")
    w = Window.partitionBy("order_id", *same).orderBy("copy")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1 and copy > 0").drop("rn", "copy", "order_id")


@query("state_digests", """WITH RECURSIVE s AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, l_partkey || ':' || o_orderstatus AS item,
  CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN l_partkey || ':return requested' WHEN l_returnflag = 'N' AND o_orderstatus = 'O' THEN coalesce(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity), l_partkey + 1) || ':O' END AS new,
  CASE WHEN l_returnflag = 'N' AND o_orderstatus = 'O' AND l_quantity >= 25 THEN (l_partkey + 1) || ':O' END AS rival, l_returnflag AS flag, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT order_id, count(*) AS n, list(item ORDER BY line, part, flag, q) AS items, list_filter(coalesce(list({'o': item, 'n': new} ORDER BY line, part, flag, q), []) || coalesce(list({'o': item, 'n': rival} ORDER BY line, part, flag, q), []), lambda x: x.n IS NOT NULL) AS acts FROM s GROUP BY order_id),
w AS (SELECT order_id, 'once' AS way, acts AS todo, items FROM g UNION ALL SELECT order_id, 'back', list_reverse(acts), items FROM g UNION ALL SELECT order_id, 'twice', acts || acts, items FROM g),
r(order_id, way, todo, k, st) AS (SELECT order_id, way, todo, 0, items FROM w UNION ALL
  SELECT order_id, way, todo, k + 1, CASE WHEN p > 0 THEN list_concat(list_concat(st[:p - 1], [todo[k + 1].n]), st[p + 1:]) ELSE st END
  FROM (SELECT *, coalesce(list_position(st, todo[k + 1].o), 0) AS p FROM r WHERE k < len(todo))),
f AS (SELECT order_id, way, list_sort(st) AS st FROM r WHERE k = len(todo))
SELECT g.order_id, n AS rows, o.st <> list_sort(items) AS changed, o.st = b.st AS order_free, o.st = t.st AS repeat_free FROM g
JOIN f o ON o.order_id = g.order_id AND o.way = 'once' JOIN f b ON b.order_id = g.order_id AND b.way = 'back' JOIN f t ON t.order_id = g.order_id AND t.way = 'twice'""")
def state_digests(spark, d):
    """An order's state before and after its replacements (a modified item becomes one like the next line's, the last one the
    next part; for a quantity of 25 or more there is a second, rival wish, which finds its item gone unless the order has another
    one; a returned one changes its status), by digests that do not depend on the listing order of items: did it change,
    does the list of replacements give the same state read backwards, and given twice."""
    li = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    j = li.join(T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    g = j.groupBy(F.col("o_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "o_orderstatus"))).alias("x"))

    def item(part, status):
        return F.concat_ws(":", part.cast("string"), status)

    def action(x, i):
        following = F.coalesce(F.get("x", i + 1)["l_partkey"], x["l_partkey"] + 1)
        new = F.when((x["l_returnflag"] == "R") & (x["o_orderstatus"] == "F"), item(x["l_partkey"], F.lit("return requested"))).when(
            (x["l_returnflag"] == "N") & (x["o_orderstatus"] == "O"), item(following, F.lit("O")))
        return F.struct(item(x["l_partkey"], x["o_orderstatus"]).alias("old"), new.alias("new"))

    def rival(x):
        again = (x["l_returnflag"] == "N") & (x["o_orderstatus"] == "O") & (x["l_quantity"] >= 25)
        return F.struct(item(x["l_partkey"], x["o_orderstatus"]).alias("old"), F.when(again, item(x["l_partkey"] + 1, F.lit("O"))).alias("new"))
    acts = F.filter(F.concat(F.transform("x", action), F.transform("x", rival)), lambda a: a["new"].isNotNull())
    g = g.select("order_id", F.transform("x", lambda x: item(x["l_partkey"], x["o_orderstatus"])).alias("items"), acts.alias("acts"))

    def after(todo):
        return S.state_digest(S.replayed(F.col("items"), todo))
    g = g.select("order_id", S.state_digest(F.col("items")).alias("b"), after(F.col("acts")).alias("once"), after(F.reverse("acts")).alias("back"), after(F.concat("acts", "acts")).alias("twice"))
    return g.select("order_id", F.col("b.n").alias("rows"), (F.col("once") != F.col("b")).alias("changed"),
                    (F.col("once") == F.col("back")).alias("order_free"), (F.col("once") == F.col("twice")).alias("repeat_free"))


@query("item_change_candidates", I + """, u AS (SELECT product, name, size, min(item_id) AS item_id, min(price) AS price FROM variants WHERE available GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT m.item_id, 'name' AS k, u.name AS v, u.item_id AS to_id FROM variants m JOIN u ON u.product = m.product AND u.size = m.size AND u.name <> m.name
  UNION ALL SELECT m.item_id, 'size', u.size, u.item_id FROM variants m JOIN u ON u.product = m.product AND u.name = m.name AND u.size <> m.size),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k, v, to_id) = 1),
once AS (SELECT order_id, product FROM items GROUP BY ALL HAVING count(*) = 1),
x AS (SELECT order_id, items.item_id, status, f.to_id, md5('4:change:' || order_id || ':' || items.item_id) AS h FROM items SEMI JOIN once USING (order_id, product) JOIN f ON f.item_id = items.item_id WHERE status <> 'processed'),
r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY h) AS rn, count(*) OVER (PARTITION BY order_id) AS n FROM x)
SELECT order_id, item_id, to_id, CASE WHEN status = 'delivered' THEN 'exchange' ELSE 'modify' END AS verb, CASE WHEN n >= 3 THEN 3 ELSE n END AS level FROM r WHERE rn <= 3""")
def item_change_candidates(spark, d):
    """Items that occur once in their order and have a one-option neighbour, up to three per order by hash;
    the order's level is how many it offers."""
    from pyspark.sql import Window
    v = T.variants(spark, d)
    it = T.order_items(spark, d).where("status <> 'processed'")
    once = it.groupBy("order_id", "product", "status").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id")).where("n = 1")
    x = sized(once.join(S.single_option_neighbour(v).select("item_id", "to_id"), "item_id"), T.item_rows(spark, d), "order_id")
    h = H.digest(4, "change", F.col("order_id"), F.col("item_id"))
    w = Window.partitionBy("order_id").orderBy("h")
    top = x.withColumn("h", h).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    level = F.max("rn").over(Window.partitionBy("order_id"))
    return top.withColumn("level", level).select("order_id", "item_id", "to_id", F.when(F.col("status") == "delivered", "exchange").otherwise("modify").alias("verb"), F.col("level").cast("bigint").alias("level"))
