"""Typed arguments, swap alignment, record files and the flat store, by hand."""

import gzip
import json

from pyspark.sql import functions as F

from tracemill.functions import calls as C
from tracemill.operators import swaps
from tracemill.sources import episodes as EP
from tracemill.sources import runs as R
from tracemill.sources import schema as S


def canon(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.orderBy("i").select(C.canonical_args(C.parse_args(F.col("t"))).alias("c")).collect()]


def test_values_keep_their_type(spark):
    same = ['{"a": 1, "b": {"y": 2, "x": [1]}}', ' {"b":{"x":[1],"y":2},"a":1} ']
    other = ['{"a": "1", "b": {"y": 2, "x": [1]}}', '{"a": 1.0, "b": {"y": 2, "x": [1]}}', '{"a": true, "b": {"y": 2, "x": [1]}}', '{"a": null, "b": {"y": 2, "x": [1]}}',
             '{"b": {"y": 2, "x": [1]}}', '{"a": "\\u00011", "b": {"y": 2, "x": [1]}}']
    got = canon(spark, *same, *other)
    assert got[0] == got[1] and len(set(got)) == 1 + len(other)
    lists = canon(spark, '{"item_ids": ["2", "1"]}', '{"item_ids": ["1", "2"]}', '{"item_ids": "[\\"1\\",\\"2\\"]"}', '{"item_ids": [1, 2]}', '{"item_ids": [1, "2"]}')
    assert lists[0] == lists[1] and len(set(lists)) == 4
    pair = canon(spark, '{"item_ids": ["a", "b"], "new_item_ids": ["x", "y"]}', '{"item_ids": ["b", "a"], "new_item_ids": ["y", "x"]}', '{"item_ids": ["b", "a"], "new_item_ids": ["x", "y"]}')
    assert pair[0] == pair[1] != pair[2]


def test_unreadable_arguments_are_kept_and_flagged(spark):
    bad = ['{"a": 1', '{"a": 1} x', '{"a": 1}}', '{"a": 1}],[{}', '{"a": 1},{"b": 2}', '{"a":1},"w":2', "[1]", "7", '"text"', '{"a":1,"a":2}', "nul"]
    empty = ["", "  ", "null", "{}", "[]", "0", '""', None]
    df = spark.createDataFrame([(t,) for t in bad + empty], "t string")
    call = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("f").alias("name"), F.col("t").alias("arguments")))
    got = {r.t: r.c[0] for r in df.select("t", C.parse_calls(call).alias("c")).collect()}
    for t in bad:
        assert got[t].parse_error and got[t].args == {"_unparsed": t}, t
    for t in empty:
        assert not got[t].parse_error and got[t].args == {}, t
    assert got["{}"].id == "call_0"


def swap(order, old, new):
    return json.dumps({"order_id": order, "item_ids": old, "new_item_ids": new})


def test_alignment_of_swaps(spark):
    """Unequal lists, other listing orders, repeats inside a call and over calls, missing, extra and empty answers."""
    name = C.SWAP_TOOLS[0]
    gold = spark.createDataFrame([(1, name, swap("o", ["a", "b", "c", "d"], ["A", "B", "C"])), (2, name, swap("o", ["a", "a"], ["A", "Z"])), (3, "get_order_details", "{}"),
                                  (4, name, '{"item_ids": ["a"], "new_item_ids": ["A"]}')], "episode_id int, name string, t string")
    done = spark.createDataFrame([(1, 5, 0, name, swap("o", ["c", "b", "x"], ["C", "Q", "X", "Y"])), (1, 7, 0, name, swap("o", ["b", "a"], ["B", ""])), (1, 8, 0, C.SWAP_TOOLS[1], swap("o", ["a"], ["A"])),
                                  (2, 1, 1, name, swap("o", ["a", "a"], ["N", "A"])), (2, 1, 0, name, swap("p", ["a"], ["A"])), (4, 0, 0, name, '{"item_ids": ["a"], "new_item_ids": ["B"]}'),
                                  (5, 0, 0, name, '{"item_ids": "[a]", "new_item_ids": null}')], "episode_id int, turn_idx int, call_idx int, name string, t string")
    args = C.parse_args(F.col("t")).alias("args")
    j = swaps.aligned(gold.select("episode_id", "name", args), done.select("episode_id", "turn_idx", "call_idx", "name", args))
    v = spark.createDataFrame([(x, "p") for x in "ABC"] + [("Q", "q"), ("Z", "p")], "item_id string, product string")
    got = {(r.episode_id, r.name == name, r.order_id, r.old_id, r.pos, r.gold_id, r.agent_id, r.outcome) for r in swaps.outcomes(j, v).collect()}
    assert got == {(1, True, "o", "a", 0, "A", None, "not swapped"), (1, True, "o", "b", 1, "B", "Q", "other product"), (1, True, "o", "c", 2, "C", "C", "exact"),
                   (1, True, "o", "x", None, None, "X", "not asked"), (1, False, "o", "a", None, None, "A", "not asked"),
                   (2, True, "o", "a", 0, "A", "A", "exact"), (2, True, "o", "a", 1, "Z", "A", "wrong variant"), (2, True, "p", "a", None, None, "A", "not asked"),
                   (4, True, None, "a", 0, "A", "B", "wrong variant")}


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "episode_id int, turn_idx int, call_idx int, name string, args map<string,string>")
    assert swaps.aligned(none, none).count() == 0


def test_torn_records_keep_their_text(spark, tmp_path):
    good = {"episode_id": "e", "batch_id": 1, "turns": [], "reward": 1, "termination": "natural", "schema_version": 1}
    folder = tmp_path / "run" / "records" / "b1"
    folder.mkdir(parents=True)
    for file, text in (("a.json.gz", json.dumps(good)), ("b.json.gz", json.dumps(good)[:30]), (".tmp-c.json.gz", "{"), ("d.txt", "{")):
        with gzip.open(folder / file, "wt") as f:
            f.write(text)
    e = EP.with_run_and_batch(EP.read_episodes(spark, str(tmp_path), recursive=True))
    ok, faulty = S.split_faulty(e)
    assert [(r.episode_id, r.run, r.batch_dir) for r in ok.collect()] == [("e", "run", "b1")]
    assert [(r.fault, r[S.CORRUPT]) for r in faulty.collect()] == [("unreadable", json.dumps(good)[:30])]


def test_store_is_flattened(spark, tmp_path):
    item = {"name": "Lamp", "product_id": "p", "item_id": "i", "price": 2.5, "options": {"size": "s"}}
    db = {"products": {"p": {"product_id": "p", "name": "Lamp", "variants": {"i": {"item_id": "i", "options": {"size": "s"}, "available": True, "price": 2.5}}}},
          "users": {"u": {"user_id": "u", "name": {"first_name": "A", "last_name": "B"}, "email": "e", "address": {"city": "c"}, "orders": ["o", "q"],
                          "payment_methods": {"g1": {"id": "g1", "source": "gift_card", "balance": 3.0}}}},
          "orders": {"o": {"order_id": "o", "user_id": "u", "status": "pending", "address": {"city": "c"}, "items": [item, item],
                           "payment_history": [{"transaction_type": "payment", "amount": 5.0, "payment_method_id": "g1"}]}, "q": {"order_id": "q"}}}
    (tmp_path / "db.json").write_text(json.dumps(db, indent=1))
    s = R.read_store(spark, f"{tmp_path}/db.json")
    assert [(r.user_id, r.last_name, r.city, r.n_orders) for r in s["users"].collect()] == [("u", "B", "c", 2)]
    assert sorted((r.order_id, r.user_id, r.city) for r in s["orders"].collect()) == [("o", "u", "c"), ("q", None, None)]
    assert [(r.order_id, r.pos, r.item_id, r.price, r.options) for r in s["order_items"].collect()] == [("o", p, "i", 2.5, {"size": "s"}) for p in (0, 1)]
    assert [(r.order_id, r.amount, r.payment_method_id) for r in s["order_payments"].collect()] == [("o", 5.0, "g1")]
    assert [(r.item_id, r.price) for r in s["variants"].collect()] == [("i", 2.5)] and [r.payment_id for r in s["payments"].collect()] == ["g1"]
