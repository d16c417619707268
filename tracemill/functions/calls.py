"""Tool-call columns: parsing, canonical forms, write keys and write closeness.

Arguments travel as JSON text and are compared as ``map<string,string>`` that keeps the type of each value: a JSON string
is itself, null is null, any other value is ``MARK`` and its canonical JSON (object keys sorted). So 1 differs from "1", a
text that starts with ``[`` is no list, and 1 differs from 1.0 (inside nested objects numbers compare by value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The retail tool sets.
READ_TOOLS = ("calculate", "find_user_id_by_email", "find_user_id_by_name_zip", "get_item_details",
              "get_order_details", "get_product_details", "get_user_details",
              "list_all_product_types", "think", "transfer_to_human_agents")
AUTH_TOOLS = ("find_user_id_by_email", "find_user_id_by_name_zip")
AUTH_TOOLS_WIDE = AUTH_TOOLS + ("get_user_details",)
SWAP_TOOLS = ("modify_pending_order_items", "exchange_delivered_order_items")
WRITE_TOOLS = ("return_delivered_order_items", "exchange_delivered_order_items", "cancel_pending_order",
               "modify_pending_order_items", "modify_pending_order_address", "modify_pending_order_payment",
               "modify_user_address")
ERROR_PREFIX = "Error"

MARK = "\x01"             # begins values that are not JSON strings
EMPTY_VALUES = ("null", "0", "0.0", "false", '""', "[]")
ARGS = "map<string,string>"
STRINGS = "array<string>"
# a list of texts as ``_typed`` writes it; possessive, so that a long one takes no stack
PLAIN_TEXTS = "^" + MARK + r'\["[^"\\\x00-\x1f]*+"(?:,"[^"\\\x00-\x1f]*+")*+\]\z'


def is_write(name: Column, read_tools: tuple[str, ...] = READ_TOOLS) -> Column:
    return name.isNotNull() & ~name.isin(*read_tools)


def tool_class(name: Column, read_tools: tuple[str, ...] = READ_TOOLS,
               auth_tools: tuple[str, ...] = AUTH_TOOLS) -> Column:
    return (F.when(name.isin(*auth_tools), F.lit("auth")).when(name.isin(*read_tools), F.lit("read"))
            .otherwise(F.lit("write")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: expressions inside lambdas are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _typed(v: Column) -> Column:
    """A variant as text that keeps its type."""
    def of(json: Column) -> Column:
        text = F.variant_get(v, "$", "string")
        whole = json.rlike("^-?[0-9]+$") & F.schema_of_variant(v).startswith("DECIMAL")     # 1.0
        return (F.when(json == "null", F.lit(None).cast("string"))
                .when(json.startswith('"'), F.when(text.startswith(MARK), F.concat(F.lit(MARK), json)).otherwise(text))
                .otherwise(F.concat(F.lit(MARK), json, F.when(whole, F.lit(".0")).otherwise(F.lit("")))))
    return once(F.to_json(v), of)


def parse_args(arguments: Column) -> Column:
    """JSON text to a typed map. Blank text and the empty values of JSON (null, 0, false, "", []) are an empty map. Null: text
    that is no JSON, has anything behind its value, repeats a key, or is no object. The parser stops behind the first
    value, so the text is read once inside an array, which must have one element, and once inside an object."""
    def read(text: Column) -> Column:
        def fields(inside: Column) -> Column:
            alone = F.try_variant_get(inside, "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
            return F.transform_values(F.when(alone, F.try_variant_get(inside, "$[0]", "map<string,variant>")), lambda k, v: _typed(v))
        return F.when(text.isin("", *EMPTY_VALUES), F.create_map().cast(ARGS)).otherwise(
            once(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), fields))
    return once(F.trim(F.coalesce(arguments, F.lit(""))), read)


def readable_args(arguments: Column) -> Column:
    """(args, parse_error): unreadable text is kept under _unparsed and flagged."""
    return once(parse_args(arguments), lambda args: F.struct(
        F.coalesce(args, F.create_map(F.lit("_unparsed"), arguments)).alias("args"), args.isNull().alias("parse_error")))


def parse_calls(tool_calls: Column) -> Column:
    """Raw calls to (id, name, args, parse_error): missing ids become call_<i>."""
    def one(c: Column, i: Column) -> Column:
        return once(readable_args(c["arguments"]), lambda read: F.struct(
            F.coalesce(c["id"], F.concat(F.lit("call_"), i.cast("string"))).alias("id"), c["name"].alias("name"), read["args"].alias("args"), read["parse_error"].alias("parse_error")))
    return F.transform(F.coalesce(tool_calls, F.array().cast("array<struct<id:string,name:string,arguments:string>>")), one)


def _is_list(text: Column) -> Column:
    return F.coalesce(text.startswith(MARK + "["), F.lit(False))


def item_list(text: Column) -> Column:
    """The elements of a list value, typed like the values of a map; anything but a list has none. A list of plain texts (no
    quotes, backslashes or control characters inside) is cut at its commas, any other is parsed."""
    inner = F.substr(text, F.lit(len(MARK) + 3), F.length(text) - len(MARK) - 4)
    return F.when(text.rlike(PLAIN_TEXTS), F.split(inner, '","', -1)).otherwise(_parsed_list(text))


def _parsed_list(text: Column) -> Column:
    return F.coalesce(F.transform(F.from_json(F.when(_is_list(text), F.substr(text, F.lit(len(MARK) + 1))), "array<variant>"), _typed), F.array().cast(STRINGS))


def _pairs(old: Column, new: Column) -> Column:
    n = F.least(F.size(old), F.size(new))
    return F.arrays_zip(F.slice(old, F.lit(1), n).alias("old"), F.slice(new, F.lit(1), n).alias("new"))


def swap_pairs(args: Column) -> Column:
    """(old, new) pairs of a swap, by position."""
    return _pairs(item_list(args["item_ids"]), item_list(args["new_item_ids"]))


def canonical_args(args: Column) -> Column:
    """Comparable text: keys sorted, a lone item list sorted, a swap turned into its sorted pairs
    because only the mapping counts, not the listing order."""
    args = F.coalesce(args, F.create_map().cast(ARGS))
    listed = _is_list(args["item_ids"])
    swap = listed & _is_list(args["new_item_ids"])
    rest = F.map_filter(args, lambda k, v: ~(k.isin("item_ids", "new_item_ids") & swap | (k == "item_ids") & listed))
    items = (F.when(swap, F.concat(F.lit("pairs"), F.to_json(F.array_sort(swap_pairs(args)))))
             .when(listed, F.concat(F.lit("items"), F.to_json(F.array_sort(item_list(args["item_ids"])))))
             .otherwise(F.lit("")))
    return F.concat(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest)))), items)


def canonical_key(name: Column, args: Column) -> Column:
    return F.concat(name, F.lit(":"), canonical_args(args))


def write_key(name: Column, args: Column) -> Column:
    """(tool, target): the order when the call names one (even a null one), else the user."""
    args = F.coalesce(args, F.create_map().cast(ARGS))
    return F.struct(name.alias("name"),
                    F.when(F.map_contains_key(args, "order_id"), args["order_id"]).otherwise(args["user_id"]).alias("target"))


def match_target(args: Column) -> Column:
    """First non-empty of order and user."""
    return F.coalesce(F.nullif(args["order_id"], F.lit("")), args["user_id"])


def _share(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def closeness(gold: Column, done: Column) -> Column:
    """How near one write came to a gold write of the same tool and target, in [0, 1]: the share of
    the item part, halved unless every other gold field also matches; the share of matching fields
    where there is no item part."""
    listed = _is_list(gold["item_ids"])
    swap = listed & _is_list(gold["new_item_ids"])
    taken = F.when(swap, F.array(F.lit("item_ids"), F.lit("new_item_ids"))).when(
        listed, F.array(F.lit("item_ids"))).otherwise(F.array().cast(STRINGS))
    fields = F.filter(F.map_keys(gold), lambda k: ~k.isin("order_id", "user_id") & ~F.array_contains(taken, k))
    same = F.when(F.size(fields) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(fields, lambda k: F.element_at(gold, k).eqNullSafe(F.try_element_at(done, k))))
        / F.size(fields))
    items = F.when(swap, _share(swap_pairs(gold), swap_pairs(done))).when(
        listed, _share(item_list(gold["item_ids"]), item_list(done["item_ids"])))
    return F.when(items.isNull(), same).otherwise(items * F.when(same == 1.0, F.lit(1.0)).otherwise(F.lit(0.5)))


def option_closeness(a: Column, b: Column) -> Column:
    """Equal options over the union of option names."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    equal = F.filter(keys, lambda k: F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.size(equal) / F.size(keys)


def differing_options(a: Column, b: Column) -> Column:
    """Option names whose values differ, in name order."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
