"""Documents read as episode records, one row each, so that the record functions run on real text.

A line is a turn: long lines are agent turns whose digest names the tool calls, middle ones tool
results, short ones customer messages. A second view cuts the same text into token turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import calls as C
from tracemill.sources.tables import table

AGENT_WORDS, TOOL_WORDS, SECOND_CALL, GOLD_WORDS = 40, 10, 60, 50


def _tool(word: Column) -> Column:
    c = F.substring(word, 1, 1)
    return (F.when(c < "d", "get_order_details").when(c < "i", "find_user_id_by_email").when(c < "o", "cancel_pending_order")
            .otherwise("exchange_delivered_order_items"))


def _arguments(words: Column, start: int, other: Column | None = None) -> Column:
    """JSON arguments of the call named by word ``start``; ``other`` replaces the last new item."""
    w = [words[start - 1 + k] for k in range(5)]
    order = F.substring(w[1], 1, 2).alias("order_id")
    swap = F.to_json(F.struct(order, F.array(w[2], w[3]).alias("item_ids"), F.array(w[3], w[4] if other is None else other).alias("new_item_ids")))
    return F.when(_tool(w[0]) == C.SWAP_TOOLS[1], swap).otherwise(F.to_json(F.struct(order, w[2].alias("reason"))))


def doc_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # per line: its word count and 16 names from a digest of the whole line, computed once
    split = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x != ""))

    def names(line: Column) -> Column:
        return F.regexp_extract_all(F.translate(F.md5(line), "0123456789abcdef", "abcdefghijklmnop"), F.lit(".."), F.lit(0))
    facts = split.withColumn("facts", F.transform("lines", lambda line: F.struct(
        line.alias("line"), F.size(F.split(line, " ")).alias("n"), names(line).alias("w"))))

    def turn(f: Column) -> Column:
        role = F.when(f["n"] >= AGENT_WORDS, "assistant").when(f["n"] >= TOOL_WORDS, "tool").otherwise("user")
        call = lambda i, start: F.struct(F.lit(f"c{i}").alias("id"), _tool(f["w"][start - 1]).alias("name"), _arguments(f["w"], start).alias("arguments"))
        calls = F.when(f["n"] >= SECOND_CALL, F.array(call(0, 1), call(1, 10))).when(f["n"] >= AGENT_WORDS, F.array(call(0, 1)))
        content = F.when(F.lower(F.substring(f["line"], 1, 1)) < "h", F.concat(F.lit("Error: "), f["line"])).otherwise(f["line"])
        return F.struct(F.when(f["n"] >= AGENT_WORDS, "a").otherwise("e").alias("kind"), role.alias("role"),
                        F.when(f["n"] >= AGENT_WORDS, f["line"]).alias("text"), F.lit("stop").alias("finish_reason"),
                        F.when(role == "tool", content).when(role == "user", f["line"]).alias("content"), F.lit(None).cast("string").alias("tool_name"), calls.alias("tool_calls"))

    def gold(f: Column) -> Column:
        other = F.when(F.substring(f["w"][4], 1, 1) < "n", f["w"][4]).otherwise(f["w"][5])
        return F.struct(_tool(f["w"][0]).alias("name"), C.parse_args(_arguments(f["w"], 1, other)).alias("args"))
    return facts.select("doc_id", "source", "lang", "n_chars", F.transform("facts", turn).alias("turns"),
                        F.transform(F.filter("facts", lambda f: f["n"] >= GOLD_WORDS), gold).alias("gold"),
                        F.when(F.col("lang") == "en", 1).otherwise(0).alias("reward"),
                        F.when(F.col("n_chars") > 6000, "length").otherwise("natural").alias("termination"))


LINES_SQL = """docs AS (SELECT doc_id, source, lang, n_chars, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM docs),
words AS (SELECT doc_id, i, line, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n FROM lines),
clean AS (SELECT *, regexp_extract_all(translate(md5(line), '0123456789abcdef', 'abcdefghijklmnop'), '..') AS c, CASE WHEN n >= 40 THEN 'assistant' WHEN n >= 10 THEN 'tool' ELSE 'user' END AS role FROM words),
rawcalls AS (SELECT doc_id, i, 0 AS j, 1 AS w_at, c, n FROM clean WHERE role = 'assistant' UNION ALL SELECT doc_id, i, 1, 10, c, n FROM clean WHERE role = 'assistant' AND n >= 60),
named AS (SELECT doc_id, i, j, n, c[w_at] AS w0, coalesce(c[w_at+1], '') AS w1, coalesce(c[w_at+2], '') AS w2, coalesce(c[w_at+3], '') AS w3, coalesce(c[w_at+4], '') AS w4, coalesce(c[w_at+5], '') AS w5,
  CASE WHEN substr(c[w_at], 1, 1) < 'd' THEN 'get_order_details' WHEN substr(c[w_at], 1, 1) < 'i' THEN 'find_user_id_by_email' WHEN substr(c[w_at], 1, 1) < 'o' THEN 'cancel_pending_order' ELSE 'exchange_delivered_order_items' END AS name FROM rawcalls),
keyed AS (SELECT *, substr(w1, 1, 2) AS target, CASE WHEN name LIKE 'exch%' THEN array_to_string(list_sort([w2 || '>' || w3, w3 || '>' || w4]), ',') ELSE w2 END AS detail FROM named),
results AS (SELECT k.*, (SELECT count(*) FROM clean t WHERE t.doc_id = k.doc_id AND t.i > k.i AND t.i <= k.i + k.j + 1 AND t.role = 'tool') = k.j + 1 AS have,
  (SELECT lower(substr(t.line, 1, 1)) < 'h' FROM clean t WHERE t.doc_id = k.doc_id AND t.i = k.i + k.j + 1) AS err FROM keyed k),
calls AS (SELECT *, name NOT IN ('get_order_details', 'find_user_id_by_email') AS is_write, have AND NOT err AS ok, have AND err AS rejected FROM results),
gold AS (SELECT doc_id, name, target, CASE WHEN name LIKE 'exch%' THEN array_to_string(list_sort([w2 || '>' || w3, w3 || '>' || CASE WHEN substr(w4, 1, 1) < 'n' THEN w4 ELSE w5 END]), ',') ELSE w2 END AS detail
  FROM keyed WHERE j = 0 AND n >= 50 AND name NOT IN ('get_order_details', 'find_user_id_by_email'))"""


def doc_token_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four agent turns cut from the text at its quarters. The last two are rendered with line breaks as
    spaces, so a break inside the shared history makes the prompts part."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")

    def tokens(t: Column) -> Column:
        return F.transform(F.split(t, " "), lambda w: (F.ascii(w) * 100 + F.char_length(w)).cast("int"))
    d = d.select("doc_id", "source", tokens(F.col("text")).alias("x"), tokens(F.replace("text", F.lit("\n"), F.lit(" "))).alias("y"))
    n = F.size("x")

    def turn(k: int) -> Column:
        src = F.col("x") if k < 2 else F.col("y")
        a, b = F.floor(n * (2 * k + 1) / 8).cast("int"), F.floor(n * (2 * k + 2) / 8).cast("int")
        out = F.slice(src, a + 1, b - a)
        return F.struct(F.lit("a").alias("kind"), F.slice(src, F.lit(1), a).alias("prompt_token_ids"), out.alias("token_ids"),
                        F.transform(out, lambda t: -(t % 100) / 10.0).alias("logprobs"),
                        F.array(F.struct(F.lit(f"tool{k}").alias("name"))).alias("tool_calls"))
    return d.select("doc_id", "source", F.array(*[turn(k) for k in range(4)]).alias("turns"))


TOKENS_SQL = """toks AS (SELECT doc_id, source, list_transform(string_split(text, ' '), lambda w: ascii(w) * 100 + length(w)) AS x,
  list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda w: ascii(w) * 100 + length(w)) AS y, len(string_split(text, ' ')) AS n FROM documents),
turns AS (SELECT doc_id, source, k, CASE WHEN k < 2 THEN x ELSE y END AS src, CAST(floor(n * (2 * k + 1) / 8.0) AS INTEGER) AS a, CAST(floor(n * (2 * k + 2) / 8.0) AS INTEGER) AS b FROM toks, (SELECT unnest(range(4)) AS k)),
arr AS (SELECT doc_id, source, k, src[1:a] AS p, src[a+1:b] AS o, a, b FROM turns),
pairs AS (SELECT c.doc_id, c.source, c.k, n.p[1:c.a] = c.p AS prefix_ok, n.p[1:c.a] = c.p AND n.p[c.a+1:c.b] = c.o AS mask_ok, c.p AS cp, n.p AS np FROM arr c JOIN arr n ON n.doc_id = c.doc_id AND n.k = c.k + 1),
eps AS (SELECT doc_id, any_value(source) AS source, count(*) AS pairs, count(*) FILTER (prefix_ok) AS prefix_ok, count(*) FILTER (mask_ok) AS mask_ok, bool_and(mask_ok) AS single FROM pairs GROUP BY doc_id),
tot AS (SELECT doc_id, sum(b) AS per_turn, max(b) AS single_tokens, sum(b - a) AS trained FROM arr GROUP BY doc_id)"""
