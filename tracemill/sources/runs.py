"""Run outputs, task files, profiles, splits, ledgers and metrics logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import episode as E
from tracemill.session import materialise
from tracemill.sources import schema as S


# ------------------------------------------------------------------ evaluation runs

def simulations(docs: DataFrame) -> DataFrame:
    """One row per simulation of parsed run results (column ``simulations``). A simulation without reward
    info died on infrastructure; it stays, flagged."""
    s = docs.select(*[c for c in docs.columns if c != "simulations"], F.explode("simulations").alias("s"))
    return flatten_simulation(s, "s")


def flatten_simulation(df: DataFrame, col: str) -> DataFrame:
    keep = [c for c in df.columns if c != col]
    s = F.col(col)
    agent = F.filter(s["messages"], lambda m: m["role"] == "assistant")

    def tokens(field: str) -> Column:
        return F.aggregate(agent, F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(m["usage"][field], F.lit(0)))
    return df.select(
        *keep, s["id"].alias("sim_id"), s["task_id"].alias("task_id"), s["reward_info"]["reward"].alias("reward"),
        s["reward_info"]["db_check"]["db_reward"].alias("db_reward"), s["reward_info"].isNotNull().alias("scored"),
        F.element_at(F.split(s["termination_reason"], r"\."), -1).alias("ending"), F.coalesce(s["duration"], F.lit(0.0)).alias("duration"),
        F.coalesce(s["user_cost"], F.lit(0.0)).alias("user_cost"), F.size(agent).alias("agent_turns"),
        tokens("prompt_tokens").alias("prompt_tokens"), tokens("completion_tokens").alias("completion_tokens"),
        F.flatten(F.transform(agent, lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string>>")), lambda c: c["name"]))).alias("calls"))


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    docs = spark.read.schema(f"simulations array<{S.SIMULATION}>").option("multiLine", True).json(list(paths))
    return simulations(docs.withColumn("run", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1)))


def run_costs(monolithic: DataFrame, single: DataFrame) -> DataFrame:
    """Costs from both checkpoint layouts (columns id, user_cost): an id in the monolithic file wins over
    its own file, and a missing cost is 0."""
    both = monolithic.select("id", "user_cost", F.lit(0).alias("rank")).unionByName(single.select("id", "user_cost", F.lit(1).alias("rank")))
    return both.groupBy("id").agg(F.min(F.struct("rank", F.coalesce("user_cost", F.lit(0.0)).alias("usd")))["usd"].alias("usd"))


def read_costs(spark: SparkSession, run_dir: str) -> DataFrame:
    mono = spark.read.schema("simulations array<struct<id:string,user_cost:double>>").option("multiLine", True).json(f"{run_dir}/results.json")
    single = spark.read.schema("user_cost double").option("multiLine", True).json(f"{run_dir}/simulations/*.json")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return run_costs(mono.select(F.explode("simulations").alias("s")).select("s.id", "s.user_cost"), single.select(stem.alias("id"), "user_cost"))


def estimated_spend(costs: DataFrame, judge_factor: float, per_episode: float) -> DataFrame:
    return costs.agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("customer_usd")).withColumn(
        "estimated_usd", F.col("customer_usd") * judge_factor + F.col("episodes") * per_episode)


# ------------------------------------------------------------------ task files

def read_tasks(spark: SparkSession, *paths: str) -> DataFrame:
    """Task arrays; instructions stay text because they are a string in one format and a record in the
    other. The files are small configuration files, each parsed as one record."""
    return spark.read.schema(S.TASK).option("multiLine", True).json(list(paths)).withColumnRenamed("id", "task_id")


def gold_actions(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", F.posexplode("evaluation_criteria.actions").alias("pos", "a")).select(
        "task_id", "pos", "a.name", "a.arguments")


def count_map(text: Column) -> Column:
    return F.from_json(text, "map<string,struct<successes:int,trials:int>>")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(count_map(F.col("value"))).alias("task_id", "p")).select("task_id", "p.successes", "p.trials")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.from_json("value", "map<string,struct<family:string,writes:int,level:int>>")).alias("task_id", "r")).select("task_id", "r.*")


def split_rows(text: Column) -> Column:
    """(task_id, part) rows from the JSON of a split: a map of part to id list."""
    m = F.map_entries(F.from_json(text, "map<string,array<string>>"))
    return F.flatten(F.transform(m, lambda e: F.transform(e["value"], lambda t: F.struct(t.alias("task_id"), e["key"].alias("part")))))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.inline(split_rows(F.col("value"))))


def convert_task(index: Column, instruction: Column, actions: Column, outputs: Column) -> Column:
    """An external task in the record schema: id tb_%04d, numbered gold actions, the default reward basis."""
    tid = F.concat(F.lit("tb_"), F.when(F.length(index.cast("string")) < 4, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string")))
    acts = F.transform(actions, lambda a, j: F.struct(
        F.concat(tid, F.lit("_"), j.cast("string")).alias("action_id"), F.lit("assistant").alias("requestor"), a["name"].alias("name"), a["kwargs"].alias("arguments")))
    return F.struct(tid.alias("id"), instruction.alias("instructions"), acts.alias("actions"), outputs.alias("communicate_info"),
                    F.array(F.lit("DB"), F.lit("COMMUNICATE")).alias("reward_basis"))


# ------------------------------------------------------------------ ledgers and logs

def parse_ledger(lines: DataFrame, line: str = "value") -> DataFrame:
    """Ledger lines with NUL bytes and outer blanks removed; blank lines leave, unreadable ones are kept as
    corrupt with no amount, and a missing amount counts 0."""
    c = lines.withColumn("_t", F.regexp_replace(line, r"^[\s\x00]+|[\s\x00]+$", "")).where("_t <> ''")
    ok = F.try_parse_json("_t").isNotNull()
    rec = F.when(ok, F.from_json("_t", S.LEDGER))
    return c.select(*[x for x in lines.columns if x != line], (~ok).alias("corrupt"), rec["at"].alias("at"),
                    F.when(ok, F.coalesce(rec["usd"], F.lit(0.0))).alias("usd"), rec["what"].alias("what"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_ledger(spark.read.text(path))


def ledger_lines(spend: DataFrame) -> DataFrame:
    return spend.select(F.to_json(F.struct(F.col("at").cast("string").alias("at"), F.round("usd", 6).alias("usd"), "what")).alias("value"))


def append_ledger(spend: DataFrame, path: str) -> None:
    ledger_lines(spend).write.mode("append").text(path)


def not_logged(new: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the log does not hold yet."""
    return new.join(log.select(*key), key, "left_anti")


def damaged_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Text files holding NUL bytes, line by line so that large files split over tasks."""
    t = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.contains("value", F.lit("\x00")).cast("int").alias("bad"))
    return t.groupBy("file").agg(F.sum("bad").alias("bad_lines")).where("bad_lines > 0")


def step_mismatch(metrics: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Runs whose last logged step is not the step before their checkpoint's."""
    last = metrics.groupBy("run").agg(F.max("step").alias("last_step"))
    return checkpoints.join(last, "run").where(F.col("last_step") != F.col("ckpt_step") - 1)


# ------------------------------------------------------------------ store documents

PRODUCT = "struct<product_id:string,name:string,variants:map<string,struct<item_id:string,options:map<string,string>,available:boolean,price:double>>>"
USER = ("struct<user_id:string,name:struct<first_name:string,last_name:string>,email:string,address:struct<city:string,state:string,zip:string>,"
        "payment_methods:map<string,struct<id:string,source:string,brand:string,last_four:string,balance:double>>,orders:array<string>>")


def product_variants(products: DataFrame, col: str) -> DataFrame:
    p = products.select(F.from_json(col, PRODUCT).alias("p"))
    return p.select("p.product_id", F.col("p.name").alias("product_name"), F.explode("p.variants").alias("item_id", "v")).select(
        "product_id", "product_name", "item_id", "v.options", "v.available", "v.price")


def user_payments(users: DataFrame, col: str) -> DataFrame:
    u = users.select(F.from_json(col, USER).alias("u"))
    return u.select("u.user_id", "u.name.first_name", "u.address.city", F.explode("u.payment_methods").alias("payment_id", "m")).select(
        "user_id", "first_name", "city", "payment_id", "m.source", "m.balance")


ORDER = ("struct<order_id:string,user_id:string,status:string,address:struct<city:string,state:string,zip:string>,"
         "items:array<struct<name:string,product_id:string,item_id:string,price:double,options:map<string,string>>>,"
         "payment_history:array<struct<transaction_type:string,amount:double,payment_method_id:string>>>")


def flat_users(users: DataFrame, col: str) -> DataFrame:
    """One row a user; payment methods are in ``user_payments``."""
    u = users.select(F.from_json(col, USER).alias("u"))
    return u.select("u.user_id", "u.name.first_name", "u.name.last_name", "u.email", "u.address.*", F.size("u.orders").alias("n_orders"))


def flat_orders(orders: DataFrame, col: str) -> dict[str, DataFrame]:
    """Order documents as the tables orders, order_items (pos as listed) and order_payments. An order without items or
    payments has no rows there; a document that cannot be read is one order row of nulls. Documents are read once into a
    written table, which the three take their columns from."""
    o = materialise(orders.select(F.from_json(col, ORDER).alias("o")), "order-documents")
    return {"orders": o.select("o.order_id", "o.user_id", "o.status", "o.address.*"),
            "order_items": o.select("o.order_id", F.posexplode("o.items").alias("pos", "i")).select("order_id", "pos", "i.*"),
            "order_payments": o.select("o.order_id", F.posexplode("o.payment_history").alias("pos", "p")).select("order_id", "pos", "p.*")}


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The entity tables of a nested store file: variants, users, payments, orders, order_items and order_payments. The
    file is parsed once into its three parts."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<products:map<string,variant>,users:map<string,variant>,orders:map<string,variant>>").alias("db"))

    def part(name: str) -> DataFrame:
        return t.select(F.explode(F.col("db")[name]).alias("id", "v")).select("id", F.to_json("v").alias("doc"))
    users = part("users")
    return {"variants": product_variants(part("products"), "doc"), "users": flat_users(users, "doc"), "payments": user_payments(users, "doc"), **flat_orders(part("orders"), "doc")}


def profile_rows(episodes: DataFrame) -> DataFrame:
    return episodes.select("task_id", E.eval_reward(F.col("reward"), F.col("termination")).alias("reward"))
