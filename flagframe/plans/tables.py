"""Inputs of the registered queries: the given tables and what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flagframe.functions.bits import FlagSet
from flagframe.operators.corpus import score_contexts, weighted_complexity
from flagframe.operators.flags import pack_flags
from flagframe.operators.ordered import number_rows
from flagframe.streaming.state import as_job_events

LINE_FLAGS = {
    "returned": "l_returnflag = 'R'",
    "open": "l_linestatus = 'O'",
    "discounted": "l_discount > 0",
    "taxed": "l_tax > 0",
    "bulk": "l_quantity >= 30",
}
LINE_SET = FlagSet(LINE_FLAGS)

ORDER_FLAGS = {
    "finished": "o_orderstatus = 'F'",
    "open": "o_orderstatus = 'O'",
    "partial": "o_orderstatus = 'P'",
    "large": "o_totalprice > 250000",
    "late": "o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'",
}
ORDER_SET = FlagSet(ORDER_FLAGS)

EVENT_SET = FlagSet(("signup", "view", "click", "purchase", "error"))

LEGACY_ALIASES = {
    "auth": "auth",
    "sanitize": "sanitize",
    "validateAndSanitize": "sanitize",
    "sanitize_body": "sanitize_body",
    "validateAndSanitizeBody": "sanitize_body",
}
LEGACY_SET = FlagSet(("auth", "sanitize", "sanitize_body"), first_bit=1)

JOB_OPS = {"signup": "start", "click": "retry", "view": "cancel", "purchase": "complete", "error": "fail"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its five conditions packed into ``flags``."""
    return pack_flags(table(spark, sf_dir, "lineitem"), LINE_FLAGS)


def order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_flags(table(spark, sf_dir, "orders"), ORDER_FLAGS)


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks per order by priority; orders of one priority get no update."""
    priority = F.col("o_orderpriority")

    def masks(urgent: int, high: int, medium: int, low: int) -> Column:
        return (
            F.when(priority == "1-URGENT", F.lit(urgent))
            .when(priority == "2-HIGH", F.lit(high))
            .when(priority == "3-MEDIUM", F.lit(medium))
            .otherwise(F.lit(low))
        )

    return (
        table(spark, sf_dir, "orders")
        .where(priority != "4-NOT SPECIFIED")
        .select(
            "o_orderkey",
            masks(32, 64, 0, 8).alias("set_mask"),
            masks(2, 0, 24, 1).alias("clear_mask"),
            masks(0, 8, 16, 0).alias("toggle_mask"),
            masks(0, 8, 2, 1).alias("require_mask"),
        )
    )


def event_day(ts: str = "ts") -> Column:
    return F.date_format(F.col(ts).cast("date"), "yyyy-MM-dd").alias("day")


def event_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``flags`` = the bit of their type."""
    conditions = {n: F.col("event_type") == n for n in EVENT_SET.names}
    return pack_flags(table(spark, sf_dir, "events"), conditions)


VALUE_FLAGS = {"small": "value < 10", "medium": "value >= 10 and value < 60", "big": "value >= 60"}


def pack_value_flags(events: DataFrame) -> DataFrame:
    """events with ``flags`` packed from the size of their value."""
    return pack_flags(events, VALUE_FLAGS)


def value_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_value_flags(table(spark, sf_dir, "events"))


def assign_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("field"), (F.col("value") > 10).alias("value"), F.col("event_id").alias("seq")
    )


def event_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three stages a user goes through in a day; other events have none."""
    kind = F.col("event_type")
    stage = F.when(kind == "signup", 0).when(kind == "view", 1).when(kind == "purchase", 2)
    return table(spark, sf_dir, "events").select("user_id", event_day(), stage.alias("stage"))


def legacy_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    pairs = [
        item
        for i, key in enumerate(LEGACY_ALIASES)
        for item in (F.lit(key), size.bitwiseAND(F.lit(1 << i)) != 0)
    ]
    settings = F.when(size < 50, F.create_map(*pairs))
    return table(spark, sf_dir, "part").select("p_partkey", settings.alias("settings"))


def struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations read as field lists: a struct per conversation, a field per turn."""
    turns = table(spark, sf_dir, "conversations")
    heads = turns.where(F.col("turn") == 0).select("conv_id", F.col("role").alias("file"))
    return turns.join(heads, "conv_id").select(
        "file",
        F.col("conv_id").alias("struct_name"),
        F.col("turn").alias("pos"),
        F.concat(F.lit("f"), F.col("turn").cast("string")).alias("field"),
        F.when(F.length("text") % 3 == 0, F.lit("bool")).otherwise(F.lit("string")).alias("type"),
        (F.col("turn") + 1).cast("int").alias("line"),
    )


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part read as rule chains: one per brand, branches in key order."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type", "p_name", "p_size")
    numbered = number_rows(part, ["p_brand"], ["p_partkey"], "position")
    return numbered.select(
        F.col("p_brand").alias("chain_id"),
        "position",
        F.when(F.col("p_size") == 50, F.lit("p_name")).otherwise(F.lit("p_type")).alias("var"),
        F.when(F.col("p_size") == 49, F.lit("!=")).otherwise(F.lit("==")).alias("op"),
        F.lit("string").alias("lit_kind"),
        F.col("p_type").alias("value"),
        F.col("p_name").alias("action"),
    )


def priority_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over the priorities per order status; one of them breaks too early to compile."""
    found = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    numbered = number_rows(found, ["o_orderstatus"], ["o_orderpriority"], "position")
    priority = F.col("o_orderpriority")
    breaks = (priority == "5-LOW") | ((F.col("o_orderstatus") == "P") & (priority == "3-MEDIUM"))
    return numbered.select(
        F.col("o_orderstatus").alias("chain_id"),
        "position",
        F.lit("priority").alias("var"),
        F.when(breaks, F.lit("!=")).otherwise(F.lit("==")).alias("op"),
        F.lit("string").alias("lit_kind"),
        priority.alias("value"),
        F.concat(F.lit("lane_"), "o_orderstatus", F.substring(priority, 1, 1)).alias("action"),
    )


# Everything but letters and digits of any script, underscore and dollar.
TOKEN_SEPARATOR = r"[^\p{L}\p{Nd}_$]+"


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document."""
    words = F.filter(F.split("text", TOKEN_SEPARATOR), lambda t: t != "")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return documents.select(F.col("source").alias("file"), "lang", F.explode(words).alias("literal"))


def document_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A force mark for good documents, and later a keep mark for toxic ones."""
    force = F.when(F.col("quality") == 1, F.struct(F.lit(1).alias("seq"), F.lit("force").alias("mark")))
    keep = F.when(F.col("toxic") == 1, F.struct(F.lit(2).alias("seq"), F.lit("nobfuscate").alias("mark")))
    marks = F.explode(F.array_compact(F.array(force, keep)))
    return table(spark, sf_dir, "labels").select("doc_id", marks.alias("m")).select("doc_id", "m.seq", "m.mark")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as syntax nodes owned by a user's day."""
    kind = F.col("event_type")
    node = (
        F.when(kind == "signup", "if").when(kind == "error", "for").when(kind == "click", "switch")
        .when(kind == "view", "call").otherwise("other")
    )
    return table(spark, sf_dir, "events").select("user_id", event_day(), "event_id", node.alias("kind"))


def code_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored context per user and day."""
    user = F.col("user_id")
    kind = (
        F.when(user % 4 == 0, "function").when(user % 4 == 1, "if_chain").when(user % 4 == 2, "switch")
        .otherwise("struct")
    )
    prefix = (
        F.when(user % 5 == 0, "config_").when(user % 5 == 1, "util_").when(user % 5 == 2, "Check_")
        .when(user % 5 == 3, "handler_").otherwise("x_")
    )
    scored = weighted_complexity(code_nodes(spark, sf_dir), ["user_id", "day"])
    return score_contexts(
        scored.select(
            F.col("day").alias("file"),
            kind.alias("type"),
            F.concat(prefix, user.cast("string")).alias("name"),
            "complexity",
            user.cast("int").alias("start_line"),
            (user + 1).cast("int").alias("end_line"),
        )
    )


def owners_and_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases open an interval of 400 event ids; every other event lies somewhere."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    is_owner = F.col("event_type") == "purchase"
    owners = events.where(is_owner).select(
        F.col("user_id").alias("file"),
        F.concat(F.lit("fn_"), F.col("event_id").cast("string")).alias("name"),
        F.col("event_id").alias("start_line"),
        (F.col("event_id") + 400).alias("end_line"),
    )
    nodes = events.where(~is_owner).select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.col("event_type").alias("kind")
    )
    return owners, nodes


def nested_owners_and_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same events with intervals of many lengths, which nest and overlap."""
    owners, nodes = owners_and_nodes(spark, sf_dir)
    longer = F.col("end_line") + F.col("start_line") % 7 * 900
    kind = F.when(F.col("kind") == "error", "for").when(F.col("kind") == "view", "call").otherwise("if")
    return owners.withColumn("end_line", longer), nodes.withColumn("kind", kind)


def turn_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns linked to the next one; a system turn ends its chain."""
    node = F.shiftleft("conv_id", 32) + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        node.alias("id"), F.when(F.col("role") != "system", node + 1).alias("else_id")
    )


def looped_turn_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns linked to the next one; in every third conversation the last turn leads back to the second."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    base = F.shiftleft("conv_id", 32)
    goes = F.when((F.col("turn") == F.col("last")) & (F.col("conv_id") % 3 == 0), base + 1).when(F.col("role") != "system", base + F.col("turn") + 1)
    return turns.join(last, "conv_id").select((base + F.col("turn")).alias("id"), goes.alias("else_id"))


def region_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region: nations as functions, some of them handlers, and suppliers as structs."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    is_handler = F.endswith(F.col("n_name"), F.lit("1"))
    functions = nation.select(
        F.col("n_regionkey").alias("file"),
        F.lit("function").alias("type"),
        F.concat(F.when(is_handler, F.lit("Handler_")).otherwise(F.lit("fn_")), "n_name").alias("name"),
        F.col("n_nationkey").cast("bigint").alias("start_line"),
    )
    structs = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("file"),
        F.lit("struct").alias("type"),
        F.col("s_name").alias("name"),
        F.col("s_suppkey").alias("start_line"),
    )
    return functions.unionByName(structs)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text", "source")


def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context per line of at least 200 characters."""
    lines = document_files(spark, sf_dir).select("file", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.length("line") >= 200).select("file")


def document_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("file"),
        (F.col("quality") == 1).alias("transformed"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("error"),
    )


def page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context per link of a page beyond the fifth."""
    links = (F.length("html") - F.length(F.replace(F.col("html"), F.lit("<a "), F.lit("")))) / 3 - 5
    return (
        table(spark, sf_dir, "pages")
        .select(F.col("page_id").alias("file"), links.cast("int").alias("n"))
        .where(F.col("n") > 0)
        .select("file", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("context"))
    )


def candidate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with some prices changed, some rows gone and some copies added."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    dear = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)
    gone = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    copied = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") < 20000)
    copies = F.when(
        copied, F.array(F.col("o_orderkey"), -1 - F.col("o_orderkey"))
    ).otherwise(F.array("o_orderkey"))
    return (
        orders.where(~gone)
        .withColumn("o_totalprice", F.when(dear, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
        .withColumn("o_orderkey", F.explode(copies))
    )


def part_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version texts in all the shapes that occur, by part size."""
    size = F.col("p_size")
    text = size.cast("string")
    version = (
        F.when(size == 50, F.lit("1.x"))
        .when(size == 49, F.lit("1.2"))
        .when(size >= 40, F.concat(F.lit("v1."), text, F.lit(".0")))
        .when(size >= 30, F.concat(F.lit("1."), text, F.lit(".2-rc1")))
        .otherwise(F.concat(F.lit("0."), text, F.lit("."), text))
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", version.alias("version"))


def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as registry entries, nested under ``control`` for some types and flat for others."""
    k = F.get_json_object("props", "$.k").cast("bigint")

    def hex16(value: Column) -> Column:
        return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 16, "0"))

    control = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit("unix").alias("type"), F.concat(F.lit("/run/"), "event_type").alias("socket")).alias("ipc"),
        F.struct(
            F.lit(1024).alias("ns_bits"),
            hex16(F.col("event_id")).alias("cap_mask"),
            hex16(k * F.col("event_id")).alias("state_hex"),
        ).alias("bitreg"),
        F.struct(
            F.array(F.struct(F.concat(F.lit("0x"), F.hex("user_id")).alias("key_hash"))).alias("declare_hashes"),
            F.array(
                F.struct(
                    F.concat(F.lit("0x"), F.hex("user_id")).alias("key_hash"), hex16(k).alias("u64_hex")
                ),
                F.struct(
                    F.concat(F.lit("0x"), F.hex(F.col("user_id") + 1)).alias("key_hash"),
                    hex16(F.col("event_id") + k).alias("u64_hex"),
                ),
            ).alias("values"),
            F.lit("u64").alias("encoding"),
        ).alias("kv"),
        k.alias("seq"),
        (F.lit(1_700_000_000_000_000_999) + F.col("event_id") * 1000000007).alias("epoch_ns"),
    )
    body = F.when(
        F.col("event_type").isin("view", "click"), F.to_json(F.struct(control.alias("control")))
    ).otherwise(F.to_json(control))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return events.select("event_id", body.alias("body"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", event_day(), "ts", "event_id", "event_type")
    return as_job_events(events, JOB_OPS, "event_type")


def broken_props(events: DataFrame) -> DataFrame:
    """Properties of expensive errors get a mark in front, so that some rows are malformed."""
    broken = (F.col("event_type") == "error") & (F.col("value") > 50)
    return events.select(
        "event_id",
        F.col("event_type").alias("package"),
        F.when(broken, F.concat(F.lit("!"), "props")).otherwise(F.col("props")).alias("props"),
    )


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with control comments in their texts: plain and spaced, some with both marks."""
    turn = F.col("turn")
    comment = (
        F.when(F.col("conv_id") % 5 == 0, "//flagframe:nobfuscate").when((F.col("conv_id") % 5 == 1) & (turn == 1), "// flagframe:force")
        .when(F.col("conv_id") % 5 == 2, F.when(turn == 0, "// flagframe:nobfuscate").otherwise("//flagframe:force"))
        .when(F.col("conv_id") % 5 == 3, "// flagframe:force flagframe:nobfuscate").otherwise("")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rows.withColumn("text", F.concat("text", F.lit("\n"), F.coalesce(comment, F.lit(""))))


WIDE_FLAGS = {f"f{i}": "false" if i in (62, 63) else f"(l_partkey + l_linenumber + {i * i}) % 11 = 0" for i in range(70)}
WIDE_SET = FlagSet(WIDE_FLAGS)


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with 70 conditions in masks of two words; bits 62 and 63 stay empty."""
    return pack_flags(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), WIDE_FLAGS)


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of eight letters and more in the conversations, the shorter and then the alphabetically lesser first."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 8)
    found = table(spark, sf_dir, "conversations").select(F.explode(words).alias("keyword")).distinct()
    numbered = number_rows(found.withColumn("letters", F.length("keyword")), ["letters"], ["keyword"])
    return numbered.select("keyword", (F.col("letters") * F.lit(1_000_000_000_000) + F.col("row_no")).alias("rank"))
