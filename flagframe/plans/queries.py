"""The registered queries: every operator run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagframe.functions.bits import FlagSet
from flagframe.operators import corpus, dispatch, flags, masking, reports, state, textscan
from flagframe.plans import tables
from flagframe.plans.passes import run_passes, standard_passes
from flagframe.session import scratch_path, staged
from flagframe.sources import dictionary, files, folds, masked, outputs, registry
from flagframe.streaming import keyed, sessions
from flagframe.streaming import state as stream_state
from flagframe.streaming.registers import stream_union_flags
from flagframe.streaming.sinks import latest_rows, start_batches

Query = Callable[[SparkSession, str], DataFrame]

LINE_KEY = ("l_orderkey", "l_partkey", "l_linenumber")
DISPATCH_CASES = ((0, "refund"), (2, "rebate"), (4, "freight"))
KEYWORDS = ("license", "the ", "de ", "check")
NEEDLES = ("de ", "la ")
PASS_RULES = {"A": "accept", "N": "note", "R": "refund"}

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- flags on tables ------------------------------------------------------------------


@query
def order_flags(spark, sf_dir):
    """Pack line conditions, union them per order, count and decode: the flagship."""
    packed = tables.line_flags(spark, sf_dir)
    registers = flags.union_flags(packed, ["l_orderkey"])
    named = flags.decode_flags(registers, tables.LINE_SET)
    return named.withColumn("n_flags", F.bit_count("flags"))


@query
def flags_pack(spark, sf_dir):
    return tables.line_flags(spark, sf_dir).select(*LINE_KEY, "flags")


@query
def flags_unpack(spark, sf_dir):
    packed = tables.line_flags(spark, sf_dir).select(*LINE_KEY, "flags")
    return flags.unpack_flags(packed, tables.LINE_SET)


@query
def flags_filter(spark, sf_dir):
    """The condition is stated on the source columns and reaches the reader."""
    lines = tables.table(spark, sf_dir, "lineitem")
    kept = flags.filter_flags(
        lines,
        tables.LINE_SET,
        all_of=["returned"],
        any_of=["discounted", "taxed"],
        none_of=["bulk"],
        definitions=tables.LINE_FLAGS,
    )
    return flags.pack_flags(kept, tables.LINE_FLAGS).select(*LINE_KEY, "flags")


@query
def flags_filter_mask(spark, sf_dir):
    """The same condition on the mask."""
    packed = tables.line_flags(spark, sf_dir)
    kept = flags.filter_flags(
        packed, tables.LINE_SET, all_of=["returned"], any_of=["discounted", "taxed"], none_of=["bulk"]
    )
    return kept.select(*LINE_KEY, "flags")


@query
def flags_filter_files(spark, sf_dir):
    """The same condition on a written table, of which only files that can match are opened."""
    path = scratch_path(spark, "masked-lines")
    masked.write_masked(tables.line_flags(spark, sf_dir).select(*LINE_KEY, "flags"), path, tables.LINE_SET)
    return masked.read_masked(spark, path, tables.LINE_SET, all_of=["returned"], any_of=["discounted", "taxed"], none_of=["bulk"])


@query
def flags_update(spark, sf_dir):
    packed = tables.order_flags(spark, sf_dir).select("o_orderkey", "flags")
    return flags.update_flags(packed, tables.order_updates(spark, sf_dir), "o_orderkey")


@query
def flags_fold(spark, sf_dir):
    return flags.fold_assignments(tables.assign_log(spark, sf_dir), tables.EVENT_SET, "user_id")


@query
def flags_fold_runs(spark, sf_dir):
    """The same log in three runs out of order, one of them twice, merged before the last."""
    path, keys = scratch_path(spark, "fold-runs"), ["user_id"]
    log = tables.assign_log(spark, sf_dir)
    errors, purchases = F.col("field") == "error", F.col("field") == "purchase"
    folds.save_fold(folds.fold_log(log.where(errors), keys), path, "errors")
    folds.save_fold(folds.fold_log(log.where(~errors & ~purchases & ~F.col("value")), keys), path, "cleared")
    folds.save_fold(folds.fold_log(log.where(errors), keys), path, "errors")
    folds.compact_folds(spark, path, keys)
    folds.save_fold(folds.fold_log(log.where(purchases | (~errors & F.col("value"))), keys), path, "others")
    return folds.masks_of(folds.load_folds(spark, path, keys), tables.EVENT_SET, keys)


@query
def flags_counts(spark, sf_dir):
    return flags.flag_counts(tables.line_flags(spark, sf_dir), tables.LINE_SET, by=["l_linestatus", "l_linenumber"])


@query
def flags_union(spark, sf_dir):
    return flags.union_flags(tables.event_bits(spark, sf_dir), ["user_id"])


@query
def flags_intersect(spark, sf_dir):
    return flags.intersect_flags(tables.line_flags(spark, sf_dir), ["l_orderkey"])


@query
def flags_parity(spark, sf_dir):
    return flags.parity_flags(tables.event_bits(spark, sf_dir), ["user_id"])


@query
def flags_decode(spark, sf_dir):
    """Declared order, sorted by name, and with the last two bits unknown."""
    packed = tables.line_flags(spark, sf_dir).select(*LINE_KEY, "flags")
    known = FlagSet(tables.LINE_SET.names[:3])
    named = flags.decode_flags(packed, tables.LINE_SET)
    named = flags.decode_flags(named, tables.LINE_SET, out="sorted_names", by_name=True)
    return flags.decode_flags(named, known, out="known_names").drop("flags")


@query
def flags_from_map(spark, sf_dir):
    maps = tables.legacy_maps(spark, sf_dir)
    return flags.flags_from_map(maps, "settings", tables.LEGACY_SET, tables.LEGACY_ALIASES).drop("settings")


@query
def flag_dictionary(spark, sf_dir):
    return flags.flag_dictionary(tables.struct_fields(spark, sf_dir))


@query
def dictionary_saved(spark, sf_dir):
    """The flag dictionary written as JSON and read back."""
    path = scratch_path(spark, "dictionary")
    dictionary.save_dictionary(flag_dictionary(spark, sf_dir), path)
    return dictionary.load_dictionary(spark, path).select("file", "struct_name", "field", "flag_name", "bit", "width")


@query
def flags_wide(spark, sf_dir):
    """Masks of 70 flags: union per order, count per line number, decode, dispatch, update."""
    lines = tables.wide_lines(spark, sf_dir)
    union = flags.union_flags(lines, ["l_orderkey"], flags=tables.WIDE_SET)
    updates = union.select("l_orderkey", F.array(F.lit(1).cast("bigint"), F.lit(32).cast("bigint")).alias("toggle_mask"))
    changed = flags.update_flags(union, updates, "l_orderkey", flags=tables.WIDE_SET)
    named = flags.decode_flags(changed, tables.WIDE_SET)
    cases = ((69, "last"), (64, "second word"), (0, "first"))
    return flags.dispatch_bits(named, cases).select("l_orderkey", "flag_names", "action")


@query
def flags_wide_counts(spark, sf_dir):
    return flags.flag_counts(tables.wide_lines(spark, sf_dir), tables.WIDE_SET, by=["l_linenumber"])


@query
def flags_dispatch(spark, sf_dir):
    packed = tables.line_flags(spark, sf_dir).select(*LINE_KEY, "flags")
    return flags.dispatch_bits(packed, DISPATCH_CASES).drop("flags")


@query
def flags_stages(spark, sf_dir):
    return flags.stage_completion(tables.event_stages(spark, sf_dir), ["user_id", "day"], "stage")


@query
def flags_stage_share(spark, sf_dir):
    completed = flags.stage_completion(tables.event_stages(spark, sf_dir), ["user_id", "day"], "stage")
    return flags.completion_share(completed, ["day"])


# --- dispatch tables ------------------------------------------------------------------


@query
def rules_compile(spark, sf_dir):
    return dispatch.compile_rules(tables.part_rules(spark, sf_dir))


@query
def rules_residual(spark, sf_dir):
    left = dispatch.residual_rules(tables.part_rules(spark, sf_dir))
    return left.select("chain_id", "position", "var", "op", "value", "action")


@query
def rules_apply(spark, sf_dir):
    compiled = dispatch.compile_rules(tables.priority_rules(spark, sf_dir))
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return dispatch.apply_rules(orders, "o_orderpriority", compiled, default="none", chain="o_orderstatus")


# --- masking and text -----------------------------------------------------------------


@query
def mask_literals(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return masking.mask_literals(masking.mask_literals(part, "p_name"), "p_type", "PartType")


@query
def mask_roundtrip(spark, sf_dir):
    """Masks and unmasks conversation texts, accents included."""
    texts = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    masked = masking.mask_literals(texts, "text", out="masked")
    back = masking.unmask_literals(masked, "masked", out="unmasked")
    return back.select("conv_id", "turn", F.md5("masked").alias("masked_md5"), F.md5("unmasked").alias("unmasked_md5"))


@query
def literal_report(spark, sf_dir):
    return masking.literal_report(
        tables.document_tokens(spark, sf_dir),
        is_import="lang = 'es' and left(literal, 1) between 'A' and 'Z'",
        is_tag="startswith(literal, 'http') or startswith(literal, 'www')",
        is_constant="literal rlike '^[A-Z0-9_$]+$'",
    )


def _pseudonyms(level: int) -> Query:
    def run(spark, sf_dir):
        customers = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
        return masking.pseudonymise(customers, ["c_name", "c_mktsegment"], level, "k1")

    return run


_QUERIES["pseudonymise"] = _pseudonyms(1)
_QUERIES["pseudonymise_medium"] = _pseudonyms(2)
_QUERIES["pseudonymise_high"] = _pseudonyms(3)


def _masked_documents(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return masking.mask_by_policy(documents, tables.document_marks(spark, sf_dir), "doc_id", "text")


@query
def control_marks(spark, sf_dir):
    """Marks parsed out of conversation texts in both spellings, the last one of a conversation deciding."""
    turns = tables.marked_turns(spark, sf_dir)
    marks = turns.select("conv_id", F.col("turn").alias("seq"), masking.control_mark(F.col("text"), "flagframe").alias("mark"))
    masked = masking.mask_by_policy(turns, marks.where(F.col("mark").isNotNull()), "conv_id", "text")
    return masked.select("conv_id", "turn", "policy", F.md5("text").alias("text_md5"))


@query
def mask_policy(spark, sf_dir):
    masked = _masked_documents(spark, sf_dir)
    return masked.select("doc_id", "policy", F.md5("text").alias("text_md5"))


@query
def policy_counts(spark, sf_dir):
    return masking.policy_counts(_masked_documents(spark, sf_dir), ["source"])


@query
def tag_keywords(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return textscan.tag_keywords(documents, "text", KEYWORDS).drop("text")


@query
def keyword_counts(spark, sf_dir):
    return textscan.keyword_counts(tables.table(spark, sf_dir, "documents"), "text", KEYWORDS)


@query
def keyword_table(spark, sf_dir):
    """Thousands of keywords counted in one scan of the texts."""
    documents = tables.table(spark, sf_dir, "documents")
    matches = textscan.keyword_matches(documents, ["doc_id"], "text", tables.keyword_table(spark, sf_dir))
    return textscan.keyword_table_counts(matches).drop("occurrences")


@query
def keyword_table_first(spark, sf_dir):
    keywords = staged(tables.keyword_table(spark, sf_dir), "ranked-keywords")
    matches = textscan.keyword_matches(tables.table(spark, sf_dir, "documents"), ["doc_id"], "text", keywords, name="rank")
    return textscan.first_of_table(matches, ["doc_id"], keywords)


@query
def token_profile(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return textscan.token_profile(documents, ["doc_id"], "text", tables.TOKEN_SEPARATOR)


@query
def rebase_paths(spark, sf_dir):
    paths = tables.page_paths(spark, sf_dir).select("page_id", "path")
    return textscan.rebase_paths(paths, "path", "site", ["fr", "de"])


@query
def first_line(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return textscan.first_line_with_prefix(documents, "text", "De ").drop("text")


@query
def count_lines(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return textscan.count_lines_matching(documents, "text", NEEDLES).drop("text")


# --- corpus structure -----------------------------------------------------------------


def _checked_events(spark, sf_dir):
    events = tables.broken_props(tables.table(spark, sf_dir, "events"))
    return files.check_rows(events, "props", "k bigint", ["event_id", "package"])


@query
def check_rows(spark, sf_dir):
    return _checked_events(spark, sf_dir)


@query
def check_summary(spark, sf_dir):
    return files.check_summary(_checked_events(spark, sf_dir))


@query
def candidates(spark, sf_dir):
    return corpus.flag_candidates(tables.struct_fields(spark, sf_dir))


@query
def complexity(spark, sf_dir):
    return corpus.weighted_complexity(tables.code_nodes(spark, sf_dir), ["user_id", "day"])


@query
def owner_complexity(spark, sf_dir):
    """Nodes are placed in the interval that holds them, then scored per owner."""
    owners, nodes = tables.owners_and_nodes(spark, sf_dir)
    kind = F.when(F.col("kind") == "error", "for").when(F.col("kind") == "view", "call").otherwise("if")
    placed = corpus.assign_owners(nodes, owners).where(F.col("owner").isNotNull())
    keyed = placed.select("file", F.col("owner").alias("name"), kind.alias("kind"))
    return corpus.weighted_complexity(keyed, ["file", "name"], owners)


@query
def owner_complexity_nested(spark, sf_dir):
    """Intervals that nest and overlap; a node counts for each one that holds it."""
    owners, nodes = tables.nested_owners_and_nodes(spark, sf_dir)
    return corpus.nested_complexity(nodes, owners)


@query
def chain_lengths(spark, sf_dir):
    return corpus.chain_lengths(tables.turn_links(spark, sf_dir))


@query
def chain_status(spark, sf_dir):
    """Chains of which some lead into a cycle."""
    return corpus.chain_status(tables.looped_turn_links(spark, sf_dir))


@query
def branch_counts(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders")
    return corpus.branch_counts(orders, tables.table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query
def score_contexts(spark, sf_dir):
    return tables.code_contexts(spark, sf_dir)


@query
def select_contexts(spark, sf_dir):
    chosen = corpus.select_contexts(tables.code_contexts(spark, sf_dir), eligible=True, simple=True)
    return chosen.select("file", "type", "name", "complexity")


@query
def select_contexts_by_type(spark, sf_dir):
    chosen = corpus.select_contexts(tables.code_contexts(spark, sf_dir), types=["function", "if_chain"], simple=False)
    return chosen.select("file", "type", "name", "complexity", "eligible")


@query
def dependencies(spark, sf_dir):
    return corpus.link_dependencies(tables.region_contexts(spark, sf_dir))


@query
def dependency_members(spark, sf_dir):
    return corpus.dependency_members(tables.region_contexts(spark, sf_dir))


@query
def expand_states(spark, sf_dir):
    counts = corpus.branch_counts(
        tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )
    contexts = counts.select("o_orderkey", F.lit("switch").alias("type"), F.col("branches").alias("complexity"))
    return corpus.expand_states(contexts, ["o_orderkey"])


@query
def expand_mixed_states(spark, sf_dir):
    """All context types; functions have states only when eligible."""
    return corpus.expand_states(tables.code_contexts(spark, sf_dir), ["file", "name"])


# --- reports --------------------------------------------------------------------------


@query
def findings(spark, sf_dir):
    return reports.findings(corpus.flag_candidates(tables.struct_fields(spark, sf_dir)))


@query
def report_text(spark, sf_dir):
    """The report over ``findings`` as text blocks, numbered within their file."""
    return outputs.report_lines(findings(spark, sf_dir))


@query
def report_document(spark, sf_dir):
    """The lines of the report over ``findings`` as one JSON document."""
    found = findings(spark, sf_dir)
    return outputs.document_lines(found, reports.summarise(found))


@query
def summary(spark, sf_dir):
    return reports.summarise(findings(spark, sf_dir))


@query
def project_stats(spark, sf_dir):
    return reports.project_stats(
        tables.document_files(spark, sf_dir),
        tables.document_contexts(spark, sf_dir),
        tables.document_outcome(spark, sf_dir),
    )


@query
def project_issues(spark, sf_dir):
    return reports.project_issues(tables.document_outcome(spark, sf_dir))


@query
def size_estimate(spark, sf_dir):
    fields = tables.struct_fields(spark, sf_dir)
    counts = fields.groupBy("struct_name").agg(F.count(F.lit(1)).alias("rows"))
    return reports.size_estimate(flags.flag_dictionary(fields), counts)


@query
def overlay(spark, sf_dir):
    original = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    generated = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    merged = reports.overlay(original, generated, "doc_id", "text")
    return merged.select("doc_id", F.md5("text").alias("text_md5"), "origin")


@query
def route_rows(spark, sf_dir):
    pages = tables.page_paths(spark, sf_dir).select(F.col("page_id").alias("file"), "path")
    in_english = F.split_part("path", F.lit("/"), F.lit(1)) == "en"
    return reports.route_files(pages, tables.page_contexts(spark, sf_dir), preserve=in_english)


@query
def preserved_annotations(spark, sf_dir):
    """Days that end in 1 are preserved files."""
    contexts = tables.code_contexts(spark, sf_dir)
    days = contexts.select("file").distinct()
    routed = reports.route_files(days, contexts, preserve=F.endswith(F.col("file"), F.lit("1")))
    return reports.preserved_annotations(routed, contexts)


ORDER_COLUMNS = ("o_orderstatus", "o_totalprice", "o_orderpriority")


def _baseline_orders(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", *ORDER_COLUMNS)


def _compared(spark, sf_dir):
    return reports.compare_datasets(_baseline_orders(spark, sf_dir), tables.candidate_orders(spark, sf_dir), ["o_orderkey"])


def _compared_columns(spark, sf_dir):
    """Without the last digits of keys, so that a key has many rows on both sides."""
    key = (F.col("o_orderkey") / 8).cast("bigint").alias("key")
    sides = [df.select(key, *ORDER_COLUMNS) for df in (_baseline_orders(spark, sf_dir), tables.candidate_orders(spark, sf_dir))]
    return reports.compare_columns(*sides, ["key"])


@query
def compare_columns(spark, sf_dir):
    return _compared_columns(spark, sf_dir)


@query
def changed_columns(spark, sf_dir):
    return reports.changed_columns(_compared_columns(spark, sf_dir), ["key"], ORDER_COLUMNS)


@query
def column_summary(spark, sf_dir):
    return reports.column_summary(_compared_columns(spark, sf_dir))


@query
def compare_outcome(spark, sf_dir):
    """Which keys passed and which failed."""
    return reports.passed_and_failed(_compared(spark, sf_dir)).select("o_orderkey", "outcome")


@query
def compare(spark, sf_dir):
    return _compared(spark, sf_dir).select("o_orderkey", "status")


@query
def compare_summary(spark, sf_dir):
    return reports.comparison_summary(_compared(spark, sf_dir))


def _manifest(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return reports.checksum_manifest(documents)


@query
def checksums(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query
def duplicate_contents(spark, sf_dir):
    return reports.duplicate_contents(_manifest(spark, sf_dir))


@query
def size_report(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents")
    sized = documents.select("source", "lang", F.octet_length("text").alias("length"))
    return reports.size_report(sized, ["source", "lang"])


@query
def versions(spark, sf_dir):
    return reports.latest_versions(tables.part_versions(spark, sf_dir), "p_brand", "version")


@query
def registry_rows(spark, sf_dir):
    decoded = registry.decode_registry(tables.registry_entries(spark, sf_dir), "body", ["event_id"])
    return decoded.select(
        "event_id", "ipc_socket", "ns_bits", "cap_mask", "state", "declared", "seq", F.unix_micros("epoch").alias("epoch_us")
    )


@query
def registry_values(spark, sf_dir):
    return registry.registry_values(tables.registry_entries(spark, sf_dir), "body", ["event_id"])


# --- state ----------------------------------------------------------------------------


@query
def job_state(spark, sf_dir):
    states = state.job_state(tables.job_events(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"])
    return flags.decode_flags(states, state.JOB_FLAGS, "mask", "state")


@query
def job_rejections(spark, sf_dir):
    refused = state.job_rejections(tables.job_events(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"])
    return refused.select("user_id", "day", "event_id", "op")


@query
def job_restartable(spark, sf_dir):
    states = state.job_state_restartable(tables.job_events(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"])
    return flags.decode_flags(states, state.RESTARTABLE_FLAGS, "mask", "state", by_name=True, unknown="none")


def _stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream."""
    schema = tables.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run_stream(stream: DataFrame, name: str, mode: str) -> str:
    """Run a stream over what is there; returns where its batches were written."""
    out = scratch_path(stream.sparkSession, name)
    start_batches(stream, f"{out}/rows", f"{out}/checkpoint", mode, once=True).awaitTermination()
    return f"{out}/rows"


@query
def stream_job_state(spark, sf_dir):
    """The streaming form of ``job_state``, run to the end of the table."""
    events = tables.as_job_events(
        _stream_events(spark, sf_dir).withColumn("day", tables.event_day()), tables.JOB_OPS, "event_type"
    )
    states = stream_state.stream_job_state(events, ["user_id", "day"], ["ts", "event_id"])
    return latest_rows(spark, _run_stream(states, "job-state", "update"), ["user_id", "day"])


@query
def stream_job_rejections(spark, sf_dir):
    events = tables.as_job_events(
        _stream_events(spark, sf_dir).withColumn("day", tables.event_day()), tables.JOB_OPS, "event_type"
    )
    out = scratch_path(spark, "job-rejections")
    stream_state.start_job_rejections(
        events, ["user_id", "day"], ["ts", "event_id"], out, f"{out}/checkpoint", once=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "day", "event_id", "op")


def _arrivals(events: DataFrame, batches: list[DataFrame]) -> tuple[DataFrame, str]:
    """A file stream that takes ``batches`` one at a time, in this order, and a scratch path for its results."""
    out = scratch_path(events.sparkSession, "arrivals")
    for batch in batches:
        batch.repartition(1).write.mode("append").parquet(f"{out}/in")
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in"), out


def _timed_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.job_events(spark, sf_dir).select("user_id", "day", F.col("ts").cast("timestamp").alias("ts"), "event_id", "op")


@query
def stream_rejections_keyed(spark, sf_dir):
    """Events arrive by time in four micro-batches and are judged at once; each key's history is in the state store."""
    events = _timed_job_events(spark, sf_dir)
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    quarter = F.floor((F.unix_seconds("ts") - first) * 4 / (last - first + 1))
    stream, out = _arrivals(events, [events.where(quarter == i) for i in range(4)])
    keyed.start_keyed_rejections(stream, ["user_id", "day"], "ts", f"{out}/rows", f"{out}/checkpoint", ["event_id"], once=True).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "day", "event_id", "op")


@query
def stream_rejections_ordered(spark, sf_dir):
    """Events arrive out of order in three micro-batches and are judged as the watermark, moved by a last event, passes them."""
    events = _timed_job_events(spark, sf_dir)
    deal = F.pmod(F.xxhash64("event_id"), F.lit(3))
    closing = spark.createDataFrame([(-1, "2200-01-01", -1, "cancel")], "user_id long, day string, event_id long, op string")
    closing = closing.select("user_id", "day", F.col("day").cast("timestamp").alias("ts"), "event_id", "op")
    stream, out = _arrivals(events, [*[events.where(deal == i) for i in range(3)], closing])
    keyed.start_keyed_rejections(
        stream, ["user_id", "day"], "ts", f"{out}/rows", f"{out}/checkpoint", ["event_id"], watermark="1000 days", once=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "day", "event_id", "op")


@query
def stream_checks(spark, sf_dir):
    """Rows of the event stream that fail their check, appended to an alert table."""
    props = tables.broken_props(_stream_events(spark, sf_dir))
    failures = files.check_rows(props, "props", "k bigint", ["event_id", "package"]).where("status <> 'ok'")
    alerts = _run_stream(failures, "alerts", "append")
    return spark.read.schema(failures.schema).parquet(f"{alerts}/*")


@query
def stream_registers(spark, sf_dir):
    """The streaming form of ``registers_tumbling``."""
    events = tables.pack_value_flags(_stream_events(spark, sf_dir))
    registers = stream_union_flags(events, ["event_type"], "flags", "ts", "1 hour", "1 hour")
    path = _run_stream(registers, "registers", "update")
    return _window_text(latest_rows(spark, path, ["window_start", "window_end", "event_type"]))


def _window_text(df: DataFrame) -> DataFrame:
    for c in ("window_start", "window_end"):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query
def registers_tumbling(spark, sf_dir):
    """The streaming register over the static table: one hour, per event type."""
    events = tables.value_flags(spark, sf_dir)
    return _window_text(stream_union_flags(events, ["event_type"], "flags", "ts", "1 hour", "1 hour"))


@query
def registers_sliding(spark, sf_dir):
    events = tables.value_flags(spark, sf_dir)
    return _window_text(stream_union_flags(events, ["event_type"], "flags", "ts", "1 hour", "1 hour", "30 minutes"))


@query
def registers_session(spark, sf_dir):
    events = tables.value_flags(spark, sf_dir)
    sessions = stream_union_flags(events, ["user_id"], "flags", "ts", "1 hour", "2 hours", session=True)
    return _window_text(sessions).drop("window_end")


@query
def registers_session_stitched(spark, sf_dir):
    """Sessions folded per bucket of time and stitched, so that no user is one task's work."""
    found = sessions.session_flags(tables.value_flags(spark, sf_dir), ["user_id"], "flags", "ts", "2 hours")
    return _window_text(found).drop("window_end")


@query
def stream_sessions(spark, sf_dir):
    """The buckets kept by a stream, stitched from what it wrote."""
    events = tables.pack_value_flags(_stream_events(spark, sf_dir))
    buckets = sessions.session_buckets(events, ["user_id"], "flags", "ts", "2 hours", watermark="1 hour")
    rows = latest_rows(spark, _run_stream(buckets, "sessions", "update"), ["user_id", "bucket"])
    return _window_text(sessions.stitch_sessions(rows, ["user_id"], "2 hours")).drop("window_end")


def _late_stream(spark: SparkSession, sf_dir: str) -> str:
    """Events arrive by time in four micro-batches, but every seventh in the last; returns where the registers are."""
    events = tables.value_flags(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "flags")
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    quarter = F.floor((F.unix_seconds("ts") - first) * 4 / (last - first + 1))
    arrival = F.when(F.col("event_id") % 7 == 0, 3).otherwise(quarter)
    stream, out = _arrivals(events, [events.where(arrival == i) for i in range(4)])
    sessions.start_kept_registers(stream, ["event_type"], "flags", "ts", "1 hour", "1 hour", f"{out}/kept", f"{out}/checkpoint", once=True).awaitTermination()
    return f"{out}/kept"


@query
def late_rows(spark, sf_dir):
    """The rows of a stream that came behind the watermark."""
    return sessions.late_rows(spark, _late_stream(spark, sf_dir)).select("event_id", "event_type", F.col("batch_id").cast("int").alias("batch_id"))


@query
def kept_registers(spark, sf_dir):
    """The registers of the rows that came in time."""
    return _window_text(sessions.kept_registers(spark, _late_stream(spark, sf_dir), ["event_type"]))


# --- passes ---------------------------------------------------------------------------


@query
def passes_run(spark, sf_dir):
    """Pack, filter, update, read back, mask and look up over lineitem, by pass names."""
    columns = ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity")
    lines = tables.table(spark, sf_dir, "lineitem").select(*columns)
    updates = tables.order_updates(spark, sf_dir).select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("set_mask"), F.lit(1).alias("clear_mask")
    )
    registry_ = standard_passes(
        tables.LINE_FLAGS,
        condition={"any_of": ["returned", "bulk"]},
        updates=(updates, "l_orderkey"),
        fields=["returned", "taxed"],
        text=["l_linestatus"],
        rules=("l_returnflag", PASS_RULES),
    )
    names = "bool2flags, if-to-bitwise,assign2bitwise, field2bitwise,stringobf,jumptable"
    out = run_passes(lines, names, registry_).df
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "flags", "returned", "taxed", "l_linestatus", "action")
