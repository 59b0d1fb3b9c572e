"""Corpus structure: candidates, complexity, chains, contexts and their relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.functions import text as T
from flagframe.operators.ordered import carry_last, carry_sum
from flagframe.session import discard, staged

# Complexity per node kind and of a bare function.
NODE_WEIGHTS = {
    "if": 2,
    "for": 3,
    "range": 3,
    "switch": 2,
    "type_switch": 2,
    "call": 1,
}
BASE_COMPLEXITY = 1
AUTH_COMPLEXITY = 8

# The three states of functions and of access checks, with the
# condition that turns each on and the action it runs.
FUNCTION_STATES = (
    ("function_entry", "function_called", "initialize_context"),
    ("function_processing", "parameters_validated", "execute_logic"),
    ("function_exit", "logic_completed", "return_result"),
)
AUTH_STATES = (
    ("auth_check_init", "user_input_received", "validate_input_format"),
    ("auth_processing", "input_valid", "perform_obfuscated_check"),
    ("auth_result", "check_completed", "return_auth_status"),
)

# Name parts that mark simple structs and functions.
SIMPLE_STRUCT_NAMES = ("flag", "state", "config")
SIMPLE_FUNCTION_NAMES = ("util", "helper", "check", "validate")

# States of one context are made in blocks of 2^16.
BLOCK_BITS = 16


def flag_candidates(fields: DataFrame, min_flags: int = 1) -> DataFrame:
    """Structs with boolean fields: how many, and the struct's line.

    The fields themselves, numbered, are the rows of ``flags.flag_dictionary``: a
    list per struct would grow with the struct.
    """
    return (
        fields.where(F.col("type") == "bool")
        .groupBy("file", "struct_name")
        .agg(F.count(F.lit(1)).alias("bool_fields"), F.min("line").alias("line"))
        .where(F.col("bool_fields") >= min_flags)
    )


def node_weight(kind: Column, weights: Mapping[str, int] = NODE_WEIGHTS) -> Column:
    weight = F.lit(0)
    for name, value in weights.items():
        weight = F.when(kind == name, F.lit(value)).otherwise(weight)
    return weight


def weighted_complexity(
    nodes: DataFrame,
    owner: Sequence[str],
    owners: DataFrame | None = None,
    weights: Mapping[str, int] = NODE_WEIGHTS,
    base: int = BASE_COMPLEXITY,
    kind: str = "kind",
) -> DataFrame:
    """``base`` plus the weights of an owner's nodes.

    Owners without nodes appear when the table of ``owners`` is given.
    """
    keys = list(owner)
    sums = nodes.groupBy(*keys).agg(F.sum(node_weight(F.col(kind), weights)).alias("_sum"))
    if owners is not None:
        sums = owners.select(*keys).join(sums, keys, "left")
    return sums.select(*keys, (F.coalesce(F.col("_sum"), F.lit(0)) + base).cast("bigint").alias("complexity"))


def assign_owners(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Give each node ``(file, line)`` the owner whose line interval holds it.

    ``owners(file, name, start_line, end_line)`` do not overlap within a file, so the
    only candidate is the last one that starts at or before the node. Both tables
    are merged in line order and the owner is carried forward; no pairs are formed.
    """
    marker = F.struct("name", "start_line", "end_line")
    starts = owners.select("file", F.col("start_line").alias("line"), F.lit(0).alias("_rank"), marker.alias("_owner"))
    merged = starts.unionByName(nodes.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    carried = carry_last(merged, ["file"], ["line", "_rank"], {"_in": F.col("_owner")})
    inside = F.col("line") <= F.col("_in.end_line")
    return (
        carried.where(F.col("_rank") == 1)
        .withColumn("owner", F.when(inside, F.col("_in.name")))
        .withColumn("owner_line", F.when(inside, F.col("_in.start_line")))
        .select(*nodes.columns, "owner", "owner_line")
    )


def nested_complexity(
    nodes: DataFrame, owners: DataFrame, weights: Mapping[str, int] = NODE_WEIGHTS, base: int = BASE_COMPLEXITY
) -> DataFrame:
    """``base`` plus the weights of all nodes within an owner's lines, those of owners inside it included.

    ``nodes(file, line, kind)`` count for every one of the ``owners(file, name, start_line,
    end_line)`` that holds them, however these nest or overlap. Nodes and the two ends of each owner are merged in line
    order and weights are summed along it: an owner's share is the sum at its end less the sum
    before its start. No pairs are formed, and a hot file is summed in many chunks. An owner given
    more than once is one row; owners without lines, or that end before they start, hold nothing.
    """
    ends = F.array(F.struct(F.col("start_line").alias("line"), F.lit(0).alias("_rank")), F.struct(F.col("end_line").alias("line"), F.lit(2).alias("_rank")))
    bounds = owners.select("file", "name", "start_line", "end_line", F.explode(ends).alias("_at"))
    bounds = bounds.select("file", "_at.line", "_at._rank", "name", "start_line", "end_line")
    weighed = nodes.select("file", "line", F.lit(1).alias("_rank"), node_weight(F.col("kind"), weights).alias("_weight"))
    merged = bounds.unionByName(weighed, allowMissingColumns=True)
    summed = carry_sum(merged, ["file"], ["line", "_rank"], {"_sum": F.col("_weight")}).where(F.col("_rank") != 1)
    inside = F.max(F.when(F.col("_rank") == 2, F.col("_sum"))) - F.max(F.when(F.col("_rank") == 0, F.col("_sum")))
    per_owner = summed.groupBy("file", "name", "start_line", "end_line").agg(inside.alias("_inside"))
    held = F.when(F.col("end_line") >= F.col("start_line"), F.col("_inside")).otherwise(F.lit(0))
    return per_owner.select("file", "name", "start_line", "end_line", (held + base).cast("bigint").alias("complexity"))


def chain_status(links: DataFrame, id_col: str = "id", else_col: str = "else_id") -> DataFrame:
    """Per node: ``id``, ``length`` to the end of its else chain (a plain final else counts 1) and ``status``.

    Pointer doubling: every round joins the open chains with the table of pointers
    and doubles their reach, so a chain of n links takes about log2(n) rounds. A round writes the
    chains that were open; those that end in it are kept, the open ones of the round
    before are removed. After more than log2 of all nodes rounds every chain that ends has ended: what is
    still open lies on a cycle or leads to one. Such nodes have status ``cyclic`` and no length, others ``ended``.
    """
    start = links.select(F.col(id_col).alias("id"), F.col(else_col).alias("_next"), F.lit(1).cast("bigint").alias("length"))
    current = staged(start, "chains")
    ended, still_open = F.col("_next").isNull(), F.col("_next").isNotNull()
    finished = staged(current.where(ended), "chains-ended")
    rounds_left = max(current.count(), 1).bit_length() + 1
    while rounds_left and not current.where(still_open).isEmpty():
        rounds_left -= 1
        hop = finished.unionByName(current.where(still_open)).select(
            F.col("id").alias("_id"), F.col("_next").alias("_after"), F.col("length").alias("_more")
        )
        moved = staged(
            current.where(still_open).join(hop, F.col("_next") == F.col("_id"), "left").select(
                "id", F.col("_after").alias("_next"), (F.col("length") + F.coalesce("_more", F.lit(1))).alias("length")
            ),
            "chains",
        )
        finished = finished.unionByName(staged(moved.where(ended), "chains-ended"))
        discard(current)
        current = moved
    cyclic = current.where(still_open).select("id", F.lit(None).cast("bigint").alias("length"), F.lit("cyclic").alias("status"))
    return finished.select("id", "length", F.lit("ended").alias("status")).unionByName(cyclic)


def chain_lengths(links: DataFrame, id_col: str = "id", else_col: str = "else_id") -> DataFrame:
    """``chain_status`` where every chain must end: ``id`` and ``length``. A cyclic chain is an error."""
    found = chain_status(links, id_col, else_col)
    if not found.where("status = 'cyclic'").isEmpty():
        raise ValueError("the links contain a cycle")
    return found.where("status = 'ended'").select("id", "length")


def branch_counts(parents: DataFrame, children: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Branches per parent; parents without any count 0."""
    counts = children.groupBy(F.col(parent_col).alias("_parent")).agg(F.count(F.lit(1)).alias("_n"))
    joined = parents.select(id_col).join(counts, F.col(id_col) == F.col("_parent"), "left")
    return joined.select(id_col, F.coalesce("_n", F.lit(0)).cast("bigint").alias("branches"))


def score_contexts(contexts: DataFrame) -> DataFrame:
    """Decide which contexts are eligible and add the access-check rows.

    Functions up to complexity 3, chains from 3, structs and switches always, none
    above 10. A function whose name holds an access keyword gives a second row of
    type ``auth_logic``, always eligible with complexity 8.
    """
    is_auth = (F.col("type") == "function") & T.first_keyword(F.col("name"), T.AUTH_KEYWORDS).isNotNull()
    kinds = F.when(is_auth, F.array(F.lit("function"), F.lit("auth_logic"))).otherwise(F.array("type"))
    rows = contexts.withColumn("type", F.explode(kinds))
    complexity = F.when(F.col("type") == "auth_logic", F.lit(AUTH_COMPLEXITY)).otherwise(F.col("complexity"))
    rows = rows.withColumn("complexity", complexity.cast(contexts.schema["complexity"].dataType))
    eligible = (
        F.when(F.col("type") == "auth_logic", F.lit(True))
        .when(F.col("complexity") > 10, F.lit(False))
        .when(F.col("type") == "function", F.col("complexity") <= 3)
        .when(F.col("type") == "if_chain", F.col("complexity") >= 3)
        .otherwise(F.col("type").isin("struct", "switch"))
    )
    return rows.withColumn("eligible", eligible)


def is_simple(dependencies: Column | None = None) -> Column:
    """Contexts that are safe to convert on their own."""
    kind, size, name = F.col("type"), F.col("complexity"), F.lower(F.col("name"))
    deps = F.lit(0) if dependencies is None else dependencies
    return (
        F.when(kind == "struct", (size <= 3) & T.contains_any(name, SIMPLE_STRUCT_NAMES))
        .when(kind == "function", (size <= 2) & T.contains_any(name, SIMPLE_FUNCTION_NAMES))
        .when(kind == "auth_logic", F.lit(True))
        .when(kind == "if_chain", (size <= 4) & (deps <= 2))
        .when(kind == "switch", (size <= 3) & (deps <= 1))
        .otherwise(F.lit(False))
    )


def select_contexts(
    contexts: DataFrame,
    types: Sequence[str] | None = None,
    eligible: bool | None = None,
    simple: bool | None = None,
) -> DataFrame:
    """Filter scored contexts by type, eligibility and the stricter simple rule."""
    out = contexts
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    if eligible is not None:
        out = out.where(F.col("eligible") == eligible)
    if simple is not None:
        deps = F.col("dependencies") if "dependencies" in contexts.columns else None
        out = out.where(is_simple(deps) == simple)
    return out


def link_dependencies(contexts: DataFrame) -> DataFrame:
    """Number of structs each ``handler`` function depends on: all of its file.

    Every handler of a file has the same list, so the list is kept once per file
    (``dependency_members``) and rows carry its length; a handler's list is found
    under its ``file``.
    """
    structs = (
        contexts.where(F.col("type") == "struct")
        .groupBy(F.col("file").alias("_file"))
        .agg(F.count(F.lit(1)).alias("_structs"))
    )
    is_handler = (F.col("type") == "function") & F.contains(F.lower(F.col("name")), F.lit("handler"))
    joined = contexts.join(structs, (F.col("file") == F.col("_file")) & is_handler, "left")
    return joined.withColumn("dependencies", F.coalesce("_structs", F.lit(0)).cast("bigint")).drop(
        "_file", "_structs"
    )


def dependency_members(contexts: DataFrame) -> DataFrame:
    """The structs that the handlers of a file depend on, in source order by ``start_line``."""
    handler_files = (
        contexts.where((F.col("type") == "function") & F.contains(F.lower(F.col("name")), F.lit("handler")))
        .select("file")
        .distinct()
    )
    structs = contexts.where(F.col("type") == "struct")
    return structs.join(handler_files, "file", "left_semi").select("file", "name", "start_line")


def expand_states(contexts: DataFrame, id_cols: Sequence[str], fields: DataFrame | None = None) -> DataFrame:
    """One row per state of each context: ``bit``, ``state``, ``condition``, ``action``.

    Chains and switches have ``complexity`` states, functions (when eligible) and
    access checks have three fixed ones. States of structs are their boolean fields
    and come from ``fields``, a flag dictionary with the same ``id_cols``.
    """
    kind = F.col("type")
    fixed = {"function": FUNCTION_STATES, "auth_logic": AUTH_STATES}
    counted = {
        "if_chain": ("condition_", "evaluate_condition_", "execute_branch_"),
        "switch": ("case_", "match_case_", "execute_case_"),
    }
    has_fixed = kind.isin(*fixed)
    if "eligible" in contexts.columns:
        has_fixed = has_fixed & ((kind != "function") | F.col("eligible"))
    n = F.when(kind.isin(*counted), F.col("complexity")).when(has_fixed, F.lit(len(AUTH_STATES))).cast("int")
    # Blocks of states first, then the states of a block, so that no array grows with a context.
    # sequence(0, -1) would count down.
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.shiftright(n - 1, BLOCK_BITS)))
    blocked = contexts.select(*id_cols, "type", n.alias("_n"), F.explode(blocks).alias("_block"))
    first = F.shiftleft("_block", BLOCK_BITS)
    rows = blocked.select(*id_cols, "type", F.explode(F.sequence(first, F.least(first + (1 << BLOCK_BITS), F.col("_n")) - 1)).alias("bit"))

    def part(i: int) -> Column:
        """Name, condition or action of the state ``bit`` of its context type."""
        text = F.lit(None).cast("string")
        for name, prefixes in counted.items():
            text = F.when(kind == name, F.concat(F.lit(prefixes[i]), F.col("bit").cast("string"))).otherwise(text)
        for name, states in fixed.items():
            listed = F.array(*[F.lit(state[i]) for state in states])
            text = F.when(kind == name, F.get(listed, F.col("bit"))).otherwise(text)
        return text

    expanded = rows.select(
        *id_cols, "type", "bit", part(0).alias("state"), part(1).alias("condition"), part(2).alias("action")
    )
    if fields is None:
        return expanded
    own = fields.select(
        *id_cols,
        F.lit("struct").alias("type"),
        "bit",
        F.col("field").alias("state"),
        F.concat(F.lit("Set"), F.col("field"), F.lit("(true)")).alias("condition"),
        F.concat(F.lit("Execute_"), F.col("field"), F.lit("_Logic")).alias("action"),
    )
    structs = contexts.where(kind == "struct").select(*id_cols)
    return expanded.unionByName(own.join(structs, list(id_cols), "left_semi"))
