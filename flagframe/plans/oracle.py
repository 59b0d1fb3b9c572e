"""DuckDB twins of the registered queries, written from the operators' definitions."""

from __future__ import annotations

LINE_MASK = """(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END
  + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END
  + CASE WHEN l_discount > 0 THEN 4 ELSE 0 END
  + CASE WHEN l_tax > 0 THEN 8 ELSE 0 END
  + CASE WHEN l_quantity >= 30 THEN 16 ELSE 0 END)"""

LINES = f"li AS (SELECT *, CAST({LINE_MASK} AS SMALLINT) AS flags FROM lineitem)"

ORDERS = """ord AS (SELECT *, CAST(
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END
  + CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END
  + CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 0 END
  + CASE WHEN o_totalprice > 250000 THEN 8 ELSE 0 END
  + CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN 16 ELSE 0 END AS SMALLINT) AS flags FROM orders)"""

NAMES = ("returned", "open", "discounted", "taxed", "bulk")


def _decoded(mask: str, names: tuple[str, ...], first_bit: int = 0, unknown: bool = True) -> str:
    parts = ", ".join(
        f"CASE WHEN {mask} & {1 << (first_bit + i)} <> 0 THEN '{n}' END" for i, n in enumerate(names)
    )
    joined = f"concat_ws('|', {parts})"
    other = f"CASE WHEN {mask} = 0 THEN 'none' ELSE 'unknown(0x' || hex({mask}) || ')' END" if unknown else "'none'"
    return f"CASE WHEN {joined} = '' THEN {other} ELSE {joined} END"


def _decoded_sorted(mask: str, bits: dict[str, int]) -> str:
    parts = ", ".join(f"CASE WHEN {mask} & {b} <> 0 THEN '{n}' END" for n, b in bits.items())
    listed = f"list_sort(list_filter([{parts}], lambda x: x IS NOT NULL))"
    return f"CASE WHEN len({listed}) = 0 THEN 'none' ELSE array_to_string({listed}, '|') END"


EVENT_BIT = """CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 4
  WHEN 'purchase' THEN 8 WHEN 'error' THEN 16 ELSE 0 END"""

DAY = "strftime(ts, '%Y-%m-%d')"

FIELDS = """fields AS (SELECT h.role AS file, c.conv_id AS struct_name, c.turn AS pos, 'f' || c.turn AS field,
    CASE WHEN length(c.text) % 3 = 0 THEN 'bool' ELSE 'string' END AS type, CAST(c.turn + 1 AS INTEGER) AS line
  FROM conversations c JOIN conversations h ON h.conv_id = c.conv_id AND h.turn = 0)"""

DICTIONARY = f"""{FIELDS}, dict AS (SELECT file, struct_name, field, 'Flag' || struct_name || '_' || field AS flag_name,
    CAST(row_number() OVER w - 1 AS INTEGER) AS bit, count(*) OVER (PARTITION BY file, struct_name) AS n
  FROM fields WHERE type = 'bool' WINDOW w AS (PARTITION BY file, struct_name ORDER BY pos))"""

CANDIDATES = f"""{FIELDS}, cand AS (SELECT file, struct_name, count(*) AS bool_fields, min(line) AS line
  FROM fields WHERE type = 'bool' GROUP BY ALL)"""

FINDINGS = f"""{CANDIDATES}, found AS (SELECT file, 'BitfieldConversion' AS type,
    'Convert ' || bool_fields || ' bool fields to bitwise flags in struct ' || struct_name AS description,
    file || ':' || line AS location, CAST(bool_fields * 7 AS BIGINT) AS bytes_saved, CAST(2.5 AS DOUBLE) AS speedup,
    'Obfuscated struct ' || struct_name || ' with bitwise operations' AS security_description,
    'Medium' AS security_strength FROM cand)"""

RULES = """rules AS (SELECT p_brand AS chain_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position,
    CASE WHEN p_size = 50 THEN 'p_name' ELSE 'p_type' END AS var, CASE WHEN p_size = 49 THEN '!=' ELSE '==' END AS op,
    p_type AS value, p_name AS action FROM part),
  seen AS (SELECT *, first(var) OVER (PARTITION BY chain_id ORDER BY position) AS first_var FROM rules),
  good AS (SELECT *, min(CASE WHEN op = '==' AND var = first_var THEN 1 ELSE 0 END)
    OVER (PARTITION BY chain_id ORDER BY position) AS valid FROM seen),
  prefix AS (SELECT *, sum(valid) OVER (PARTITION BY chain_id) AS branches FROM good)"""

# Text to masked text, as a function of a column name and a type name.
_STOP = "('main', 'func', 'package', 'import', 'var', 'const', 'if', 'else', 'for', 'range')"


def _masked(col: str, kind: str = "string") -> str:
    pairs = f"regexp_extract_all(hex(encode({col})), '..')"
    numbers = f"list_transform({pairs}, lambda p: CAST(CAST('0x' || p AS INTEGER) AS VARCHAR))"
    masked = f"'{kind}([]byte{{' || array_to_string({numbers}, ', ') || '}})'"
    return f"CASE WHEN octet_length(encode({col})) < 4 OR {col} IN {_STOP} THEN {col} ELSE {masked} END"


def _pseudonyms(level: int) -> str:
    digest = "sha256('k1:' || name)"
    letters = f"regexp_replace(base64(unhex({digest})), '[^A-Za-z0-9]', '', 'g')"
    if level == 1:
        token = f"lower(substr(name, 1, 1)) || substr({letters}, 1, 4)"
    elif level == 2:
        token = f"substr({letters}, 1, 6) || '_' || substr({letters}, 7, 2)"
    else:
        pre = "['Jf', 'Kx', 'Zm', 'Qp', 'Wv', 'Bh', 'Ny', 'Lg']"
        suf = "['8sZ', '91x', '4mP', '7vQ', '2nR', '6kL', '9wE', '3tY']"
        a = f"CAST('0x' || substr({digest}, 1, 2) AS INTEGER) % 8 + 1"
        b = f"CAST('0x' || substr({digest}, 3, 2) AS INTEGER) % 8 + 1"
        token = f"{pre}[{a}] || substr({letters}, 1, 2) || '_' || {suf}[{b}]"
    whole = f"{token} || '_' || substr({digest}, 1, 32)"
    of = {c: whole.replace("name", c) for c in ("c_name", "c_mktsegment")}
    return f"SELECT c_custkey, {of['c_name']} AS c_name, {of['c_mktsegment']} AS c_mktsegment FROM customer"


WIDE = ", ".join(
    f"bool_or({'false' if i in (62, 63) else f'(l_partkey + l_linenumber + {i * i}) % 11 = 0'}) AS f{i}" for i in range(70)
)
# the update toggles flags 0 and 69
WIDE_NOW = [f"NOT f{i}" if i in (0, 69) else f"f{i}" for i in range(70)]
WIDE_NAMES = ", ".join(f"CASE WHEN {now} THEN 'f{i}' END" for i, now in enumerate(WIDE_NOW))
WIDE_ANY = " OR ".join(WIDE_NOW)

TOKEN_TESTS = {
    "all_caps": r"regexp_matches(t, '\p{L}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]')",
    "all_lower": r"regexp_matches(t, '\p{L}') AND NOT regexp_matches(t, '[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]')",
    "constant_like": "true",
    "identifier": r"regexp_matches(t, '^\p{L}')",
    "valid_ident": "regexp_matches(t, '^[A-Za-z0-9_$]+$')",
}
TOKEN_PROFILE = (
    r"WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{Nd}_$]+'), lambda t: t <> '') AS ts FROM documents) "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS class, CAST(len(list_filter(ts, lambda t: {test})) AS BIGINT) AS tokens FROM tok"
        for name, test in TOKEN_TESTS.items()
    )
)


MARKED = f"""policy AS (SELECT d.doc_id, d.source, d.text,
    CASE WHEN l.toxic = 1 THEN 'skipped' ELSE 'masked' END AS policy
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

NODE_SCORE = "CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"

CONTEXTS = f"""base AS (SELECT user_id, {DAY} AS file, CAST(1 + sum({NODE_SCORE}) AS BIGINT) AS complexity
    FROM events GROUP BY ALL),
  named AS (SELECT file, CASE user_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'if_chain' WHEN 2 THEN 'switch' ELSE 'struct' END AS type,
    CASE user_id % 5 WHEN 0 THEN 'config_' WHEN 1 THEN 'util_' WHEN 2 THEN 'Check_' WHEN 3 THEN 'handler_' ELSE 'x_' END
      || user_id AS name, complexity, CAST(user_id AS INTEGER) AS start_line, CAST(user_id + 1 AS INTEGER) AS end_line FROM base),
  ctx AS (
    SELECT *, CASE WHEN complexity > 10 THEN false WHEN type = 'function' THEN complexity <= 3
      WHEN type = 'if_chain' THEN complexity >= 3 ELSE true END AS eligible FROM named
    UNION ALL
    SELECT file, 'auth_logic', name, 8, start_line, end_line, true FROM named
    WHERE type = 'function' AND regexp_matches(lower(name), 'auth|login|check|verify|validate|permission'))"""

SIMPLE = """CASE type WHEN 'struct' THEN complexity <= 3 AND regexp_matches(lower(name), 'flag|state|config')
  WHEN 'function' THEN complexity <= 2 AND regexp_matches(lower(name), 'util|helper|check|validate')
  WHEN 'auth_logic' THEN true WHEN 'if_chain' THEN complexity <= 4 WHEN 'switch' THEN complexity <= 3 ELSE false END"""

REGION_CONTEXTS = """ctx AS (
    SELECT n_regionkey AS file, 'function' AS type,
      CASE WHEN n_name LIKE '%1' THEN 'Handler_' ELSE 'fn_' END || n_name AS name, CAST(n_nationkey AS BIGINT) AS start_line
    FROM nation
    UNION ALL
    SELECT n_regionkey, 'struct', s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

ORDER_LINES = """counts AS (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS branches
  FROM orders)"""

PAGE_LINKS = """links AS (SELECT page_id AS file,
    greatest(0, (length(html) - length(replace(html, '<a ', ''))) // 3 - 5) AS contexts FROM pages)"""

PAGE_PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)"

COMPARED = """base AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
  cand AS (
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000
      THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority
    FROM base WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')
    UNION ALL
    SELECT -1 - o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM base
    WHERE o_orderpriority = '2-HIGH' AND o_totalprice < 20000),
  cmp AS (SELECT coalesce(b.o_orderkey, c.o_orderkey) AS o_orderkey,
    CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN b.o_orderkey IS NULL THEN 'extra'
      WHEN b.o_orderstatus IS NOT DISTINCT FROM c.o_orderstatus AND b.o_totalprice IS NOT DISTINCT FROM c.o_totalprice
        AND b.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority THEN 'matched' ELSE 'changed' END AS status
    FROM base b FULL OUTER JOIN cand c ON b.o_orderkey = c.o_orderkey)"""

COLUMN_COMPARED = COMPARED + """,
  sides AS (
    SELECT trunc(o_orderkey / 8)::BIGINT AS key, o_orderstatus, o_totalprice, o_orderpriority, 'b' AS side FROM base UNION ALL
    SELECT trunc(o_orderkey / 8)::BIGINT, o_orderstatus, o_totalprice, o_orderpriority, 'c' FROM cand),
  counted AS (SELECT key, o_orderstatus, o_totalprice, o_orderpriority, count(*) FILTER (side = 'b') AS nb, count(*) FILTER (side = 'c') AS nc
    FROM sides GROUP BY ALL),
  rest AS (SELECT *, greatest(nb - nc, 0) AS rb, greatest(nc - nb, 0) AS rc FROM counted WHERE nb <> nc),
  cells AS (
    SELECT key, rb, rc, unnest(['o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS "column",
      unnest([o_orderstatus, o_totalprice::VARCHAR, o_orderpriority]) AS value FROM rest),
  vals AS (SELECT key, "column", value, sum(rb) AS rb, sum(rc) AS rc FROM cells GROUP BY ALL),
  differs AS (SELECT key, "column", CAST(least(sum(rb), sum(rc)) - least(sum(least(rb, rc)), least(sum(rb), sum(rc))) AS BIGINT) AS differing
    FROM vals GROUP BY ALL HAVING differing > 0)"""

VERSIONS = r"""vers AS (SELECT p_partkey, p_brand, CASE WHEN p_size = 50 THEN '1.x' WHEN p_size = 49 THEN '1.2'
    WHEN p_size >= 40 THEN 'v1.' || p_size || '.0' WHEN p_size >= 30 THEN '1.' || p_size || '.2-rc1'
    ELSE '0.' || p_size || '.' || p_size END AS version FROM part),
  parsed AS (SELECT *, list_transform(string_split(regexp_replace(string_split(version, '-')[1], '^v', ''), '.'),
    lambda p: TRY_CAST(p AS BIGINT)) AS raw FROM vers),
  nums AS (SELECT *, CASE WHEN list_contains(list_transform(raw, lambda p: p IS NULL), true) THEN NULL ELSE raw END AS parts
    FROM parsed),
  ranked AS (SELECT *, max(parts) OVER (PARTITION BY p_brand) AS best FROM nums)"""

JOB_EVENTS = f"""ev AS (SELECT user_id, {DAY} AS day, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'retry' WHEN 'view' THEN 'cancel'
      WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS op FROM events)"""

# The machines as plain sequential folds over the ordered operations.
GUARDED_FOLD = """list_reduce(list_transform(ops, lambda o: CASE o WHEN 'start' THEN 1001 WHEN 'cancel' THEN 1002
    WHEN 'retry' THEN 1003 WHEN 'complete' THEN 1004 ELSE 1005 END),
  lambda m, o: CASE
    WHEN o = 1002 THEN m | 4
    WHEN m & 112 <> 0 THEN m
    WHEN o = 1001 THEN m | 2
    WHEN o = 1003 THEN (m | 8) & ~2
    WHEN o = 1004 THEN (m | 16) & ~14
    ELSE (m | 32) & ~10 END, 0)"""

RESTARTABLE_FOLD = """list_reduce(list_transform(ops, lambda o: CASE o WHEN 'start' THEN 1001 WHEN 'retry' THEN 1003
    WHEN 'complete' THEN 1004 ELSE 1005 END),
  lambda m, o: CASE
    WHEN o = 1001 THEN (m & ~56) | 2
    WHEN o = 1003 THEN CASE WHEN m & 2 <> 0 THEN m | 4 ELSE m END
    WHEN o = 1004 THEN 8
    ELSE 16 END, 0)"""

JOB_BITS = ("pending", "running", "cancel_requested", "retrying", "completed", "failed", "timed_out")
RESTARTABLE_BITS = {"running": 2, "retrying": 4, "completed": 8, "failed": 16, "timeout": 32}

VALUE_FLAGS = """vf AS (SELECT *, CAST(CASE WHEN value < 10 THEN 1 ELSE 0 END
    + CASE WHEN value >= 10 AND value < 60 THEN 2 ELSE 0 END + CASE WHEN value >= 60 THEN 4 ELSE 0 END AS SMALLINT) AS flags
  FROM events)"""


def _text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


LATE = f"""{VALUE_FLAGS},
  ends AS (SELECT floor(epoch(min(ts))) AS first, floor(epoch(max(ts))) AS last FROM vf),
  arrived AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 3 ELSE floor((floor(epoch(ts)) - first) * 4 / (last - first + 1)) END AS arrival FROM vf, ends),
  marks AS (SELECT b, (SELECT max(ts) - INTERVAL 1 HOUR FROM arrived WHERE arrival < b) AS mark FROM range(4) t(b)),
  judged AS (SELECT a.*, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark, false) AS late FROM arrived a JOIN marks ON b = arrival)"""

KEYWORD_MATCHES = """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS keyword FROM conversations),
        k AS (SELECT keyword, length(keyword) * 1000000000000 + row_number() OVER (PARTITION BY length(keyword) ORDER BY keyword) AS rank
          FROM w WHERE length(keyword) >= 8),
        m AS (SELECT doc_id, lower(text) AS t, keyword, rank FROM documents JOIN k ON contains(lower(text), keyword))"""

ORACLE: dict[str, str] = {
    "order_flags": f"""WITH {LINES}, reg AS (SELECT l_orderkey, bit_or(flags) AS flags FROM li GROUP BY 1)
        SELECT l_orderkey, flags, {_decoded('flags', NAMES)} AS flag_names,
          CAST(bit_count(flags) AS INTEGER) AS n_flags FROM reg""",
    "flags_pack": f"WITH {LINES} SELECT l_orderkey, l_partkey, l_linenumber, flags FROM li",
    "flags_unpack": """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag = 'R' AS returned, l_linestatus = 'O' AS open,
        l_discount > 0 AS discounted, l_tax > 0 AS taxed, l_quantity >= 30 AS bulk FROM lineitem""",
    "flags_filter": f"""WITH {LINES} SELECT l_orderkey, l_partkey, l_linenumber, flags FROM li
        WHERE l_returnflag = 'R' AND (l_discount > 0 OR l_tax > 0) AND NOT l_quantity >= 30""",
    "flags_filter_mask": f"""WITH {LINES} SELECT l_orderkey, l_partkey, l_linenumber, flags FROM li
        WHERE l_returnflag = 'R' AND (l_discount > 0 OR l_tax > 0) AND NOT l_quantity >= 30""",
    "flags_filter_files": f"""WITH {LINES} SELECT l_orderkey, l_partkey, l_linenumber, flags FROM li
        WHERE l_returnflag = 'R' AND (l_discount > 0 OR l_tax > 0) AND NOT l_quantity >= 30""",
    "flags_update": f"""WITH {ORDERS}, up AS (SELECT *, CASE o_orderpriority
          WHEN '1-URGENT' THEN [32, 2, 0, 0] WHEN '2-HIGH' THEN [64, 0, 8, 8] WHEN '3-MEDIUM' THEN [0, 24, 16, 2]
          WHEN '5-LOW' THEN [8, 1, 0, 1] ELSE [0, 0, 0, 0] END AS m FROM ord)
        SELECT o_orderkey, CAST(CASE WHEN (flags & m[4]) = m[4] THEN xor((flags & ~m[2]) | m[1], m[3]) ELSE flags END
          AS SMALLINT) AS flags FROM up""",
    "flags_fold": f"""WITH last AS (SELECT user_id, event_type, arg_max(value > 10, event_id) AS v FROM events GROUP BY ALL)
        SELECT user_id, CAST(bit_or(CASE WHEN v THEN {EVENT_BIT} ELSE 0 END) AS SMALLINT) AS flags FROM last GROUP BY 1""",
    "flags_fold_runs": f"""WITH last AS (SELECT user_id, event_type, arg_max(value > 10, event_id) AS v FROM events GROUP BY ALL)
        SELECT user_id, CAST(bit_or(CASE WHEN v THEN {EVENT_BIT} ELSE 0 END) AS SMALLINT) AS flags FROM last GROUP BY 1""",
    "flags_counts": f"""WITH {LINES}, g AS (SELECT l_linestatus, l_linenumber, count(*) AS rows_total,
          CAST(sum(bit_count(flags)) AS BIGINT) AS bits_total, {", ".join(
              f"count(*) FILTER (flags & {1 << i} <> 0) AS {n}" for i, n in enumerate(NAMES))}
          FROM li GROUP BY 1, 2)
        {" UNION ALL ".join(
            f"SELECT l_linestatus, l_linenumber, rows_total, bits_total, '{n}' AS flag, {n} AS rows_set FROM g"
            for n in NAMES)}""",
    "flags_union": f"SELECT user_id, CAST(bit_or({EVENT_BIT}) AS SMALLINT) AS flags FROM events GROUP BY 1",
    "flags_intersect": f"WITH {LINES} SELECT l_orderkey, bit_and(flags) AS flags FROM li GROUP BY 1",
    "flags_parity": f"SELECT user_id, CAST(bit_xor({EVENT_BIT}) AS SMALLINT) AS flags FROM events GROUP BY 1",
    "flags_decode": f"""WITH {LINES} SELECT l_orderkey, l_partkey, l_linenumber, {_decoded('flags', NAMES)} AS flag_names,
        {_decoded_sorted('flags', {n: 1 << i for i, n in enumerate(NAMES)})} AS sorted_names,
        {_decoded('flags', NAMES[:3])} AS known_names FROM li""",
    "flags_from_map": """SELECT p_partkey, CAST(CASE WHEN p_size >= 50 THEN 0 ELSE
          CASE WHEN p_size & 1 <> 0 THEN 2 ELSE 0 END
        + CASE WHEN p_size & 6 <> 0 THEN 4 ELSE 0 END
        + CASE WHEN p_size & 24 <> 0 THEN 8 ELSE 0 END END AS SMALLINT) AS flags FROM part""",
    "flag_dictionary": f"""WITH {DICTIONARY} SELECT file, struct_name, field, flag_name, bit,
        CASE WHEN n <= 8 THEN 8 WHEN n <= 16 THEN 16 WHEN n <= 32 THEN 32 ELSE 64 END AS width FROM dict""",
    "flags_dispatch": """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'refund'
        WHEN l_discount > 0 THEN 'rebate' WHEN l_quantity >= 30 THEN 'freight' END AS action FROM lineitem""",
    "flags_stages": f"""SELECT user_id, {DAY} AS day,
          CAST(bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END) AS BIGINT) AS stages,
          count(DISTINCT event_type) FILTER (event_type IN ('signup', 'view', 'purchase')) = 3 AS complete
        FROM events GROUP BY ALL""",
    "flags_stage_share": f"""WITH per AS (SELECT user_id, {DAY} AS day,
          count(DISTINCT event_type) FILTER (event_type IN ('signup', 'view', 'purchase')) = 3 AS complete
        FROM events GROUP BY ALL)
        SELECT day, count(*) AS keys, count(*) FILTER (complete) AS complete_keys FROM per GROUP BY 1""",
    "rules_compile": f"""WITH {RULES} SELECT chain_id, var, value, arg_min(action, position) AS action,
        min(position) AS position FROM prefix WHERE valid = 1 AND branches >= 3 GROUP BY ALL""",
    "rules_residual": f"""WITH {RULES} SELECT chain_id, position, var, op, value, action FROM prefix
        WHERE valid = 0 OR branches < 3""",
    "rules_apply": """SELECT o_orderkey, o_orderstatus, o_orderpriority,
        CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN 'none'
          ELSE 'lane_' || o_orderstatus || substr(o_orderpriority, 1, 1) END AS action FROM orders""",
    "mask_literals": f"""SELECT p_partkey, {_masked('p_name')} AS p_name, {_masked('p_type', 'PartType')} AS p_type FROM part""",
    "mask_roundtrip": f"""SELECT conv_id, turn, md5({_masked('text')}) AS masked_md5, md5(text) AS unmasked_md5
        FROM conversations""",
    "literal_report": f"""WITH tok AS (SELECT source AS file, lang,
          unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{Nd}}_$]+'), lambda t: t <> '')) AS literal FROM documents)
        SELECT file, CASE WHEN lang = 'es' AND regexp_matches(literal, '^[A-Z]') THEN 'import'
          WHEN regexp_matches(literal, '^(https?|www)') THEN 'tag'
          WHEN regexp_matches(literal, '^[A-Z0-9_$]+$') THEN 'constant'
          WHEN strlen(literal) < 4 THEN 'short' WHEN literal IN {_STOP} THEN 'stop_word' ELSE 'masked' END AS reason,
          count(*) AS literals FROM tok GROUP BY ALL""",
    "pseudonymise": _pseudonyms(1),
    "pseudonymise_medium": _pseudonyms(2),
    "pseudonymise_high": _pseudonyms(3),
    "mask_policy": f"""WITH {MARKED} SELECT doc_id, policy,
        md5(CASE WHEN policy = 'skipped' THEN text ELSE {_masked('text')} END) AS text_md5 FROM policy""",
    "policy_counts": f"""WITH {MARKED} SELECT source, count(*) FILTER (policy = 'masked') AS masked,
        count(*) FILTER (policy = 'skipped') AS skipped FROM policy GROUP BY 1""",
    "tag_keywords": """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license'
        WHEN contains(lower(text), 'the ') THEN 'the ' WHEN contains(lower(text), 'de ') THEN 'de '
        WHEN contains(lower(text), 'check') THEN 'check' END AS keyword FROM documents""",
    "keyword_counts": """WITH k AS (SELECT lower(text) AS t, CASE WHEN contains(lower(text), 'license') THEN 'license'
          WHEN contains(lower(text), 'the ') THEN 'the ' WHEN contains(lower(text), 'de ') THEN 'de '
          WHEN contains(lower(text), 'check') THEN 'check' END AS first FROM documents)
        SELECT kw AS keyword, count(*) FILTER (contains(t, kw)) AS rows_with, count(*) FILTER (first = kw) AS rows_first
        FROM k CROSS JOIN (VALUES ('license'), ('the '), ('de '), ('check')) AS v(kw) GROUP BY 1""",
    "keyword_table": f"{KEYWORD_MATCHES} SELECT keyword, count(*) AS rows_with FROM m GROUP BY 1",
    "keyword_table_first": f"{KEYWORD_MATCHES} SELECT doc_id, arg_min(keyword, rank) AS keyword, count(*) AS n_keywords FROM m GROUP BY 1",
    "token_profile": TOKEN_PROFILE,
    "rebase_paths": f"""WITH {PAGE_PATHS} SELECT page_id, CASE WHEN string_split(path, '/')[1] IN ('fr', 'de')
          OR starts_with(path, 'site') OR contains(path, '.') THEN path ELSE 'site/' || trim(path, '/') END AS path FROM paths""",
    "first_line": r"""SELECT doc_id, trim(substr(list_filter(list_transform(string_split(text, chr(10)),
          lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: starts_with(l, 'De '))[1], 4), ' ') AS line FROM documents""",
    "count_lines": """SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)),
          lambda l: contains(l, 'de ') OR contains(l, 'la '))) AS BIGINT) AS lines FROM documents""",
    "check_rows": """WITH e AS (SELECT event_id, event_type AS package,
          CASE WHEN event_type = 'error' AND value > 50 THEN '!' || props ELSE props END AS props FROM events)
        SELECT event_id, package, CASE WHEN json_valid(props) THEN 'ok' ELSE 'error' END AS status,
          CASE WHEN NOT json_valid(props) THEN 'malformed: ' || props END AS error FROM e""",
    "check_summary": """WITH e AS (SELECT event_type AS package, NOT json_valid(
          CASE WHEN event_type = 'error' AND value > 50 THEN '!' || props ELSE props END) AS bad FROM events)
        SELECT package, count(*) AS checked, count(*) FILTER (bad) AS failed,
          CASE WHEN count(*) FILTER (bad) > 0 THEN 'failed' ELSE 'ok' END AS status FROM e GROUP BY 1""",
    "candidates": f"WITH {CANDIDATES} SELECT file, struct_name, bool_fields, line FROM cand",
    "complexity": f"""SELECT user_id, {DAY} AS day, CAST(1 + sum({NODE_SCORE}) AS BIGINT) AS complexity FROM events GROUP BY ALL""",
    "owner_complexity": """WITH o AS (SELECT user_id AS file, event_id AS s, event_id + 400 AS e FROM events WHERE event_type = 'purchase'),
          n AS (SELECT user_id AS file, event_id AS line, event_type FROM events WHERE event_type <> 'purchase'),
          placed AS (SELECT n.file, o.s, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 1 ELSE 2 END AS w
            FROM n ASOF JOIN o ON n.file = o.file AND n.line >= o.s WHERE n.line <= o.e)
        SELECT o.file, 'fn_' || o.s AS name, CAST(1 + coalesce(sum(w), 0) AS BIGINT) AS complexity
        FROM o LEFT JOIN placed p ON p.file = o.file AND p.s = o.s GROUP BY ALL""",
    "chain_lengths": """WITH RECURSIVE l AS (SELECT (conv_id << 32) + turn AS id,
            CASE WHEN role <> 'system' THEN (conv_id << 32) + turn + 1 END AS nxt FROM conversations),
          walk AS (SELECT id, nxt, 1 AS n FROM l
            UNION ALL SELECT w.id, l.nxt, w.n + 1 FROM walk w LEFT JOIN l ON l.id = w.nxt WHERE w.nxt IS NOT NULL)
        SELECT id, CAST(max(n) AS BIGINT) AS length FROM walk GROUP BY 1""",
    "owner_complexity_nested": """WITH o AS (SELECT user_id AS file, 'fn_' || event_id AS name, event_id AS s, event_id + 400 + event_id % 7 * 900 AS e
            FROM events WHERE event_type = 'purchase'),
          n AS (SELECT user_id AS file, event_id AS line, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 1 ELSE 2 END AS w
            FROM events WHERE event_type <> 'purchase')
        SELECT o.file, name, s AS start_line, e AS end_line, CAST(1 + coalesce(sum(w), 0) AS BIGINT) AS complexity
        FROM o LEFT JOIN n ON n.file = o.file AND n.line BETWEEN s AND e GROUP BY ALL""",
    "chain_status": """WITH RECURSIVE t AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
          l AS (SELECT (conv_id << 32) + turn AS id, CASE WHEN turn = last AND conv_id % 3 = 0 THEN (conv_id << 32) + 1
            WHEN role <> 'system' THEN (conv_id << 32) + turn + 1 END AS nxt FROM t),
          walk AS (SELECT id, id AS at FROM l UNION SELECT w.id, l.nxt FROM walk w JOIN l ON l.id = w.at WHERE l.nxt IS NOT NULL),
          ends AS (SELECT w.id, count(*) AS n, bool_or(l.nxt IS NULL) AS ended FROM walk w LEFT JOIN l ON l.id = w.at GROUP BY 1)
        SELECT id, CASE WHEN ended THEN n END AS length, CASE WHEN ended THEN 'ended' ELSE 'cyclic' END AS status FROM ends""",
    "branch_counts": f"WITH {ORDER_LINES} SELECT o_orderkey, branches FROM counts",
    "score_contexts": f"WITH {CONTEXTS} SELECT file, type, name, complexity, start_line, end_line, eligible FROM ctx",
    "select_contexts": f"WITH {CONTEXTS} SELECT file, type, name, complexity FROM ctx WHERE eligible AND {SIMPLE}",
    "select_contexts_by_type": f"""WITH {CONTEXTS} SELECT file, type, name, complexity, eligible FROM ctx
        WHERE type IN ('function', 'if_chain') AND NOT {SIMPLE}""",
    "dependencies": f"""WITH {REGION_CONTEXTS} SELECT file, type, name, start_line,
        CASE WHEN type = 'function' AND contains(lower(name), 'handler')
          THEN (SELECT count(*) FROM ctx s WHERE s.file = c.file AND s.type = 'struct') ELSE 0 END AS dependencies FROM ctx c""",
    "dependency_members": f"""WITH {REGION_CONTEXTS} SELECT file, name, start_line FROM ctx WHERE type = 'struct'
        AND file IN (SELECT file FROM ctx WHERE type = 'function' AND contains(lower(name), 'handler'))""",
    "expand_states": f"""WITH {ORDER_LINES}, e AS (SELECT o_orderkey, CAST(unnest(range(branches)) AS INTEGER) AS bit FROM counts)
        SELECT o_orderkey, 'switch' AS type, bit, 'case_' || bit AS state, 'match_case_' || bit AS condition,
          'execute_case_' || bit AS action FROM e""",
    "expand_mixed_states": f"""WITH {CONTEXTS},
        c AS (SELECT file, name, type, CAST(unnest(range(complexity)) AS INTEGER) AS bit FROM ctx WHERE type IN ('if_chain', 'switch')),
        f(type, bit, state, condition, action) AS (VALUES
          ('function', 0, 'function_entry', 'function_called', 'initialize_context'),
          ('function', 1, 'function_processing', 'parameters_validated', 'execute_logic'),
          ('function', 2, 'function_exit', 'logic_completed', 'return_result'),
          ('auth_logic', 0, 'auth_check_init', 'user_input_received', 'validate_input_format'),
          ('auth_logic', 1, 'auth_processing', 'input_valid', 'perform_obfuscated_check'),
          ('auth_logic', 2, 'auth_result', 'check_completed', 'return_auth_status'))
        SELECT file, name, type, bit, CASE type WHEN 'switch' THEN 'case_' ELSE 'condition_' END || bit AS state,
          CASE type WHEN 'switch' THEN 'match_case_' ELSE 'evaluate_condition_' END || bit AS condition,
          CASE type WHEN 'switch' THEN 'execute_case_' ELSE 'execute_branch_' END || bit AS action FROM c
        UNION ALL
        SELECT file, name, type, CAST(bit AS INTEGER), state, condition, action FROM ctx JOIN f USING (type) WHERE eligible""",
    "findings": f"WITH {FINDINGS} SELECT * FROM found",
    "summary": f"""WITH {FINDINGS} SELECT count(DISTINCT file) AS files_analyzed, count(*) AS total_optimizations,
        CAST(coalesce(sum(bytes_saved), 0) AS BIGINT) AS estimated_bytes_saved,
        coalesce(avg(speedup), 1.0) AS average_speedup_factor, count(security_strength) AS security_features FROM found""",
    "project_stats": """WITH c AS (SELECT doc_id AS file,
          len(list_filter(string_split(text, chr(10)), lambda l: length(l) >= 200)) AS n FROM documents),
          j AS (SELECT n, quality = 1 AND n > 0 AS done, toxic FROM c LEFT JOIN labels ON doc_id = file)
        SELECT count(*) AS total_files, count(*) FILTER (n > 0) AS files_with_contexts,
          count(*) FILTER (done) AS transpiled_files, CAST(sum(n) AS BIGINT) AS contexts_found,
          CAST(coalesce(sum(n) FILTER (done), 0) AS BIGINT) AS contexts_transpiled,
          count(*) FILTER (toxic = 1) AS errors FROM j""",
    "project_issues": "SELECT doc_id AS file, 'toxic' AS error FROM labels WHERE toxic = 1",
    "size_estimate": f"""WITH {DICTIONARY}, c AS (SELECT struct_name, count(*) AS rows FROM fields GROUP BY 1),
          d AS (SELECT struct_name, count(*) AS n FROM dict GROUP BY 1),
          j AS (SELECT c.struct_name, rows, coalesce(n, 0) AS n FROM c LEFT JOIN d USING (struct_name))
        SELECT struct_name, n AS flags, rows, n * rows AS bytes_before, 8 * rows AS bytes_after,
          CASE WHEN n > 0 THEN greatest(CAST(0 AS DOUBLE), CAST(n - 8 AS DOUBLE) / n * 100) END AS reduction_pct FROM j""",
    "overlay": """SELECT doc_id, md5(coalesce(b.text, d.text)) AS text_md5,
        CASE WHEN b.text IS NULL THEN 'original' ELSE 'generated' END AS origin
        FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
    "route_rows": f"""WITH {PAGE_PATHS}, {PAGE_LINKS} SELECT page_id AS file, path, CAST(contexts AS BIGINT) AS contexts,
        CASE WHEN contexts = 0 THEN 'copy' WHEN string_split(path, '/')[1] = 'en' THEN 'preserve' ELSE 'transform' END AS route
        FROM paths JOIN links ON file = page_id""",
    "preserved_annotations": f"""WITH {CONTEXTS} SELECT file, type, name, complexity,
        'Optimization opportunity: ' || type || ' (' || name || ') at lines ' || start_line || '-' || end_line AS note
        FROM ctx WHERE eligible AND {SIMPLE} AND file LIKE '%1'""",
    "compare": f"WITH {COMPARED} SELECT o_orderkey, status FROM cmp",
    "compare_columns": f"WITH {COLUMN_COMPARED} SELECT * FROM differs",
    "changed_columns": f"""WITH {COLUMN_COMPARED} SELECT key, CAST(sum(CASE "column" WHEN 'o_orderstatus' THEN 1 WHEN 'o_totalprice' THEN 2 ELSE 4 END) AS BIGINT) AS mask,
        string_agg("column", ',' ORDER BY CASE "column" WHEN 'o_orderstatus' THEN 1 WHEN 'o_totalprice' THEN 2 ELSE 4 END) AS changed_columns
        FROM differs GROUP BY key""",
    "column_summary": f"""WITH {COLUMN_COMPARED} SELECT "column", count(*) AS keys, CAST(sum(differing) AS BIGINT) AS rows FROM differs GROUP BY 1""",
    "compare_outcome": f"""WITH {COMPARED} SELECT o_orderkey,
        CASE status WHEN 'matched' THEN 'passed' WHEN 'extra' THEN 'extra' ELSE 'failed' END AS outcome FROM cmp""",
    "compare_summary": f"""WITH {COMPARED}, s AS (SELECT count(*) FILTER (status <> 'extra') AS total,
          count(*) FILTER (status = 'matched') AS passed, count(*) FILTER (status IN ('changed', 'missing')) AS failed,
          count(*) FILTER (status = 'extra') AS extra FROM cmp)
        SELECT total, passed, failed, extra, CASE WHEN total > 0 THEN printf('%.1f', passed / total * 100) ELSE '0.0' END || '%'
          AS coverage FROM s""",
    "checksums": """SELECT doc_id AS path, sha256(text) AS sha256, doc_id || '.sha256' AS sidecar FROM documents""",
    "duplicate_contents": """SELECT sha256(text) AS sha256, count(*) AS files, min(doc_id) AS first_path FROM documents
        GROUP BY 1 HAVING count(*) > 1""",
    "size_report": """WITH s AS (SELECT source, lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY ALL)
        SELECT source, lang, bytes, CASE WHEN bytes > 1048576 THEN printf('%.1f', CAST(bytes AS DOUBLE) / 1024 / 1024) || 'MB'
          ELSE printf('%.1f', CAST(bytes AS DOUBLE) / 1024) || 'KB' END AS size FROM s""",
    "versions": f"""WITH {VERSIONS} SELECT p_partkey, p_brand, version, array_to_string(best, '.') AS latest,
        CASE WHEN parts IS NULL THEN 'invalid' WHEN len(parts) <> len(best) THEN 'mismatch' ELSE 'ok' END AS status,
        CASE WHEN parts IS NULL OR len(parts) <> len(best) THEN NULL WHEN parts < best THEN -1 WHEN parts > best THEN 1 ELSE 0 END AS cmp,
        CASE WHEN parts IS NULL OR len(parts) <> len(best) THEN NULL ELSE parts = best END AS is_latest FROM ranked""",
    "registry_rows": """SELECT event_id, '/run/' || event_type AS ipc_socket, 1024 AS ns_bits, event_id AS cap_mask,
        CAST(json_extract(props, '$.k') AS BIGINT) * event_id AS state, 1 AS declared,
        CAST(json_extract(props, '$.k') AS INTEGER) AS seq, (1700000000000000999 + event_id * 1000000007) // 1000 AS epoch_us FROM events""",
    "registry_values": """SELECT event_id, user_id AS key_hash, CAST(json_extract(props, '$.k') AS BIGINT) AS value, true AS declared
        FROM events UNION ALL
        SELECT event_id, user_id + 1, event_id + CAST(json_extract(props, '$.k') AS BIGINT), false FROM events""",
    "job_state": f"""WITH {JOB_EVENTS}, g AS (SELECT user_id, day, list(op ORDER BY ts, event_id) AS ops FROM ev GROUP BY ALL),
        m AS (SELECT user_id, day, CAST({GUARDED_FOLD} AS BIGINT) AS mask FROM g)
        SELECT user_id, day, mask, {_decoded('mask', JOB_BITS)} AS state FROM m""",
    "job_rejections": f"""WITH {JOB_EVENTS},
        w AS (SELECT *, max(CASE WHEN op IN ('complete', 'fail') THEN 1 ELSE 0 END) OVER p AS ended,
            last_value(CASE WHEN op IN ('start', 'retry') THEN op END IGNORE NULLS) OVER p AS moved FROM ev
          WINDOW p AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT user_id, day, event_id, op FROM w WHERE (op <> 'cancel' AND ended = 1) OR (op = 'start' AND moved = 'start')""",
    "job_restartable": f"""WITH {JOB_EVENTS}, g AS (SELECT user_id, day, list(op ORDER BY ts, event_id) AS ops
          FROM ev WHERE op <> 'cancel' GROUP BY ALL),
        m AS (SELECT user_id, day, CAST({RESTARTABLE_FOLD} AS BIGINT) AS mask FROM g)
        SELECT user_id, day, mask, {_decoded_sorted('mask', RESTARTABLE_BITS)} AS state FROM m""",
    "registers_tumbling": f"""WITH {VALUE_FLAGS} SELECT {_text("date_trunc('hour', ts)")} AS window_start,
        {_text("date_trunc('hour', ts) + INTERVAL 1 HOUR")} AS window_end, event_type, bit_or(flags) AS flags FROM vf GROUP BY ALL""",
    "registers_sliding": f"""WITH {VALUE_FLAGS}, s AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w
          FROM vf CROSS JOIN (VALUES (0), (1)) AS v(k))
        SELECT {_text("w")} AS window_start, {_text("w + INTERVAL 1 HOUR")} AS window_end, event_type, bit_or(flags) AS flags
        FROM s GROUP BY ALL""",
    "registers_session": f"""WITH {VALUE_FLAGS},
        g AS (SELECT *, CASE WHEN ts < lag(ts) OVER p + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM vf
          WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT {_text("min(ts)")} AS window_start, user_id, bit_or(flags) AS flags FROM n GROUP BY user_id, session""",
    "late_rows": f"WITH {LATE} SELECT event_id, event_type, CAST(arrival AS INTEGER) AS batch_id FROM judged WHERE late",
    "kept_registers": f"""WITH {LATE} SELECT {_text("date_trunc('hour', ts)")} AS window_start,
        {_text("date_trunc('hour', ts) + INTERVAL 1 HOUR")} AS window_end, event_type, bit_or(flags) AS flags FROM judged WHERE NOT late GROUP BY ALL""",
    "passes_run": f"""WITH {LINES}, kept AS (SELECT * FROM li WHERE l_returnflag = 'R' OR l_quantity >= 30),
        up AS (SELECT k.*, CASE o_orderpriority WHEN '1-URGENT' THEN 32 WHEN '2-HIGH' THEN 64 WHEN '3-MEDIUM' THEN 0
            WHEN '5-LOW' THEN 8 END AS s FROM kept k LEFT JOIN orders ON o_orderkey = l_orderkey),
        done AS (SELECT *, CAST(CASE WHEN s IS NULL THEN flags ELSE (flags & ~1) | s END AS SMALLINT) AS f FROM up)
        SELECT l_orderkey, l_partkey, l_linenumber, f AS flags, f & 1 <> 0 AS returned, f & 8 <> 0 AS taxed, l_linestatus,
          CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'N' THEN 'note' ELSE 'refund' END AS action FROM done""",
    "dictionary_saved": f"""WITH {DICTIONARY} SELECT file, CAST(struct_name AS VARCHAR) AS struct_name, field, flag_name, bit,
        CASE WHEN n <= 8 THEN 8 WHEN n <= 16 THEN 16 WHEN n <= 32 THEN 32 ELSE 64 END AS width FROM dict""",
    "flags_wide": f"""WITH u AS (SELECT l_orderkey, {WIDE} FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CASE WHEN {WIDE_ANY} THEN concat_ws('|', {WIDE_NAMES}) ELSE 'none' END AS flag_names,
          CASE WHEN NOT f69 THEN 'last' WHEN f64 THEN 'second word' WHEN NOT f0 THEN 'first' END AS action FROM u""",
    "flags_wide_counts": f"""WITH li AS (SELECT l_linenumber, {", ".join(
            ("false" if i in (62, 63) else f"(l_partkey + l_linenumber + {i * i}) % 11 = 0") + f" AS f{i}" for i in range(70))} FROM lineitem),
        g AS (SELECT l_linenumber, count(*) AS rows_total, {", ".join(f"count(*) FILTER (f{i}) AS f{i}" for i in range(70))} FROM li GROUP BY 1),
        t AS (SELECT *, {" + ".join(f"f{i}" for i in range(70))} AS bits_total FROM g)
        {" UNION ALL ".join(f"SELECT l_linenumber, rows_total, bits_total, 'f{i}' AS flag, f{i} AS rows_set FROM t" for i in range(70))}""",
    "control_marks": f"""WITH t AS (SELECT conv_id, turn, text || chr(10) || CASE conv_id % 5 WHEN 0 THEN '//flagframe:nobfuscate'
            WHEN 1 THEN CASE WHEN turn = 1 THEN '// flagframe:force' ELSE '' END
            WHEN 2 THEN CASE WHEN turn = 0 THEN '// flagframe:nobfuscate' ELSE '//flagframe:force' END
            WHEN 3 THEN '// flagframe:force flagframe:nobfuscate' ELSE '' END AS text FROM conversations),
        m AS (SELECT *, CASE WHEN contains(text, 'flagframe:nobfuscate') THEN 1 WHEN contains(text, 'flagframe:force') THEN 0 END AS mark FROM t),
        p AS (SELECT conv_id, arg_max(mark, turn) FILTER (mark IS NOT NULL) AS mark FROM m GROUP BY 1),
        q AS (SELECT t.conv_id, turn, text, CASE WHEN p.mark = 1 THEN 'skipped' ELSE 'masked' END AS policy FROM t JOIN p USING (conv_id))
        SELECT conv_id, turn, policy, md5(CASE WHEN policy = 'skipped' THEN text ELSE {_masked('text')} END) AS text_md5 FROM q""",
    "report_text": f"""WITH {FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY location, description) AS number,
          count(*) OVER (PARTITION BY file) AS found_in_file FROM found)
        SELECT file, number, concat_ws(chr(10), number || ' of ' || found_in_file || ' in ' || file, 'File: ' || file, '  ' || description,
          '     Type: ' || type, '     Location: ' || location, '     Bytes saved: ' || bytes_saved,
          '     Speedup: ' || printf('%.2f', speedup) || 'x', '  Security: ' || security_description || ' (' || security_strength || ')') AS lines FROM n""",
    "report_document": f"""WITH {FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY location, description) AS number,
          count(*) OVER (PARTITION BY file) AS n, min(file) OVER () AS first FROM found),
        j AS (SELECT *, '{{"type":"' || type || '","description":"' || description || '","location":"' || location || '","bytes_saved":' || bytes_saved
            || ',"speedup_factor":2.5}}' AS item, '{{"description":"' || security_description || '","strength":"Medium"}}' AS feature FROM n),
        s AS (SELECT '{{"summary":{{"files_analyzed":' || count(DISTINCT file) || ',"total_optimizations":' || count(*) || ',"estimated_bytes_saved":'
            || sum(bytes_saved) || ',"average_speedup_factor":2.5,"security_features":' || count(*) || '}},"results":[' AS head FROM found)
        SELECT 0 AS part, NULL::VARCHAR AS file, 0 AS section, 0::BIGINT AS number, head AS value FROM s UNION ALL SELECT 2, NULL, 0, 0, ']}}' UNION ALL
        SELECT 1, file, 0, number, CASE WHEN number > 1 THEN ',' ELSE CASE WHEN file = first THEN '' ELSE ',' END || '{{"original_file":"' || file
          || '","transpiled_file":"' || file || '","findings":' || n || ',"optimizations":[' END || item
          || CASE WHEN number = n THEN '],"security_features":[' ELSE '' END FROM j UNION ALL
        SELECT 1, file, 1, number, CASE WHEN number > 1 THEN ',' ELSE '' END || feature || CASE WHEN number = n THEN ']}}' ELSE '' END FROM j""",
    "stream_checks": """WITH e AS (SELECT event_id, event_type AS package,
          CASE WHEN event_type = 'error' AND value > 50 THEN '!' || props ELSE props END AS props FROM events)
        SELECT event_id, package, 'error' AS status, 'malformed: ' || props AS error FROM e WHERE NOT json_valid(props)""",
}

# The streams give what the tables give.
ORACLE["stream_job_state"] = ORACLE["job_state"].replace(f", {_decoded('mask', JOB_BITS)} AS state", "")
ORACLE["stream_job_rejections"] = ORACLE["job_rejections"]
ORACLE["stream_rejections_keyed"] = ORACLE["stream_rejections_ordered"] = ORACLE["job_rejections"]
ORACLE["registers_session_stitched"] = ORACLE["stream_sessions"] = ORACLE["registers_session"]
ORACLE["stream_registers"] = ORACLE["registers_tumbling"]
