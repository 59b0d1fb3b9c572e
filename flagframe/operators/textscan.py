"""Text scans: keywords, token classes, paths and lines. All are narrow but for counts and keyword tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.functions import text as T
from flagframe.functions.bits import FlagSet, pack
from flagframe.session import staged


def tag_keywords(
    df: DataFrame, col: str, keywords: Sequence[str] = T.AUTH_KEYWORDS, out: str = "keyword"
) -> DataFrame:
    """First keyword contained in the lower-cased text; NULL when there is none."""
    return df.withColumn(out, T.first_keyword(F.col(col), keywords))


def keyword_counts(df: DataFrame, col: str, keywords: Sequence[str] = T.AUTH_KEYWORDS) -> DataFrame:
    """Rows that contain each keyword, and rows it is the first match of; each text is searched once per keyword."""
    low = F.lower(F.col(col))
    # one bit per keyword, named in a projection of its own: of these integers alone the counts are taken
    word = 62
    parts = [list(keywords[at : at + word]) for at in range(0, len(keywords), word)]
    masks = [pack(FlagSet(p), {k: F.contains(low, F.lit(k)) for k in p}).cast("bigint").alias(f"_w{i}") for i, p in enumerate(parts)]
    seen = df.select(*masks).groupBy(*[f"_w{i}" for i in range(len(parts))]).agg(F.count(F.lit(1)).alias("_rows"))

    def hits(at: int) -> tuple[Column, Column]:
        w, bit = divmod(at, word)
        mask = F.col(f"_w{w}")
        has = mask.bitwiseAND(F.lit(1 << bit)) != 0
        before = mask.bitwiseAND(F.lit((1 << bit) - 1)) == 0
        for earlier in range(w):
            before = before & (F.col(f"_w{earlier}") == 0)
        return has, has & before

    rows = []
    for at, keyword in enumerate(keywords):
        has, first = hits(at)
        rows.append(F.struct(F.lit(keyword).alias("keyword"), F.when(has, F.col("_rows")).otherwise(0).alias("hit"), F.when(first, F.col("_rows")).otherwise(0).alias("first")))
    counts = seen.select(F.explode(F.array(*rows)).alias("k"))
    return counts.groupBy("k.keyword").agg(F.sum("k.hit").alias("rows_with"), F.sum("k.first").alias("rows_first"))


GRAM = 8
WORD = r"[\p{L}\p{M}\p{N}_]"


def _found(df: DataFrame, cols: Sequence[str], col: str, known: DataFrame, gram: int, name: str) -> DataFrame:
    """(cols..., ``name`` of the keyword): a row for every place of ``col`` at which a keyword starts.

    A place looks up its first characters, at most ``gram``, which name the lengths of the keywords that
    begin so, and then the texts of these lengths themselves. So it makes a row per length, not per keyword.
    """
    grams = known.select(F.substring("keyword", 1, gram).alias("_gram"), "_length").groupBy("_gram")
    grams = staged(grams.agg(F.collect_set("_length").alias("_lengths")), "keyword-starts")
    length = F.col("_length")
    ends = known.agg(F.min(length).alias("shortest"), F.max(length).alias("longest"), F.collect_set(F.least(length, F.lit(gram))).alias("sizes")).first()
    # the look-ahead takes what follows a place, the dot steps on by one character
    places = F.regexp_extract_all(F.col(col), F.lit(f"(?s)(?=(.{{{ends['shortest']},{ends['longest']}}}))."), F.lit(1))
    at = df.select(*cols, F.explode(places).alias("_here"))
    # near the end of a text several sizes give one and the same beginning
    starts = F.explode(F.array_distinct(F.array(*[F.substring("_here", 1, n) for n in sorted(ends["sizes"])])))
    met = at.select(*cols, "_here", starts.alias("_gram")).join(grams, "_gram")
    met = met.select(*cols, "_here", F.explode("_lengths").alias("_length")).where(length <= F.char_length("_here"))
    cut = met.select(*cols, F.col("_here").substr(F.lit(1), length).alias("keyword"))
    return cut.join(known.select(*dict.fromkeys(["keyword", name])), "keyword").select(*cols, name)


def keyword_matches(
    df: DataFrame, id_cols: Sequence[str], col: str, keywords: DataFrame, gram: int = GRAM, name: str = "keyword"
) -> DataFrame:
    """(id..., keyword, occurrences) for every keyword of a table that the lower-cased text contains.

    ``keywords`` has distinct values in ``keyword``; null and empty ones match nothing. ``name`` is the column
    that the result gives of a keyword: another with distinct values, such as a rank, spares a join of the matches. A keyword of
    letters, marks, digits and underscores lies within one run of such characters, so these keywords are sought once
    in the distinct runs that are long enough, and every text joins its runs. Other keywords are sought
    at every place of the texts. Either way a place makes a row per length of the keywords that begin as it does,
    however many there are, and carries as many characters as the longest has, never the text. Spark broadcasts
    the written keywords while their files are small.
    """
    known = keywords.where("keyword <> ''").select(*dict.fromkeys(["keyword", name]), F.char_length("keyword").alias("_length"))
    known = staged(known.withColumn("_word", F.col("keyword").rlike(rf"\A{WORD}+\z")), "keywords")
    shortest = {r["_word"]: r["shortest"] for r in known.groupBy("_word").agg(F.min("_length").alias("shortest")).collect()}
    low = df.select(*id_cols, F.lower(F.col(col)).alias("_text"))
    none = F.lit(None).cast(known.schema[name].dataType).alias(name)
    found = [low.select(*id_cols, none, F.lit(1).alias("_n")).where(F.lit(False))]
    if True in shortest:
        # a run that is too short is left at its first character
        run = F.explode(F.regexp_extract_all("_text", F.lit(f"(?<!{WORD}){WORD}{{{shortest[True]},}}"), F.lit(0)))
        # written, so that the texts are cut once for the distinct runs and for the join
        runs = staged(low.select(*id_cols, run.alias("_run")), "keyword-runs")
        inside = _found(runs.select("_run").distinct(), ["_run"], "_run", known.where("_word"), gram, name)
        inside = inside.groupBy("_run", name).agg(F.count(F.lit(1)).alias("_n"))
        found.append(runs.join(inside, "_run").select(*id_cols, name, "_n"))
    if False in shortest:
        others = _found(low, id_cols, "_text", known.where("NOT _word"), gram, name)
        found.append(others.select(*id_cols, name, F.lit(1).alias("_n")))
    return reduce(DataFrame.unionByName, found).groupBy(*id_cols, name).agg(F.sum("_n").alias("occurrences"))


def keyword_table_counts(matches: DataFrame) -> DataFrame:
    """Rows that contain each keyword of a table, and how often it occurs in all; keywords without a row are left out."""
    return matches.groupBy("keyword").agg(F.count(F.lit(1)).alias("rows_with"), F.sum("occurrences").alias("occurrences"))


def first_of_table(matches: DataFrame, id_cols: Sequence[str], keywords: DataFrame) -> DataFrame:
    """(id..., keyword, n_keywords): of the keywords a row contains the one of the lowest ``rank``, a distinct BIGINT.

    Matches that were taken by ``rank`` are folded as they are; others join the keywords first.
    """
    if "rank" not in matches.columns:
        matches = matches.join(keywords.select("keyword", "rank"), "keyword")
    best = matches.groupBy(*id_cols).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_keywords"))
    return best.join(keywords.select("keyword", "rank"), "rank").select(*id_cols, "keyword", "n_keywords")


def tokens_of(text: Column, separator: str = r"[^A-Za-z]+") -> Column:
    """Non-empty tokens of the whole text."""
    return F.filter(F.split(text, separator), lambda t: t != "")


def token_profile(
    df: DataFrame, id_cols: Sequence[str], col: str, separator: str = r"[^A-Za-z0-9_$\p{L}]+"
) -> DataFrame:
    """Tokens of each class per row, as ``(id..., class, tokens)``.

    Counted inside the row's token array, so nothing is exploded or shuffled.
    """
    classes = T.TOKEN_CLASSES

    def members(name: str) -> Column:
        bit = F.lit(classes.value(name))
        return F.size(F.filter("_masks", lambda m: m.bitwiseAND(bit) != 0)).cast("bigint").alias(name)

    masks = F.transform(tokens_of(F.col(col), separator), T.token_classes)
    listed = df.select(*id_cols, masks.alias("_masks"))
    counted = listed.select(*id_cols, *[members(name) for name in classes.names])
    return counted.unpivot(list(id_cols), list(classes.names), "class", "tokens")


def rebased_path(path: Column, root: str, is_known: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    keep = is_known | F.startswith(path, F.lit(root)) | F.contains(path, F.lit("."))
    joined = F.when(clean == "", F.lit(root)).otherwise(F.concat_ws("/", F.lit(root), clean))
    return F.when(keep, path).otherwise(joined)


def rebase_paths(
    df: DataFrame,
    col: str,
    root: str,
    known_roots: Sequence[str] | DataFrame = T.STANDARD_ROOTS,
    out: str | None = None,
) -> DataFrame:
    """Prefix local paths with ``root``.

    Kept are paths whose first part is a known root, that are under ``root``
    already, or that contain a dot. ``known_roots`` is a list or a one-column table
    of distinct names.
    """
    first = F.split_part(F.col(col), F.lit("/"), F.lit(1))
    if isinstance(known_roots, DataFrame):
        roots = known_roots.select(F.col(known_roots.columns[0]).alias("_root"))
        joined = df.join(roots, first == F.col("_root"), "left")
        return joined.withColumn(out or col, rebased_path(F.col(col), root, F.col("_root").isNotNull())).drop("_root")
    known = first.isin(*known_roots) if known_roots else F.lit(False)
    return df.withColumn(out or col, rebased_path(F.col(col), root, known))


def first_line_with_prefix(df: DataFrame, col: str, prefix: str, out: str = "line") -> DataFrame:
    """Remainder of the first trimmed line that starts with ``prefix``; NULL when none does."""
    lines = F.transform(F.split(F.col(col), "\n"), T.trim_line)
    hit = F.get(F.filter(lines, lambda line: F.startswith(line, F.lit(prefix))), F.lit(0))
    return df.withColumn(out, T.trim_line(F.substring(hit, F.lit(len(prefix) + 1), F.length(hit))))


def count_lines_matching(df: DataFrame, col: str, needles: Sequence[str], out: str = "lines") -> DataFrame:
    """Lines that contain any needle; a line counts once."""
    hits = F.filter(F.split(F.col(col), "\n"), lambda line: T.contains_any(line, needles))
    return df.withColumn(out, F.coalesce(F.size(hits), F.lit(0)).cast("bigint"))
