"""Operator 3: n-gram Jaccard join with set-relation skipping.

A document's set holds the distinct shingles of five words, as 64-bit hashes. Two documents
link when 100 * |A and B| >= 80 * |A or B|. The join returns the components of the links.

1. Exact sets first: documents with equal sets (128-bit digest) are one node.
2. A shared-token filter. Half of every set, its smallest hashes, goes to token owners as Golomb-Rice coded
   blocks of thousands of documents, and one bit per token comes back: does another block or document
   hold it? A set that links to another shares at least 80 % of its tokens, so at
   most 20 % of them may be unshared; a document with more unshared tokens than that among
   the tokens asked for links with nothing. Prose leaves the join here at three bytes a token.
   Distinct sets of what is left ask once more, now for all their tokens, which drops sets that
   only share tokens with their own copies.
3. The remaining sets are indexed by token, in order of frequency, rarest first, with prefix lengths
   by which any linked pair shares a list. Sets whose tokens are too often unique drop out.
4. Answers from a similar set. Every list has a leader, its most central set. Only pairs of
   a leader and a member are counted exactly at first, one row per member. Members that link to
   one leader are connected, so pairs among them need no answer. For other members x and y the
   leader L bounds |x and y| by min(|L and x|, |L and y|) plus the smaller number of shared
   tokens outside L, and nearly all are skipped by that.
5. What is left meets in a join on token and band of set sizes (a factor of 1.25), of which a set probes
   three; pairs whose positions leave too few tokens are skipped one by one.
   Those pairs are counted exactly as well, so no component is lost.

Three parts of the method are replaced. A leader's answers bound other pairs and connect its members, but no
member's linked sets or counts are derived from them: pairs of members that link to one leader are not counted, so that
the result has components and neither all links nor their number. Lists are skipped by size band, which is in
the join's key; positions are a condition on each pair that meets, not blocks to be skipped.

Defined cases: documents with fewer than five words have their whole sequence as one shingle; a
null text and a text without words have an empty set and link with nothing; component_id is
the smallest doc_id of the component, null ids being ignored unless there is no other; repeated rows
are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagframe.llm.batches import bounded, lean, sliced
from flagframe.llm.dedup import members, rice_decode, rice_encode
from flagframe.session import discard, staged

WORDS = 5
BLOCK_TOKENS = 1 << 18
OWNER_TOKENS = 1 << 20
TOKEN_BITS = 48
CACHED_WORDS = 200_000
BROADCAST_ROWS = 500_000
PARTNERS = 1_024

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TURN = np.uint64(0x9E3779B97F4A7C15)


# --- sets ------------------------------------------------------------------------------------------


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text; words are hashed once per worker."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh64_intdigest(word)
        hashed = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(words))
        n = len(words) - width + 1
        mixed = np.full(n, np.uint64(width))
        for i in range(width):
            mixed = _stir(mixed * _TURN + hashed[i : i + n])
        return np.unique(mixed)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    two = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(two[0]), int(two[1])


_BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("keys1", pa.list_(pa.int64())),
        ("keys2", pa.list_(pa.int64())), ("tokens", pa.binary()),
    ]
)
BLOCK_SCHEMA = "block long, doc_ids array<long>, sizes array<long>, keys1 array<long>, keys2 array<long>, tokens binary"


def _half(n: int) -> int:
    return (n + 1) // 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents: ids, set sizes, digests and the smaller half of each set's tokens."""
    part, number, shingles = TaskContext.get().partitionId(), 0, Shingler()
    out: list[list] = [[], [], [], [], []]
    held = 0

    def row():
        columns = [[(part << 32) + number], *([c] for c in out[:4]), [b"".join(out[4])]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = shingles(text)
            one, two = digest(tokens)
            small = (tokens[: _half(len(tokens))] >> np.uint64(64 - TOKEN_BITS)).view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8]
            for column, value in zip(out, (doc_id, len(tokens), one, two, small.tobytes())):
                column.append(value)
            held += _half(len(tokens))
            if held >= BLOCK_TOKENS or len(out[0]) >= BLOCK_TOKENS:
                yield row()
                out, held, number = [[], [], [], [], []], 0, number + 1
    if out[0]:
        yield row()


def _tokens(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) * 8 // TOKEN_BITS, 8), np.uint8)
    wide[:, : TOKEN_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BITS // 8)
    return wide.view(np.int64).ravel()


def _asked(width: int, column: str):
    """Messages to owners: a block's distinct tokens in each owner's range, coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            out: dict[str, list] = {"block": [], "owner": [], "code": []}
            for block, data in zip(batch.column("block").to_pylist(), batch.column(column).to_pylist()):
                values = np.unique(_short(data) if column == "wide" else _tokens(data))
                owner = values // width
                for o in np.unique(owner).tolist():
                    a, b = np.searchsorted(owner, [o, o + 1])
                    out["block"].append(block)
                    out["owner"].append(o)
                    out["code"].append(rice_encode(values[a:b] - o * width, width))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("code", pa.binary())]))

    return run


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(code) for code in group.code]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bits = [np.packbits(members(one, shared)).tobytes() for one in lists]
    return pd.DataFrame({"block": group.block, "owner": group.owner, "bits": bits, "n": [len(one) for one in lists]})


def _shared(tokens: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """Which of a block's tokens another document or block has too."""
    values, where, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    marks = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers or [], key=lambda a: a["owner"])]
    elsewhere = np.concatenate(marks).astype(bool) if marks else np.zeros(len(values), bool)
    return (elsewhere | (counts > 1))[where]


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block that share enough of the tokens asked for."""
    for batch in sliced(batches, 1):
        out: list[list] = [[], [], []]
        for ids, sizes, one, two, data, answers in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "keys1", "keys2", "tokens", "answers"))):
            sizes = np.array(sizes, np.int64)
            asked = (sizes + 1) // 2
            ends = np.cumsum(asked)
            total = np.concatenate([[0], np.cumsum(_shared(_tokens(data), answers))])
            found = total[ends] - total[ends - asked]
            for i in np.flatnonzero((sizes > 0) & (asked - found <= sizes - _least(sizes))):
                for column, value in zip(out, (ids[i], one[i], two[i])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "key1", "key2"])


def _least(n):
    """Tokens of a set of ``n`` that a linked set must have too."""
    return -(-4 * n // 5)


def _short(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, np.uint64) >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)


def _answers(blocks: DataFrame, column: str, total: int) -> DataFrame:
    """Blocks with the owners' answers to the tokens in ``column``, one per owner."""
    width = -(-(1 << TOKEN_BITS) // max(1, total // OWNER_TOKENS))
    asked = blocks.select("block", column).mapInArrow(lean(_asked(width, column)), "block long, owner long, code binary")
    answers = asked.groupBy("owner").applyInPandas(_answered, "block long, owner long, bits binary, n int")
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits", "n")).alias("answers"))
    return blocks.join(gathered, "block", "left").select(*blocks.columns, "answers")


def documents_of(blocks: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, key1, key2."""
    fields = F.arrays_zip("doc_ids", "sizes", "keys1", "keys2")
    one = blocks.select(F.explode(fields).alias("d"))
    return one.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n"), F.col("d.keys1").alias("key1"), F.col("d.keys2").alias("key2"))


def sharing_nodes(blocks: DataFrame) -> DataFrame:
    """Distinct sets that may link to another or have copies: key1, key2 and a document that has the set."""
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + F.shiftright(n + 1, 1)))).first()[0] or 0
    passed = _answers(blocks, "tokens", total).mapInArrow(lean(_passed), "doc_id long, key1 long, key2 long")
    return passed.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for batch in batches:
        found = [shingles(text) for text in batch.column(1).to_pylist()]
        keys = [digest(tokens) for tokens in found]
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
        columns.append(pa.array([tokens.view(np.int64) for tokens in found], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, ["key1", "key2", "tokens"])


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct sets of the documents that ``nodes`` name, from their whole texts: node, n, key1, key2, tokens."""
    named = nodes.select(F.col("doc_id").alias("_doc_id")).distinct()
    # numbers only: broadcast up to a size, shuffled beyond
    named = F.broadcast(named) if nodes.count() <= BROADCAST_ROWS else named
    wanted = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_semi")
    sets = wanted.mapInArrow(lean(_sets), "key1 long, key2 long, tokens array<long>").dropDuplicates(["key1", "key2"])
    return sets.select("key1", "key2", "tokens", F.size("tokens").cast("long").alias("n"), F.monotonically_increasing_id().alias("node"))


def _set_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    nodes, sizes, data, held = [], [], [], 0

    def row():
        columns = [pa.array([(part << 32) + number]), pa.array([nodes], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "nodes", "sizes", "wide"])

    for batch in batches:
        lists = batch.column(1)
        for i, node in enumerate(batch.column(0).to_pylist()):
            tokens = lists[i].values.to_numpy()
            nodes.append(node)
            sizes.append(len(tokens))
            data.append(tokens.tobytes())
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                yield row()
                nodes, sizes, data, held, number = [], [], [], 0, number + 1
    if nodes:
        yield row()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared tokens of the sets that share enough of them."""
    for batch in sliced(batches, 1):
        out: list[list] = [[], [], []]
        for nodes, sizes, data, answers in zip(*(batch.column(c).to_pylist() for c in ("nodes", "sizes", "wide", "answers"))):
            tokens, shared, end = np.frombuffer(data, np.int64), _shared(_short(data), answers), 0
            for node, n in zip(nodes, sizes):
                start, end = end, end + n
                own = tokens[start:end][shared[start:end]]
                if len(own) >= max(1, _least(n)):
                    for column, value in zip(out, (node, n, own)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["node", "n", "tokens"])


def shared_tokens(sets: DataFrame) -> DataFrame:
    """Of the distinct sets those that share enough tokens with other sets, with these tokens: node, n, tokens."""
    blocks = staged(sets.select("node", "tokens").mapInArrow(lean(_set_blocks), "block long, nodes array<long>, sizes array<long>, wide binary"), "jaccard-set-blocks")
    total = sets.agg(F.sum("n")).first()[0] or 0
    return _answers(blocks, "wide", total).mapInArrow(lean(_kept), "node long, n long, tokens array<long>")


# --- lists -----------------------------------------------------------------------------------------


def index_lists(shared: DataFrame) -> DataFrame:
    """Entries of lists with two sets or more: token, node, n, shared (tokens held by another set), centre, position."""
    entries = shared.select("node", "n", F.explode("tokens").alias("token"))
    often = entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = staged(entries.join(often, "token"), "jaccard-entries")
    per_node = known.groupBy("node").agg(F.count("*").alias("shared"), F.sum("df").alias("centre"))
    enough = known.join(per_node, "node").where(F.col("shared") >= F.ceil(F.col("n") * 4 / 5))
    # tokens that no other set has come first in the order; they take places of the prefix but open no list
    position = F.col("n") - F.col("shared") + F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    prefix = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    lists = enough.withColumn("position", position).where(F.col("position") <= prefix)
    return lists.select("token", "node", "n", "shared", "centre", F.col("position").cast("long").alias("position"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact number of common tokens of each pair (a, b).

    Every pair takes the tokens of b and then meets those of a, of which there is one copy
    for every ``PARTNERS`` pairs: a leader of many members is as many keys as it needs.
    """
    pairs = staged(pairs, "jaccard-pairs")  # numbers: Spark broadcasts them while their files are small
    per = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")), "jaccard-parts")
    several = per.where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))
    spread = pairs.join(several, "a", "left").select("a", "b", part.alias("part"))
    two = spread.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("_tb")), "b")
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_ta")).join(per, "a")
    one = one.select("a", "_ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return two.join(one, ["a", "part"]).select("a", "b", F.size(F.array_intersect("_ta", "_tb")).cast("long").alias("both"))


def linked(both: Column, n: Column, m: Column) -> Column:
    """100 * both >= 80 * (n + m - both), in integers."""
    return 9 * both >= 4 * (n + m)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b): root is the smallest node reachable.

    Labels fall to the smallest of the neighbours' labels, then to their label's
    label, until none changes; every round is written so that none is computed twice.
    """
    edges = staged(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "jaccard-edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "jaccard-labels")
    while True:
        nearest = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(nearest, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        moved = staged(lower.join(jump, "root").select("node", "was", F.least("root", "beyond").alias("root")), "jaccard-labels")
        changed = moved.where("was <> root").limit(1).count()
        discard(labels)
        labels = moved.select("node", "root")
        if not changed:
            return labels


def links_of(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all links; ``sets`` hold the tokens that another set may hold."""
    leaders = lists.groupBy("token").agg(F.max(F.struct("centre", "node"))["node"].alias("leader"))
    led = staged(lists.join(leaders, "token"), "jaccard-led")
    stars = led.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sizes = sets.select("node", "n")
    size_a, size_b = sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    counted = staged(overlaps(stars, sets).join(size_a, "a").join(size_b, "b"), "jaccard-stars")
    first = counted.where(linked(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    roots = components(first)
    answers = counted.select(F.col("a").alias("leader"), F.col("b").alias("node"), "both")
    known = (
        led.join(answers, ["leader", "node"], "left")
        .withColumn("both", F.coalesce("both", F.col("n")))  # the leader itself
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .join(roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root")), "leader", "left")
        .withColumn("open", F.col("root") != F.coalesce("leader_root", "leader"))
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
        .select("token", "node", "n", "shared", "both", "root", "open", "band", "position")
    )
    known = staged(known, "jaccard-known")
    # a set outside its leader's component meets the blocks of compatible size
    probe = known.where("open AND node IS NOT NULL").select(
        *[F.col(c).alias(f"p_{c}") for c in ("token", "node", "n", "shared", "both", "root", "position")],
        F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("p_band"),
    )
    need = F.ceil(4 * (F.col("n") + F.col("p_n")) / 9)
    outside = F.least(F.col("shared") - F.col("both"), F.col("p_shared") - F.col("p_both"))
    bound = F.least(F.least("both", "p_both") + outside, F.least(F.col("n") - F.col("position"), F.col("p_n") - F.col("p_position")) + 1)
    meets = (
        (F.col("token") == F.col("p_token")) & (F.col("band") == F.col("p_band")) & (F.col("root") != F.col("p_root"))
        & (5 * F.least("n", "p_n") >= 4 * F.greatest("n", "p_n")) & (bound >= need)
    )
    rest = known.join(probe, meets).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
    more = overlaps(rest, sets).join(size_a, "a").join(size_b, "b").where(linked(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    return first.unionAll(staged(more, "jaccard-rest"))


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): documents with their digests, and of each set that others equal or link to its component.

    component is the smallest doc_id, which components may share if ids are repeated; head1, head2
    is the smallest digest of the component, which no other has.
    """
    blocks = staged(texts.mapInArrow(lean(_blocks), BLOCK_SCHEMA), "jaccard-blocks")
    nodes = staged(sharing_nodes(blocks), "jaccard-nodes")
    sets = staged(node_sets(texts, nodes), "jaccard-sets")
    shared = staged(shared_tokens(sets), "jaccard-shared")
    roots = components(links_of(shared, staged(index_lists(shared), "jaccard-lists")))
    rows = documents_of(blocks)
    # groups of equal sets and of linked sets; every other document is alone
    equal = rows.where("n > 0").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = sets.select("key1", "key2", "node").join(roots, "node").select("key1", "key2", "root")
    grouped = staged(equal.join(named, ["key1", "key2"], "left").where("copies > 1 OR root IS NOT NULL"), "jaccard-classes")
    own = F.struct("key1", "key2")
    by_root = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"), F.min(own).alias("head"))
    head = F.coalesce("head", own)
    classes = grouped.join(by_root, "root", "left").select(
        "key1", "key2", F.coalesce("component", "least").alias("component"), head["key1"].alias("head1"), head["key2"].alias("head2")
    )
    return rows, staged(classes, "jaccard-components")


def _texts(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, and key1, key2, the digest of its set."""
    rows, classes = _classes(_texts(docs))
    found = rows.join(classes.drop("head1", "head2"), ["key1", "key2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "key1", "key2")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for batch in batches:
        keys = [digest(shingles(text)) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], ["rid", "doc_id", "key1", "key2"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which exactly one stays per component.

    That is the row of the smallest doc_id, nulls last, then the first row as staged. Rows without words all stay.
    """
    rows, classes = _classes(_texts(docs))
    ids = staged(rows.join(classes, ["key1", "key2"], "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "jaccard-suspects")
    nulls = ids.where("_id IS NULL").limit(1).count() > 0  # kept out of the joins, where they would be one hot key
    own = docs["doc_id"].cast("long")
    same = own == ids["_id"]  # by its table, as the rows may have a column of that name
    some, rest = docs.join(ids, same, "left_semi"), docs.join(ids, same, "left_anti")
    if nulls:
        some, rest = some.unionAll(docs.where(own.isNull())), rest.where(own.isNotNull())
    # rows whose id is in a component get a number, which belongs to the same row for every later reader
    numbered = staged(some.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[some[c] for c in docs.columns]).alias("row")), "jaccard-suspect-rows")
    keyed = numbered.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    keyed = keyed.mapInArrow(lean(_digests), "rid long, doc_id long, key1 long, key2 long").join(classes, ["key1", "key2"])
    keyed = staged(keyed.select("rid", "doc_id", "head1", "head2"), "jaccard-suspect-keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))["rid"]
    best = keyed.groupBy("head1", "head2").agg(first.alias("rid")).select("rid")
    dropped = staged(keyed.select("rid").join(best, "rid", "left_anti"), "jaccard-dropped")
    return rest.unionAll(numbered.join(dropped, "rid", "left_anti").select("row.*"))
