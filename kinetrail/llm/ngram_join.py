"""N-gram Jaccard join by prefix filters under several global token orders.

A document is its set of hashed word shingles. Documents with equal sets are one
class. Under any total order of the tokens, two sets whose Jaccard similarity is
t or more share a token among the first n - ceil(t n) + 1 of each; so they do
under every order. All orders here put frequent tokens last, by their count, and
shuffle the others by a keyed hash. The first order's prefixes make the lists of
documents per token; a candidate pair must also pass the size and position
filters, and must share a prefix token under the other orders before its full
sets are compared.

Only components are asked for, so that a list is worked off in two steps. First
all members are compared with the list's hub, its member with the smallest share
of rare tokens; a group of near copies collapses to one component in a number of
comparisons that grows with its size, not with its square. Then the pairs of
members that are still in different components are compared, whatever their
number: no link between different components can be missed, and there is no cap
on lists, candidates or partners.

Finding the tokens that two documents share moves arrays, not rows: every task
sends its sorted distinct prefix tokens by range of the token, a range answers
each task with those that another document has too, and only these become rows.
A token that many documents of a task hold is sent twice at most.

The order of tokens is free, results don't depend on it: the counts behind it are
sums over all documents of what occurs twice in a batch, and the MOST_FREQUENT
largest of them (8 MB) travel with the tasks.

A class is known by 64 bits of its set's hash, as a token is by 64 bits of its
words' hash.

Defined results: null and empty texts and texts of white space have no shingle
and link with nothing, themselves their component; a null id takes part and is
ignored where the smallest id is taken, null if there is no other; repeated rows
are equal sets, of which one_of_each() keeps one; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, materialise, text_of, with_row_id
from .components import components
from .word_hashes import mix, shingle_set

WORDS = 5
#: Similarity of a link as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
ORDERS = 3
#: A token counts as frequent from here on; at most so many are told apart.
FREQUENT_FROM, MOST_FREQUENT = 8, 500_000
#: Prefix tokens that one range holds, about.
RANGE_TOKENS, LEAST_RANGES = 500_000, 256
#: Ids up to this number are broadcast (16 MB), more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _sets(batch: pa.RecordBatch, column: int, k: int) -> list[np.ndarray]:
    return [shingle_set(np.frombuffer(t.as_buffer(), dtype=np.uint8), k) for t in batch.column(column)]


def frequent_tokens(docs: DataFrame, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in _sets(batch, 0, k) if len(s)]
            if not sets:
                continue
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"]
            )

    counted = docs.select(text_of(docs).alias("text")).mapInArrow(count, "token long, n long")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
    # MOST_FREQUENT rows at most, whatever the input
    found = top.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    tokens, counts = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def prefixes(tokens: np.ndarray, counts: np.ndarray, orders: int = ORDERS) -> list[np.ndarray]:
    """The prefix of a set under each order; the first one in its order."""
    p, out = prefix_length(len(tokens)), []
    rare = np.flatnonzero(counts == 0)
    for i in range(orders):
        key = mix(tokens ^ np.uint64(0xA24BAED4963EE407 * (i + 1) % 2**64))
        if len(rare) >= p:
            few = rare[np.argpartition(key[rare], p - 1)[:p]] if len(rare) > p else rare
            order = few[np.argsort(key[few])]
        else:
            order = np.lexsort((key, counts))[:p]
        out.append(tokens[order])
    return out


def document_table(docs: DataFrame, k: int = WORDS, orders: int = ORDERS) -> DataFrame:
    """A written row per document (with _uid): the task that made it, doc_id, uid, n, the class
    (hash of the set, null without shingles), the share of rare tokens, the
    first order's prefix and those of the others; prefixes are left out where
    the task had a document of the class before."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(frequent_tokens(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = told.value
        part, known = TaskContext.get().partitionId(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = {c: [] for c in ("n", "node", "rare", "prefix", "filters")}
                for tokens in _sets(batch, 1, k):
                    n = len(tokens)
                    node = class_of(tokens)
                    new = n > 0 and node not in known
                    known.add(node)
                    out["n"].append(n)
                    out["node"].append(node)
                    out["rare"].append(0)
                    out["prefix"].append(None)
                    out["filters"].append(None)
                    if not new:
                        continue
                    counts = np.zeros(n, dtype=np.int64)
                    if len(frequent):
                        near = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                        counts = np.where(frequent[near] == tokens, times[near], 0)
                    first, *others = prefixes(tokens, counts, orders)
                    out["rare"][-1] = int(1_000_000 * (counts == 0).mean())
                    out["prefix"][-1] = first.tobytes()
                    out["filters"][-1] = [np.sort((x >> np.uint64(32)).astype("<u4")).tobytes() for x in others]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array([part] * batch.num_rows, type=pa.int32()),
                        pa.array(out["n"], type=pa.int64()),
                        pa.array(out["node"], type=pa.int64()),
                        pa.array(out["rare"], type=pa.int64()),
                        pa.array(out["prefix"], type=pa.binary()),
                        pa.array(out["filters"], type=pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "uid", "part", "n", "node", "rare", "prefix", "filters"],
                )

    schema = "doc_id long, uid long, part int, n long, node long, rare long, prefix binary, filters array<binary>"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), "_uid").mapInArrow(run, schema)
    return materialise(rows, "ngram-documents")


def class_of(tokens: np.ndarray) -> int | None:
    """The class of a set; null for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))) if len(tokens) else None


def _sizes_fit(a: str, b: str) -> str:
    return f"least({a}.n, {b}.n) * {DENOMINATOR} >= greatest({a}.n, {b}.n) * {NUMERATOR}"


def _positions_fit(a: str, b: str) -> str:
    """The tokens from the shared one on must suffice for the overlap
    t / (1 + t) * (n_a + n_b); the first shared token of a linked pair passes."""
    return f"least({a}.n - {a}.pos, {b}.n - {b}.pos) * {NUMERATOR + DENOMINATOR} >= ({a}.n + {b}.n) * {NUMERATOR}"


def shared_postings(documents: DataFrame) -> DataFrame:
    """(token, node, n, rare, pos) of the prefix tokens that two documents hold."""
    holding = documents.filter("prefix is not null")
    total = holding.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-int(total) // RANGE_TOKENS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy()
            out = ([], [], [])
            for part in np.unique(parts):
                rows = np.flatnonzero(parts == part)
                tokens = np.sort(np.concatenate([np.frombuffer(batch.column(1)[int(i)].as_buffer(), "<u8") for i in rows]))
                # of equal tokens two stay: enough to tell that they are shared
                keep = np.ones(len(tokens), dtype=bool)
                keep[2:] = tokens[2:] != tokens[:-2]
                tokens = tokens[keep]
                lane = (tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                starts = np.searchsorted(lane, np.arange(ranges + 1, dtype=np.uint64))
                for r in np.flatnonzero(np.diff(starts)):
                    out[0].append(int(r))
                    out[1].append(int(part))
                    out[2].append(tokens[starts[r] : starts[r + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], type=pa.int32()), pa.array(out[1], type=pa.int32()), pa.array(out[2], type=pa.binary())],
                names=["range", "part", "tokens"],
            )

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(t, "<u8") for t in frame["tokens"]]
        tokens, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = tokens[counts >= 2]
        rows = []
        for part, own in zip(frame["part"], lists, strict=True):
            both = np.intersect1d(own, shared)
            if len(both):
                rows.append((part, both.tobytes()))
        return pd.DataFrame(rows, columns=["part", "tokens"])

    answers = (
        holding.select("part", "prefix")
        .mapInArrow(deal, "range int, part int, tokens binary")
        .groupBy("range")
        .applyInPandas(answer, "part int, tokens binary")
    )

    def place(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["token", "node", "n", "rare", "pos"]
        if not len(docs) or not len(told):
            return pd.DataFrame(columns=columns, dtype=np.int64)
        shared = np.unique(np.concatenate([np.frombuffer(t, "<u8") for t in told["tokens"]]))
        lists = [np.frombuffer(p, "<u8") for p in docs["prefix"]]
        sizes = np.array([len(x) for x in lists])
        tokens, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = shared[np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)] == tokens
        facts = {c: docs[c].to_numpy(np.int64)[row[hit]] for c in ("node", "n", "rare")}
        return pd.DataFrame({"token": tokens[hit].view(np.int64), **facts, "pos": pos[hit]})[columns]

    # the documents of one task and what it asked for: as large as an input split
    return (
        holding.select("part", "node", "n", "rare", "prefix")
        .groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInPandas(place, "token long, node long, n long, rare long, pos long")
    )


def token_lists(documents: DataFrame) -> DataFrame:
    """(token, node, n, pos, hub, hub_n, hub_pos) of the tokens of two classes or
    more; hub is the member with the smallest share of rare tokens."""
    postings = materialise(shared_postings(documents), "shared-postings")
    hubs = (
        postings.groupBy("token")
        .agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(F.struct("rare", "node", "n", "pos")).alias("hub"))
        .filter("lo < hi")
        .select(dealt_anew("token"), F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    )
    # the hub side has one row per token: AQE splits the list of a hot token
    return postings.drop("rare").join(hubs, "token")


def _share_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, filters of u, filters of v) that share a token under each of
    the other orders."""
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            blobs = zip(a.as_py(), b.as_py(), strict=True)
            if all(len(np.intersect1d(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))) for x, y in blobs):
                keep.append(i)
        index = pa.array(keep, type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index)], names=["u", "v"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common * DENOMINATOR >= NUMERATOR * (len(x) + len(y) - common):
                keep.append(i)
        index = pa.array(keep, type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index)], names=["u", "v"])


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column is in the written table ids (one column); the ids
    are broadcast up to BROADCAST_ROWS, so that df stays where it is."""
    wanted = ids.toDF("_wanted")
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_ROWS else wanted
    return df.join(wanted, df[column].eqNullSafe(F.col("_wanted")), "left_semi")


def _nodes(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.select("u").union(pairs.select("v")).distinct(), "nodes")


def _with_both(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    left = facts.select(F.col("node").alias("u"), F.col(column).alias("a"))
    right = facts.select(F.col("node").alias("v"), F.col(column).alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")


def verified(pairs: DataFrame, documents: DataFrame, docs: DataFrame, k: int = WORDS) -> DataFrame:
    """Of distinct candidate pairs (u, v) those that are linked.

    First the other orders' prefixes decide; the full sets are made again from
    the texts of the documents that are left, instead of being kept for all.
    """
    pairs = materialise(pairs, "pairs")
    facts = _only(documents.filter("filters is not null").select("node", "filters"), "node", _nodes(pairs))
    facts = materialise(facts.dropDuplicates(["node"]), "filters")
    left = materialise(_with_both(pairs, facts, "filters").mapInArrow(_share_prefixes, "u long, v long"), "candidates")
    needed = _only(documents.select("node", "doc_id"), "node", _nodes(left)).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    needed = materialise(needed, "needed")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    texts = _only(texts, "doc_id", needed.select("doc_id").distinct())

    def remake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                sets = _sets(whole.slice(at, 512), 0, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())],
                    names=["node", "tokens"],
                )

    sets = texts.select("text").mapInArrow(remake, "node long, tokens binary")
    sets = materialise(sets.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    return _with_both(left, sets, "tokens").mapInArrow(_compare, "u long, v long")


def _components_of_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, uid, n, component (null without shingles), component_id, class_id
    of docs with _uid."""
    documents = document_table(docs, k)
    lists = materialise(token_lists(documents), "token-lists")
    near_hub = (
        lists.selectExpr("struct(node, n, pos) as a", "struct(hub as node, hub_n as n, hub_pos as pos) as b")
        .filter("a.node <> b.node")
        .filter(_sizes_fit("a", "b"))
        .filter(_positions_fit("a", "b"))
        .selectExpr("least(a.node, b.node) as u", "greatest(a.node, b.node) as v")
        .distinct()
    )
    links = materialise(verified(near_hub, documents, docs, k), "links")
    first = materialise(components(links), "hub-components")

    # what is left of the lists: members outside the hub's component, against all members
    placed = lists.join(first, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    hub_comp = first.select(F.col("node").alias("hub"), F.col("component").alias("hub_comp"))
    placed = placed.join(hub_comp, "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
    placed = materialise(placed.select("token", "node", "n", "pos", "comp", "hub_comp"), "placed-lists")
    outside = placed.filter("comp <> hub_comp").alias("a")
    # two outsiders meet once, an outsider and a member of the hub's component from the outsider's side
    cross = (
        outside.join(
            placed.alias("b"),
            F.expr(
                "a.token = b.token and a.comp <> b.comp and (b.comp = b.hub_comp or a.node < b.node) and "
                f"{_sizes_fit('a', 'b')} and {_positions_fit('a', 'b')}"
            ),
        )
        .selectExpr("least(a.node, b.node) as u", "greatest(a.node, b.node) as v")
        .distinct()
    )
    more = verified(cross, documents, docs, k)
    everything = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    classes = documents.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    whole = classes.join(everything, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = materialise(whole, "class-components")
    smallest = whole.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = whole.join(smallest, "component").select("node", "component", "class_id", "component_id")
    # one row per class on the right: AQE splits the partition of a hot class on the left
    return documents.select("doc_id", "uid", "n", "node").join(named, "node", "left").select(
        "doc_id",
        "uid",
        "n",
        "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def jaccard_components(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id, the smallest doc_id with
    the same set: one row per document."""
    rows = docs.select("doc_id", "text").withColumn("_uid", F.lit(0).cast("long"))
    return _components_of_rows(rows, k).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def one_of_each(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """One row of each group, of those with the smallest id, and every row that
    links with nothing; all columns stay."""
    own = with_row_id(docs)
    rows = _components_of_rows(own.select("doc_id", "text", "_uid"), k)
    firsts = rows.filter((F.col("n") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    # the partial aggregate leaves a row per task of a hot group
    firsts = firsts.groupBy("component", "doc_id").agg(F.min("uid").alias("uid")).select("doc_id", "uid")
    kept = firsts.unionByName(rows.filter("n = 0").select("doc_id", "uid")).toDF("__id", "__uid")
    same = own["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (own["_uid"] == kept["__uid"])
    return own.join(kept, same, "left_semi").select([own[c] for c in docs.columns])
