"""SimHash near-duplicate groups through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkernel as tk
from tidemark.llm.components import components
from tidemark.runtime import materialize, ship, table

LANES = 4  # 64-bit words of the fingerprint
PLACES = 8 * LANES  # positional bytes
SURE_BITS = 23  # two fingerprints within so many bits share MIN_SHARED positional bytes at least
MIN_SHARED = PLACES - SURE_BITS
VERIFY_BITS = 40  # most differing bits of a link
PAIR_LIMIT = 1 << 26  # distinct fingerprints from which lists are keyed by three bytes instead of two
BLOCK = 16384  # postings of a list from which its pairs are spread over several tasks
_SAMPLE = 64  # one node in so many tells which lists are so long
_CHUNK = 2_000_000  # pairs compared at a time
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) for i in range(LANES)]


def kinds(size: int) -> np.ndarray:
    """The posted choices of `size` places. The places are cut into so few groups that MIN_SHARED
    shared bytes put `size` of them into one group; all choices within a group are posted."""
    groups = np.array_split(np.arange(PLACES), (MIN_SHARED - 1) // (size - 1))
    return np.array([c for g in groups for c in combinations(g.tolist(), size)], np.int64)


def fingerprints(col: pa.Array) -> np.ndarray:
    """A row of LANES 64-bit words for each text: bit by bit the majority over its distinct words,
    a word that occurs n times having 1 + floor(log2 n) votes.

    A text without any word but with other characters counts as one word; rows of nulls and of
    texts with only white space are all zero.
    """
    words = tk.Words(col)
    rows, row = len(words.ptr) - 1, words.row()
    order = np.lexsort((words.hash, row))
    row, word = row[order], words.hash[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(fresh)
    votes = np.frexp(np.diff(np.append(at, len(row))))[1]  # 1 + floor(log2 n)
    row, word = np.repeat(row[at], votes), np.repeat(word[at], votes)
    bare = np.flatnonzero(np.diff(words.ptr) == 0)
    if len(bare):
        lines = tk.group_sums(words.data > 32, words.off[bare], words.off[bare + 1])
        bare = bare[lines > 0]
        whole = tk.span_hashes(words.data, words.off[bare], words.off[bare + 1])
        row, word = np.concatenate([row, bare]), np.concatenate([word, whole])
        order = np.argsort(row, kind="stable")
        row, word = row[order], word[order]
    out = np.zeros((rows, LANES), np.uint64)
    if not len(row):
        return out
    count = np.bincount(row, minlength=rows)
    # byte counters hold up to 255 words: sum runs of at most 255, then the runs of a row
    first = np.cumsum(count) - count
    runs = -(-count // 255)
    run_start = np.repeat(first, runs) + 255 * tk.ranges(np.zeros(rows, np.int64), runs)
    run_first = (np.cumsum(runs) - runs)[count > 0]
    has = np.flatnonzero(count)
    for lane, seed in enumerate(_SEEDS):
        bits = np.unpackbits(tk.mix(word ^ seed).view(np.uint8).reshape(-1, 8), axis=1)
        part = np.add.reduceat(bits.view(np.uint64).ravel().reshape(-1, 8), run_start, axis=0)
        total = np.add.reduceat(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 64).astype(np.int32), run_first, axis=0)
        major = 2 * total > count[has][:, None]
        out[has, lane] = np.packbits(major, axis=1).view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            prints = fingerprints(part.column("text"))
            full = pa.array(prints.any(axis=1))
            lanes = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), *(pa.array(prints[:, i].view(np.int64)) for i in range(LANES))], ["doc_id", "tid", *(f"f{i}" for i in range(LANES))])
            yield lanes.filter(full)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) with the same components as the edges a - b: fewer than nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right, label[left], label[right]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """The top bit of each byte of x that is zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return ~(((x & low) + low) | x | low)


def _links(kind: np.ndarray, f: np.ndarray, i: np.ndarray, j: np.ndarray, posted: np.ndarray) -> np.ndarray:
    """Which pairs (i, j), each met in a list of kind[i], are links that belong to that list: their
    shared positional bytes reach MIN_SHARED, they differ in VERIFY_BITS at most, and no earlier
    kind of list holds both."""
    # in a dense cluster most pairs belong to the first group's lists: all others let them go early
    size = posted.shape[1]
    group = np.array_split(np.arange(PLACES), (MIN_SHARED - 1) // (size - 1))[0]
    first = f[0][i] ^ f[0][j]
    within = np.bitwise_count(_equal_bytes(first) & np.uint64((1 << 8 * len(group)) - 1))
    at = np.flatnonzero((within < size) | (kind[i] < int((posted[:, 0] <= group[-1]).sum())))
    a, b = i[at], j[at]
    at = at[np.bitwise_count(first[at]) + np.bitwise_count(f[1][a] ^ f[1][b]) <= VERIFY_BITS]
    found = []
    for lo in range(0, len(at), _CHUNK // 8):
        part = at[lo : lo + _CHUNK // 8]
        x = np.column_stack([lane[i[part]] ^ lane[j[part]] for lane in f])
        ok = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= VERIFY_BITS
        part, x = part[ok], x[ok]
        same = np.ascontiguousarray(x).view(np.uint8).reshape(-1, PLACES) == 0
        ok = same.sum(axis=1) >= MIN_SHARED  # the tally of shared positional bytes
        part, same = part[ok], same[ok]
        both = same[:, posted[:, 0]]
        for c in range(1, size):
            both = both & same[:, posted[:, c]]
        found.append(part[both.argmax(axis=1) == kind[i[part]]])
    return np.concatenate(found) if found else at[:0]


def _linked(size: int) -> Callable:
    """From whole posting lists: (a, b, 0) that join what their links join, and (a, null, documents
    that a links to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        list_, block, own, node, docs = (whole.column(c).to_numpy() for c in ("list", "block", "own", "node", "docs"))
        order = np.lexsort((own, block, list_))
        list_, block, own, node, docs = list_[order], block[order], own[order], node[order], docs[order]
        f = [np.ascontiguousarray(whole.column(f"f{i}").to_numpy()[order]).view(np.uint64) for i in range(LANES)]
        kind, posted = list_ >> 32, kinds(size)
        n = len(list_)
        new = np.ones(n + 1, bool)
        new[1:-1] = (list_[1:] != list_[:-1]) | (block[1:] != block[:-1])
        edge = np.flatnonzero(new)
        end = np.repeat(edge[1:], np.diff(edge))
        # a block's members pair among themselves; of two blocks, those of the first with all of the second
        half = new.copy()
        half[1:-1] |= own[1:] != own[:-1]
        cut = np.flatnonzero(half)
        half_end = np.repeat(cut[1:], np.diff(cut))
        within = block >> 24 == (block & 0xFFFFFF)
        begin = np.where(within, np.arange(n) + 1, half_end)
        todo = np.cumsum(end - begin)
        at = 0
        left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        degree = np.zeros(n, np.int64)
        while at < n:
            to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + _CHUNK, "right")))
            i = np.repeat(np.arange(at, to), (end - begin)[at:to])
            j = tk.ranges(begin[at:to], (end - begin)[at:to])
            ok = _links(kind, f, i, j, posted)
            i, j = i[ok], j[ok]
            degree += np.bincount(i, docs[j], n).astype(np.int64) + np.bincount(j, docs[i], n).astype(np.int64)
            left, right = np.concatenate([left, node[i]]), np.concatenate([right, node[j]])
            if len(left) > _CHUNK:
                left, right = stars(left, right)
            at = to
        left, right = stars(left, right)
        has = np.flatnonzero(degree)
        who, where = np.unique(node[has], return_inverse=True)
        sums = np.bincount(where, degree[has], len(who)).astype(np.int64) if len(has) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([left, who])), pa.concat_arrays([pa.array(right, pa.int64()), pa.nulls(len(who), pa.int64())]), pa.array(np.concatenate([np.zeros(len(left), np.int64), sums]))],
            ["a", "b", "links"],
        )

    return run


def _postings(nodes: DataFrame, size: int) -> DataFrame:
    """(list, node, docs, f0..) for each posted choice of places; a list is the kind of choice and
    the bytes there."""
    packed = [k << 32 | sum(p << 8 * i for i, p in enumerate(places)) for k, places in enumerate(kinds(size).tolist())]
    each = nodes.withColumn("choice", F.explode(F.array(*map(F.lit, packed))))
    lanes = "array(" + ", ".join(f"f{i}" for i in range(LANES)) + ")"
    place = [f"cast(shiftright(choice, {8 * i}) & 255 as int)" for i in range(size)]
    byte = [f"shiftleft(shiftrightunsigned(get({lanes}, shiftright({p}, 3)), 8 * ({p} & 7)) & 255, {8 * i})" for i, p in enumerate(place)]
    return each.select(F.expr(f"shiftleft(shiftright(choice, 32), 32) | {' | '.join(byte)}").alias("list"), "node", "docs", *(f"f{i}" for i in range(LANES)))


def _spread(postings: DataFrame, nodes: DataFrame, size: int, block: int) -> DataFrame:
    """Postings with the pair of blocks (block) that each is compared in, and its own block (own).

    Most lists are one block. One of more than about `block` postings is cut into several by a hash
    of the node, and every two of its blocks meet in a task of their own, so no task holds a hot list."""
    few = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(_SAMPLE)) == 0)
    counts = _postings(few, size).groupBy("list").agg((F.count("*") * _SAMPLE).alias("n")).filter(F.col("n") > block)
    long = materialize(counts.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "long_lists")
    if long.isEmpty():
        return postings.withColumns({"block": F.lit(0), "own": F.lit(0)})
    cut = postings.join(long, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return other.withColumn("block", F.least("own", "other") * F.lit(1 << 24).cast("long") + F.greatest("own", "other")).drop("other")


def _groups(docs: DataFrame, pair_limit: int, block: int) -> DataFrame:
    """(doc_id, tid, group_id, first, links) for each row of a group: tid is a hash of the text,
    first tells the row that stands for its group."""
    ship(docs.sparkSession)
    lanes = [f"f{i}" for i in range(LANES)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    seen = texts.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(_fingerprint_batches, "doc_id long, tid long, " + ", ".join(f"{c} long" for c in lanes))
    prints = materialize(seen, "fingerprints")
    # equal fingerprints are one node, however many documents have them; repeated rows count once
    distinct = prints.dropDuplicates(["doc_id", "tid"])
    per_print = distinct.groupBy(*lanes).agg(F.min(F.struct("doc_id", "tid")).alias("least"), F.count("*").alias("docs"))
    nodes = materialize(per_print.withColumn("node", F.monotonically_increasing_id()), "nodes")
    size = 2 if nodes.count() <= pair_limit else 3
    slim = nodes.select("node", "docs", *lanes)
    postings = _spread(_postings(slim, size), slim, size, block)
    met = materialize(postings.repartition("list", "block").mapInArrow(_linked(size), "a long, b long, links long"), "links")
    roots = components(met.filter("b is not null").select("a", "b"))
    degree = met.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("near"))
    grouped = nodes.join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = grouped.groupBy("root").agg(F.min("least").alias("head"), F.sum("docs").alias("size")).filter("size > 1").select("root", "head")
    member = grouped.join(classes, "root").select(*lanes, "head", (F.coalesce("near", F.lit(0)) + F.col("docs") - 1).alias("links"))
    out = prints.join(member, lanes)
    first = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("tid") == F.col("head.tid"))
    return out.select("doc_id", "tid", F.col("head.doc_id").alias("group_id"), first.alias("first"), "links")


def near_duplicates(docs: DataFrame, pair_limit: int = PAIR_LIMIT, block: int = BLOCK) -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, group_id, links), a row for each member of a
    group of two documents or more. group_id is the least doc_id of the group; links counts the
    documents that the member is linked to itself, copies with the same fingerprint included.

    Each text gets a SimHash of LANES x 64 bits over its distinct lower-case words. Two fingerprints
    are linked if they share MIN_SHARED of their PLACES positional bytes and differ in VERIFY_BITS
    bits at most; all pairs within SURE_BITS bits share so many. Groups are the connected components.

    The inverted index posts bytes with their places, two at a time out of few groups of places:
    MIN_SHARED shared bytes put two into one group, so every link meets in some list. There the
    shared positional bytes of each pair are tallied, pairs that reach the minimum are kept and the
    whole fingerprints verify them. From pair_limit distinct fingerprints on, lists are keyed by
    three bytes out of fewer groups, with the same links. A list of more than about `block` postings
    is compared block by block, in a task for every two blocks. Tasks return links as edges to the
    least member, fewer than they have nodes, and counts, so a large group isn't written out as pairs.
    Equal fingerprints are one node, so thousands of exact copies cost one posting.

    Null texts and texts of white space only belong to no group; rows with a null doc_id are left
    out. Repeated rows with the same doc_id and text count once; different texts with one doc_id are
    documents of their own, each with its row. Of equal candidates the least doc_id, then the least
    hash of the text leads a group. Texts of any length are fingerprinted whole. Other columns are
    ignored; an empty table gives no rows.
    """
    return _groups(docs, pair_limit, block).groupBy("doc_id", "group_id").agg(F.max("links").alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", spread=True))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that another of their group stands for. Rows are told apart by
    doc_id and text, so a different text with a repeated doc_id is judged by itself."""
    gone = _groups(docs, PAIR_LIMIT, BLOCK).filter("not first").select(F.col("doc_id").alias("gone_doc"), F.col("tid").alias("gone_tid"))
    at = (docs["doc_id"].cast("long") == F.col("gone_doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("gone_tid"))
    return docs.join(gone, at, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
