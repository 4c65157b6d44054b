"""Near-duplicate join on word shingles: a MinHash LSH forest finds candidates, exact sets verify them.

Each text's distinct shingles of five words get TREES labels of DEPTH one-byte minhashes. Sorted by its bits, a tree's
labels are a prefix trie: texts that share the first d minhashes of a label are the texts below one node at depth d.
The join begins at the longest prefix that finds a pair at the threshold with probability FLOOR, in one of the trees,
and shortens the prefix by one minhash at a time. After each round the recall is estimated from the links that were
verified: a pair of similarity s shares a node at depth d with probability p = 1 - (1 - s^d)^TREES, so each link found
stands for 1 / p links. Prefixes are shortened until the estimate reaches the target, or a pair at the threshold
itself would reach it.

Nodes hold candidates, not links. Within a node the signatures are compared first: pairs whose agreement is more than
DEVIATIONS standard deviations below the threshold go (one pair in some hundred thousand at the threshold), so that
texts which are only half alike don't chain into large groups. What remains connects texts to work groups, in which
every pair that no earlier round has seen is verified on the words of its shingles. Nodes and work groups larger than
a block are compared block against block in separate tasks, so no task holds more than two blocks; texts of the same
words are one class, whatever their number. Only sums per class and links to the first class leave a task.

Defined cases: null and empty texts have no shingles, link to nothing and are their own class; repeated rows are
copies of each other; different texts under one doc_id are judged apart, each row for itself; rows without doc_id
take part, but give no class its name while another row can (a class of such rows alone has a null class_id); other
columns are ignored; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _store, _text

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH = 20, 7
#: Recall of a pair at the threshold in the first round, and the recall at which prefixes stop being shortened.
FLOOR, TARGET = 0.995, 0.999
DEVIATIONS = 4.5
#: Documents and bytes of text in a block of a split work group (a block holds at least one document, of any length).
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
#: Signatures in a block of a split node.
NODE_BLOCK = 2048

_SIGNED = "row bigint, doc_id bigint, whole binary, labels array<bigint>, size bigint"


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix with which a pair at the threshold meets in one of the trees with the target probability."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < target:
        d -= 1
    return d


def shingles(words: np.ndarray, doc: np.ndarray, n: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text with their text's number, sorted by it; a short text is one shingle."""
    grams = _text.windows(words, width)
    within = doc[: len(grams)] == doc[width - 1 : width - 1 + len(grams)]
    grams, owner = grams[within], doc[: len(grams)][within]
    size = np.bincount(doc, minlength=n)
    for length in range(1, width):
        short = np.flatnonzero(size == length)
        if len(short):
            begin = (np.cumsum(size) - size)[short]
            code = words[begin]
            for k in range(1, length):
                code = _text.pair(code, words[begin + k])
            grams, owner = np.concatenate([grams, _text.mix(code + np.uint64(length))]), np.concatenate([owner, short])
    return _distinct(grams, owner)


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]) if len(grams) else np.zeros(0, bool)
    return grams[new], owner[new]


def exact_shingles(words: np.ndarray, doc: np.ndarray, n: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), from the numbers of a dictionary of words: equal numbers are the same words in the same order."""
    size = np.bincount(doc, minlength=n)
    begin = np.cumsum(size) - size
    grams, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    base, code, words = 0, words.astype(np.int64), words.astype(np.int64)
    many = int(words.max(initial=0)) + 1
    for length in range(1, width + 1):
        if length > 1:  # numbers of the sequences of so many words
            code = np.unique(code[: len(code) - 1] * many + words[length - 1 :], return_inverse=True)[1].astype(np.int64) if len(code) > 1 else code[:0]
        if length < width:
            start = begin[size == length]
        else:
            start = np.flatnonzero(doc[: len(code)] == doc[width - 1 : width - 1 + len(code)]) if len(code) else np.zeros(0, np.int64)
        grams, owner = np.concatenate([grams, code[start] + base]), np.concatenate([owner, doc[start]])
        base += int(code.max(initial=-1)) + 1
    return _distinct(grams, owner)


def _sign(width: int, trees: int, depth: int):  # noqa: ANN202
    r = np.random.default_rng(61)
    factors = r.integers(1, 2**63, trees * depth, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in _text.chunks(batch.column(2), 1 << 20):
                n = to - at
                row = batch.column(0).slice(at, n)
                first, last, doc = _text.spans(data, bounds, _text.NON_SPACE)
                grams, owner = shingles(_text.hash_spans(data, first, last), doc, n, width)
                full = np.flatnonzero(np.bincount(owner, minlength=n))
                begin = np.searchsorted(owner, full)
                whole = [hashlib.blake2b(b" ".join(data[a:b].tobytes().split()), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for i in np.setdiff1d(np.arange(n), full):  # a text without shingles is its own class
                    whole[i] = b"row" + int(row[int(i)].as_py()).to_bytes(8, "big")
                labels = np.zeros((len(full), trees), np.uint64)
                if len(full):
                    for t in range(trees):
                        for d in range(depth):
                            least = np.minimum.reduceat(grams * factors[t * depth + d] ^ (grams >> np.uint64(31)), begin)
                            labels[:, t] = (labels[:, t] << np.uint64(8)) | (_text.mix(least) >> np.uint64(56))
                sizes = np.zeros(n + 1, np.int32)
                sizes[full + 1] = trees
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(labels.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([row, batch.column(1).slice(at, n), pa.array(whole, pa.binary()), lists, pa.array((bounds[1:] - bounds[:-1]).astype(np.int64))], names=["row", "doc_id", "whole", "labels", "size"])

    return run


def _cells(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], of, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """What of() gives for each run of rows with one key, in batches."""
    now, rows, out = None, [], []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for r in batch.slice(lo, 256).to_pylist():
                own = tuple(r[k] for k in key)
                if own != now:
                    out += of(rows)
                    now, rows = own, []
                rows.append(r)
            if len(out) > 5000:
                yield flush()
    out += of(rows)
    yield flush()


def _sieve(depth: int, threshold: float):  # noqa: ANN202
    """Edges of a node's texts whose signatures agree well enough, enough of them to connect what they connect."""

    def cell(rows: list[dict]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        rep, part = np.array([r["rep"] for r in rows]), np.array([r["part"] for r in rows])
        signs = np.array([r["labels"] for r in rows], np.int64).astype("<i8")
        signs = signs.view(np.uint8).reshape(len(rows), signs.shape[1], 8)[:, :, :depth].reshape(len(rows), -1)
        least = (threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / signs.shape[1])) * signs.shape[1]
        left = np.arange(len(rows))
        todo: list[int] = []
        while len(left):
            if not todo:
                todo, left = [int(left[0])], left[1:]
            i = todo.pop()
            near = (signs[left] == signs[i]).sum(axis=1) >= least
            for j in left[near]:
                if part[i] != part[j]:
                    yield int(rep[i]), int(rep[j])
                todo.append(int(j))
            left = left[~near]

    return lambda batches: _cells(batches, ("tree", "node", "low", "high"), cell, ["a", "b"], [pa.int64()] * 2)


def components(edges: DataFrame) -> DataFrame:
    """node, first: the smallest node of the connected component of each node of edges (a, b).

    Labels spread along edges and jump to the labels of their labels, until none changes.
    """
    both = _store.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _store.written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("first")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("first").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.least("first", "near").alias("reached"), F.col("first").alias("before"))
        jump = labels.select(F.col("node").alias("to"), F.col("first").alias("jump"))
        jumped = _store.written(spread.join(jump, spread["reached"] == jump["to"], "left").select("node", F.least("reached", F.coalesce("jump", "reached")).alias("first"), "before"))
        _store.forget(labels)
        labels = jumped
        if not jumped.where("first < before").limit(1).count():
            _store.forget(both)
            return labels


def _verify(width: int, threshold: float, trees: int, depths: list[int]):  # noqa: ANN202
    """Exact links among texts of different parts: per text how many, the first of its local component and of its copies, and how many each stands for."""

    def pairs(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many shingles each two of n texts share."""
        _, inverse, df = np.unique(grams, return_inverse=True, return_counts=True)
        shared = df[inverse] > 1
        column = (np.cumsum(df > 1) - 1)[inverse[shared]]
        row, out, step = owner[shared], np.zeros((n, n)), 8192
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for lo in range(0, int((df > 1).sum()), step):
            a, b = np.searchsorted(column, [lo, lo + step])
            matrix = np.zeros((n, step), np.float32)
            matrix[row[a:b], column[a:b] - lo] = 1
            out += matrix @ matrix.T
        return out

    def cell(rows: list[dict]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        n, crossed = len(rows), rows[0]["low"] != rows[0]["high"]
        texts = pa.array([r["text"] for r in rows], pa.large_string())
        _, _, data, bounds = next(_text.chunks(texts, 1 << 62))
        doc, words, _ = _text.word_codes(data, bounds, _text.NON_SPACE)
        grams, owner = exact_shingles(words, doc, n, width)
        size = np.bincount(owner, minlength=n)
        common = pairs(grams, owner, n)
        union = size[:, None] + size - common
        part, block = (np.array([r[k] for r in rows]) for k in ("part", "block"))
        linked = (common >= threshold * union - 1e-9) & (part[:, None] != part)
        if crossed:
            linked &= block[:, None] != block
        if not linked.any():
            return
        rep, members = np.array([r["rep"] for r in rows]), np.array([r["members"] for r in rows])
        count, first = linked @ members, rep.copy()
        while True:  # smallest class of each local component
            new = np.minimum(first, np.where(linked, first, np.iinfo(np.int64).max).min(axis=1))
            if (new == first).all():
                break
            first = new
        same = np.where(linked & (common == union), rep, np.iinfo(np.int64).max).min(axis=1)
        likeness = np.where(linked, common / np.maximum(union, 1), 1.0)
        stand = [np.where(linked, 1 / (1 - (1 - likeness**d) ** trees), 0).sum(axis=1) for d in depths]
        partners = linked.sum(axis=1)
        for i in np.flatnonzero(partners):
            yield int(rep[i]), int(count[i]), int(first[i]), int(min(same[i], rep[i])), int(partners[i]), [float(s[i]) for s in stand]

    names = ["rep", "links", "first", "same", "partners", "stand"]
    return lambda batches: _cells(batches, ("work", "low", "high"), cell, names, [pa.int64()] * 5 + [pa.list_(pa.float64())])


_LINKS = "rep bigint, links bigint, first bigint, same bigint, partners bigint, stand array<double>"


def _blocked(rows: DataFrame, blocks: str, key: list[str]) -> DataFrame:
    """rows, of which each block of a group meets each block (also itself) in a cell (key, low, high)."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).drop(blocks)
    return placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _met(classes: DataFrame, parts: DataFrame | None, depth: int, full: int, threshold: float) -> DataFrame:
    """Edges between texts of different parts that share a node at this depth and have signatures that agree."""
    slim = classes.where(F.size("labels") > 0).select("rep", "labels")
    slim = slim.withColumn("part", F.col("rep")) if parts is None else slim.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("first", "rep")).drop("first")
    below = slim.select("rep", "part", F.posexplode("labels").alias("tree", "label")).select("tree", F.shiftrightunsigned("label", 8 * (full - depth)).alias("node"), "rep", "part")
    shared = below.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("tree", "node", F.ceil(F.col("n") / NODE_BLOCK).cast("int").alias("blocks"))
    shared = _store.written(shared)
    own = _store.written(below.join(shared, ["tree", "node"]))
    cells = _blocked(own, "blocks", ["tree", "node"]).join(slim.select("rep", "labels"), "rep").repartition("tree", "node", "low", "high").sortWithinPartitions("tree", "node", "low", "high", "rep")
    edges = _store.written(cells.select("tree", "node", "low", "high", "rep", "part", "labels").mapInArrow(_sieve(full, threshold), "a bigint, b bigint").distinct())
    _store.forget(shared, own)
    return edges


def _joined(docs: DataFrame, row: str, width: int, threshold: float, trees: int, depth: int, floor: float, target: float) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """Of rows with numbers: signed rows, classes of equal words with what was found of them, and the recall estimated at each depth."""
    _store.ship(docs.sparkSession)
    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = _store.written(rows.mapInArrow(_sign(width, trees, depth), _SIGNED))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead")
    classes = _store.written(signed.groupBy("whole").agg(F.min("row").alias("rep"), lead, F.count("*").alias("members"), F.first("labels").alias("labels"), F.first("size").alias("size")))
    depths = list(range(prefix_length(threshold, trees, depth, floor), prefix_length(threshold, trees, depth, target) - 1, -1))
    parts, edges, links, recalls, spent = None, None, None, [], [classes]
    for k, d in enumerate(depths):
        new = _met(classes, parts, d, depth, threshold)
        edges = new if edges is None else edges.unionByName(new)
        before, parts = parts, components(edges)
        spent += [new, parts]
        member = parts.select(F.col("node").alias("rep"), F.col("first").alias("work"))
        member = member.withColumn("part", F.col("rep")) if before is None else member.join(before.select(F.col("node").alias("rep"), F.col("first").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        member = _store.written(member.join(classes.select("rep", "members", "size"), "rep"))
        # Work groups that this round has joined from several parts, in blocks: one is verified with itself, more also with each other.
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.least(F.ceil(F.sum("size") / BLOCK_BYTES), F.count("*")), F.lit(1)).cast("int").alias("blocks")
        groups = _store.written(member.groupBy("work").agg(blocks, F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("work", "blocks"))
        placed = _blocked(member.join(groups, "work"), "blocks", ["work"])
        cells = placed.join(rows.select(F.col("row").alias("rep"), "text"), "rep").repartition("work", "low", "high").sortWithinPartitions("work", "low", "high", "rep")
        found = _store.written(cells.select("work", "low", "high", "rep", "part", "block", "members", "text").mapInArrow(_verify(width, threshold, trees, depths), _LINKS))
        links = found if links is None else links.unionByName(found)
        spent.append(found)
        _store.forget(member, groups)
        seen = links.agg(F.coalesce(F.sum("partners"), F.lit(0)).alias("found"), F.sum(F.col("stand")[k]).alias("stand")).first()
        recalls.append((d, seen["found"] / seen["stand"] if seen["found"] else 0.0))
        if recalls[-1][1] >= target:
            break
    joined = components(links.where("first < rep").select(F.col("rep").alias("a"), F.col("first").alias("b")))
    # Equal sets have equal signatures, so each two of them met and were compared: the least of them needs no chain.
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"), F.min("same").alias("set"))
    ends = classes.select("whole", "rep", "lead", "members").join(counted, "rep", "left").withColumn("set", F.coalesce("set", "rep"))
    ends = ends.join(joined.select(F.col("node").alias("rep"), F.col("first").alias("group")), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    ends = _store.written(ends)
    spent += [joined, ends]
    firsts = lambda name: ends.groupBy(name).agg(F.min("lead").alias(f"{name}_lead"))
    out = _store.written(ends.join(firsts("group"), "group").join(firsts("set"), "set").select("whole", F.col("set_lead.doc_id").alias("copy_id"), F.col("group_lead.doc_id").alias("class_id"), F.col("group_lead.row").alias("keeper"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links")))
    _store.forget(*spent)
    return signed, out, recalls


def join(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, floor: float = FLOOR, target: float = TARGET) -> DataFrame:
    """Per row: doc_id, copy_id (first document with the same shingles), class_id (first document of its component), n_links."""
    rows, row = _store.numbered(docs.select("doc_id", "text"))
    signed, ends, _ = _joined(rows, row, width, threshold, trees, depth, floor, target)
    return signed.select("doc_id", "whole").join(ends, "whole").select("doc_id", "copy_id", "class_id", "n_links")


def keep_first(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each component alone: that of the smallest doc_id (rows without one come last), the first of equal ones."""
    rows, row = _store.numbered(docs)
    signed, ends, _ = _joined(rows, row, width, threshold, TREES, DEPTH, FLOOR, TARGET)
    later = _store.written(signed.select("row", "whole").join(ends, "whole").where(F.col("row") != F.col("keeper")).select(F.col("row").alias(row)))
    _store.forget(signed, ends)
    return rows.join(later, row, "left_anti").select(*docs.columns)
