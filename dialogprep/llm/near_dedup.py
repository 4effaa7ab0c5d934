"""MinHash near-dedup: DartMinHash signatures, banded join, exact check.

Texts are nodes: all documents with the same words in the same order are one.

1. Signatures: ``K`` coordinates per text over its five-word shingles, kept as
   ``BANDS`` band keys of ``ROWS`` coordinates each and a sketch of one byte a
   coordinate.  At similarity 0.8 two texts share a band with probability
   0.99993, about 8 of 24 on average.
2. Banded join: band keys that occur once are dropped by a count.  The others,
   with their sketches, are sorted by key and then by the coordinates that
   follow the band; a range of the sort goes to each task, so one key may span
   tasks.  A task reads a key's texts ``CHUNK`` at a time (chunks overlap),
   compares them by sketch, and emits not the pairs but a spanning forest of
   the closest ones, and between the parts that sure pairs join the few closest
   doubtful pairs of each text: edges in proportion to texts, however large
   the group.
3. Exact check: each distinct edge is kept if the shingle sets (or weights)
   have a similarity of at least ``threshold``.
4. Components of the kept edges: each round joins texts to their smallest
   neighbour, by pointer jumping, and goes on with the edges between the parts
   this makes, until none is left; written to the shared folder each round.
   Each written step lets go of its shuffle files.
5. The rest: steps 2 and 3 only save work.  For band keys whose texts are not
   all in one component, groups of up to ``SMALL`` texts check every pair of
   unlike components, and the texts of larger ones are joined on their rarest
   shingles, which no pair at ``threshold`` escapes and on which a template's
   wording does not fall.  No estimate, cap or chunk decides; then step 4 goes on
   with these edges.

No pair list of a group, set of candidates or component map passes through the
driver.  Hot texts fold into one node before any shuffle of signatures.

Defined results: null text is empty; words are split at ASCII white space after
lower-casing A-Z; texts of fewer than five words are one shingle; empty texts
are one class; a class's id is its least document id (null only if all are);
of repeated rows with the kept id one stays; repeated rows give repeated rows;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import join_small, keep_and_release, rows_of, text_of
from dialogprep.llm.dartminhash import WordHash, mix, shingles, signatures

K = 256
BANDS, ROWS = 24, 5
THRESHOLD = 0.8
MARGIN = 0.07  # about three standard errors of a 256-coordinate estimate
DOUBTFUL = 3  # pairs that a text tries with texts that are not surely in its part
CHUNK = 2048
OVERLAP = 256
MEMBERS_PER_RANGE = 20_000
SMALL = 16  # groups up to this size compare all pairs of unlike roots, larger ones join on rare shingles
BUCKETS = 1 << 17  # of shingle counts; collisions only make the order of rarity less sharp
WIDTH = 1.08  # of a class of set sizes
WORK_PER_BATCH = 400_000  # shingles and darts


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _weighted(words: list[bytes], hashes: WordHash, weights: str) -> tuple[np.ndarray, np.ndarray]:
    element, count = np.unique(shingles(words, hashes), return_counts=True)
    return element, (count if weights == "count" else np.ones(len(element), np.int64))


def _node(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def _sign(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def done(batch, rows, nodes, sets):
            sig = signatures(sets, K)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands * np.uint64(31) + sig[:, i:BANDS * ROWS:ROWS] + np.arange(BANDS, dtype=np.uint64))
            empty = np.array([not len(e) for e, _ in sets], bool)
            keys = [None if e else b for e, b in zip(empty, bands.view(np.int64))]
            sketch = [r.tobytes() for r in (sig >> np.uint64(40)).astype(np.uint8)]
            at = pa.array(rows, pa.int32())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["id", "h", "node", "keys", "sketch"])

        for batch in batches:
            rows, nodes, sets, size = [], [], [], 0
            for k, text in enumerate(batch.column(2)):
                words = _words(text.as_py())
                rows.append(k)
                nodes.append(_node(words))
                sets.append(_weighted(words, hashes, weights))
                size += len(sets[-1][0]) + 8 * K
                if size > WORK_PER_BATCH:
                    yield done(batch, rows, nodes, sets)
                    rows, nodes, sets, size = [], [], [], 0
            if rows:
                yield done(batch, rows, nodes, sets)

    return run


def _forest(sketch: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges among the rows of ``sketch``, at most ``1 + DOUBTFUL`` a row.

    Prim's algorithm gives a spanning forest of largest estimates, one row of
    estimates in memory at a time.  Its parts are what the surely similar pairs
    join.  Between parts, each row also tries its closest doubtful pairs.
    """
    n, low, high = len(sketch), threshold - MARGIN, threshold + MARGIN

    def estimates(i: int) -> np.ndarray:
        same = np.count_nonzero(sketch == sketch[i], axis=1) / sketch.shape[1]
        return (same - 1 / 256) / (1 - 1 / 256)

    best, link = np.full(n, -1.0), np.zeros(n, np.int64)
    part, todo, parts = np.zeros(n, np.int64), np.ones(n, bool), 1
    edges, i = [], 0
    for _ in range(n - 1):
        todo[i], best[i] = False, -2.0
        now = estimates(i)
        better = todo & (now > best)
        best[better], link[better] = now[better], i
        i = int(best.argmax())
        if best[i] >= low:
            edges.append((int(link[i]), i))
        if best[i] >= high:
            part[i] = part[link[i]]
        else:
            part[i] = parts
            parts += 1
    if parts > 1:
        for i in range(n):
            now = np.where(part == part[i], -1.0, estimates(i))
            for j in np.argsort(-now, kind="stable")[:DOUBTFUL]:
                if now[j] < low:
                    break
                edges.append((i, int(j)))
    return edges


def _link(threshold: float):
    """Rows sorted by key: (key, node, sketch) -> edges (a, b), a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sketches, fresh = None, [], [], 0
        out: set[tuple[bytes, bytes]] = set()

        def close():
            if len(nodes) > 1 and fresh:
                table = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), K)
                for i, j in _forest(table, threshold):
                    out.add((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))

        def rows():
            pairs = sorted(out)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

        for batch in batches:
            for k, node, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    close()
                    key, nodes, sketches, fresh = k, [], [], 0
                elif len(nodes) >= CHUNK:
                    close()
                    nodes, sketches, fresh = nodes[-OVERLAP:], sketches[-OVERLAP:], 0
                nodes.append(node)
                sketches.append(sketch)
                fresh += 1
            if len(out) > 100_000:
                yield rows()
                out.clear()
        close()
        yield rows()

    return run


def _sets(weights: str):
    """(node, text) -> (node, elements, counts) if the text is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                nodes, elements, counts = [], [], []
                for node, text in zip(*(c.slice(at, 256) for c in batch.columns)):
                    words = _words(text.as_py())
                    if _node(words) == node.as_py():
                        e, c = _weighted(words, hashes, weights)
                        nodes.append(node.as_py())
                        elements.append(e.tobytes())
                        counts.append(c.astype(np.int32).tobytes() if weights == "count" else None)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (nodes, elements, counts)], names=["node", "elements", "counts"])

    return run


def _similar(threshold: float):
    """(a, b, elements and counts of both) -> edges that pass the exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                ea, ca, eb, cb = (batch.column(c)[k].as_py() for c in range(2, 6))
                ea, eb = np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64)
                _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
                wa = np.frombuffer(ca, np.int32) if ca is not None else np.ones(len(ea), np.int32)
                wb = np.frombuffer(cb, np.int32) if cb is not None else np.ones(len(eb), np.int32)
                both = int(np.minimum(wa[ia], wb[ib]).sum())
                good.append(both + 1e-9 >= threshold * (int(wa.sum()) + int(wb.sum()) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _elements(element: bytes, count: bytes | None) -> np.ndarray:
    """The set's elements; of a multiset, each element once for each time it counts."""
    e = np.frombuffer(element, np.uint64)
    if count is None:
        return e
    c = np.frombuffer(count, np.int32)
    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    return mix(np.repeat(e, c) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (elements % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(elements, counts) -> texts per bucket of shingles."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for e, c in zip(*(c.to_pylist() for c in batch.columns)):
            np.add.at(n, _bucket(_elements(e, c)), 1)
    hit = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["bucket", "n"])


def _size_classes() -> np.ndarray:
    """Least size of each class."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * WIDTH)))
    return np.array(out)


def _rare(threshold: float, common: np.ndarray):
    """(node, root, elements, counts) -> (key, node, root, size, rest): keys that similar texts of unlike roots share.

    Of two sets of ``n`` and ``m`` elements with similarity ``t`` or more, at
    least ``need = t / (1 + t) * (n + m)`` are in both, so in any one order of
    all elements the first ``n - need + 1`` of one meet the first
    ``m - need + 1`` of the other.  The order is by rarity.  A text gives its
    first elements for each class of sizes that its partner may have: with a
    partner of like size and a similarity under ``t``, wording that both have
    from a template is not among them.  ``rest`` counts
    the elements from this one on, for the exact bound on a pair.
    """
    least = _size_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, nodes, roots, sizes, rests = [], [], [], [], []
                for node, root, e, c in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns)):
                    x = _elements(e, c)
                    n = len(x)
                    x = x[np.lexsort((x, common[_bucket(x)]))]
                    low, high = math.ceil(threshold * n - 1e-6), math.floor(n / threshold + 1e-6)
                    own, first, last = (int(np.searchsorted(least, v, "right")) - 1 for v in (n, max(low, 1), high))
                    for q in range(first, last + 1):
                        need = math.ceil(threshold / (1 + threshold) * (n + max(low, int(least[q]))) - 1e-6)
                        some = x[:max(n - need + 1, 0)]
                        keys.append(mix(some + mix(np.array([min(own, q) * 4096 + max(own, q) + 1], np.uint64))).view(np.int64))
                        nodes += [node] * len(some)
                        roots += [root] * len(some)
                        sizes += [n] * len(some)
                        rests += range(n, n - len(some), -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.int64)])), pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(sizes, pa.int32()), pa.array(rests, pa.int32())],
                                                 names=["key", "node", "root", "size", "rest"])

    return run


def _across(rows: DataFrame, also: str = "true") -> DataFrame:
    """(key, node, root, ...) -> pairs ``a < b`` of unlike roots that share a key."""
    a, b = (rows.withColumnsRenamed({c: c + x for c in rows.columns if c != "key"}) for x in "ab")
    pairs = a.join(b, "key").filter(f"nodea < nodeb and roota <> rootb and ({also})")
    return pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, node, root) whose key has several roots, with the number ``n`` of the key's rows."""
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    return rows.join(keys.filter("lo <> hi").select("key", "n"), "key")


def rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of ``sets`` (node, root, elements, counts) with unlike roots that can reach the threshold."""
    common = np.zeros(BUCKETS, np.int64)
    for r in sets.select("elements", "counts").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        common[r["bucket"]] = r["n"]
    rows = keep_and_release(sets.select("node", "root", "elements", "counts").mapInArrow(_rare(threshold, common), "key long, node binary, root binary, size int, rest int"))
    return _across(keep_and_release(_mixed(rows).drop("n")), f"least(resta, restb) + 1e-6 >= {threshold / (1 + threshold)!r}D * (sizea + sizeb)")


def _hooked(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): where the way by least neighbours ends."""
    both = edges.union(edges.select("b", "a")).toDF("node", "near")
    steps = keep_and_release(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
    while True:
        one, two = steps.toDF("n1", "r1"), steps.toDF("n2", "r2")
        jumped = steps.join(one, steps["root"] == one["n1"]).join(two, F.col("r1") == two["n2"])
        jumped = keep_and_release(jumped.select("node", F.col("r1").alias("old"), F.col("r2").alias("root")))
        steps = jumped.select("node", "root")
        if not jumped.filter("root <> old").limit(1).count():
            return steps


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between unlike roots, as edges of the roots; a node without a root is its own."""
    ends = edges.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
    return keep_and_release(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the least node of its component.

    A round joins each node to its least neighbour and goes on with the edges
    between what is joined, so that no round reads the edges of the one before.
    ``known``: a former result, to which ``edges`` are added.
    """
    edges, roots = edges.select("a", "b"), known
    if known is not None:
        edges = _contracted(edges, known)
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        roots = known.select("node", "root").union(ends.join(known, "node", "left_anti").select("node", "node"))
    while True:
        found = _hooked(edges)
        if roots is None:
            roots = found
        else:
            roots = keep_and_release(roots.join(found.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        edges = _contracted(edges, found)
        if not edges.limit(1).count():
            return roots


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """One row per document: ``id, h, root, class_id, class_size`` (``h``: hash of the text)."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    signed = keep_and_release(rows.mapInArrow(_sign(weights), f"id {kind}, h long, node binary, keys array<long>, sketch binary"))
    nodes = signed.groupBy("node").agg(F.min("h").alias("h"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"),
                                       F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = keep_and_release(nodes)

    banded = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = keep_and_release(banded.join(shared, "key", "left_semi"))  # without the sketches, which move once, sorted
    n = max(2, math.ceil(members.count() / MEMBERS_PER_RANGE))
    wide = members.join(nodes.select("node", "sketch"), "node")
    wide = wide.select("key", F.substring("sketch", F.col("band") * ROWS + ROWS + 1, F.lit(16)).alias("next"), "node", "sketch")
    ordered = wide.repartitionByRange(n, "key", "next", "node").sortWithinPartitions("key", "next", "node")
    links = keep_and_release(ordered.select("key", "node", "sketch").mapInArrow(_link(threshold), "a binary, b binary").distinct())

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = rows.select("h", "text").join(wanted.distinct().join(nodes.select("node", "h"), "node"), "h").groupBy("node").agg(F.first("text").alias("text"))
        return keep_and_release(texts.mapInArrow(_sets(weights), "node binary, elements binary, counts binary"))

    def similar(edges: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = edges.join(sets.toDF("a", "ea", "ca"), "a").join(sets.toDF("b", "eb", "cb"), "b").select("a", "b", "ea", "ca", "eb", "cb")
        return pairs.mapInArrow(_similar(threshold), "a binary, b binary")

    def ends(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("a").alias("node")).union(edges.select("b"))

    good = keep_and_release(similar(links, sets_of(ends(links))))
    roots = components(good)

    at = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    at = keep_and_release(_mixed(at))
    few = keep_and_release(_across(at.filter(F.col("n") <= SMALL).select("key", "node", "root")).join(links, ["a", "b"], "left_anti"))
    many = keep_and_release(at.filter(F.col("n") > SMALL).select("node", "root").distinct())
    left = sets_of(ends(few).union(many.select("node")))
    rare = rare_pairs(many.join(left, "node"), threshold).join(links, ["a", "b"], "left_anti")
    more = keep_and_release(similar(few.union(rare).distinct(), left))
    if more.limit(1).count():
        roots = components(more, roots)

    narrow = nodes.select("node", "least", "n")
    linked = keep_and_release(narrow.join(roots, "node"))
    classes = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    # Only linked texts need their class looked up, by a salted key: one class may hold most of them.
    where = join_small(linked.select("node", "root"), classes, "root", F.col("node")).select("node", "root", "class_id", "class_size")
    alone = narrow.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"), F.col("least").alias("class_id"), F.col("n").alias("class_size"))
    return signed.select("id", "h", "node").join(where.unionByName(alone), "node").select("id", "h", "root", "class_id", "class_size")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, all its columns."""
    found = near_classes(docs, id_col, text_col, threshold).filter(F.col("id").eqNullSafe(F.col("class_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("id", "h")).alias("k")).select("k.id", "k.h")
    return rows_of(docs, kept, id_col, F.xxhash64(text_of(docs[text_col])))
