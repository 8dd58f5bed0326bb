"""Near-duplicate documents: MinHash with tensored banding, exact confirmation, connected components.

A document's set is its distinct five-word shingles (64-bit hashes); documents of equal sets form one class, and only
classes are compared. Two small collections of ``m`` bands with ``r`` minhashes each are computed; a table key joins band
i of the first collection with band j of the second, so ``m * m`` tables of ``2 r`` minhashes cost ``2 m r`` minhashes instead
of ``2 m m r``. With r = 3 and m = 16 a pair of similarity 0.75 meets in some table with probability
``(1 - (1 - 0.75**3)**16)**2``, over 0.9996, and one of 0.8 with over 0.9999.

A bucket of at most ``DIRECT`` members compares them with each other, those of fitting size. A larger bucket never emits its
pairs. Larger buckets are merged by the half of their key from the first collection, so a node has at most ``m`` rows there and
not one for each table; merged buckets that share members form a group (one more run of :func:`connected`), which holds every
pair that meets in a large bucket. A group of more than ``GROUP`` members is left in its merged buckets instead, each a group. A group has a hub, the member of most merged buckets, and every member is compared with
it on full sets. That settles the bulk of near copies. Groups that still hold several components are settled in blocks of about
``BLOCK`` members: each pair of blocks is one small task that counts all overlaps at once and returns a spanning set of links,
and pairs of blocks of one component are left out. So every pair that meets in some table is settled on full sets, whatever
its bucket's size, in two steps of comparing; rows that are moved grow with a group's members times its blocks outside the main component.

Defined results: null or empty texts, and texts without words, have empty sets, link with nothing and form a component of
their own; rows of one id and equal text are one class; rows of one id and different texts stay different nodes; a
component's id is its smallest id that isn't null (null if all are null); extra columns are kept by :func:`deduplicate`
and ignored by :func:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, pieces, table, texts_of

WORDS = 5
BANDS = 16  # m
ROWS = 3  # r
DIRECT = 16  # members of a bucket that are compared with each other
GROUP = 1 << 16  # members of large buckets that are settled together
BLOCK = 256  # members of a block
_COLUMNS = 4096  # shingles whose overlaps are counted at a time
_LOW = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode().translate(_LOW).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, WORDS)
    x = h[: n - size + 1].copy()
    for k in range(1, size):
        x = x * _STEP + h[k : n - size + 1 + k]
    return np.unique(_mix(x + np.uint64(size)))


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=75))
    return rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def half_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each non-empty set the keys of ``2 * bands`` bands, the first collection's before the second's."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    a, b = _hash_family(2 * bands * rows)
    out = np.zeros((len(sets), 2 * bands), np.uint64)
    for k in range(2 * bands):
        key = np.full(len(sets), k + 1, np.uint64)
        for j in range(rows):
            low = np.minimum.reduceat(flat * a[k * rows + j] + b[k * rows + j], starts)
            key = _mix(key * _STEP + low)
        out[:, k] = key
    return out


def _text_key() -> Column:
    """A digest of the text as it stands; with the id it tells rows apart, but for those that repeat both."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null for empty sets), keys and text_key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text", 2 << 20):
            sets = [shingles(t) for t in texts_of(rb, "text")]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for k, row in zip(full, half_keys([sets[k] for k in full]).view(np.int64), strict=True):
                    keys[k] = row
            node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), rb.column("text_key")],
                ["doc_id", "n_shingles", "node", "keys", "text_key"],
            )

    wanted = docs.select("doc_id", "text", _text_key().alias("text_key"))
    return wanted.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node binary, keys array<long>, text_key binary")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted shingles, for ``nodes`` (node, rep: an id that has the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text", 2 << 20):
            sets = [shingles(t) for t in texts_of(rb, "text")]
            flat = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in flat], pa.binary()), pa.array(flat, pa.binary())], ["node", "set"])

    wanted = nodes.select("rep").distinct()
    made = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(run, "node binary, set binary")
    return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (node, hub), on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "set", 4 << 20):
            on = []
            for x, h in zip(rb.column("set").to_pylist(), rb.column("hub_set").to_pylist(), strict=True):
                x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
                both = int(np.count_nonzero(h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x))
                on.append(100 * both >= 75 * (len(x) + len(h) - both))
            yield rb.select(["node", "hub"]).filter(pa.array(on, pa.bool_()))

    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set")), "hub")
    return both.select("node", "hub", "set", "hub_set").mapInArrow(run, "node binary, hub binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    sizes = [len(s) for s in (*left, *right)]
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, column, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    of, column = of[shared], column[shared]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    column = np.cumsum(np.r_[0, np.diff(column) > 0]) if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + _COLUMNS])
        held = np.zeros((len(sizes), _COLUMNS), np.float32)
        held[of[lo:hi], column[lo:hi] - start] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def _settled(rows: pa.Table) -> pa.Table:
    """A spanning set of the links (node, hub) between components, of one pair of blocks (node, label, first, second, set)."""
    node, label = rows.column("node").to_pylist(), rows.column("label").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
    first, second = (np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    size = np.array([len(s) for s in sets])
    both = overlaps([sets[k] for k in first], [sets[k] for k in second])
    number = {x: k for k, x in enumerate(dict.fromkeys(label))}
    part = np.array([number[x] for x in label])
    linked = (100 * both >= 75 * (size[first][:, None] + size[second][None, :] - both)) & (part[first][:, None] != part[second][None, :])
    root = list(range(len(number)))
    out: tuple[list, list] = [], []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = part[first[i]], part[second[j]]
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out[0].append(node[first[i]])
            out[1].append(node[second[j]])
    return pa.table({"node": pa.array(out[0], pa.binary()), "hub": pa.array(out[1], pa.binary())})


def _between(groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, hub) links between components inside ``groups`` (group, node), block by block; the tasks' links span what they join."""
    held = materialise(groups.join(labels, "node"), "neardup-held")
    parts = materialise(held.groupBy("group", "label").agg(F.count("*").alias("k")), "neardup-parts")
    open_ = parts.groupBy("group").agg(F.count("*").alias("parts")).where("parts > 1").select("group")
    # A component of at least a block has blocks of its own; the others share blocks.
    own = F.when(F.col("k") >= BLOCK, F.col("label")).otherwise(F.lit(b""))
    parts = materialise(parts.join(open_, "group").select("group", "label", own.alias("own"), "k"), "neardup-open")
    pools = materialise(parts.groupBy("group", "own").agg(F.ceil(F.sum("k") / BLOCK).alias("blocks")), "neardup-pools")
    # Written, so that both sides of the join are plain exchanges and a hot component can be split.
    place = materialise(parts.join(pools, ["group", "own"]).select("group", "label", "own", "blocks"), "neardup-places")
    block = F.struct("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("i"))
    placed = materialise(held.join(place, ["group", "label"]).select("group", "node", "label", block.alias("block")), "neardup-placed")
    blocks = pools.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), "own").select("group", F.struct("own", "i").alias("block"))
    a, b = blocks.withColumnRenamed("block", "p"), blocks.withColumnRenamed("block", "q")
    mixed = (F.col("p.own") != F.col("q.own")) | (F.col("p.own") == F.lit(b""))
    pairs = materialise(a.join(b, "group").where((F.col("p") <= F.col("q")) & mixed), "neardup-block-pairs")
    sides = pairs.select("group", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    rows = sides.join(placed, ["group", "block"]).select("group", "p", "q", "node", "label", (F.col("block") == F.col("p")).alias("first"), (F.col("block") == F.col("q")).alias("second"))
    return rows.join(sets, "node").groupBy("group", "p", "q").applyInArrow(_settled, "node binary, hub binary")


def connected(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, of all nodes in ``links`` (node, hub).

    Each node takes its smallest neighbour's smallest neighbour as label, and links are contracted to those between labels. At
    least half of the nodes go each time, and all but one of a clique or star.
    """
    edges, labels = materialise(links.select("node", "hub"), "neardup-edges"), None
    while True:
        near = edges.union(edges.select("hub", "node")).groupBy("node").agg(F.least(F.col("node"), F.min("hub")).alias("label"))
        near = materialise(near, "neardup-near")
        over = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialise(near.join(over, "label").select("node", F.col("next").alias("label")), "neardup-labels")
        of = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        rest = edges.join(of("node"), "node").join(of("hub"), "hub").where("node_label <> hub_label")
        rest = materialise(rest.select(F.col("node_label").alias("node"), F.col("hub_label").alias("hub")).distinct(), "neardup-rest")
        if labels is None:
            labels = step
        else:
            before, labels = labels, materialise(_moved(labels, step), "neardup-labels")
            discard(before, step)
        discard(near, edges)
        if not rest.limit(1).count():
            return labels
        edges = rest


def _moved(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` (node, label) with labels replaced by their own label in ``moved``, if they have one."""
    return labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (of all nodes that were ever compared) after more links; only links between components are looked at."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    between = links.join(of("node"), "node").join(of("hub"), "hub").where("node_label <> hub_label")
    between = materialise(between.select(F.col("node_label").alias("node"), F.col("hub_label").alias("hub")).distinct(), "neardup-between")
    if not between.limit(1).count():
        return labels
    moved = connected(between)
    out = materialise(_moved(labels, moved), "neardup-labels")
    discard(labels, between, moved)
    return out


def _direct(few: DataFrame) -> DataFrame:
    """(node, hub) of the pairs of fitting size in the buckets of ``few`` (key, node, n), all of at most ``DIRECT`` members."""
    sets = few.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("n", "node"))).alias("all"))
    pairs = sets.select("all").distinct()  # the tables that have the same nodes in a bucket
    pairs = pairs.select("all", F.explode("all").alias("x"))
    pairs = pairs.select("x", F.explode(F.filter("all", lambda y: (y < F.col("x")) & (y.n * 4 >= F.col("x.n") * 3))).alias("y"))
    return pairs.select(F.col("x.node").alias("node"), F.col("y.node").alias("hub"))


def _large(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, node) and (node, hub) of the merged buckets' ``members`` (key, node)."""
    members = materialise(members.select("node", "key"), "neardup-large")
    first = members.groupBy("key").agg(F.min("node").alias("hub"))
    links = materialise(members.join(first, "key").select("node", "hub", "key"), "neardup-large-links")
    family = materialise(connected(links.select("node", "hub").distinct()), "neardup-families") if links.limit(1).count() else links.select("node", F.col("node").alias("label"))
    often = links.groupBy("node").agg(F.count("*").alias("often")).join(family, "node")
    size = often.groupBy("label").agg(F.count("*").alias("size"))
    sized = materialise(often.join(size, "label").select("node", "label", "often", "size"), "neardup-sized")
    whole = sized.where(F.col("size") <= GROUP).select(F.col("label").alias("group"), "node", "often")
    parts = links.join(sized.where(F.col("size") > GROUP).select("node", "often"), "node").select(F.col("key").cast("string").cast("binary").alias("group"), "node", "often")
    groups = materialise(whole.union(parts.distinct()), "neardup-groups")
    hubs = groups.groupBy("group").agg(F.max(F.struct("often", "node")).alias("most")).select("group", F.col("most.node").alias("hub"))
    stars = groups.join(hubs, "group").where("node <> hub").select("node", "hub")
    return groups.select("group", "node"), stars


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches, and node, rep, first (the node's row of the smallest id, nulls last: none, doc_id, text_key) and label of each node."""
    rows = materialise(sketches(docs), "neardup-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = materialise(
        rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), first.alias("first")), "neardup-nodes"
    )
    # Bands that a single node has can't be half of a shared table key.
    halves = nodes.select("node", "n", F.posexplode("keys").alias("band", "half"))
    shared = materialise(halves.groupBy("half").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("half"), "neardup-halves")
    held = halves.join(shared, "half").groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("band") < BANDS, F.col("half"))).alias("first"), F.collect_list(F.when(F.col("band") >= BANDS, F.col("half"))).alias("second")
    )
    held = materialise(held, "neardup-shared-halves")
    starts = held.select("node", "n", F.explode("first").alias("a"), "second")
    members = starts.select("node", "n", "a", F.explode("second").alias("b")).select("node", "n", "a", F.xxhash64("a", "b").alias("key"))
    members = materialise(members, "neardup-members")
    buckets = members.groupBy("key", "a").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("k")).where("first <> last")
    buckets = materialise(buckets.select("key", "a", "k"), "neardup-buckets")
    large = buckets.where(F.col("k") > DIRECT).select("a").distinct()
    groups, stars = _large(starts.where(F.size("second") > 0).select("node", "a").join(large, "a").select("node", F.col("a").alias("key")))
    pairs = _direct(members.join(buckets.where(F.col("k") <= DIRECT).select("key", "a"), ["key", "a"]).drop("a"))
    pairs = materialise(pairs.union(stars).distinct(), "neardup-pairs")
    discard(shared, held, members, buckets)
    met = pairs.select("node").union(pairs.select("hub")).distinct()
    met = materialise(nodes.join(met, "node", "left_semi").select("node", "rep"), "neardup-met")
    sets = materialise(_sets(docs, met), "neardup-sets")
    links = materialise(_compare(pairs, sets), "neardup-links")
    labels = materialise(_merged(met.select("node", F.col("node").alias("label")), links), "neardup-labels")
    discard(pairs)
    if groups.limit(1).count():
        labels = _merged(labels, materialise(_between(groups, labels, sets), "neardup-block-links"))
    discard(sets)
    return rows, nodes.select("node", "rep", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, labelled = _labelled(docs)
    least = materialise(labelled.groupBy("label").agg(F.min("rep").alias("component_id")), "neardup-least")
    of_node = materialise(labelled.join(least, "label").select("node", "component_id"), "neardup-components")
    own = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = rows.where("node is not null").select("doc_id", "n_shingles", "node").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return full.union(own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component: a row of its smallest id that isn't null, if it has one; columns as they were.

    Rows are found again by id and text, never by the id alone, so texts that share an id, or have none, are judged each by
    its own component. Of rows that repeat id and text one stays. Rows without words are components of their own and all stay.
    """
    rows, labelled = _labelled(docs)
    firsts = labelled.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    copies = rows.where("node is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("__copies"))
    kept = materialise(firsts.join(copies, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key"))).select("__id", "__key", "__copies"), "neardup-kept")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = docs.where(words).withColumn("__text_key", _text_key()).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")))
    once = out.where("__copies = 1").select(*docs.columns)
    repeated = out.where("__copies > 1").dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns)
    return once.union(repeated).union(docs.where(~words))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLE_SQL = {
    "op6_near_duplicates": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') sh from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
r(doc_id, c) as (select doc_id, doc_id from documents union select l.y, r.c from r join l on l.x = r.doc_id),
m as (select doc_id, min(c) component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, component_id, d.doc_id = component_id kept from documents d join m using (doc_id) left join n using (doc_id)
"""
}
