"""N-gram Jaccard join by parity sketches.

A text's distinct word shingles are hashed to 64 bits and toggle bits of a sketch: shingles that two texts share
cancel out in the exclusive or, so the Hamming distance of two sketches is at most the size of the symmetric
difference. Jaccard >= 3/4 means a difference of at most (a + b) / 7 for sets of a and b shingles. Within a size band
the sketch is cut into parts; two linked texts agree in all parts but that many, so, by the pigeonhole
principle, one of any D + 1 occupied parts of a text is the same in its partner, whatever order ranks the parts, as
long as it is one order for all texts. Parts that many texts of a sample hold come last in that order, which keeps common
passages out of the join; the sample only decides the order, no link depends on it. Texts that share a part are compared
exactly.

Texts with equal shingle sets are one node; the join works on nodes, so copies cost nothing.
Candidates of a part are first compared with one member (a star, not all pairs). In parts whose members are
then still in different components, those outside the part's largest component are compared with all, in tiles, where
short dense sketches reject nearly all pairs before any exact comparison. Parts that are held by more nodes than a task
should take are dealt out by node, keys that many rows share are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import bytesops as B
from .common import bound_resources, join_hot, key_filter, passes, saved, written
from .components import components

SHINGLE = 5
FLAT = 64  # bands of up to so many shingles have a part for every shingle
BAND = 3  # bands grow by powers of 2^BAND
SKETCH_BITS = 512  # at least; a sketch has as many bits as its set has shingles, rounded up to a power of two
FOLD_BITS = 4096  # at most, in the join of whole parts
SAMPLE = 8  # one text in so many decides which parts are common
COMMON = 1 << 20  # so many parts at most are ranked as common: their filter has a fixed size
TILE = 512
HOT_ROWS = 1 << 22  # a part that more nodes hold, by the sample, is dealt out by node
SALTS = 64
GATHER = 1 << 17  # words of sketches compared at once
FITS = 1 << 15  # bytes of a set or sketch that may be broadcast for a hot key
_U = np.uint64
_MULTIPLIERS = B.mix(np.arange(11, 11 + SHINGLE, dtype=_U)) | _U(1)


def shingles(data: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; fewer words are one shingle, none are none."""
    low = B.ascii_lower(data)
    start, end, row = B.words(low, bounds, B.NOT_SPACE)
    words = B.span_hash(B.prefix_hash(low), start, end)
    cut = np.searchsorted(row, np.arange(len(bounds)))
    rolled = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n):
        rolled += words[k : k + len(rolled)] * _MULTIPLIERS[k]
    rolled = B.mix(rolled)
    out = []
    for i in range(len(bounds) - 1):
        size = cut[i + 1] - cut[i]
        if size >= n:
            out.append(np.unique(rolled[cut[i] : cut[i + 1] - n + 1]))
        elif size:
            short = (words[cut[i] : cut[i + 1]] * _MULTIPLIERS[:size]).sum(dtype=_U) + _U(int(size))
            out.append(B.mix(np.array([short ^ _U(0x5DEECE66D)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def node_of(hashes: np.ndarray) -> int:
    """The set's fingerprint; 0 for the empty set."""
    if not len(hashes):
        return 0
    total = B.mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U) + _U(len(hashes))
    return int(B.mix(np.array([total], _U)).view(np.int64)[0]) or 1


def dense_sketch(hashes: np.ndarray) -> bytes:
    size = max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length())
    bits = np.bincount((hashes >> _U(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _half(x: np.ndarray) -> np.ndarray:
    return x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]


def _folded(x: np.ndarray) -> np.ndarray:
    while len(x) > FOLD_BITS // 64:
        x = _half(x)
    return x


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches; a longer one is first folded to the other's length."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line for each text: its node and set size; where a task meets a node first, also its sketches."""
    recent = B.Recent()
    for batch in batches:
        for at, to, data, bounds in B.chunks(batch.column("text")):
            sets = shingles(data, bounds)
            nodes = np.array([node_of(h) for h in sets], np.int64)
            distinct, first = np.unique(nodes, return_index=True)
            new = np.zeros(len(nodes), bool)
            new[first[recent.new(distinct)]] = True
            sketches = [dense_sketch(h) if fresh and len(h) > 2 else None for h, fresh in zip(sets, new, strict=True)]
            folds = [_folded(np.frombuffer(x, _U)).tobytes() if x and 8 * len(x) > FOLD_BITS else x for x in sketches]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), batch.column("h").slice(at, to - at), pa.array(nodes), pa.array([len(h) for h in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array(folds, pa.binary())], ["id", "h", "node", "n", "sketch", "fold"])


def parts(hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """A set's occupied parts as keys, and the difference D to allow for, band by band.

    A band holds sets of [L, L 2^BAND) shingles; a set in its upper quarter may have partners in the next band and has
    parts there too. A key hashes band, part and the part's toggled bits."""
    n = len(hashes)
    band = (n.bit_length() - 1) // BAND
    out = []
    for b in (band, band + 1) if 4 * n >= 3 << (BAND * (band + 1)) else (band,):
        top = (1 << (BAND * (b + 1))) - 1
        if top < FLAT:
            keys = B.mix(hashes + _U(b))
        else:
            place = (hashes >> _U(40)).astype(np.int64) % (top + 1)
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            toggled = np.bitwise_xor.reduceat(B.mix(hashes[order]), first)
            keys = B.mix(toggled + _U(b) + (place[order][first].astype(_U) << _U(32)))
        out.append((keys, (n + min(4 * n // 3, top)) // 7))
    return out


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sets of three shingles or more with their nodes, chunk by chunk; a node that a task met lately is passed over. Fewer
    shingles are only similar enough to an equal set, which is the same node."""
    recent = B.Recent()
    for batch in batches:
        for _at, _to, data, bounds in B.chunks(batch.column("text")):
            sets = [h for h in shingles(data, bounds) if len(h) > 2]
            nodes, first = np.unique(np.array([node_of(h) for h in sets], np.int64), return_index=True)
            new = recent.new(nodes)
            if len(new):
                yield [sets[i] for i in first[new]], nodes[new]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for sets, _ in _fresh(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for h in sets for k, _ in parts(h)]).view(np.int64))], ["key"])


def _emit(common: np.ndarray, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, nodes in _fresh(batches):
            keys, which = [], []
            for i, h in enumerate(sets):
                for k, difference in parts(h):
                    if len(k) > difference + 1:
                        k = k[np.lexsort((k, passes(common, k)))[: difference + 1]]
                    keys.append(k.view(np.int64))
                    which.append(np.full(len(k), i))
            key, which = np.concatenate(keys), np.concatenate(which)
            salt = np.where(np.isin(key, hot), 1 + nodes[which] % SALTS, 0).astype(np.int32)
            sizes = np.array([len(h) for h in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[which]), pa.array(sizes[which]), pa.array(salt)], ["key", "node", "n", "salt"])

    return run


def _common_parts(texts: DataFrame, hot_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A filter of the parts that most sampled texts hold, at most COMMON of them and each held by three or more; and the
    hot parts, which are at most as many as hot_rows goes into all rows of parts."""
    sampled = texts.where(F.col("h") % SAMPLE == 0).mapInArrow(_sampled, "key long")
    counts = saved(sampled.groupBy("key").agg(F.count("*").alias("n")).where("n > 2"))
    total = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    by_count = counts.groupBy("n").agg(F.count("*").alias("keys")).withColumn("total", F.sum("keys").over(total))  # a row for each count
    least = by_count.agg(F.min(F.when(F.col("total") <= COMMON, F.col("n"))).alias("least")).first()["least"] or 1 << 62
    hot = [r["key"] for r in counts.where(F.col("n") * SAMPLE > hot_rows).select("key").collect()]
    return key_filter(counts.where(F.col("n") >= least), "key"), np.array(hot, np.int64)


def _sets(bits: np.ndarray):
    """Sets of the texts whose hash the filter lets through; the others are not even cut into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (batch.filter(pa.array(passes(bits, batch.column("h").to_numpy()))) for batch in batches)
        for sets, nodes in _fresh(wanted):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "hashes"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), _U), np.frombuffer(right[i].as_buffer(), _U)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            keep.append(100 * common >= 75 * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in at most (a + b) / 7 bits; all others differ in more shingles than that."""
    for batch in batches:
        n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        x, y = batch.column("x"), batch.column("y")
        keep = [7 * distance(np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U)) <= n[i] for i in range(batch.num_rows)]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


class Members:
    """Rows of a table of parts: nodes with size, component and folded sketch; sketches are held by length."""

    def __init__(self, table: pa.Table) -> None:
        self.node, self.n, self.comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
        blobs = table.column("fold").to_pylist()
        self.words = np.array([len(x) // 8 for x in blobs], np.int64)
        self.place, self.sketch, self.halved = np.zeros(len(blobs), np.int64), {}, {}
        for size in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == size)
            self.place[rows] = np.arange(len(rows))
            self.sketch[size] = np.frombuffer(b"".join([blobs[i] for i in rows]), _U).reshape(-1, size)
            self.halved[size // 2] = _half(self.sketch[size])

    def plausible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of places (a, b) the pairs of nodes, smaller first, whose components differ and whose sizes and sketches don't
        rule a link out."""
        ok = (self.comp[a] != self.comp[b]) & (4 * np.minimum(self.n[a], self.n[b]) >= 3 * np.maximum(self.n[a], self.n[b]))
        a, b = a[ok], b[ok]
        found = [np.zeros((2, 0), np.int64)]
        for size in self.sketch:
            for other in (size, 2 * size, size // 2):
                some = np.flatnonzero((self.words[a] == size) & (self.words[b] == other))
                for at in range(0, len(some), GATHER // size):
                    i, j = a[some[at : at + GATHER // size]], b[some[at : at + GATHER // size]]
                    x = (self.halved if other < size else self.sketch)[min(size, other)][self.place[i]]
                    y = (self.halved if other > size else self.sketch)[min(size, other)][self.place[j]]
                    near = 7 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= self.n[i] + self.n[j]
                    left, right = self.node[i[near]], self.node[j[near]]
                    found.append(np.stack([np.minimum(left, right), np.maximum(left, right)]))
        return np.concatenate(found, 1)


def _tiles(group: pa.Table) -> pa.Table:
    left = group.column("left").to_numpy()
    rows, lefts, rights = Members(group), np.flatnonzero(left), np.flatnonzero(~left)
    pairs = np.concatenate([np.zeros((2, 0), np.int64)] + [rows.plausible(np.full(len(rights), i), rights) for i in lefts], 1)
    return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node, at most TILE for each key: pairs within each key, by their distance in it. Keys with the
    same members are joined once."""
    rest, recent = None, B.Recent()

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, key = Members(table), table.column("key").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        members, first = np.unique((B.mix(np.add.reduceat(B.mix(rows.node.view(_U)), edge)) | _U(1)).view(np.int64), return_index=True)
        fresh = np.zeros(len(edge), bool)
        fresh[first[recent.new(members)]] = True
        size = np.diff(np.append(edge, len(key)))
        after = np.repeat(edge + size - 1, size) - np.arange(len(key))  # members of the key behind this one
        a, apart, found = np.flatnonzero(np.repeat(fresh, size)), 0, []
        while len(a):
            apart += 1
            a = a[after[a] >= apart]
            found.append(rows.plausible(a, a + apart))
            if not len(a) or sum(x.shape[1] for x in found) > GATHER:
                all_ = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([pa.array(all_[0]), pa.array(all_[1])], ["a", "b"])
                found = []

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = table.slice(cut)
        if cut:
            yield from pairs(table.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from pairs(rest)


def _with(pairs: DataFrame, side: str, table: DataFrame, total: int, fits: str) -> DataFrame:
    """Pairs with the columns of a node's row; a side of the pairs may be the same node in very many of them."""
    uses = pairs.groupBy(side).agg(F.count("*").alias("uses"))
    return join_hot(pairs, table.join(uses, side), side, "uses", total, fits=fits)


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough: sketches rule most others out, then sets are compared."""
    pairs = saved(pairs)
    total = pairs.count()
    first = _with(pairs, "a", nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), total, f"octet_length(x) <= {FITS}")
    both = first.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
    pairs = saved(both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_plausible, "a long, b long"))
    total = pairs.count()
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bits = key_filter(nodes.join(needed, "node", "left_semi"), "h")
    sets = saved(texts.mapInArrow(_sets(bits), "node long, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes")))
    first = _with(pairs, "a", sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), total, f"octet_length(x) <= {FITS}")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return saved(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))


def _still_apart(shared: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes in one part and in different components that sketches don't rule out."""
    named = written(shared.select("key", "node", "n").join(comp, F.col("node") == F.col("id"), "left").select("key", "node", F.col("n").cast("long").alias("n"), F.coalesce("component", "node").alias("comp")))
    per_comp = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    stats = per_comp.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    stats = stats.select("key", "m", F.col("most.comp").alias("major"), (F.col("m") - F.col("most.c")).alias("minors"), F.col("m").alias("rows"))
    mixed = written(join_hot(named, stats, "key", "rows", named.count()).join(nodes.select("node", "fold"), "node"))
    rows = ["key", "node", "n", "comp", "fold"]
    few = mixed.where(F.col("m") <= TILE).select(*rows).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_runs, "a long, b long")
    blocks = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    many = mixed.where(F.col("m") > TILE)
    lefts = many.where("comp <> major").select(place("minors").alias("i"), every("m").alias("j"), F.lit(True).alias("left"), *rows)
    rights = many.select(every("minors").alias("i"), place("m").alias("j"), F.lit(False).alias("left"), *rows)
    tiles = lefts.unionByName(rights).groupBy("key", "i", "j").applyInArrow(_tiles, "a long, b long")
    return few.union(tiles).distinct()


def similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs; ids are integers.

    Null and empty texts have no shingles and are linked with nothing, each a component of its own. Equal
    sets are linked. component_id is the smallest id reachable by links; a row with a null id is grouped like any
    other but never names a component."""
    bound_resources(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    table = written(texts.mapInArrow(_summarise, "id long, h long, node long, n long, sketch binary, fold binary"))
    rows = table.select("id", "node", "n")
    nodes = written(table.where("sketch is not null").groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "h", "sketch", "fold")]))
    texts = texts.select("h", "text")
    tokens = texts.mapInArrow(_emit(*_common_parts(texts, hot_rows)), "key long, node long, n int, salt int")
    by_key, by_size = W.partitionBy("key", "salt"), W.partitionBy("key", "salt").orderBy("n", "node")
    # of rows sorted by size, one that is not near enough in size to the next on either side has no partner
    partner = F.coalesce(4 * F.col("n") >= 3 * F.lead("n").over(by_size), F.lit(False)) | F.coalesce(4 * F.lag("n").over(by_size) >= 3 * F.col("n"), F.lit(False)) | (F.col("salt") > 0)
    partnered = tokens.withColumn("partner", partner).where("partner").drop("partner")
    shared = partnered.withColumn("first", F.min(F.struct("node", "n")).over(by_key)).withColumn("last", F.max("node").over(by_key)).where((F.col("first.node") < F.col("last")) | (F.col("salt") > 0)).select("key", "salt", "node", "n", "first")
    shared = written(shared.distinct())
    if not shared.where("salt > 0").isEmpty():  # the least node of each salt is known: at most SALTS rows for each hot part
        least = shared.where("salt > 0").groupBy("key").agg(F.min("first").alias("least"))
        shared = shared.join(F.broadcast(least), "key", "left").withColumn("first", F.coalesce("least", "first")).drop("least")
    near = (4 * F.least("n", "first.n") >= 3 * F.greatest("n", "first.n")) & (F.col("node") > F.col("first.node"))
    links = _links(shared.where(near).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), nodes, texts)
    comp = components(links)
    pairs = saved(_still_apart(shared, comp, nodes))
    if not pairs.isEmpty():
        links = links.union(_links(pairs, nodes, texts))
        comp = components(links)

    per_node = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    named = saved(per_node.join(comp, F.col("node") == F.col("id"), "left").select("node", "least", "copies", F.coalesce("component", "node").alias("comp")))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    labels = join_hot(named.drop("least"), least, "comp", "nodes", named.count()).select("node", "component_id", "copies")
    full = join_hot(rows.where("n > 0"), labels, "node", "copies", rows.count())
    out = full.select("id", "n", "component_id").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs of documents that share a shingle, compared exactly.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = w.doc_id"""
