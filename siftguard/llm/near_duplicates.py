"""Near-duplicate detection with SetSketch registers: band, estimate jointly, verify, connect.

*Sketch.* A document is the set of its distinct five-word shingles (fewer words: one shingle of
all). A register is a truncated minimum on an exponential scale, ``floor(1 - log_b x)`` of the
smallest of exponentially distributed hashes, kept in two bytes. Minima merge, so the sketch
of a union is the register-wise maximum (``merged``).

*Classes.* Documents with equal sets form one class, found by a 128-bit digest of the set; only
the class with its smallest doc_id goes on. Copies never meet in pairs.

*Bands.* Four neighbouring registers are a band. Two sets of similarity 0.75 miss each other in
all 64 bands with a probability below 1e-11.

*Leaders.* Only connectivity is wanted. In each bucket the member with the most company leads and
is compared with every other member; linked classes become components. A bucket whose
members lie in one component is done.

*Stragglers.* What is left are members that a leader c does not link. Common shingles of such a
member and another one lie in c or outside it; those inside are at most the smaller overlap
with c, which is known. So either that is enough by itself, which takes a partner smaller than
c, or the two share shingles outside c, at least as many as are lacking. Pairs are made by
these two tests only, the second as a join on the rarest of the shared shingles. Nothing is
capped.

*Estimate.* The similarity of a straggler's pair is estimated from both sketches by maximum
likelihood, with the exact set sizes; the pair goes on unless the estimate is more than six
standard errors below the threshold. (A leader's pairs need no estimate: their overlap is wanted anyway,
and there is one per member and leader.)

*Verify.* The full sets of both texts decide: 100 * intersection >= 75 * union.

Texts travel compressed, and only those of pairs that are to be verified. A leader with many
partners is salted by their total size.

Defined cases: null and empty texts and texts without words have size 0 and link with nothing;
rows that share a doc_id are one document to the links; a null doc_id is carried through
with its size, takes no part in links and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftguard.llm.common import dropped, packed, pieces, release, saved, ship, table, tidied, unpacked
from siftguard.llm.words import SPACED_FOLDED, Runs, mix, signed, tokenize

SHINGLE, PERCENT = 5, 75
REGISTERS, BAND = 256, 4
#: Base of the register scale. So close to one, registers of unrelated sets rarely agree (1 in 4000),
#: and buckets do not fill up as the corpus grows.
SCALE = 1.001
#: Register value of a minimum of one; keeps sets of one shingle above zero in two bytes.
OFFSET = 8000
#: Standard errors an estimate may lie below the threshold.
ERRORS = 6
#: Shingles of partners that one task verifies against one leader.
SALT_SHINGLES = 400_000
#: Ids that may be broadcast to select texts (4 MB); more of them are joined by shuffle.
BROADCAST_IDS = 250_000

_RNG = np.random.default_rng(7)
_FACTORS = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SALTS = _RNG.integers(0, 2**63, 4, dtype=np.uint64)


def shingles(words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    counts = words.counts
    runs = Runs(words.hashes)
    whole = runs.all_of(SHINGLE)
    start = np.flatnonzero(np.arange(len(whole)) + SHINGLE <= words.text_end()[:len(whole)])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    code = np.concatenate([whole[start], runs.of(words.bounds[short], words.bounds[short + 1])])
    row = np.concatenate([np.searchsorted(words.bounds, start, "right") - 1, short])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(counts) + 1))


def registers(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of registers per text that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), REGISTERS), np.uint16)
    if not len(starts):
        return out
    bases = [(mix(code ^ s) >> np.uint64(32)).astype(np.uint32) for s in _SALTS]
    low = np.empty((REGISTERS, len(starts)), np.uint32)
    hashed = np.empty(len(code), np.uint32)
    for i in range(REGISTERS):
        np.multiply(bases[i % len(bases)], _FACTORS[i], out=hashed)
        low[i] = np.minimum.reduceat(hashed, starts)
    exponential = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(SCALE)) + OFFSET, 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def estimated_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sketched sets of known sizes, on a grid of 1/128."""
    larger, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * (np.arange(1, 129) / 128)[None, :]

    def share(x):
        return -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)

    above, below = share(u - v * j), share(v - u * j)
    tiny = 1e-12
    likelihood = (larger * np.log(np.maximum(above, tiny)) + smaller * np.log(np.maximum(below, tiny))
                  + equal * np.log(np.maximum(1 - above - below, tiny)))
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size, 128-bit digest of the set, registers."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            code, bounds = shingles(tokenize(data, offsets, SPACED_FOLDED))
            sizes = np.diff(bounds)
            sums = []
            for salt in _SALTS[:2]:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code ^ salt), dtype=np.uint64)])
                sums.append(pa.array(signed(mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64)))))
            packed_rows = iter(registers(code, bounds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *sums,
                 pa.array([next(packed_rows).tobytes() if n else None for n in sizes.tolist()], pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def _bands(nodes: DataFrame) -> DataFrame:
    """One row per class and band."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                four = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(-1, REGISTERS // BAND)
                code = mix(four + np.arange(1, four.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(code.reshape(-1))), part.column("node").take(pa.array(np.repeat(np.arange(len(part)), four.shape[1])))],
                    ["bucket", "node"])

    return nodes.select("node", "sketch").mapInArrow(cut, "bucket long, node long")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least ``least``, with b's set size."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                raw = [np.frombuffer(b"".join(part.column(f"sketch_{k}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in "ab"]
                size = [part.column(f"n_{k}").to_numpy() for k in "ab"]
                good = pa.array(estimated_similarity(*raw, *size) >= least)
                yield part.select(["a", "b", "n_b"]).filter(good)

    return both.mapInArrow(judge, "a long, b long, n_b long").groupBy("a", "b").agg(F.max("n_b").alias("n_b"))


def _compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Set sizes, overlap, and b's shingles outside a, of pairs (leader a, partner b), from the full sets."""
    load = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / SALT_SHINGLES).cast("int").alias("salts"))
    partner = pairs.join(load, "a").select(F.col("b").alias("doc"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    leader = load.select(F.col("a").alias("doc"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
    roles = saved(partner.withColumn("partner", F.lit(True)).union(leader.withColumn("partner", F.lit(False))), "roles")
    ids = roles.select("doc").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text"))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    texts = packed(texts, "doc")
    rows = texts.join(roles, "doc").repartition("lead", "salt").sortWithinPartitions("lead", "salt", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, []
        for batch in batches:
            n_bytes = batch.column("n_bytes").to_numpy()
            ends = np.concatenate([[0], np.cumsum(n_bytes)])
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (2 << 20), "right")) - 1)
                part = batch.slice(start, stop - start)
                start = stop
                code, bounds = shingles(tokenize(*unpacked(part.column("ztext").to_pylist(), part.column("n_bytes").to_pylist()), SPACED_FOLDED))
                found = []
                lead, salt, doc, partner = (part.column(k).to_pylist() for k in ("lead", "salt", "doc", "partner"))
                for r in range(len(part)):
                    own = code[bounds[r]:bounds[r + 1]]
                    if (lead[r], salt[r]) != current:
                        current, sets = (lead[r], salt[r]), []
                    if not partner[r]:
                        sets.append(own)
                        continue
                    for other in sets:  # one, unless rows share the leader's doc_id
                        if len(other) and len(own):
                            common = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
                            found.append((lead[r], doc[r], len(other), len(own), int(common.sum()), signed(own[~common])))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(6)], ["a", "b", "size_a", "size_b", "overlap", "outside"])
            release()

    return rows.select("doc", "lead", "salt", "partner", "ztext", "n_bytes").mapInArrow(
        compare, "a long, b long, size_a long, size_b long, overlap long, outside array<long>")


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where(f"100 * overlap >= {PERCENT} * (size_a + size_b - overlap)").select("a", "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, for every node of an edge table (a, b).

    Alternating large-star and small-star steps on stored tables until nothing changes; only
    minima per node are aggregated, neighbourhoods are never collected.
    """
    def state(frame):
        return frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = state(edges)
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    while True:
        # Rows are doubled in place; unions of two halves would hold what is below them twice, and so eight times in a step.
        both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(lowest, both.a == lowest.node).where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        up = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        small = large.join(up, large.b == up.node).select(F.inline(F.array(pair("low", "a"), pair("low", "node"))))
        after = saved(small.where("a < b").distinct(), "edges")
        dropped(edges)
        edges, last, before = after, before, state(after)
        if before == last:
            tidied(edges.sparkSession)
            return edges.select(F.col("b").alias("node"), F.col("a").alias("low"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    sketched = saved(sketches(docs), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = saved(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    lead = usable.join(classes, ["d1", "d2"]).where("doc_id = node").dropDuplicates(["node", "d1", "d2"])
    nodes = saved(lead.select("node", "n_shingles", "sketch"), "nodes")
    links = _links(docs, nodes)
    # Rows that share a doc_id link their classes as well.
    shared = usable.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).join(
        nodes.select(F.col("node").alias("b")), "b", "left_semi")
    low = connected(links.union(shared.select("a", "b")))
    member = classes.join(low, classes.node == low.node, "left").select("d1", "d2", F.coalesce("low", classes.node).alias("component_id"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = sketched.select("doc_id", "n_shingles", "d1", "d2").join(member, ["d1", "d2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links that connect everything the bands bring together."""
    rows = _bands(nodes)
    sizes = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = saved(rows.join(sizes, "bucket"), "members")
    degree = saved(members.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    heads = saved(members.join(degree, "node").groupBy("bucket").agg(F.max_by("node", "degree").alias("lead")), "heads")
    placed = saved(members.join(heads, "bucket").select("bucket", "node", "lead"), "placed")
    dropped(sizes, members, heads)
    tidied(docs.sparkSession)
    nodes = saved(nodes.join(degree.select("node"), "node", "left_semi"), "candidates")
    pairs = saved(placed.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sized = pairs.join(nodes.groupBy(F.col("node").alias("b")).agg(F.max("n_shingles").alias("n_b")), "b")
    compared = saved(_compared(docs, sized.select("a", "b", "n_b")), "compared")
    links = saved(_linked(compared), "links")
    low = connected(links)
    label = saved(degree.join(low, "node", "left").select("node", F.coalesce("low", "node").alias("label")), "label")
    more = _straggler_pairs(placed, label, compared, pairs)
    close = PERCENT / 100 - ERRORS * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)
    likely = saved(_likely(more, nodes, close), "likely")
    again = saved(_linked(_compared(docs, likely)), "links")
    dropped(placed, pairs, compared, more, likely, label, degree, nodes)
    tidied(docs.sparkSession)
    return links.union(again)


def _straggler_pairs(placed: DataFrame, label: DataFrame, compared: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of different components that may link, though no leader linked them."""
    many = compared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("size_b").alias("size"), F.max("size_a").alias("lead_size"), F.max("overlap").alias("overlap"))
    known = saved(many.where("n = 1").select(F.col("a").alias("lead"), F.col("b").alias("node"), "size", "lead_size", "overlap"), "known")
    named = placed.join(label, "node")
    open_buckets = saved(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket"), "open")
    leader = label.select(F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    rows = named.join(open_buckets, "bucket").join(leader, "lead")
    rows = rows.join(known, ["lead", "node"], "left")
    # A leader shares everything with itself; it has been compared already.
    rows = saved(rows.where("node <> lead"), "rows")
    side = lambda frame, k: frame.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "label", "size", "overlap")))
    stray = side(rows.where("overlap is not null and label <> lead_label"), "a")
    partner = side(rows.where("size < lead_size"), "b")
    by_size = stray.join(partner, "bucket").where(
        f"label_a <> label_b and {100 + PERCENT} * least(overlap_a, overlap_b) >= {PERCENT} * (size_a + size_b) and "
        f"size_a * 100 >= size_b * {PERCENT} and size_b * 100 >= size_a * {PERCENT}")
    unknown = side(rows.where("overlap is null"), "a").join(side(rows, "b"), "bucket").where("label_a <> label_b")
    outside = compared.select(F.col("a").alias("lead"), F.col("b").alias("node"), F.explode("outside").alias("shingle")).join(label, "node")
    common = saved(outside.groupBy("lead", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
                   .where("low < high").select("lead", "shingle", "n"), "common")
    shared = outside.join(common, ["lead", "shingle"]).join(known, ["lead", "node"]).join(leader, "lead")
    own = Window.partitionBy("lead", "node")
    shared = saved(shared.withColumns({"nth": F.row_number().over(own.orderBy("n", "shingle")), "have": F.count(F.lit(1)).over(own)}), "shared")
    # With a partner no smaller than the leader, a straggler needs ``lack`` common shingles outside the leader, so one of them
    # is among all but ``lack - 1`` of its own; the rarest are kept. A smaller partner may need one only.
    lack = F.floor((PERCENT * (F.col("size") + F.col("lead_size")) + PERCENT + 99) / (100 + PERCENT)) - F.col("overlap")
    some = lambda frame, k: frame.select("lead", "shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "label", "size", "overlap")))
    strays = shared.where("label <> lead_label")
    rarest = some(strays.where(F.col("nth") <= F.col("have") - lack + 1), "a").join(some(shared.where("size >= lead_size"), "b"), ["lead", "shingle"])
    smaller = some(strays, "a").join(some(shared.where("size < lead_size"), "b"), ["lead", "shingle"])
    by_shingle = rarest.union(smaller).where(f"label_a <> label_b and size_a * 100 >= size_b * {PERCENT} and size_b * 100 >= size_a * {PERCENT}")
    pairs = by_size.select("node_a", "node_b").union(unknown.select("node_a", "node_b")).union(by_shingle.select("node_a", "node_b"))
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = saved(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    dropped(known, open_buckets, rows, common, shared)
    tidied(placed.sparkSession)
    return out


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document per group of near duplicates, that of the smallest doc_id, with all columns.

    Documents in no group stay, so do rows without an id, and of rows that share a doc_id all that share
    the kept one's.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == F.col("__gone"), "left_anti")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
