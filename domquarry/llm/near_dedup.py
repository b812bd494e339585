"""MinHash near-dedup by chosen paths: documents branch down trees by selected minwise tokens; small nodes are compared.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set: its distinct shingles of 5 words; with fewer words
the whole sequence as one; without words it is empty and linked with nothing. Documents are linked if
100 * intersection >= 85 * union, always confirmed on full sets; components are the classes.

1. One pass makes of each text a hash of its set, 64 minwise tokens and a bit of each of 256.
2. Documents of equal sets (128 bits of hash and the size) are one class with a number of its own (a hash aggregate, combined
   map-side); only classes go on, by number.
3. Independent trees branch the classes by one token each at the root.
4. Star pass: each node's least class is compared with its other members: a group of thousands of near copies gives one pair
   a member, not all pairs. Confirmed links are contracted to components.
5. Exhaustive pass: only nodes that still hold several components count. Nodes of at most LEAF classes are compared whole;
   larger ones branch again by two tokens a node, down to DEPTH; what is still large there is compared in blocks.
   A pair of one component is never compared again. Pairs are dropped whose 64 bits differ, or whose sketches of 256 bits,
   in more places than limits(percent) allows; the rest are confirmed on full sets.

A pair of similarity 0.85 shares a root token in a tree with probability 0.85 and survives each further level with 0.9775;
a bit differs with probability 0.075, so over 18 of 64 or over 42 of 256 do with probability under
1e-6; other values of percent have limits of their own. With 10 trees a link is missed with probability 6e-9 where root nodes are
small and under 1e-6 three levels down.

Cases: a row without doc_id is linked with nothing, its component_id is null and it is kept; rows that repeat a doc_id are each
judged by their own text; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lut, materialize, mix, slices, span_hash, tidy, word_spans
from .components import components

SHINGLE, TOKENS, SKETCH, LEAF, DEPTH = 5, 64, 256, 32, 4
#: Probability with which a link at the threshold may be lost to one sketch, and to all trees three levels down.
MISS = 1e-6
#: Ids of compared classes, and of rows that go, are broadcast up to this number (32 bytes each at most); beyond it the texts are joined by shuffle.
BROADCAST_IDS = 1 << 20

_rng = np.random.default_rng(20240229)
_SEED = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def limits(percent: int) -> tuple[int, int, int]:
    """Differing bits allowed of 64 and of SKETCH, and trees: what a link of similarity percent / 100 meets but for MISS."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and 100 at most")
    p = (100 - percent) / 200  # minwise tokens differ with probability 1 - similarity, their bits in half of these cases

    def bits(n: int) -> int:
        tail = 0.0
        for k in range(n, 0, -1):
            tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail > MISS:
                return k
        return 0

    # a root token is shared with probability percent / 100, one of two tokens on each further level
    s = percent / 100
    lost = 1 - s * (1 - (1 - s) ** 2) ** 3
    trees = max(10, math.ceil(math.log(MISS) / math.log(lost))) if lost > 0 else 10
    if trees > TOKENS:
        raise ValueError(f"percent={percent} takes {trees} root tokens; there are {TOKENS}")
    return bits(64) + 1, bits(SKETCH), trees


def shingle_sets(column: pa.Array):
    """For each row, in order: the sorted distinct 64-bit shingle hashes of its text."""
    for _, _, data, off in slices(column):
        low = LOWER[data]
        start, end, first = word_spans(low, off, lut("nonspace"))
        h = span_hash(low, start, end)
        n = max(0, len(h) - SHINGLE + 1)
        s = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            s += h[j : j + n] * _STEP[j]
        s = mix(s)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(s[a : b - SHINGLE + 1])
            elif b > a:
                yield mix((h[a:b] * _STEP[: b - a]).sum(keepdims=True) ^ np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)), int(mix(s ^ np.uint64(0x3C3C3C3C3C3C3C3C)).sum().astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH minwise hashes of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[i : i + 1024] ^ _SEED[:, None]) * _ODD[:, None]).min(1), out=least)
    return least


def _sketcher(batches):
    for batch in batches:
        n, hi, lo, bits, fine, tokens = [], [], [], [], [], []
        for s in shingle_sets(batch.column(1)):
            least = sketch(s)
            key = set_key(s) if len(s) else (0, 0)
            low = np.packbits((mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
            n.append(len(s))
            hi.append(key[0])
            lo.append(key[1])
            bits.append(int(low[0]))
            fine.append(low)
            tokens.append(least[:TOKENS])
        flat = np.concatenate(tokens).view(np.int32) if tokens else np.zeros(0, np.int32)
        words = np.concatenate(fine) if fine else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TOKENS, dtype=np.int32)), pa.array(flat))
        fines = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, SKETCH // 64, dtype=np.int32)), pa.array(words))
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bits, pa.int64()), fines, lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n_shingles", "hi", "lo", "bits", "fine", "tokens"])


def pack_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes."""
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack_set(raw) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view(np.uint64).ravel()


def _set_rows(batches):
    """Over rows (text, c, hi, lo): the class's number and its set; texts of another set (of rows that repeat an id) give none."""
    for batch in batches:
        own, sets = [], []
        for i, (s, hi, lo) in enumerate(zip(shingle_sets(batch.column(0)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if len(s) and set_key(s) == (hi, lo):
                own.append(i)
                sets.append(pack_set(s))
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(own, pa.int64())), pa.array(sets, pa.binary())], ["c", "members"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([unpack_set(a.as_buffer()), unpack_set(b.as_buffer())])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        self.bits, self.sketch_bits, self.trees = limits(percent)
        self.docs = docs.select(F.col("doc_id").cast("long"), "text")
        self.rows = materialize(self.docs.withColumn("t", F.xxhash64("text")).mapInArrow(tidy(_sketcher), "doc_id long, t long, n_shingles long, hi long, lo long, bits long, fine array<long>, tokens array<int>"), "near-sketches")
        real = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = real.groupBy("hi", "lo", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("fine").alias("fine"), F.first("tokens").alias("tokens"))
        self.classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "near-classes")  # written, so numbers stay

    def roots(self) -> DataFrame:
        """node, c, n, bits, tree: one root branch a tree."""
        node = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(F.xxhash64(t, F.get("tokens", t * F.lit(TOKENS // self.trees))).alias("node")))
        return self.classes.select("c", "n", "bits", F.explode(node).alias("b")).select(F.col("b.node").alias("node"), "c", "n", "bits")

    def near(self, n1: str, n2: str, b1: str, b2: str):
        """What any linked pair meets: sizes within the ratio, few differing bits."""
        return F.expr(f"100 * least({n1}, {n2}) >= {self.percent} * greatest({n1}, {n2}) AND bit_count({b1} ^ {b2}) <= {self.bits}")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """pairs: distinct a, b of classes. Those whose full sets are similar enough, as u, v. All bits of the sketches are compared first."""
        fine = self.classes.select("c", "fine")
        apart = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(SKETCH // 64))
        pairs = pairs.join(fine.withColumnsRenamed({"c": "a", "fine": "x"}), "a").join(fine.withColumnsRenamed({"c": "b", "fine": "y"}), "b")
        pairs = materialize(pairs.where(f"{apart} <= {self.sketch_bits}").select("a", "b"), "near-alike")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(self.classes.select("c", "hi", "lo", "doc_id"), "c")
        ids = materialize(ids, "near-ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = self.docs.join(ids, "doc_id").select("text", "c", "hi", "lo").mapInArrow(tidy(_set_rows), "c long, members binary")
        sets = materialize(sets, "near-sets").dropDuplicates(["c"])  # rows may repeat ids
        own = pairs.join(sets.select(F.col("c").alias("b"), F.col("members").alias("y")), "b")
        own = own.join(sets.select(F.col("c").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
        return own.mapInArrow(tidy(_confirm(self.percent)), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def star_links(self) -> DataFrame:
        rows = self.roots()
        pivot = rows.groupBy("node").agg(F.min(F.struct("bits", "n", "c")).alias("p"), F.count("*").alias("size")).where("size > 1")
        near = rows.join(pivot, "node").where("c <> p.c").where(self.near("n", "p.n", "bits", "p.bits"))
        # of a class's pivots in all trees the likeliest
        best = near.groupBy("c").agg(F.min(F.struct(F.expr("bit_count(bits ^ p.bits)").alias("apart"), F.col("p.c").alias("a"))).alias("b"))
        return self.confirm(best.select(F.col("b.a").alias("a"), F.col("c").alias("b")))

    def rest_links(self, links: DataFrame) -> DataFrame:
        """Links between components of ``links``."""
        label = components(links)
        of = self.classes.select("c").join(label.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("label"))
        of = materialize(of, "near-labels")
        rows, found = self.roots().join(of, "c"), None
        for depth in range(DEPTH + 1):
            live = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("node", "size")
            rows = materialize(rows.join(live, "node"), "near-nodes")
            last = depth == DEPTH
            small = rows if last else rows.where(F.col("size") <= LEAF)
            # beyond the last level a large node is cut in blocks; each pair of blocks is a task's work of its own
            blocks = F.ceil(F.col("size") / (8 * LEAF)).cast("int") if last else F.lit(1)
            mine = F.pmod(F.xxhash64("c"), blocks).cast("int")
            small = small.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))))
            small = small.select("node", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "c", "n", "bits", "label")
            x, y = small.alias("x"), small.alias("y")
            same = (F.col("x.node") == F.col("y.node")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
            differ = (F.col("x.c") < F.col("y.c")) & (F.col("x.label") != F.col("y.label")) & self.near("x.n", "y.n", "x.bits", "y.bits")
            pairs = x.join(y, same & differ).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
            pairs = materialize(pairs, "near-pairs")
            found = pairs if found is None else found.unionByName(pairs)
            big = rows.where(F.col("size") > LEAF)
            if last or not big.limit(1).count():
                break
            two = F.array(*[F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS // 2)).cast("int") * 2 + k for k in (0, 1)])
            child = F.transform(two, lambda p: F.xxhash64("node", p, F.get("tokens", p)))
            rows = big.join(self.classes.select("c", "tokens"), "c").select(F.explode(child).alias("node"), "c", "n", "bits", "label")
        return self.confirm(materialize(found.distinct(), "near-rest"))


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, component_id and kept, a row for each row."""
    join = _Join(docs, percent)
    star = materialize(join.star_links(), "near-links")
    links = star.unionByName(materialize(join.rest_links(star), "near-links"))
    label = components(links)
    of = join.classes.select("c", "hi", "lo", "n", "doc_id").join(label.withColumnRenamed("node", "c"), "c", "left").select("hi", "lo", "n", F.col("doc_id").alias("least"), F.coalesce("root", "c").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(smallest, "root").select("hi", "lo", F.col("n").alias("n_shingles"), "component_id")
    rows = join.rows.select("doc_id", "t", "n_shingles", "hi", "lo").join(classes, ["hi", "lo", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "t", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs' doc_id (as long) with n_shingles, component_id and kept (doc_id = component_id), a row for each row."""
    return _judged(docs, percent).drop("t")


def dedup_near(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows whose document isn't the smallest of its component; rows that repeat a kept id and text all stay."""
    judged = _judged(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"))
    gone = materialize(judged.distinct(), "near-gone")  # of rows that share an id only those of this text go
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = (docs["doc_id"].cast("long") == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_t"])
    return docs.join(gone, same, "left_anti")
