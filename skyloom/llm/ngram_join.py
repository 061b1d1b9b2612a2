"""n-gram Jaccard self-join by MinHash banding, with whole n-gram sets to verify.

1. A text's words (runs of letters, digits and non-ASCII characters, A-Z in lower case) form the set of its N-grams, or
   one gram of all its words if it has fewer than N. Texts with the same words are one text from here on, a node, with
   the number of their copies and the least doc_id as representative. Texts that share a doc_id stay nodes of their own.
2. Representatives are shuffled on the hashes of the bands of their MinHash signature. Bands and rows are chosen so that
   a pair at the threshold shares a band with probability TARGET_RECALL at least. In a bucket each member is linked with
   the least one, so a bucket of k gives k - 1 candidate edges, and the edges' components hold every candidate pair.
3. Pairs are verified on full sets, in blocks of about BLOCK by BLOCK members that count each member's links and give a
   spanning forest of them, never the pairs. A component is verified as a whole (which holds all pairs of its buckets) or
   bucket by bucket, whichever copies its members to fewer blocks: groups of near copies go whole, long chains of texts
   that are each like the next only go by buckets, so their work grows with their length. Buckets with the same members
   are verified once, and a pair counts in the first bucket that both its texts are in. Where a component has several
   blocks, the forests' components are its classes.

Result: for each row of the input doc_id, class_id (least doc_id that it is linked with by links or copies, itself
included) and n_links (other rows with the same words or a similarity of the threshold or more). Texts without words,
null ones too, and rows without a doc_id are linked with nothing. Rows that repeat a doc_id and its words count as
copies; rows that repeat it with other words are judged each by its own text. An empty table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, settled, ship, slices, spread, table, utf8, whole_rows
from .graph import components
from .license_scan import words_of

N, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.99999
#: Most MinHash values of a signature; members, and n-grams of all members, of each side of a block; elements of a dense matrix.
MOST_HASHES, BLOCK, BLOCK_GRAMS, DENSE = 160, 512, 1 << 21, 1 << 22
_MIX = np.random.default_rng(2024).integers(1, 2**32, (2, MOST_HASHES), np.uint32)
_STEP = [int(x) | 1 for x in np.random.default_rng(2025).integers(1, 2**63, 64, np.uint64)]


def bands_and_rows(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows, so the fewest false candidates, for which enough bands to reach the recall fit into `most` values."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-p))) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the recall can't be reached with so few values")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def grams(words: list[bytes], known: dict, n: int = N) -> np.ndarray:
    """The set of 64-bit hashes of the words' n-grams, in order."""
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    if not k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        total += w[j : len(w) - k + 1 + j] * np.uint64(_STEP[j])
    return np.unique(_mixed(total + np.uint64(k)))


def band_hashes(g: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band; long sets in slices."""
    a, b = _MIX[0, : bands * rows, None], _MIX[1, : bands * rows, None] | np.uint32(1)
    h = (g >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, 2**32 - 1, np.uint32)
    for k in range(0, len(h), 2048):
        x = (h[None, k : k + 2048] ^ a) * b
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(axis=1), out=low)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(_STEP[9])
    for j in range(rows):
        key = _mixed(key + low.reshape(bands, rows)[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, fp (128 bits of the words; null if there are none or no doc_id), n_grams, bands."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in slices(batches):
            fps, counts, keys = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                words = words_of(text)
                there = bool(words) and doc_id is not None
                fps.append(xxhash.xxh3_128_digest(b" ".join(words)) if there else None)
                g = grams(words, known, n) if there else None
                counts.append(len(g) if there else 0)
                keys.append(band_hashes(g, bands, rows) if there else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "n_grams", "bands"])

    return spread(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")).mapInArrow(run, "doc_id long, fp binary, n_grams long, bands array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairs' intersections."""
    k = len(sets)
    both = np.zeros((k, k), np.float32)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[inverse]
    row = np.repeat(np.arange(k), [len(x) for x in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, DENSE // k)
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((k, min(width, int(shared.sum()) - at)), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        both += dense @ dense.T
    return both.astype(np.int64)


def linked(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Matrix of which pairs reach the threshold, exactly: I / (a + b - I) >= t is (1 + t) I >= t (a + b) in whole numbers."""
    sizes = np.array([len(x) for x in sets], np.int64)
    t, u = threshold.numerator, threshold.denominator
    return (u + t) * overlaps(sets) >= t * (sizes[:, None] + sizes[None, :])


def _roots(link: np.ndarray) -> np.ndarray:
    """For each row the least row that it is linked with, over any number of links."""
    root = np.arange(len(link))
    while True:
        new = np.where(link, root[None, :], len(link)).min(axis=1)
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify_block(members: pa.Table, threshold: Fraction) -> pa.Table:
    """Counts links in one block of pairs: within it if it stands for one part of its group, between its two parts else. A pair
    that an earlier group holds too is a link there already."""
    members = members.sort_by("node")
    node = members["node"].to_numpy()
    first = np.append(True, node[1:] != node[:-1])
    node = node[first]
    copies, part = members["copies"].to_numpy()[first], members["part"].to_numpy()[first]
    pick = np.flatnonzero(first)
    link = linked([np.frombuffer(members["grams"][int(k)].as_py(), np.uint64) for k in pick], threshold)
    np.fill_diagonal(link, False)
    if members["low"][0].as_py() != members["high"][0].as_py():
        link &= part[:, None] != part[None, :]
    root = node[_roots(link)]
    before = [np.array(members["before"][int(k)].as_py() or (), np.int64) for k in pick]
    if any(map(len, before)):
        link &= overlaps(before) == 0
    return pa.table({"node": node, "links": (link @ copies).astype(np.int64), "root": root, "alone": pa.array(members["alone"].to_numpy(zero_copy_only=False)[first])})


def _blocks(n: str, grams: str) -> Column:
    """Parts into which a group of n members is dealt."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(grams) / BLOCK_GRAMS)).cast("int")


def _groups(comp: DataFrame, keys: DataFrame, buckets: DataFrame, texts: DataFrame, n_docs: int, bands: int) -> DataFrame:
    """(node, groups): in which groups each member of a component is verified, as key, part, parts and whole (the group is a whole component)."""
    sized = comp.join(texts.select("node", "n_grams"), "node")
    whole = sized.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).withColumn("parts", _blocks("n", "grams"))
    whole = materialise(whole.select("comp", "n", "parts"), "jaccard-wholes", n_docs // 2)
    # Only components of several blocks have a choice. A bucket lies within one component.
    held = keys.join(buckets.select("band"), "band").join(sized, "node").join(whole.filter("parts > 1").select("comp"), "comp")
    by_band = held.groupBy("comp", "band").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    by_band = by_band.groupBy("comp", "n", "same").agg(F.min("band").alias("band"), F.max("grams").alias("grams")).withColumn("parts", _blocks("n", "grams"))
    by_band = materialise(by_band.select("comp", "band", "n", "parts"), "jaccard-by-band", n_docs * bands // 2)
    cost = by_band.groupBy("comp").agg(F.sum(F.col("n") * F.col("parts")).alias("cost"))
    chosen = materialise(whole.join(cost, "comp", "left").select("comp", "parts", (F.col("cost") < F.col("n") * F.col("parts")).alias("split")), "jaccard-chosen", n_docs // 2)
    part = lambda salt: F.pmod(F.xxhash64("node", salt), F.col("parts")).cast("int").alias("part")
    entire = comp.join(chosen.filter("NOT coalesce(split, false)"), "comp").select("node", F.array(F.struct(F.col("comp").alias("key"), part("comp"), "parts", F.lit(True).alias("whole"))).alias("groups"))
    split = by_band.join(chosen.filter("split").select("comp"), "comp").select("band", "parts")
    split = keys.join(split, "band").select("node", F.struct(F.col("band").alias("key"), part("band"), "parts", F.lit(False).alias("whole")).alias("g"))
    return entire.unionByName(split.groupBy("node").agg(F.collect_list("g").alias("groups")))


def _classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, fp and first (the row's text is the one that stands for its class) for every row of docs."""
    bands, rows = bands_and_rows(threshold, recall)
    sig = materialise(signatures(docs, n, bands, rows), "jaccard-signatures")
    n_docs = sig.count()  # from the files' footers
    by_text = settled(lambda: _by_text(docs, sig, n_docs, n, Fraction(threshold).limit_denominator(1000), bands), "jaccard-classes", n_docs)
    there = sig.filter("fp IS NOT NULL").select("doc_id", "fp").join(by_text, "fp").select("doc_id", "class_id", "n_links", "fp", "first")
    return there.unionByName(sig.filter("fp IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "fp", F.lit(True).alias("first")))


def _by_text(docs: DataFrame, sig: DataFrame, n_docs: int, n: int, exact: Fraction, bands: int) -> DataFrame:
    """fp, class_id, n_links and first for every text with words."""
    texts = sig.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "jaccard-texts", n_docs)
    reps = sig.select(F.col("doc_id").alias("rep"), "fp", "bands").join(texts, ["fp", "rep"]).dropDuplicates(["fp", "rep"])
    keys = materialise(reps.select("node", F.explode("bands").alias("band")), "jaccard-bands", n_docs * bands)
    buckets = materialise(keys.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").drop("n"), "jaccard-buckets", n_docs * bands // 2)
    edges = keys.join(buckets, "band").select(F.col("node").alias("a"), F.col("least").alias("b"))
    comp = materialise(components(edges), "jaccard-components", n_docs)
    members = _groups(comp, keys, buckets, texts, n_docs, bands).join(texts, "node").select("node", "rep", "groups", "copies", "fp")
    members = materialise(members, "jaccard-members", n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in slices(batches):
            good, found = [], []
            for k, (text, fp) in enumerate(zip(utf8(b.column("text")), b.column("fp").to_pylist())):
                words = words_of(text)
                if xxhash.xxh3_128_digest(b" ".join(words)) == fp:
                    good.append(k)
                    found.append(grams(words, known, n).tobytes())
            kept = b.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in ("node", "groups", "copies")], pa.array(found, pa.binary())], names=["node", "groups", "copies", "grams"])

    # Members grow with the input, so they are shuffled at every size.
    got = docs.selectExpr("CAST(doc_id AS BIGINT) AS rep", "text").join(members.hint("merge"), "rep")
    got = got.mapInArrow(run, "node long, groups array<struct<key: long, part: int, parts: int, whole: boolean>>, copies long, grams binary")
    # Each member goes to every block that pairs its part of a group with another, or with itself.
    got = got.select("node", "copies", "grams", "groups", F.explode("groups").alias("g")).select("node", "copies", "grams", "g.*", F.expr("transform(filter(groups, x -> x.key < g.key), x -> x.key)").alias("before"))
    got = got.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "_o"), "high": F.greatest("part", "_o"), "alone": F.expr("whole AND parts = 1")}).drop("_o", "parts")
    checked = got.groupBy("whole", "key", "low", "high").applyInArrow(lambda t: verify_block(t, exact), "node long, links long, root long, alone boolean")
    checked = materialise(checked, "jaccard-links")
    split = components(checked.filter("NOT alone AND node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = checked.filter("alone").select("node", F.col("root").alias("comp"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = whole.unionByName(split).groupBy("node").agg(F.min("comp").alias("comp"))
    least = classes.join(texts.select("node", "rep"), "node").groupBy("comp").agg(F.min(F.struct("rep", "node")).alias("least"))
    by_text = texts.join(links, "node", "left").join(classes.join(least, "comp").select("node", "least"), "node", "left")
    return by_text.select("fp", F.coalesce("least.rep", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce(F.col("least.node") == F.col("node"), F.lit(True)).alias("first"))


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    return _classes(docs, n, threshold, recall).select("doc_id", "class_id", "n_links")


def fingerprints(text: Column) -> Column:
    """The fp of signatures for each text; empty if it has no words."""

    @F.arrow_udf("binary")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(b" ".join(w)) if (w := words_of(x)) else b"" for x in utf8(t)], pa.binary())

    return run(text)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of docs that stands for each class, of rows that repeat its doc_id and words one, and those without a doc_id; with all their columns."""
    stands = F.when(F.col("first") & (F.col("doc_id") == F.col("class_id")), F.coalesce("fp", F.lit(b"")))
    keep = _classes(docs).groupBy("doc_id").agg(F.count("*").alias("_times"), F.collect_set(stands).alias("_fps")).filter("doc_id IS NOT NULL AND size(_fps) > 0")
    keep = materialise(keep, "jaccard-kept")
    repeated = bool(keep.filter("_times > 1").head(1))
    rows = whole_rows(docs).withColumn("_id", F.col("doc.doc_id"))
    # What is kept grows with the input, so it is shuffled at every size.
    if repeated:
        keep = keep.select(F.col("doc_id").alias("_keep"), F.explode("_fps").alias("_keep_fp"))
        kept = rows.withColumn("_fp", fingerprints(F.col("doc.text"))).join(keep.hint("merge"), (F.col("_id") == F.col("_keep")) & (F.col("_fp") == F.col("_keep_fp")), "left_semi")
        kept = kept.dropDuplicates(["_id", "_fp"]).drop("_fp")
    else:
        kept = rows.join(keep.select(F.col("doc_id").alias("_keep")).hint("merge"), F.col("_id") == F.col("_keep"), "left_semi")
    return kept.unionByName(rows.filter("_id IS NULL")).select("doc.*")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT r.doc_id, min(seen)::BIGINT AS class_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links FROM r LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = r.doc_id GROUP BY r.doc_id"""
