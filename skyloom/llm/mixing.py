"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets. Sources, in code-point order with null last, weigh 5, 2, 1, repeating, and share `share_percent` of all words;
no target exceeds CAP times its source's words, and the excess goes to the others by weight (`water level`: target =
min(CAP * words, c * weight), the same c for all).

Copies. Within a source a document is expected CAP times at most: min(CAP, c * (20 + what its word count's bit length
lacks to 16)), so that short documents are repeated rather than long ones; c makes the expected words equal the target.
The whole part of that is allocated for certain. For the fractional part, its inclusion probability p, documents are
ranked by (u / (1 - u)) / (p / (1 - p)), u being a uniform number hashed from doc_id and text, and taken from the lowest
rank up while the middle of a document lies within the words still wanted. As the targets are in words, so is the sample's
fixed size: not a fixed number of documents, for which alone Pareto sampling's odds are known to be near p. Here a
document's odds differ from p by what its own length and the last document's shift the end of the sample. A source's
taken words miss its target by half a document at most.

Ranks aren't sorted as a whole: a histogram of ranks finds the bucket in which the sample ends, and only that bucket is
sorted. Null text has no words; a null doc_id hashes like the word null, so rows without an id are drawn each by its text;
rows equal in doc_id, source and text rise or fall together (each still counts); an empty table gives an empty mix; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread, table, whole_rows, words_of

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
SEED = "mix-1"
#: Rank buckets for a source: this many, and one more for each ROWS_PER_BUCKET documents.
BUCKETS, ROWS_PER_BUCKET = 256, 10_000


def _draw(doc_id: Column, text: Column) -> Column:
    """52 random bits of a row, the same on every run and engine."""
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


LEVEL = "CAST(least(length(bin(size)), 16) AS BIGINT)"
FAVOUR = "(36L - level)"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """source, source_size, n_docs, target. A row per source; the two windows without keys sort the sources, not the documents."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = s.withColumn("weight", weight)
    # Those that reach the cap first come first; c of the first source that stays below it is the level.
    fill = Window.orderBy(F.expr(f"CAST({CAP} * source_size AS DOUBLE) / weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumns({"_all": F.sum("source_size").over(everything), "_w": F.sum("weight").over(everything)})
    s = s.withColumns({"_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_wb": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("_c", F.expr(f"CAST({share_percent} * _all - {100 * CAP} * _capped AS DOUBLE) / CAST(100 * (_w - _wb) AS DOUBLE)"))
    s = s.withColumn("_k", F.row_number().over(fill))
    s = s.withColumn("c", F.min(F.expr(f"CASE WHEN _c * weight <= {CAP} * source_size THEN struct(_k, _c) END")).over(everything)["_c"])
    return s.select("source", "source_size", "n_docs", F.expr(f"least(CAST({CAP} * source_size AS DOUBLE), coalesce(c * weight, CAST({CAP} * source_size AS DOUBLE)))").alias("target"))


def allocation(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source: its target, expected copies by level as a map, and the words left to the sample."""
    groups = sized.groupBy("source", "level").agg(F.sum("size").alias("words"))
    g = groups.alias("g").join(wanted.alias("w"), F.expr("g.source <=> w.source")).select("g.source", "level", "words", "source_size", "n_docs", "target")
    g = g.withColumn("_f", F.expr(FAVOUR))
    down = Window.partitionBy("source").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    g = g.withColumns({"_all": F.sum(F.expr("_f * words")).over(whole), "_cap": F.coalesce(F.sum("words").over(down), F.lit(0)), "_fb": F.coalesce(F.sum(F.expr("_f * words")).over(down), F.lit(0))})
    g = g.withColumn("_c", F.expr(f"CASE WHEN _all > _fb THEN (target - {CAP} * _cap) / CAST(_all - _fb AS DOUBLE) END"))
    g = g.withColumn("c", F.min(F.expr(f"CASE WHEN _c * _f <= {CAP} THEN struct(level, _c) END")).over(whole)["_c"])
    g = g.withColumn("copies", F.expr(f"least({CAP}D, coalesce(c * _f, {CAP}D))"))
    return g.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("n_docs").alias("n_docs"), F.first("target").alias("target"),
        F.map_from_entries(F.collect_list(F.struct("level", "copies"))).alias("copies"),
        F.sum(F.expr("CAST(floor(copies) * words AS BIGINT)")).alias("_certain"),
    ).withColumn("wanted", F.expr("target - _certain")).drop("_certain")


def ranked(sized: DataFrame, alloc: DataFrame, *more: str) -> DataFrame:
    """sized with certain (whole copies), rank (null: not in the draw) and bucket."""
    r = sized.alias("d").join(alloc.alias("a"), F.expr("d.source <=> a.source")).select("d.*", "source_size", "n_docs", "target", "wanted", *more, F.expr("a.copies[level]").alias("_e"))
    r = r.withColumns({"certain": F.expr("CAST(floor(_e) AS BIGINT)"), "_p": F.expr("_e - floor(_e)"), "_u": F.expr("(draw + 0.5D) / 4503599627370496D")})
    r = r.withColumn("rank", F.expr("CASE WHEN _p > 0 THEN (_u / (1 - _u)) / (_p / (1 - _p)) END"))
    return r.withColumn("bucket", F.expr(f"CAST(floor(rank / (1 + rank) * ({BUCKETS} + n_docs DIV {ROWS_PER_BUCKET})) AS BIGINT)")).drop("_e", "_p", "_u")


def sample_ends(sized: DataFrame, alloc: DataFrame, n_docs: int) -> DataFrame:
    """alloc with end_bucket and end (rank, draw): documents of lower buckets are drawn, those of this one up to the end."""
    r = ranked(sized, alloc).filter("rank IS NOT NULL")
    hist = r.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("run", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = materialise(hist.filter("run <= wanted AND run + words > wanted").groupBy("source").agg(F.min("bucket").alias("end_bucket"), F.min_by("run", "bucket").alias("run")), "mix-buckets", n_docs)
    inside = r.alias("d").join(last.alias("b"), F.expr("d.source <=> b.source AND d.bucket = b.end_bucket")).select("d.source", "rank", "draw", "size", "wanted", "run")
    units = inside.groupBy("source", "rank", "draw").agg(F.sum("size").alias("size"), F.first("wanted").alias("wanted"), F.first("run").alias("run"))
    order = Window.partitionBy("source").orderBy("rank", "draw").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("at", F.expr("run") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    ends = units.filter("2 * at + size <= 2 * wanted").groupBy("source").agg(F.max(F.struct("rank", "draw")).alias("end"))
    a = alloc.alias("a").join(last.alias("b"), F.expr("a.source <=> b.source"), "left").join(ends.alias("e"), F.expr("a.source <=> e.source"), "left")
    return materialise(a.select("a.*", "end_bucket", "end"), "mix-ends", n_docs)


def sized_documents(docs: DataFrame, doc_id: Column, source: Column, text: Column, *keep: str) -> DataFrame:
    return spread(docs).select(*keep, doc_id.alias("doc_id"), source.alias("source"), F.size(words_of(text)).cast("long").alias("size"), _draw(doc_id, text).alias("draw")).withColumn("level", F.expr(LEVEL))


def _drawn(sized: DataFrame, ends: DataFrame) -> DataFrame:
    drawn = "rank IS NOT NULL AND (end_bucket IS NULL OR bucket < end_bucket OR bucket = end_bucket AND end IS NOT NULL AND struct(rank, draw) <= end)"
    r = ranked(sized, ends, "end_bucket", "end")
    return r.withColumn("n_copies", F.expr(f"certain + CASE WHEN {drawn} THEN 1L ELSE 0L END"))


def plan_mix(sized: DataFrame) -> DataFrame:
    """A row per source with all that decides its documents' copies; materialised, so its size is known before any join."""
    n_docs = sized.count()  # from the files' footers
    wanted = materialise(targets(sized), "mix-targets", n_docs)
    return sample_ends(sized, materialise(allocation(sized, wanted), "mix-allocation", n_docs), n_docs)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_copies for every row of docs."""
    sized = materialise(sized_documents(docs, F.col("doc_id"), F.col("source"), F.col("text")), "mix-sizes")
    return _drawn(sized, plan_mix(sized)).select("doc_id", "size", "source_size", "target", F.expr("size * n_copies").alias("taken"), "n_copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns. Rows are written once with their sizes, so words are counted once."""
    packed = materialise(sized_documents(whole_rows(docs), F.col("doc.doc_id"), F.col("doc.source"), F.col("doc.text"), "doc"), "mix-sizes")
    copies = _drawn(packed, plan_mix(packed.drop("doc"))).filter("n_copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("_copy")).select("doc.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS draw FROM {docs}),
l AS (SELECT *, least(length(bin(size)), 16)::BIGINT AS level FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM l GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS al, sum(weight) OVER ()::BIGINT AS w, coalesce(sum(source_size) OVER f, 0)::BIGINT AS capped, coalesce(sum(weight) OVER f, 0)::BIGINT AS wb, count(*) OVER f AS k
    FROM s1 WINDOW f AS (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (150 * al - 200 * capped)::DOUBLE / (100 * (w - wb))::DOUBLE AS ci FROM s2),
s4 AS (SELECT *, (min(CASE WHEN ci * weight <= 2 * source_size THEN struct_pack(k := k, ci := ci) END) OVER ()).ci AS c FROM s3),
s AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(c * weight, (2 * source_size)::DOUBLE)) AS target FROM s4),
g0 AS (SELECT l.source, level, (36 - level)::BIGINT AS f, sum(size)::BIGINT AS words FROM l GROUP BY ALL),
g1 AS (SELECT g0.*, target, sum(f * words) OVER (PARTITION BY g0.source)::BIGINT AS al, coalesce(sum(words) OVER b, 0)::BIGINT AS cap, coalesce(sum(f * words) OVER b, 0)::BIGINT AS fb
    FROM g0 JOIN s ON s.source IS NOT DISTINCT FROM g0.source WINDOW b AS (PARTITION BY g0.source ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g2 AS (SELECT *, CASE WHEN al > fb THEN (target - 2 * cap) / (al - fb)::DOUBLE END AS ci FROM g1),
g3 AS (SELECT *, (min(CASE WHEN ci * f <= 2 THEN struct_pack(level := level, ci := ci) END) OVER (PARTITION BY source)).ci AS c FROM g2),
g AS (SELECT *, least(2.0::DOUBLE, coalesce(c * f, 2.0::DOUBLE)) AS copies FROM g3),
r AS (SELECT source, target - sum((floor(copies) * words)::BIGINT)::DOUBLE AS wanted FROM g GROUP BY source, target),
u AS (SELECT l.*, floor(copies)::BIGINT AS certain, copies - floor(copies) AS p,
    (draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM l JOIN g ON g.source IS NOT DISTINCT FROM l.source AND g.level = l.level),
k AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u),
y AS (SELECT source, rank, draw, sum(size)::BIGINT AS unit FROM k GROUP BY ALL),
o AS (SELECT *, coalesce(sum(unit) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM y),
z AS (SELECT k.*, certain + CASE WHEN k.rank IS NOT NULL AND 2 * run + unit <= 2 * wanted THEN 1 ELSE 0 END AS n_copies
    FROM k JOIN o ON o.source IS NOT DISTINCT FROM k.source AND o.rank IS NOT DISTINCT FROM k.rank AND o.draw = k.draw JOIN r ON r.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * n_copies)::BIGINT AS taken, n_copies::BIGINT AS n_copies FROM z JOIN s ON s.source IS NOT DISTINCT FROM z.source"""


ORACLE = _oracle()
