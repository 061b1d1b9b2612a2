"""Quality rules with adaptive limits, in DataFrame functions only.

Each document gets base counts (see `measures`). Four rates and two lengths go into mergeable quantile sketches per
language and source: log-linear histograms whose buckets keep the leading bits of an integer, so a sketch is a map from
a bucket's lower edge to a count, two sketches merge by adding counts, and a quantile is off by at most one part in 32.
Only documents that pass the base rule are sketched. Each group's sketch is merged with its language's and with all
documents', either scaled to the weight of PRIOR documents: small groups lean on them, large ones hardly feel them, and
no group size changes the rule.

Limits come from the merged sketches alone. mean_len must lie within 3 interquartile ranges (and a bucket's width) of
the quartiles. The other rates are 0 in most documents, so their limit is the 80th percentile, and 3 times its distance
to the median, and what CHANCE occurrences make in a document of the group's lower-quartile length: chance marks in short
texts aren't junk. The limits are joined back by language and source.

Null text counts as empty; empty text has no words and fails the base rule. Null lang or source is a group of its own.
Repeated rows are judged alike, each counted; an empty table gives an empty result; other columns, whatever their
names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, materialise, spread, table, whole_rows, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Leading bits that a sketch's buckets keep.
BITS = 6
#: Documents that the sketch of the language, and that of all documents, weigh in each group's; and the fixed-point factor of weights.
PRIOR, SCALE = 25, 1024
#: Spreads beyond the quartile or percentile at which a limit lies, and chance occurrences allowed.
SPREADS, CHANCE = 3, 2
#: rate: (what one occurrence adds to it, in a document of length 1; the measure of length).
OCCURRENCE = {"symbol_rate": (1000, "n_words"), "dup_rate": (1000, "n_lines"), "repeat_rate": (2000 * WINDOW, "n_words")}
RATES = ("mean_len", *OCCURRENCE)
SKETCHED = {"mean_len": (25, 75), **{r: (50, 80) for r in OCCURRENCE}, "n_words": (25,), "n_lines": (25,)}
#: limit: its rule over the quantiles.
LIMITS = {
    "lo_mean_len": f"mean_len_25 - {SPREADS} * (mean_len_75 - mean_len_25) - mean_len_25 {{div}} 32",
    "hi_mean_len": f"mean_len_75 + {SPREADS} * (mean_len_75 - mean_len_25) + mean_len_75 {{div}} 32",
    **{f"hi_{r}": f"{r}_80 + {SPREADS} * ({r}_80 - {r}_50) + {CHANCE * one} {{div}} greatest({length}_25, 1)" for r, (one, length) in OCCURRENCE.items()},
}
WITHIN = " AND ".join([f"{r} <= {{0}}hi_{r}" for r in RATES] + ["mean_len >= {0}lo_mean_len"])
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(df: DataFrame, text: Column) -> DataFrame:
    """df with the base counts, n_lines (lines with a word), base_failed and the four rates, whole numbers."""
    d = df.withColumns({"_t": F.coalesce(text, F.lit("")), "_w": words_of(text)})
    d = d.withColumns({"_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(NOT_SPACE)), "_h": F.transform("_w", lambda w: F.xxhash64(w))})
    # Hashes of all windows tell most texts, which repeat none, from the rest; there equal hashes are confirmed on the words.
    hashes = ", ".join(f"_h[i + {k}]" for k in range(WINDOW))
    d = d.withColumn("_win", F.expr(f"CASE WHEN size(_h) > {WINDOW} THEN transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({hashes})) ELSE array() END").cast("array<bigint>"))
    # Sorted (hash, words, place) show repeats as neighbours; array(..)[0] binds the sorted array once.
    repeated = f"""transform(array(sort_array(transform(_win, (h, i) -> struct(h, slice(_w, i + 1, {WINDOW}) AS v, i)))), s -> transform(s, (e, k) ->
        CASE WHEN k > 0 AND s[k - 1].h = e.h AND s[k - 1].v = e.v OR k < size(s) - 1 AND s[k + 1].h = e.h AND s[k + 1].v = e.v THEN e.i END))[0]"""
    covered = f"""CASE WHEN size(_win) = size(array_distinct(_win)) THEN 0L ELSE aggregate(sort_array(filter({repeated}, p -> p IS NOT NULL)),
        named_struct('n', 0L, 'stop', 0L), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.stop), 'stop', p + {WINDOW}L), a -> a.n) END"""
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.expr(covered).cast("long"),
    }).drop("_t", "_w", "_l", "_h", "_win")
    return d.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")).withColumns({
        "mean_len": F.expr("100 * word_chars DIV greatest(n_words, 1L)"),
        "symbol_rate": F.expr("1000 * n_symbols DIV greatest(n_words, 1L)"),
        "dup_rate": F.expr("1000 * n_dup_lines DIV greatest(n_lines, 1L)"),
        "repeat_rate": F.expr("1000 * n_repeat_words DIV greatest(n_words, 1L)"),
    })


def edge(value: str) -> str:
    """SQL for the lower edge of a value's bucket: all but its BITS leading bits cleared."""
    cut = f"greatest(length(bin({value})) - {BITS}, 0)"
    return f"shiftleft(shiftright({value}, {cut}), {cut})"


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by (lkey, skey, rate, edge) of the documents that pass the base rule. A group has at most about 32 edges for each bit of its values."""
    pairs = ", ".join(f"'{r}', {r}" for r in SKETCHED)
    long = measured.filter("NOT base_failed").select("lkey", "skey", F.expr(f"stack({len(SKETCHED)}, {pairs}) AS (rate, value)"))
    return long.groupBy("lkey", "skey", "rate", F.expr(edge("value")).alias("edge")).agg(F.count("*").alias("n"))


def quantile(bins: str, total: str, percent: int) -> str:
    """SQL for the least edge up to which `percent` of a sorted sketch's weights lie."""
    return f"""aggregate({bins}, named_struct('c', 0L, 'v', CAST(NULL AS BIGINT)), (a, b) -> named_struct('c', a.c + b.n, 'v',
        CASE WHEN a.v IS NULL AND 100 * (a.c + b.n) >= {percent} * {total} THEN b.edge ELSE a.v END), a -> a.v)"""


def _bins(sketch: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """A row for each of the keys, with an array of (edge, n) for each sketched measure and the documents in it."""
    merged = sketch.groupBy(*keys, "rate", "edge").agg(F.sum("n").alias("n"))
    of = lambda r: F.when(F.col("rate") == r, F.struct("edge", "n"))
    return merged.groupBy(*keys).agg(F.sum(F.when(F.col("rate") == RATES[0], F.col("n"))).alias(f"{prefix}_total"), *[F.collect_list(of(r)).alias(f"{prefix}_{r}") for r in SKETCHED])


def limits(sketch: DataFrame, prior: int = PRIOR, n_docs: int | None = None) -> DataFrame:
    """(lkey, skey, lim): the LIMITS of each group that has documents past the base rule. n_docs, if known, bounds the rows written."""
    # akey, written out, is a key that joins all groups with the one row for all documents.
    sketch = materialise(sketch.withColumn("akey", F.lit("*")), "quality-sketches", n_docs and n_docs * len(SKETCHED))
    own, lang, every = _bins(sketch, "o", "lkey", "skey", "akey"), _bins(sketch, "l", "lkey"), _bins(sketch, "a", "akey")
    g = own.join(lang, "lkey").join(every, "akey")
    scaled = lambda p, r: f"transform({p}_{r}, x -> struct(x.edge, ({prior * SCALE}L * x.n) DIV {p}_total AS n))"
    g = g.select("lkey", "skey", *[F.expr(f"sort_array(concat(transform(o_{r}, x -> struct(x.edge, {SCALE}L * x.n AS n)), {scaled('l', r)}, {scaled('a', r)}))").alias(f"b_{r}") for r in SKETCHED])
    g = g.select("*", *[F.expr(f"aggregate(b_{r}, 0L, (a, x) -> a + x.n)").alias(f"t_{r}") for r in SKETCHED])
    q = g.select("lkey", "skey", *[F.expr(quantile(f"b_{r}", f"t_{r}", p)).alias(f"{r}_{p}") for r, ps in SKETCHED.items() for p in ps])
    return materialise(q.select("lkey", "skey", F.struct(*[F.expr(rule.format(div="DIV")).alias(name) for name, rule in LIMITS.items()]).alias("lim")), "quality-limits", n_docs)


def keyed(df: DataFrame, lang: Column, source: Column) -> DataFrame:
    """Keys that tell null from any text and from '*'."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return df.withColumns({"lkey": key(lang), "skey": key(source)})


def judged(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """measured with `kept`. The limits are a row per group; Spark broadcasts them only while they are small and splits hot keys otherwise."""
    within = WITHIN.format("lim.")
    return measured.join(chosen, ["lkey", "skey"], "left").withColumn("kept", F.expr(f"NOT base_failed AND {within}"))


def quality_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rates, for every row of docs."""
    measured = keyed(measures(spread(docs.select("doc_id", "text", "lang", "source")), F.col("text")), F.col("lang"), F.col("source")).drop("text", "lang", "source")
    measured = materialise(measured, "quality-measures")
    return judged(measured, limits(sketches(measured), prior, measured.count())).select("doc_id", *BASE, "base_failed", "kept", *RATES)


def filter_documents(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Rows are written once with their measures, so texts are measured once."""
    measured = keyed(measures(spread(whole_rows(docs)), F.col("doc.text")), F.col("doc.lang"), F.col("doc.source"))
    measured = materialise(measured, "quality-measures")
    return judged(measured, limits(sketches(measured), prior, measured.count())).filter("kept").select("doc.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _oracle(docs: str = "documents", doc_out: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, mean_len, symbol_rate, dup_rate, repeat_rate") -> str:
    """DuckDB SQL, by windows that are unnested and grouped."""
    q = ", ".join(f"min(edge) FILTER (rate = '{r}' AND 100 * run >= {p} * total) AS {r}_{p}" for r, ps in SKETCHED.items() for p in ps)
    lim = ", ".join(f"{rule.format(div='//')} AS {name}" for name, rule in LIMITS.items())
    leads = ", ".join(f"lead(x, {k}) OVER z" for k in range(1, WINDOW))
    long = " UNION ALL ".join(f"SELECT lkey, skey, '{r}' AS rate, {r} AS value FROM m WHERE NOT base_failed" for r in SKETCHED)
    return f"""
WITH src AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
t AS (SELECT rid, doc_id, coalesce('=' || lang, '') AS lkey, coalesce('=' || source, '') AS skey, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM src),
win AS (SELECT rid, p, v FROM (SELECT rid, p, [x, {leads}] AS v, lead(x, {WINDOW - 1}) OVER z AS last FROM (SELECT rid, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM t) WINDOW z AS (PARTITION BY rid ORDER BY p)) WHERE last IS NOT NULL),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, v) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p + k) AS n FROM rep, range(0, {WINDOW}) AS r(k) GROUP BY rid),
li AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t)
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
b AS (SELECT t.rid, doc_id, lkey, skey, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
    FROM t LEFT JOIN cov USING (rid) LEFT JOIN li USING (rid)),
m AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, 100 * word_chars // greatest(n_words, 1) AS mean_len,
    1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_rate,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate FROM b),
v AS (SELECT *, greatest(length(bin(value)) - {BITS}, 0) AS cut FROM ({long})),
sk AS (SELECT lkey, skey, rate, (value >> cut) << cut AS edge, count(*)::BIGINT AS n FROM v GROUP BY ALL),
la AS (SELECT *, sum(n) OVER (PARTITION BY lkey, rate)::BIGINT AS total FROM (SELECT lkey, rate, edge, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)),
aa AS (SELECT *, sum(n) OVER (PARTITION BY rate)::BIGINT AS total FROM (SELECT rate, edge, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)),
gr AS (SELECT DISTINCT lkey, skey FROM sk),
mg AS (SELECT lkey, skey, rate, edge, sum(n)::BIGINT AS n FROM (SELECT lkey, skey, rate, edge, {SCALE} * n AS n FROM sk
    UNION ALL SELECT lkey, skey, rate, edge, ({PRIOR * SCALE} * n) // total FROM gr JOIN la USING (lkey) UNION ALL SELECT lkey, skey, rate, edge, ({PRIOR * SCALE} * n) // total FROM gr, aa) GROUP BY ALL),
ru AS (SELECT *, sum(n) OVER (PARTITION BY lkey, skey, rate ORDER BY edge) AS run, sum(n) OVER (PARTITION BY lkey, skey, rate) AS total FROM mg),
qq AS (SELECT lkey, skey, {q} FROM ru GROUP BY lkey, skey),
lim AS (SELECT lkey, skey, {lim} FROM qq),
res AS (SELECT m.*, (NOT base_failed AND {WITHIN.format("")}) AS kept FROM m LEFT JOIN lim USING (lkey, skey))
SELECT {doc_out} FROM res"""


ORACLE = _oracle()
