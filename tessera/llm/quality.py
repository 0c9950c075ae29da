"""Quality rules: text statistics, then a hashed n-gram likelihood ratio of trusted text against the raw corpus.

DataFrame functions only. Tokens are runs of letters and digits or of other visible characters, in lower case; unigrams
and bigrams fall into BUCKETS by CRC-32. The target multinomial counts all documents labelled as good, the
raw one counts every document. Weights are rounded to millionths, so sums are
whole numbers and a verdict never depends on their order.

Defined results: a null text has no words and fails; a text without n-grams has ratio 0; without trusted documents all
weights are 0; equal rows get equal verdicts; a null doc_id is just never a trusted one; other columns are kept unless
they have the name of an added one; names that begin with `_q` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 10_000
BLANKS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]+"
#: a-z and 0-9 are letters and digits anyhow; named first, they are told by one look-up.
TOKEN = "[a-z0-9\\p{L}\\p{N}]++|[^a-z0-9\\p{L}\\p{N}\\x20\\x09-\\x0D]++"
#: N-grams of the raw corpus's mixture that are lent to the target: a small trusted set stays near ratio 0.
PRIOR = 10_000.0
#: Mean millionths for each n-gram below which a document goes, and n-grams of ratio 0 lent to every document.
LEAST_MEAN = -100_000
LENT = 20
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "ratio_sum", "kept")


def _at(c: str, i: Column) -> Column:
    return F.get(F.col(c), i)


def _doubled(c: str, n: int) -> Column:
    return F.transform(c, lambda x, i: F.shiftleft(x, n).bitwiseXOR(_at(c, i + n)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the five base counts and base_failed. Windows are hashed first; only where two hashes agree are the
    words themselves compared, so the count is exact."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.withColumn("_q_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    d = d.withColumns(
        {
            "_q_lines": lines,
            "_q_1": F.transform("_q_words", lambda w: F.xxhash64(w)),
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    # hashes of runs of 2, 4 and 8 words, each made of two of half the length; the last ones reach over the end: null
    for n in (1, 2, 4):
        d = d.withColumn(f"_q_{2 * n}", _doubled(f"_q_{n}", n))
    d = d.withColumns({"_q_windows": F.slice("_q_8", F.lit(1), F.greatest(F.size("_q_8") - 7, F.lit(0))), "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long")})
    d = d.withColumn("_q_some", F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"))
    by_hash = F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("w"), i.alias("i"))))
    d = d.withColumn("_q_sorted", F.when(F.col("_q_some"), by_hash))

    def neighbours(c: str) -> Column:
        """The starts beside which stands an equal window."""
        same = lambda x, q: F.coalesce(_at(c, q)["w"] == x["w"], F.lit(False))
        return F.transform(F.filter(c, lambda x, p: (p > 0) & same(x, p - 1) | same(x, p + 1)), lambda x: x["i"])

    d = d.withColumn("_q_some", neighbours("_q_sorted"))
    words = lambda i: F.array_join(F.slice("_q_words", i + 1, 8), " ")
    d = d.withColumn("_q_sorted", F.sort_array(F.transform("_q_some", lambda i: F.struct(words(i).alias("w"), i.alias("i")))))
    d = d.withColumn("_q_hit", F.sort_array(neighbours("_q_sorted")))
    # a start covers eight words, or as many as lie before the next start
    covered = F.aggregate("_q_hit", F.struct(F.lit(0).cast("int").alias("n"), F.lit(-8).cast("int").alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(8), i - s["last"])).alias("n"), i.alias("last")))
    d = d.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _codes(docs: DataFrame) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0))
    return docs.withColumn("_q_codes", F.transform(tokens, lambda t: F.crc32(t.cast("binary"))))


def _buckets(codes: str = "_q_codes") -> Column:
    """Buckets of all unigrams, then of all bigrams and a null for the one that begins before the text."""
    one = F.transform(F.col(codes), lambda c: (c % BUCKETS).cast("int"))
    return F.concat(one, _pairs(codes))


def _pairs(codes: str) -> Column:
    return F.transform(F.col(codes), lambda c, i: ((_at(codes, i - 1) * 31 + c) % BUCKETS).cast("int"))


def weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """The log ratio of each bucket in millionths. One row for each bucket reaches the driver, however large the corpus."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_q_id")).distinct().withColumn("_q_good", F.lit(1))
    # hashed, so that texts are not sorted; rows without id are spread by their texts (a literal 0 as
    # the other side's key would be taken out of the join, and the salt with it)
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    both = docs.select("doc_id", "text", salt.alias("_q_salt")).join(good.withColumn("_q_none", F.pmod("_q_id", F.lit(1))).hint("shuffle_hash"), (F.col("doc_id") == F.col("_q_id")) & (F.col("_q_salt") == F.col("_q_none")), "left")
    rows = _codes(both.select(F.coalesce("_q_good", F.lit(0)).alias("good"), "text")).select("good", F.explode(_buckets()).alias("b")).filter("b is not null")
    # counted for each bucket and kind first: a bucket that a third of all n-grams have is summed where it is read
    counts = rows.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0] * BUCKETS
    import math

    share = [(n + 1.0) / (all_raw + BUCKETS) for n in raw]
    return [math.floor(1e6 * math.log((t + PRIOR * q) / (all_target + PRIOR) / q) + 0.5) for t, q in zip(target, share)]


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, n_grams, ratio_sum (millionths) and kept."""
    docs = docs.select(*[c for c in docs.columns if c not in ADDED and not c.startswith("_q")])
    model = F.from_json(F.lit("[" + ",".join(map(str, weights(docs, labels))) + "]"), "array<int>")
    d = _codes(statistics(docs))
    d = d.withColumn("n_grams", F.greatest(F.lit(0), 2 * F.size("_q_codes") - 1).cast("long"))
    look = lambda b: F.get(model, b)
    d = d.withColumn("_q_pairs", _pairs("_q_codes"))
    ones = F.aggregate("_q_codes", F.lit(0).cast("long"), lambda s, c: s + look((c % BUCKETS).cast("int")))
    d = d.withColumn("ratio_sum", F.aggregate(F.slice("_q_pairs", F.lit(2), F.size("_q_pairs")), ones, lambda s, b: s + look(b)))
    good = F.col("ratio_sum") >= LEAST_MEAN * (F.col("n_grams") + LENT)
    return d.withColumn("kept", ~F.col("base_failed") & good).select(*docs.columns, *ADDED)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with assess()'s columns. The verdicts are written first: as a filter on what is yet to be
    computed, Spark would push them down to the scan and compute every list anew for each of its elements."""
    return cut(assess(docs, labels), "verdicts").filter("kept")


#: The query in DuckDB's SQL.
ORACLE = rf"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM doc),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS x FROM pos),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
tok AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM
  (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\x20\x09-\x0D]+') AS ts FROM doc)),
byt AS (SELECT t, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bs
  FROM (SELECT t, hex(encode(t)) AS h FROM (SELECT DISTINCT t FROM tok))),
crc AS (SELECT t, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS c FROM byt, tab),
seq AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM tok JOIN crc USING (t)),
gram AS (SELECT doc_id, c % {BUCKETS} AS b FROM seq UNION ALL SELECT doc_id, (p * 31 + c) % {BUCKETS} FROM seq WHERE p IS NOT NULL),
cnt AS (SELECT b, count(*) AS raw, count(l.doc_id) AS target FROM gram LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY b),
tot AS (SELECT sum(raw)::DOUBLE AS r, sum(target)::DOUBLE AS t FROM cnt),
wt AS (SELECT b, floor(1e6 * ln((target + {PRIOR}::DOUBLE * ((raw + 1.0::DOUBLE) / (r + {BUCKETS}))) / (t + {PRIOR}::DOUBLE) / ((raw + 1.0::DOUBLE) / (r + {BUCKETS}))) + 0.5)::BIGINT AS v FROM cnt, tot),
sc AS (SELECT doc_id, count(*) AS n, sum(v)::BIGINT AS s FROM gram JOIN wt USING (b) GROUP BY doc_id),
fin AS (SELECT base.*, coalesce(n, 0)::BIGINT AS n_grams, coalesce(s, 0)::BIGINT AS ratio_sum,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base LEFT JOIN sc USING (doc_id))
SELECT *, NOT base_failed AND ratio_sum >= {LEAST_MEAN} * (n_grams + {LENT}) AS kept FROM fin
"""
