"""Queries over the driver's tables for every operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.hashes import PolynomialHash, TabulationHash, bucket, murmur32_sql, murmur32_udf, pair_key, sign
from ..operators import association, pairs, sketches, topk, train
from ..operators.learners import Spec
from ..operators.sketches import SketchConfig
from ..sources import libsvm, text
from . import examples as ex
from .examples import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
POLY, TAB = PolynomialHash(3, 7), TabulationHash(2, 7)
CMS, CS, PAIRED = SketchConfig(8, 2, 11), SketchConfig(8, 3, 13, tabulation=True), SketchConfig(13, 2, 17)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# sources, scans, samples


@query("SELECT count(*) AS num_examples, count(DISTINCT event_type = 'purchase') AS num_classes, count(*) FILTER (event_type = 'purchase') AS positives, max(user_id) + 1 AS feature_dim, count(*) AS num_features FROM events")
def label_stats(spark, d):
    e = ex.events(spark, d)
    dim = F.max(F.array_max(F.transform("features", lambda f: f["key"]))) + 1
    return e.agg(F.count("*").alias("num_examples"), F.count_distinct("label").alias("num_classes"), F.count_if(F.col("label") == 1).alias("positives"), dim.alias("feature_dim"), F.sum(F.size("features")).alias("num_features"))


@query("SELECT max(l_partkey) + 1 AS feature_dim FROM lineitem")
def feature_dim(spark, d):
    rows = table(spark, d, "lineitem").select(F.array(ex.feature(F.col("l_partkey"))).alias("features"))
    return libsvm.feature_dim(rows)


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE 2 END AS label, [o_custkey, 7, o_custkey] AS keys, [0.5, 7.0, 2.0] AS values FROM orders")
def libsvm_parse(spark, d):
    o = table(spark, d, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "+1").when(F.col("o_orderstatus") == "O", "-1").otherwise("2.5")
    lines = o.select(F.col("o_orderkey").alias("seq"), F.concat_ws(" ", label, F.concat("o_custkey", F.lit(":0.5")), F.lit("7"), F.concat("o_custkey", F.lit(":2"))).alias("value"))
    return libsvm.parse(lines).select("seq", "label", F.transform("features", lambda f: f["key"]).alias("keys"), F.transform("features", lambda f: f["value"].cast("double")).alias("values"))


@query("SELECT epoch, label, count(*) AS n FROM (SELECT quality AS label FROM labels), (SELECT unnest([0, 1, 2]) AS epoch) GROUP BY ALL")
def epoch_scan(spark, d):
    return libsvm.epochs(ex.judged(spark, d), 3).groupBy("epoch", "label").agg(F.count("*").alias("n"))


@query(f"SELECT i AS draw, s_suppkey, s_acctbal FROM (SELECT i, {POLY.sql('i')} % (SELECT count(*) FROM supplier) AS n FROM range(500) t(i)) JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier) USING (n)")
def sample_with_replacement(spark, d):
    rows = libsvm.numbered(table(spark, d, "supplier"), "s_suppkey")
    n = rows.count()
    return libsvm.sample_with_replacement(rows, 500, F.pmod(POLY.column(F.col("i")), F.lit(n)), by="n").select("draw", "s_suppkey", "s_acctbal")


# scalars and hashes

_KEYS = "(SELECT DISTINCT l_partkey AS key FROM lineitem)"


def _keys(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct()


@query("SELECT c_custkey, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(ln(1 + exp(-x)), 9) AS loss, round(-1 / (1 + exp(x)), 9) AS grad FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def sigmoid_grad_loss(spark, d):
    x = F.col("c_acctbal") / 1000
    return table(spark, d, "customer").select("c_custkey", F.round(scalars.sigmoid(x), 9).alias("sigmoid"), F.round(scalars.logistic_loss(x), 9).alias("loss"), F.round(scalars.logistic_grad(x), 9).alias("grad"))


@query(f"SELECT key, {POLY.sql('key', 0)} AS h0, {POLY.sql('key', 2)} AS h2 FROM {_KEYS}")
def poly_hash(spark, d):
    k = F.col("key")
    return _keys(spark, d).select("key", POLY.column(k, 0).alias("h0"), POLY.column(k, 2).alias("h2"))


@query(f"SELECT key, {TAB.sql('key', 0)} AS h0, {TAB.sql('key', 1)} AS h1 FROM {_KEYS}")
def tab_hash(spark, d):
    k = F.col("key")
    return _keys(spark, d).select("key", TAB.column(k, 0).alias("h0"), TAB.column(k, 1).alias("h1"))


@query(f"SELECT key, CASE WHEN (h >> 31) & 1 = 1 THEN 1 ELSE -1 END AS sign, CAST(h & 255 AS INTEGER) AS bucket FROM (SELECT key, {TAB.sql('key')} AS h FROM {_KEYS})")
def sign_bucket(spark, d):
    h = TAB.column(F.col("key"))
    return _keys(spark, d).select("key", sign(h).alias("sign"), bucket(h, 8).alias("bucket"))


@query(f"SELECT DISTINCT p_brand, p_type, (101 * {murmur32_sql('p_brand', 42)} + {murmur32_sql('p_type', 42)}) % 4294967296 AS key FROM part")
def murmur_pair_key(spark, d):
    """Keys of the pairs of a part's brand and type."""
    h = murmur32_udf(42)
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    return p.select("p_brand", "p_type", pair_key(h("p_brand"), h("p_type")).alias("key"))


# sketches


def _cms_sql(source: str, key: str, c: SketchConfig, more: str = "", width: int | None = None) -> str:
    w = (1 << (c.log2_width if width is None else width)) - 1
    return " UNION ALL ".join(f"SELECT {i} AS row, {c.hash.sql(key, i)} AS h, CAST({c.hash.sql(key, i)} & {w} AS INTEGER) AS bucket{more} FROM {source}" for i in range(c.depth))


_CMS = f"SELECT row, bucket, count(*) AS cnt FROM ({_cms_sql('lineitem', 'l_partkey', CMS)}) GROUP BY ALL"


@query(_CMS)
def cms_table(spark, d):
    return sketches.count_min(table(spark, d, "lineitem"), F.col("l_partkey"), CMS)


@query(f"SELECT key, min(cnt) AS estimate FROM ({_cms_sql(_KEYS, 'key', CMS, ', key')}) JOIN ({_CMS}) USING (row, bucket) GROUP BY key")
def cms_point_query(spark, d):
    return sketches.count_min_query(cms_table(spark, d), _keys(spark, d), CMS)


_CS = f"SELECT row, bucket, sum(CASE WHEN (h >> 31) & 1 = 1 THEN q ELSE -q END) AS weight FROM ({_cms_sql('lineitem', 'l_partkey', CS, ', l_quantity AS q')}) GROUP BY ALL"


@query(_CS)
def countsketch_table(spark, d):
    return sketches.count_sketch(table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_quantity"), CS)


@query(f"SELECT key, median(CASE WHEN (h >> 31) & 1 = 1 THEN weight ELSE -weight END) AS estimate FROM ({_cms_sql(_KEYS, 'key', CS, ', key')}) JOIN ({_CS}) USING (row, bucket) GROUP BY key")
def countsketch_query(spark, d):
    return sketches.count_sketch_query(countsketch_table(spark, d), _keys(spark, d), CS)


_TOKENS = """(SELECT doc_id, toxic AS label, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS token FROM documents JOIN labels USING (doc_id))"""
_KEYED = f"(SELECT CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS key, label, token FROM {_TOKENS})"


def _toxic_tokens(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    rows = docs.select("label", F.explode(scalars.tokens(F.col("text"))).alias("token"))
    classes = docs.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return rows.select("label", "token", ex.token_key(F.col("token")).alias("key")), classes


@query(f"""WITH f AS {_KEYED}, sk AS (SELECT row, bucket, count(*) FILTER (label = 1) AS num, count(*) FILTER (label <> 1) AS den FROM ({_cms_sql('f', 'key', PAIRED, ', label', PAIRED.log2_width - 1)}) GROUP BY ALL),
k AS (SELECT DISTINCT key FROM f), c AS (SELECT count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic <> 1) AS neg FROM documents JOIN labels USING (doc_id)),
l AS (SELECT key, min(num) AS num, min(den) AS den FROM ({_cms_sql('k', 'key', PAIRED, ', key', PAIRED.log2_width - 1)}) JOIN sk USING (row, bucket) GROUP BY key),
w AS (SELECT key, ln((num + 1.0::DOUBLE) / (den + 1.0::DOUBLE) / ((pos + 1.0::DOUBLE) / (neg + 1.0::DOUBLE))) AS weight FROM l, c)
SELECT key, round(weight, 9) AS weight FROM w ORDER BY round(abs(weight), 9) DESC, key LIMIT 100""")
def paired_cms_topk(spark, d):
    """Which tokens tell toxic documents? By log ratios of a paired Count-Min sketch."""
    rows, classes = _toxic_tokens(spark, d)
    sketch = sketches.paired_count_min(rows, PAIRED)
    ratios = sketches.paired_ratios(sketch, rows.select("key"), classes, PAIRED)
    w = ratios.select("key", F.round("weight", 9).alias("weight"))
    return topk.top_by_magnitude(w, 100, "weight", "key")


_CELLS = 1 << CMS.log2_width
_RAISED = f"""WITH e AS (SELECT l_returnflag AS model_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey, [{', '.join(f"{i * _CELLS + 1} + ({CMS.hash.sql('l_partkey', i)} & {_CELLS - 1})" for i in range(CMS.depth))}] AS places FROM lineitem),
g AS (SELECT model_id, list_prepend({{'p': []::BIGINT[], 't': list_transform(range({CMS.depth * _CELLS}), lambda x: 0::BIGINT)}}, list({{'p': places, 't': []::BIGINT[]}} ORDER BY seq, l_partkey)) AS es FROM e GROUP BY model_id),
f AS (SELECT model_id, list_reduce(es, lambda a, e: {{'p': e.p, 't': list_transform(a.t, lambda v, i: CASE WHEN list_contains(e.p, i) THEN greatest(v, list_min(list_transform(e.p, lambda j: a.t[j])) + 1) ELSE v END)}}).t AS t FROM g)
SELECT model_id, CAST((i - 1) // {_CELLS} AS INTEGER) AS row, CAST((i - 1) % {_CELLS} AS INTEGER) AS bucket, cnt FROM (SELECT model_id, unnest(t) AS cnt, generate_subscripts(t, 1) AS i FROM f) WHERE cnt > 0"""


@query(_RAISED)
def cms_conservative(spark, d):
    """Conservative Count-Min over lineitem in order, one sketch for each return flag."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("key"))
    return sketches.conservative(rows, CMS)


@query(f"SELECT token AS key, count(*) AS cnt FROM {_TOKENS} GROUP BY token HAVING count(*) > 0.002 * (SELECT count(*) FROM {_TOKENS})")
def heavy_hitters(spark, d):
    """Tokens that make up more than a 500th of the judged documents."""
    rows, _ = _toxic_tokens(spark, d)
    return sketches.heavy_hitters(rows, "token", 0.002)


_TAIL = f"SELECT row, bucket, sum(CASE WHEN (h >> 31) & 1 = 1 THEN q ELSE -q END) AS weight FROM ({_cms_sql('(SELECT doc_id % 14 + 2 AS key, quality - 0.75 AS q FROM labels)', 'key', CS, ', q')}) GROUP BY ALL"


@query(f"""WITH f AS (SELECT doc_id AS seq, quality AS label, toxic AS key, 1.0::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, quality, doc_id % 14 + 2, 0.5 FROM labels),
k AS (SELECT DISTINCT key FROM f WHERE key > 4), e AS (SELECT key, median(CASE WHEN (h >> 31) & 1 = 1 THEN coalesce(weight, 0) ELSE -coalesce(weight, 0) END) AS weight FROM ({_cms_sql('k', 'key', CS, ', key')}) LEFT JOIN ({_TAIL}) USING (row, bucket) GROUP BY key
 UNION ALL SELECT key, key - 2.5 FROM range(5) t(key))
SELECT seq, label, round(sum(weight * value) + 0.125, 6) AS z FROM f JOIN e USING (key) GROUP BY ALL""")
def active_set_tables(spark, d):
    """Five exact weights and a Count-Sketch of the others, as tables, score documents."""
    rows = table(spark, d, "labels").select((F.col("doc_id") % 14 + 2).alias("key"), (F.col("quality") - 0.75).cast("double").alias("q"))
    active = spark.range(5).select(F.col("id").alias("key"), (F.col("id") - 2.5).cast("double").alias("weight"))
    sketch = sketches.count_sketch(rows, F.col("key"), F.col("q"), CS)
    return sketches.active_set_scores(ex.judged(spark, d), active, sketch, CS, 0.125).select("seq", "label", F.round("z", 6).alias("z"))


@query("SELECT l_returnflag, avg(l_quantity) AS mean, median(l_quantity) AS median FROM lineitem GROUP BY ALL")
def mean_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("median"))


# top-k and reservoirs


@query("SELECT s_suppkey AS key, s_acctbal AS weight FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 25")
def exact_topk_abs(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("weight"))
    return topk.top_by_magnitude(rows, 25, "weight", "key")


@query("SELECT o_custkey AS key, count(*) AS cnt FROM orders GROUP BY 1 ORDER BY cnt DESC, key LIMIT 25")
def topk_count(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("cnt"))
    return topk.top_by_count(rows, 25, "cnt", "key")


@query("SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def topk_per_group(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return topk.top_per_group(rows, "c_nationkey", 3, "c_acctbal", "c_custkey")


def _uniform(key: Column) -> Column:
    return (POLY.column(key, 1) + 1) / float(1 << 31)


@query(f"SELECT c_custkey AS key, round(r, 6) AS r FROM (SELECT c_custkey, pow(abs(c_acctbal), 0.5) * ln(({POLY.sql('c_custkey', 1)} + 1) / 2147483648.0::DOUBLE) AS r FROM customer) ORDER BY r, c_custkey LIMIT 50")
def weighted_reservoir(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("weight"))
    return topk.weighted_reservoir(rows, 50, _uniform(F.col("key")), "weight", 0.5, "key").select("key", F.round("r", 6).alias("r"))


@query(f"SELECT c_custkey AS key, ({POLY.sql('c_custkey', 1)} + 1) / 2147483648.0::DOUBLE AS r FROM customer ORDER BY r, key LIMIT 50")
def uniform_reservoir(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return topk.uniform_reservoir(rows, 50, _uniform(F.col("key")), "key")


# pairs and association

_LINES = """(SELECT conv_id * 1000 + turn AS doc, unnest(generate_series(1, len(ls))) AS line, ls[unnest(generate_series(1, len(ls)))] AS txt FROM (SELECT *, string_split(text, chr(10)) AS ls FROM conversations WHERE text IS NOT NULL))"""
_LT = f"""(SELECT doc, line, list_filter(regexp_split_to_array(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS ts FROM {_LINES})"""
_POS = f"(SELECT doc, line, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM {_LT})"
_PAIRS = f"(SELECT x.token AS a, y.token AS b, x.pos, y.pos - x.pos AS dist, doc, line FROM {_POS} x JOIN {_POS} y USING (doc, line) WHERE x.pos < y.pos AND y.pos <= x.pos + 5)"


@query(f"SELECT a, b, count(*) AS cnt FROM {_PAIRS} GROUP BY ALL")
def skipgram_pairs(spark, d):
    return pairs.skipgrams(ex.turn_lines(spark, d), 5).groupBy("a", "b").agg(F.count("*").alias("cnt"))


@query(f"SELECT CAST(dist AS INTEGER) AS dist, count(*) AS n, count(DISTINCT a) AS left_words FROM {_PAIRS} GROUP BY ALL")
def skipgram_windows(spark, d):
    """The same pairs by distance, with the window function form: lead by 1 to 5."""
    rows = text.token_rows(ex.turn_lines(spark, d))
    w = Window.partitionBy("doc", "line").orderBy("pos")
    ahead = rows.select("token", *[F.lead("token", i).over(w).alias(f"b{i}") for i in range(1, 6)])
    each = ahead.select(F.col("token").alias("a"), F.posexplode(F.array(*[F.col(f"b{i}") for i in range(1, 6)])).alias("i", "b")).where("b is not null")
    return each.groupBy((F.col("i") + 1).alias("dist")).agg(F.count("*").alias("n"), F.count_distinct("a").alias("left_words"))


@query(f"SELECT token, count(*) AS cnt FROM {_POS} GROUP BY ALL")
def unigram_counts(spark, d):
    return pairs.unigrams(ex.turn_lines(spark, d))


_PMI = f"""WITH c AS (SELECT a, b, count(*) AS cnt FROM {_PAIRS} GROUP BY ALL), l AS (SELECT a, sum(cnt) AS ca FROM c GROUP BY a), r AS (SELECT b, sum(cnt) AS cb FROM c GROUP BY b), n AS (SELECT sum(cnt) AS n FROM c)
SELECT a, b, cnt, round(ln(CAST(cnt AS DOUBLE) * n / (CAST(ca AS DOUBLE) * cb)), 9) AS pmi FROM c JOIN l USING (a) JOIN r USING (b), n WHERE cnt >= 5"""


@query(f"SELECT * FROM ({_PMI}) WHERE pmi >= 0 ORDER BY pmi DESC, a, b LIMIT 100")
def pmi_topk(spark, d):
    found = pairs.pmi(ex.turn_lines(spark, d), 5, least=5)
    kept = found.select("a", "b", "cnt", F.round("pmi", 9).alias("pmi")).where("pmi >= 0")
    return kept.orderBy(F.col("pmi").desc(), "a", "b").limit(100)


@query(f"""WITH u AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS slot FROM (SELECT token, count(*) AS n FROM {_POS} GROUP BY token ORDER BY n DESC, token LIMIT 64)),
p AS (SELECT doc * 100000 + line * 1000 + pos * 10 + dist AS id, a, b FROM {_PAIRS}), f AS (SELECT id, a, b, j, {POLY.sql('id * 8 + j')} AS h FROM p, (SELECT unnest([1, 2]) AS j)),
m AS (SELECT CASE WHEN (h >> 20) & 1 = 0 THEN a ELSE token END AS a, CASE WHEN (h >> 20) & 1 = 0 THEN token ELSE b END AS b FROM f JOIN u ON u.slot = h % 64)
SELECT r AS real, count(*) AS n, count(DISTINCT a || ' ' || b) AS distinct_pairs FROM (SELECT a, b, true AS r FROM p UNION ALL SELECT a, b, false FROM m) GROUP BY r""")
def negative_samples(spark, d):
    """Each pair with two corrupted ones, drawn by hashes from 64 frequent words."""
    lines = ex.turn_lines(spark, d)
    slots = pairs.unigrams(lines).orderBy(F.col("cnt").desc(), "token").limit(64)
    slots = slots.select("token", (F.row_number().over(Window.orderBy("token")) - 1).cast("bigint").alias("slot"))
    rows = pairs.skipgrams_ordered(lines, 5, "tokens", "doc", "line")
    rows = rows.select("a", "b", (F.col("doc") * 100000 + (F.col("line") + 1) * 1000 + (F.col("pos") + 1) * 10 + F.col("dist")).alias("id"))
    h = POLY.column(F.col("id") * 8 + F.col("j"))
    made = pairs.negatives(rows, slots, 64, 2, h, F.shiftright(h, 20).bitwiseAND(F.lit(1)))
    return made.groupBy("real").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws(" ", "a", "b")).alias("distinct_pairs"))


@query()
def pmi_stream(spark, d):
    """Streaming PMI over the lines of all documents in bounded memory, by one model."""
    return association.fit_pmi(ex.document_lines(spark, d), k=1024, log2_width=12, window=5, negatives=5, reservoir=4000, seed=1)


@query()
def pmi_shards(spark, d):
    """The same by eight models of an eighth of the documents each, in parallel."""
    return association.fit_pmi(ex.document_lines(spark, d), shards=8, k=1024, log2_width=12, window=5, negatives=5, reservoir=4000, seed=1)


# learners: in these settings each method must equal plain logistic regression

_RATE, _L2, _DIM = 0.1, 1e-3, 16
_FIT = f"""WITH RECURSIVE ex AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS t, doc_id AS seq, quality AS label, toxic + 1 AS i, doc_id % 14 + 3 AS j FROM labels),
fit AS (SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS seq, 0 AS label, CAST(0 AS DOUBLE) AS bias, list_transform(range({_DIM}), lambda x: CAST(0 AS DOUBLE)) AS w, CAST(0 AS DOUBLE) AS z
 UNION ALL SELECT t + 1, seq, label, bias - {_RATE}::DOUBLE / (1 + {_RATE * _L2!r}::DOUBLE * t) * y * g, list_transform(w, lambda x, n: CASE WHEN n = i THEN x - {_RATE / (1 - _RATE * _L2)!r}::DOUBLE * y * g WHEN n = j THEN x - {_RATE / (1 - _RATE * _L2)!r}::DOUBLE * y * g * 0.5 ELSE x END), z
 FROM (SELECT *, -1 / (1 + exp(y * z)) AS g FROM (SELECT f.t, e.seq, e.label, f.bias, f.w, i, j, CASE WHEN e.label = 1 THEN 1 ELSE -1 END AS y, {1 - _RATE * _L2!r}::DOUBLE / (1 + {_RATE * _L2!r}::DOUBLE * (f.t - 1)) * (f.w[i] + f.w[j] * 0.5) + f.bias AS z FROM fit f JOIN ex e ON e.t = f.t))),
last AS (SELECT *, {1 - _RATE * _L2!r}::DOUBLE / (1 + {_RATE * _L2!r}::DOUBLE * (t - 1)) AS scale FROM fit ORDER BY t DESC LIMIT 1)"""
_WEIGHTS = _FIT + " SELECT key, round(weight, 9) AS weight FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS key, unnest(w) * scale AS weight FROM last UNION ALL SELECT CAST(-1 AS BIGINT), bias FROM last) WHERE key = -1 OR key < 16"
_STATS = _FIT + " SELECT sum(CASE WHEN (z >= 0) <> (label = 1) THEN 1 ELSE 0 END)::BIGINT AS err_count, count(*) AS count, round((SELECT bias FROM last), 9) AS bias FROM fit WHERE seq IS NOT NULL"


def _model(spark, d, method: str, **params) -> DataFrame:
    return train.fit(ex.judged(spark, d), Spec(method, rate=_RATE, l2=_L2, seed=3, **params))


def _budgeted(method: str, examples: str, k: int, cells: int, hashes: str, rate: float, l2: float, key: str = "BIGINT") -> str:
    """A fold over examples (t, seq, key, label) of one feature each: the state after each
    of them, and z before it. w, who, cnt and tick are the store; tab is the sketch (for
    countmin, counts)."""
    c, step = rate * l2, rate / (1 - rate * l2)
    least = {"truncated": "list_transform(w, lambda x: abs(x))", "active_set": "list_transform(w, lambda x: abs(x))"}.get(method, "list_transform(cnt, lambda x, i: x * 1000000000 + tick[i])")
    x = "CASE WHEN pos > 0 THEN w[pos] ELSE " + ("g * tab[c]" if method == "active_set" else "0") + " END"
    n = "CASE WHEN pos > 0 THEN cnt[pos] + 1 ELSE " + {"spacesaving": f"CASE WHEN len(who) < {k} THEN 1 ELSE cnt[m] + 1 END", "countmin": "tab[c]::BIGINT + 1"}.get(method, "0") + " END"
    enters = {"spacesaving": "true", "countmin": "n >= cnt[m]"}.get(method, "abs(new) >= abs(w[m])")
    change = lambda l, v: f"CASE WHEN act = 'add' THEN list_append({l}, {v}) WHEN act = 'stay' THEN {l} ELSE list_transform({l}, lambda q, i: CASE WHEN i = slot THEN {v} ELSE q END) END"
    tab = {"active_set": "list_transform(tab, lambda q, i: CASE WHEN act = 'stay' AND i = c THEN q - step * g WHEN act = 'swap' AND i = oc[m] THEN og[m] * w[m] ELSE q END)", "countmin": "list_transform(tab, lambda q, i: CASE WHEN i = c THEN q + 1 ELSE q END)"}.get(method, "tab")
    return f"""WITH RECURSIVE ex AS (SELECT *, {hashes} FROM {examples}),
fit AS (SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS seq, 0 AS label, CAST(0 AS DOUBLE) AS bias, CAST(0 AS DOUBLE) AS z, []::DOUBLE[] AS w, []::{key}[] AS who, []::BIGINT[] AS cnt, []::BIGINT[] AS tick, []::BIGINT[] AS oc, []::DOUBLE[] AS og, list_transform(range({cells}), lambda x: CAST(0 AS DOUBLE)) AS tab
 UNION ALL SELECT t + 1, seq, label, bias - {rate!r}::DOUBLE / (1 + {c!r}::DOUBLE * t) * y * gr, z, {change('w', 'new')}, {change('who', 'key')}, {change('cnt', 'n')}, {change('tick', 't')}, {change('oc', 'c')}, {change('og', 'g')}, {tab}
 FROM (SELECT *, CASE WHEN pos > 0 THEN 'set' WHEN len(who) < {k} THEN 'add' WHEN {enters} THEN 'swap' ELSE 'stay' END AS act, CASE WHEN pos > 0 THEN pos ELSE m END AS slot
 FROM (SELECT *, x - step AS new, {n} AS n FROM (SELECT *, {step!r}::DOUBLE * y * gr AS step FROM (SELECT *, -1 / (1 + exp(y * z)) AS gr FROM (SELECT *, {1 - c!r}::DOUBLE / (1 + {c!r}::DOUBLE * (t - 1)) * x + bias AS z
 FROM (SELECT *, {x} AS x FROM (SELECT f.* EXCLUDE (seq, label, z), e.seq, e.label, e.key, e.c, e.g, CASE WHEN e.label = 1 THEN 1 ELSE -1 END AS y, coalesce(list_position(who, e.key), 0) AS pos, list_position({least}, list_min({least})) AS m FROM fit f JOIN ex e ON e.t = f.t)))))))),
last AS (SELECT *, {1 - c!r}::DOUBLE / (1 + {c!r}::DOUBLE * (t - 1)) AS scale FROM fit ORDER BY t DESC LIMIT 1)"""


_ONE = "(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS t, doc_id AS seq, doc_id % 14 AS key, quality AS label FROM labels)"
_EVENTS = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS t, event_id AS seq, user_id AS key, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events)"
_NONE = "1 AS c, CAST(1 AS DOUBLE) AS g"
_STORED = " SELECT who AS key, round(weight, 9) AS weight FROM (SELECT unnest(who) AS who, unnest(w) * scale AS weight FROM last UNION ALL SELECT CAST(-1 AS BIGINT), bias FROM last)"


def _tabulated(bits: int, seed: int, key: str = "key") -> str:
    h = TabulationHash(1, seed).sql(key)
    return f"({h} & {(1 << bits) - 1}) + 1 AS c, CASE WHEN ({h} >> 31) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g"


def _counted(bits: int, seed: int) -> str:
    return f"({PolynomialHash(1, seed).sql('key')} & {(1 << bits) - 1}) + 1 AS c, CAST(1 AS DOUBLE) AS g"


def _small_model(spark, d, method: str, k: int) -> DataFrame:
    """Three or four weights for 14 features, and four cells: something always goes."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("seq"), F.col("quality").alias("label"), F.array(ex.feature(F.col("doc_id") % 14)).alias("features"))
    return _weights(train.fit(rows, Spec(method, k=k, log2_width=2, rate=_RATE, l2=_L2, seed=3)))


def _weights(model: DataFrame) -> DataFrame:
    return model.where("kind in ('weight', 'bias')").select(F.coalesce("key", F.lit(-1)).alias("key"), F.round("weight", 9).alias("weight"))


def _stats(model: DataFrame) -> DataFrame:
    return model.agg(F.max(F.when(F.col("kind") == "stat", F.col("weight"))).cast("bigint").alias("err_count"), F.max(F.when(F.col("kind") == "stat", F.col("n"))).alias("count"), F.round(F.max(F.when(F.col("kind") == "bias", F.col("weight"))), 9).alias("bias"))


@query(_WEIGHTS)
def lr_fit(spark, d):
    return _weights(_model(spark, d, "logistic", k=64))


@query(_WEIGHTS)
def truncated_full(spark, d):
    return _weights(_model(spark, d, "truncated", k=64))


@query(_WEIGHTS)
def prob_truncated_full(spark, d):
    return _weights(_model(spark, d, "prob_truncated", k=64))


@query(_WEIGHTS)
def spacesaving_full(spark, d):
    return _weights(_model(spark, d, "spacesaving", k=64))


@query(_WEIGHTS)
def countmin_full(spark, d):
    return _weights(_model(spark, d, "countmin", k=64))


@query(_WEIGHTS)
def active_set_full(spark, d):
    return _weights(_model(spark, d, "active_set", k=64))


@query(_WEIGHTS)
def sketch_injective(spark, d):
    return _weights(_model(spark, d, "logistic_sketch", k=64, depth=3, log2_width=5, exact_hash=True))


@query(_WEIGHTS)
def sketch_injective_median(spark, d):
    return _weights(_model(spark, d, "logistic_sketch", k=64, depth=3, log2_width=5, exact_hash=True, median=True))


@query(_budgeted("truncated", _ONE, 4, 1, _NONE, _RATE, _L2) + _STORED)
def truncated_evicts(spark, d):
    return _small_model(spark, d, "truncated", 4)


@query(_budgeted("spacesaving", _ONE, 4, 1, _NONE, _RATE, _L2) + _STORED)
def spacesaving_evicts(spark, d):
    return _small_model(spark, d, "spacesaving", 4)


@query(_budgeted("countmin", _ONE, 4, 4, _counted(2, 3), _RATE, _L2) + _STORED)
def countmin_evicts(spark, d):
    return _small_model(spark, d, "countmin", 4)


@query(_budgeted("active_set", _ONE, 3, 4, _tabulated(2, 3), _RATE, _L2) + _STORED)
def active_set_evicts(spark, d):
    """Three exact weights; the others collide in four cells."""
    return _small_model(spark, d, "active_set", 3)


@query(_STATS)
def active_set_tail(spark, d):
    """Three exact weights; the others lie in a sketch without collisions."""
    return _stats(_model(spark, d, "active_set", k=3, log2_width=5, exact_hash=True))


@query(_FIT + " SELECT seq, label, z >= 0 AS predicted FROM fit WHERE seq IS NOT NULL")
def progressive_predictions(spark, d):
    model = train.fit(ex.judged(spark, d), Spec("logistic", rate=_RATE, l2=_L2, k=64), predictions=True)
    return model.where("kind = 'pred'").select("seq", "label", "predicted")


@query(_FIT + """, p AS (SELECT z >= 0 AS predicted, label FROM fit WHERE seq IS NOT NULL), c AS (SELECT count(*) FILTER (predicted AND label = 1) AS tp, count(*) FILTER (predicted AND label <> 1) AS fp, count(*) FILTER (NOT predicted AND label = 1) AS fn, count(*) FILTER (predicted <> (label = 1)) AS err_count, count(*) AS count FROM p),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1, err_count, count, round(err_count / count, 9) AS err_rate FROM r""")
def confusion_metrics(spark, d):
    said = progressive_predictions(spark, d)
    both = topk.confusion(said).join(topk.progressive(said))
    return both.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "err_count", "count", F.round("err_rate", 9).alias("err_rate"))


@query(_FIT + " SELECT doc_id AS seq, quality AS label, round(scale * (w[toxic + 1] + w[doc_id % 14 + 3] * 0.5) + bias, 8) AS z, scale * (w[toxic + 1] + w[doc_id % 14 + 3] * 0.5) + bias >= 0 AS predicted FROM labels, last")
def lr_scores(spark, d):
    """A fitted model as a table, scored by an equi-join on keys."""
    model = _model(spark, d, "logistic", k=64).where("kind in ('weight', 'bias')").select("kind", "key", "weight").collect()
    weights = spark.createDataFrame([(r["key"], r["weight"]) for r in model if r["kind"] == "weight"], "key bigint, weight double")
    bias = next(r["weight"] for r in model if r["kind"] == "bias")
    return topk.scores(ex.judged(spark, d), weights, bias).select("seq", "label", F.round("z", 8).alias("z"), "predicted")


@query(_FIT + """, p AS (SELECT doc_id AS seq, quality AS label, scale * (w[toxic + 1] + w[doc_id % 14 + 3] * 0.5) + bias >= 0 AS predicted FROM labels, last)
SELECT model_id, p.* FROM p, (SELECT unnest(['0000-logistic', '0001-active_set', '0002-logistic_sketch']) AS model_id)""")
def model_predictions(spark, d):
    """Models kept as state and applied to examples; with room for all features they agree."""
    rows = ex.judged(spark, d)
    common = {"k": 64, "rate": _RATE, "l2": _L2, "log2_width": 5, "exact_hash": True}
    models = train.fit(rows, [Spec("logistic", **common), Spec("active_set", **common), Spec("logistic_sketch", depth=3, **common)], keep_state=True)
    return train.predict(rows, models)


@query(_budgeted("active_set", _EVENTS, 32, 64, _tabulated(6, 0), 0.1, 1e-6) + """ SELECT kind, key, round(weight, 6) AS weight, n FROM (
SELECT 'weight' AS kind, unnest(who) AS key, unnest(w) * scale AS weight, CAST(NULL AS BIGINT) AS n FROM last UNION ALL SELECT 'bias', NULL, bias, NULL FROM last
UNION ALL SELECT 'stat', NULL, sum(CASE WHEN (z >= 0) <> (label = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE, count(*) FROM fit WHERE seq IS NOT NULL)""")
def active_set_budgeted(spark, d):
    """Active-set classifier on events in a budget of 32 weights and 64 cells."""
    return train.fit(ex.events(spark, d), Spec("active_set", k=32, log2_width=6)).select("kind", "key", F.round("weight", 6).alias("weight"), "n")


@query()
def method_grid(spark, d):
    """All methods on events at once, one task each."""
    specs = [Spec(m, k=32, log2_width=7, depth=2, seed=5) for m in ("logistic", "logistic_sketch", "active_set", "truncated", "prob_truncated", "countmin", "spacesaving", "paired_countmin")]
    return train.fit(ex.events(spark, d), specs).drop("state")


@query(f"""WITH RECURSIVE ex AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS t, quality AS label, toxic + 1 AS i, doc_id % 14 + 3 AS j FROM (SELECT *, {train.SHARD.sql('doc_id')} % 8 AS s FROM labels)),
fit AS (SELECT s, CAST(0 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS bias, list_transform(range({_DIM}), lambda x: CAST(0 AS DOUBLE)) AS w FROM (SELECT DISTINCT s FROM ex)
 UNION ALL SELECT s, t + 1, bias - {_RATE}::DOUBLE / (1 + {_RATE * _L2!r}::DOUBLE * t) * y * g, list_transform(w, lambda x, n: CASE WHEN n = i THEN x - {_RATE / (1 - _RATE * _L2)!r}::DOUBLE * y * g WHEN n = j THEN x - {_RATE / (1 - _RATE * _L2)!r}::DOUBLE * y * g * 0.5 ELSE x END)
 FROM (SELECT *, -1 / (1 + exp(y * z)) AS g FROM (SELECT f.s, f.t, f.bias, f.w, i, j, CASE WHEN e.label = 1 THEN 1 ELSE -1 END AS y, {1 - _RATE * _L2!r}::DOUBLE / (1 + {_RATE * _L2!r}::DOUBLE * (f.t - 1)) * (f.w[i] + f.w[j] * 0.5) + f.bias AS z FROM fit f JOIN ex e ON e.s = f.s AND e.t = f.t))),
last AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY s ORDER BY t DESC) = 1),
every AS (SELECT CAST(unnest(range({_DIM})) AS BIGINT) AS key, unnest(w) * {1 - _RATE * _L2!r}::DOUBLE / (1 + {_RATE * _L2!r}::DOUBLE * (t - 1)) AS weight FROM last UNION ALL SELECT NULL, bias FROM last)
SELECT key, round(avg(weight), 9) AS weight FROM every GROUP BY key""")
def sharded_average(spark, d):
    """Averaged models of eight shards: approximate, parallel in the stream."""
    spec = Spec("active_set", k=64, log2_width=8, rate=_RATE, l2=_L2)
    return train.fit_sharded(ex.judged(spark, d), spec, 8).select("key", F.round("weight", 9).alias("weight"))


@query()
def sharded_events(spark, d):
    """The same over events, with fewer weights than features."""
    return train.fit_sharded(ex.events(spark, d), Spec("active_set", k=64, log2_width=8), 8)


@query("SELECT '{\"params\":{\"topk\":3,\"metric\":\"acctbal\"},\"results\":{\"count\":' || count(*) || ',\"nothing\":null,\"top\":' || to_json(list(s_suppkey ORDER BY abs(s_acctbal) DESC, s_suppkey)[1:3]) || '}}' AS json FROM supplier")
def json_report(spark, d):
    s = table(spark, d, "supplier")
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.abs("s_acctbal")).alias("w"), "s_suppkey"))), lambda x: x["s_suppkey"]), 1, 3)
    best = topk.top_by_magnitude(s.select("s_suppkey", "s_acctbal"), 3, "s_acctbal", "s_suppkey").agg(top.alias("top"))
    one = s.agg(F.count("*").alias("count")).join(best)
    return text.report({"topk": 3, "metric": "acctbal"}, {"count": F.col("count"), "nothing": F.lit(float("nan")), "top": F.col("top")}, one)
