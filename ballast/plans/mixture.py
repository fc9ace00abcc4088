"""Queries over keys, splits, isolation, guards, budgets, samples and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import helpers
from ballast.functions import keys as K
from ballast.functions.durable import apart, cut
from ballast.operators import budget, convert, guard, isolate, mixture, sample
from ballast.plans.fixtures import EX, examples, sql_bucket, sql_family, sql_fold, sql_norm, sql_print, sql_train_split, table
from ballast.plans.registry import query

docs = lambda spark, d: table(spark, d, "documents")

# K: keys, hashes, splits


@query("keys_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.digest(F.col("text")).alias("digest"))


@query("keys_normalized", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.normalized(F.col("text")).alias("norm"))


@query("keys_fingerprint", f"SELECT doc_id, {sql_print('text')} AS fingerprint FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.fingerprint(F.col("text")).alias("fingerprint"))


@query("keys_casefold", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.casefold(F.col("text")).alias("folded"))


@query("keys_casefold_exact", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", helpers.exact_casefold(F.col("text")).alias("folded"))


@query("keys_hash_bucket", f"SELECT doc_id, {sql_bucket('text')} AS bucket FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.hash_bucket(F.col("text")).alias("bucket"))


@query("split_train", f"SELECT doc_id, {sql_train_split('source || doc_id', 'false')} AS split FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.train_split(F.concat("source", F.col("doc_id").cast("string")), False).alias("split"))


_IMAGE = sql_bucket("'doh-vqa:' || page_id")


@query("split_image", f"SELECT page_id, CASE WHEN {_IMAGE} < 10 THEN 'test' WHEN {_IMAGE} < 15 THEN 'dev' ELSE {sql_train_split('CAST(page_id AS VARCHAR)', 'true')} END AS split FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", K.image_split(F.col("page_id").cast("string")).alias("split"))


_FAMILY = sql_bucket(sql_family("html"))


@query("split_family", f"SELECT page_id, CASE WHEN {_FAMILY} < 15 THEN 'test' WHEN {_FAMILY} < 25 THEN 'dev' WHEN {_FAMILY} < 35 THEN 'calibration' ELSE 'train' END AS split FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", K.family_split(K.family_signature(F.col("html"))).alias("split"))


@query("split_official", f"WITH {EX} SELECT id, split FROM ex")
def _(spark, d):
    return examples(spark, d).select("id", "split")


@query("family_signature", f"SELECT page_id, {sql_family('html')} AS signature FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", K.family_signature(F.col("html")).alias("signature"))


@query("keys_sample", "SELECT doc_id, sha256('doh-sample-v1:' || doc_id) AS sample_key FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.sample_key(F.col("doc_id").cast("string")).alias("sample_key"))


@query("keys_bytes_and_pixels", "SELECT page_id, 'image-bytes:' || sha256(html) AS byte_key, 'pixels:' || sha256('4x2:' || html) AS pixel_key FROM pages")
def _(spark, d):
    raw = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select("page_id", K.byte_key(raw).alias("byte_key"), K.pixel_key(F.lit(4), F.lit(2), raw).alias("pixel_key"))


@query("keys_canonical_json", "SELECT o_custkey, sha256('{\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS identity, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus")
def _(spark, d):
    keyed = table(spark, d, "orders").withColumn("identity", K.digest(K.canonical_json("o_orderstatus", "o_orderpriority")))
    return keyed.groupBy("o_custkey", "identity").agg(F.count("*").alias("n"))


@query("keys_small_functions", r"SELECT doc_id, CASE WHEN starts_with(source, 'src') THEN substr(source, 4) ELSE source END AS bare, substr(text, 1, 3000) AS head, length(regexp_replace(text, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '', 'g')) AS stripped FROM documents")
def _(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", K.remove_prefix(F.col("source"), "src").alias("bare"), K.head(t).alias("head"), K.stripped_length(t).cast("long").alias("stripped"))


_QS = sql_train_split("'esci:' || o_orderpriority || ':' || trim(CAST(o_custkey AS VARCHAR))", "false")


@query("query_split", f"SELECT o_orderpriority AS locale, CAST(o_custkey AS VARCHAR) AS query, CASE WHEN max(o_orderstatus = 'P') THEN 'test' ELSE {_QS} END AS split FROM orders GROUP BY o_orderpriority, o_custkey")
def _(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("locale"), F.col("o_custkey").cast("string").alias("query"), "o_orderstatus")
    return sample.query_split(q, F.col("o_orderstatus") == "P")


# G: isolation. The oracle walks the bipartite graph of groups and aliases.
_CC = f"""{EX},
e AS (SELECT DISTINCT "group" AS g, unnest(aliases) AS a FROM ex),
least AS (SELECT a, min(g) AS g FROM e GROUP BY a),
n AS (SELECT DISTINCT e.g AS g, least.g AS h FROM e JOIN least USING (a) UNION SELECT DISTINCT least.g, e.g FROM e JOIN least USING (a)),
walk AS (SELECT g, h FROM n UNION SELECT w.g, n.h FROM walk w JOIN n ON w.h = n.g),
reach AS (SELECT g, min(h) AS low FROM walk GROUP BY g),
roots AS (SELECT reach.g, min(k) AS root FROM reach JOIN (SELECT low AS l, min(a) AS k FROM reach JOIN e ON reach.g = e.g GROUP BY low) m ON reach.low = m.l GROUP BY reach.g),
rooted AS (SELECT ex.*, least(root, low) AS root, CASE split WHEN 'train' THEN 0 WHEN 'calibration' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END AS rank FROM ex JOIN roots ON ex."group" = roots.g JOIN reach ON reach.g = roots.g),
judged AS (SELECT *, rank < max(rank) OVER (PARTITION BY root) AS conflict FROM rooted),
survive AS (SELECT *, row_number() OVER (PARTITION BY dataset, root, state ORDER BY input_pos) > 1 AS duplicate FROM judged WHERE NOT conflict)"""
_REC = _CC.replace("ex0 AS", "RECURSIVE ex0 AS", 1)


@query("alias_edges", f'WITH {EX} SELECT DISTINCT "group", unnest(aliases) AS alias FROM ex')
def _(spark, d):
    return isolate.alias_edges(examples(spark, d))


@query("connected_components", f'WITH {_REC} SELECT DISTINCT "group", root FROM rooted')
def _(spark, d):
    return isolate.component_roots(examples(spark, d))


@query("components_extended", f'WITH {_REC} SELECT DISTINCT "group", root FROM rooted')
def _(spark, d):
    """The held-out rows first, then the training rows added to their result."""
    ex = examples(spark, d)
    base, added = ex.where("split <> 'train'"), ex.where("split = 'train'")
    return isolate.extended_roots(cut(isolate.component_roots(base)), base, added)


@query("components_sizes", f'WITH {_REC} SELECT root, count(*) AS rows, count(DISTINCT "group") AS groups FROM rooted GROUP BY root')
def _(spark, d):
    return isolate.component_sizes(examples(spark, d))


@query("resolve_split_priority", f"WITH {_REC} SELECT id, root, conflict FROM judged")
def _(spark, d):
    ex = cut(examples(spark, d).select("id", "group", "aliases", "split"))  # keys once, and no texts
    return isolate.resolve_split_priority(ex.join(apart(isolate.component_roots(ex), "group"), "group")).select("id", "root", "conflict")


@query("isolate_kept", f'WITH {_REC} SELECT id, dataset, root AS "group", split FROM survive WHERE NOT duplicate')
def _(spark, d):
    return isolate.isolate(examples(spark, d))[0].select("id", "dataset", "group", "split")


@query("isolate_audit", f"""WITH {_REC} SELECT dataset, split, reason, count(*) AS n FROM (
  SELECT dataset, split, 'cross_split_group' AS reason FROM judged WHERE conflict UNION ALL SELECT dataset, split, 'duplicate_input' FROM survive WHERE duplicate) GROUP BY ALL""")
def _(spark, d):
    return isolate.isolate(examples(spark, d))[1]


@query("dedupe_inputs", f"WITH {EX} SELECT id, row_number() OVER (PARTITION BY dataset, state ORDER BY input_pos) > 1 AS duplicate FROM ex")
def _(spark, d):
    return isolate.dedupe_inputs(examples(spark, d), "dataset", "state").select("id", "duplicate")


# A1-A3: counts


@query("split_counts", f"WITH {EX} SELECT dataset, split, count(*) AS n FROM ex GROUP BY ALL")
def _(spark, d):
    return mixture.split_counts(examples(spark, d))


_LABELLED = f"{EX}, lab AS (SELECT ex.*, l.toxic FROM ex JOIN labels l ON ex.input_pos = l.doc_id)"


def _labelled(spark, d):
    from ballast.functions.arrays import one_hot

    labels = table(spark, d, "labels").select(F.col("doc_id").alias("input_pos"), "toxic")
    return examples(spark, d).join(labels, "input_pos").withColumn("target", one_hot(F.col("toxic"), 2))


@query("class_counts", f'WITH {_LABELLED} SELECT dataset, split, CAST(toxic AS INT) AS "class", count(*) AS n FROM lab GROUP BY ALL')
def _(spark, d):
    return mixture.class_counts(_labelled(spark, d))


_TOKENS = r"len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\s\p{L}\p{N}]'))"


@query("exclusion_waterfall", f"""WITH {_REC},
tagged AS (SELECT dataset, split, state, CASE WHEN conflict THEN 'cross_split_group' END AS reason FROM judged WHERE conflict
  UNION ALL SELECT dataset, split, state, CASE WHEN duplicate THEN 'duplicate_input' WHEN {_TOKENS.replace('text', 'state')} > 1000 THEN 'token_budget' END FROM survive)
SELECT dataset, split, reason, count(*) AS n FROM tagged WHERE reason IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    rows = isolate.tagged(examples(spark, d))
    over = F.when(budget.count_pieces(F.col("state")) > 1000, "token_budget")
    return mixture.exclusion_counts(rows.withColumn("reason", mixture.first_reason(F.col("reason"), over)))


# F: filters


@query("token_budget", f"SELECT doc_id, CAST({_TOKENS} AS INT) AS tokens, CASE WHEN {_TOKENS} > 2048 THEN 'token_budget' END AS reason FROM documents")
def _(spark, d):
    return budget.token_budget(docs(spark, d), budget.count_pieces(F.col("text"))).select("doc_id", "tokens", "reason")


#: A public vocabulary of ranks.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("token_budget_vocabulary")
def _(spark, d):
    """Merges of a vocabulary are not for SQL; tests hold the counts against the vocabulary's own library."""
    return budget.token_budget(docs(spark, d), budget.vocabulary_tokens(spark, F.col("text"), RANKS)).select("doc_id", "tokens", "reason")


@query("image_token_count", """WITH s AS (SELECT p_partkey, CAST(p_size * 37 AS DOUBLE) AS w, CAST(100 + p_partkey % 900 AS DOUBLE) AS h FROM part)
SELECT p_partkey, CAST(greatest(32, floor(w * sqrt(262144.0 / (w * h)) / 32) * 32) / 32 * (greatest(32, floor(h * sqrt(262144.0 / (w * h)) / 32) * 32) / 32) AS BIGINT) AS tokens FROM s""")
def _(spark, d):
    w, h = (F.col("p_size") * 37).cast("double"), (100 + F.col("p_partkey") % 900).cast("double")
    return table(spark, d, "part").select("p_partkey", budget.image_token_count(w, h).alias("tokens"))


def _with_leaves(spark, d):
    return examples(spark, d).withColumn("state_leaves", F.array("state"))


_LEAF = r"length(regexp_replace({x}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')) >= 80"
#: Rows of a dataset that a guard or a replay samples.
SAMPLED = 6000
# The base: held-out documents, and conversations as training rows that are sampled. Training documents are the candidates.
_BLOCKED = f"""{EX},
conv AS (SELECT role AS dataset, 'conv:' || conv_id || ':' || turn AS id, text AS state FROM conversations),
sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('doh-sample-v1:' || id), id) AS nth FROM conv) WHERE nth <= {SAMPLED}),
blocked AS (SELECT DISTINCT {sql_print('state')} AS fingerprint FROM (SELECT state FROM ex WHERE split <> 'train' UNION ALL SELECT state FROM sampled) WHERE {_LEAF.format(x='state')}
  UNION SELECT {sql_print('text')} FROM benchmark),
variants AS (SELECT id, state AS leaf FROM ex WHERE split = 'train' UNION SELECT id, substr(state, 1, 3000) FROM ex WHERE split = 'train'),
flagged AS (SELECT DISTINCT id FROM variants WHERE {_LEAF.format(x='leaf')} AND {sql_print('leaf')} IN (SELECT fingerprint FROM blocked))"""


def _blocked(spark, d):
    ex = cut(_with_leaves(spark, d).select("id", "dataset", "group", "split", "state_leaves"))
    c = table(spark, d, "conversations")
    turns = c.select(F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("id"), F.col("role").alias("dataset"), F.lit("train").alias("split"), F.array("text").alias("state_leaves"))
    chosen = sample.stable_sample(turns.select("dataset", "id"), SAMPLED).select("id")  # texts are joined afterwards
    base = ex.select(*turns.columns).where("split <> 'train'")
    return ex, (base, turns.join(chosen, "id", "left_semi"), table(spark, d, "benchmark").select("text"))


@query("blocked_fingerprints", f"WITH {_BLOCKED} SELECT fingerprint FROM blocked")
def _(spark, d):
    return guard.blocked_fingerprints(*_blocked(spark, d)[1])


@query("guard_overlap", f"WITH {_BLOCKED} SELECT id FROM flagged")
def _(spark, d):
    ex, blocked = _blocked(spark, d)
    return guard.benchmark_overlap(ex.where("split = 'train'"), guard.blocked_leaves(*blocked))


@query("guard_reject_groups", f"""WITH {_BLOCKED} SELECT id FROM ex WHERE split = 'train'
  AND "group" NOT IN (SELECT "group" FROM ex JOIN flagged USING (id) WHERE split = 'train')""")
def _(spark, d):
    ex, blocked = _blocked(spark, d)
    train = ex.where("split = 'train'")
    return guard.reject_overlap_groups(train, guard.benchmark_overlap(train, guard.blocked_leaves(*blocked))).select("id")


@query("nonempty_rows", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND n_chars >= 0")
def _(spark, d):
    p = F.array(F.col("doc_id") % 2 * 1.0, 1.0 - F.col("doc_id") % 2)
    return budget.valid_rows(docs(spark, d).withColumn("p", p), text="text", distribution="p").select("doc_id")


# W: windows and samples


@query("stable_sample", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('doh-sample-v1:' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 6000")
def _(spark, d):
    return sample.stable_sample(docs(spark, d), SAMPLED, by="source", row_id="doc_id").select("doc_id", "source")


_QUERIES = "q AS (SELECT DISTINCT o_orderpriority AS locale, CAST(o_custkey AS VARCHAR) AS query, CASE WHEN o_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM orders), chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locale, split ORDER BY sha256(locale || ':' || query), query) AS nth FROM q) WHERE nth <= CASE WHEN split = 'train' THEN 450 ELSE 60 END)"


def _queries(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("locale"), F.col("o_custkey").cast("string").alias("query"), F.when(F.col("o_custkey") % 3 == 0, "test").otherwise("train").alias("split")).distinct()


@query("capped_queries", f"WITH {_QUERIES} SELECT locale, query, split FROM chosen")
def _(spark, d):
    return sample.capped_queries(_queries(spark, d))


_JUDGED = "j AS (SELECT o_orderpriority AS locale, CAST(o_custkey AS VARCHAR) AS query, l_partkey AS product_id, CAST(l_linenumber % 2 AS INT) AS small_version, l_returnflag AS label, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT locale, p_partkey AS product_id, p_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part, (SELECT DISTINCT o_orderpriority AS locale FROM orders))"


def _judged(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    judged = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("locale"), F.col("o_custkey").cast("string").alias("query"), F.col("l_partkey").alias("product_id"), (F.col("l_linenumber") % 2).alias("small_version"), F.col("l_returnflag").alias("label"), "l_orderkey", "l_linenumber")
    locales = o.select(F.col("o_orderpriority").alias("locale")).distinct()
    products = table(spark, d, "part").join(F.broadcast(locales)).select("locale", F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_title"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("product_brand"))
    return judged, products


@query("selected_queries", f"WITH {_QUERIES}, {_JUDGED} SELECT l_orderkey, l_linenumber FROM j SEMI JOIN chosen USING (locale, query)")
def _(spark, d):
    return convert.selected_queries(_judged(spark, d)[0], sample.capped_queries(_queries(spark, d))).select("l_orderkey", "l_linenumber")


@query("attach_products", f"WITH {_JUDGED} SELECT l_orderkey, l_linenumber, p_name AS title, coalesce(brand, '') AS brand FROM j JOIN p USING (locale, product_id)")
def _(spark, d):
    judged, products = _judged(spark, d)
    return convert.attach_products(judged, products).select("l_orderkey", "l_linenumber", "title", "brand")


@query("product_relevance", f"WITH {_QUERIES}, {_JUDGED} SELECT l_orderkey, l_linenumber, split, p_name AS title, coalesce(brand, '') AS brand FROM j JOIN chosen USING (locale, query) JOIN p USING (locale, product_id) WHERE small_version = 1")
def _(spark, d):
    judged, products = _judged(spark, d)
    return convert.product_relevance_source(judged, products, _queries(spark, d)).select("l_orderkey", "l_linenumber", "split", "title", "brand")


@query("missing_products", f"WITH {_JUDGED} SELECT DISTINCT locale, product_id FROM j ANTI JOIN (SELECT * FROM p WHERE product_id % 7 <> 0) x USING (locale, product_id)")
def _(spark, d):
    judged, products = _judged(spark, d)
    return convert.missing_products(judged, products.where("product_id % 7 <> 0"))


@query("length_batches", "SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY length(text), CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 64, doc_id) - 1) / 16.0) AS BIGINT) AS batch FROM documents")
def _(spark, d):
    return sample.length_batches(docs(spark, d), 16, F.length("text"), by="source", row_id="doc_id").select("doc_id", "source", "batch")


@query("first_n_cases", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) WHERE nth <= 3")
def _(spark, d):
    return sample.first_n(table(spark, d, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn")


@query("training_plan", """WITH ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096, doc_id) - 1 AS rank FROM documents),
sizes AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source) - 1 AS ordinal FROM documents GROUP BY source),
steps AS (SELECT s AS step, CAST('0x' || substr(sha256('42:dataset:' || s), 1, 12) AS BIGINT) % (SELECT count(*) FROM sizes) AS ordinal FROM range(0, 3600) r(s)),
drawn AS (SELECT step, source, slot, CAST('0x' || substr(sha256('42:row:' || step || ':' || slot), 1, 12) AS BIGINT) % size AS rank FROM steps JOIN sizes USING (ordinal), range(0, 32) t(slot))
SELECT step, CAST(slot AS INT) AS slot, source, doc_id FROM drawn JOIN ranked USING (source, rank)""")
def _(spark, d):
    return sample.training_plan(docs(spark, d), 0, 3600, 32, 42, by="source", row_id="doc_id")


# U, J4, G6: unions and replays


@query("concatenate_sources", "SELECT CAST(0 AS INT) AS source, doc_id AS row, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark")
def _(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("row_index"), "text")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("row_index"), "text")
    return mixture.concatenate([a, b]).select("input_pos.source", "input_pos.row", "text")


_SAMPLED = f"{EX}, sampled AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('doh-sample-v1:' || id), id) AS nth FROM ex WHERE split = 'train') WHERE nth <= {SAMPLED})"


@query("replay_filter", f"WITH {_SAMPLED} SELECT id, split FROM ex WHERE split <> 'train' OR id IN (SELECT id FROM sampled)")
def _(spark, d):
    ex = examples(spark, d)
    return mixture.replay_filter(ex, sample.stable_sample(ex.where("split = 'train'"), SAMPLED)).select("id", "split")


@query("mixture_union", f"WITH {_SAMPLED} SELECT id, split FROM ex WHERE split <> 'train' OR id IN (SELECT id FROM sampled) UNION ALL SELECT 'item:' || item_id, 'train' FROM benchmark")
def _(spark, d):
    ex = examples(spark, d)
    new = table(spark, d, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("id"), F.lit("train").alias("split"))
    return mixture.replay(ex, sample.stable_sample(ex.where("split = 'train'"), SAMPLED), new).select("id", "split")


@query("blocked_union", f"SELECT {sql_print('text')} AS fingerprint FROM documents UNION SELECT {sql_print('text')} FROM benchmark")
def _(spark, d):
    f = K.fingerprint(F.col("text")).alias("fingerprint")
    return docs(spark, d).select(f).union(table(spark, d, "benchmark").select(f)).distinct()


@query("subset_check", "SELECT doc_id AS id, 'right' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'left' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    return mixture.subset_check(table(spark, d, "labels").select(F.col("doc_id").alias("id")), docs(spark, d).select(F.col("doc_id").alias("id")))


@query("ordered_outputs", f"WITH {EX} SELECT dataset, split, count(*) AS n FROM ex GROUP BY ALL ORDER BY dataset, split")
def _(spark, d):
    return mixture.split_counts(examples(spark, d)).orderBy("dataset", "split")
