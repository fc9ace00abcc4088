"""Queries over conversions of annotated sources, prompts and text helpers."""

from __future__ import annotations


from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions import helpers
from ballast.functions import keys as K
from ballast.operators import convert, prompts
from ballast.plans.fixtures import WHITE, sql_bucket, sql_family, sql_norm, table
from ballast.plans.registry import query

LANGS = ["de", "en", "es", "fr"]


def _docs(spark, d):
    return table(spark, d, "documents")


@query("build_examples", f"SELECT 'src:' || doc_id AS id, 'src' AS dataset, 'utterance:' || sha256({sql_norm('text')}) AS \"group\", [sha256(lang)] AS aliases, 'train' AS split, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE [0.25, 0.75]::DOUBLE[] END AS target FROM documents")
def _(spark, d):
    target = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(0.2), F.lit(0.2))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    group = F.concat(F.lit("utterance:"), K.digest(K.normalized(F.col("text"))))
    made = convert.build_examples(_docs(spark, d), F.lit("src"), F.col("doc_id"), group, F.lit("train"), F.col("text"), convert.question("noul", F.lit("?")), target, aliases=F.array(K.digest(F.col("lang"))))
    return made.select("id", "dataset", "group", "aliases", "split", "target")


@query("invalid_targets", "SELECT 'src:' || doc_id AS id, 'invalid_target' AS reason FROM documents WHERE doc_id % 4 = 0")
def _(spark, d):
    target = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(0.2), F.lit(0.2))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    return convert.invalid_targets(convert.build_examples(_docs(spark, d), F.lit("src"), F.col("doc_id"), F.col("source"), F.lit("train"), F.col("text"), convert.question("noul", F.lit("?")), target))


@query("label_index", "SELECT doc_id, CAST(list_position(['de', 'en', 'fr'], lang) - 1 AS INT) AS position FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id, NULL FROM documents WHERE lang = 'es'")
def _(spark, d):
    return _docs(spark, d).select("doc_id", convert.label_index(F.col("lang"), F.array(*map(F.lit, ["de", "en", "fr"]))).alias("position"))


@query("intent_vocabulary", "SELECT list(s ORDER BY s) AS labels, list(replace(s, '_', ' ') ORDER BY s) AS descriptions FROM (SELECT DISTINCT 'ask_' || source AS s FROM documents WHERE lang = 'en')")
def _(spark, d):
    return convert.intent_vocabulary(_docs(spark, d).withColumn("s", F.concat(F.lit("ask_"), "source")), "s", F.col("lang") == "en")


@query("classification_source", f"SELECT 'lang:' || doc_id AS id, 'utterance:' || sha256({sql_norm('text')}) AS \"group\", list_transform(range(0, 3), lambda i: CAST(i = list_position(['de', 'en', 'fr'], lang) - 1 AS DOUBLE)) AS target FROM documents WHERE lang <> 'es'")
def _(spark, d):
    return convert.classification_source(_docs(spark, d), ["de", "en", "fr"], "Which language?", "lang", "doc_id", "text", "lang", F.lit("train")).select("id", "group", "target")


@query("boolean_source", f"SELECT 'bool:' || d.doc_id AS id, 'passage:' || sha256({sql_norm('text')}) AS \"group\", [CAST(1 - toxic AS DOUBLE), CAST(toxic AS DOUBLE)] AS target FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    joined = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("asked", F.lit("Is it toxic?"))
    return convert.boolean_source(joined, "bool", "doc_id", "text", "asked", "toxic", F.lit("train")).select("id", "group", "target")


@query("entailment_source", f"SELECT 'nli:' || conv_id || '-' || turn AS id, 'xnli:' || conv_id || '-' || turn AS \"group\", ['premise:' || sha256({sql_norm('text')})] AS aliases, list_transform(range(0, 3), lambda i: CAST(i = turn % 3 AS DOUBLE)) AS target FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("position", F.concat_ws("-", "conv_id", "turn")).withColumn("label", F.col("turn") % 3)
    return convert.entailment_source(c, "nli", "position", "text", "role", "label", F.lit("train")).select("id", "group", "aliases", "target")


def _typed(spark, d):
    """Two questions to each turn, as JSON: whose it is, with odds by its number, and whether its number is even."""
    asked = F.to_json(F.create_map(
        F.lit("a"), F.struct(F.lit("choice").alias("type"), F.concat(F.lit("who says this in "), F.col("conv_id").cast("string"), F.lit("?")).alias("instructions"), F.array(F.lit("nobody"), F.concat(F.lit("the "), "role")).alias("criteria")),
        F.lit("b"), F.struct(F.lit("noul").alias("type"), F.lit("even?").alias("instructions"), F.array().cast("array<string>").alias("criteria")),
    ))
    odds = lambda *xs: F.struct(F.create_map(*xs).alias("probabilities"))
    even = (F.col("turn") % 2 == 0).cast("double")
    gold = F.to_json(F.create_map(F.lit("a"), odds(F.concat(F.lit("the "), "role"), (F.col("turn") % 4 + 1) / 8, F.lit("nobody"), 1 - (F.col("turn") % 4 + 1) / 8), F.lit("b"), odds(F.lit("true"), even, F.lit("false"), 1 - even)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("state"), asked.alias("questions"), gold.alias("gold"))


@query("typed_questions", """WITH t AS (SELECT conv_id, turn, role, (turn % 4 + 1) / 8.0::DOUBLE AS u FROM conversations)
SELECT conv_id, turn, 'a' AS qid, ['nobody', 'the ' || role] AS labels, [1 - u, u] AS target FROM t
UNION ALL SELECT conv_id, turn, 'b', ['false', 'true'], [CAST(turn % 2 AS DOUBLE), CAST(1 - turn % 2 AS DOUBLE)] FROM t""")
def _(spark, d):
    return convert.typed_questions(_typed(spark, d)).select("conv_id", "turn", "qid", "labels", F.transform("target", lambda x: F.round(x, 6)).alias("target"))


@query("vote_targets", "SELECT user_id, round(avg(CAST(event_type = 'click' AS INT)), 6) AS yes FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def _(spark, d):
    vote = F.when(F.col("event_type") == "click", "yes").when(F.col("event_type") == "view", "no").otherwise("maybe")
    grouped = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(vote).alias("votes"))
    return convert.vote_targets(grouped).select("user_id", F.round(F.get("target", F.lit(1)), 6).alias("yes"))


@query("image_choice_source", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{}' ELSE '{\"hint\":\"h' || page_id || '\"}' END AS state, [0.0, 1.0]::DOUBLE[] AS target FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
def _(spark, d):
    n = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.when(n % 5 != 0, F.col("url")).alias("image"), F.array(F.lit("x"), F.when(n % 7 == 0, "x").otherwise("y")).alias("choices"), F.when(n % 3 != 0, F.concat(F.lit("h"), n.cast("string"))).alias("hint"), F.lit(1).alias("answer"))
    return convert.image_choice_source(rows).select("page_id", "state", "target")


_LOOK = "WHERE o_orderkey % 9 {} 0"


def _looked_up(spark, d):
    questions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), "l_linenumber")
    lookup = table(spark, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("image_id"))
    return convert.attach_image_ids(questions, lookup)


@query("attach_image_ids", f"SELECT l_orderkey AS question_id, l_linenumber, o_custkey AS image_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey {_LOOK.format('<>')}")
def _(spark, d):
    return _looked_up(spark, d)[0]


@query("missing_image_ids", f"SELECT l_orderkey AS question_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders {_LOOK.format('<>')})")
def _(spark, d):
    return _looked_up(spark, d)[1]


@query("program_questions", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'exist' WHEN 2 THEN 'query_size' ELSE 'scene' END AS step, l_orderkey % 2 AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE step WHEN 'count' THEN 'score' WHEN 'exist' THEN 'noul' ELSE 'choice' END AS type, CASE step WHEN 'count' THEN 'count' WHEN 'exist' THEN 'exist' ELSE 'attribute' END AS family, CAST(CASE step WHEN 'count' THEN 11 ELSE 2 END AS INT) AS k, CAST(a AS INT) AS gold FROM s WHERE step <> 'scene'""")
def _(spark, d):
    step = F.when(F.col("l_linenumber") % 4 == 0, "count").when(F.col("l_linenumber") % 4 == 1, "exist").when(F.col("l_linenumber") % 4 == 2, "query_size").otherwise("scene")
    one = F.col("l_orderkey") % 2 == 1
    answer = F.when(step == "count", F.when(one, "1").otherwise("0")).when(step == "exist", F.when(one, "yes").otherwise("no")).otherwise(F.when(one, "large").otherwise("small"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.lit("scene"), step).alias("program"), answer.alias("answer"))
    return convert.program_questions(rows).select("l_orderkey", "l_linenumber", "type", "family", F.size("target").alias("k"), A.argmax(F.col("target")).alias("gold"))


def _screens(spark, d):
    """A UI tree per part: a root with three visible leaves (two alike for some), one hidden, one out of the screen."""
    n = F.col("p_partkey")
    node = lambda l, t, r, b, more="": F.concat(F.lit('{"bounds":['), F.concat_ws(",", *(x.cast("string") if not isinstance(x, int) else F.lit(str(x)) for x in (l, t, r, b))), F.lit(f"]{more}}}"))  # noqa: E731, E741
    second = node(10, 10, F.when(n % 3 == 0, 50).otherwise(60), 50)
    children = F.concat_ws(",", node(10, 10, 50, 50), second, node(0, 60, 20, 80, ',"visibility":"gone"'), node(30, 60, 200, 80), node(60, 60, 90, 90))
    tree = F.concat(F.lit('{"activity":{"root":{"bounds":[0,0,100,100],"children":['), children, F.lit("]}}}"))
    return table(spark, d, "part").select(n.alias("uid"), F.when(n % 11 == 0, F.lit("{broken")).otherwise(tree).alias("tree"))


_REGIONS = "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN [1, 5] ELSE [1, 2, 5] END"


@query("region_candidates", f"SELECT p_partkey AS uid, {_REGIONS} AS keys, CASE WHEN p_partkey % 11 <> 0 THEN 0.9::DOUBLE END AS last_right FROM part")
def _(spark, d):
    c = _screens(spark, d).withColumn("c", helpers.region_candidates(F.col("tree")))
    return c.select("uid", F.transform("c", lambda r: r["key"]).alias("keys"), F.element_at("c", -1)["right"].alias("last_right"))


def _answered(spark, d):
    n = F.col("uid")
    answers = F.when(n % 5 == 0, F.array().cast("array<array<int>>")).when(n % 5 == 1, F.array(F.array(F.lit(1)), F.array(F.lit(5)))).when(n % 5 == 2, F.array(F.array(F.lit(4)))).otherwise(F.array(F.array(F.lit(5)), F.array(F.lit(5))))
    return _screens(spark, d).withColumn("candidates", helpers.region_candidates(F.col("tree"))).withColumn("answers", answers).withColumn("has_image", n % 13 != 0).withColumn("split", F.lit("train"))


_REASON = "CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'missing_assets' WHEN p_partkey % 5 = 0 THEN 'multi_or_empty' WHEN p_partkey % 5 = 1 THEN 'disagreement' WHEN p_partkey % 5 = 2 THEN 'unmapped_region' END"


@query("region_audit", f"SELECT {_REASON} AS reason, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return convert.region_audit(_answered(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


_RID = "'screen_choice:train:' || p_partkey"
_NEG = f"list_filter({_REGIONS}, lambda k: k <> 5)"


@query("region_examples", f"""WITH b AS (SELECT p_partkey, {_RID} AS id, {_REGIONS} AS keys, {_NEG} AS others FROM part WHERE {_REASON} IS NULL), n AS (SELECT *, others[1 + {sql_bucket('id', 'len(others)')}] AS neg FROM b)
SELECT id, 'choice' AS type, CAST(5 AS INT) AS key, CAST(len(keys) - 1 AS INT) AS gold FROM n UNION ALL SELECT 'screen_noul:train:' || p_partkey || ':r5', 'noul', 5, 1 FROM n UNION ALL SELECT 'screen_noul:train:' || p_partkey || ':r' || neg, 'noul', neg, 0 FROM n""")
def _(spark, d):
    return convert.region_examples(convert.region_audit(_answered(spark, d))).select("id", "type", "key", A.argmax(F.col("target")).alias("gold"))


@query("policy_actions", f"SELECT page_id, 'sharc-page:' || CASE WHEN page_id % 2 = 0 THEN url ELSE {sql_norm('html')} END AS \"group\", CAST(page_id % 4 AS INT) AS gold FROM pages")
def _(spark, d):
    n = F.col("page_id")
    answer = F.when(n % 4 == 0, " Yes").when(n % 4 == 1, "no").when(n % 4 == 2, "Irrelevant").otherwise("Do you live in Wales?")
    rows = table(spark, d, "pages").select("page_id", F.when(n % 2 == 0, F.col("url")).otherwise("").alias("url"), F.col("html").alias("snippet"), answer.alias("answer"))
    return convert.policy_source(rows).select("page_id", "group", A.argmax(F.col("target")).alias("gold"))


@query("contract_source", "SELECT conv_id AS id, role AS key, CASE WHEN turn % 2 = 0 THEN 'Entailment' ELSE 'NotMentioned' END AS choice, 'The ' || role || ' speaks.' AS hypothesis FROM (SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY ALL)")
def _(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("turn"))
    noted = F.map_from_entries(F.collect_list(F.struct("role", F.when(F.col("turn") % 2 == 0, "Entailment").otherwise("NotMentioned"))))
    each = last.groupBy("conv_id").agg(F.array(F.struct(F.first("conv_id").alias("id"), F.lit("text").alias("text"), noted.alias("annotations"))).alias("documents"))
    roles = ["user", "assistant", "system"]
    named = F.create_map(*(F.lit(x) for r in roles for x in (r, f"The {r} speaks.")))
    return convert.contract_source(each.withColumn("labels", named)).select("id", "key", "choice", "hypothesis")


@query("relevance_source", f"SELECT d.doc_id, 'wikiqa-query:' || {sql_norm('source')} AS \"group\", ['document:' || {sql_norm('lang')}] AS aliases, CAST(quality AS INT) AS gold FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    joined = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return convert.relevance_source(joined, "source", "text", "lang", "quality").select("doc_id", "group", "aliases", A.argmax(F.col("target")).alias("gold"))


_FAMILY = sql_bucket(sql_family("text"))
_FSPLIT = f"CASE WHEN {_FAMILY} < 15 THEN 'test' WHEN {_FAMILY} < 25 THEN 'dev' WHEN {_FAMILY} < 35 THEN 'calibration' ELSE 'train' END"


@query("mail_examples", f"SELECT d.doc_id, task, CAST(CASE WHEN task = 'spam' THEN toxic ELSE 0 END AS INT) AS label, {_FSPLIT} AS split FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('spam'), ('phishing')) v(task) WHERE (task = 'spam' OR toxic = 0) AND length(trim(text)) > 0")
def _(spark, d):
    joined = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("spam", F.col("toxic") == 1)
    return convert.mail_examples(joined, body="text").select("doc_id", "task", "label", "split")


@query("dated_corpus_source", "SELECT event_id, CASE month(ts) WHEN 1 THEN CASE WHEN day(ts) < 20 THEN 'train' ELSE 'test' END END AS split FROM events WHERE day(ts) % 2 = 0")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.dayofmonth("ts").alias("year"))
    days = {x: "train" if x < 20 else "test" for x in range(2, 32, 2)}
    return convert.dated_corpus_source(rows, days).select("event_id", "split")


@query("sms_source", f"SELECT doc_id, {_FSPLIT} AS split, CAST(source = 'src0' AS INT) AS gold FROM documents WHERE length(trim(text)) > 0")
def _(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("source") == "src0", "spam").otherwise("ham").alias("label"), "text")
    return convert.sms_source(rows).select("doc_id", "split", A.argmax(F.col("target")).alias("gold"))


@query("state_leaves", "SELECT event_id, [event_type, props, CAST(user_id AS VARCHAR)] AS leaves FROM events")
def _(spark, d):
    nested = F.to_json(F.struct(F.col("event_type").alias("a"), F.struct(F.array("props", F.col("user_id").cast("string")).alias("c"), F.lit(7).alias("n")).alias("b")))
    return table(spark, d, "events").select("event_id", helpers.json_leaves(nested).alias("leaves"))


@query("render_state", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN replace(props, ' ', '') ELSE event_type END AS state FROM events")
def _(spark, d):
    even = F.col("event_id") % 2 == 0
    spaced = F.when(even, F.replace("props", F.lit(":"), F.lit(" : "))).otherwise(F.col("event_type"))
    return table(spark, d, "events").withColumn("s", spaced).select("event_id", prompts.render_state(F.col("s"), even).alias("state"))


_OPT = "o AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END AS type, p_brand, p_type, p_name FROM part)"


def _options(spark, d):
    n = F.col("p_partkey")
    item = lambda label, text: F.struct(label.alias("label"), text.alias("description"))
    two = F.array(item(F.col("p_brand"), F.col("p_name")), item(F.col("p_type"), F.lit("")))
    criteria = F.when(n % 3 == 1, F.array().cast("array<struct<label:string,description:string>>")).otherwise(two)
    return table(spark, d, "part").select("p_partkey", F.when(n % 3 == 0, "choice").when(n % 3 == 1, "noul").otherwise("score").alias("type"), criteria.alias("criteria"))


@query("option_labels", f"WITH {_OPT} SELECT p_partkey, CASE type WHEN 'noul' THEN ['false', 'true'] WHEN 'score' THEN ['0', '1'] ELSE [p_brand, p_type] END AS labels, type <> 'choice' OR p_brand <> p_type AS valid FROM o")
def _(spark, d):
    labels = prompts.option_labels(F.col("type"), F.col("criteria"))
    return _options(spark, d).select("p_partkey", labels.alias("labels"), prompts.valid_options(labels).alias("valid"))


_TEXTS = "CASE type WHEN 'noul' THEN ['false', 'true'] WHEN 'score' THEN ['level 0: ' || p_name, 'level 1: ' || p_type] ELSE [p_brand || ': ' || p_name, p_type] END"


@query("option_texts", f"WITH {_OPT} SELECT p_partkey, {_TEXTS} AS texts FROM o")
def _(spark, d):
    return _options(spark, d).select("p_partkey", prompts.option_texts(F.col("type"), F.col("criteria")).alias("texts"))


@query("prompt_render", f"WITH {_OPT}, t AS (SELECT *, {_TEXTS} AS texts FROM o) SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '<|image|>' || chr(10) ELSE '' END || 'State: ' || p_name || chr(10) || type || ' question: Which?' || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(texts, lambda x: '- ' || x || '<|option|>'), chr(10)) END AS prompt FROM t")
def _(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit("a<|option|>b")).otherwise(F.col("p_name")).alias("state"))
    made = _options(spark, d).join(names, "p_partkey")
    texts = prompts.option_texts(F.col("type"), F.col("criteria"))
    return made.select("p_partkey", prompts.render_prompt(F.col("type"), F.col("state"), F.lit("Which?"), texts, F.col("p_partkey") % 2 == 0).alias("prompt"))


@query("suite_rows", "SELECT 'apps/' || s AS suite, CAST(pos AS INT) AS \"case\", qid, text AS state, CASE qid WHEN 'a' THEN turn ELSE conv_id END AS gold FROM (SELECT *, 's' || conv_id AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), (VALUES ('a'), ('b')) v(qid)")
def _(spark, d):
    asked = F.create_map(F.lit("a"), F.lit("which turn?"), F.lit("b"), F.lit("which conversation?"))
    gold = F.create_map(F.lit("a"), F.col("turn"), F.lit("b"), F.col("conv_id"))
    item = F.struct("turn", F.struct(F.col("text").alias("state"), asked.alias("questions")).alias("case"), gold.alias("gold"))
    suites = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(item).alias("j")))).alias("xs"))
    kind = "struct<turn:bigint,case:struct<state:string,questions:map<string,string>>,gold:map<string,bigint>>"
    parsed = suites.select("conv_id", F.transform("xs", lambda x: F.from_json(x["j"], kind)).alias("xs"))
    made = parsed.select("conv_id", F.transform("xs", lambda x: x["case"]).alias("cases"), F.transform("xs", lambda x: x["gold"]).alias("gold"))
    return convert.suite_rows(made, F.lit("apps"), F.concat(F.lit("s"), F.col("conv_id").cast("string"))).select("suite", "case", "qid", "state", "gold")


# What a reader sees of the given pages, whose markup and character references are few; mail is made from documents by columns.
_SEEN = r"regexp_replace(regexp_replace(regexp_replace(html, '(<[^>]*|&[^;\s<]*)$', ''), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->', ' ', 'g'), '<[/!a-zA-Z][^>]*>', ' ', 'g')"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
    _SEEN = f"regexp_replace({_SEEN}, '&{_name};?', '{_sign}', 'g')"  # as in HTML, these need no semicolon, so a cut title's last one counts


@query("visible_text", rf"SELECT page_id, trim(regexp_replace({_SEEN}, '{WHITE}', ' ', 'g')) AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", helpers.visible_text(F.col("html")).alias("text"))


@query("mail_text", r"SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    raw = F.concat(F.encode(F.concat(F.lit("From: a@example.org\r\nSubject: "), F.col("source"), F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n")), "UTF-8"), F.encode(F.base64(F.encode("text", "UTF-8")), "UTF-8"))
    return _docs(spark, d).select("doc_id", helpers.mail_text(raw).alias("text"))


@query("score_batches", "SELECT doc_id, [CAST(length(text) AS DOUBLE), 0.0] AS logits FROM documents")
def _(spark, d):
    from ballast.operators.scoring import score_batches

    return score_batches(_docs(spark, d).select("doc_id", F.col("text").alias("prompt")), lambda prompts: [[float(len(p)), 0.0] for p in prompts]).select("doc_id", "logits")
