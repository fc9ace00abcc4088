"""From annotated sources to rows of one form: id, dataset, group, aliases, split, state, question, target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import arrays as A
from ballast.functions import keys as K

OPTION = "struct<label:string,description:string>"

# Labels of the three-way and four-way tasks, and the answer domains of program questions.
ENTAILMENT = ("entailment", "neutral", "contradiction")
POLICY = ("yes", "no", "irrelevant", "ask_follow_up")
DOMAINS = {
    "exist": ("no", "yes"),
    "count": tuple(str(i) for i in range(11)),
    "query_color": ("gray", "red", "blue", "green", "brown", "purple", "cyan", "yellow"),
    "query_material": ("rubber", "metal"),
    "query_shape": ("cube", "sphere", "cylinder"),
    "query_size": ("small", "large"),
}
NEGATIVE_COUNT = (2, 128)


def text_or(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def options(labels: Column, descriptions: Column | None = None) -> Column:
    """Ordered candidates; position is the class."""
    if descriptions is None:
        return F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(None).cast("string").alias("description")))
    return F.zip_with(labels, descriptions, lambda x, y: F.struct(x.alias("label"), y.alias("description")))


def question(kind: Column | str, instructions: Column, criteria: Column | None = None) -> Column:
    """``struct<type, instructions, criteria>``; a noul question has no criteria of its own."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    c = criteria if criteria is not None else F.array().cast(f"array<{OPTION}>")
    return F.struct(k.alias("type"), instructions.alias("instructions"), c.alias("criteria"))


def build_examples(df: DataFrame, dataset: Column, uid: Column, group: Column, split: Column, state: Column, asked: Column, target: Column, image: Column | None = None, aliases: Column | None = None) -> DataFrame:
    """The common form; targets that are no distribution become null (see :func:`invalid_targets`)."""
    return df.select(
        F.concat_ws(":", dataset, uid.cast("string")).alias("id"),
        dataset.alias("dataset"),
        group.alias("group"),
        (aliases if aliases is not None else F.array().cast("array<string>")).alias("aliases"),
        split.alias("split"),
        state.alias("state"),
        (image if image is not None else F.lit(None).cast("string")).alias("image"),
        asked.alias("question"),
        A.normalize(target).alias("target"),
    )


def invalid_targets(examples: DataFrame) -> DataFrame:
    """Ids whose target was no distribution."""
    return examples.where("target is null").select("id", F.lit("invalid_target").alias("reason"))


def label_index(label: Column, vocabulary: Column) -> Column:
    """0-based position in a vocabulary; null for an unknown label."""
    return F.nullif(F.array_position(vocabulary, label), F.lit(0)).cast("int") - 1


def intent_vocabulary(df: DataFrame, label: str, where: Column) -> DataFrame:
    """One row: the sorted distinct labels of the chosen rows, and their descriptions."""
    labels = df.where(where).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return labels.select("labels", F.transform("labels", lambda x: F.replace(x, F.lit("_"), F.lit(" "))).alias("descriptions"))


def classification_source(df: DataFrame, labels: list[str], instruction: str, dataset: str, uid: str, text: str, label: str, split: Column) -> DataFrame:
    """Text with a fixed list of labels as choices; rows with other labels are dropped."""
    vocabulary = F.array(*map(F.lit, labels))
    index = label_index(F.col(label), vocabulary)
    group = F.concat(F.lit("utterance:"), K.digest(K.normalized(F.col(text))))
    return build_examples(df.where(index.isNotNull()), F.lit(dataset), F.col(uid), group, split, F.col(text), question("choice", F.lit(instruction), options(vocabulary)), A.one_hot(index, len(labels)))


def boolean_source(df: DataFrame, dataset: str, uid: str, passage: str, asked: str, answer: str, split: Column) -> DataFrame:
    """Passage and question with a yes or no answer."""
    state = F.to_json(F.struct(F.col(passage).alias("passage"), F.col(asked).alias("question")))
    group = F.concat(F.lit("passage:"), K.digest(K.normalized(F.col(passage))))
    return build_examples(df, F.lit(dataset), F.col(uid), group, split, state, question("noul", F.lit("Is the answer yes?")), A.one_hot(F.col(answer).cast("int"), 2))


def entailment_source(df: DataFrame, dataset: str, position: str, premise: str, hypothesis: str, label: str, split: Column) -> DataFrame:
    """Three-way entailment; grouped by row position so translations of a row stay together, aliased by premise."""
    state = F.to_json(F.struct(F.col(hypothesis).alias("hypothesis"), F.col(premise).alias("premise")))
    labels = F.array(*map(F.lit, ENTAILMENT))
    alias = F.array(F.concat(F.lit("premise:"), K.digest(K.normalized(F.col(premise)))))
    asked = question("choice", F.lit("How does the hypothesis relate to the premise?"), options(labels))
    return build_examples(df, F.lit(dataset), F.col(position), F.concat(F.lit("xnli:"), F.col(position).cast("string")), split, state, asked, A.one_hot(F.col(label).cast("int"), 3), aliases=alias)


TYPED = "map<string, struct<type:string,instructions:string,criteria:array<string>>>"
GOLD = "map<string, struct<probabilities:map<string,double>>>"


def typed_questions(df: DataFrame, state: str = "state", questions: str = "questions", gold: str = "gold") -> DataFrame:
    """One row per question of JSON question maps, with gold probabilities in label order."""
    parsed = df.withColumn("__q", F.from_json(questions, TYPED)).withColumn("__g", F.from_json(gold, GOLD))
    each = parsed.select("*", F.explode("__q").alias("qid", "question"))
    labels = F.when(F.col("question.type") == "noul", F.array(F.lit("false"), F.lit("true"))).otherwise(F.col("question.criteria"))
    chosen = F.transform(labels, lambda x: F.coalesce(F.try_element_at(F.try_element_at("__g", F.col("qid"))["probabilities"], x), F.lit(0.0)))
    return each.withColumn("labels", labels).withColumn("target", A.normalize(chosen)).drop("__q", "__g")


def vote_targets(df: DataFrame, votes: str = "votes") -> DataFrame:
    """``df`` with the soft target of its yes and no votes; rows without any are dropped."""
    kept = df.withColumn("votes", F.filter(votes, lambda v: v.isin("yes", "no"))).where(F.size("votes") > 0)
    p = F.size(F.filter("votes", lambda v: v == "yes")) / F.size("votes")
    return kept.withColumn("target", F.array(1 - p, p))


def image_choice_source(df: DataFrame) -> DataFrame:
    """Rows with an image and distinct choices; the hint, if any, becomes the state."""
    sound = df.where(F.col("image").isNotNull() & (F.size(F.array_distinct("choices")) == F.size("choices")))
    hint = F.col("hint")
    return sound.withColumn("state", F.when(text_or(hint) != "", F.to_json(F.struct(hint.alias("hint")))).otherwise(F.lit("{}"))).withColumn("target", A.one_hot(F.col("answer"), F.size("choices")))


def program_questions(df: DataFrame, program: str = "program", answer: str = "answer") -> DataFrame:
    """Questions whose last program step has a known domain: type, dataset, labels and target."""
    step = F.element_at(program, -1)
    domain = F.lit(None).cast("array<string>")
    for name, values in DOMAINS.items():
        asks = step.startswith("equal") | step.isin("exist", "greater_than", "less_than") if name == "exist" else step == name
        domain = F.when(asks, F.array(*map(F.lit, values))).otherwise(domain)
    known = df.withColumn("labels", domain).where(F.col("labels").isNotNull())
    kind = F.when(step == "count", "score").when(F.size("labels") == 2, F.when(F.get("labels", F.lit(0)) == "no", "noul").otherwise("choice")).otherwise("choice")
    family = F.when(step == "count", "count").when(step.startswith("query_"), "attribute").when(step == "exist", "exist").otherwise("compare")
    index = label_index(F.col(answer), F.col("labels"))
    return known.withColumns({"type": kind, "family": family, "target": A.one_hot(index, F.size("labels"))}).where("target is not null")


def region_audit(df: DataFrame) -> DataFrame:
    """``df`` with the first ``reason`` against a region question; ``candidates``, ``answers`` (arrays of keys) and ``has_image`` are given."""
    c, a = F.col("candidates"), F.col("answers")
    keys = F.array_distinct(F.transform(a, lambda x: F.get(x, F.lit(0))))
    reason = (
        F.when(c.isNull() | ~F.col("has_image"), "missing_assets")
        .when((F.size(c) < NEGATIVE_COUNT[0]) | (F.size(c) > NEGATIVE_COUNT[1]), "candidate_count")
        .when((F.size(a) == 0) | F.exists(a, lambda x: F.size(x) != 1), "multi_or_empty")
        .when(F.size(keys) != 1, "disagreement")
        .when(~F.exists(c, lambda r: r["key"] == F.get(keys, F.lit(0))), "unmapped_region")
    )
    return df.withColumn("reason", reason)


def region_examples(df: DataFrame) -> DataFrame:
    """A choice row among all regions, and two noul rows: the answer, and a region picked by hash among the others."""
    answer = F.get(F.get("answers", F.lit(0)), F.lit(0))
    keys = F.transform("candidates", lambda r: r["key"])
    base = df.where("reason is null").withColumn("id", F.concat_ws(":", F.lit("screen_choice"), "split", F.col("uid").cast("string"))).withColumn("keys", keys).withColumn("answer", answer)
    others = F.filter("keys", lambda k: k != F.col("answer"))
    negative = F.get(others, K.hash_bucket(F.col("id"), F.size(others)).cast("int"))
    named = lambda label, key, kind, target: F.struct(F.lit(kind).alias("type"), label.alias("id"), key.alias("key"), target.alias("target"))
    noul = lambda key: F.concat_ws(":", F.lit("screen_noul"), "split", F.col("uid").cast("string"), F.concat(F.lit("r"), key.cast("string")))
    index = (F.array_position("keys", F.col("answer")) - 1).cast("int")
    rows = F.array(
        named(F.col("id"), F.col("answer"), "choice", A.one_hot(index, F.size("keys"))),
        named(noul(F.col("answer")), F.col("answer"), "noul", A.one_hot(F.lit(1), 2)),
        named(noul(F.col("negative")), F.col("negative"), "noul", A.one_hot(F.lit(0), 2)),
    )
    return base.withColumn("negative", negative).select("split", F.explode(rows).alias("r")).select("split", "r.*")


def policy_source(df: DataFrame, url: str = "url", snippet: str = "snippet", answer: str = "answer") -> DataFrame:
    """``df`` with the group (its page, or its snippet where there is none) and the target of a policy question."""
    named = F.lower(F.trim(text_or(F.col(answer))))
    labels = F.array(*map(F.lit, POLICY))
    index = F.coalesce(label_index(named, F.slice(labels, 1, 3)), F.lit(3))
    group = F.concat(F.lit("sharc-page:"), F.coalesce(F.nullif(F.col(url), F.lit("")), K.normalized(F.col(snippet))))
    return df.withColumn("group", group).withColumn("target", A.one_hot(index, 4))


def contract_source(df: DataFrame) -> DataFrame:
    """A row per document and hypothesis: ``documents`` array with an ``annotations`` map, ``labels`` map of hypotheses."""
    each = df.select(F.explode("documents").alias("d"), "labels")
    noted = each.select("d.id", "d.text", "labels", F.explode("d.annotations").alias("key", "choice"))
    return noted.select("id", "text", "key", "choice", F.try_element_at("labels", F.col("key")).alias("hypothesis"))


def relevance_source(df: DataFrame, query: str, passage: str, title: str, label: str) -> DataFrame:
    """Query and passage as a noul question, aliased by document title."""
    state = F.to_json(F.struct(F.col(passage).alias("passage"), F.col(query).alias("query")))
    alias = F.array(F.concat(F.lit("document:"), K.normalized(F.col(title))))
    return df.withColumns({"state": state, "group": F.concat(F.lit("wikiqa-query:"), K.normalized(F.col(query))), "aliases": alias, "target": A.one_hot(F.col(label).cast("int"), 2)})


def product_relevance_source(judged: DataFrame, products: DataFrame, splits: DataFrame, train_cap: int = 450, other_cap: int = 60) -> DataFrame:
    """Judged (locale, query, product_id, label) rows of capped queries, with their products; splits: one per query."""
    from ballast.operators.sample import capped_queries

    chosen = capped_queries(splits, train_cap, other_cap)
    rows = selected_queries(judged.where("small_version = 1"), chosen).join(chosen, ["locale", "query"])
    return attach_products(rows, products)


def selected_queries(judged: DataFrame, chosen: DataFrame) -> DataFrame:
    """Judgements of chosen (locale, query) pairs."""
    return judged.join(chosen.select("locale", "query"), ["locale", "query"], "left_semi")


def attach_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` with the texts of their products; products are first reduced to those needed, nulls are empty."""
    needed = products.join(rows.select("locale", "product_id").distinct(), ["locale", "product_id"], "left_semi")
    texts = [c for c in products.columns if c.startswith("product_") and c != "product_id"]
    named = needed.select("locale", "product_id", *(text_or(F.col(c)).alias(c.removeprefix("product_")) for c in texts))
    return rows.join(named, ["locale", "product_id"])


def attach_image_ids(questions: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(questions with the image_id of their question_id, questions that the lookup lacks)``; the second must be empty."""
    return questions.join(lookup.select("question_id", "image_id"), "question_id"), questions.join(lookup, "question_id", "left_anti")


def missing_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Keys that no product has; must be none."""
    return rows.select("locale", "product_id").distinct().join(products, ["locale", "product_id"], "left_anti")


def mail_examples(df: DataFrame, body: str = "body", spam: str = "spam") -> DataFrame:
    """One row per message that is not blank; a message that is no spam is also a negative for phishing."""
    kinds = F.when(F.col(spam), F.array(F.struct(F.lit("spam").alias("task"), F.lit(1).alias("label")))).otherwise(F.array(F.struct(F.lit("spam").alias("task"), F.lit(0).alias("label")), F.struct(F.lit("phishing").alias("task"), F.lit(0).alias("label"))))
    sound = df.where(F.length(F.trim(text_or(F.col(body)))) > 0)
    made = sound.withColumn("signature", K.family_signature(F.col(body))).withColumn("split", K.family_split(F.col("signature")))
    return made.select("*", F.explode(kinds).alias("k")).select("*", "k.*").drop("k").withColumn("target", A.one_hot(F.col("label"), 2))


def dated_corpus_source(df: DataFrame, years: dict[int, str], year: str = "year") -> DataFrame:
    """Positives whose corpus year picks the split; other years are dropped."""
    split = F.lit(None).cast("string")
    for y, name in years.items():
        split = F.when(F.col(year) == y, name).otherwise(split)
    return df.withColumn("split", split).where("split is not null").withColumn("target", A.one_hot(F.lit(1), 2))


def sms_source(df: DataFrame) -> DataFrame:
    """``(label, text)`` lines as spam questions, split by family."""
    signature = K.family_signature(F.col("text"))
    return df.where(F.length(F.trim(text_or(F.col("text")))) > 0).withColumns({"signature": signature, "target": A.one_hot((F.col("label") == "spam").cast("int"), 2)}).withColumn("split", K.family_split(F.col("signature")))


def suite_rows(df: DataFrame, family: Column, suite: Column) -> DataFrame:
    """One row per question of a suite's cases: ``cases`` array of (state, questions map) beside ``gold`` array of maps."""
    named = df.select(F.concat_ws("/", family, suite).alias("suite"), F.posexplode(F.arrays_zip("cases", "gold")).alias("case", "z"))
    return named.select("suite", "case", F.col("z.cases.state").alias("state"), F.explode("z.cases.questions").alias("qid", "question"), F.col("z.gold").alias("gold")).withColumn("gold", F.try_element_at("gold", F.col("qid")))
