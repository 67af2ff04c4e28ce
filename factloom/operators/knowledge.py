"""Names in text and what follows from them: gazetteer and fuzzy matches, events, relations, page classes, keyphrases, search over all layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C

# Words that tell of events.
EVENTS = {
    "Commissioning": ["commissioned", "commissioning", "inaugurated"], "Safety Accident": ["accident", "explosion", "mishap", "fatal"], "Subsidence": ["subsidence", "collapse"],
    "Expansion": ["expansion"], "Statutory Clearance": ["clearance", "approval", "approved"], "Mine Closure": ["closure", "closed", "abandoned"], "Strike": ["strike"],
}

# Relations of two kinds that stand in one chunk.
RELATIONS = [
    ("organization", "mine", "OPERATES"), ("mine", "location", "LOCATED_IN"), ("mine", "geology", "HAS_GEOLOGY"), ("organization", "location", "BASED_IN"), ("document", "location", "MENTIONS"),
    ("document", "geology", "MENTIONS"), ("document", "event", "MENTIONS"), ("event", "document", "REPORTED_IN"), ("event", "mine", "OCCURRED_AT"), ("event", "location", "OCCURRED_AT"), ("event", "organization", "INVOLVES"),
]

# Limits of page classes, and rows of a search layer.
TEXT_CHARS, IMAGE_SHARE, VECTOR_DRAWINGS, SHORT_CHARS, LAYER_ROWS = 20, 0.05, 200, 50, 12


def events(text: Column) -> Column:
    """The events that a text tells of, in the order of ``EVENTS``."""
    found = F.array(*(F.when(text.rlike(rf"(?i)\b(?:{'|'.join(words)})\b"), label) for label, words in EVENTS.items()))
    return F.filter(found, lambda x: x.isNotNull())


def gazetteer(entities: DataFrame) -> DataFrame:
    """``entity, name`` of every entity's own name and its ``aliases``."""
    names = F.array_union(F.array("entity"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("entity", F.explode(names).alias("name")).where("name <> ''").distinct()


def mentioned(texts: DataFrame, names: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``key, entity`` for every text that holds one of an entity's names as words.

    Short names in capitals are abbreviations and must be written so. Texts and names meet by the longest word of the name, without
    the text; the text comes back for the few names that it may hold.
    """
    word = lambda s: F.filter(F.transform(C.search_tokens(s), lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")
    words = texts.select(key, F.explode(F.array_distinct(word(F.col(text_col)))).alias("__w"))
    longest = F.array_max(F.transform(word(F.col("name")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = names.select("entity", "name", longest.alias("__w")).where("__w is not null")
    capitals = (F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name")) & (F.length("name") <= 6)
    quoted = F.concat(F.when(capitals, "").otherwise("(?iu)"), F.lit(r"(?U)(?<!\w)\Q"), "name", F.lit(r"\E(?!\w)"))
    maybe = words.join(asked, "__w").select(key, "entity", "name").distinct()
    return maybe.join(texts.select(key, F.col(text_col).alias("__text")), key).where(F.call_function("rlike", F.col("__text"), quoted)).select(key, "entity").distinct()


def relations(mentions: DataFrame, rules: list[tuple[str, str, str]] = RELATIONS) -> DataFrame:
    """Edges of things of two kinds in one chunk (chunk_id, kind, name), by the rules: how many chunks hold both, and the first of them.

    One join of the chunk's mentions for all rules: each mention goes to the rules in which its kind stands first or second.
    """
    listed = mentions.distinct()
    table = lambda i: F.create_map(*(x for kind in sorted({r[i] for r in rules}) for x in (F.lit(kind), F.array(*(F.lit(n) for n, r in enumerate(rules) if r[i] == kind)))))
    side = lambda i, name: listed.select("chunk_id", F.explode(F.element_at(table(i), F.col("kind"))).alias("rule"), F.col("name").alias(name))
    pairs = side(0, "src").join(side(1, "dst"), ["chunk_id", "rule"]).groupBy("rule", "src", "dst").agg(F.count("*").alias("n"), F.min("chunk_id").alias("receipt"))
    part = lambda i: F.get(F.array(*(F.lit(r[i]) for r in rules)), F.col("rule"))
    return pairs.select(part(0).alias("src_kind"), "src", part(2).alias("relation"), part(1).alias("dst_kind"), "dst", "n", "receipt")


def grams(s: Column, n: int = 3) -> Column:
    """Distinct runs of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n)))


def fuzzy_entities(questions: DataFrame, names: DataFrame, least: int = 90) -> DataFrame:
    """The entity that each question (query_id, text) means: query_id, entity, name, score. names: entity, name.

    Abbreviations count 100 where they stand as a word. Other names are held against the question's windows of as many words, by
    100 * (1 - edits / longer length); two texts as near as ``least`` = 90 asks share three characters in a row. An edit changes three such
    runs at most, so a name and a window within e edits share one of any 3 e + 1 runs of the name: the rarest ones are their keys, and none is
    missed. Windows that several questions hold are compared once. Ties go to the name that sorts first.
    """
    capitals = (F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name")) & (F.length("name") <= 6)
    size = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    asked = questions.select("query_id", "text", F.split(F.trim(F.lower("text")), r"\s+").alias("w"))
    plain = names.where(~capitals).select("entity", "name", F.lower("name").alias("low"), size(F.col("name")).alias("k"))
    sizes = plain.agg(F.array_sort(F.collect_set("k")).alias("sizes"))  # one row: the numbers of words that names have

    def of_size(k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(k.alias("k"), F.array_join(F.slice("w", i, k), " ").alias("window")))

    windows = F.flatten(F.transform("sizes", of_size))
    window = asked.crossJoin(F.broadcast(sizes)).select("query_id", F.explode(F.array_distinct(windows)).alias("x")).select("query_id", "x.k", F.regexp_replace("x.window", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("window"))
    most = F.floor(F.length("low") * (100 - least) / least).cast("int")  # edits between a name and a window as near as that
    pieces = plain.distinct().withColumns({"gram": F.explode(grams(F.col("low"))), "take": 3 * most + 1})
    pieces = pieces.withColumn("n", F.count("*").over(Window.partitionBy("k", "gram")))
    of_name = ["entity", "name", "low", "k"]
    place = F.row_number().over(Window.partitionBy(*of_name).orderBy("n", "gram"))
    keys = pieces.withColumn("place", place).where(F.col("place") <= F.col("take")).groupBy(*of_name).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("keys"))
    asked_once = window.select("k", "window").distinct().select("k", "window", F.explode(grams(F.col("window"))).alias("gram"))
    met = asked_once.join(keys.select(*of_name, "keys", F.explode("keys").alias("gram")), ["k", "gram"])
    long = F.greatest(F.length("low"), F.length("window"))
    room = F.floor(long * (100 - least) / 100).cast("int")
    first = F.get(F.filter("keys", lambda g: F.contains(F.col("window"), g)), F.lit(0)) == F.col("gram")  # a pair that meets by several is taken once
    met = met.where(first & (F.abs(F.length("low") - F.length("window")) <= room)).withColumn("edits", F.call_function("levenshtein", F.col("low"), F.col("window"), room)).where("edits >= 0")
    score = F.floor(100 * (1 - F.col("edits") / long)).cast("int")
    found = met.select("k", "window", "entity", "name", score.alias("score")).where(F.col("score") >= least)
    near = window.join(found, ["k", "window"]).select("query_id", "entity", "name", "score")
    short = names.where(capitals).select("entity", "name", F.lower("name").alias("word"))
    said = asked.select("query_id", "text", F.explode(F.array_distinct(C.search_tokens(F.col("text")))).alias("word")).join(short, "word")
    exact = said.where(F.call_function("rlike", F.col("text"), F.concat(F.lit(r"\b\Q"), "name", F.lit(r"\E\b")))).select("query_id", "entity", "name", F.lit(100).alias("score"))
    every = near.unionByName(exact)
    best = every.groupBy("query_id").agg(F.min_by(F.struct("entity", "name", "score"), F.struct(-F.col("score"), "name", "entity")).alias("b"))
    return best.select("query_id", "b.entity", "b.name", "b.score")


def containing(queries: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``query_id, key`` where the row's ``text`` holds the query's text, in any case; they meet by the query's first three characters."""
    low = F.lower(F.trim("text"))
    q = queries.select("query_id", low.alias("q")).where("q <> ''").withColumn("gram", F.substring("q", 1, 3))
    lengths = [r.n for r in q.select(F.length("gram").alias("n")).distinct().collect()]  # at most three
    runs = F.flatten(F.array(*(grams(F.lower("text"), n) for n in lengths))) if lengths else F.array().cast("array<string>")
    t = texts.select(key, F.lower("text").alias("t"), F.explode(runs).alias("gram"))
    return q.join(t, "gram").where(F.contains("t", "q")).select("query_id", key).distinct()


def ranked(rows: DataFrame, layer: str, key: str, *order: Column) -> DataFrame:
    """The first rows of a layer for each query: query_id, layer, id, rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= LAYER_ROWS).select("query_id", F.lit(layer).alias("layer"), F.col(key).cast("string").alias("id"), "rank")


def organisation_search(queries: DataFrame, documents: DataFrame, facts: DataFrame, entities: DataFrame, reference: DataFrame, places: list[str]) -> DataFrame:
    """Six layers for each query (query_id, text): query_id, layer, id, rank.

    documents: hits query_id, id, rank of a document search. facts match by entity, detected attribute or period, or the
    attribute's name; entities (entity, kind) and, of the kinds ``places``, locations by name; metrics by name and keywords;
    reference rows (ref_id, entity, label, value) by any of their texts. Every layer but documents is cut to its best rows.
    """
    asked = queries.select("query_id", "text", C.detect_attribute(F.col("text")).alias("attribute"), C.normalize_period(F.col("text")).alias("period"))
    named = containing(queries, entities.select("entity", F.col("entity").alias("text")), "entity")
    known = facts.select("attribute").distinct()
    like = containing(asked.where("attribute is null"), known.select("attribute", F.col("attribute").alias("text")), "attribute")
    by = lambda q, key: q.join(facts, key).select("query_id", "fact_id", "is_current", "conf")
    hit = by(named, "entity").unionByName(by(asked.where("attribute is not null").select("query_id", "attribute"), "attribute")).unionByName(by(asked.where("period is not null").select("query_id", "period"), "period")).unionByName(by(like, "attribute")).distinct()
    counted = entities.join(facts.groupBy("entity").agg(F.count("*").alias("n_facts")), "entity", "left").fillna(0, ["n_facts"])
    found = named.join(counted, "entity")
    words = facts.sparkSession.createDataFrame([(a, w) for a, ws in C.ATTRIBUTES.items() for w in [a, *ws]], "attribute string, text string")
    low = F.lower(F.trim("text"))
    inside = containing(queries, words, "attribute")
    around = queries.select("query_id", low.alias("q")).join(F.broadcast(words.where("text <> attribute")), F.contains("q", "text")).select("query_id", "attribute")  # the vocabulary: a fixed table
    metric = inside.union(around).union(containing(queries, known.where("attribute <> 'quantity'").select("attribute", F.col("attribute").alias("text")), "attribute")).distinct()
    every = reference.select("ref_id", F.explode(F.array("entity", "label", "value")).alias("text"))
    ref = containing(queries, every, "ref_id").join(reference, "ref_id")
    layers = [
        documents.select("query_id", F.lit("documents").alias("layer"), F.col("id").cast("string").alias("id"), "rank"), ranked(hit, "facts", "fact_id", F.desc("is_current"), F.desc("conf"), F.desc("fact_id")),
        ranked(found, "entities", "entity", F.desc("n_facts"), F.col("entity")), ranked(found.where(F.col("kind").isin(places)), "locations", "entity", F.desc("n_facts"), F.col("entity")),
        ranked(metric, "metrics", "attribute", F.col("attribute")), ranked(ref, "reference", "ref_id", F.col("entity"), F.col("ref_id")),
    ]
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out


def page_class(chars: Column, images: Column, image_share: Column, n_tables: Column, drawings: Column) -> Column:
    """Class of a page from what is on it."""
    text, image, table = chars >= TEXT_CHARS, (images > 0) & (image_share >= IMAGE_SHARE), n_tables > 0
    return (
        F.when((drawings >= VECTOR_DRAWINGS) | (text & image & table), "COMPLEX_LAYOUT").when(table & (image | ~text), "IMAGE_TABLE").when(table, "TEXT_TABLE")
        .when(image & text, "TEXT_IMAGE").when(image, "IMAGE_ONLY").when(text, "TEXT_ONLY").otherwise("LOW_CONFIDENCE")
    )


def extraction_plan(kind: Column, chars: Column, ocr: Column) -> Column:
    """Steps for a page of a class: its own text first, then recognition where an engine is there, then vision."""
    pictures = kind.isin("IMAGE_ONLY", "IMAGE_TABLE", "COMPLEX_LAYOUT")
    read = ocr & (pictures | (kind == "LOW_CONFIDENCE") | ((kind == "TEXT_IMAGE") & (chars < SHORT_CHARS)))
    return F.filter(F.array(F.lit("native"), F.when(read, "ocr"), F.when(pictures, "vision")), lambda x: x.isNotNull())


def keyphrases(docs: DataFrame, top: int = 15, words: int = 60, pairs: int = 40) -> DataFrame:
    """Words and repeated word pairs of each document by the cosine of their TF-IDF vectors with the document's: doc_id, phrase, score, rank."""
    base = docs.select("doc_id", C.keyword_tokens(F.col("text")).alias("w"))
    tf = base.select("doc_id", F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    many = docs.agg(F.count("*").alias("many"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(many)).select("term", F.log1p(F.col("many") / F.col("df")).alias("idf"))  # many: one row
    weighed = tf.join(idf, "term")
    norm = weighed.groupBy("doc_id").agg(F.sqrt(F.sum((F.col("n") * F.col("idf")) ** 2)).alias("norm"))
    best = lambda df, *order: df.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    single = best(weighed, F.desc("n"), F.col("term")).where(F.col("r") <= words).select("doc_id", F.col("term").alias("phrase"), (F.col("n") * F.col("idf")).alias("dot"))
    both = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pair = base.select("doc_id", F.explode(both).alias("p")).where("p.a is not null and p.b is not null").groupBy("doc_id", "p.a", "p.b").agg(F.count("*").alias("c")).where("c > 1")
    pair = best(pair, F.desc("c"), F.col("a"), F.col("b")).where(F.col("r") <= pairs)
    for side in ("a", "b"):
        pair = pair.join(weighed.select("doc_id", F.col("term").alias(side), F.col("n").alias(f"n_{side}"), F.col("idf").alias(f"i_{side}")), ["doc_id", side])
    same = F.col("a") == F.col("b")
    dot = F.when(same, F.col("n_a") * F.col("i_a")).otherwise((F.col("n_a") * F.col("i_a") ** 2 + F.col("n_b") * F.col("i_b") ** 2) / F.sqrt(F.col("i_a") ** 2 + F.col("i_b") ** 2))
    double = pair.select("doc_id", F.concat_ws(" ", "a", "b").alias("phrase"), dot.alias("dot"))
    scored = single.unionByName(double).join(norm, "doc_id").select("doc_id", "phrase", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "phrase"))).where(F.col("rank") <= top)
