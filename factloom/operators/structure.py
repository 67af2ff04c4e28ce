"""From elements to sections, chunks and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C


def page_elements(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of HTML pages, in order of kind and place: page_id, element_type, level, idx, text."""
    kinds = [("HEADING", i, rf"(?is)<h{i}[^>]*>(.*?)</h{i}>") for i in range(1, 7)] + [("PARAGRAPH", 0, r"(?is)<p[^>]*>(.*?)</p>"), ("LIST", 0, r"(?is)<li[^>]*>(.*?)</li>")]
    found = F.flatten(F.array(*(_tagged(k, n, p) for k, n, p in kinds)))
    rows = pages.select("page_id", F.explode(found).alias("e")).select("page_id", "e.*")
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]*>", " "), r"[ \t\n\r\f\x0b]+", " "))
    return rows.withColumn("text", text).where("text <> ''")


def _tagged(kind: str, level: int, pattern: str):
    def one(t, i):
        return F.struct(F.lit(kind).alias("element_type"), F.lit(level).alias("level"), i.alias("idx"), t.alias("text"))

    return F.transform(F.regexp_extract_all("html", F.lit(pattern), 1), one)


def section_paths(elements: DataFrame, levels: int = 3) -> DataFrame:
    """``section_path`` in force at each element: the last heading of each level that no higher heading has closed since."""
    w = Window.partitionBy("doc_id").orderBy("order_idx")
    out = elements
    for k in range(1, levels + 1):
        mine = F.when((F.col("element_type") == "HEADING") & (F.col("level") == k), F.struct(F.col("order_idx").alias("at"), F.col("text").alias("text")))
        higher = F.when((F.col("element_type") == "HEADING") & (F.col("level") < k), F.col("order_idx"))
        out = out.withColumns({f"__h{k}": F.last(mine, ignorenulls=True).over(w), f"__c{k}": F.last(higher, ignorenulls=True).over(w)})
    parts = [F.when(F.col(f"__h{k}").isNotNull() & (F.coalesce(F.col(f"__c{k}"), F.lit(-1)) < F.col(f"__h{k}.at")), F.col(f"__h{k}.text")) for k in range(1, levels + 1)]
    return out.withColumn("section_path", F.concat_ws(" > ", *parts)).drop(*(f"__{x}{k}" for x in "hc" for k in range(1, levels + 1)))


def chunks(elements: DataFrame, budget: int = 400) -> DataFrame:
    """Paragraphs merged until section, page or the token budget changes: doc_id, section_path, page_no, part, n_tokens, n_elements, text.

    Islands of one section and page are aggregated, so a document is never gathered whole; inside one the greedy rule
    starts a new chunk as soon as the budget would be passed.
    """
    paths = section_paths(elements)
    w = Window.partitionBy("doc_id").orderBy("order_idx")
    new = ~(F.lag("section_path").over(w).eqNullSafe(F.col("section_path")) & F.lag("page_no").over(w).eqNullSafe(F.col("page_no")))
    body = paths.withColumn("island", F.sum(new.cast("int")).over(w)).where("element_type <> 'HEADING'").withColumn("tokens", C.token_count(F.col("text")))
    grouped = body.groupBy("doc_id", "island", "section_path", "page_no").agg(F.array_sort(F.collect_list(F.struct("order_idx", "tokens", "text"))).alias("e"))
    zero = F.struct(F.lit(0).alias("part"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(a, x):
        full = (a["used"] > 0) & (a["used"] + x["tokens"] > budget)
        part = F.when(full, a["part"] + 1).otherwise(a["part"])
        return F.struct(part.alias("part"), F.when(full, x["tokens"]).otherwise(a["used"] + x["tokens"]).alias("used"), F.array_append(a["parts"], part).alias("parts"))

    numbered = grouped.withColumn("z", F.explode(F.arrays_zip("e", F.aggregate("e", zero, step)["parts"].alias("p"))))
    rows = numbered.select("doc_id", "island", "section_path", "page_no", F.col("z.p").alias("part"), F.col("z.e").alias("e"))
    out = rows.groupBy("doc_id", "island", "section_path", "page_no", "part").agg(F.sum("e.tokens").alias("n_tokens"), F.count("*").alias("n_elements"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "\n").alias("text"))
    return out.withColumn("chunk_id", F.substring(F.sha1(F.concat_ws("|", "doc_id", "island", "part")), 1, 16))


def table_chunks(cells: DataFrame, headers: DataFrame, budget: int = 400) -> DataFrame:
    """A table in one chunk if it fits, else one self-describing chunk for each row. cells: table_id, row_idx, col_idx, value; headers: table_id, col_idx, header."""
    named = cells.join(headers, ["table_id", "col_idx"])
    rows = named.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "header", "value"))).alias("c"))
    rows = rows.select("table_id", "row_idx", F.array_join(F.transform("c", lambda c: F.concat(c["header"], F.lit(": "), c["value"])), " | ").alias("text"))
    w = Window.partitionBy("table_id")
    rows = rows.withColumn("tokens", C.token_count(F.col("text"))).withColumn("all", F.sum("tokens").over(w))
    small = rows.where(F.col("all") <= budget).groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda r: r["text"]), "\n").alias("text"))
    large = rows.where(F.col("all") > budget).select("table_id", F.col("row_idx"), F.lit("TABLE_ROW").alias("content_type"), "text")
    return small.select("table_id", F.lit(-1).cast("long").alias("row_idx"), F.lit("TABLE").alias("content_type"), "text").unionByName(large.withColumn("row_idx", F.col("row_idx").cast("long")))


def regions(rows: DataFrame) -> DataFrame:
    """Bands of a sheet between blank rows: rows (sheet, row_idx, is_blank, title) get ``region`` and the title carried forward."""
    w = Window.partitionBy("sheet").orderBy("row_idx")
    out = rows.withColumns({"region": F.sum(F.col("is_blank").cast("int")).over(w), "title": F.last("title", ignorenulls=True).over(w)})
    return out.where("not is_blank")


def apart(docs: DataFrame, key: str = "doc_id", most: int = 500_000) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is theirs alone, and those that share it or have none (null if there are none).

    What is counted by document needs no shuffle for the former. Only keys are shuffled; shared ones are broadcast if they are at most ``most``.
    """
    shared = docs.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) | F.col(key).isNull()).select(key)
    many = shared.limit(most + 1).count()
    if not many:
        return docs, None
    held = F.broadcast(shared) if many <= most else shared
    own = F.col(key).isNotNull()
    return docs.where(own).join(held, key, "left_anti"), docs.where(~own).unionByName(docs.where(own).join(held, key, "left_semi"))


def neighbours(w: Column) -> Column:
    """Each word of an array with the next one, with a blank between them."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def keywords(docs: DataFrame, top: int = 10, least: int = 3) -> DataFrame:
    """Top terms of each document, then pairs of neighbours that occur ``least`` times and hold no chosen term.

    Words and pairs of a document are counted in its row; only rows that share an id are counted by a shuffle.
    """
    alone, rest = apart(docs.select("doc_id", "text"))
    w = alone.select("doc_id", C.keyword_tokens(F.col("text")).alias("w")).select("doc_id", "w", C.most_frequent(C.counted(F.col("w")), top).alias("best"))
    w = w.withColumn("names", F.transform("best", lambda c: c["item"]))
    part = lambda p, i: F.element_at(F.split(p, " "), i)  # noqa: E731  words hold no blank
    pairs = F.filter(F.filter(C.counted(neighbours(F.col("w"))), lambda p: p["n"] >= least), lambda p: ~F.array_contains("names", part(p["item"], 1)) & ~F.array_contains("names", part(p["item"], 2)))
    row = lambda keyword, n, source: F.struct(keyword.alias("keyword"), n.alias("n"), F.lit(source).alias("source"))
    every = F.concat(F.transform("best", lambda c: row(c["item"], -c["less"], "term")), F.transform(pairs, lambda p: row(p["item"], p["n"], "bigram")))
    out = w.select("doc_id", F.explode(every).alias("k")).select("doc_id", "k.*")
    return out if rest is None else out.unionByName(_shared_keywords(rest, top, least))


def top_terms(docs: DataFrame, top: int = 10) -> DataFrame:
    """``doc_id, keyword, n``: the terms of :func:`keywords`, without counting pairs."""
    alone, rest = apart(docs.select("doc_id", "text"))
    best = C.most_frequent(C.counted(C.keyword_tokens(F.col("text"))), top)
    out = alone.select("doc_id", F.explode(best).alias("c")).select("doc_id", F.col("c.item").alias("keyword"), (-F.col("c.less")).alias("n"))
    return out if rest is None else out.unionByName(_shared_terms(rest.select("doc_id", C.keyword_tokens(F.col("text")).alias("w")), top))


def _shared_counts(base: DataFrame, items: Column) -> DataFrame:
    counts = base.select("doc_id", F.explode(C.counted(items)).alias("c"))
    return counts.groupBy("doc_id", F.col("c.item").alias("keyword")).agg(F.sum("c.n").alias("n"))


def _shared_terms(base: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "keyword"))
    return _shared_counts(base, F.col("w")).withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def _shared_keywords(docs: DataFrame, top: int, least: int) -> DataFrame:
    """Keywords of rows that share ids, each id as one document."""
    base = docs.select("doc_id", C.keyword_tokens(F.col("text")).alias("w"))
    chosen, both = _shared_terms(base, top), F.split("keyword", " ")
    pairs = _shared_counts(base, neighbours(F.col("w"))).where(F.col("n") >= least).select("doc_id", "keyword", "n", both[0].alias("a"), both[1].alias("b"))
    for side in ("a", "b"):
        pairs = pairs.join(chosen.select("doc_id", F.col("keyword").alias(side)), ["doc_id", side], "left_anti")
    return chosen.select("doc_id", "keyword", "n", F.lit("term").alias("source")).unionByName(pairs.select("doc_id", "keyword", "n", F.lit("bigram").alias("source")))


def fingerprints(docs: DataFrame, top: int = 30) -> DataFrame:
    """Sixteen hex digits per document from its page count and most frequent terms (count descending, then term)."""
    key = F.substring(F.sha1(F.concat_ws("|", F.col("pages").cast("string"), F.coalesce("terms", F.lit("")))), 1, 16)
    alone, rest = apart(docs)
    own = F.array_join(F.transform(C.most_frequent(C.counted(C.keyword_tokens(F.col("text"))), top), lambda c: c["item"]), " ")
    out = alone.select("doc_id", "pages", own.alias("terms")).select("doc_id", key.alias("fingerprint"))
    if rest is None:
        return out
    terms = rest.select("doc_id", F.explode(C.counted(C.keyword_tokens(F.col("text")))).alias("c")).groupBy("doc_id", F.col("c.item").alias("w")).agg(F.sum("c.n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))
    best = terms.withColumn("r", rank).where(F.col("r") <= top).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), " ").alias("terms"))
    return out.unionByName(rest.join(best, "doc_id", "left").select("doc_id", key.alias("fingerprint")))


def quality_gate(docs: DataFrame, elements: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """COMPLETE, WARNING or FAILED per document with the checks that failed."""
    e = elements.groupBy("doc_id").agg(F.count("*").alias("n_elements"), F.count_distinct("page_no").alias("n_pages"), F.sum(F.length("text")).alias("chars"))
    c = chunk_rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("n_tokens").alias("most"))
    j = docs.select("doc_id", "n_chars").join(e, "doc_id", "left").join(c, "doc_id", "left").fillna(0)
    checks = F.filter(F.array(F.when(F.col("n_elements") == 0, "no elements"), F.when(F.col("n_chunks") == 0, "no chunks"), F.when(F.col("chars") < 0.9 * F.col("n_chars"), "low coverage"), F.when(F.col("most") > 400, "chunk above budget")), lambda x: x.isNotNull())
    verdict = F.when(F.col("n_elements") == 0, "FAILED").when(F.size("checks") > 0, "WARNING").otherwise("COMPLETE")
    return j.withColumn("checks", checks).select("doc_id", "n_pages", "n_elements", "n_chunks", verdict.alias("verdict"), F.array_join("checks", "; ").alias("reasons"))


# Share of empty pages, share of recognised pages and mean confidence at which a check warns.
EMPTY_PAGES, OCR_PAGES, OCR_CONFIDENCE = 0.5, 0.8, 70.0


def document_checks(docs: DataFrame, pages: DataFrame, tables: DataFrame, figures: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """``doc_id, checks, verdict, reason``: six checks (array of struct(name, status, detail)); FAILED with one that fails, WARNING with one that warns.

    docs: doc_id, page_count, sheets, predicted_tables, vision_skipped; pages: doc_id, page_no, text, ocr_planned, ocr_used, conf;
    tables: doc_id, page_no; figures: doc_id, page_no, method; chunk_rows: doc_id, n_elements.
    """
    on_page = tables.select("doc_id", "page_no").unionByName(figures.select("doc_id", "page_no")).where("page_no is not null").distinct().withColumn("__held", F.lit(True))
    text = F.trim(F.coalesce("text", F.lit(""))) != ""
    p = pages.join(on_page, ["doc_id", "page_no"], "left")
    done = F.col("ocr_planned") & F.col("ocr_used") & text
    p = p.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(text | F.coalesce("__held", F.lit(False))).alias("content"), F.count_if("ocr_planned").alias("planned"), F.count_if(done).alias("done"),
        F.avg(F.when(done & (F.col("conf") > 0), F.col("conf"))).alias("conf"),
    )
    t = tables.groupBy("doc_id").agg(F.count("*").alias("tables"))
    v = figures.groupBy("doc_id").agg(F.count_if(F.col("method") == "vision").alias("vision"))
    c = chunk_rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("n_elements") > 0).alias("linked"))
    j = docs
    for part in (p, t, v, c):
        j = j.join(part, "doc_id", "left")
    j = j.fillna(0, ["pages", "content", "planned", "done", "tables", "vision", "chunks", "linked", "sheets", "predicted_tables", "vision_skipped"])
    col, text_of = F.col, lambda *x: F.concat(*(y.cast("string") if not isinstance(y, str) else F.lit(y) for y in x))
    check = lambda name, status, detail: F.struct(F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"))
    got = F.when(col("pages") > 0, col("pages")).otherwise(col("sheets"))
    short = (col("page_count") > 0) & (got < col("page_count"))
    empty = 1 - col("content") / col("pages")
    nothing = (col("pages") > 0) & (col("content") == 0) & (col("tables") == 0) & (col("sheets") == 0)
    sparse = (col("pages") > 0) & (empty > EMPTY_PAGES)
    share = col("done") / col("planned")
    none_read, few_read = (col("planned") > 0) & (col("done") == 0), (col("planned") > 0) & (share < OCR_PAGES)
    unsure = (col("planned") > 0) & (col("conf") < OCR_CONFIDENCE)
    lost = (col("predicted_tables") > 0) & (col("tables") == 0)
    unlinked = (col("chunks") > 0) & (col("linked") < col("chunks"))
    none_built = (col("chunks") == 0) & ((col("content") > 0) | (col("tables") > 0))
    checks = F.array(
        check("pages_processed", F.when(short, "fail").otherwise("pass"), F.when(short, text_of(got, "/", col("page_count"), " pages produced")).otherwise(text_of(got, " page(s)/sheet(s)"))),
        check("content_coverage", F.when(nothing | ((col("pages") == 0) & (col("sheets") == 0)), "fail").when(sparse, "warn").otherwise("pass"),
              F.when(nothing, "no text, tables or figures extracted").when(col("pages") == 0, text_of(col("sheets"), " sheet(s)")).when(sparse, text_of(F.round(empty * 100).cast("int"), "% pages empty")).otherwise(text_of(col("content"), "/", col("pages"), " pages"))),
        check("ocr_fidelity", F.when(none_read, "fail").when(few_read | unsure, "warn").otherwise("pass"),
              F.when(col("planned") == 0, "no OCR planned").when(none_read, text_of("0/", col("planned"), " planned pages OCR'd")).when(few_read, text_of(col("done"), "/", col("planned"), " pages OCR'd")).when(unsure, F.concat(F.lit("mean OCR confidence "), F.format_number("conf", 1), F.lit("%"))).otherwise(text_of(col("done"), "/", col("planned"), " pages"))),
        check("table_parity", F.when(lost, "warn").otherwise("pass"), F.when(lost, text_of(col("predicted_tables"), " ruled table(s) seen, none extracted")).otherwise(text_of(col("tables"), " table(s)"))),
        check("provenance", F.when(unlinked | none_built, "warn").otherwise("pass"), F.when(col("chunks") == 0, "no chunks built").when(unlinked, text_of(col("linked"), "/", col("chunks"), " chunks linked")).otherwise(text_of(col("chunks"), " chunks linked"))),
        check("vision", F.lit("pass"), text_of(col("vision"), " interpreted, ", col("vision_skipped"), " skipped")),
    )
    has = lambda status: F.exists("checks", lambda x: x["status"] == status)
    failed = F.transform(F.filter("checks", lambda x: x["status"] == "fail"), lambda x: F.concat(x["name"], F.lit(": "), x["detail"]))
    return j.withColumn("checks", checks).select("doc_id", "checks", F.when(has("fail"), "FAILED").when(has("warn"), "WARNING").otherwise("COMPLETE").alias("verdict"), F.array_join(failed, "; ").alias("reason"))
