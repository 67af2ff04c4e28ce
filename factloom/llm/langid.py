"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are fused as log-probabilities: character trigrams of the text under per-language models, the language
that the markup declares, the suffix of the address (a language segment of the path, else the top-level domain), and the
host. How far declarations and suffixes can be trusted is itself counted: P(declared | language) and P(suffix | language) come
from grouped aggregation over all rows, with text evidence as the judge. Host priors are counts per host, smoothed towards
those of the host's domain, and those towards the counts of all rows.

Text models are fitted on at most ``per_language`` labelled texts of each language (smallest id hashes, at most ``longest``
characters), a documented bound. A label column of more than ``most_languages`` names is an error, as there are some 8,000 languages; a
task holds the models of ``at_once`` of them (131 MB) and texts pass once for each such part. All rows are judged over whole texts, and
all rows count in the aggregates, but for a row's own evidence its own decision is taken off. Trigrams overlap and are not independent, so a text's log-likelihood
is tempered by ``weight``, at every length alike.

Defined results: null or empty texts have no text evidence and are never accepted; null declarations, addresses and hosts
count as missing values of their own; repeated rows count each; without labelled texts the language is null; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import common
from factloom.llm.common import beside, cut, ship, small_batches, whole_text

BUCKETS = 1 << 15
_SKIPPED = re.compile(r"<(script|style|nav)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav")}


def visible(page: str) -> str:
    """Text of a page without markup, scripts, styles, comments and navigation; what is left open hides only its own tag.

    Each end is searched for from where the last search stopped, and not again once there is none, so the time is linear.
    """
    out, at = [], 0
    missing: set[str] = set()

    def end_of(kind: str, start: int) -> int:
        if kind in missing:
            return -1
        if kind in _ENDS:
            found = _ENDS[kind].search(page, start)
            end = found.end() if found else -1
        else:
            end = page.find(kind, start)
            end = end + len(kind) if end >= 0 else -1
        if end < 0:
            missing.add(kind)
        return end

    while (tag := page.find("<", at)) >= 0:
        out.append(page[at:tag])
        skipped = _SKIPPED.match(page, tag)
        end = end_of("-->", tag + 4) if page.startswith("<!--", tag) else end_of(skipped[1].lower(), tag) if skipped else -1
        if end < 0:
            end = end_of(">", tag)
        if end < 0:  # no tag is closed any more
            out.append(page[tag:])
            return html.unescape(" ".join(out))
        at = end
    out.append(page[at:])
    return html.unescape(" ".join(out))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of letters and single blanks."""
    letters = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    x = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(x) < 4:
        return np.zeros(0, dtype=np.int64)
    code = (x[:-2] * np.uint64(0x9E3779B1) ^ x[1:-1] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D) + x[2:] * np.uint64(0x27D4EB2F)
    return ((code ^ code >> np.uint64(23)) % np.uint64(BUCKETS)).astype(np.int64)


def declared_language(page):
    """The ``lang`` of the first ``html`` tag (a Column): the tag's end is found once, and only the tag is searched."""
    tag = F.regexp_extract(page, r"(?i)<html(\s[^>]*+)", 1)
    return F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([a-z]{2,3})", 1)


def two_letters(code):
    """A language code as ISO 639-1 has it (a Column); codes of three letters that have none stay as they are."""
    low = F.lower(F.regexp_extract(code, "^[A-Za-z]*", 0))
    short = F.element_at(F.create_map(*(F.lit(x) for kv in THREE_LETTERS.items() for x in kv)), low)
    return F.coalesce(short, low)


# Codes of three letters of the languages that have one of two.
THREE_LETTERS = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi",
    "ces": "cs", "cze": "cs", "slk": "sk", "slo": "sk", "hun": "hu", "ron": "ro", "rum": "ro", "bul": "bg", "ell": "el", "gre": "el", "tur": "tr", "ara": "ar", "heb": "he", "hin": "hi", "ben": "bn", "zho": "zh",
    "chi": "zh", "jpn": "ja", "kor": "ko", "vie": "vi", "tha": "th", "ukr": "uk", "hrv": "hr", "srp": "sr", "slv": "sl", "est": "et", "lav": "lv", "lit": "lt", "cat": "ca", "eus": "eu", "baq": "eu", "glg": "gl",
}


def text_models(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, longest: int = 50_000, most_languages: int = 10_000) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of the buckets, from a bounded sample of labelled texts.

    The smallest hashes of a language are found below a threshold that its number of texts gives, so only the sample is ranked.
    """
    ship(labelled.sparkSession)
    small_batches(labelled.sparkSession)
    short = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), whole_text(text_col).alias("text")).where((F.length("text") <= longest) & (F.col("lang") != "") & (F.col("text") != ""))
    order = Window.partitionBy("lang").orderBy("x", "id")
    ids = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.length(whole_text(text_col)).alias("n")).where((F.col("n") <= longest) & (F.col("n") > 0) & (F.col("lang") != ""))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("many")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    wanted = per_language + 10 * int(per_language**0.5)  # of so many drawn, fewer than per_language hardly ever come
    limits = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, wanted / r.many)))) if sizes else F.lit(None).cast("map<string,double>")
    drawn = ids.withColumn("x", F.xxhash64("id", F.lit(5)) / F.lit(2.0**64) + 0.5).where(F.col("x") <= F.element_at(limits, F.col("lang")))
    chosen = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
                if len(sums) > 256:
                    yield from sent(sums)
        yield from sent(sums)

    def sent(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while sums:
            lang, n = sums.popitem()
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    counted = short.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(langs)), 0.1)
    where = {name: i for i, name in enumerate(langs)}
    table[counted.column("bucket").to_numpy(), [where[x] for x in counted.column("lang").to_pylist()]] += counted.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True)) if langs else table


def text_evidence(rows: DataFrame, table: np.ndarray, markup: bool, weight: float) -> DataFrame:
    """Rows with the log-likelihoods of ``__text`` under the table's languages put after ``text_logs``, and its trigrams as ``n``."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = {name: rows.columns.index(name) for name in ("__text", "text_logs", "n")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            out, sizes = [], []
            for page, before in zip(batch.column("__text").to_pylist(), batch.column("text_logs").to_pylist()):
                codes = trigrams(visible(page) if markup else page)
                sizes.append(len(codes))
                out.append(before + ((logs[codes].sum(axis=0) * weight).tolist() if len(codes) else [0.0] * logs.shape[1]))
            columns = list(batch.columns)
            columns[at["text_logs"]], columns[at["n"]] = pa.array(out, pa.list_(pa.float64())), pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def identify(
    rows: DataFrame, langs: list[str], table: np.ndarray, id_col: str, text_col: str, declared_col: str | None, address_col: str | None, host_col: str | None,
    markup: bool = False, prior_strength: float = 20.0, weight: float = 0.25, sure: float = 0.9, at_once: int = 500,
) -> DataFrame:
    """``id_col, lang, posterior, text_lang, declared, suffix, accepted`` of every row.

    With ``markup`` the text column holds pages, whose ``html lang`` is the declaration.
    """
    spark = rows.sparkSession
    ship(spark)
    small_batches(spark)
    absent = F.lit(None).cast("string")
    text = whole_text(text_col)
    declared = declared_language(text) if markup else F.col(declared_col).cast("string") if declared_col else absent
    address = F.coalesce(F.col(address_col).cast("string"), F.lit("")) if address_col else F.lit("")
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)) if address_col else F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    segment = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    suffix = F.when(segment != "", segment).otherwise(F.concat(F.lit("."), F.regexp_extract(host, r"([^.]*)$", 1))) if address_col else F.lit("")
    listed = rows.select(
        F.col(id_col).alias("id"), text.alias("__text"), F.coalesce(two_letters(declared), F.lit("")).alias("declared"),
        suffix.alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"),
    )
    carried = ["id", "declared", "suffix", "host", "domain"]
    made = listed.withColumns({"text_logs": F.array().cast("array<double>"), "n": F.lit(0).cast("long")})
    for start in range(0, len(langs), at_once):
        made = text_evidence(made if not start else cut(made, "logs"), table[:, start : start + at_once], markup, weight)
    made = made.select(*carried, "text_logs", "n")
    names = F.array(*(F.lit(x) for x in langs)) if langs else F.array().cast("array<string>")
    best = F.get(names, F.array_position("text_logs", F.array_max("text_logs")).cast("int") - 1)
    made = cut(made.withColumn("text_lang", F.when(F.col("n") > 0, best)), "evidence")
    judged = made.where("text_lang is not null")

    if not langs:
        return made.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), "text_lang", "declared", "suffix", F.lit(False).alias("accepted"))

    def counts_of(keys: list[str], name: str) -> DataFrame:
        """Judged rows of each key: an array over the languages and its sum (a key has at most one entry a language)."""
        pairs = judged.groupBy(*keys, "text_lang").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "c"))).alias("m"), F.sum("c").alias(f"{name}_sum"))
        return pairs.select(*keys, F.transform(names, lambda x: F.coalesce(F.element_at("m", x), F.lit(0).cast("long"))).alias(f"{name}_n"), f"{name}_sum")

    def joined_to(rows: DataFrame, counts: DataFrame, keys: list[str], label: str) -> DataFrame:
        counts = cut(counts, label)
        return beside(rows, counts, keys, counts.count() * len(langs) <= 16 * common.FEW, "left")

    own = F.array_position(names, F.col("text_lang")) - 1
    one = F.col("text_lang").isNotNull().cast("int")
    others = lambda c: F.transform(c, lambda x, i: x - F.when(i == F.col("own"), 1).otherwise(0))  # noqa: E731  the row's own decision is no evidence for it
    given = lambda c: F.zip_with(others(f"{c}_n"), others("world_n"), lambda x, t: F.log((x + 0.5) / (t + 10.0)))
    smoothed = lambda c, prior: F.zip_with(others(f"{c}_n"), prior, lambda x, p: (x + prior_strength * p) / (F.col(f"{c}_others") + prior_strength))
    joined = joined_to(made, joined_to(counts_of(["host", "domain"], "host"), counts_of(["domain"], "domain"), ["domain"], "domains").drop("domain"), ["host"], "hosts")
    for key in ("declared", "suffix"):
        joined = joined_to(joined, counts_of([key], key), [key], key)
    joined = joined.crossJoin(F.broadcast(counts_of([], "world")))  # one row
    joined = joined.withColumns({"own": own, **{f"{c}_others": F.col(f"{c}_sum") - one for c in ("host", "domain", "world")}})
    overall = F.transform(others("world_n"), lambda x: (x + 1.0) / (F.col("world_others") + len(langs)))
    host_logs = F.transform(smoothed("host", smoothed("domain", overall)), lambda p: F.log(p))
    zero = F.array_repeat(F.lit(0.0), len(langs))
    total = F.col("text_logs")
    for logs in (given("declared"), given("suffix"), host_logs):
        total = F.zip_with(total, F.coalesce(logs, zero), lambda a, b: a + b)
    fused = joined.withColumn("logs", total).withColumn("top", F.array_max("logs"))
    fused = fused.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    fused = fused.withColumn("lang", F.get(names, F.array_position("logs", F.col("top")).cast("int") - 1))
    return fused.select(F.col("id").alias(id_col), "lang", "posterior", "text_lang", "declared", "suffix", ((F.col("n") > 0) & (F.col("posterior") >= sure)).alias("accepted"))
