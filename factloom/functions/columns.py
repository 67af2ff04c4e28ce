"""Column functions of the evidence model: numbers, quantities, periods, attributes and text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.vocabulary import ANALYTICAL, ATTRIBUTES, MONTHS, MULTIPLIERS, NO_VALUE, RANGES, STOPWORDS, UNITS

#: A number that doesn't continue a word, another number, a date or a range.
NUMBER = r"(?U)(?<![\w.-])[+-]?[0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?"
#: Letters, percent signs and apostrophes begin a word that may be a number word or a unit.
_WORD = "[a-z'%][a-z0-9'./%]*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _table(table: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _lookup(key: Column, table: dict[str, object]) -> Column:
    return F.element_at(_table(table), key)


def number_of(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("double")


def parse_number(s: Column) -> Column:
    """First number, with Indian or other grouping by commas."""
    return number_of(F.nullif(F.regexp_extract(s, "[+-]?[0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?", 0), F.lit("")))


def _words_after(after: Column) -> Column:
    """Up to four words that follow a number without other signs between; stops and slashes at their ends are dropped."""
    run = F.regexp_extract(F.lower(F.substring(after, 1, 80)), rf"^\s*((?:{_WORD}\s*){{0,4}})", 1)
    return F.transform(F.filter(F.split(run, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[./]+$", ""))


def _unit_of(words: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the longest unit phrase that begins a list of words, and how many words it takes; null and 0 where there is none."""
    phrase = lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " "))
    known = _table({u: u for u in UNITS})
    first = F.get(words, F.lit(0))
    tries = [(F.element_at(known, phrase(3)), 3), (F.element_at(known, phrase(2)), 2), (F.element_at(known, first), 1), (F.when(first.startswith("%"), "%"), 1), (F.element_at(known, F.substring_index(first, "/", 1)), 1)]
    one = F.coalesce(*(F.when(unit.isNotNull(), F.struct(unit.alias("unit"), F.lit(n).alias("taken"))) for unit, n in tries), F.struct(F.lit(None).cast("string").alias("unit"), F.lit(0).alias("taken")))
    return let(one, lambda x: use(x["unit"], x["taken"]))


def measure(number: Column, after: Column) -> Column:
    """struct(raw, value, unit, words) of a number and the text after it.

    The value is the number times a number word times the unit's factor, ``words`` how many words these two take.
    """

    def read(words: Column) -> Column:
        def with_word(many: Column) -> Column:
            def of(unit: Column, taken: Column) -> Column:
                factor = F.coalesce(_lookup(unit, {k: v[1] for k, v in UNITS.items()}), F.lit(1.0))
                return F.struct(
                    F.concat_ws(" ", number, F.when(many.isNotNull(), F.get(words, F.lit(0))), unit).alias("raw"), (number_of(number) * F.coalesce(many, F.lit(1.0)) * factor).alias("value"),
                    _lookup(unit, {k: v[0] for k, v in UNITS.items()}).alias("unit"), (taken + F.when(many.isNotNull(), 1).otherwise(0)).alias("words"),
                )

            return let(F.when(many.isNotNull(), F.slice(words, F.lit(2), F.size(words))).otherwise(words), lambda rest: _unit_of(rest, of))

        return let(_lookup(F.get(words, F.lit(0)), MULTIPLIERS), with_word)

    bare = F.struct(number.alias("raw"), number_of(number).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(0).alias("words"))
    return F.when(F.trim(after) == "", bare).otherwise(let(_words_after(after), read))  # most cells hold a number alone


def has_number(s: Column) -> Column:
    """Whether :func:`parse_quantity` gives a value: any digit does."""
    return s.rlike("[0-9]")


def _first_measure(s: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(number, text before it, text after it)`` of the first number of a text; null without one."""
    split = lambda parts: F.when(F.size(parts) > 1, let(F.regexp_extract(s, NUMBER, 0), lambda number: use(number, F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))
    return F.when(has_number(s), let(F.split(s, NUMBER, 2), split))


def parse_quantity(s: Column) -> Column:
    """First quantity of a text as struct(value, unit): number times number word times the unit's factor, and the canonical unit."""
    found = _first_measure(s, lambda number, before, after: let(measure(number, after), lambda m: F.struct(m["value"].alias("value"), m["unit"].alias("unit"))))
    return F.coalesce(found, F.struct(parse_number(s).alias("value"), F.lit(None).cast("string").alias("unit")))


def is_year(s: Column) -> Column:
    """A calendar or fiscal year, or a span of years, and nothing else."""
    bare = F.regexp_replace(F.upper(F.trim(s)), "^FY *'?", "")
    year = lambda x: F.coalesce(x.rlike(r"^(?:19|20)[0-9]{2}\z"), F.lit(False))

    def spans(parts: Column) -> Column:
        end = F.get(parts, F.lit(1))
        return year(F.get(parts, F.lit(0))) & ((F.size(parts) == 1) | ((F.size(parts) == 2) & F.length(end).between(2, 4) & end.try_cast("int").isNotNull()))

    return let(F.split(F.regexp_replace(bare, " *[–—-] *", "-"), "-"), spans)


def _judged(s: Column) -> Column:
    """struct(noise, value, unit) of a cell, its measure read once: noise is null without a number and for a null cell."""
    joined = lambda n: rf"^[0-9]{{1,4}}(?: *[–—./-] *[0-9]{{1,4}}){{{n}}}$"  # noqa: E731  parts of a date or a range

    def cell(raw: Column) -> Column:
        def words_left(number: Column, before: Column, after: Column) -> Column:
            words = lambda x: F.size(F.filter(F.regexp_extract_all(x, F.lit("([A-Za-z]{2,})"), 1), lambda w: w != ""))
            spare = lambda m: words(F.concat_ws(" ", before, after)) > words(m["raw"])
            noise = lambda m: shaped | spare(m) | (m["value"] < 0) | (number_of(number) < 1) | (F.length(F.regexp_extract(number, "[.]([0-9]*?)0*$", 1)) > 4)
            return let(measure(number, after), lambda m: F.struct(noise(m).alias("noise"), m["value"].alias("value"), m["unit"].alias("unit")))

        shaped = (raw == "") | F.lower(raw).isin(NO_VALUE) | raw.startswith("(") | is_year(raw) | raw.rlike(joined(2)) | raw.rlike("^[0-9]+ *[–—-] *[0-9]+$")
        return _first_measure(raw, words_left)

    return let(F.trim(s), cell)


def is_noise(s: Column) -> Column:
    """Cells that aren't measurable: blanks, footnotes, years, dates, ranges, words, negatives, fractions, computed decimals.

    A measurable cell is one number, at least one, with at most four decimals; beside its unit it has no word of two letters.
    """
    return F.coalesce(_judged(s)["noise"], F.lit(True))


def extract_value(s: Column) -> Column:
    """The quantity of a cell, or null if the cell is noise."""
    return let(_judged(s), lambda j: F.when(~j["noise"], F.struct(j["value"].alias("value"), j["unit"].alias("unit"))))


def end_of_march(d: Column) -> Column:
    """A position on 31 March belongs to the fiscal year that it ends."""
    return F.when((F.month(d) == 3) & (F.dayofmonth(d) == 31), F.make_date(F.year(d) - 1, F.lit(4), F.lit(1))).otherwise(d)


def normalize_period(s: Column) -> Column:
    """Start of the period that a text names: day, date with a month's name, span of years, FY year, or bare year."""
    day_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    part = lambda p, i: F.get(p, F.lit(i))
    first = lambda dates: F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
    numbers = F.split(F.translate(F.regexp_extract(s, "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}", 0), "/-", ".."), "[.]")
    numeric = let(numbers, lambda p: F.when(F.size(p) == 3, day_of(part(p, 2), part(p, 1), part(p, 0))))
    named = F.regexp_extract_all(F.lower(s), F.lit("([0-9]{1,2}[a-z]{0,2}\\s+[a-z]{3,9}[.]?\\s+[0-9]{4})"), 1)
    month = lambda p: _lookup(F.substring(part(p, 1), 1, 3), {m: str(i) for i, m in enumerate(MONTHS, 1)})
    worded = first(F.transform(named, lambda x: let(F.split(x, r"\s+"), lambda p: day_of(part(p, 2), month(p), F.regexp_extract(part(p, 0), "^[0-9]+", 0)))))
    start = lambda year, month: F.make_date(year, F.lit(month), F.lit(1))
    span = F.regexp_extract(s, "(?<![0-9])([0-9]{4})\\s*[–—-]\\s*(?:[0-9]{4}|[0-9]{2,3})(?![0-9])", 1).try_cast("int")
    fiscal = F.regexp_extract(s, "(?i)\\bFY\\s*'?([0-9]{2,4})(?![0-9])", 1).try_cast("int")
    ended = F.when(fiscal < 100, fiscal + 2000).otherwise(fiscal)
    bare = F.regexp_extract(s, "(?<![0-9])(19[0-9]{2}|20[0-9]{2})(?![0-9])", 1).try_cast("int")
    return F.coalesce(end_of_march(numeric), end_of_march(worded), start(span, 4), start(ended - 1, 4), start(bare, 1))


def fy_label(d: Column) -> Column:
    """FY2021-22 for a period that starts on 1 April, else the year; a dash for none."""
    fiscal = F.concat(F.lit("FY"), F.year(d), F.lit("-"), F.lpad(((F.year(d) + 1) % 100).cast("string"), 2, "0"))
    return F.when(d.isNull(), "-").when((F.month(d) == 4) & (F.dayofmonth(d) == 1), fiscal).otherwise(F.year(d).cast("string"))


def context_unit(s: Column) -> Column:
    """struct(unit, factor) of the longest unit phrase in a text without numbers, such as a column header."""
    pieces = F.transform(F.split(F.lower(s), "[^a-z0-9'./% ]+"), lambda x: F.transform(F.filter(F.split(x, " +"), lambda w: w.rlike(f"^{_WORD}$")), lambda w: F.regexp_replace(w, "[./]+$", "")))
    phrases = lambda words, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    known = F.filter(F.flatten(F.transform(pieces, lambda w: F.concat(*(phrases(w, n) for n in (1, 2, 3))))), lambda p: F.array_contains(F.lit(list(UNITS)), p))
    longest = F.element_at(F.array_sort(known, lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a > b, -1).when(a < b, 1).otherwise(0)), -1)
    best = lambda u: F.struct(_lookup(u, {k: v[0] for k, v in UNITS.items()}).alias("unit"), F.coalesce(_lookup(u, {k: v[1] for k, v in UNITS.items()}), F.lit(1.0)).alias("factor"))
    return let(F.when(F.size(known) > 0, longest), best)


def detect_attribute(s: Column) -> Column:
    """Attribute whose keyword stands last in a text; ties go to the earlier one in the vocabulary."""
    order = {w: (-(100 * i + j), name) for i, (name, words) in enumerate(ATTRIBUTES.items()) for j, w in enumerate(words)}
    names = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("order"), F.lit(name).alias("name")) for w, (i, name) in order.items()))

    def last(low: Column) -> Column:
        at = lambda k: F.when(low.contains(k["w"]), -F.length(F.call_function("substring_index", low, k["w"], F.lit(-1))) - F.length(k["w"]))  # noqa: E731  from the end
        found = F.filter(F.transform(names, lambda k: F.struct(at(k).alias("at"), k["order"].alias("order"), k["name"].alias("name"))), lambda x: x["at"].isNotNull())
        return F.array_max(found)["name"]

    return let(F.lower(s), last)


def in_range(attribute: Column, value: Column) -> Column:
    """Whether a value is plausible; attributes without a range always are."""
    out = F.lit(True)
    for name, (low, high) in RANGES.items():
        out = F.when(attribute == name, value.between(low, high)).otherwise(out)
    return out


def clean_text(s: Column) -> Column:
    """Without soft hyphens, with line-break hyphens closed and blanks collapsed."""
    s = F.regexp_replace(F.replace(s, F.lit("­"), F.lit("")), r"(?U)(\w)-\n(\w)", "$1$2")
    return F.trim(F.regexp_replace(s, "[ \t]+", " "))


def search_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"(?U)([\w']+)"), 1)


def search_token_count(s: Column) -> Column:
    return F.regexp_count(F.lower(s), F.lit(r"(?U)[\w']+"))


def keyword_tokens(s: Column, least: int = 3) -> Column:
    """Lower-case words without stop words and short ones."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"([a-z][a-z\-']+)"), 1), lambda w: (F.length(w) >= least) & ~w.isin(STOPWORDS))


def counted(items: Column) -> Column:
    """``array<struct<item, n>>``: how often each distinct item is in an array, sorted; counted inside the row, so nothing is shuffled. None of a null array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("item"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("n"))))[0]

    return F.transform(F.array(F.sort_array(items)), runs)[0]


def most_frequent(counts: Column, top: int) -> Column:
    """The ``top`` entries of :func:`counted` by count, then item: ``array<struct<less, item>>`` with the count below zero."""
    return F.slice(F.sort_array(F.transform(counts, lambda c: F.struct((-c["n"]).alias("less"), c["item"].alias("item")))), 1, top)


def token_count(s: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(s), r"\s+"), ""))


def embedding_prefix(title: Column, subsidiary: Column, doc_type: Column, keywords: Column) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), c) for n, c in (("Title", title), ("Subsidiary", subsidiary), ("Doc Type", doc_type), ("Keywords", keywords))))


def recency(d: Column, as_of: str) -> Column:
    """exp(-days / 365); 0.3 without a date."""
    return F.when(d.isNull(), 0.3).otherwise(F.exp(-F.greatest(F.datediff(F.lit(as_of).cast("date"), d), F.lit(0)) / 365))


def version_stem(filename: Column) -> Column:
    """File name without extension and one revision suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(filename), r"\.[a-z0-9]+$", ""), r"[ _-]*(?:rev(?:ised|ision)?|final|draft|copy|v)[ _-]*\d*$", "")


def route(s: Column) -> Column:
    """LISTING (begins with a word that asks for a list, or counts), NUMERIC_FACT (names a metric or a fiscal span) or SEMANTIC."""
    low = F.lower(s)
    listing = low.rlike(r"^\s*(?:list|enumerate|name)\b") | low.startswith("how many")
    span = s.rlike(r"(?i)\bFY\s*\d{2,4}\b|\b(?:19|20)\d{2}\s*[-–]\s*\d{2,4}\b")
    return F.when(listing, "LISTING").when(detect_attribute(s).isNotNull() | span, "NUMERIC_FACT").otherwise("SEMANTIC")


def is_analytical(s: Column) -> Column:
    """Whether a question asks for a comparison, a statistic or a chart."""
    return s.rlike(rf"(?i)\b(?:{'|'.join(ANALYTICAL)})\b")


def extractive_summary(s: Column, least: int = 320, most: int = 520) -> Column:
    """Leading sentences until they hold ``least`` characters, cut at ``most``."""
    sentences = F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), r"(?<=[.!?]) ")
    return F.substring(F.aggregate(sentences, F.lit(""), lambda a, x: F.when(F.length(a) >= least, a).otherwise(F.trim(F.concat_ws(" ", a, x)))), 1, most)


def excerpt(s: Column, after: int = 480) -> Column:
    """Text up to the end of the first sentence that ends after ``after`` characters."""
    at = F.locate(". ", s, after + 1)
    return F.when((F.length(s) > after) & (at > 0), F.substring(s, F.lit(1), at)).otherwise(s)


def stripped_citations(s: Column, allowed: Column) -> Column:
    """Text without [En] references that aren't among the allowed ones."""
    refs = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(\[E\d+\])"), 1))
    return F.aggregate(F.array_except(refs, allowed), s, lambda a, r: F.replace(a, r, F.lit("")))


def renumbered_citations(s: Column, n: Column) -> Column:
    """struct(text, old): the references [E1] to [En] that a text cites numbered anew from 1 in their order, and their old numbers.

    Others stay as they are. New numbers are never above old ones, so a fold in rising order meets none twice.
    """
    cited = F.filter(F.array_distinct(F.regexp_extract_all(s, F.lit(r"\[E([1-9][0-9]{0,8})\]"), 1)), lambda x: x.cast("int") <= n)

    def numbered(old: Column) -> Column:
        mark = lambda x: F.concat(F.lit("[E"), x.cast("string"), F.lit("]"))
        pairs = F.transform(old, lambda x, i: F.struct(x.alias("old"), (i + 1).alias("new")))
        return F.struct(F.aggregate(pairs, s, lambda a, p: F.replace(a, mark(p["old"]), mark(p["new"]))).alias("text"), old.alias("old"))

    return let(F.array_sort(F.transform(cited, lambda x: x.cast("int"))), numbered)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
