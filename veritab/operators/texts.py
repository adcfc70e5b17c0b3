"""Text retrieval and checking: related texts, passages, quotes, numbers, sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quotes import normal, normalise, quote_score
from ..functions.text import BARE_NAME_UNIQUENESS, NAME_RULES, VALUE_RULES, VALUE_SHARE, cosine, scrub, terms, words
from ..plans import lineage
from ..sources.shared import written

#: Share of a question's terms that a related text must hold, and how many at least.
RELATED_SHARE, RELATED_TERMS = 0.3, 2


def related(texts: DataFrame, questions: DataFrame, text_id: str, text: str, question_id: str, question: str) -> DataFrame:
    """Texts that hold enough of a question's terms: question_id, text_id, matched, score.

    Terms are joined, not texts with questions. A text that holds m of a question's n terms
    holds one of any n - m + 1 of them: only texts that share one of a question's rarest that
    many terms are looked at, so a term that most texts hold makes no candidates alone.
    """
    asked = questions.select(F.col(question_id).alias("q"), F.explode(terms(F.col(question))).alias("term"))
    held = texts.select(F.col(text_id).alias("t"), F.explode(terms(F.col(text))).alias("term"))
    # Texts are read once; the terms that some question has are written, and all the rest reads these.
    held = written(held.join(asked.select("term").distinct(), "term", "left_semi"), "terms")
    often = held.groupBy("term").agg(F.count("*").alias("k"))
    of_question = Window.partitionBy("q")
    sized = asked.join(often, "term", "left").withColumns(
        {"terms": F.count("*").over(of_question), "place": F.row_number().over(of_question.orderBy(F.coalesce("k", F.lit(0)), "term"))}
    )
    sized = sized.withColumn("least", F.greatest(F.lit(RELATED_TERMS), F.ceil(RELATED_SHARE * F.col("terms"))).cast("int"))
    rare = sized.where(F.col("place") <= F.col("terms") - F.col("least") + 1).select("q", "term")
    pairs = held.join(rare.hint("merge"), "term").select("q", "t").distinct()
    met = pairs.join(sized.select("q", "term", "terms", "least"), "q").join(held.hint("merge"), ["t", "term"], "left_semi")
    out = met.groupBy("q", "t", "terms", "least").agg(F.count("*").alias("matched")).where(F.col("matched") >= F.col("least"))
    return out.select(F.col("q").alias(question_id), F.col("t").alias(text_id), "matched", (F.col("matched") / F.col("terms")).alias("score"))


def passages(texts: DataFrame, id_col: str, text: str, terms: list[str], k: int = 12) -> DataFrame:
    """The ``k`` lines of each text with most of the given terms, at least one: id, line, hits."""
    lines = texts.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    wanted = F.array(*map(F.lit, sorted({t.lower() for t in terms})))
    scored = lines.withColumn("hits", F.size(F.array_intersect(words(F.col("content")), wanted))).where("hits > 0")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("hits"), "line"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select(id_col, "line", "hits")


#: Similarity of a quote that counts as found.
FUZZY = 0.9


def quoted(quotes: DataFrame, sources: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """Quotes with how well their source, found by ``key``, holds them: score, exact, verified.

    See ``quotes.similarity``. A quote without a source scores 0.
    """
    found = sources.select(key, F.col(text).alias("__source"))
    met = quotes.join(found, key, "left").withColumn("score", quote_score(F.col(quote), F.col("__source"))).drop("__source")
    return met.withColumns({"exact": F.col("score") == 1, "verified": F.col("score") >= FUZZY})


# What a number in a text looks like, and what is no number: code and dates.
_CODE, _DATE = "`[^`]*`", r"\b\d{4}-\d{2}(-\d{2})?([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\b"
_NUMBER = (
    r"(?:([<>≤≥])=?\s*)?(?<![\w.])(-)?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
    r"(?:[eE]([-+]?\d+)|\s?[\u00d7x*]\s?10\^?([-\u2212+]?\d+))?"
    r"(\s?%)?"
    r"(?:\s?(thousand|million|billion|[kKMB])\b)?"
    r"(?![\w.]*[A-Za-z_])"
)
_SCALES = {"thousand": 1e3, "k": 1e3, "K": 1e3, "million": 1e6, "M": 1e6, "billion": 1e9, "B": 1e9}
#: Whole numbers up to this are counted in words and need no source.
EXEMPT_MAX = 10


def claims(text: Column) -> Column:
    """The numbers that a text states: an array of (text, value, decimals, percent, scale, bound).

    Code, dates and words with digits are none; small whole numbers without a unit are exempt.
    ``bound`` is < or > where the text states a bound.
    """
    plain = F.regexp_replace(F.regexp_replace(text, _CODE, " "), _DATE, " ")
    part = lambda m, i: F.regexp_extract(m, _NUMBER, i)
    scales = F.create_map(*(F.lit(x) for kv in _SCALES.items() for x in kv))

    def claim(m: Column) -> Column:
        number = F.regexp_replace(part(m, 3), ",", "")
        power = F.translate(F.concat(part(m, 4), part(m, 5)), "\u2212", "-").try_cast("int")
        scale = F.coalesce(scales[part(m, 7)], F.lit(1.0)) * F.pow(F.lit(10.0), F.coalesce(power, F.lit(0)))
        value = number.cast("double") * F.when(part(m, 2) == "-", -1.0).otherwise(1.0)
        bound = F.when(part(m, 1).isin("<", "≤"), "<").when(part(m, 1).isin(">", "≥"), ">")
        decimals = F.length(F.regexp_extract(number, r"\.(\d+)", 1))
        fields = {"text": F.trim(m), "value": value, "decimals": decimals, "percent": part(m, 6) != "", "scale": scale, "bound": bound}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    found = F.transform(F.regexp_extract_all(plain, F.lit(f"({_NUMBER})"), F.lit(0)), claim)
    exempt = lambda c: c["bound"].isNull() & (c["decimals"] == 0) & (F.abs(c["value"]) <= EXEMPT_MAX) & ~c["percent"] & (c["scale"] == 1.0)
    return F.filter(found, lambda c: ~exempt(c))


def supported(claim: Column, pool: Column) -> Column:
    """Whether a stated number equals one of a pool to half a unit of its last digit, sign aside, or keeps its bound.

    A percentage equals a share too.
    """
    tolerance = 0.5 * F.pow(F.lit(10.0), -claim["decimals"]) * claim["scale"] * (1 + 1e-9)
    target = claim["value"] * claim["scale"]
    as_stated = lambda v: F.when(claim["percent"], v * 100).otherwise(v)
    near = lambda v: F.abs(F.abs(v) - F.abs(target)) <= tolerance
    equal = F.exists(pool, lambda v: near(v) | near(as_stated(v)))
    below, above = F.exists(pool, lambda v: as_stated(v) < target + tolerance), F.exists(pool, lambda v: as_stated(v) > target - tolerance)
    return F.coalesce(F.when(claim["bound"] == "<", below).when(claim["bound"] == ">", above).otherwise(equal), F.lit(False))


def all_numbers(text: Column) -> Column:
    """Every number written in a text or in JSON, as doubles."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",(?=[0-9]{3})", ""), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(1))
    return F.transform(found, lambda n: n.cast("double"))


def grounded(answers: DataFrame, sources: DataFrame, key: str, answer: str, source: str) -> DataFrame:
    """Answers with the numbers that none of their sources (text or JSON by ``key``) holds: key, answer, checked, unsupported, ok."""
    pools = sources.groupBy(key).agg(F.flatten(F.collect_list(all_numbers(F.col(source)))).alias("__pool"))
    met = answers.join(pools, key, "left").withColumn("__claims", claims(F.col(answer)))
    pool = F.coalesce(F.col("__pool"), F.array().cast("array<double>"))
    bad = F.array_distinct(F.transform(F.filter("__claims", lambda c: ~supported(c, pool)), lambda c: c["text"]))
    out = met.withColumns({"checked": F.size("__claims"), "unsupported": bad})
    return out.withColumn("ok", F.size("unsupported") == 0).select(key, answer, "checked", "unsupported", "ok")


def check_cells(cells: DataFrame, citations: DataFrame, passages_: DataFrame) -> DataFrame:
    """Values with their citations checked: cell, n_citations, verified, missing_labels, unsupported, ok.

    ``cells`` has cell, doc, value; ``citations`` cell, label, quote; ``passages_`` doc, label,
    ordinal, text. A quote may run on into passages next to its own that the cell cites too.
    Numbers of a value must be in its cited passages. A cell is ok with a citation, all of
    them verified, and no other number.
    """
    cited = cells.select("cell", "doc").join(citations, "cell").join(passages_, ["doc", "label"], "left")
    known = cited.where("ordinal is not null").select("cell", "ordinal", "text").distinct()
    run = Window.partitionBy("cell")  # the citations of one cell
    runs = known.withColumn("run", F.col("ordinal") - F.row_number().over(run.orderBy("ordinal")))
    joined = runs.groupBy("cell", "run").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])).alias("whole"))
    around = runs.join(joined, ["cell", "run"]).select("cell", "ordinal", "whole")
    scored = cited.join(around, ["cell", "ordinal"], "left").withColumn("score", F.greatest(quote_score(F.col("quote"), F.col("text")), quote_score(F.col("quote"), F.col("whole"))))
    by_cell = scored.groupBy("cell").agg(
        F.count("text").alias("n_citations"), F.count_if(F.col("score") >= FUZZY).alias("verified"), F.array_sort(F.collect_set(F.when(F.col("text").isNull(), F.col("label")))).alias("missing_labels"),
        F.flatten(F.collect_list(all_numbers(F.col("text")))).alias("pool"),
    )
    met = cells.select("cell", "value").join(by_cell, "cell", "left").withColumn("__claims", claims(F.coalesce("value", F.lit(""))))
    pool = F.coalesce(F.col("pool"), F.array().cast("array<double>"))
    bad = F.array_distinct(F.transform(F.filter("__claims", lambda c: ~supported(c, pool)), lambda c: c["text"]))
    out = met.select(
        "cell", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("missing_labels", F.array().cast("array<string>")).alias("missing_labels"), bad.alias("unsupported")
    )
    return out.withColumn("ok", (F.col("n_citations") > 0) & (F.col("verified") == F.col("n_citations")) & (F.size("missing_labels") == 0) & (F.size("unsupported") == 0))


def coerce(value: Column, kind: str, options: list[str] | None = None) -> Column:
    """A text value in the form of its kind, as (value, problem): list, number, category or text.

    List items stand between line breaks or "; "; a number is the first one written; a
    category is the option that reads alike.
    """
    problem = lambda bad, text: F.when(bad, text)
    out = F.trim(value)
    why = F.lit(None).cast("string")
    if kind == "list":
        items = F.filter(F.transform(F.split(value, "\n|;\\s"), F.trim), lambda x: x != "")
        out = F.to_json(items)
    elif kind == "number":
        found = F.regexp_extract(value, r"(-?\d[\d,]*(?:\.\d+)?)", 1)
        out = F.when(found == "", value).otherwise(F.regexp_replace(found, ",", "").cast("double").cast("string"))
        why = problem(value.isNotNull() & (found == ""), F.concat(F.lit('"'), value, F.lit('" is not a number')))
    elif kind == "category":
        match = F.coalesce(*(F.when(normal(value) == normalise(o), F.lit(o)) for o in options)) if options else F.lit(None).cast("string")
        out = F.coalesce(match, value)
        why = problem(value.isNotNull() & match.isNull(), F.concat(F.lit('"'), value, F.lit('" is not one of the options')))
    return F.struct(out.alias("value"), why.alias("problem"))


# Abbreviations that end no sentence.
ABBREVIATIONS = [
    "al", "e.g", "i.e", "eg", "ie", "etc", "fig", "figs", "eq", "eqs", "sec", "secs", "tab",
    "no", "nos", "vs", "cf", "dr", "mr", "ms", "prof", "approx", "resp", "ref", "refs", "vol",
    "pp", "ch", "inc", "ltd", "jr", "sr", "st", "dept", "univ", "min", "max", "avg", "std",
]
_SHORT = "(?i:" + "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS) + "|[a-z]|[a-z][.][a-z]|[a-z][.][a-z][.][a-z])"


def sentences(text: Column) -> Column:
    """Sentences: text cut after . ! or ? where a capital, digit or opening mark follows, not after abbreviations or initials.

    A fragment without three letters joins the sentence before it, and a sentence under 25
    characters the next one.
    """
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.split(flat, rf"(?<=[.!?][\"'”’)\]]?)(?<!(?:^|[\s(\[\"']){_SHORT}[.!?]) (?=[\p{{Lu}}0-9\"'(“\[])")
    few = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}]", "")) < 3
    last = lambda done: F.element_at(done, -1)
    front = lambda done: F.slice(done, F.lit(1), F.size(done) - 1)
    joined = F.aggregate(
        cut,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "", done)
        .when(F.size(done) == 0, F.when(few(s), done).otherwise(F.array(s)))
        .when(few(s) | (F.length(F.try_element_at(done, F.lit(-1))) < 25), F.concat(front(done), F.array(F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), s))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return joined


# Kinds of sections and the words of their headings, and how headings are numbered.
SECTION_WORDS = [
    ("abstract", r"abstract|summary"),
    ("keywords", r"keywords|index terms"),
    ("introduction", r"introduction|motivation"),
    ("background", r"background|preliminaries"),
    ("related_work", r"related work|related works|literature review|prior work|state of the art"),
    (
        "method",
        r"methods?|methodology|approach|proposed (?:method|approach)|study design|materials and "
        r"methods|research method(?:ology)?",
    ),
    ("experiments", r"experiments?|experimental setup|evaluation|experimental evaluation|setup"),
    ("results", r"results?|findings|results and discussion"),
    ("discussion", r"discussion"),
    ("limitations", r"limitations?|threats to validity|validity threats"),
    ("conclusion", r"conclusions?|concluding remarks|conclusion and future work"),
    ("future_work", r"future work|future directions"),
    ("acknowledgements", r"acknowledge?ments?"),
    ("references", r"references|bibliography|works cited"),
    ("appendix", r"appendix|appendices|supplementary material"),
]
NUMBERING = r"(?:\d+(?:\.\d+)*[.)]?\s*|(?:[IVXL]+|[A-Z])(?:[.)]\s*|\s+))?"


def section_kind(heading: Column) -> Column:
    """What a section is about: by its whole heading less the number, else by the words in it, else other."""
    title = F.trim(F.regexp_replace(heading, r"\s+", " "))
    bare = F.lower(F.regexp_replace(title, f"^{NUMBERING}", ""))
    out = F.when(title.isNull() | (title == ""), "other")
    for kind, pattern in SECTION_WORDS:
        out = out.when(title.rlike(f"(?i)^{NUMBERING}(?:{pattern})\\s*[:.]?$"), kind)
    for kind, pattern in SECTION_WORDS:
        out = out.when(bare.rlike(rf"\b(?:{pattern})\b"), kind)
    return out.otherwise("other")


def _running(line: Column) -> Column:
    """A line as it is compared with those of other pages: lower case, every number as ``#``, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


# 128 bits stand for a line where lines are counted, so that each one's text is moved once at most.
_HASH = ["__h1", "__h2"]


def _hashed(lines: DataFrame, line: str) -> DataFrame:
    plain = _running(F.col(line))
    return lines.withColumn("__line", plain).withColumns({"__h1": F.xxhash64("__line"), "__h2": F.xxhash64("__line", F.lit(1))})


def running_lines(lines: DataFrame, doc: str, page: str, line: str, least: float = 0.5, pages: int = 2) -> DataFrame:
    """Lines that repeat on ``least`` of a document's pages, digits aside, on ``pages`` at least: doc, line, n_pages.

    ``lines`` are those in the margins of pages. Their hashes are counted, and the text is looked
    up for lines that repeat alone.
    """
    rows = _hashed(lines, line)
    hashes = rows.select(doc, page, F.when(F.col("__line") != "", F.col("__h1")).alias("__h1"), "__h2").distinct()
    total = hashes.groupBy(doc).agg(F.count_distinct(page).alias("total"))
    counts = hashes.where("__h1 IS NOT NULL").groupBy(doc, *_HASH).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= pages)
    counts = counts.join(total, doc).where(F.col("n_pages") >= least * F.col("total")).drop("total")
    found = rows.select(doc, *_HASH, "__line").join(counts, [doc, *_HASH]).groupBy(doc, *_HASH).agg(F.min("__line").alias("__line"), F.first("n_pages").alias("n_pages"))
    return found.select(doc, F.col("__line").alias(line), "n_pages")


# Fixed value: a page number on its own, once numbers are ``#``.
PAGE_NUMBER = r"^(page\s*)?#(\s*(of|/)\s*#)?$"


def without_running_lines(lines: DataFrame, doc: str, page: str, line: str, margin: Column, least: float = 0.5, pages: int = 2) -> DataFrame:
    """Lines of pages without what runs through a document: margin lines that repeat, and page numbers in the margin.

    ``margin`` says which lines are in the margin of their page; all others stay. A document of
    one page has no repeated lines.
    """
    marked = _hashed(lines.withColumn("__margin", F.coalesce(margin, F.lit(False))), line)
    repeated = running_lines(lines.where(margin), doc, page, line, least, pages).select(doc, line)
    repeated = repeated.select(doc, F.xxhash64(line).alias("__h1"), F.xxhash64(line, F.lit(1)).alias("__h2"), F.lit(True).alias("__runs"))
    met = marked.join(repeated, [doc, *_HASH], "left")
    gone = F.col("__margin") & (F.col("__runs").isNotNull() | F.coalesce(F.col("__line").rlike(PAGE_NUMBER), F.lit(False)))
    return met.where(~gone).select(*lines.columns)


def retrieve_columns(columns: DataFrame, question: str, limit: int = 20, vector: list[float] | None = None) -> DataFrame:
    """The best columns (name, label, description) for a question: all their fields, points and score.

    3 points for each word of the question in name or label, 1 in the description, 1 for each
    that begins a word of the name; with a ``vector`` of the question a tenth of the points is
    added to the cosine with the column's ``embedding``. Columns without points and vector go.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked = words(F.lit(question))
    named, described = words(F.concat_ws(" ", F.regexp_replace(text("name"), "_", " "), text("label"))), words(text("description"))
    begins = F.size(F.filter(asked, lambda w: F.exists(named, lambda n: F.startswith(n, w))))
    points = 3 * F.size(F.array_intersect(asked, named)) + F.size(F.array_intersect(asked, described)) + begins
    near = cosine(F.col("embedding"), F.array(*map(F.lit, vector))) if vector else F.lit(None).cast("double")
    out = columns.withColumns({"points": points, "score": F.coalesce(near + 0.1 * points, points.cast("double"))})
    return out.where(F.col("points") > 0 if not vector else F.lit(True)).orderBy(F.desc("score"), "name").limit(limit)


def personal_by_name(column: str, uniqueness: float = 0.0) -> str | None:
    """Why a column holds personal data by its name; a bare ``name`` only if half its values differ."""
    for reason, pattern in NAME_RULES:
        if re.search(pattern, column):
            return reason
    return "person name" if column == "name" and uniqueness >= BARE_NAME_UNIQUENESS else None


def personal_by_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of which half the values or more look like personal data: column, reason, share; one pass."""
    rates = [
        F.struct(F.lit(c).alias("column"), F.lit(reason).alias("reason"), F.lit(i).alias("place"), F.avg(F.trim(F.col(c)).rlike(pattern).cast("double")).alias("share"))
        for c in columns
        for i, (reason, pattern) in enumerate(VALUE_RULES)
    ]
    found = df.agg(F.array(*rates).alias("r")).select(F.inline("r")).where(F.col("share") >= VALUE_SHARE)
    return found.groupBy("column").agg(F.min_by("reason", "place").alias("reason"), F.min_by("share", "place").alias("share"))


def masked(df: DataFrame, personal: set[str]) -> DataFrame:
    """A result without personal data: what is computed from personal columns is masked, other text is scrubbed.

    ``personal`` holds column names, or table.column, of the tables that ``df`` reads; its plan
    tells what each column is made from, through aliases, expressions, joins, unions and
    subqueries. Counts of a personal column stay. ``*`` masks all text.
    """
    names = {p.lower() for p in personal}

    def hidden(kind: str, found: lineage.Sources) -> bool:
        return "*" in names and kind == "string" or any(c.lower() in names or f"{t}.{c}".lower() in names for t, c in found)

    out = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may repeat
    columns = []
    for i, ((name, kind), found) in enumerate(zip(df.dtypes, lineage.sources(df, counts=False))):
        value = F.col(f"c{i}")
        if hidden(kind, found):
            value = F.when(value.isNotNull(), F.lit("<masked>"))
        elif kind == "string":
            value = scrub(value)
        columns.append(value.alias(name))
    return out.select(*columns)
