"""Learned sentence boundaries (N10): an unsupervised detector in the manner of
Kiss and Strunk (2006), as distributed counts and a tagged split.

Learning (``learn_boundaries``) reads the lines twice and keeps two small tables of
counts: per word type how often it occurs, with a final period, in lower case and
capitalised inside a sentence (``word_types``); per word that ends in a mark, the word after it
(``marked_pairs``). From these follow, by log-likelihood ratios:

* abbreviations: types that nearly always carry a period, short, with inner periods;
* sentence starters: capitalised words frequent after certain sentence ends;
* collocations: an abbreviation, initial or number with the word after it ("3. Mai");
* openers: words that are capitalised only where a sentence begins.

The model is a table (kind, key), so it can be written, read back and joined.

Splitting (``split_sentences``): a word that ends in ``!``, ``?`` or a period of no
abbreviation, initial, number or ellipsis ends a sentence. After an abbreviation, initial or ellipsis
one ends only if an opener or a starter follows; after a number unless the next word is in lower
case; never inside a collocation. Texts keep their blanks inside a sentence.

Plan: learning counts the words as they stand first (a hot word costs a row a task) and
parses each distinct one once. Splitting takes the words beside each place behind a mark once, as an
array, and is one projection: the model's keys are hash sets in the expression, below
``session.LITERAL_BYTES`` a kind; a larger model is joined with the places behind marks only
(their two words, without texts) and the answers go back to the lines by key.

A U+0001 inside a text ends a sentence, as a line break does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.session import LITERAL_BYTES, write_once

# Thresholds of the published method and its share of periods.
ABBREVIATION_SCORE = 0.3
STARTER_RATIO = 30.0
COLLOCATION_RATIO = 7.88
PERIOD_SHARE = 0.99
# Blanks both engines agree on, and quotes and brackets around words.
BLANK = r" \t\n\x0B\f\r"
OPENING = r"\"'(\[{„“”»«‚‘’"
CLOSING = r"\"')\]}“”»«‘’"
END_MARKS = ".,;:!?"
NUMBER = "##"
KINDS = ("abbreviation", "starter", "collocation", "opener")
_MARK = "\u0001"
_BLANKS = " \t\n\x0B\f\r"


def _plain(char_class: str) -> Column:
    """The characters of a class, for the trim functions: a scan of a word's ends, no pattern."""
    return F.lit(char_class.replace("\\", ""))


def _spaced(text: Column) -> Column:
    """Every blank as a space: functions of plain strings suffice from here on."""
    return F.regexp_replace(text, r"[\t\n\x0B\f\r]", " ")


def core(word: Column) -> Column:
    """A word without the quotes and brackets around it."""
    return F.rtrim(F.ltrim(word, _plain(OPENING)), _plain(CLOSING))


def word_end(c: Column) -> Column:
    """How a core ends: 'e' ellipsis, '.', '!' (also ?), '' none."""
    return (F.when(c.endswith(".."), "e").when(c.endswith("."), ".")
            .when(c.endswith("!") | c.endswith("?"), "!").otherwise(""))


def word_type(c: Column) -> Column:
    """The type of a core: lower case, without end marks; numbers are one type."""
    t = F.lower(F.rtrim(c, F.lit(END_MARKS)))
    return F.when(t.rlike(r"^[0-9][0-9.,]*$"), NUMBER).otherwise(t)


def word_case(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{Lu}"), "u").when(c.rlike(r"^\p{Ll}"), "l").otherwise("o")


def _segments(text: Column) -> Column:
    """A line cut behind every mark before a blank; the blanks stay with the part before."""
    trimmed = F.rtrim(text, F.lit(_BLANKS))
    return F.split(F.regexp_replace(trimmed, f"([.!?][{CLOSING}]*[{BLANK}]+)", "$1" + _MARK), _MARK)


def word_types(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """(typ, n, n_dot, n_lower, n_upper_mid) of every word type. A word is inside a
    sentence unless it is the first of a segment."""
    s = lines.select(F.explode(_segments(F.col(text_col))).alias("s"))
    w = s.select(F.posexplode(F.split(F.trim(_spaced(F.col("s"))), " +")).alias("at", "cur")).where("cur <> ''")
    seen = w.groupBy("cur").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") > 0).alias("n_mid"))
    w = seen.select(core(F.col("cur")).alias("c"), "n", "n_mid")
    w = w.select(word_type(F.col("c")).alias("typ"), word_end(F.col("c")).alias("end"), word_case(F.col("c")).alias("case"), "n", "n_mid")

    def among(rows: Column, count: str, name: str) -> Column:
        return F.sum(F.when(rows, F.col(count)).otherwise(0)).alias(name)

    return w.where("typ <> ''").groupBy("typ").agg(
        F.sum("n").alias("n"), among(F.col("end") == ".", "n", "n_dot"), among(F.col("case") == "l", "n", "n_lower"),
        among(F.col("case") == "u", "n_mid", "n_upper_mid"))


def marked_pairs(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """(typ, end, next_typ, next_case, n): words that end in a mark with the next word of the line,
    which are the words around the cuts between segments."""
    s = lines.select(_bare_edges(_segments(F.col(text_col))).alias("e"))
    w = s.select(F.explode(_places("e")).alias("p")).select(F.col("p.a.last").alias("cur"), F.col("p.b.first").alias("next"))
    w = w.groupBy("cur", "next").agg(F.count(F.lit(1)).alias("n"))
    w = w.select(core(F.col("cur")).alias("c"), core(F.col("next")).alias("f"), "n")
    w = w.select(word_type(F.col("c")).alias("typ"), word_end(F.col("c")).alias("end"), word_type(F.col("f")).alias("next_typ"),
                 word_case(F.col("f")).alias("next_case"), "n")
    return w.where("end <> ''").groupBy("typ", "end", "next_typ", "next_case").agg(F.sum("n").alias("n"))


def _bare_edges(segments: Column) -> Column:
    """The first and last word of every segment as they stand."""
    bare = F.transform(segments, lambda g: F.trim(_spaced(g)))
    return F.transform(bare, lambda g: F.struct(F.substring_index(g, " ", -1).alias("last"), F.substring_index(g, " ", 1).alias("first")))


def _places(edges: str) -> Column:
    """(a, b): neighbouring segments of an array column."""
    n = F.greatest(F.size(edges) - 1, F.lit(0))
    return F.arrays_zip(F.slice(edges, F.lit(1), n).alias("a"), F.slice(edges, F.lit(2), n).alias("b"))


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def log_likelihood(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's ratio of two events counted ``a`` and ``b`` times, ``both`` together, of ``total``."""
    a, b, both, total = (x.cast("double") for x in (a, b, both, total))
    cells = (_x_log_x(both) + _x_log_x(a - both) + _x_log_x(b - both) + _x_log_x(total - a - b + both))
    margins = _x_log_x(a) + _x_log_x(total - a) + _x_log_x(b) + _x_log_x(total - b)
    return 2 * (cells + _x_log_x(total) - margins)


def _kind(typ: Column, end: Column, is_abbreviation: Column) -> Column:
    """'!' or 'p' certain ends, 'e' ellipsis, 'n' number, 'i' initial, 'a' abbreviation."""
    return (F.when(end != ".", end).when(typ == NUMBER, "n").when(typ.rlike(r"^\p{L}$"), "i")
            .when(is_abbreviation, "a").otherwise("p"))


def learn_boundaries(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """The model (kind, key) of the lines' own statistics, written once."""
    types = write_once(word_types(lines, text_col), "word-types")
    pairs = write_once(marked_pairs(lines, text_col), "marked-pairs")
    sums = types.agg(F.sum("n").alias("n"), F.sum("n_dot").alias("d")).first()  # two numbers
    words, dots = sums["n"] or 0, sums["d"] or 0
    total = F.lit(words)

    n, k = F.col("n").cast("double"), F.col("n_dot").cast("double")
    share = dots / words if dots else 0.5  # without periods there are no candidates
    rest = F.when(n > k, (n - k) * (F.ln(F.lit(1 - PERIOD_SHARE)) - F.ln(F.lit(1 - share)))).otherwise(0.0)
    ratio = 2 * (k * (F.ln(F.lit(PERIOD_SHARE)) - F.ln(F.lit(share))) + rest)
    letters = F.length(F.replace("typ", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("typ") - letters
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, k - n)
    abbreviations = write_once(
        types.where((F.col("n_dot") > 0) & F.col("typ").rlike(r"\p{L}") & ~F.col("typ").rlike(r"^\p{L}$") & F.lit(share < 1))
        .where(score >= ABBREVIATION_SCORE).select("typ"), "abbreviations")

    known = abbreviations.withColumn("is_abbreviation", F.lit(True))
    marked = pairs.join(known, "typ", "left").select(
        "typ", "next_typ", "next_case", F.col("n").alias("c"),
        _kind(F.col("typ"), F.col("end"), F.coalesce("is_abbreviation", F.lit(False))).alias("kind"))
    certain = marked.where(F.col("kind").isin("p", "!"))
    breaks = F.lit(certain.agg(F.sum("c").alias("c")).first()["c"] or 0)
    after = (certain.where((F.col("next_case") == "u")).groupBy("next_typ").agg(F.sum("c").alias("c"))
             .join(types.select(F.col("typ").alias("next_typ"), "n"), "next_typ"))
    starters = after.where((F.col("c") * total > breaks * F.col("n"))
                           & (log_likelihood(breaks, F.col("n"), F.col("c"), total) >= STARTER_RATIO)).select(F.col("next_typ").alias("key"))
    together = (marked.where(F.col("kind").isin("a", "i", "n") & (F.col("next_typ") != ""))
                .groupBy("typ", "next_typ").agg(F.sum("c").alias("c"))
                .join(types.select("typ", F.col("n_dot").alias("a")), "typ")
                .join(types.select(F.col("typ").alias("next_typ"), F.col("n").alias("b")), "next_typ"))
    collocations = together.where(
        (F.col("c") > 1) & (F.col("c") * total > F.col("a") * F.col("b"))
        & (log_likelihood(F.col("a"), F.col("b"), F.col("c"), total) >= COLLOCATION_RATIO)
    ).select(F.concat_ws(" ", "typ", "next_typ").alias("key"))
    openers = types.where("n_lower > 0 AND n_upper_mid = 0 AND n > n_lower").select(F.col("typ").alias("key"))
    kinds = zip(KINDS, (abbreviations.select(F.col("typ").alias("key")), starters, collocations, openers))
    model = None
    for kind, keys in kinds:
        rows = keys.select(F.lit(kind).alias("kind"), "key")
        model = rows if model is None else model.unionByName(rows)
    return write_once(model, "boundaries")


def _ends(kind: Column, case: Column, collocation: Column, opens: Column) -> Column:
    """Whether a sentence ends between two words."""
    return (F.when(kind.isin("p", "!"), True).when(collocation, False)
            .when(kind == "n", case != "l").otherwise((case == "u") & opens))


def _edges(segments: Column) -> Column:
    """Per segment (typ, end) of its last word and (next_typ, case) of its first one."""
    cores = F.transform(_bare_edges(segments), lambda e: F.struct(core(e["last"]).alias("last"), core(e["first"]).alias("first")))
    return F.transform(cores, lambda e: F.struct(
        word_type(e["last"]).alias("typ"), word_end(e["last"]).alias("end"),
        word_type(e["first"]).alias("next_typ"), word_case(e["first"]).alias("case")))


def _member(col: Column, values: list[str]) -> Column:
    return col.isin(values) if values else F.lit(False)


def _literal_sets(model: DataFrame, limit: int) -> dict[str, list[str]] | None:
    """The model's keys by kind, or None if a kind takes more than ``limit`` bytes (counted first)."""
    sizes = model.groupBy("kind").agg(F.sum(F.octet_length("key") + 16).alias("b")).collect()  # a row a kind
    if any(r["b"] > limit for r in sizes):
        return None
    sets: dict[str, list[str]] = {kind: [] for kind in KINDS}
    for r in model.collect():
        sets[r["kind"]].append(r["key"])
    return sets


def _joined_answers(segments: DataFrame, keys: list[str], model: DataFrame) -> DataFrame:
    """(keys, digest, open): the places of a line where no sentence ends, by joins
    of the undecided places with the model's kinds."""
    p = segments.where(F.size("edges") > 1).select(*keys, "digest", F.posexplode(_places("edges")).alias("at", "p"))
    p = p.select(*keys, "digest", (F.col("at") + 1).alias("at"), "p.a.typ", "p.a.end", "p.b.next_typ", "p.b.case")
    certain = _kind(F.col("typ"), F.col("end"), F.lit(True)).isin("p", "!")
    p = p.where(~certain)  # an end whatever the model holds
    p = p.withColumn("pair", F.concat_ws(" ", "typ", "next_typ"))
    for kind, on in zip(KINDS, ("typ", "next_typ", "pair", "next_typ")):
        own = model.where(F.col("kind") == kind).select(F.col("key").alias(on), F.lit(True).alias(kind))
        p = p.join(own, on, "left").withColumn(kind, F.coalesce(kind, F.lit(False)))
    ends = _ends(_kind(F.col("typ"), F.col("end"), F.col("abbreviation")), F.col("case"), F.col("collocation"),
                 F.col("starter") | F.col("opener"))
    return p.where(~ends).groupBy(*keys, "digest").agg(F.collect_set("at").alias("open"))


def split_sentences(lines: DataFrame, key_cols: list[str], model: DataFrame, text_col: str = "text",
                    literal_bytes: int | None = None) -> DataFrame:
    """key_cols, sentence_no (from 0), sentence of every line; blank lines give none, a null line
    gives none. Rows that share their keys and text stay apart rows."""
    sets = _literal_sets(model, LITERAL_BYTES if literal_bytes is None else literal_bytes)
    s = lines.select(*key_cols, _segments(F.col(text_col)).alias("segments")).withColumn("edges", _edges(F.col("segments")))
    if sets is None:
        s = s.withColumn("digest", F.md5(F.array_join("segments", _MARK)))
        null_safe = [s[c].eqNullSafe(F.col(f"_o_{c}")) for c in [*key_cols, "digest"]]
        answers = _joined_answers(s, key_cols, model)
        answers = answers.select(*[F.col(c).alias(f"_o_{c}") for c in [*key_cols, "digest"]], "open")
        s = s.join(answers, null_safe, "left").select(*key_cols, "segments", F.coalesce("open", F.array().cast("array<int>")).alias("open"))
        parts = F.transform("segments", lambda seg, i: F.when((i == 0) | F.array_contains("open", i), seg)
                            .otherwise(F.concat(F.lit(_MARK), seg)))
    else:
        def ends(a: Column, b: Column) -> Column:
            kind = _kind(a["typ"], a["end"], _member(a["typ"], sets["abbreviation"]))
            pair = _member(F.concat_ws(" ", a["typ"], b["next_typ"]), sets["collocation"])
            return _ends(kind, b["case"], pair, _member(b["next_typ"], sets["starter"]) | _member(b["next_typ"], sets["opener"]))

        n = F.size("edges") - 1
        cuts = F.zip_with(F.slice("edges", F.lit(1), n), F.slice("edges", F.lit(2), n), ends)
        cuts = F.concat(F.array(F.lit(False)), cuts)  # the first segment goes on from none
        parts = F.zip_with(cuts, "segments", lambda cut, seg: F.when(cut, F.concat(F.lit(_MARK), seg)).otherwise(seg))
    whole = s.select(*key_cols, F.posexplode(F.split(F.array_join(parts, ""), _MARK)).alias("sentence_no", "sentence"))
    sentence = F.btrim("sentence", F.lit(_BLANKS))
    return whole.select(*key_cols, "sentence_no", sentence.alias("sentence")).where("sentence <> ''")
