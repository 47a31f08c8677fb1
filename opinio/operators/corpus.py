"""Corpus preparation (N10-N14, N17, J9 re-aimed, S7, S8).

* ``corpus_preprocess`` (N10): sentence split, optional umlaut digraphs,
  tokenisation, punctuation / stop-word removal, sentences of 2+ words.
* ``bigram_counts`` / ``bigram_phrases`` / ``bigram_rewrite`` (N11): the
  published phrase score ``(c_ab - min_count) / c_a / c_b * |vocab|`` with
  the library defaults (min_count 5, threshold 10) and a greedy
  left-to-right merge of accepted pairs.
* ``labelled_corpus`` (N12), ``one_hot_split`` (N14), ``train_classifier`` (N17).
* Pair augmentation (J9): the reference emits every same-label pair whose
  lengths sum below 512. Here ``pair_counts`` counts them exactly from
  per-class length histograms (no pair is materialised) and
  ``class_balance`` (N13) generates as many as bring a class to the size of
  the largest (or all there are), in rounds -- output grows with the samples,
  never with their square.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinio.functions.strings import umlaut_digraphs
from opinio.operators.ids import dense_ids
from opinio.operators.sentences import split_sentences
from opinio.session import by_repeats, checkpoint_dir, literal_set, scratch_path, write_once

# Punctuation tokens removed by the preprocessing, and the
# characters stripped from the remaining tokens.
PUNCTUATION_TOKENS = [".", "..", "...", ",", ";", ":", "(", ")", '"', "'", "[", "]",
                      "{", "}", "?", "!", "-", "–", "+", "*", "--", "''", "``"]
PUNCTUATION_CHARS = "?.!/;:()&+"
# Phrase detection defaults of the public library the
# reference uses (min_count 5, threshold 10, joined with '_').
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0
PHRASE_DELIMITER = "_"
# Pair augmentation keeps pairs shorter than 512 characters.
PAIR_MAX_LEN = 512
# An item's rounds are dealt out in pieces of 2 ** 10.
_ROUND_BITS = 10
# Rows are added to the gradient in blocks; each block passes over a dense matrix of all
# features and classes (786,432 numbers), as much work as 1 MB of rows, the library's default.
TRAIN_BLOCK_MB = 16
# Texts the reference treats as empty.
EMPTY_TEXTS = ["", "\n", "\r", "\r\n", "\t", " "]

TOKEN_PATTERN = r"[\pL\pN_]+|[^\pL\pN_\s]+"
_SENT_MARK = "\u0001"


def sentences(text: Column) -> Column:
    """Sentence split after ., ! or ? followed by whitespace."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + _SENT_MARK), _SENT_MARK)


def _without_stopwords(s: DataFrame, keys: list[str], stopwords: DataFrame) -> DataFrame:
    """Beyond the literal bound: an anti-join per token, the rest put together again."""
    t = s.select(*keys, F.posexplode("tokens").alias("_p", "word"))
    left = t.join(write_once(stopwords.select("word").distinct(), "stopwords"), "word", "left_anti")
    kept = F.transform(F.array_sort(F.collect_list(F.struct("_p", "word"))), lambda x: x["word"])
    return left.groupBy(*keys).agg(kept.alias("tokens"))


def corpus_preprocess(lines: DataFrame, key_cols: list[str], text_col: str = "text",
                      umlauts: bool = False, punctuation: bool = True,
                      stopwords: DataFrame | None = None, first_only: bool = False,
                      boundaries: DataFrame | None = None) -> DataFrame:
    """One output row per kept sentence: key cols, sentence_no, sentence.
    ``first_only`` reproduces the reference's early ``return`` (only the
    first qualifying sentence of each line). ``boundaries`` is a learned model of
    ``operators/sentences.py``; without it sentences end at every mark before a blank.

    The stop list is a hash set inside the token filter (``literal_set``), so
    nothing is exchanged; only a list beyond its byte bound is joined."""
    if boundaries is None:
        s = lines.select(*key_cols, F.posexplode(sentences(F.col(text_col))).alias("sentence_no", "s"))
    else:
        s = split_sentences(lines, key_cols, boundaries, text_col).withColumnRenamed("sentence", "s")
    if umlauts:
        s = s.withColumn("s", umlaut_digraphs(F.col("s")))
    stop: list[str] | None = []
    if stopwords is not None:
        if umlauts:
            stopwords = stopwords.select(umlaut_digraphs(F.col("word")).alias("word"))
        stop = literal_set(stopwords, "word")
    toks = F.regexp_extract_all(F.col("s"), F.lit(TOKEN_PATTERN), 0)
    if punctuation:
        toks = F.transform(F.filter(toks, lambda t: ~t.isin(PUNCTUATION_TOKENS)),
                           lambda t: F.translate(t, PUNCTUATION_CHARS, ""))
    if stop:
        toks = F.filter(toks, lambda t: ~t.isin(stop))
    # Exploded from an array of one, so that Catalyst doesn't tokenise again in every filter on the tokens.
    s = s.select(*key_cols, "sentence_no", F.explode(F.array(toks)).alias("tokens"))
    if stop is None:
        s = _without_stopwords(s, [*key_cols, "sentence_no"], stopwords)
    kept = s.filter(F.size("tokens") > 1)
    if first_only:
        first = Window.partitionBy(*key_cols).orderBy("sentence_no")
        kept = kept.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1).drop("_r")
    return kept.select(*key_cols, "sentence_no", F.array_join("tokens", " ").alias("sentence"))


def preprocess_text_files(spark: SparkSession, source: str, target: str, **options) -> DataFrame:
    """A line-to-line job: every line of the text files below ``source`` is preprocessed
    (``options`` of ``corpus_preprocess``) and every kept sentence becomes a line below ``target``.
    Lines are read and written where they lie; returns the written lines (``value``)."""
    lines = spark.read.option("lineSep", "\n").text(source).withColumnRenamed("value", "text")
    corpus_preprocess(lines, [], **options).select("sentence").write.mode("overwrite").text(target)
    return spark.read.option("lineSep", "\n").text(target)


def _sentence_tokens(sent: Column) -> Column:
    return F.filter(F.split(sent, " "), lambda t: t != "")


def bigram_counts(corpus: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """(a, b, cnt) over adjacent token pairs of every sentence."""
    t = corpus.select(F.explode(F.array(_sentence_tokens(F.col(sentence_col)))).alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n).alias("a"), F.slice("t", F.lit(2), n).alias("b"))
    p = t.select(F.explode(pairs).alias("p"))
    return p.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("cnt"))


def bigram_phrases(corpus: DataFrame, sentence_col: str = "sentence", min_count: int = PHRASE_MIN_COUNT,
                   threshold: float = PHRASE_THRESHOLD, stored: bool = False) -> DataFrame:
    """Accepted phrases (a, b, cnt, score); the vocabulary size counts
    distinct unigrams and bigrams, as the library does. The sentences (unless ``stored``, a
    written table) and both counts are written once; only pairs that can reach the
    threshold are joined with their words."""
    if not stored:
        corpus = write_once(corpus.select(sentence_col), "sentences")
    uni = write_once(corpus.select(F.explode(_sentence_tokens(F.col(sentence_col))).alias("w"))
                     .groupBy("w").agg(F.count(F.lit(1)).alias("c")), "unigrams")
    bi = write_once(bigram_counts(corpus, sentence_col), "bigrams")
    vocab = F.lit(uni.count() + bi.count())  # from the files' footers
    ua = uni.select(F.col("w").alias("a"), F.col("c").alias("ca"))
    ub = uni.select(F.col("w").alias("b"), F.col("c").alias("cb"))
    able = bi.where(F.col("cnt") > min_count) if threshold >= 0 else bi  # others score 0 at most
    j = able.join(ua, "a", "inner").join(ub, "b", "inner")
    score = (F.col("cnt") - F.lit(min_count)).cast("double") / F.col("ca") / F.col("cb") * vocab
    return (j.select("a", "b", "cnt", score.alias("score")).filter(F.col("score") > threshold)
            .select("a", "b", "cnt", F.round("score", 9).alias("score")))


#: Phrases that are broadcast at most, by number and bytes (a row counts its strings and 64 bytes).
PHRASE_BROADCAST_BYTES = 128 << 20


def bigram_rewrite(corpus: DataFrame, phrases: DataFrame, key_cols: list[str],
                   sentence_col: str = "sentence") -> DataFrame:
    """Rewrite each sentence joining accepted pairs with '_', greedily
    left to right (in a run of overlapping phrases every second position
    starts a phrase). Only the places of accepted pairs are exchanged and go back to
    their sentences by key; the tokens of sentences with equal keys are put in one order
    (``_rewrite_merged``). Windows are per sentence (bounded by its length)."""
    keys = key_cols + ["sentence_no"]
    phrases = write_once(phrases.select("a", "b"), "phrases")
    size = phrases.agg(F.sum(F.octet_length("a") + F.octet_length("b") + 64).alias("n")).first()["n"] or 0
    if size <= PHRASE_BROADCAST_BYTES:
        phrases = F.broadcast(phrases)
    once, repeated = by_repeats(corpus.select(*keys, sentence_col), *keys)
    once = once.select(*keys, F.explode(F.array(_sentence_tokens(F.col(sentence_col)))).alias("t")).where("t IS NOT NULL")
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n).alias("a"), F.slice("t", F.lit(2), n).alias("b"))
    places = (once.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", "p.a", "p.b")
              .join(phrases, ["a", "b"]).select(*keys, "pos"))
    # Neighbouring places differ from their rank by the same number.
    places = places.withColumn("_run", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    first = F.min("pos").over(Window.partitionBy(*keys, "_run"))
    taken = (places.withColumn("_start", first).where((F.col("pos") - F.col("_start")) % 2 == 0)
             .groupBy(*[F.col(c).alias(f"_k_{c}") for c in keys]).agg(F.array_sort(F.collect_list("pos")).alias("at")))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    whole = once.join(taken, same, "left")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("at", k - 1) + 2)

    def upto(p: Column, k: Column) -> Column:
        """The tokens behind the phrase before, and the phrase at ``p``."""
        return F.concat(F.array_join(F.slice("t", begin(k) + 1, p - begin(k) + 1), " "), F.lit(PHRASE_DELIMITER), F.get("t", p + 1))

    behind = F.element_at("at", -1) + 2
    rest = F.when(behind < F.size("t"), F.array_join(F.slice("t", behind + 1, F.size("t") - behind), " "))
    parts = F.concat(F.transform("at", upto), F.array(rest))
    sentence = F.when(F.col("at").isNull(), F.array_join("t", " ")).otherwise(F.array_join(parts, " "))
    out = whole.select(*keys, sentence.alias("sentence"))
    return out if repeated is None else out.unionByName(_rewrite_merged(repeated, phrases, keys, sentence_col))


def _rewrite_merged(corpus: DataFrame, phrases: DataFrame, keys: list[str], sentence_col: str) -> DataFrame:
    """``bigram_rewrite`` over all tokens of each key by their places, one row a key."""
    t = corpus.select(*keys, _sentence_tokens(F.col(sentence_col)).alias("t"))
    nxt = F.concat(F.slice("t", 2, F.size("t")), F.array(F.lit(None).cast("string")))
    z = t.select(*keys, F.posexplode(F.arrays_zip(F.col("t").alias("a"), nxt.alias("b"))).alias("pos", "p"))
    z = z.select(*keys, "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    ph = phrases.select("a", "b", F.lit(True).alias("cand"))
    z = z.join(ph, ["a", "b"], "left").withColumn("cand", F.coalesce("cand", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("pos")
    last_non = F.max(F.when(~F.col("cand"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    z = z.withColumn("_start", F.coalesce(last_non + 1, F.lit(0)))
    z = z.withColumn("taken", F.col("cand") & (((F.col("pos") - F.col("_start")) % 2) == 0))
    z = z.withColumn("prev_taken", F.coalesce(F.lag("taken").over(w), F.lit(False)))
    out = z.filter(~F.col("prev_taken")).select(
        *keys, "pos", F.when(F.col("taken"), F.concat_ws(PHRASE_DELIMITER, "a", "b")).otherwise(F.col("a")).alias("tok"))
    return (out.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))),
                                                            lambda s: s["tok"]), " ").alias("sentence")))


# ---- labelled corpus, balancing, split -------------------------------------------
def labelled_corpus(posts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Posts (id, headline, body) joined to consolidated annotations
    (id, category, value); sentiment categories map to -1/0/1. A post with a
    headline yields two samples (headline + ' ' + body, and body); empty
    samples are dropped."""
    cat = F.col("category")
    lab = (F.when(cat == "SentimentNegative", -1).when(cat == "SentimentNeutral", 0)
           .when(cat == "SentimentPositive", 1))
    a = (annotations.filter(cat.isin("SentimentNegative", "SentimentNeutral", "SentimentPositive")
                            & (F.col("value") == 1))
         .select(F.col("id"), lab.alias("label")))
    j = posts.join(a, "id", "inner")
    empty = F.array(*[F.lit(e) for e in EMPTY_TEXTS])
    has_h = ~F.array_contains(empty, F.coalesce(F.col("headline"), F.lit("")))
    s = j.select("id", "label", F.explode(F.array(
        F.struct(F.lit(0).alias("sample_no"),
                 F.when(has_h, F.concat_ws(" ", "headline", "body")).alias("text")),
        F.struct(F.lit(1).alias("sample_no"), F.col("body").alias("text")))).alias("s"))
    s = s.select("id", F.col("s.sample_no").alias("sample_no"), F.col("s.text").alias("text"), "label")
    return s.filter(F.col("text").isNotNull() & ~F.array_contains(empty, F.col("text")))


def _pair_items(samples: DataFrame) -> DataFrame:
    """Samples that can take part in a pair (length below the limit)."""
    return (samples.withColumn("len", F.length("text"))
            .filter(F.col("len") < PAIR_MAX_LEN))


def _cum_lengths(items: DataFrame) -> DataFrame:
    """Per label and every length L in 0..511: number of items with len <= L
    (bounded: 512 rows per label)."""
    hist = items.groupBy("label", "len").agg(F.count(F.lit(1)).alias("h"))
    grid = (items.select("label").distinct()
            .select("label", F.explode(F.sequence(F.lit(0), F.lit(PAIR_MAX_LEN - 1))).alias("len")))
    g = grid.join(hist, ["label", "len"], "left").fillna(0, ["h"])
    w = Window.partitionBy("label").orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("label", "len", "h", F.sum("h").over(w).alias("cum"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """J9 (re-aimed): per label, the exact number of unordered pairs whose
    lengths sum below 512 -- from length histograms, no pair enumerated."""
    items = _pair_items(samples)
    cum = _cum_lengths(items)
    partner = cum.select("label", (F.lit(PAIR_MAX_LEN - 1) - F.col("len")).alias("len"), "cum")
    h = cum.select("label", "len", "h").filter(F.col("h") > 0)
    j = h.join(partner.withColumnRenamed("cum", "cum_p"), ["label", "len"], "inner")
    ordered = F.sum(F.col("h") * F.col("cum_p"))
    selfp = F.sum(F.when(F.col("len") * 2 < PAIR_MAX_LEN, F.col("h")).otherwise(0))
    per = j.groupBy("label").agg(((ordered - selfp) / 2).cast("bigint").alias("n_pairs"),
                                 F.sum("h").cast("bigint").alias("n_items"))
    return per


def _partner_plan(items: DataFrame, need: DataFrame) -> DataFrame:
    """Per (label, len): ``_reach``, the number of items an item of that length
    fits with (a prefix of the length order), the last round ``_last`` that is
    needed to make ``need`` pairs (or the longest possible round) and ``_extra``,
    the number of pairs taken from it. A length's items lie next to each other, so
    their partner counts are one run of integers and the pairs of any number
    of rounds are a sum over at most 512 lengths: ``_last`` is found by bisection."""
    cum = _cum_lengths(items)
    reach = cum.select("label", (F.lit(PAIR_MAX_LEN - 1) - F.col("len")).alias("len"), F.col("cum").alias("_reach"))
    blocks = cum.where("h > 0").join(reach, ["label", "len"])
    zero = F.lit(0).cast("bigint")
    most = F.greatest(F.col("_reach") - 1 - (F.col("cum") - F.col("h")), zero)  # partners of the block's first item
    rest = F.greatest(F.col("_reach") - 1 - F.col("cum"), zero)                 # of the item after the block
    per = (blocks.groupBy("label").agg(F.collect_list(F.struct(most.alias("most"), rest.alias("rest"))).alias("_b"),
                                       F.sum("h").cast("bigint").alias("_m"))
           .join(need.where("need > 0"), "label"))

    def triangle(n: Column, r: Column) -> Column:  # sum of min(u, r) over u = 1..n
        k = F.least(n, r)
        return F.shiftright(k * (k + 1), 1) + (n - k) * r

    def pairs(r: Column) -> Column:  # pairs of the rounds 1..r
        return F.aggregate("_b", zero, lambda s, b: s + triangle(b["most"], r) - triangle(b["rest"], r))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        full = pairs(mid) >= F.col("need")
        return F.struct(F.when(full, s["lo"]).otherwise(F.least(mid + 1, s["hi"])).alias("lo"),
                        F.when(full, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(zero.alias("lo"), F.col("_m").alias("hi"))
    per = per.withColumn("_last", F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, halve)["hi"])
    per = per.select("label", "_last", (F.col("need") - pairs(F.col("_last") - 1)).alias("_extra"))
    return blocks.select("label", "len", "_reach").join(per, "label")


def class_balance(samples: DataFrame, key_col: str = "key") -> DataFrame:
    """N13 (re-aimed): keep every original sample and top up each class to
    the size of the largest with generated pair samples, so the output never
    exceeds classes x largest class. Items of a class are sorted by (length,
    md5(text), key); round r pairs item i with item i + r where both fit the
    length limit. Rounds are taken in order, items in order within a round, until
    the class is full or every pair that fits is used. Item i fits with a prefix
    of the order, so its number of partners follows from its place and the
    length histogram (``_partner_plan``) and only pairs that are kept are made,
    by one equi-join on (label, place)."""
    checkpoint_dir(samples.sparkSession)
    samples = samples.checkpoint(eager=True)
    orig = samples.groupBy("label").agg(F.count(F.lit(1)).alias("n_orig"))
    need = orig.select("label", (orig.agg(F.max("n_orig")).scalar() - F.col("n_orig")).alias("need"))
    items = _pair_items(samples).withColumn("_h", F.md5("text"))
    ranked = dense_ids(items, ["label", "len", "_h", key_col], 0, id_col="_gid")
    first = ranked.groupBy("label").agg(F.min("_gid").alias("_s"))
    ranked = ranked.join(F.broadcast(first), "label").withColumn("idx", F.col("_gid") - F.col("_s"))
    # Bounded: at most 512 rows a class.
    a = ranked.join(F.broadcast(_partner_plan(items, need)), ["label", "len"])
    fits = F.col("_reach") - 1 - F.col("idx")
    in_last = (fits >= F.col("_last")) & (F.col("idx") < F.col("_extra"))
    a = (a.withColumn("_k", F.least(fits, F.col("_last") - 1) + in_last.cast("bigint")).where("_k > 0")
         .select("label", "idx", "_k", F.col("text").alias("text_a"), F.col(key_col).alias("key_a"),
                 F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("_k") - 1, _ROUND_BITS))).alias("_c"))
         .repartition("label", "idx", "_c"))  # an item with many partners is spread over the tasks
    begin = F.shiftleft(F.col("_c"), _ROUND_BITS)
    a = (a.withColumn("r", F.explode(F.sequence(begin + 1, F.least(F.col("_k"), begin + (1 << _ROUND_BITS)))))
         .withColumn("idx_b", F.col("idx") + F.col("r")))
    b = ranked.select("label", F.col("idx").alias("idx_b"), F.col("text").alias("text_b"), F.col(key_col).alias("key_b"))
    generated = a.join(b, ["label", "idx_b"]).select(
        "label", F.concat_ws(" ", "text_a", "text_b").alias("text"),
        F.concat(F.lit("g:"), "key_a", F.lit("|"), "key_b").alias(key_col), F.lit("generated").alias("origin"))
    originals = samples.select("label", "text", F.concat(F.lit("o:"), F.col(key_col)).alias(key_col),
                               F.lit("original").alias("origin"))
    return originals.unionByName(generated)


def one_hot_split(samples: DataFrame, key_col: str = "key") -> DataFrame:
    """One-hot labels (neg, neu, pos) and an 80/10/10 split by position
    in a deterministic hash order (position % 10: 0 test, 1 val, else
    train)."""
    s = samples.withColumn("_h", F.md5("text"))
    pos = dense_ids(s, ["_h", key_col], -1, id_col="position")
    split = (F.when(F.col("position") % 10 == 0, "test").when(F.col("position") % 10 == 1, "val")
             .otherwise("train"))
    one_hot = F.array(*[F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in (-1, 0, 1)])
    return pos.select(key_col, "label", "text", one_hot.alias("labels"), "position", split.alias("split"))


def train_classifier(data: DataFrame, num_features: int = 1 << 18, max_iter: int = 20) -> DataFrame:
    """N17 (re-aimed): distributed text classifier (tokenise, hashed term
    frequencies, IDF, multinomial logistic regression) fitted on the train
    split; predictions for the test split as (key, label, prediction).
    Fitting reads the data several times (IDF, the summary, the optimiser's
    first pass, the test transform), so the hashed term frequencies are first
    written once with ``checkpoint()`` into the shared checkpoint folder: each
    pass then reads them instead of cutting and hashing the texts again, and a
    lost executor re-reads them rather than replaying the lineage."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    checkpoint_dir(data.sparkSession)
    d = data.filter(F.col("split").isin("train", "test")).withColumn("_y", (F.col("label") + 1).cast("double"))
    cut = RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"\s+")
    hashed = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    d = hashed.transform(cut.transform(d)).select("key", "label", "split", "_y", "_tf").checkpoint(eager=True)
    pipe = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="_feat"),
        LogisticRegression(featuresCol="_feat", labelCol="_y", family="multinomial", maxIter=max_iter,
                           maxBlockSizeInMB=TRAIN_BLOCK_MB),
    ])
    model = pipe.fit(d.filter(F.col("split") == "train"))
    pred = model.transform(d.filter(F.col("split") == "test"))
    return pred.select("key", "label", (F.col("prediction") - 1).cast("int").alias("prediction"))


def dataset_sink_roundtrip(data: DataFrame) -> DataFrame:
    """Write the split datasets as JSON (one folder per split) below the
    shared checkpoint folder and read them back."""
    path = scratch_path(data.sparkSession, f"datasets-{uuid.uuid4().hex}")
    data.select("split", "labels", F.col("text").alias("text_input")).write.partitionBy("split").json(path)
    return data.sparkSession.read.schema("labels array<double>, text_input string, split string").json(path)


def annotated_csv_filter(rows: DataFrame) -> DataFrame:
    """Write 5-column rows as CSV quoted with '|', read them back with the
    same quote char and keep rows whose column 4 is '1', column 5 empty and
    column 3 (the text) non-empty. Texts keep their line breaks and outer
    blanks; with line breaks inside quotes a file is one split, so the file
    count is the write's partition count."""
    spark = rows.sparkSession
    path = scratch_path(spark, f"annotated-{uuid.uuid4().hex}")
    options = {"quote": "|", "escape": "|", "multiLine": True, "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(path)
    back = (spark.read.options(**options)
            .schema("c0 string, c1 string, text string, flag string, extra string").csv(path))
    return back.filter((F.col("flag") == "1") & (F.coalesce(F.col("extra"), F.lit("")) == "")
                       & (F.coalesce(F.col("text"), F.lit("")) != ""))
