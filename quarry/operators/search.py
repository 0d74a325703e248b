"""Lexical search: BM25 over weighted fields with prefix terms, exact names first.

A query needs every term, each as a prefix of some token in any field. Two ways to the same scores: `bm25_scan` reads the
documents once and counts inside each row (one query, no shuffle but one row of totals), `build_postings` and
`bm25_postings` serve many queries in one job from an index that was written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.incremental import keep

#: BM25 constants, and the weights of path, name, qualified name, signature and body.
K1, B = 1.2, 0.75
WEIGHTS = {"path": 2.0, "name": 8.0, "qualified_name": 6.0, "signature": 4.0, "body": 1.0}
LEAST_IDF = 1e-6
#: Tokens of a highlighted snippet, what stands for text left out, worth of a term's first match and of a window
#: that begins with the text or with a sentence.
SNIPPET_TOKENS, LEFT_OUT, FIRST_MATCH, AT_TEXT, AT_SENTENCE = 18, " … ", 1000, 120, 100
#: Terms of all queries up to which they are sent to every executor.
BROADCAST_TERMS = 20_000


def _idf(n: Column, docs: Column) -> Column:
    idf = F.log((docs - n + 0.5) / (n + 0.5))
    return F.when(idf > 0, idf).otherwise(LEAST_IDF)


def _part(idf: Column, f: Column, length: Column, mean: Column) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _begins(term: str):  # noqa: ANN202
    return lambda token: token.startswith(term)


def _weighing(weight: float):  # noqa: ANN202
    return lambda token: F.struct(token.alias("token"), F.lit(float(weight)).alias("w"))


def spread(df: DataFrame) -> DataFrame:
    """A few large input splits dealt out to all cores before work on texts; inputs of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bm25_scan(docs: DataFrame, fields: dict[str, float], terms: list[str], tokenize=T.tokens, columns: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """The columns of docs (all, unless named) with `bm25`, for rows that match all terms; statistics are over all docs.

    Texts are read and tokenized once: what is kept of a row for the second look are its counts and the columns.
    """
    columns = columns or docs.columns
    arrays = docs.select(*columns, *[tokenize(F.col(name)).alias(f"_t_{name}") for name in fields])
    length = sum((F.size(f"_t_{name}") for name in fields), F.lit(0))
    sums = [sum((F.lit(w) * F.size(F.filter(f"_t_{name}", _begins(t))) for name, w in fields.items()), F.lit(0.0)).alias(f"_f{i}") for i, t in enumerate(terms)]
    rows = keep(arrays.select(*columns, length.alias("_length"), *sums), "counts")
    totals = rows.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(terms))])
    joined = rows.crossJoin(F.broadcast(totals))  # one row of totals
    for i in range(len(terms)):
        joined = joined.where(F.col(f"_f{i}") > 0)
    score = sum((_part(_idf(F.col(f"_n{i}"), F.col("_docs")), F.col(f"_f{i}"), F.col("_length"), F.col("_mean")) for i in range(len(terms))), F.lit(0.0))
    return joined.select(*columns, score.alias("bm25"))


def build_postings(docs: DataFrame, key: str, fields: dict[str, float], tokenize=T.tokens, prefixes: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """(key, token, f, length): each document's distinct tokens with their weighted counts and the document's length.

    With prefixes, only tokens that begin with one of them are kept: an index for the queries at hand. Tokens are sorted and
    counted within their row, so that none of them moves.
    """
    held = docs.select(F.col(key).alias("key"), *[tokenize(F.col(name)).alias(f"_t{i}") for i, name in enumerate(fields)])
    length = sum((F.size(f"_t{i}") for i in range(len(fields))), F.lit(0))
    wanted = lambda t: t if prefixes is None else F.filter(t, lambda x: T.any_of([x.startswith(p) for p in prefixes]))
    if len(fields) == 1:
        held = held.select("key", length.alias("length"), F.sort_array(wanted(F.col("_t0"))).alias("_s"))
        token = lambda x: x
    else:
        led = F.concat(*[F.transform(wanted(F.col(f"_t{i}")), _weighing(w)) for i, w in enumerate(fields.values())])
        held = held.select("key", length.alias("length"), F.sort_array(led).alias("_s"))
        token = lambda x: x["token"]
    begins = F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (token(x) != token(F.get("_s", i - 1))), i)), lambda i: i.isNotNull())
    held = held.select("key", "length", "_s", begins.alias("_b"))
    ends = F.concat(F.slice("_b", F.lit(2), F.greatest(F.size("_b") - 1, F.lit(0))), F.array(F.size("_s")))

    def run(i: Column, j: Column) -> Column:
        if len(fields) == 1:
            f = (j - i) * F.lit(float(next(iter(fields.values()))))
        else:
            f = F.aggregate(F.slice("_s", i + 1, j - i), F.lit(0.0), lambda total, x: total + x["w"])
        return F.struct(token(F.get("_s", i)).alias("token"), f.alias("f"))

    runs = F.when(F.size("_b") > 0, F.zip_with("_b", ends, run))
    return held.select("key", "length", F.explode_outer(runs).alias("x")).select("key", F.col("x.token").alias("token"), "length", F.col("x.f").alias("f"))


def bm25_postings(postings: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, bm25) for every query; queries are (query_id, terms), stats one row (docs, mean).

    Postings meet the terms, which every task gets if they were counted few, on the first letter and are cut by the prefix.
    """
    terms = queries.select("query_id", F.size("terms").alias("wanted"), F.posexplode("terms").alias("term_no", "term")).withColumn("term", T.folded(F.col("term")))
    head = lambda c: F.substring(c, 1, 1)
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    hits = postings.where("token is not null").join(terms, (head(F.col("token")) == head(F.col("term"))) & F.col("token").startswith(F.col("term")))
    each = hits.groupBy("query_id", "wanted", "term_no", "key", "length").agg(F.sum("f").alias("f"))
    n = each.groupBy("query_id", "term_no").agg(F.count(F.lit(1)).alias("n"))
    scored = each.join(n, ["query_id", "term_no"]).crossJoin(F.broadcast(stats))
    part = scored.withColumn("p", _part(_idf(F.col("n"), F.col("docs")), F.col("f"), F.col("length"), F.col("mean")))
    return part.groupBy("query_id", "key", "wanted").agg(F.sum("p").alias("bm25"), F.count(F.lit(1)).alias("got")).where("got = wanted").select("query_id", "key", "bm25")


def statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.max("length").alias("length")).agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))


def highlights(rows: DataFrame, text: str, terms: str, out: str, n: int = SNIPPET_TOKENS) -> DataFrame:
    """Rows with `out`: the n tokens of a text that hold most of the terms, tokens that begin with one in brackets.

    A window lies around the matches that follow one of them, or begins with that match's sentence. It is worth FIRST_MATCH for
    each term that is met and 1 for each further match, more at the begin of a text or sentence; the first of the best is
    shown. Without a match it is the text's begin; null or empty texts give the empty text. Meant for rows that are shown.
    """
    no = F.array().cast("array<int>")
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(no)
    told = rows.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_terms", F.transform(terms, T.folded))
    told = told.withColumn("_words", F.regexp_extract_all("_text", F.lit(T.TOKEN), F.lit(0))).withColumn("_gaps", F.split("_text", T.TOKEN, -1))
    told = told.withColumn("_plain", F.transform("_words", T.folded)).withColumn("_n", F.size("_words"))
    hit = lambda i: F.exists("_terms", lambda t: F.get("_plain", i).startswith(t))
    told = told.withColumn("_hits", F.filter(upto(F.col("_n")), hit))
    told = told.withColumn("_starts", F.filter(upto(F.col("_n")), lambda i: (i == 0) | F.get("_gaps", i).rlike("[.:][ \\t\\n\\r]+$")))

    def worth(at: Column) -> Column:
        window = F.slice("_plain", at + 1, F.lit(n))
        met = F.transform("_terms", lambda t: F.size(F.filter(window, lambda w: w.startswith(t))))
        return F.aggregate(met, F.lit(0), lambda total, k: total + F.when(k > 0, FIRST_MATCH - 1 + k).otherwise(0))

    def around(at: Column) -> Column:
        last = F.array_max(F.filter("_hits", lambda i: (i >= at) & (i < at + n)))
        begin = at - F.floor((n - (last + 1 - at)) / 2).cast("int")
        return F.greatest(F.least(begin, F.col("_n") - n), F.lit(0))

    def windows(i: Column, turn: Column) -> Column:
        sentence = F.array_max(F.filter("_starts", lambda x: x <= i))
        bonus = F.when(F.col("_n") <= n, 0).when(sentence == 0, AT_TEXT).otherwise(AT_SENTENCE)
        one = lambda at, more, order, begin: F.struct(at.alias("at"), more.alias("more"), order.alias("order"), begin.alias("begin"))
        near = one(i, F.lit(0), -2 * turn, around(i))
        return F.when(sentence < i, F.array(near, one(sentence, bonus, -2 * turn - 1, sentence))).otherwise(F.array(near))

    told = told.withColumn("_windows", F.flatten(F.transform("_hits", windows)))
    best = F.array_max(F.transform("_windows", lambda x: F.struct((worth(x["at"]) + x["more"]).alias("value"), x["order"], x["begin"].alias("begin"))))
    told = told.withColumn("_begin", F.when(F.size("_hits") > 0, best["begin"]).otherwise(0))
    told = told.withColumn("_end", F.least(F.col("_begin") + n, F.col("_n")))
    word = lambda i: F.when(hit(i), F.concat(F.lit("["), F.get("_words", i), F.lit("]"))).otherwise(F.get("_words", i))
    led = lambda i: F.concat(F.when(i == F.col("_begin"), "").otherwise(F.get("_gaps", i)), word(i))
    shown = F.array_join(F.transform(F.filter(upto(F.col("_n")), lambda i: (i >= F.col("_begin")) & (i < F.col("_end"))), led), "")
    before = F.when(F.col("_begin") > 0, LEFT_OUT).otherwise(F.get("_gaps", F.lit(0)))
    after = F.when(F.col("_end") < F.col("_n"), LEFT_OUT).when(F.col("_n") > 0, F.get("_gaps", F.col("_n"))).otherwise("")
    return told.withColumn(out, F.concat(before, shown, after)).drop("_text", "_terms", "_words", "_gaps", "_plain", "_n", "_hits", "_starts", "_windows", "_begin", "_end")


def exact_then_text(exact: DataFrame, text: DataFrame, identity: list[str], order: list[str], limit: int, request: list[str] = ()) -> DataFrame:  # noqa: B006
    """Exact hits first, then text hits in their order; the first of each identity stays, `limit` in all; adds `position`.

    Both have the same columns. With `request` columns, each request has its own hits and positions.
    """
    both = exact.withColumn("phase", F.lit(0)).unionByName(text.withColumn("phase", F.lit(1)))
    first = both.withColumn("_k", F.row_number().over(Window.partitionBy(*request, *identity).orderBy("phase", *order))).where("_k = 1").drop("_k")
    if not request:
        first = first.orderBy("phase", *order).limit(limit)  # a bounded top, so one small window may number it
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*request).orderBy("phase", *order))).where(F.col("position") <= limit)
