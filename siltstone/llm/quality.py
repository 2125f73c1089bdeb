"""Quality rules as weak supervision, with DataFrame functions only.

Nine rules vote good (1), bad (-1) or abstain (0) on a document. Expectation
maximisation over the histogram of vote patterns (3^9 rows at most, whatever the
corpus) estimates each rule's accuracy on good and on bad documents, and a
document is kept when its posterior probability of being good is 0.5 or more.

Defined results: a null text counts as empty, and a text of fewer than
``min_words`` words fails the base test; texts are read whole; repeated rows are
judged each; an empty table gives no rows; a model of no document of ``min_words``
words judges none; other columns are untouched, whatever their names, but those of
the names in ``ADDED`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, materialize, table

#: Rounds of expectation maximisation; the estimates settle well before.
ROUNDS = 30
#: Where it starts: share of good documents, accuracy on good and on bad ones.
START = (0.85, 0.99, 0.25)

RULES = ("symbols", "dup_lines", "repeats", "upper", "word_length", "distinct", "bang", "sentences", "marks")

#: Columns that ``assess`` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")

_WORDS = r"filter(split({t}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_GRAMS = "transform(sequence(0, size(ws) - 3), i -> concat_ws(' ', get(ws, i), get(ws, i + 1), get(ws, i + 2)))"
_HASHES = "transform(sequence(0, size(ws) - 3), i -> xxhash64(get(ws, i), get(ws, i + 1), get(ws, i + 2)))"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in three-word windows that the text holds twice; ``ws`` are the words.

    Windows are sorted only when two have one hash, so equal windows end up side
    by side; the covered positions are then counted from sorted starts.
    """
    windows = f"sort_array(transform({_GRAMS}, (g, i) -> struct(g AS g, i AS i)))"
    twins = "filter(ss, (s, k) -> s.g = get(ss, k - 1).g OR s.g = get(ss, k + 1).g)"
    covered = "aggregate(zip_with(slice(ps, 1, size(ps) - 1), slice(ps, 2, size(ps) - 1), (a, b) -> least(3, b - a)), 3, (x, y) -> x + y)"
    starts = _let("ss", windows, f"sort_array(transform({twins}, s -> s.i))")
    count = _let("ps", starts, f"if(size(ps) = 0, 0, {covered})")
    hashes = _let("hs", _HASHES, "size(array_distinct(hs)) = size(hs)")
    return f"CASE WHEN size(ws) < 3 THEN 0 WHEN {hashes} THEN 0 ELSE {count} END"


def _without(chars: str) -> str:
    return f"char_length({{t}}) - char_length(translate({{t}}, '{chars}', ''))"


def measure(df: DataFrame, text: str = "text", into: str = "_q") -> DataFrame:
    """Adds ``into``: a struct of the counts that the rules read."""
    t = "tt"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lines = _let("ls", rf"filter(split({t}, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')", "struct(size(ls) AS n, size(ls) - size(array_distinct(ls)) AS d)")
    body = f"""struct(
        CAST(size(ws) AS BIGINT) AS n_words,
        CAST(char_length(translate({t}, ' \\t\\n\\u000B\\f\\r', '')) AS BIGINT) AS word_chars,
        CAST({_without('#*$%&|<>').format(t=t)} AS BIGINT) AS n_symbols,
        {lines} AS lines,
        CAST({_repeat_words()} AS BIGINT) AS n_repeat_words,
        {_without(upper).format(t=t)} AS n_upper,
        {_without('!').format(t=t)} AS n_bang,
        {_without('.!?').format(t=t)} AS n_ends,
        size(array_distinct(ws)) AS n_distinct,
        regexp_count({t}, '[#*$%&|<>]+') AS n_marks)"""
    body = body.replace("\\f", "\\u000C")
    return df.withColumn(into, F.expr(_let(t, f"coalesce(`{text}`, '')", _let("ws", _WORDS.format(t=t), body))))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(counts: str = "_q") -> list[Column]:
    """The rules' votes, in the order of RULES, over the struct that ``measure`` makes."""
    n, q = F.col(f"{counts}.n_words"), lambda name: F.col(f"{counts}.{name}")
    return [
        _vote(q("n_symbols") * 100 <= n, q("n_symbols") * 100 > n * 10),
        _vote((q("lines.d") == 0) & (q("lines.n") >= 3), (q("lines.d") >= 3) & (q("lines.d") * 100 > q("lines.n") * 30)),
        _vote(q("n_repeat_words") * 100 <= n * 5, q("n_repeat_words") * 100 > n * 30),
        _vote(q("n_upper") * 100 <= q("word_chars") * 10, q("n_upper") * 100 > q("word_chars") * 40),
        _vote((q("word_chars") >= n * 3) & (q("word_chars") <= n * 9), (q("word_chars") * 2 < n * 5) | (q("word_chars") > n * 12)),
        _vote(q("n_distinct") * 100 >= n * 40, q("n_distinct") * 100 < n * 15),
        _vote(q("n_bang") * 100 <= n * 2, q("n_bang") * 100 > n * 20),
        _vote(q("n_ends") * 100 >= n * 3, q("n_ends") * 100 < n),
        _vote(q("n_marks") * 100 <= n * 2, q("n_marks") * 100 > n * 10),
    ]


def posteriors(patterns: DataFrame) -> DataFrame:
    """(code, votes, n) -> (code, good): probability that a document so voted on is good.

    ``patterns`` has a row for each vote pattern, so a bounded number; the rounds
    are one fold over them. A rule's accuracy on a class is among the votes that
    it cast, with one vote for and one against added.
    """
    r = len(RULES)
    chance = lambda good, bad: (
        f"aggregate(zip_with(x.votes, st.{good}, (v, a) -> CASE v WHEN {bad[0]} THEN ln(a) WHEN {bad[1]} THEN ln(1 - a) ELSE 0D END), 0D, (s, y) -> s + y)"
    )
    post = f"1 / (1 + exp(ln(1 - st.pi) + {chance('b', (-1, 1))} - ln(st.pi) - {chance('a', (1, -1))}))"

    def share(weight: str, hit: int) -> str:
        total = lambda test: f"aggregate(ps, 0D, (s, x) -> s + if(get(x.votes, r) {test}, {weight}, 0D))"
        return f"transform(sequence(0, {r - 1}), r -> ({total(f'= {hit}')} + 1) / ({total('<> 0')} + 2))"

    pi = "(aggregate(ps, 0D, (s, x) -> s + x.p * x.n) + 1) / (aggregate(ps, 0D, (s, x) -> s + x.n) + 2)"
    step = _let(
        "ps",
        f"transform(xs, x -> struct(x.votes AS votes, x.n AS n, {post} AS p))",
        f"struct({pi} AS pi, {share('x.p * x.n', 1)} AS a, {share('(1 - x.p) * x.n', -1)} AS b)",
    )
    start = f"struct(CAST({START[0]} AS DOUBLE) AS pi, array_repeat(CAST({START[1]} AS DOUBLE), {r}) AS a, array_repeat(CAST({START[2]} AS DOUBLE), {r}) AS b)"
    every = patterns.agg(F.sort_array(F.collect_list(F.struct("code", "votes", F.col("n").cast("double").alias("n")))).alias("xs"))
    fitted = every.withColumn("st", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (st, k) -> {step})"))
    return fitted.selectExpr("explode(transform(xs, x -> struct(x.code AS code, " + post + " AS good))) AS g").select("g.code", "g.good")


def assess(df: DataFrame, text: str = "text", min_words: int = 50, carry_text: bool = False) -> DataFrame:
    """Adds ``n_words``, the base counts, ``base_failed``, ``quality`` (posterior, null where the base test failed) and ``kept``.

    The votes are made and written once, with the input's columns, of which the text
    is left out unless ``carry_text``; columns of the added names are replaced. The
    histogram is joined back by broadcast, as it has 3^9 rows at most.
    """
    names = [f"`{c}`" for c in df.columns if c not in ADDED and (carry_text or c != text)]
    q, code, cast, failed = fresh(df, "_q", "_code", "_votes", "_failed")
    number = sum(((v + 1) * 3**i for i, v in enumerate(votes(q))), F.lit(0))
    measured = measure(df, text, q).withColumn(code, number).withColumn(cast, F.array(*votes(q)))
    n, rep = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    measured = measured.withColumn(failed, (n < min_words) | (rep * 100 > n * 50))
    own = materialize(measured.select(*names, q, code, cast, failed), "quality")
    patterns = own.filter(n >= min_words).groupBy(F.col(code).alias("code")).agg(F.first(cast).alias("votes"), F.count("*").alias("n"))
    good = posteriors(patterns).select(F.col("code").alias(code), F.col("good").alias("quality"))
    quality = F.when(~F.col(failed), F.col("quality"))
    return own.join(F.broadcast(good), code, "left").select(
        *names,
        n.alias("n_words"), F.col(f"{q}.word_chars").alias("word_chars"), F.col(f"{q}.n_symbols").alias("n_symbols"),
        F.col(f"{q}.lines.d").cast("long").alias("n_dup_lines"), rep.alias("n_repeat_words"), F.col(failed).alias("base_failed"),
        quality.alias("quality"), F.coalesce(quality >= 0.5, F.lit(False)).alias("kept"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs).drop("quality")
