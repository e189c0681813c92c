"""Quality rules on documents, and verdicts on hosts from how often their documents fail.

Everything is built from Spark's own functions. Base rules: fewer than 50 words,
or more than half of the words in 3-word windows that the text repeats. The
failure rate of a host is shrunk towards the rates of all hosts: a beta prior
fitted by moments to the hosts' rates, so a host of few documents is not judged
by them alone. A host whose shrunk rate is over ``max_rate`` is rejected with
all its documents.

A null text has no words and fails. Documents without a host (null) form a host
of their own. Empty tables give empty results. Words are stretches without
ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelead.llm.text import words_column
from wavelead.storage import materialize

MIN_WORDS = 50
MAX_RATE = 0.5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
# Weight of a prior where the rates of the hosts give none, in documents.
DEFAULT_STRENGTH = 20.0


def _first(use, value: Column) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def positions(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - 2)
        windows = F.zip_with(
            F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            F.slice(w, 3, F.size(w)),
            lambda p, c: F.xxhash64(p["a"], p["b"], c),
        )
        keyed = F.zip_with(F.slice(windows, 1, F.size(w) - 2), at, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.array_sort(keyed)

    def shared(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("bigint")), ordered["h"])
        after = F.concat(F.slice(ordered["h"], 2, F.size(ordered)), F.array(F.lit(None).cast("bigint")))
        near = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        marked = F.zip_with(
            ordered, near, lambda o, n: F.when((o["h"] == n["b"]) | (o["h"] == n["a"]), o["i"])
        )
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        following = F.slice(at, 2, F.size(at))
        gaps = F.zip_with(at, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g)

    found = _first(lambda w: _first(shared, positions(w)), words)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_first(covered, found))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns that the rules look at; ``_words`` stays for further use."""
    value = F.coalesce(F.col(text), F.lit(""))

    def without(signs: str) -> Column:
        return F.length(value) - F.length(F.translate(value, signs, ""))

    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "*",
        words_column(value).alias("_words"),
        (F.length(value) - without(WHITE)).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        _first(lambda x: F.size(x) - F.size(F.array_distinct(x)), lines).cast("long").alias("n_dup_lines"),
    ).select("*", F.size("_words").cast("long").alias("n_words"), repeated_words(F.col("_words")).alias("n_repeat_words"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def host_verdicts(counted: DataFrame, host: str, failed: str, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, and whether the host is rejected.

    ``counted`` is aggregated in the tasks before it is shuffled, so a host with
    a third of all documents costs no more than others.
    """
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    # What the rates would vary by chance alone, as each host has so many documents, is no spread of the hosts.
    chance = F.avg(rate * (1 - rate) / F.col("n_docs"))
    moments = hosts.agg(F.avg(rate).alias("mean"), (F.var_pop(rate) - chance).alias("spread")).first()
    mean, strength = beta_prior(moments["mean"], moments["spread"])
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select(
        "host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("host_rejected")
    )


def beta_prior(mean: float | None, spread: float | None) -> tuple[float, float]:
    """Mean and weight of the beta law with the mean and variance of the hosts' rates.

    Where the rates spread no more than by chance, or wider than a beta law can be, the
    weight is ``DEFAULT_STRENGTH`` documents.
    """
    if mean is None:
        return 0.0, DEFAULT_STRENGTH
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 0.0
    return mean, strength if strength > 0 else DEFAULT_STRENGTH


def judge(
    docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), max_rate: float = MAX_RATE
) -> DataFrame:
    """Counts, base rule, shrunk rate of the host and verdict of every document, with its columns ``keep``.

    The counts are written once to the shared folder: the hosts are judged from
    them, and the verdicts joined to them. Hosts are few, so Spark broadcasts
    them as long as they are small by its own measure; beyond that it splits the
    partitions of hot hosts.
    """
    counted = text_counts(docs.select(*keep, F.col(host).alias("_host"), F.col("text").alias("_text")), "_text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    table = materialize(counted.select(*keep, "_host", *counts, failed.alias("base_failed")), "host-rules")
    hosts = host_verdicts(table, "_host", "base_failed", max_rate)
    verdicts = hosts.select("host", "shrunk_rate", "host_rejected")
    return table.join(verdicts, F.col("_host").eqNullSafe(F.col("host"))).select(
        *[F.col(c) for c in keep],
        *counts,
        "base_failed",
        "shrunk_rate",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def kept_documents(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules and the verdicts on hosts leave, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), host, "text")
    return judge(rows, host, ("_row",), max_rate).where("kept").select("_row.*")
