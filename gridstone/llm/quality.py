"""Quality rules by document, and host verdicts from shrunken failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import written

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: A host goes if its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
#: A document of an average host may have so large a share of its words in repeated windows; a worse host's, less.
REPEAT_SHARE = 0.5
#: A host at which so large a share of the documents breaks a soft rule, shrunken, is not trusted with others that break it.
DISTRUST = 0.05
#: The soft rules: over one symbol in ten words, over three in ten lines repeated.
SOFT_RULES = {"symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines"}


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by hash with their places; places of hashes that have
    an equal neighbour are merged in order. A one-element array bound to a
    lambda holds each sorted array, so that it is computed once.
    """
    last = F.size(words) - 3
    hashed = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    twice = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])), lambda x: x["i"]))
    places = F.flatten(F.transform(F.array(hashed), twice))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("at"))
    total = F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n"), p.alias("at")), lambda acc: acc["n"])
    return F.when(last >= 1, total).otherwise(F.lit(0).cast("bigint"))


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed; a null text has no words.

    n_lines counts the lines that hold a word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    with_words = docs.withColumn("__gs_w", word_array(t)).withColumn("__gs_l", lines)
    long = lambda c: c.cast("bigint")
    out = with_words.withColumns(
        {
            "n_words": long(F.size("__gs_w")),
            "word_chars": long(F.length(F.translate(t, SPACES, ""))),
            "n_symbols": long(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
            "n_lines": long(F.size("__gs_l")),
            "n_dup_lines": long(F.size("__gs_l") - F.size(F.array_distinct("__gs_l"))),
            "n_repeat_words": repeat_words(F.col("__gs_w")),
        }
    ).drop("__gs_w", "__gs_l")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _shrunken(n: Column, failed: Column, rows: float, hosts: int, squares: float, bad: float, bad_squares: float) -> Column:
    """Posterior mean of a host's failure rate under the hosts' own beta prior.

    The moments are sums over the hosts: rows n, their number, n squared, bad
    rows, and bad rows squared by n. The variance between hosts is what that
    of their rates exceeds the variance inside hosts by (rows weigh alike, so
    many hosts of a row each say little), and gives the prior's weight, 1 to
    1000 rows: hosts that differ no more than by chance share the mean.
    """
    mean = bad / rows if rows else 0.0
    between = 0.0
    if rows > hosts > 1:
        inside = (bad - bad_squares) / (rows - hosts)
        across = (bad_squares - bad * mean) / (hosts - 1)
        between = (across - inside) * (hosts - 1) / (rows - squares / rows)
    weight = min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1000.0)
    return (failed + F.lit(mean * weight)) / (n + F.lit(weight))


def host_verdicts(checked: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE, soft: dict[str, str] | None = None, distrust: float = DISTRUST) -> DataFrame:
    """host, n, n_failed, rate, share, host_kept and, for each soft rule, distrusts_<name>, for each host.

    rate is the share of rows that ``failed`` names, shrunken to the hosts'
    own beta prior (``_shrunken``): a host with few rows is drawn to the mean
    and one with many keeps its own rate. share is what a document of the host
    may repeat: REPEAT_SHARE up to the mean rate, and above it less, as the
    host's chance of a good document falls below the mean's. A soft rule is a
    SQL condition of checked (a null counts as not broken); a host is
    distrusted in it if its shrunken rate of broken ones is above distrust.
    """
    soft = soft or {}
    broken = {f"__gs_s{k}": F.coalesce(F.expr(condition), F.lit(False)) for k, condition in enumerate(soft.values())}
    counts = [F.count_if(c).alias(name) for name, c in broken.items()]
    hosts = checked.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("n_failed"), *counts)
    counted = ["n_failed", *broken]
    n = F.col("n").cast("double")
    sums = [F.sum(n), F.count("*"), F.sum(n * n), *[x for c in counted for x in (F.sum(F.col(c).cast("double")), F.sum(F.col(c).cast("double") * F.col(c) / n))]]
    rows, n_hosts, squares, *bad = [x or 0 for x in hosts.agg(*sums).first()]
    rates = {c: _shrunken(F.col("n"), F.col(c), rows, n_hosts, squares, *bad[2 * k : 2 * k + 2]) for k, c in enumerate(counted)}
    m = bad[0] / rows if rows else 0.0
    above = F.when(F.col("rate") > F.lit(m), F.lit(REPEAT_SHARE) * (1 - F.col("rate")) / F.lit(1 - m)) if m < 1 else F.lit(None).cast("double")
    out = hosts.withColumn("rate", rates["n_failed"]).withColumn("share", F.coalesce(above, F.lit(REPEAT_SHARE))).withColumn("host_kept", F.col("rate") <= F.lit(max_rate))
    return out.withColumns({f"distrusts_{name}": rates[c] > F.lit(distrust) for name, c in zip(soft, broken, strict=True)}).drop(*broken)


def quality(
    docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",), max_rate: float = MAX_HOST_RATE, soft: dict[str, str] | None = None, distrust: float = DISTRUST
) -> DataFrame:
    """The ``keep`` columns with the features, base_failed and kept for each row.

    Features are computed once and written without the texts; counts by host
    are pre-aggregated before their shuffle, and the verdict table (one row a
    host) is joined back, null hosts to each other. Spark's own size check
    decides on a broadcast; beyond it the sort-merge join can split a hot host.
    A document stays if it passes the base rules, its host's shrunken failure
    rate is max_rate at most, its repeated words keep within the share that
    the host's rate leaves it, and it breaks no soft rule (SOFT_RULES unless
    given: name and SQL condition of the features) in which its host is
    distrusted (``host_verdicts``). A host where such documents are rare keeps
    them. A null text has no words and fails. An empty table gives an empty
    result.
    """
    soft = SOFT_RULES if soft is None else soft
    thin = docs.select(*[F.col(c) for c in keep], F.col(host).alias("__gs_host"), F.col(text).alias("__gs_text"))
    checked = written(document_features(thin, "__gs_text").drop("__gs_text"), "quality")
    doubts = [f"distrusts_{name}" for name in soft]
    verdicts = host_verdicts(checked, "__gs_host", "base_failed", max_rate, soft, distrust).select("host", "host_kept", "share", *doubts)
    joined = checked.join(verdicts, F.col("__gs_host").eqNullSafe(F.col("host")), "left")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)) & (F.col("n_repeat_words") <= F.col("share") * F.col("n_words"))
    for doubt, condition in zip(doubts, soft.values(), strict=True):
        kept = kept & ~(F.col(doubt) & F.coalesce(F.expr(condition), F.lit(False)))
    return joined.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
