"""Quality rules per document and per host, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import computed, cut

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_SALTS = 16
#: Fixed values of the further rules: at most so many symbols per word, so large a share of repeated lines, and a mean
#: word length within these bounds.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_LENGTH = 0.1, 0.4, (3.0, 10.0)
RULES = ("symbols", "dup_lines", "word_length")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def measure(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, word_bytes, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed to
    docs(text, ...).

    Repeated three-word windows are found by sorting the 64-bit hashes of a text's windows with their places, so that
    a long text costs n log n. Null text: no words, all counts 0, base_failed. Other columns are kept.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, _SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    trimmed = F.btrim(text, F.lit(_SPACES))
    first = computed(docs, {
        "_words": F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")),
        "word_chars": F.length(bare).cast("long"),
        "word_bytes": F.octet_length(bare).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "_lines": lines,
    })
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))))
    second = computed(first, {
        "n_words": n.cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": F.array_sort(windows),
    }, [*docs.columns, "word_chars", "word_bytes", "n_symbols"])
    near = lambda k: F.get("_sorted", k)["h"]
    again = F.transform(F.filter("_sorted", lambda x, k: (near(k - 1).eqNullSafe(x["h"])) | (near(k + 1).eqNullSafe(x["h"]))), lambda x: x["i"])
    third = computed(second, {"_again": F.array_sort(again)}, [c for c in second.columns if c != "_sorted"])
    covered = _sum(F.transform("_again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_again", k + 1) - i, F.lit(3))).cast("long")))
    out = third.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_again")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def excess() -> dict[str, Column]:
    """Each further rule's measure over its bound: a document of :func:`measure` fails the rule alone above 1.

    Word length has no upper bound where characters take two bytes or more on average: such scripts may have no spaces.
    A document without words has no excess; the base rules reject it.
    """
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    long = F.when(F.col("word_bytes") < 2 * F.col("word_chars"), ratio(F.col("word_chars"), F.col("n_words")) / WORD_LENGTH[1]).otherwise(0.0)
    return {"symbols": ratio(F.col("n_symbols"), F.col("n_words")) / MOST_SYMBOLS,
            "dup_lines": ratio(F.col("n_dup_lines"), F.col("n_lines")) / MOST_DUP_LINES,
            "word_length": F.greatest(long, WORD_LENGTH[0] * ratio(F.col("n_words"), F.col("word_chars")))}


def host_rates(measured: DataFrame, further: tuple[str, ...] = ()) -> DataFrame:
    """Failures of each host, shrunk to what hosts have in common.

    measured(host, base_failed) -> host, n, failed, rate. Hosts' failure rates are taken as draws from a beta
    distribution whose mean and spread are estimated by moments over all hosts, weighted by size. A host's rate is the
    posterior mean (failed + a) / (n + a + b): a host of few documents stays close to the mean. Documents without a
    host are no group. If hosts differ no more than chance, the spread is 0 and every rate is the mean. Each of the
    ``further`` rules (a boolean column failed_<rule>) gives a column rate_<rule> by a prior of its own.
    """
    flags = {"failed": "base_failed"} | {f"failed_{r}": f"failed_{r}" for r in further}
    hosts = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(k) for k, c in flags.items()])
    n = F.col("n").cast("double")
    sums = [x for k in flags for x in (F.sum(F.col(k).cast("double")).alias(f"f_{k}"), F.sum(n * (F.col(k) / n) * (F.col(k) / n)).alias(f"npp_{k}"))]
    moments = hosts.agg(F.sum(n).alias("N"), F.sum(n * n).alias("N2"), F.count(F.lit(1)).alias("k"), *sums)

    def prior(k: str) -> list[Column]:
        mean = F.col(f"f_{k}") / F.col("N")
        between = F.col(f"npp_{k}") - F.col("N") * mean * mean  # weighted sum of squares of hosts' rates about the mean
        noise = mean * (1 - mean)
        spread = F.try_divide(between - (F.col("k") - 1) * noise, F.col("N") - F.col("N2") / F.col("N") - (F.col("k") - 1))
        # A beta distribution has a + b = noise / spread - 1; kept between 1 and 1e9.
        strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e9), noise / spread - 1))).otherwise(F.lit(1e9))
        return [mean.alias(f"mean_{k}"), strength.alias(f"strength_{k}")]

    priors = moments.select(*[x for k in flags for x in prior(k)])
    rate = lambda k: (F.col(k) + F.col(f"mean_{k}") * F.col(f"strength_{k}")) / (F.col("n") + F.col(f"strength_{k}"))
    return hosts.join(F.broadcast(priors)).select("host", "n", "failed", rate("failed").alias("rate"), *[rate(f"failed_{r}").alias(f"rate_{r}") for r in further])


def judge(docs: DataFrame, limit: float = 0.9) -> DataFrame:
    """Verdicts of document rules and host rules.

    docs(doc_id, text, source, ...) -> doc_id, text_key (hash of the text), the counts of :func:`measure`,
    base_failed, host_rate (null without a host), kept, sound. A document is kept if it passes the base rules and the
    shrunk failure rate of its host (the source) is below ``limit``. It is sound if it is kept, passes each further
    rule and its host's shrunk rate of that rule is below ``limit``; a rule's bound falls to (1 - rate / 2) of itself
    with that rate, so that a document that comes close passes unless much of its host fails. One row per input row;
    rows that repeat count each. Null source: the document's own counts alone decide. Empty table: no rows. Other
    columns are ignored.
    """
    measured = measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("host")))
    over = excess()
    measured = cut(measured.withColumn("text_key", F.xxhash64("text")).drop("text").withColumns({f"over_{r}": over[r] for r in RULES})
                   .withColumns({f"failed_{r}": F.col(f"over_{r}") > 1 for r in RULES}).drop("word_bytes", "n_lines"))
    rates = host_rates(measured, RULES)
    # A host may hold a third of all documents: it is dealt over salts, and its one row is repeated for each.
    salted = measured.withColumn("salt", F.pmod(F.hash("doc_id", "text_key"), F.lit(_SALTS)))
    rates = rates.select("host", F.col("rate").alias("host_rate"), *[f"rate_{r}" for r in RULES], F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    out = salted.join(rates, ["host", "salt"], "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) < limit)
    sound = kept
    for r in RULES:
        rate = F.coalesce(f"rate_{r}", F.lit(0.0))
        sound = sound & (F.col(f"over_{r}") <= 1 - rate / 2) & (rate < limit)
    return out.select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
                      kept.alias("kept"), sound.alias("sound"))
