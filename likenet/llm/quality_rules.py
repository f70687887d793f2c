"""Quality rules for documents and for the hosts they come from, in DataFrame functions only.

Each text is measured by itself, without a shuffle. Rule failures are then summed by host; a host's rate of
failure is shrunk towards the rate that hosts have in general, by a beta prior fitted to all hosts by
moments, so that a host of few documents is judged by little more than the prior. A host whose shrunk rate
is over ``max_rate`` under any rule is rejected, and all of its documents with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A document's rules: each is true where the document fails.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > n_words",
}
#: The rules that reject a document by itself.
BASE = ("short", "repeats")
SYMBOLS = "#*$%&|<>"
#: So many rejected hosts are broadcast (a host name has 253 characters at most, so they take 13 MB); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), host_col: str = "source") -> DataFrame:
    """The columns ``keep``, host, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    df = docs.select(*keep, F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    df = df.withColumn("words", F.expr(r"filter(split(body, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    df = df.withColumn("lines", F.expr(r"filter(split(body, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    # Windows of three words, sorted by hash, so that equal ones are neighbours.
    df = df.withColumn(
        "windows",
        F.expr(
            "case when size(words) < 3 then array() else sort_array(transform(sequence(0, size(words) - 3),"
            " i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) as h, i as i))) end"
        ),
    )
    df = df.withColumn(
        "starts",
        F.expr("filter(transform(windows, (w, k) -> if(w.h = get(windows, k - 1).h or w.h = get(windows, k + 1).h, w.i, null)), i -> i is not null)"),
    )
    bare = reduce(lambda c, x: F.replace(c, F.lit(x)), " \t\n\x0b\x0c\r", F.col("body"))
    plain = reduce(lambda c, x: F.replace(c, F.lit(x)), SYMBOLS, F.col("body"))
    long = lambda c: c.cast("long")
    return df.select(
        *keep,
        "host",
        long(F.size("words")).alias("n_words"),
        long(F.char_length(bare)).alias("word_chars"),
        long(F.octet_length("body") - F.octet_length(plain)).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size(F.array_distinct(F.expr("flatten(transform(starts, i -> array(i, i + 1, i + 2)))")))).alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, host_docs, <rule>_rate (shrunk) and host_rejected, of every host that isn't null.

    The prior of a rule has the mean and variance of the hosts' rates. Where rates don't differ, every host gets the
    mean; where they differ as much as zeros and ones do, they aren't shrunk.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), *(F.sum(F.expr(f"if({rule}, 1, 0)")).alias(name) for name, rule in RULES.items())
    )
    rates = {name: F.expr(f"{name} / host_docs") for name in RULES}
    moments = hosts.agg(*(f(rate).alias(f"{name}_{k}") for name, rate in rates.items() for k, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    for name, rate in rates.items():
        m, v = moments[f"{name}_mean"] or 0.0, moments[f"{name}_var"] or 0.0
        strength = m * (1 - m) / v - 1 if v > 1e-12 else None
        shrunk = F.lit(m) if strength is None else rate if strength <= 0 else (F.col(name) + m * strength) / (F.col("host_docs") + strength)
        hosts = hosts.withColumn(f"{name}_rate", shrunk)
    rejected = reduce(lambda a, b: a | b, (F.col(f"{name}_rate") > max_rate for name in RULES))
    return hosts.select("host", "host_docs", *(f"{name}_rate" for name in RULES), rejected.alias("host_rejected"))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = ("doc_id",), max_rate: float = 0.5) -> DataFrame:
    """The columns ``keep``, host, the measures, base_failed and kept, one row per row of the input.

    Null and empty texts have no words and so fail. A null host has no verdict: its documents are judged by
    themselves. Repeated rows are judged, and count for their host, once each. Long texts are measured whole. An empty
    table gives an empty result; columns other than ``keep`` are ignored.
    """
    measured = materialize(measures(docs, text_col, keep, host_col), "measures")
    rejected = host_verdicts(measured, max_rate).where("host_rejected").select(F.col("host").alias("rejected_host"))
    rejected = materialize(rejected, "hosts")
    if rejected.count() <= BROADCAST_HOSTS:  # documents then stay where they are, however many one host has
        rejected = F.broadcast(rejected)
    failed = reduce(lambda a, b: a | b, (F.expr(RULES[name]) for name in BASE))
    return (
        measured.join(rejected, F.col("host") == F.col("rejected_host"), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected_host").isNull())
        .drop("rejected_host")
    )
