"""Quality rules by host: each document is counted against rules, rule failures are summed by host, each host's failure rate is
shrunk towards an empirical beta prior, and the host's verdict decides how strictly its documents are held to the rules.

Base rules (fewer than 50 words; more than half of the words in repeated windows of three) always drop a document. The
other rules are soft: marks of junk that a clean text can show by chance. In a host that is trusted (shrunk rate at most
TRUSTED) a document is dropped for two soft failures, in an ordinary one for one, and a host whose rate is at least
REJECTED after shrinking loses all documents.

The prior is a beta distribution with the mean of all documents and the variance of the hosts' rates beyond what chance makes
(method of moments, over hosts with rows as weights), of at least MIN_PRIOR and at most MAX_PRIOR documents.

Defined results: null text has no words. A null host is a host of its own. Repeated rows count each. An empty table gives
an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datewright.llm.common import lookup, materialize
from datewright.llm.quality_stats import document_counts

MIN_WORDS, MOST_REPEATED = 50, 50
TRUSTED, REJECTED = 0.02, 0.9
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def soft_rules() -> dict[str, Column]:
    """True where a document fails."""
    n, letters = F.col("n_words"), F.col("n_upper") + F.col("n_lower")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "marks": 3 * F.col("n_marks") > n,
        "dup_lines": (F.col("n_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "upper": 2 * F.col("n_upper") > letters,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
    }


def host_verdicts(counted: DataFrame) -> DataFrame:
    """host_null, host, rows, failures, rate, shrunk, verdict of each host. counted: with host_null, host, failed."""
    hosts = counted.groupBy("host_null", "host").agg(F.count("*").alias("rows"), F.sum(F.col("failed").cast("long")).alias("failures"))
    total = hosts.agg(
        F.sum("rows").alias("all_rows"),
        (F.sum("failures") / F.sum("rows")).alias("mean"),
        F.count("*").alias("n_hosts"),
        F.sum(F.col("failures") * F.col("failures") / F.col("rows")).alias("squares"),
        F.sum("failures").alias("all_failures"),
        (F.sum("rows") - F.sum(F.col("rows") * F.col("rows")) / F.sum("rows")).alias("spread"),
    )
    # between-host variance: rows-weighted sum of squares less what a binomial of the mean would make
    between = F.try_divide(F.col("squares") - F.col("all_failures") * F.col("mean") - (F.col("n_hosts") - 1) * F.col("mean") * (1 - F.col("mean")), F.col("spread"))
    strength = F.when(between > 0, F.col("mean") * (1 - F.col("mean")) / between - 1).otherwise(F.lit(MAX_PRIOR))
    prior = total.select("mean", F.greatest(F.lit(MIN_PRIOR), F.least(F.lit(MAX_PRIOR), F.coalesce(strength, F.lit(MAX_PRIOR)))).alias("strength"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("rows") + F.col("strength"))
    return (
        hosts.crossJoin(F.broadcast(prior))  # one row
        .withColumn("rate", F.col("failures") / F.col("rows"))
        .withColumn("shrunk", shrunk)
        .withColumn("verdict", F.when(F.col("shrunk") >= REJECTED, "rejected").when(F.col("shrunk") <= TRUSTED, "trusted").otherwise("ordinary"))
        .drop("mean", "strength")
    )


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, n_failed (soft rules), host_rate (shrunk), host_verdict, kept."""
    rules = soft_rules()
    counted = (
        document_counts(docs, "doc_id", host)
        .withColumn("base_failed", base_failed())
        .withColumn("n_failed", sum((r.cast("int") for r in rules.values()), F.lit(0)))
        .withColumn("failed", F.col("base_failed") | (F.col("n_failed") > 0))
        .withColumn("host_null", F.col(host).isNull())
    )
    counted = materialize(counted.withColumn("h", F.coalesce(F.col(host).cast("string"), F.lit(""))).drop(host).withColumnRenamed("h", "host"), "counted")
    hosts = materialize(host_verdicts(counted), "hosts")
    judged = lookup(counted, hosts.select("host_null", "host", F.col("shrunk").alias("host_rate"), F.col("verdict").alias("host_verdict")), ["host_null", "host"], "inner", hosts.count())
    strict = F.when(F.col("host_verdict") == "rejected", F.lit(False)).when(F.col("host_verdict") == "trusted", F.col("n_failed") < 2).otherwise(F.col("n_failed") < 1)
    return judged.withColumn("kept", ~F.col("base_failed") & strict).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("n_failed").cast("long").alias("n_failed"), F.round("host_rate", 9).alias("host_rate"), "host_verdict", "kept"
    )


#: DuckDB SQL for the rows of quality_rules().
ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
windows as (select rid, i, w[i:i + 2] as key from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, key) as n from windows) where n > 1),
repeated as (select rid, count(distinct i + k) as n from (select rid, i, unnest([0, 1, 2]) as k from twice) group by rid),
lines as (select rid, count(*) as n, count(*) - count(distinct line) as dup from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
counted as (
  select d.rid, doc_id, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
         coalesce(l.n, 0) as n_lines, coalesce(l.dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(regexp_extract_all(text, '[!?#*$%&|<>@^~=+_\\{}\[\]]')) as n_marks, len(regexp_extract_all(text, '[A-Z]')) as n_upper, len(regexp_extract_all(text, '[a-z]')) as n_lower
  from d join w on w.rid = d.rid left join lines l on l.rid = d.rid left join repeated r on r.rid = d.rid),
ruled as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         (10 * n_symbols > n_words)::bigint + (3 * n_marks > n_words)::bigint + (n_lines >= 3 and 2 * n_dup_lines > n_lines)::bigint + (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint
         + (2 * n_upper > n_upper + n_lower)::bigint + (100 * n_repeat_words > 30 * n_words)::bigint as n_failed
  from counted),
hosts as (select source, count(*)::double as n, count(*) filter (base_failed or n_failed > 0)::double as f from ruled group by source),
overall as (select sum(f) / sum(n) as mean, count(*) as hosts, sum(f * f / n) as squares, sum(f) as f, sum(n) - sum(n * n) / sum(n) as spread from hosts),
prior as (select mean, case when spread > 0 and squares - f * mean - (hosts - 1) * mean * (1 - mean) > 0 then mean * (1 - mean) * spread / (squares - f * mean - (hosts - 1) * mean * (1 - mean)) - 1 else 1000 end as strength from overall),
verdicts as (select source, (f + mean * greatest(2, least(1000, strength))) / (n + greatest(2, least(1000, strength))) as rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed, round(rate, 9) as host_rate, case when rate >= 0.9 then 'rejected' when rate <= 0.02 then 'trusted' else 'ordinary' end as host_verdict,
       not base_failed and rate < 0.9 and n_failed < case when rate <= 0.02 then 2 else 1 end as kept
from ruled r join verdicts v on v.source is not distinct from r.source
"""
