"""From findings to results: order, cap, file results, summaries and report views. All are frames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.config import SEVERITY_WEIGHTS, Config
from folioscan.skew import numbered
from folioscan.staging import stage

#: File types, states and statuses.
TYPES = ("Word", "Excel", "PDF", "不支持")
PASS, ISSUE, ERROR = "pass", "issue", "error"


def ordered(issues: DataFrame) -> DataFrame:
    """With seq, the place of each issue in its document."""
    return issues.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("unit_idx", "ord", "rule_key", "detail")))


def capped(issues: DataFrame, config: Config | None = None) -> DataFrame:
    """The first issues of each document, as many as one may have; engine notes are beside the cap."""
    most = (config or Config()).max_issues_per_file
    notes, others = issues.where("rule_key = 'engine_note'"), issues.where("rule_key <> 'engine_note'")
    return ordered(others).where(F.col("seq") <= most).unionByName(notes.withColumn("seq", F.lit(most + 1)))


def active(issues: DataFrame) -> DataFrame:
    return issues.where("state <> 'ignored'")


def file_results(files: DataFrame, issues: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per file with its status and counts. ``files``: doc_id, file_name, file_type, file_size, error_message (null if read)."""
    live = F.col("state") != "ignored"
    counts = issues.groupBy("doc_id").agg(
        F.count("*").alias("issue_count"), F.count_if(live).alias("active_issue_count"), F.countDistinct(F.when(live, F.col("rule_key"))).alias("rule_count"),
        *(F.count_if(live & (F.col("severity") == s)).alias(s) for s in SEVERITY_WEIGHTS),
    )
    names = ["issue_count", "active_issue_count", "rule_count", *SEVERITY_WEIGHTS]
    rows = files.join(counts, "doc_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    status = F.when(F.col("error_message").isNotNull(), ERROR).when(F.col("issue_count") > 0, ISSUE).otherwise(PASS)
    return rows.withColumn("status", status).withColumn("truncated", F.col("issue_count") >= (config or Config()).max_issues_per_file)


def without_blank(results: DataFrame, contents: DataFrame) -> DataFrame:
    """Without passed files that hold nothing; ``contents``: doc_id, content_count (paragraphs and tables, or cells)."""
    blank = (F.col("status") == PASS) & (F.col("issue_count") == 0) & (F.coalesce("content_count", F.lit(0)) == 0) & F.col("file_type").isin("Word", "Excel")
    return results.join(contents, "doc_id", "left").where(~blank).drop("content_count")


def summary(results: DataFrame, issues: DataFrame | None, totals: dict[str, int] | None = None) -> DataFrame:
    """One row of totals. A file whose issues are all ignored has passed; checked issues still count. With the ``totals`` of ``written`` no issues are read."""
    files = results.agg(F.count("*").alias("total_files"), F.count_if(F.col("status") == ERROR).alias("error_files"), F.count_if((F.col("status") != ERROR) & (F.col("active_issue_count") > 0)).alias("issue_files"))
    files = files.withColumn("pass_files", F.col("total_files") - F.col("error_files") - F.col("issue_files"))
    if totals is None:
        files = files.join(issues.agg(*_totals()))  # one row each
    else:
        files = files.withColumns({k: F.lit(v).cast("long") for k, v in totals.items()})
    return files.withColumn("pass_rate", F.when(F.col("total_files") > 0, F.round(100 * F.col("pass_files") / F.col("total_files"), 1)).otherwise(0.0))


def _totals() -> list[Column]:
    live = F.col("state") != "ignored"
    counts = [F.count_if(live).alias("total_issues"), *(F.count_if(live & (F.col("severity") == s)).alias(f"{s}_issues") for s in SEVERITY_WEIGHTS)]
    return [*counts, F.count_if(~live).alias("ignored_count"), F.count_if(F.col("state") == "checked").alias("checked_count")]


def written(issues: DataFrame, name: str = "issues", by: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """The issues, staged, and their totals, which are counted in the pass that writes them, so that texts are read and rules run once.

    A listener for queries can see the totals under ``name``; tasks that are run again count once, as the counting is the last thing before the file.
    """
    seen = Observation(name)
    kept = stage(issues.observe(seen, *_totals()), name, by)
    return kept, dict(seen.get)


def by_type(results: DataFrame) -> DataFrame:
    """(file_type, files), every type there."""
    types = results.sparkSession.createDataFrame([(t,) for t in TYPES], "file_type string")
    return types.join(results.groupBy("file_type").agg(F.count("*").alias("n")), "file_type", "left").select("file_type", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def by_rule(issues: DataFrame) -> DataFrame:
    """(rule_title, issues, share, place): most frequent first; equal ones in alphabetical order."""
    counts = active(issues).groupBy("rule_title").agg(F.count("*").alias("issues"))
    share = F.round(100 * F.col("issues") / F.sum("issues").over(W.partitionBy()), 1)
    return counts.select("*", share.alias("share"), F.row_number().over(W.orderBy(F.desc("issues"), "rule_title")).alias("place"))  # one row per rule


def weight(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, w) for s, w in SEVERITY_WEIGHTS.items()), F.lit(0))


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` gravest active issues, in document order among equals."""
    return active(issues).withColumn("weight", weight(F.col("severity"))).orderBy(F.desc("weight"), "doc_id", "unit_idx", "ord", "detail").limit(n)


def top_rules(issues: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most frequent rules with their first suggestion that is not empty."""
    first = F.min_by("suggestion", F.when(F.col("suggestion") != "", F.struct("doc_id", "unit_idx", "ord"))).alias("suggestion")
    return active(issues).groupBy("rule_title").agg(F.count("*").alias("issues"), first).orderBy(F.desc("issues"), "rule_title").limit(n)


def filtered(issues: DataFrame, severity: str | None = None, state: str | None = None, keyword: str = "") -> DataFrame:
    """Issues by severity, state and a word in title, detail, location or file name."""
    rows = issues
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if state:
        rows = rows.where(F.col("state") == state)
    if keyword:
        where = F.lower(F.concat_ws(" ", "rule_title", "detail", "location", *[c for c in ("file_name",) if c in issues.columns]))
        rows = rows.where(F.contains(where, F.lit(keyword.lower())))
    return rows


def report_mode(results: DataFrame, issues: DataFrame, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """With mode fluency only sentence findings, and the files that have some; otherwise all."""
    if mode != "fluency":
        return results, issues
    own = issues.where(F.startswith("rule_key", F.lit("fl_")))
    return results.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), own


def file_details(issues: DataFrame) -> DataFrame:
    """Active issues numbered within their file."""
    rows = ordered(active(issues))
    return rows.withColumnRenamed("seq", "no")


def unreadable(results: DataFrame) -> DataFrame:
    """The files that can't be read, numbered by name."""
    return numbered(results.where(F.col("status") == ERROR), "no", "file_name", "doc_id").select("no", "file_name", "file_type", "error_message")


def conclusion(totals: DataFrame) -> DataFrame:
    """The closing line of a report."""
    text = F.when(F.col("high_issues") > 0, F.concat(F.lit("存在 "), F.col("high_issues").cast("string"), F.lit(" 处严重问题，建议优先整改"))).when(F.col("total_issues") > 0, F.lit("未发现严重问题，建议按清单逐项复核")).otherwise(F.lit("未发现问题"))
    return totals.select("total_files", "total_issues", text.alias("conclusion"))


def with_labels(issues: DataFrame, states: DataFrame) -> DataFrame:
    """Issues with the review states of their documents: ``states`` has doc_id and state."""
    return issues.drop("state").join(states, "doc_id", "left").withColumn("state", F.coalesce("state", F.lit("normal")))


def page_of_log(log: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest entries first."""
    return log.orderBy(F.desc("ts"), F.desc("event")).offset(offset).limit(limit)
