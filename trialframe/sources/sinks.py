"""Writers of artifacts, ledgers and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRMATORY = ("hypothesis", "task", "condition_A", "condition_B", "n_complete_pairs", "wilcoxon_statistic", "p_value_one_sided", "rank_biserial_r", "holm_bonferroni_rejected", "interpretation")


def write_artifacts(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """JSON records in a folder for each run, added to what is there."""
    rows.write.mode("append").partitionBy(run).json(path)


def write_ledger(rows: DataFrame, path: str) -> None:
    """Replaces the ledger as a whole; ``rows`` must not read from ``path``."""
    rows.write.mode("overwrite").parquet(path)


def nan_text(value: Column, digits: int = 6) -> Column:
    """Rounded, with NaN as the text ``nan``."""
    return F.when(F.isnan(value), "nan").otherwise(F.round(value, digits).cast("string"))


def nan_null(value: Column, digits: int = 6) -> Column:
    return F.when(~F.isnan(value), F.round(value, digits))


def null_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("nan")))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], single: bool = False) -> None:
    """CSV with a header; nested columns as JSON.  ``single`` is for reports of a few rows."""
    kinds = dict(rows.dtypes)
    out = rows.select(*(F.to_json(c).alias(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(c) for c in columns))
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def summary_lines(tests: DataFrame) -> DataFrame:
    """A line of text for each test (hypothesis, task, n_pairs, w_plus, r_rb), in their order; a report of a few rows."""
    line = F.format_string("%-4s %-4s n=%3d  W=%8.1f  r=%+.3f", "hypothesis", "task", "n_pairs", "w_plus", "r_rb")
    return tests.orderBy("hypothesis", "task").select(line.alias("line"))


# The columns of the other result files, in their order.
EXPLORATORY = ("analysis", "hypothesis", "task", "cond_a", "cond_b", "model", "n_pairs", "n_pos", "n_neg", "n_tie", "median_diff", "statistic", "raw_p", "holm_p", "r_rb", "ci_low", "ci_high", "status")
EXPORT = (
    "run_id", "item_id", "model", "function", "task", "condition", "item_status", "started_at", "finished_at", "attempt_count", "prompt_artifact_path", "response_artifact_path", "score_artifact_path", "prompt_artifact_exists",
    "response_artifact_exists", "score_artifact_exists", "score", "scorer_status", "scorer_failure_reason_code", "scorer_failure_reason_message", "score_subscores_json", "score_evidence_json", "execution_failure_reason_code",
    "execution_failure_reason_message", "skip_reason", "missing_expected_artifacts_json",
)


def write_confirmatory(decisions: DataFrame, path: str) -> None:
    """The ten columns of a confirmatory result (see ``stats.decisions``) as CSV, a statistic or p that is undefined as the text ``nan``; a report of a few rows."""
    text = lambda c: F.coalesce(F.when(F.isnan(c), "nan").otherwise(F.col(c).cast("string")), F.lit("nan")).alias(c)
    shown = [text(c) if c in ("wilcoxon_statistic", "p_value_one_sided") else F.col(c) for c in CONFIRMATORY]
    write_csv(decisions.orderBy("hypothesis", "task").select(*shown), path, CONFIRMATORY, single=True)


def write_exploratory(rows: DataFrame, path: str) -> None:
    """The 18 columns of an exploratory result (see ``stats.exploratory``) as CSV, what is undefined left empty; a report of a few rows."""
    write_csv(rows.orderBy("analysis", "model", "hypothesis", "task"), path, EXPLORATORY, single=True)


def write_export(rows: DataFrame, path: str) -> None:
    """The 26 columns of the long export (see ``workflow.export_table``) as CSV with a header in every part."""
    write_csv(rows, path, EXPORT)


def write_run(ledger: DataFrame, audit: DataFrame, export: DataFrame, path: str) -> None:
    """A run's state after a batch: ledger and audit as tables, the long export as CSV, each replaced as a whole."""
    write_ledger(ledger, f"{path}/index")
    write_ledger(audit, f"{path}/audit")
    write_export(export, f"{path}/export")


def exploratory_lines(rows: DataFrame) -> DataFrame:
    """A line of text for each row of an exploratory result, in their order; a report of a few rows."""
    number = lambda c, width: F.lpad(F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.3f", c)), width, " ")
    line = F.concat_ws(" ", F.format_string("%-4s %-5s %-5s %-5s %-18s %3d %3d %3d %3d", "hypothesis", "task", "cond_a", "cond_b", "model", "n_pairs", "n_pos", "n_neg", "n_tie"), number("median_diff", 8), number("statistic", 9), number("raw_p", 7), number("holm_p", 7), number("r_rb", 7), number("ci_low", 7), number("ci_high", 7), F.col("status"))
    return rows.orderBy("analysis", "model", "hypothesis", "task").select(line.alias("line"))
