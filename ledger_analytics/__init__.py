"""Forensic analysis of payment ledgers on Spark."""

from ledger_analytics.config import AnalysisConfig
from ledger_analytics.operators.screening import ScreeningLists
from ledger_analytics.plans.pipeline import AnalysisResult, analyze
from ledger_analytics.plans.reports import report_tables, write_report
from ledger_analytics.sources.history import RunHistory
from ledger_analytics.sources.ledger_files import auto_mapping, load_csv, load_frame

__all__ = [
    "AnalysisConfig",
    "AnalysisResult",
    "RunHistory",
    "ScreeningLists",
    "analyze",
    "auto_mapping",
    "load_csv",
    "load_frame",
    "report_tables",
    "write_report",
]
