"""Code-corpus analytics on Spark."""

from repoatlas.operators.classify import classify, select_analyzer, survey_files
from repoatlas.plans.job import Run, start_run
from repoatlas.plans.profile import Corpus, profile_report, profile_repos, survey_corpus
from repoatlas.sources.scan import scan_repos

__all__ = [
    "Corpus", "Run", "classify", "profile_report", "profile_repos", "scan_repos",
    "select_analyzer", "start_run", "survey_corpus", "survey_files",
]
