"""Writers: findings, baselines, documents, scan history, suppressions."""

from .tables import (write_baseline, write_corpus, write_documents, write_findings)
from .store import HistoryStore

__all__ = ["HistoryStore", "write_baseline", "write_corpus", "write_documents", "write_findings"]
