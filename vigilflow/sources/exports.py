"""Writers for exports, artifacts and the audit trail."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from vigilflow.functions.privacy import scrub_json

log = logging.getLogger(__name__)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, minimal quoting, quotes doubled, empty text as nothing."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def append_audit(events: DataFrame, path: str) -> bool:
    """Append scrubbed audit rows; a failed write is logged, and the main job goes on."""
    scrubbed = scrub_json(events, "details")
    try:
        scrubbed.write.mode("append").parquet(path)
    except (Py4JJavaError, PySparkException):
        log.exception("audit rows were not written to %s", path)
        return False
    return True
