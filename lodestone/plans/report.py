"""The status report as a handful of small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.operators import status as st


def status_report(discovered: DataFrame, status: DataFrame, failures: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": st.totals(discovered, status, failures),
        "statuses": st.status_counts(status),
        "stages": st.stage_counts(status),
        "recent_failures": st.recent_failures(failures),
        "processing_rate": st.processing_rate(status),
    }
