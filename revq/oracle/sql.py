"""All oracle queries."""

from __future__ import annotations

from revq.oracle import adhoc, model, views, whatif


def all_queries() -> dict[str, str]:
    found = model.queries() | adhoc.queries() | views.queries() | whatif.queries()
    # Results that were written and read back, or made in SQL, equal their plain forms.
    same = {
        "A03_counts_from_cells": "Q11_cannibalisation",
        "S07_written_facts": "D06_fact_orders",
        "S09_views_from_cells": "V12_risk_adjusted_summary",
        "U01_sql_functions": "Q04_revenue_loss_by_band",
        "U03_refreshed_summary": "P01_monthly_summary",
        "U03_refreshed_by_month": "P01_monthly_summary",
    }
    return found | {name: found[plain] for name, plain in same.items()}
