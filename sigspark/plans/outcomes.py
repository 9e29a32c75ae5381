"""Outcome labels, excursions, touches and quality reasons."""

from sigspark.plans.records_fixture import examples, labelled
from sigspark.plans.registry import query

C = "exit_price return_pct directional_return max_rise max_drop risk_pct rr"
query("label_daily_outcomes", f"SELECT signal_id, horizon, status, completed, missing_reason, {', '.join(C.split())}, target_hit, stop_hit FROM outc", f=C)(
    lambda s, d: labelled(s, d).select("signal_id", "horizon", "status", "completed", "missing_reason", *C.split(), "target_hit", "stop_hit"))
E5 = "mfe mae mfe_before_stop mae_before_target approach_ratio"
query("excursions", f"SELECT signal_id, horizon, {', '.join(E5.split())} FROM outc", f=E5)(
    lambda s, d: labelled(s, d).select("signal_id", "horizon", *E5.split()))
query("first_touch", "SELECT signal_id, horizon, first_touch FROM outc")(
    lambda s, d: labelled(s, d).select("signal_id", "horizon", "first_touch"))
query("outcome_quality_reason", "SELECT signal_id, horizon, reason FROM ex")(
    lambda s, d: examples(s, d).select("signal_id", "horizon", "reason"))
