"""Batch scoring of a payload: contract, forecast, totals, tags."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from panelcast.functions.lineage import materialise
from panelcast.operators.baselines import fallback_forecast
from panelcast.operators.contract import ContractViolation, contract_report, enforce
from panelcast.operators.encoding import CodeMaps
from panelcast.operators.learners import forecast_model
from panelcast.operators.reconcile import tag, with_total
from panelcast.sources.panel import missing_columns, normalise_dates
from panelcast.sources.sinks import append_prediction_log
from panelcast.spec import PanelSpec


def score_payload(
    payload: DataFrame,
    model: PipelineModel | None,
    codes: CodeMaps | None,
    model_version: str = "none",
    run_id: str | None = None,
    include_total: bool = True,
    allow_fallback: bool = False,
    spec: PanelSpec = PanelSpec(),
    log: str | None = None,
    day: str | None = None,
) -> DataFrame:
    """Tagged forecasts of the month after the payload.

    Dates may be text or any day of their month. Without a model the payload is refused,
    unless persistence was asked for; that path checks the columns only, and its rows say
    ``fallback``. With ``log``, a folder, the forecast is also appended there under ``day``.
    """
    absent = missing_columns(payload, spec)
    if absent:
        raise ContractViolation("required_columns", ", ".join(absent))
    payload = normalise_dates(payload, spec)
    if model is None:
        if not allow_fallback:
            raise RuntimeError("no model given and fallback not allowed")
        rows, source, version, contract = fallback_forecast(payload, spec), "fallback", "none", 0
        out = with_total(rows, spec) if include_total else rows
        return _logged(tag(out, source, version, run_id, contract), log, day)
    enforce(contract_report(payload, codes, spec))
    rows = forecast_model(payload, model, spec)
    out = with_total(rows, spec) if include_total else rows
    return _logged(tag(out, "model", model_version, run_id), log, day)


def _logged(forecast: DataFrame, log: str | None, day: str | None) -> DataFrame:
    """The forecast itself, or what was logged of it, so both are the same rows."""
    if log is None:
        return forecast
    written = materialise(forecast)
    append_prediction_log(written, log, day or date.today().isoformat())
    return written
