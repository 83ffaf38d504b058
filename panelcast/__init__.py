"""Panel forecasting as ordinary Spark DataFrame, window and ML plans."""

from panelcast.spec import PanelSpec

__all__ = ["PanelSpec"]
