"""Payment screening on Spark: detectors, trust history, ledgers and analytics as DataFrame jobs."""

from .config import ScreenConfig
from .plans.screen import Ledgers, ScreenResult, register_detector, screen, update_ledgers

__all__ = ["ScreenConfig", "Ledgers", "ScreenResult", "register_detector", "screen", "update_ledgers"]
