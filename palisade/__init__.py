"""Palisade: a PySpark-native security scan engine for code, diffs and prompts."""

from palisade.catalogue import RULES, Pattern, Rule
from palisade.settings import ScanConfig, load_config

__all__ = ["RULES", "Pattern", "Rule", "ScanConfig", "load_config"]
