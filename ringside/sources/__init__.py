"""Scans, sinks and the checks around them."""
