"""Scans, sinks and the input views used by the registered queries."""
