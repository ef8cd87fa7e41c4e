"""Distributed sinks: CSV, JSON, XML, MBOX, HTML and reports."""
