"""Sinks: tables (path or catalog, with preflight), JDBC, quarantine and the audit log."""
