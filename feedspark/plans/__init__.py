"""Composed plans: the feed plan over the test tables and the registered queries."""
