"""Sources: test tables, the feed writer (encoder), control replies, landed packet files."""
