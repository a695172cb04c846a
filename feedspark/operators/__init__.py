"""Operators: numbering, keys, packets, loss, recovery, framing."""
