"""Structured Streaming: landed packets -> gate -> packets; stateful gap tracking with late healing."""
