"""Structured Streaming: windows over events, and counters over the last minute."""
