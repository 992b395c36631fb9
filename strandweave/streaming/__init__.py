"""Structured Streaming forms: windows with late data, replays that file nothing twice, rate limits, idle sessions."""
