"""Structured Streaming over the events table: windows with watermarks, sessions, duplicates, a table sink (extensions)."""
