"""Structured Streaming: inboxes, late matches, latest-wins state, event windows."""
