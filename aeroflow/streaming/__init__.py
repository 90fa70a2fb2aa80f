"""Structured Streaming jobs; each gives the rows that its batch form gives."""
