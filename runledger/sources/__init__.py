"""Readers and writers for snapshots, exports, pages and transcripts."""
