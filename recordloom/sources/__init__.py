"""Readers and writers: store files, exports, foreign lists, decision log."""
