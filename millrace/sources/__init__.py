"""Readers and writers: dense CSV, indexed centers, click-log TSV, LibSVM, run-log tables."""
