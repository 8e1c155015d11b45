"""Readers and writers: raw mail, labelled CSV, history tables."""
