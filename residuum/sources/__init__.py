"""Readers and writers: structure files, label tables, search reports, tables of many files."""
