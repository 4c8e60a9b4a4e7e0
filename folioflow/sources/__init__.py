"""Readers and writers: tables, archives, labels, manifests, reports."""
