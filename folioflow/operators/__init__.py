"""Relational operators over page records: pairing, sampling, indexing, lines, reports, references, flattening."""
