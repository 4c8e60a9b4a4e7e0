"""Plan building blocks shared by operators: lineage cuts, hash-bucketed ranks and prefixes, size-checked joins."""
