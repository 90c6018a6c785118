"""DataFrame -> DataFrame operators: sections, chunks, requests, responses,
merge/consolidation, reports and joins.  Row-local unless the semantics need
a shuffle (per-paper consolidation, per-key merge, anti join)."""
