"""Tables on storage: corpora, score tables, verdict snapshots."""
