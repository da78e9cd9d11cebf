"""Part of the curation engine; see the README for its modules."""
