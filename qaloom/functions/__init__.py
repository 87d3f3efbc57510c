"""Column-level building blocks: text rules, ids, templates, images."""
