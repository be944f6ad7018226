"""Named queries and the whole dataflow."""
