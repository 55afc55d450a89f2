"""Table builders and the guarded build that publishes them."""
