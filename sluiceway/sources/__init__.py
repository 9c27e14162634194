"""Row sources."""
