"""Row-level operators over observation tables."""
