"""Plan plumbing: staging of intermediate tables and session tuning."""
